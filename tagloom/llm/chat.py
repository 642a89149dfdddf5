"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<s>" role "\\n" text "</s>"  |  "<s esc>" escaped-role "\\n" escaped-text "</s>"

A turn is first rendered verbatim and reparsed by the deterministic parser; where the recovered turn differs from its
source (a role with a line end), or a mark of the template stands in its role or text, it is rendered escaped, in which
form no control string can occur. The whole conversation is then reparsed; it must give the source's turns, else the job
fails. The work per conversation grows with its length, times the logarithm of its number of turns.

Turns are ordered by number, then role, then text (a null number is first); repeated rows are turns of their own. Null
text and role are empty. Rows with a null conversation id form one conversation, as grouping has it. An empty table gives
no conversations. Columns other than the four named ones take no part, whatever their names. A conversation is one row,
as its digest asks; a very long one has to fit in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, BEGIN_ESCAPED, END = "<s>", "<s esc>", "</s>"
TRAINED_ROLE = "assistant"


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, [("~", "~0"), ("<", "~1")])


def escape_role(c: Column) -> Column:
    return _replace(escape(c), [("\n", "~2")])


def unescape(c: Column) -> Column:
    return _replace(c, [("~1", "<"), ("~2", "\n"), ("~0", "~")])


def running_sums(numbers: Column) -> Column:
    """The sums of an array's beginnings, by doubling steps: no array is grown element by element."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + F.lit(1))).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= reach, F.get(sums, i - reach)).otherwise(0))

    return F.aggregate(steps, numbers, step)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text, begin, length>>``: ``begin`` and ``length``
    (code points) place the text as it stands in the formatted string. Null if the string isn't in the grammar."""
    parts = F.split(formatted, END, -1)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _turn)
    ends = running_sums(F.transform(turns, lambda t: t["size"] + len(END)))
    placed = F.zip_with(turns, ends, lambda t, end: F.struct(
        t["role"].alias("role"), t["text"].alias("text"),
        (end - len(END) - t["length"]).alias("begin"), t["length"].alias("length")))
    sound = (F.element_at(parts, -1) == "") & F.forall(turns, lambda t: t["ok"])
    return F.when(sound, placed)


def _turn(part: Column) -> Column:
    escaped = part.startswith(BEGIN_ESCAPED)
    head = F.when(escaped, len(BEGIN_ESCAPED)).otherwise(len(BEGIN))
    line = F.locate("\n", part)
    role = F.substring(part, head + 1, line - head - 1)
    text = F.substring(part, line + 1, F.length(part))
    return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"),
                    F.when(escaped, unescape(text)).otherwise(text).alias("text"),
                    F.length(part).alias("size"), F.length(text).alias("length"),
                    ((line > 0) & (escaped | part.startswith(BEGIN))).alias("ok"))


def render(role: Column, text: Column) -> Column:
    """One turn: verbatim if it holds no mark of the template and parses back to itself, else escaped."""
    plain = F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END))
    marked = F.lit(False)
    for mark in (BEGIN, BEGIN_ESCAPED, END):
        marked = marked | role.contains(mark) | text.contains(mark)
    back = F.split(plain, END, -1)
    turn = _turn(F.element_at(back, 1))
    same = (F.size(back) == 2) & turn["ok"] & (turn["role"] == role) & (turn["text"] == text)
    return F.when(~marked & same, plain).otherwise(
        F.concat(F.lit(BEGIN_ESCAPED), escape_role(role), F.lit("\n"), escape(text), F.lit(END)))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``id_col, formatted, turns, loss_spans`` per conversation: ``turns`` as read back from the formatted string,
    ``loss_spans`` the code point ranges ``[begin, end)`` of the trained role's texts in it."""
    src = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("shown", render(F.col("role"), F.col("text")))
    conv = (src.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("source"))
            .withColumn("formatted", F.array_join(F.transform("source", lambda t: t["shown"]), "")))
    conv = conv.withColumn("turns", parse(F.col("formatted")))
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    same = F.transform("turns", pair).eqNullSafe(F.transform("source", pair))
    conv = conv.withColumn("turns", F.when(same, F.col("turns")).otherwise(
        F.raise_error(F.lit("a formatted conversation doesn't parse back to its turns"))))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == trained_role),
                        lambda t: F.struct(t["begin"].alias("begin"), (t["begin"] + t["length"]).alias("end")))
    return conv.select(F.col("conv").alias(id_col), "formatted", "turns", spans.alias("loss_spans"))


def under_mask(turns: Column, trained_role: str = TRAINED_ROLE) -> Column:
    """All text under the loss mask, unescaped, nothing between: the trained role's texts as ``parse`` read them back."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == trained_role), lambda t: t["text"]), "")
