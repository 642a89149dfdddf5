"""Markdown rendering of wiki markup: a stack automaton over a page's tags, everything else as native expressions.

Tags may nest in any depth, which no built-in function can follow: an ``aggregate`` copies its whole state at every step, so
folding a page in one is quadratic. A small Arrow function therefore reads the pages that hold a tag (the others never
leave the JVM): it meets each tag once, shifts openings on a stack, and folds the frames above a closing tag's opening,
rendered, into the frame below. A tag that isn't closed ends with the tag around it (bold, italic, ... with their line); a closing
tag without an opening one is text. Between ``[nodtext]`` or ``[code]`` and its end nothing is markup. Malformed markup
gives an error with its offset. Headings, links and lists are then found natively in the text that stays, outside of those
blocks."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.markup import ANY_LINK, ATTR_TAGS, SIMPLE_TAGS, link_of, replace_each

# Characters (or words) one of the rules below needs; texts without any are rendered unchanged.
RENDER_HINT = r'[\[<{"@*\r]|http|h[0-9]'

#: A tag or a break. A bracket before ``(`` or ``]`` belongs to a link.
TAG = (rf"\[(?:(?:{'|'.join(SIMPLE_TAGS)})|(?:{'|'.join(ATTR_TAGS)})(?:[ =][^\]\n]*)?)\](?![(\]])"
       rf"|\[/(?:{'|'.join(SIMPLE_TAGS + ATTR_TAGS)})\]|\[[bh]r\]")

# Tags within a line of text: opening and closing HTML. The first four end with their line if they aren't closed.
INLINE = {"b": ("<b>", "</b>"), "i": ("<i>", "</i>"), "u": ("<ins>", "</ins>"), "s": ("<s>", "</s>"), "tn": ("<sub><sup>", "</sub></sup>")}
ONE_LINE = ("b", "i", "u", "s")
TABLE = ("table", "thead", "tbody", "tr")          # hold cells and each other; other text in them is a line end
CELLS = ("thead", "tbody", "tr", "th", "td")
HOLDS_TABLE = ("", "spoilers", "expand", *TABLE)
RAW = ("nodtext", "code")
BREAKS = {"[br]": "<br>\n", "[hr]": "\n<hr>\n"}
HEADINGS = [(r"h([0-9])#([^.\"\n]+)\.[ \t]*([^\n]*?)[ \t]*(?=\n|$)", "<h$1 id=\"$2\">$3</h$1>"),
            (r"h([0-9])\.[ \t]*([^\n]*?)[ \t]*(?=\n|$)", "<h$1>$2</h$1>")]
# Around text that is no markup: noncharacters, which are taken out of every text first.
BEGIN, END = "\ufdd1", "\ufdd2"

_TAG = re.compile(TAG)
_TITLE = re.compile(r'\[expand=\s*"?(.*?)"?\s*\]')


class _Frame:
    """An open tag: how it was written, whether it ends with its line, and the rendered parts gathered so far."""
    __slots__ = ("tag", "raw", "line", "parts")

    def __init__(self, tag: str, raw: str, line: bool):
        self.tag, self.raw, self.line, self.parts = tag, raw, line, []

    def rendered(self, closed: bool) -> str:
        inner = "".join(self.parts)
        if self.tag in INLINE:
            begin, end = INLINE[self.tag]
            whole, rest = inner, ""
            if self.tag in ONE_LINE and not closed:
                whole, newline, rest = inner.partition("\n")
                rest = newline + rest
            return "\n".join(f"{begin}{x.strip(' ')}{end}" for x in whole.split("\n") if x) + rest
        if self.tag in ("table", "tr", "th", "td"):
            return f"<{self.tag}>{inner}</{self.tag}>"
        if self.tag == "quote":
            return f"<blockquote>{inner}</blockquote>"
        if self.tag == "expand":
            title = _TITLE.fullmatch(self.raw)
            return f"<h5>{title[1]}</h5>\n<hr>\n{inner}" if title else inner
        if self.tag == "nodtext":
            return BEGIN + inner + END
        if self.tag == "code":
            return f"{BEGIN}```\n{inner.removesuffix(chr(10))}\n```{END}"
        return f"{self.raw}{inner}[/url]" if self.tag == "url" else inner


def _misplaced(tag: str, within: str) -> str | None:
    """What is wrong with opening a tag within another one."""
    if tag in ("col", "colgroup"):
        return "a column tag has no rendering"
    if within == "url":
        return "a tag inside [url]"
    if within in TABLE and tag not in ("table", *CELLS):
        return "a tag between a table's cells"
    if tag in CELLS and within not in TABLE:
        return "a table part outside of a table"
    if tag == "table" and within not in HOLDS_TABLE:
        return f"a table inside [{within}]"
    return None


def _tag_name(written: str) -> str:
    return re.split(r"[ =\]]", written.strip("[/"), maxsplit=1)[0]


def render_tags(text: str) -> tuple[str, str | None, int | None]:
    """The text with its tags rendered, what is wrong with it, and where."""
    to_come = Counter(m[0] for m in _TAG.finditer(text) if m[0].startswith("[/"))    # a tag that none can close ends with its line
    stack, error, at = [_Frame("", "", False)], None, 0
    is_open = Counter()

    def fold(k: int, closing: str) -> None:
        for _ in range(k):
            frame = stack.pop()
            is_open[frame.tag] -= 1
            stack[-1].parts.append(frame.rendered(frame.line or frame.tag == closing))

    def gather(run: str) -> None:
        if stack[-1].tag in TABLE:
            if run and stack[-1].parts[-1:] != ["\n"]:
                stack[-1].parts.append("\n")
            return
        while run and stack[-1].line and "\n" in run:
            line, _, rest = run.partition("\n")
            stack[-1].parts.append(line)
            k = next(i for i, f in enumerate(reversed(stack)) if not f.line)
            fold(k, "")
            run = "\n" + rest
        if run:
            stack[-1].parts.append(run)

    for m in _TAG.finditer(text):
        written, begin = m[0], m.start()
        closing, top = written.startswith("[/"), stack[-1].tag
        if closing:
            to_come[written] -= 1
        name = _tag_name(written)
        if top in RAW and not (closing and name == top):
            continue                                    # stays in the run of text
        if closing and not is_open[name]:
            continue
        gather(text[at:begin])
        at = m.end()
        if written in BREAKS:
            gather(BREAKS[written])
        elif closing:
            if is_open[name]:                           # a line may have ended it just now
                fold(next(i for i, f in enumerate(reversed(stack), 1) if f.tag == name), name)
            else:
                gather(written)
        else:
            wrong = _misplaced(name, stack[-1].tag)
            if wrong and error is None:
                error = (wrong, begin)
            stack.append(_Frame(name, written, name in ONE_LINE and not to_come[f"[/{name}]"]))
            is_open[name] += 1
    gather(text[at:])
    fold(len(stack) - 1, "")
    return "".join(stack[0].parts), *(error or (None, None))


_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
                        T.StructField("error_at", T.IntegerType())])


@F.pandas_udf(_PARSED)
def _tags(texts: pd.Series) -> pd.DataFrame:
    none = (None, None, None)
    return pd.DataFrame([none if t is None else render_tags(t) for t in texts], columns=["text", "error", "error_at"]).astype(
        {"error_at": "Int32"})


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def parse(body: Column) -> Column:
    """``struct<text, error, error_at>``: the text with its tags rendered, what is wrong, and where (characters before it);
    null for a text without tags."""
    clean = F.translate(F.replace(body, F.lit("\r\n"), F.lit("\n")), BEGIN + END, "")
    return _tags(F.when(body.rlike(TAG), clean))


def _links(c: Column) -> Column:
    def html(m: Column) -> Column:
        return _let(link_of(m), lambda x: F.concat(F.lit('<a href="'), x["url"], F.lit('">'), x["label"], F.lit("</a>")))
    return replace_each(c, ANY_LINK, html)


def _lists(c: Column) -> Column:
    """Flat and nested ``*`` lists: each item becomes ``<li>``; a deeper level opens a ``<ul>``
    beside the item; the newline after a list's last item is consumed when a blank line or the end
    follows."""
    lvl = lambda s: F.length(F.regexp_extract(s, r"^(\*+)", 1))

    def per_text(lines):
        # ``lines`` is a lambda variable: neighbour lookups read the array, they do not recompute it
        n = F.size(lines)

        def render(s, i):
            cur = lvl(s)
            prev = F.when(i > 0, lvl(F.element_at(lines, F.greatest(i, F.lit(1))))).otherwise(F.lit(0))
            nxt = F.when(i < n - 1, lvl(F.element_at(lines, F.least(i + 2, n)))).otherwise(F.lit(0))
            opens = F.when(cur > prev, F.repeat(F.lit("<ul>\n"), cur - prev)).otherwise(F.lit(""))
            closes = F.when(nxt < cur, F.repeat(F.lit("\n</ul>"), cur - nxt)).otherwise(F.lit(""))
            item = F.concat(opens, F.lit("<li>"), F.trim(F.regexp_replace(s, r"^\*+", "")), F.lit("</li>"), closes)
            after_list = (s == "") & (i > 0) & (prev > 0)
            return F.when(cur > 0, item).when(after_list, F.lit(None)).otherwise(s)
        # array_join skips the NULL lines
        return F.array_join(F.transform(lines, render), "\n")
    return F.when(c.rlike(r"(?m)^\*"), _let(F.split(c, "\n"), per_text)).otherwise(c)


def render_segment(c: Column) -> Column:
    """Headings, links and lists of a text without tags."""
    for pattern, html in HEADINGS:
        c = F.regexp_replace(c, pattern, html)
    return _let(_let(c, _links), _lists)


def _finished(text: Column) -> Column:
    """The parsed text with its headings, links and lists, outside of protected blocks."""
    def block(s: Column) -> Column:
        return F.when(s.startswith(BEGIN), F.translate(s, BEGIN + END, "")).otherwise(render_segment(s))
    blocks = F.regexp_extract_all(text, F.lit(f"{BEGIN}[^{END}]*+{END}|[^{BEGIN}]++"), 0)
    return F.when(text.contains(BEGIN), F.array_join(F.transform(blocks, block), "")).otherwise(render_segment(text))


def render(body: Column) -> Column:
    """``struct<markdown, error, error_at>`` of a markup column; a null body has a null markdown."""
    tags = parse(body)
    text = F.coalesce(tags["text"], F.translate(F.replace(body, F.lit("\r\n"), F.lit("\n")), BEGIN + END, ""))
    return F.struct(F.when(body.rlike(RENDER_HINT), _let(text, _finished)).otherwise(body).alias("markdown"),
                    tags["error"].alias("error"), tags["error_at"].alias("error_at"))


def render_markdown(body) -> Column:
    """Markdown of a markup column; a NULL body stays NULL, and a malformed one has none."""
    r = render(body if isinstance(body, Column) else F.col(body))
    return F.when(r["error"].isNull(), r["markdown"])


def render_corpus(pages: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """``(id, markdown, error, error_at)`` per page; a malformed page has an error with its offset in the text (line ends as one
    character) and no markdown, and stops nothing."""
    rows = pages.select(F.col(id_col).alias("id"), render(F.col(body_col)).alias("r"))
    return rows.select("id", F.when(F.col("r.error").isNull(), F.col("r.markdown")).alias("markdown"), "r.error", "r.error_at")
