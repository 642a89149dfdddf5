"""String helpers used by the tagging and search jobs; all native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's behaviour ------------------------------------
# Tags that keep their underscores when underscores are replaced by spaces (emoticons).
KAOMOJI = [
    "0_0", "(o)_(o)", "+_+", "+_-", "._.", "<o>_<o>", "<|>_<|>", "=_=", ">_<", "3_3", "6_9", ">_o",
    "@_@", "^_^", "o_o", "u_u", "x_x", "|_|", "||_||",
]
# Title namespaces that are not wiki content.
SKIPPED_NAMESPACES = ("api:", "howto:", "template:", "help:")
# Marker tag that separates kept tags from the rest of a caption.
BREAK = "BREAK"
# Token pattern of the search columns and of query terms.
TOKEN_SEPARATOR = "[^a-z0-9]+"
# Size units, 1024 steps.
BYTE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]
# ------------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_text(c) -> Column:
    """Search column: lower-case, every run of non ``[a-z0-9]`` becomes one space (leading and
    trailing runs included), i.e. the tokens joined by single spaces."""
    return F.regexp_replace(F.lower(_c(c)), TOKEN_SEPARATOR, " ")


def replace_underscores(c) -> Column:
    """``_`` -> space, except for emoticon tags."""
    c = _c(c)
    return F.when(c.isin(KAOMOJI), c).otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def escape_brackets(c) -> Column:
    """``(`` -> ``\\(`` and ``)`` -> ``\\)``."""
    return F.regexp_replace(_c(c), r"([()])", r"\\$1")


def strip_rating_prefix(c) -> Column:
    return F.regexp_replace(_c(c), "^rating_", "")


def split_tags(c) -> Column:
    """Comma-separated caption -> array of stripped, non-empty tags (order and duplicates kept)."""
    return F.filter(F.transform(F.split(_c(c), ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)


def query_terms(c, lower: bool = True) -> Column:
    """Search terms of a free-text query: ``[a-z0-9]+`` runs. ``lower=False`` keeps the original
    behaviour where upper-case letters act as separators."""
    c = _c(c)
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit("([a-z0-9]+)"), 1)


def word_key(c) -> Column:
    """Whitespace-normalised form of a tag: its words joined by one space ('' for blank)."""
    return F.regexp_replace(F.trim(_c(c)), r"\s+", " ")


def human_bytes(c) -> Column:
    """1024-step size with two decimals: ``1.50 KiB``. Values beyond the last unit stay in TiB."""
    c = _c(c).cast("double")
    expr = None
    for i, unit in enumerate(BYTE_UNITS):
        scaled = c / float(1024 ** i)
        txt = F.concat(F.format_string("%.2f", scaled), F.lit(" " + unit))
        cond = (c < float(1024 ** (i + 1))) if i < len(BYTE_UNITS) - 1 else None
        if expr is None:
            expr = F.when(cond, txt)
        elif cond is not None:
            expr = expr.when(cond, txt)
        else:
            expr = expr.otherwise(txt)
    return expr


def natural_sort_key(c) -> Column:
    """Sort key comparing digit runs of any length as numbers and text case-insensitively: a run becomes its number of
    significant digits (ten places) followed by these digits."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(x))
    return F.transform(parts, key)


def selection_title(c) -> Column:
    """Title out of a ``"title (count)"`` selection label."""
    return F.regexp_extract(_c(c), r"^(.+?) \(.+\)", 1)


def selection_label(title, count) -> Column:
    return F.format_string("%s (%d)", _c(title), _c(count))
