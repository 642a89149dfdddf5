"""Wiki markup (DText) as native Spark column expressions.

The page corpus is processed with chains of ``regexp_replace`` / ``regexp_extract_all`` so the work
stays in the JVM and scales with the page table; there is no per-row parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the markup grammar ------------------------------------------------------------
# Block/inline tags without attributes, and tags that may carry attributes.
SIMPLE_TAGS = ["b", "i", "u", "s", "tn", "spoilers", "nodtext", "code", "quote", "table", "colgroup"]
ATTR_TAGS = ["thead", "tbody", "tr", "col", "th", "td", "expand", "url"]
WIKI_URL = "https://danbooru.donmai.us/wiki_pages/"
SEARCH_URL = "https://danbooru.donmai.us/posts?tags="
USER_URL = "https://danbooru.donmai.us/users?name="
HEADING = r'h([0-9])(#[^."\n]+)?\.([^\n]+)'
# Link forms in the order in which they are tried at one place: kind, pattern, target group, label group.
LINKS = [
    ("html", r'<a href="([^"\n]+?)">([^\n]+?)</a>', 1, 2),
    ("tag_url", r"\[url=([^\]\n]+)\]([^\[]*+)\[/url\]", 1, 2),
    ("tag_url", r"\[url\]([^\[]*+)\[/url\]", 1, 1),
    ("text_url", r'"([^"]+?)":\[([^\]\n]+?)\]', 2, 1),
    ("text_url", r'"([^"]+?)":((?:https?|/|#)[^\s]*)', 2, 1),
    ("wiki", r"(?<![a-zA-Z0-9])([a-zA-Z0-9]*+)\[\[([^\]\n]+?)\]\]([a-zA-Z0-9]*)", 2, 2),
    ("search", r"\{\{([^}\n]+?)\}\}", 1, 1),
    ("md_url", r"\[(https?[^\]\n]*?)\]\(([^)\n]+?)\)", 1, 2),
    ("md_text", r"\[(?!http)([^\]\n]+?)\]\(([^)\n]+?)\)", 2, 1),
    ("angle_url", r"<(https?[^>\n]+?)>", 1, 1),
    ("bare_url", r"(https?://[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,4}\b[-a-zA-Z0-9@:%_+.~#?&/=]*)", 1, 1),
    ("user", r"@([a-zA-Z0-9_-]+)", 1, 1),
]
LINK_BEGINS = {"html": "<a ", "tag_url": "[url", "text_url": '"', "search": "{{", "md_url": "[http", "md_text": "[", "angle_url": "<http",
               "bare_url": "http", "user": "@"}
PROTECTED = r"\[nodtext\][\s\S]*?\[/nodtext\]|\[code\][\s\S]*?\[/code\]"
# ------------------------------------------------------------------------------------------------

_simple = "|".join(SIMPLE_TAGS)
_attr = "|".join(ATTR_TAGS)

# Plain text of a page: markup removed, every link replaced by its visible text. Applied in order.
PLAIN_TEXT_RULES: list[tuple[str, str]] = [
    (r"\r\n", "\n"),
    (rf"\[/?({_simple})\]", ""),                                  # simple tags
    (rf"\[({_attr})([ =][^\]]*)?\]", ""),                          # opening tags with attributes
    (rf"\[/({_attr})\]", ""),                                      # their closing tags
    (r"\[(br|hr)\]", " "),                                         # breaks
    (HEADING.replace(r"\.(", r"\.[ \t]*("), "$3"),                  # headings keep their text
    (r"(?m)^\*+[ \t]?", ""),                                       # list markers
    (r'"([^"]+?)":\[([^\]\n]+?)\]', "$1"),                           # "text":[url]
    (r'"([^"]+?)":((https?|/|#)[^\s]*)', "$1"),                    # "text":url
    (r"\[(https?[^\]\n]*?)\]\(([^)\n]+?)\)", "$2"),                    # [url](text)
    (r"\[([^\]\n]+?)\]\(([^)\n]+?)\)", "$1"),                          # [text](url)
    (r"<(https?[^>\n]+?)>", "$1"),                                   # <url>
    (r"\[\[([^\]|\n]+)\|([^\]#\n]+)#[A-Z][^\]\n]*\]\]", "$2"),             # [[target|label#Anchor]]
    (r"\[\[([^\]|\n]+)\|([^\]\n]+)\]\]", "$2"),                        # [[target|label]]
    (r"\[\[([^\]|(\n]*?)[ \t]*\([^\]\n]*\)[ \t]*\|\]\]", "$1"),              # [[target (qualifier)|]]
    (r"\[\[([^\]|#\n]+)(#[^\]\n]*)?\|?\]\]", "$1"),                    # [[target]], [[target#Anchor]]
    (r"\{\{([^}|\n]+)\|([^}\n]+)\}\}", "$2"),                          # {{search|label}}
    (r"\{\{([^}|(\n]*?)[ \t]*\([^}\n]*\)[ \t]*\|\}\}", "$1"),                # {{search (qualifier)|}}
    (r"\{\{([^}|\n]+)\|?\}\}", "$1"),                                # {{search}}
]


# Every plain-text rule needs one of these in the text (a heading needs "h<digit>"): texts without any
# of them are returned unchanged, so the rule chain runs only on texts that carry markup.
MARKUP_HINT = r'[\[<{"*\r]|h[0-9]'


def plain_text(c) -> Column:
    """Searchable text of a markup column (NULL stays NULL)."""
    src = F.col(c) if isinstance(c, str) else c
    col = src
    for pat, rep in PLAIN_TEXT_RULES:
        col = F.regexp_replace(col, pat, rep)
    return F.when(src.rlike(MARKUP_HINT), col).otherwise(src)


def unprotected(c: Column) -> Column:
    """The text without its ``[nodtext]`` and ``[code]`` blocks, in which nothing is markup."""
    return F.regexp_replace(c, PROTECTED, "\n")


def extract_headings(pages: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """``(page_id, pos, level, anchor, text)`` for every ``hN. text`` / ``hN#anchor. text``."""
    m = pages.select(F.col(id_col).alias("page_id"),
                     F.posexplode(F.regexp_extract_all(unprotected(F.col(body_col)), F.lit(HEADING), 0)).alias("pos", "h"))
    return m.select("page_id", "pos",
                    F.regexp_extract("h", HEADING, 1).cast("int").alias("level"),
                    F.nullif(F.regexp_replace(F.regexp_extract("h", HEADING, 2), "^#", ""), F.lit("")).alias("anchor"),
                    F.trim(F.regexp_extract("h", HEADING, 3)).alias("text"))


# ---- links: one tokeniser for rendering and extraction -------------------------------------------

#: Every link form in one alternation: the leftmost form wins, so a link is met once and none is met inside another.
ANY_LINK = "|".join(f"(?:{p})" for _, p, _, _ in LINKS)


def _page_target(t: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(t)), " ", "_")


def _piped(inner: Column) -> tuple[Column, Column]:
    """Target and, behind the first ``|``, the label (null without one)."""
    at = F.instr(inner, "|")
    return F.split_part(inner, F.lit("|"), F.lit(1)), F.when(at > 0, F.substring(inner, at + 1, F.length(inner)))


def _section(part: Column) -> Column:
    """The section that a part names: what follows ``#`` if it begins with a capital; else null."""
    at = F.instr(part, "#")
    after = F.substring(part, at + 1, F.length(part))
    return F.when((at > 0) & after.rlike("^[A-Z]"), after)


def _before_section(part: Column, section: Column) -> Column:
    return F.when(section.isNotNull(), F.split_part(part, F.lit("#"), F.lit(1))).otherwise(part)


def _link_fields(kind: str, pat: str, url_group: int, label_group: int, m: Column) -> tuple[Column, Column]:
    """``(url, label)`` of one matched link ``m`` of a kind.

    Wiki links point at ``lower(target)`` with spaces as ``_``, plus ``#dtext-section``; the section stands behind the
    target or behind the label. An empty label is the target without its ``(qualifier)``; adjoining word characters
    join the label. Search links keep the target as typed (lower-cased)."""
    g = lambda i: F.regexp_extract(m, pat, i)
    if kind == "user":
        return F.concat(F.lit(USER_URL), g(1)), F.concat(F.lit("@"), g(1))
    if kind not in ("wiki", "search"):
        return g(url_group), g(label_group)
    target, label = _piped(g(url_group))
    short = lambda t: F.trim(F.regexp_replace(t, r"\(.+\)", ""))
    if kind == "search":
        shown = F.when(label.isNull(), F.trim(target)).when(label == "", short(target)).otherwise(F.trim(label))
        return F.concat(F.lit(SEARCH_URL), F.lower(F.when(label.isNull() | (label == ""), target).otherwise(F.trim(target)))), shown
    first = _section(target)
    second = F.when(first.isNull(), _section(label))
    target, label = _before_section(target, first), _before_section(label, second)
    shown = F.when(label.isNull(), F.trim(target)).when(label == "", short(target)).otherwise(F.trim(label))
    anchor = F.coalesce(F.concat(F.lit("#dtext-"), F.lower(F.coalesce(first, second))), F.lit(""))
    return F.concat(F.lit(WIKI_URL), _page_target(target), anchor), F.concat(g(1), shown, g(3))


def link_of(m: Column) -> Column:
    """``struct<kind, url, label>`` of a match of ``ANY_LINK``: the first form that the whole match has. Forms that begin otherwise
    are passed over without their patterns."""
    out = None
    for kind, pat, url_group, label_group in LINKS:
        url, label = _link_fields(kind, pat, url_group, label_group, m)
        entry = F.struct(F.lit(kind).alias("kind"), url.alias("url"), label.alias("label"))
        is_it = m.rlike(f"^(?:{pat})$")
        begins = LINK_BEGINS.get(kind)
        is_it = m.startswith(begins) & is_it if begins else m.contains("[[") & is_it if kind == "wiki" else is_it
        out = F.when(is_it, entry) if out is None else out.when(is_it, entry)
    return out


def replace_each(c: Column, pattern: str, fn) -> Column:
    """``c`` with every match of ``pattern`` replaced by ``fn(match)``; ``c`` is evaluated once."""
    def rebuild(text: Column) -> Column:
        between = F.split(text, pattern, -1)
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.array_join(F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(fn(m), F.lit("")))), "")
    return F.element_at(F.transform(F.array(c), rebuild), 1)


def extract_wiki_links(pages: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """Link edge table ``(page_id, kind, pos, url, label)``; ``pos`` numbers the links of a page. Each link is met once;
    ``[nodtext]`` and ``[code]`` blocks have none."""
    found = F.transform(F.regexp_extract_all(unprotected(F.col(body_col)), F.lit(ANY_LINK), 0), link_of)
    return (pages.select(F.col(id_col).alias("page_id"), F.posexplode(found).alias("pos", "e"))
            .select("page_id", "e.kind", "pos", "e.url", "e.label"))
