"""Registered queries of the dataset-tagging workload (W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.text import BREAK, split_tags, strip_rating_prefix
from tagloom.operators import tags as T
from tagloom.operators import bitmaps as B
from tagloom.operators.stats import filter_by_tags, tag_facets, decode_scores, decode_caption_scores
from tagloom.operators.tags import TagSettings, csv_list
from tagloom.plans import dataset as D
from tagloom.plans.oracle import kept_ctes, rus, sql_list, with_
from tagloom.plans.registry import register, r6
from tagloom.session import materialize_once
from tagloom.sources import fixtures as X
from tagloom.sources.tables import table

DEFAULT = TagSettings()
# Fixed query parameters of the registered rule queries (tags of the fixture vocabulary).
KEEP = "widget, bolt"
PREFIX = "photo, scan"
BAN = "gear, red widget"
SELECTED = ["widget"]


def map_rules_ctes(rules_text: str, max_passes: int = 20) -> str:
    """SQL twin of the mapping-rule rewrite: a recursive CTE applying one rule per step to each
    file's list, a pass ending after the last rule, stopping after a pass without a real change.
    Reads ``l1(file_id, tag, s, p)``, defines ``lm`` with the same columns."""
    rules = T.parse_mapping_rules(rules_text)
    n = len(rules)

    def arr(xs):
        return f"CAST([{sql_list(xs)}] AS VARCHAR[])" if xs else "CAST([] AS VARCHAR[])"
    lit = ", ".join(f"struct_pack(pos := {arr(r.positives)}, neg := {arr(r.negatives)}, tgt := {arr(r.targets)})"
                    for r in rules)
    return f""",
rules AS (SELECT [{lit}] AS rs),
init AS (SELECT file_id, list(struct_pack(tag := tag, score := s) ORDER BY p) AS tags FROM l1 GROUP BY file_id),
rm(file_id, step, tags, changed, done) AS (
  SELECT file_id, 0, tags, false, false FROM init
  UNION ALL
  SELECT file_id, step + 1,
         CASE WHEN fires THEN list_concat(list_filter(tags, lambda x: NOT list_contains(r.pos, x.tag)),
                                          list_transform(r.tgt, lambda t: struct_pack(tag := t, score := top)))
              ELSE tags END,
         ch, (step % {n} = {n - 1}) AND NOT ch
  FROM (SELECT *, (CASE WHEN step % {n} = 0 THEN false ELSE changed END)
                  OR (fires AND NOT list_has_all(r.tgt, r.pos)) AS ch
        FROM (SELECT *, list_has_all(list_transform(tags, lambda x: x.tag), r.pos)
                        AND NOT list_has_any(list_transform(tags, lambda x: x.tag), r.neg) AS fires,
                     list_max(list_transform(r.pos, lambda t: (list_filter(tags, lambda x: x.tag = t))[1].score)) AS top
              FROM (SELECT rm.*, (SELECT rs FROM rules)[(rm.step % {n}) + 1] AS r
                    FROM rm WHERE NOT rm.done AND rm.step < {max_passes * n}) a) b) c),
fin AS (SELECT file_id, arg_max(tags, step) AS tags FROM rm GROUP BY file_id),
lm0 AS (SELECT file_id, generate_subscripts(tags, 1) AS p, unnest(tags) AS e FROM fin),
lm AS (SELECT file_id, e.tag AS tag, e.score AS s, p FROM lm0)"""


def caption_ctes(keep: str | None = None, prefix: str | None = None, ban: str | None = None,
                 escape: bool = False, map_rules: str | None = None) -> str:
    """SQL twin of the caption path (long form): ranked list -> map -> keep -> prefix -> ban -> sort."""
    s = kept_ctes() + """,
allf AS (SELECT DISTINCT file_id FROM pred),
cl AS (SELECT file_id, tag, CASE WHEN category = 'character' THEN score ELSE score - 1.0 END AS s,
              CASE WHEN category = 'character' THEN 0 ELSE 1 END AS cat, ord FROM kept),
l1 AS (SELECT file_id, tag, s, row_number() OVER (PARTITION BY file_id ORDER BY s DESC, cat, ord) AS p FROM cl)"""
    cur = "l1"
    if map_rules:
        s += map_rules_ctes(map_rules)
        cur = "lm"
    k = csv_list(keep)
    if k:
        s += f""",
mk AS (SELECT f.file_id, greatest(0, coalesce(max(l.s), 0)) AS m, coalesce(max(l.p), 0) AS n
       FROM allf f LEFT JOIN {cur} l ON l.file_id = f.file_id GROUP BY f.file_id),
lk AS (SELECT file_id, tag,
              CASE WHEN list_position([{sql_list(k)}], tag) > 0
                   THEN 5.0 + (1.0 - (list_position([{sql_list(k)}], tag) - 1) / {float(len(k))}) ELSE s END AS s, p
       FROM {cur}
       UNION ALL SELECT file_id, '{BREAK}', m + 1.0, n + 1 FROM mk)"""
        cur = "lk"
    pr = csv_list(prefix)
    if pr:
        vals = ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(reversed(pr)))
        s += f""",
mp AS (SELECT f.file_id, greatest(0, coalesce(max(l.s), 0)) AS m
       FROM allf f LEFT JOIN {cur} l ON l.file_id = f.file_id GROUP BY f.file_id),
lp AS (SELECT file_id, tag, s, p FROM {cur}
       UNION ALL SELECT mp.file_id, v.tag, mp.m + v.i, v.i - 1000000 FROM mp, (VALUES {vals}) v(tag, i))"""
        cur = "lp"
    b = csv_list(ban, drop_empty=False)
    if b:
        s += f""",
lb AS (SELECT * FROM {cur} WHERE tag NOT IN ({sql_list(b)}))"""
        cur = "lb"
    joined = "string_agg(l.tag, ', ' ORDER BY l.s DESC, l.p)"
    if escape:
        joined = f"replace(replace({joined}, '(', '\\('), ')', '\\)')"
    s += f""",
cap AS (SELECT f.file_id, coalesce({joined}, '') AS caption
        FROM allf f LEFT JOIN {cur} l ON l.file_id = f.file_id GROUP BY f.file_id)"""
    return s


def _pred(spark, d):
    """The prediction table. The tagging job reads it several times (kept tags, both sides of the
    trim join, vocabulary, file count, ratings), so it is written once to the shared checkpoint
    folder, as the scoring job would store it, and scanned from there (once per application and
    input version)."""
    return materialize_once(spark, "pred", [f"{d}/lineitem.parquet", f"{d}/part.parquet"],
                            lambda: X.pred(spark, d))


# ---- flagship -------------------------------------------------------------------------------

STATS_SQL = with_("pred", extra=kept_ctes() + """,
vocab AS (SELECT DISTINCT file_id, category, tag FROM p WHERE category <> 'rating'),
res AS (SELECT DISTINCT v.file_id, v.category, v.tag FROM kept k JOIN vocab v ON k.file_id = v.file_id AND k.tag = v.tag),
n AS (SELECT count(DISTINCT file_id) AS n FROM pred)""") + """
SELECT category, tag, round(count(*) / (SELECT n FROM n), 6) AS value FROM res GROUP BY category, tag
UNION ALL
SELECT 'rating' AS category, regexp_replace(tag, '^rating_', '') AS tag, round(sum(score) / (SELECT n FROM n), 6) AS value
FROM pred WHERE category = 'rating' GROUP BY regexp_replace(tag, '^rating_', '')"""


@register("tag_dataset", STATS_SQL)
def q_tag_dataset(spark, d):
    _, stats = D.tag_dataset(_pred(spark, d), DEFAULT)
    return stats.select("category", "tag", r6("value").alias("value"))


@register("assemble_caption", with_("pred", extra=caption_ctes()) + "SELECT file_id, caption FROM cap")
def q_assemble_caption(spark, d):
    return D.captions(_pred(spark, d), DEFAULT)


@register("fn_escape_brackets", with_("pred", extra=caption_ctes(escape=True)) + "SELECT file_id, caption FROM cap")
def q_escape(spark, d):
    """Caption with bracket escaping on (part names carry no brackets: the wiki titles do, see
    ``fn_escape_title``)."""
    return D.captions(_pred(spark, d), TagSettings(escape_brackets=True))


@register("keep_tags", with_("pred", extra=caption_ctes(keep=KEEP)) + "SELECT file_id, caption FROM cap")
def q_keep(spark, d):
    return D.captions(_pred(spark, d), TagSettings(keep_tags=KEEP))


@register("prefix_tags", with_("pred", extra=caption_ctes(prefix=PREFIX)) + "SELECT file_id, caption FROM cap")
def q_prefix(spark, d):
    return D.captions(_pred(spark, d), TagSettings(prefix_tags=PREFIX))


@register("ban_tags", with_("pred", extra=caption_ctes(ban=BAN)) + "SELECT file_id, caption FROM cap")
def q_ban(spark, d):
    return D.captions(_pred(spark, d), TagSettings(ban_tags=BAN))


@register("caption_rules", with_("pred", extra=caption_ctes(keep=KEEP, prefix=PREFIX, ban=BAN))
          + "SELECT file_id, caption FROM cap")
def q_caption_rules(spark, d):
    return D.captions(_pred(spark, d), TagSettings(keep_tags=KEEP, prefix_tags=PREFIX, ban_tags=BAN))


MAP_RULES = """# fixture vocabulary rules
widget & -red widget : gadget
small ring, small bolt : small part
"hot & cold" & gear : thermal
gadget & bolt : kit, gadget
"""


@register("apply_mapping_rules",
          with_("pred", extra=caption_ctes(keep=KEEP, ban=BAN, map_rules=MAP_RULES)).replace("WITH ", "WITH RECURSIVE ", 1)
          + "SELECT file_id, caption FROM cap")
def q_mapping(spark, d):
    """Iterative rewrite (passes until no change) as native higher-order functions; the SQL twin is
    a recursive CTE applying one rule per step (also checked against a plain-Python restatement)."""
    return D.captions(_pred(spark, d), TagSettings(map_tags=MAP_RULES, keep_tags=KEEP, ban_tags=BAN))


_RUS_SQL = with_("pred") + f"""
SELECT DISTINCT tag AS raw, {rus('tag')} AS tag FROM pred"""


@register("fn_replace_underscores", _RUS_SQL)
@register("replace_underscores", _RUS_SQL)
def q_replace_us(spark, d):
    p = _pred(spark, d).select(F.col("tag").alias("raw")).distinct()
    from tagloom.functions.text import replace_underscores
    return p.select("raw", replace_underscores(F.col("raw")).alias("tag"))


@register("threshold_scores", with_("pred", extra=kept_ctes()) + """
SELECT file_id, category, tag, score FROM th""")
def q_threshold(spark, d):
    p = T.prepare_predictions(_pred(spark, d))
    return T.threshold_scores(p.where(F.col("category") != "rating")).select("file_id", "category", "tag", "score")


MCUT_SQL = with_("pred") + """,
w AS (SELECT file_id, category, score,
             row_number() OVER (PARTITION BY file_id, category ORDER BY score DESC, tag) AS p,
             lead(score) OVER (PARTITION BY file_id, category ORDER BY score DESC, tag) AS nxt
      FROM pred WHERE category <> 'rating'),
r AS (SELECT file_id, category, (score + nxt) / 2 AS cut,
             row_number() OVER (PARTITION BY file_id, category ORDER BY score - nxt DESC, p) AS k
      FROM w WHERE nxt IS NOT NULL)
SELECT file_id, category, round(cut, 6) AS cut FROM r WHERE k = 1"""


@register("mcut_threshold", MCUT_SQL)
def q_mcut(spark, d):
    c = T.mcut_threshold(_pred(spark, d).where(F.col("category") != "rating"))
    return c.select("file_id", "category", r6("cut").alias("cut"))


@register("mcut_scores", with_("pred", extra="""
w AS (SELECT file_id, category, tag, score,
             row_number() OVER (PARTITION BY file_id, category ORDER BY score DESC, tag) AS p,
             lead(score) OVER (PARTITION BY file_id, category ORDER BY score DESC, tag) AS nxt
      FROM pred WHERE category <> 'rating'),
r AS (SELECT file_id, category, (score + nxt) / 2 AS cut,
             row_number() OVER (PARTITION BY file_id, category ORDER BY score - nxt DESC, p) AS k
      FROM w WHERE nxt IS NOT NULL),
c AS (SELECT file_id, category, cut FROM r WHERE k = 1)""") + """
SELECT w.file_id, w.category, w.tag, w.score FROM w LEFT JOIN c ON c.file_id = w.file_id AND c.category = w.category
WHERE w.score >= greatest(CASE WHEN w.category = 'general' THEN 0.35 ELSE 0.9 END, c.cut)""")
def q_mcut_scores(spark, d):
    """Thresholds raised per file by Maximum-Cut on both categories."""
    p = _pred(spark, d).where(F.col("category") != "rating")
    return T.threshold_scores(p, general_mcut=True, character_mcut=True).select("file_id", "category", "tag", "score")


@register("trim_contained_tags", with_("pred", extra=kept_ctes()) + """
SELECT file_id, tag, score FROM gt""")
def q_trim(spark, d):
    p = T.prepare_predictions(_pred(spark, d))
    g = T.threshold_scores(p.where(F.col("category") == "general"))
    return T.trim_contained_tags(g).select("file_id", "tag", "score")


@register("union_categories", with_("pred", extra=kept_ctes()) + """
SELECT file_id, tag, CASE WHEN category = 'character' THEN score ELSE score - 1.0 END AS s,
       CASE WHEN category = 'character' THEN 0 ELSE 1 END AS cat FROM kept""")
def q_union(spark, d):
    k = D.kept_tags(_pred(spark, d), DEFAULT)
    u = T.union_categories(k.where(F.col("category") == "character"), k.where(F.col("category") == "general"))
    return u.select("file_id", "tag", "s", "cat")


RESULT_SQL = with_("pred", extra=kept_ctes() + """,
vocab AS (SELECT DISTINCT file_id, category, tag FROM p WHERE category <> 'rating')""") + f"""
SELECT v.file_id, v.category, v.tag, min(k.score) AS score
FROM kept k JOIN vocab v ON k.file_id = v.file_id AND k.tag = v.tag
WHERE k.tag NOT IN ({sql_list(csv_list(BAN, drop_empty=False))})
GROUP BY v.file_id, v.category, v.tag"""


@register("result_scores", RESULT_SQL)
def q_result(spark, d):
    return D.result_scores(_pred(spark, d), TagSettings(ban_tags=BAN))


@register("retain_vocabulary", with_("pred", extra=kept_ctes() + """,
vocab AS (SELECT DISTINCT file_id, category, tag FROM p WHERE category <> 'rating')""") + """
SELECT DISTINCT v.file_id, v.category, v.tag FROM kept k JOIN vocab v ON k.file_id = v.file_id AND k.tag = v.tag""")
def q_retain(spark, d):
    return D.result_scores(_pred(spark, d), DEFAULT).select("file_id", "category", "tag")


@register("tag_document_frequency", STATS_SQL.split("UNION ALL\nSELECT 'rating'")[0])
def q_freq(spark, d):
    p = _pred(spark, d)
    f = D.tag_document_frequency(D.result_scores(p, DEFAULT), D.n_files(p))
    return f.select("category", "tag", r6("value").alias("value"))


@register("rating_mean", with_("pred") + """
SELECT 'rating' AS category, regexp_replace(tag, '^rating_', '') AS tag,
       round(sum(score) / (SELECT count(DISTINCT file_id) FROM pred), 6) AS value
FROM pred WHERE category = 'rating' GROUP BY regexp_replace(tag, '^rating_', '')""")
def q_rating(spark, d):
    p = _pred(spark, d)
    return D.rating_mean(p, D.n_files(p)).select("category", "tag", r6("value").alias("value"))


@register("fn_strip_rating_prefix", with_("pred") + """
SELECT DISTINCT tag AS raw, regexp_replace(tag, '^rating_', '') AS tag FROM pred WHERE category = 'rating'""")
def q_strip(spark, d):
    p = _pred(spark, d).where(F.col("category") == "rating").select(F.col("tag").alias("raw")).distinct()
    return p.select("raw", strip_rating_prefix(F.col("raw")).alias("tag"))


@register("tag_facets", with_("pred", extra=caption_ctes()) + """
SELECT trim(t.tag) AS tag, count(*) AS n FROM cap, unnest(string_split(cap.caption, ',')) t(tag)
GROUP BY trim(t.tag)""")
def q_facets(spark, d):
    return tag_facets(D.captions(_pred(spark, d), DEFAULT))


@register("filter_by_tags", with_("pred", extra=caption_ctes()) + f"""
SELECT file_id, caption FROM cap
WHERE list_has_all(list_transform(string_split(caption, ','), lambda x: trim(x)), [{sql_list(SELECTED)}])""")
def q_filter_by_tags(spark, d):
    return filter_by_tags(D.captions(_pred(spark, d), DEFAULT), SELECTED)


# Selections of tags: every product name alone, the first two names of every size together, one tag that no file has, none.
_SELECTIONS = """,
words AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, p_name AS b FROM part),
sel AS (SELECT b AS selection, [b] AS tags FROM words UNION ALL SELECT a, (list(b ORDER BY b))[1:2] FROM words GROUP BY a
        UNION ALL SELECT 'absent', ['no such tag'] UNION ALL SELECT '', []::VARCHAR[]),
ct AS (SELECT file_id, list_distinct(list_transform(string_split(caption, ','), lambda x: trim(x))) AS tags FROM cap),
hits AS (SELECT selection, ct.file_id, ct.tags FROM sel, ct WHERE list_has_all(ct.tags, sel.tags))"""


def _bitmaps(spark, d):
    inputs = [f"{d}/{t}.parquet" for t in ("lineitem", "part")]
    return materialize_once(spark, "tag-bitmaps", inputs, lambda: B.tag_bitmaps(D.captions(_pred(spark, d), DEFAULT)), sort_by=["tag", "bucket"])


def _selections(spark, d):
    p = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.col("p_name").alias("b")).distinct()
    pairs = p.groupBy(F.col("a").alias("selection")).agg(F.slice(F.array_sort(F.collect_set("b")), 1, 2).alias("tags"))
    return (p.select(F.col("b").alias("selection"), F.array("b").alias("tags")).unionByName(pairs)
            .unionByName(spark.createDataFrame([("absent", ["no such tag"]), ("", [])], "selection string, tags array<string>")))


@register("filter_by_selections", with_("pred", extra=caption_ctes() + _SELECTIONS) + "SELECT selection, file_id FROM hits")
def q_filter_by_selections(spark, d):
    """The files of many tag selections at once, from bitmaps."""
    return B.selected_files(B.selected_bitmaps(_bitmaps(spark, d), _selections(spark, d)))


@register("selection_counts", with_("pred", extra=caption_ctes() + _SELECTIONS) + """
SELECT selection, count(file_id) AS n_files FROM sel LEFT JOIN hits USING (selection) GROUP BY selection""")
def q_selection_counts(spark, d):
    """How many files each selection has (none: 0), as bit counts."""
    s = _selections(spark, d)
    return B.selection_counts(B.selected_bitmaps(_bitmaps(spark, d), s), s)


@register("selection_facets", with_("pred", extra=caption_ctes() + _SELECTIONS) + """
SELECT selection, t.tag, count(*) AS n_files FROM hits, unnest(hits.tags) t(tag) GROUP BY selection, t.tag""")
def q_selection_facets(spark, d):
    """The tags of each selection's files with their number of files, from bitmaps."""
    b = _bitmaps(spark, d)
    return B.selection_facets(b, B.selected_bitmaps(b, _selections(spark, d)))


@register("drop_blank_tags", with_("captions") + """
SELECT file_id, list_filter(list_transform(string_split(caption, ','), lambda x: trim(x)), lambda x: length(x) > 0) AS tags
FROM captions""")
def q_drop_blank(spark, d):
    return X.captions(spark, d).select("file_id", split_tags(F.col("caption")).alias("tags"))


@register("decode_scores", with_("label_vocab", "score_long") + """
SELECT s.vec_id, CASE v.category WHEN 9 THEN 'rating' WHEN 0 THEN 'general' WHEN 4 THEN 'character' END AS category,
       v.name AS tag, s.score
FROM score_long s JOIN label_vocab v ON v.idx = s.idx WHERE v.category IN (9, 0, 4)""")
def q_decode(spark, d):
    return decode_scores(X.score_vectors(spark, d), X.label_vocab(spark, d))


@register("decode_caption_scores", with_("captions") + """
SELECT DISTINCT file_id, 'general' AS category, trim(t.tag) AS tag, CAST(1.0 AS DOUBLE) AS score
FROM captions, unnest(string_split(caption, ',')) t(tag)""")
def q_decode_caption(spark, d):
    return decode_caption_scores(X.captions(spark, d))
