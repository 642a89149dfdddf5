"""Registered queries of the wiki build and search workloads (W1, W2)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tagloom.functions.jaro import jaro_winkler_udf
from tagloom.functions.search import register_search
from tagloom.functions.stem import stem_terms
from tagloom.functions.text import SKIPPED_NAMESPACES, normalise_text, query_terms
from tagloom.operators.markup import extract_headings, extract_wiki_links, plain_text
from tagloom.operators.render import render_corpus
from tagloom.plans import fuzzy as Z
from tagloom.plans import topk as T
from tagloom.plans import wiki as W
from tagloom.plans.oracle import FIX, sql_list, with_
from tagloom.plans.registry import register, r6
from tagloom.sources import fixtures as X
from tagloom.sources import readers as R
from tagloom.session import materialize_once
from tagloom.sources.tables import table

# Fixed query parameters.
SEARCH = "red widget"
TITLE_TERMS = ["red", "widgit"]
TEXT_SEARCH = "ernt"
BM25_SEARCH = "thnt eron the"       # two words of the texts and a stop word
STOP_SEARCH = "the and of"          # stop words alone
MISS_SEARCH = "red sprocket"        # no title holds both
TEXT_TITLE_TERMS = ["bolt"]
ROUTE = '"small gizmo" thnt'
LOOKUP = "red_widget"
LIMIT = 20
GROUP = "promo"


def _tags(spark, d):
    return R.read_tags(spark, X.tags_file(spark, d)).rows


def _pages(spark, d):
    return R.read_pages(spark, X.pages_file(spark, d)).rows


def _markup(spark, d):
    return spark.read.parquet(X.markup_file(spark, d))


def _wiki(spark, d):
    return W.build_wiki(_pages(spark, d), _tags(spark, d))


def _search_tables(spark, d):
    """Build the page table and its index once per query and persist both in the shared
    checkpoint folder (the index clustered by term), as the build job would; the search then reads
    them several times (hits, statistics) without recomputing the corpus."""
    inputs = [f"{d}/{t}.parquet" for t in ("documents", "part", "lineitem")]
    w = materialize_once(spark, "wiki", inputs,
                         lambda: _wiki(spark, d).select("id", "post_count", "title", W.TITLE, W.TEXT))
    p = materialize_once(spark, "postings", inputs, lambda: W.build_search_index(w), sort_by=["term", "id"])
    return w, p


def _written(spark, d, w, p):
    """What is written once next to the postings: the term dictionary ``(term, df)`` and the corpus statistics."""
    inputs = [f"{d}/{t}.parquet" for t in ("documents", "part", "lineitem")]
    return {"dictionary": materialize_once(spark, "dictionary", inputs, lambda: W.term_dictionary(p), sort_by=["term"]),
            "stats": materialize_once(spark, "corpus_stats", inputs, lambda: W.corpus_stats(w))}


def _blocks(spark, d, w, p):
    """The block-max postings, written with the index."""
    inputs = [f"{d}/{t}.parquet" for t in ("documents", "part", "lineitem")]
    return materialize_once(spark, "blocks", inputs, lambda: T.block_index(w, p, _written(spark, d, w, p)["stats"]))


def _titles(spark, d, w):
    """The title index: pages by title token, and the tokens' signatures."""
    inputs = [f"{d}/{t}.parquet" for t in ("documents", "part", "lineitem")]
    t = materialize_once(spark, "title_postings", inputs, lambda: Z.title_postings(w), sort_by=["token", "id"])
    return {"titles": t, "tokens": materialize_once(spark, "title_tokens", inputs, lambda: Z.title_tokens(t))}


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def plain_text_sql(expr: str) -> str:
    """Plain text of the documents' own texts, which hold no brackets or quotes: line ends, headings and list marks."""
    out = f"replace({expr}, chr(13) || chr(10), chr(10))"
    out = f"regexp_replace({out}, 'h([0-9])(#[^.\"\n]+)?\\.([^\n]+)', '\\3', 'g')"
    return f"regexp_replace({out}, '(?m)^\\*+[ \t]?', '', 'g')"


_NS = " AND ".join(f"NOT starts_with(p.title, '{p}')" for p in SKIPPED_NAMESPACES)
WIKI_CTES = f""",
t AS (SELECT name, max(post_count) AS post_count FROM tags_raw GROUP BY name),
w AS (SELECT p.id, greatest(t.post_count, 1) AS post_count, p.title,
             regexp_replace(lower(p.title), '[^a-z0-9]+', ' ', 'g') AS search_title,
             regexp_replace(lower({plain_text_sql('p.body')}), '[^a-z0-9]+', ' ', 'g') AS search_text
      FROM wiki_raw p LEFT JOIN t ON p.title = t.name WHERE {_NS})"""

INDEX_CTES = WIKI_CTES + """,
tok AS (SELECT id, 'search_title' AS field, unnest(regexp_extract_all(search_title, '[a-z]+')) AS term FROM w
        UNION ALL SELECT id, 'search_text' AS field, unnest(regexp_extract_all(search_text, '[a-z]+')) AS term FROM w),
tf AS (SELECT field, term, id, count(*) AS tf FROM tok WHERE term NOT IN (%STOP%) GROUP BY field, term, id),
dl AS (SELECT id, CAST(sum(tf) AS INTEGER) AS doc_len FROM tf GROUP BY id),
post AS (SELECT tf.field, tf.term, tf.id, tf.tf, dl.doc_len FROM tf JOIN dl ON dl.id = tf.id)""".replace(
    "%STOP%", sql_list(W.STOP_WORDS))


def _w(extra: str = "") -> str:
    return "WITH " + FIX["tags_raw"] + ",\n" + FIX["wiki_raw"] + extra + "\n"


def bm25_sql(terms: list[str], specs: dict[str, tuple[str, float, float, bool]]) -> str:
    q = sorted(set(terms))
    cols = []
    for name, (field, k, b, conj) in specs.items():
        wexpr = (f"idf * tf * {k + 1} / (tf + {k} * (1 - {b} + {b} * doc_len / "
                 f"((SELECT sum(tf) FROM post) / (SELECT count(*) FROM w))))")
        s = f"sum(CASE WHEN field = '{field}' THEN {wexpr} END)"
        if conj:
            s = f"CASE WHEN count(DISTINCT CASE WHEN field = '{field}' THEN term END) = {len(q)} THEN {s} END"
        cols.append(f"{s} AS {name}")
    return f""",
hits AS (SELECT * FROM post WHERE term IN ({sql_list(q) or 'NULL'})),
dfs AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
h AS (SELECT hits.*, log10(((SELECT count(*) FROM w) - dfs.df + 0.5) / (dfs.df + 0.5) + 1) AS idf
      FROM hits JOIN dfs ON dfs.term = hits.term),
s AS (SELECT id, {', '.join(cols)} FROM h GROUP BY id)"""


# ---- scans and build --------------------------------------------------------------------------

@register("scan_tags", _w() + "SELECT name, post_count FROM tags_raw")
def q_scan_tags(spark, d):
    """The popularity table through its reader: counts that are stored as text, rows that don't fit left aside."""
    return _tags(spark, d)


@register("scan_wiki_pages", _w() + "SELECT id, title, body FROM wiki_raw")
def q_scan_pages(spark, d):
    return _pages(spark, d)


@register("scan_tag_groups", with_("tag_groups") + "SELECT DISTINCT tag_group FROM tag_groups")
def q_scan_groups(spark, d):
    return R.tag_groups(R.read_tag_groups(spark, X.tag_groups_file(spark, d)).rows)


@register("tags_in_group", with_("tag_groups") + f"SELECT DISTINCT tag FROM tag_groups WHERE tag_group = '{GROUP}'")
def q_tags_in_group(spark, d):
    return R.tags_in_group(R.read_tag_groups(spark, X.tag_groups_file(spark, d)).rows, GROUP)


@register("scan_rejected_rows", """
SELECT 'tags' AS file, 'post_count is no int' AS reason, '{"name":"' || s_name || '","post_count":"many"}' AS row FROM supplier
UNION ALL SELECT 'tags', 'name is missing', '{"post_count":"' || n_nationkey || '"}' FROM nation
UNION ALL SELECT 'pages', 'id is no int', '{"id":' || (c_custkey + 1099511627776) || ',"title":"' || c_name || '"}' FROM customer
UNION ALL SELECT 'pages', 'id is missing', '{"title":"' || r_name || '"}' FROM region
UNION ALL SELECT DISTINCT 'groups', 'tag_group is missing', '{"tag":"' || p_brand || '"}' FROM part
UNION ALL SELECT 'labels', 'category code is unknown', '{"idx":' || max(len(embedding)) || ',"name":"odd"}' FROM embeddings""")
def q_scan_rejected(spark, d):
    """What the readers of the four input files left aside, with the reason."""
    reads = {"tags": R.read_tags(spark, X.tags_file(spark, d)), "pages": R.read_pages(spark, X.pages_file(spark, d)),
             "groups": R.read_tag_groups(spark, X.tag_groups_file(spark, d)), "labels": R.read_labels(spark, X.labels_file(spark, d, "csv"), "csv")}
    rows = [r.rejected.select(F.lit(name).alias("file"), "reason", "row") for name, r in reads.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


@register("tags_max_count", _w() + "SELECT name, max(post_count) AS post_count FROM tags_raw GROUP BY name")
def q_tags_max(spark, d):
    return W.tags_max_count(_tags(spark, d))


@register("filter_namespaces", _w() + f"SELECT p.id, p.title FROM wiki_raw p WHERE {_NS}")
def q_filter_ns(spark, d):
    return W.filter_namespaces(_pages(spark, d)).select("id", "title")


@register("join_pages_counts", _w(""",
t AS (SELECT name, max(post_count) AS post_count FROM tags_raw GROUP BY name)""") + """
SELECT p.id, p.title, t.post_count FROM wiki_raw p LEFT JOIN t ON p.title = t.name""")
def q_join_counts(spark, d):
    return W.join_pages_counts(_pages(spark, d).select("id", "title"), _tags(spark, d)) \
        .select("id", "title", "post_count")


@register("clamp_post_count", _w(WIKI_CTES) + "SELECT id, post_count FROM w")
def q_clamp(spark, d):
    return _wiki(spark, d).select("id", "post_count")


@register("build_wiki", _w(WIKI_CTES) + "SELECT id, post_count, title, search_title, search_text FROM w")
def q_build_wiki(spark, d):
    """The page table without the rendered markdown (see ``render_corpus``)."""
    return _wiki(spark, d).select("id", "post_count", "title", "search_title", "search_text")


@register("count_pages", _w(WIKI_CTES) + "SELECT count(*) AS n_pages FROM w")
def q_count_pages(spark, d):
    return W.count_pages(_wiki(spark, d))


@register("lookup_title", _w(WIKI_CTES) + f"""
SELECT w.title, p.body AS markdown FROM w JOIN wiki_raw p ON p.id = w.id WHERE w.title = '{LOOKUP}' ORDER BY w.id LIMIT 1""")
def q_lookup(spark, d):
    """Markdown of one exact title (its page is prose without markup, so it renders as itself)."""
    return W.lookup_title(_wiki(spark, d), LOOKUP)


@register("fn_normalise_text", _w() + """
SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS search_title FROM wiki_raw""")
def q_normalise(spark, d):
    return _pages(spark, d).select("id", normalise_text(F.col("title")).alias("search_title"))


# ---- markup: every expected value below is built from the columns that the fixture wrote into the markup ------------

MARKUP_SQL = """WITH m AS (
  SELECT doc_id AS id, doc_id % 13 AS form, coalesce(p_name, 'page ' || doc_id) AS t, coalesce(source, 'none') AS s,
    CAST(doc_id AS VARCHAR) AS n, replace(regexp_replace(translate(coalesce(text, ''), '[]{}<>"*@#|' || chr(13), '            '),
      'h([0-9])', 'h \\1', 'g'), 'http', 'hxxp') AS rest
  FROM documents LEFT JOIN part ON p_partkey = doc_id),
w AS (SELECT *, 'https://danbooru.donmai.us/wiki_pages/' || replace(lower(t), ' ', '_') AS page,
             'https://danbooru.donmai.us/posts?tags=' || lower(t) || ' (' || s || ')' AS search,
             'https://danbooru.donmai.us/users?name=' || s AS person FROM m)
"""


@register("plain_text_corpus", MARKUP_SQL + """
SELECT id, CASE form WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t || 's' WHEN 3 THEN 'see the ' || s || ' page' WHEN 4 THEN t WHEN 5 THEN t
  WHEN 6 THEN t WHEN 7 THEN 'https://example.com/' || n || ' and https://example.org/' || n WHEN 8 THEN t || chr(10) || s || '  ' || t || ' '
  WHEN 9 THEN t || s WHEN 10 THEN t || chr(10) || s WHEN 11 THEN t || ' @' || s ELSE 'ask @' || s || ' about ' END
  || chr(10) || chr(10) || rest AS plain FROM w""")
def q_plain_text(spark, d):
    """Plain text of pages in every markup form."""
    return _markup(spark, d).select("id", plain_text(F.col("body")).alias("plain"))


@register("extract_headings", MARKUP_SQL + """
SELECT id AS page_id, 0 AS pos, CASE form WHEN 0 THEN 4 ELSE 2 END AS level, CASE form WHEN 1 THEN 'sec-' || n END AS anchor, t AS text
FROM w WHERE form IN (0, 1)""")
def q_headings(spark, d):
    """Heading table over pages in every markup form."""
    return extract_headings(_markup(spark, d))


@register("extract_wiki_links", MARKUP_SQL + """
SELECT id AS page_id, 'wiki' AS kind, 0 AS pos, page AS url, t || 's' AS label FROM w WHERE form = 2
UNION ALL SELECT id, 'wiki', 0, page || '#dtext-history', 'the ' || s || ' page' FROM w WHERE form = 3
UNION ALL SELECT id, 'search', 0, search, t FROM w WHERE form = 4
UNION ALL SELECT id, 'text_url', 0, '/posts/' || n, t FROM w WHERE form = 5
UNION ALL SELECT id, 'md_url', 0, 'https://example.com/' || n, t FROM w WHERE form = 6
UNION ALL SELECT id, 'angle_url', 0, 'https://example.com/' || n, 'https://example.com/' || n FROM w WHERE form = 7
UNION ALL SELECT id, 'bare_url', 1, 'https://example.org/' || n, 'https://example.org/' || n FROM w WHERE form = 7
UNION ALL SELECT id, 'user', 0, person, '@' || s FROM w WHERE form = 12""")
def q_links(spark, d):
    """Link edge table over pages in every markup form."""
    return extract_wiki_links(_markup(spark, d))


_MARKDOWN_SQL = """CASE form WHEN 0 THEN '<h4>' || t || '</h4>' WHEN 1 THEN '<h2 id="sec-' || n || '">' || t || '</h2>'
    WHEN 2 THEN '<a href="' || page || '">' || t || 's</a>'
    WHEN 3 THEN 'see <a href="' || page || '#dtext-history">the ' || s || ' page</a>'
    WHEN 4 THEN '<a href="' || search || '">' || t || '</a>' WHEN 5 THEN '<a href="/posts/' || n || '">' || t || '</a>'
    WHEN 6 THEN '<a href="https://example.com/' || n || '">' || t || '</a>'
    WHEN 7 THEN '<a href="https://example.com/' || n || '">https://example.com/' || n || '</a> and <a href="https://example.org/' || n
      || '">https://example.org/' || n || '</a>'
    WHEN 8 THEN '<b>' || t || '</b>' || chr(10) || '<b>' || s || '</b> <s>' || t || '</s>'
    WHEN 9 THEN '<table><tr><td>' || t || '</td><th>' || s || '</th></tr></table>'
    WHEN 10 THEN array_to_string(['<ul>', '<li>' || t || '</li>', '<ul>', '<li>' || s || '</li>', '</ul>', '</ul>'], chr(10))
    WHEN 11 THEN '[u]' || t || '[/u] @' || s END || CASE WHEN form = 10 THEN chr(10) ELSE chr(10) || chr(10) END || rest"""


@register("render_corpus", MARKUP_SQL + "SELECT id, " + _MARKDOWN_SQL + """ AS markdown,
  CASE form WHEN 12 THEN 'a table part outside of a table' END AS error,
  CASE form WHEN 12 THEN length('ask @' || s || ' about ')::INT END AS error_at FROM w""")
def q_render(spark, d):
    """Markdown, errors and their offsets of pages in every markup form."""
    return render_corpus(_markup(spark, d))


@register("build_wiki_markup", MARKUP_SQL + """,
r AS (SELECT id::INT AS id, CASE WHEN id % 7 = 0 THEN 'help:' ELSE '' END || replace(t, ' ', '_') AS title, """ + _MARKDOWN_SQL + """ AS markdown FROM w),
c AS (SELECT replace(p_name, ' ', '_') AS name, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name),
mx AS (SELECT name, max(n) AS n FROM c GROUP BY name)
SELECT id, greatest(n, 1)::INT AS post_count, title, markdown FROM r LEFT JOIN mx ON title = name WHERE NOT starts_with(title, 'help:')""")
def q_build_wiki_markup(spark, d):
    """The page table of pages in every markup form, with their markdown (none for malformed ones)."""
    title = F.concat(F.when(F.col("id") % 7 == 0, "help:").otherwise(""), F.replace("title", F.lit(" "), F.lit("_")))
    pages = _markup(spark, d).select(F.col("id").cast("int").alias("id"), title.alias("title"), "body")
    return W.build_wiki(pages, _tags(spark, d)).select("id", "post_count", "title", "markdown")


# ---- index and search -------------------------------------------------------------------------

@register("build_search_index", _w(INDEX_CTES) + "SELECT field, term, id, tf, doc_len FROM post")
def q_index(spark, d):
    return W.build_search_index(_wiki(spark, d))


@register("bm25", _w(INDEX_CTES + bm25_sql(W.term_list(BM25_SEARCH), {"score": ("search_text", 1.2, 0.0, False)}))
          + "SELECT id, round(score, 6) AS score FROM s WHERE score IS NOT NULL")
def q_bm25(spark, d):
    w, p = _search_tables(spark, d)
    s = W.bm25_scores(w, p, W.term_list(BM25_SEARCH), {"score": W.BM25(W.TEXT, 1.2, 0.0)},
                      **_written(spark, d, w, p))
    return s.where(F.col("score").isNotNull()).select("id", r6("score").alias("score"))


def query_wiki_sql(search: str, limit: int) -> str:
    terms = W.term_list(search)
    if not search.strip():
        body = """,
r AS (SELECT id, title, post_count, CAST(0.1 AS DOUBLE) AS t0, CAST(0.1 AS DOUBLE) AS t1,
             CAST(0.1 AS DOUBLE) AS text_score FROM w)"""
        thr = 0.0
    else:
        body = bm25_sql(terms, {"t0": ("search_title", 0.0, 0.5, True), "t1": ("search_title", 0.0, 0.5, False),
                                "tx": ("search_text", 1.2, 0.0, False)}) + """,
r AS (SELECT w.id, w.title, w.post_count, greatest(0.1, s.t0) AS t0, greatest(0.1, s.t1) AS t1,
             greatest(0.0, s.tx) + 0.1 AS text_score FROM s JOIN w ON w.id = s.id)"""
        thr = 0.1
    return _w(INDEX_CTES + body) + f"""
SELECT title, post_count, round(t0 + t1, 6) AS title_score, round(text_score, 6) AS text_score,
       round(t0 + t1 + text_score * log10(post_count), 6) AS total_score
FROM r WHERE t0 > {thr} OR t1 > {thr} OR text_score > {thr}
ORDER BY t0 DESC, t0 + t1 + text_score * log10(post_count) DESC, title, id LIMIT {limit}"""


def _round_search(df):
    return df.select(*[r6(c).alias(c) if c.endswith("_score") else F.col(c) for c in df.columns])


@register("query_wiki", query_wiki_sql(SEARCH, LIMIT))
def q_query_wiki(spark, d):
    w, p = _search_tables(spark, d)
    return _round_search(W.query_wiki(w, p, SEARCH, LIMIT, **_written(spark, d, w, p)))


@register("sql_match_bm25", query_wiki_sql(SEARCH, LIMIT))
def q_sql_match(spark, d):
    """The blended search written in SQL text, with the index behind a table function."""
    w, p = _search_tables(spark, d)
    register_search(spark, p, **_written(spark, d, w, p))
    w.createOrReplaceTempView("wiki_pages")
    return spark.sql(f"""
        WITH scored AS (
            SELECT id, title, post_count, greatest(0.1D, a.score) AS t0, greatest(0.1D, b.score) AS t1, greatest(0.0D, c.score) + 0.1D AS tx
            FROM wiki_pages w
            LEFT JOIN match_bm25('{SEARCH}', fields => 'search_title', k => 0.0D, b => 0.5D, conjunctive => 1) a USING (id)
            LEFT JOIN match_bm25('{SEARCH}', fields => 'search_title', k => 0.0D, b => 0.5D) b USING (id)
            LEFT JOIN match_bm25('{SEARCH}', fields => 'search_text', k => 1.2D, b => 0.0D) c USING (id))
        SELECT title, post_count, round(t0 + t1, 6) AS title_score, round(tx, 6) AS text_score, round(t0 + t1 + tx * log10(post_count), 6) AS total_score
        FROM scored WHERE t0 > 0.1D OR t1 > 0.1D OR tx > 0.1D
        ORDER BY t0 DESC, t0 + t1 + tx * log10(post_count) DESC, title, id LIMIT {LIMIT}""")


@register("query_wiki_stop_words", query_wiki_sql(STOP_SEARCH, LIMIT))
def q_query_wiki_stop(spark, d):
    """Stop words alone are no terms: nothing is found."""
    w, p = _search_tables(spark, d)
    return _round_search(W.query_wiki(w, p, STOP_SEARCH, LIMIT, **_written(spark, d, w, p)))


@register("query_wiki_miss", query_wiki_sql(MISS_SEARCH, LIMIT))
def q_query_wiki_miss(spark, d):
    """Two terms that no title holds together: the conjunctive score stays at its floor."""
    w, p = _search_tables(spark, d)
    return _round_search(W.query_wiki(w, p, MISS_SEARCH, LIMIT, **_written(spark, d, w, p)))


@register("query_wiki_popular", query_wiki_sql("", LIMIT))
def q_query_wiki_empty(spark, d):
    """Empty search: every page qualifies, ordered by popularity."""
    w, p = _search_tables(spark, d)
    return _round_search(W.query_wiki(w, p, "", LIMIT))


def title_score_ctes(terms: list[str]) -> str:
    vals = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f""",
tt AS (SELECT id, title, post_count, unnest(regexp_split_to_array(title, '[^a-z0-9]+')) AS token FROM w),
qt AS (SELECT * FROM (VALUES {vals}) v(qi, term)),
best AS (SELECT id, title, post_count, qi, max(jaro_winkler_similarity(term, token)) AS sim
         FROM tt, qt GROUP BY id, title, post_count, qi),
sc AS (SELECT id, title, post_count, sum(sim) / {len(terms)} AS title_score FROM best GROUP BY id, title, post_count)"""


@register("title_similarity", _w(WIKI_CTES + title_score_ctes(TITLE_TERMS))
          + "SELECT id, round(title_score, 6) AS title_score FROM sc")
def q_title_sim(spark, d):
    """Mean over query terms of the best Jaro-Winkler similarity to a title token, every page."""
    s = W.title_similarity(_search_tables(spark, d)[0], TITLE_TERMS)
    return s.select("id", r6("title_score").alias("title_score"))


@register("query_title", _w(WIKI_CTES + title_score_ctes(TITLE_TERMS)) + f"""
SELECT title, post_count, round(title_score, 6) AS title_score FROM sc WHERE title_score >= 0.8
ORDER BY floor(round(title_score, 6) * 100) DESC, post_count DESC, title, id LIMIT {LIMIT}""")
def q_query_title(spark, d):
    w = _search_tables(spark, d)[0]
    return _round_search(W.query_title(w, TITLE_TERMS, LIMIT, **_titles(spark, d, w)))


def query_title_text_sql(search: str, title_terms: list[str], limit: int) -> str:
    return _w(INDEX_CTES + title_score_ctes(title_terms)
              + bm25_sql(W.term_list(search), {"tx": ("search_text", 1.2, 0.0, False)})) + f"""
SELECT sc.title, sc.post_count, round(greatest(0.0, s.tx) + 0.1, 6) AS text_score, round(sc.title_score, 6) AS title_score
FROM sc JOIN s ON s.id = sc.id
WHERE sc.title_score >= 0.8 AND s.tx IS NOT NULL AND greatest(0.0, s.tx) + 0.1 > 0.1
ORDER BY floor(round(sc.title_score, 6) * 100) DESC, sc.post_count DESC, sc.title, sc.id LIMIT {limit}"""


@register("query_title_text", query_title_text_sql(TEXT_SEARCH, TEXT_TITLE_TERMS, LIMIT))
def q_query_title_text(spark, d):
    w, p = _search_tables(spark, d)
    return _round_search(W.query_title_text(w, p, TEXT_SEARCH, TEXT_TITLE_TERMS, LIMIT, **_written(spark, d, w, p), **_titles(spark, d, w)))


_RT, _RTT = W.split_search(ROUTE)


@register("route_query", "SELECT title, post_count FROM (" + query_title_text_sql(_RT, _RTT, LIMIT) + ") x")
def q_route(spark, d):
    """Search-box routing: quoted title terms + free text -> fuzzy-title + text search."""
    w, p = _search_tables(spark, d)
    return W.route_query(w, p, ROUTE, LIMIT, **_written(spark, d, w, p), **_titles(spark, d, w))


@register("fn_query_terms", """
SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS terms FROM benchmark""")
def q_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", query_terms(F.col("text")).alias("terms"))


@register("fn_jaro_winkler", """
SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b,
       round(jaro_winkler_similarity(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)), 6) AS sim
FROM part""")
def q_jw(spark, d):
    p = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"),
                                       F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    return p.select("a", "b", r6(jaro_winkler_udf(F.col("a"), F.col("b"))).alias("sim"))


BATCH_LIMIT = 5


@register("batch_search", _w(INDEX_CTES + f""",
qt AS (SELECT item_id AS qid, list_distinct(list_filter(regexp_extract_all(
         translate(lower(text), '{W.ACCENTED}', '{W.PLAIN}'), '[a-z]+'), lambda x: x NOT IN ({sql_list(W.STOP_WORDS)}))) AS terms FROM benchmark),
qq AS (SELECT qid, len(terms) AS nq, unnest(terms) AS term FROM qt),
hits AS (SELECT * FROM post WHERE term IN (SELECT term FROM qq)),
dfs AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
h AS (SELECT qq.qid, qq.nq, hits.*, log10(((SELECT count(*) FROM w) - dfs.df + 0.5) / (dfs.df + 0.5) + 1) AS idf
      FROM qq JOIN hits ON hits.term = qq.term JOIN dfs ON dfs.term = qq.term),
al AS (SELECT (SELECT sum(tf) FROM post) / (SELECT count(*) FROM w) AS a),
s AS (SELECT qid, id,
        CASE WHEN count(CASE WHEN field = 'search_title' THEN 1 END) = first(nq)
             THEN sum(CASE WHEN field = 'search_title' THEN idf * tf * 1.0 / (tf + 0.0 * (1 - 0.5 + 0.5 * doc_len / (SELECT a FROM al))) END) END AS t0,
        sum(CASE WHEN field = 'search_title' THEN idf * tf * 1.0 / (tf + 0.0 * (1 - 0.5 + 0.5 * doc_len / (SELECT a FROM al))) END) AS t1,
        sum(CASE WHEN field = 'search_text' THEN idf * tf * 2.2 / (tf + 1.2 * (1 - 0.0 + 0.0 * doc_len / (SELECT a FROM al))) END) AS tx
      FROM h GROUP BY qid, id),
r AS (SELECT s.qid, w.id, w.title, w.post_count, greatest(0.1, s.t0) AS t0, greatest(0.1, s.t1) AS t1,
             greatest(0.0, s.tx) + 0.1 AS text_score FROM s JOIN w ON w.id = s.id),
pop AS (SELECT id, title, post_count, CAST(0.1 AS DOUBLE) AS t0, CAST(0.1 AS DOUBLE) AS t1, CAST(0.1 AS DOUBLE) AS text_score
        FROM w ORDER BY 0.2 + 0.1 * log10(post_count) DESC, title, id LIMIT {BATCH_LIMIT}),
rr AS (SELECT * FROM r WHERE t0 > 0.1 OR t1 > 0.1 OR text_score > 0.1
       UNION ALL SELECT qt.qid, pop.* FROM qt, pop WHERE len(qt.terms) = 0),
ranked AS (SELECT *, t0 + t1 + text_score * log10(post_count) AS total,
                  row_number() OVER (PARTITION BY qid ORDER BY t0 DESC, t0 + t1 + text_score * log10(post_count) DESC, title, id) AS rank
           FROM rr)""") + f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, title, post_count, round(t0 + t1, 6) AS title_score, round(text_score, 6) AS text_score,
       round(total, 6) AS total_score
FROM ranked WHERE rank <= {BATCH_LIMIT}""")
def q_batch_search(spark, d):
    """Every benchmark text as a search query, top-5 pages each, in one job over block-max postings."""
    w, p = _search_tables(spark, d)
    return _round_search(T.batch_top_k(w, _blocks(spark, d, w, p), _questions(spark, d), limit=BATCH_LIMIT, **_written(spark, d, w, p)))


@register("stem_terms")
def q_stem_terms(spark, d):
    """The index dictionary with English stems (checked against published vocabulary pairs in tests)."""
    _, p = _search_tables(spark, d)
    return stem_terms(p.select("term").distinct())


@register("query_wiki_stemmed")
def q_query_wiki_stemmed(spark, d):
    """Blended search over the stemmed index (stemmed query terms)."""
    w, p = _search_tables(spark, d)
    ps = materialize_once(spark, "postings_stemmed", [f"{d}/{t}.parquet" for t in ("documents", "part", "lineitem")],
                          lambda: W.stem_index(p), sort_by=["term", "id"])
    return _round_search(W.query_wiki(w, ps, "red widgets", LIMIT, stem=True))
