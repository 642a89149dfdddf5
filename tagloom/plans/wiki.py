"""Wiki corpus build (W1) and search (W2).

Build: filter namespaces -> left join deduplicated tag counts (AQE turns it into a broadcast join
when the count table measures small, a shuffle join otherwise) -> clamp -> search columns.

Index: ``postings(field, term, id, tf, doc_len)`` with one row per (doc, field, term). ``doc_len``
is denormalised into the postings so a query is a filter on ``term`` (pushed into the scan /
pruned by a term-sorted layout) plus ONE aggregation per document; corpus statistics (N, avgdl)
and per-term document frequencies are aggregates over the same table, joined as scalars or
small per-term frames whose size is bounded by the number of query terms.

Search: query strings are parameters parsed on the driver (they are configuration, not data).
Fuzzy title matching scores Jaro-Winkler only on *distinct* (query term, title token) pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions.jaro import jaro_winkler_udf
from tagloom.functions.stem import stem_terms
from tagloom.functions.text import SKIPPED_NAMESPACES, TOKEN_SEPARATOR, normalise_text
from tagloom.operators.markup import plain_text
from tagloom.session import materialize

TITLE, TEXT = "search_title", "search_text"


# ---------------------------------------------------------------------------------------------
# build
# ---------------------------------------------------------------------------------------------

def tags_max_count(tags: DataFrame) -> DataFrame:
    """``(name, post_count)`` deduplicated: the max count per name (a partial aggregate)."""
    return tags.groupBy("name").agg(F.max("post_count").alias("post_count"))


def filter_namespaces(pages: DataFrame, prefixes=SKIPPED_NAMESPACES, title_col: str = "title") -> DataFrame:
    """Drop pages whose title starts with a skipped namespace (a NULL title is dropped too)."""
    t = F.col(title_col)
    cond = None
    for p in prefixes:
        c = ~t.startswith(p)
        cond = c if cond is None else cond & c
    return pages.where(cond)


def clamp_post_count(c) -> F.Column:
    """``greatest(post_count, 1)``: NULL (no count) becomes 1."""
    return F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(1))


def join_pages_counts(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """Pages LEFT JOIN deduplicated counts on ``title = name`` (row count = pages)."""
    t = tags_max_count(tags)
    return pages.join(t, pages.title == t.name, "left").drop("name")


def build_wiki(pages: DataFrame, tags: DataFrame, render=None) -> DataFrame:
    """``wiki(id, post_count, title, markdown, search_title, search_text)``.

    ``render`` maps the body column to markdown (default: the native renderer)."""
    if render is None:
        from tagloom.operators.render import render_markdown as render
    w = join_pages_counts(filter_namespaces(pages.select("id", "title", "body")), tags)
    return w.select("id", clamp_post_count("post_count").alias("post_count"), "title",
                    render(F.col("body")).alias("markdown"),
                    normalise_text(F.col("title")).alias(TITLE),
                    normalise_text(plain_text(F.col("body"))).alias(TEXT))


def count_pages(wiki: DataFrame) -> DataFrame:
    return wiki.select(F.count(F.lit(1)).alias("n_pages"))


def lookup_title(wiki: DataFrame, title: str) -> DataFrame:
    """Markdown of one exact title; the lowest id wins when titles repeat."""
    return wiki.where(F.col("title") == title).orderBy("id").limit(1).select("title", "markdown")


def write_wiki(wiki: DataFrame, path: str) -> None:
    """Atomic overwrite of the page table; asserts that ``id`` is unique first."""
    dup = wiki.groupBy("id").count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError("wiki page ids are not unique")
    wiki.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------------------------------------
# inverted index
# ---------------------------------------------------------------------------------------------

# Latin letters with accents and their plain forms, and English function words.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
STOP_WORDS = tuple("""a about above after again all also am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have having he her here
hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over
own same she should so some such than that the their them then there these they this those through to too under until
up very was we were what when where which while who whom why will with would you your""".split())


@dataclass(frozen=True)
class IndexOptions:
    """How texts and queries are cut into terms: lower-cased, accents stripped, split at ``separator`` (a regular
    expression that Java and Python read alike), stop words left out. ``stop_words`` takes any list."""
    separator: str = "[^a-z]+"
    strip_accents: bool = True
    stop_words: tuple[str, ...] = STOP_WORDS

    def cut(self, c: F.Column) -> F.Column:
        """What a text is cut into, terms or not."""
        text = F.lower(c)
        if self.strip_accents:
            text = F.translate(text, ACCENTED, PLAIN)
        return F.split(text, self.separator, -1)

    def is_term(self, t: F.Column) -> F.Column:
        return (t != "") & ~t.isin(list(self.stop_words))

    def terms(self, c: F.Column) -> F.Column:
        return F.filter(self.cut(c), self.is_term)

    def query_terms(self, query: str) -> list[str]:
        text = query.lower()
        if self.strip_accents:
            text = text.translate(str.maketrans(ACCENTED, PLAIN))
        return [t for t in re.split(self.separator, text) if t and t not in self.stop_words]


DEFAULT_OPTIONS = IndexOptions()
PAGES_CUT, POSTINGS_HELD = 64, 50_000       # pages whose words a task holds at a time; postings before it passes them on


def build_search_index(wiki: DataFrame, fields=(TITLE, TEXT), options: IndexOptions = DEFAULT_OPTIONS) -> DataFrame:
    """``postings(field, term, id, tf, doc_len)``; ``doc_len`` counts the terms of all fields.

    Pages are dealt and sorted by ``id`` as whole texts; every field is cut by native expressions, and a task counts the terms
    of one page at a time (rows that repeat an id are one page), so it never holds the words of many pages as rows."""
    pages = wiki.select("id", *fields).repartition("id").sortWithinPartitions("id")
    cut = pages.select("id", *[options.terms(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = _Postings(kind), 0
        counts, page = [Counter() for _ in fields], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, PAGES_CUT):
                lists = [c.slice(at, PAGES_CUT).to_pylist() for c in batch.columns[1:]]
                for i, *terms in zip(ids[at:at + PAGES_CUT], *lists, strict=True):
                    if rows and i != page:
                        held.add(page, fields, counts)
                        counts = [Counter() for _ in fields]
                        if held.size() > POSTINGS_HELD:
                            yield held.take()
                    page, rows = i, rows + 1
                    for c, t in zip(counts, terms, strict=True):
                        c.update(t or ())
        if rows:
            held.add(page, fields, counts)
            yield held.take()

    name = wiki.schema["id"].dataType.simpleString()
    kind = to_arrow_type(wiki.schema["id"].dataType)
    return cut.mapInArrow(run, f"field string, term string, id {name}, tf long, doc_len int")


class _Postings:
    """Postings of whole pages, column by column."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind
        self.columns: list[list] = [[], [], [], [], []]

    def size(self) -> int:
        return len(self.columns[0])

    def add(self, page, fields, counts: list[Counter]) -> None:
        length = sum(sum(c.values()) for c in counts)
        field, term, ids, tf, doc_len = self.columns
        for f, c in zip(fields, counts, strict=True):
            field += [f] * len(c)
            term += c.keys()
            ids += [page] * len(c)
            tf += c.values()
            doc_len += [length] * len(c)

    def take(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), self.kind, pa.int64(), pa.int32())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)],
                                         ["field", "term", "id", "tf", "doc_len"])
        self.columns = [[], [], [], [], []]
        return out


def doc_lengths(fields=(TITLE, TEXT), options: IndexOptions = DEFAULT_OPTIONS) -> F.Column:
    return sum((F.size(options.terms(F.col(f))) for f in fields), F.lit(0))


def stem_index(postings: DataFrame) -> DataFrame:
    """Stemmed postings: the distinct term dictionary is stemmed once, written down (the
    chain of projections would otherwise be planned anew in the join), joined back on the term, and term frequencies
    of words sharing a stem are summed per (field, stem, doc)."""
    smap = materialize(stem_terms(postings.select("term").distinct()), "stems")
    return (postings.join(smap, "term")
            .groupBy("field", F.col("stem").alias("term"), "id")
            .agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len")))


def term_dictionary(postings: DataFrame) -> DataFrame:
    """``(term, df)``: documents containing each term in any field. Built once with the index
    (persisted clustered by term); queries then read the df of their terms instead of counting
    distinct documents over their hits."""
    return postings.select("term", "id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def write_search_index(postings: DataFrame, path: str) -> None:
    """Persist postings clustered by term: a query's ``term IN (...)`` then prunes row groups. The ranges are cut by
    ``(term, id)``, so a frequent term is written by many tasks."""
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def corpus_stats(wiki: DataFrame, fields=(TITLE, TEXT), options: IndexOptions = DEFAULT_OPTIONS) -> DataFrame:
    """One row ``(n_docs, total_len)``, written next to the postings: searches read it instead of the pages' texts."""
    return wiki.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(doc_lengths(fields, options)).alias("total_len"))


@dataclass(frozen=True)
class BM25:
    field: str
    k: float
    b: float
    conjunctive: bool = False


def term_list(query: str, options: IndexOptions = DEFAULT_OPTIONS) -> list[str]:
    """Query terms, cut as the index cuts texts."""
    return options.query_terms(query)


def stemmed(spark, terms: list[str]) -> list[str]:
    """The stems of a query's few terms, by the function that stems the index."""
    rows = stem_terms(spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    return [r["stem"] for r in rows]


def _scalars(stats: DataFrame) -> tuple[F.Column, F.Column]:
    n = stats.select("n_docs").scalar()
    return n, stats.select("total_len").scalar() / n


def bm25_scores(wiki: DataFrame, postings: DataFrame, terms: list[str], specs: dict[str, BM25],
                dictionary: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Scores ``(id, <name>...)`` of every document matching at least one term, one column per
    spec, all computed in ONE aggregation over the postings of the query terms.

    idf = log10((N - df + 0.5) / (df + 0.5) + 1), df over all fields; a non-matching document (or,
    for a conjunctive spec, one lacking a distinct query term in that field) scores NULL."""
    q = sorted(set(terms))
    hits = postings.where(F.col("term").isin(q))
    n, avg_len = _scalars(corpus_stats(wiki) if stats is None else stats)
    if dictionary is not None:
        df = dictionary.where(F.col("term").isin(q))                      # at most len(q) rows
    else:
        df = hits.groupBy("term").agg(F.countDistinct("id").alias("df"))  # at most len(q) rows
    idf = F.log10((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    h = hits.join(F.broadcast(df.select("term", idf.alias("idf"))), "term")
    aggs = []
    for name, s in specs.items():
        in_field = F.col("field") == s.field
        w = F.col("idf") * F.col("tf") * (s.k + 1) / (
            F.col("tf") + s.k * (1 - s.b + s.b * F.col("doc_len") / avg_len))
        score = F.sum(F.when(in_field, w))
        if s.conjunctive:
            # postings are unique per (doc, field, term): a plain count is the number of distinct
            # query terms the field holds (no distinct aggregation, no extra shuffle)
            score = F.when(F.count(F.when(in_field, F.lit(1))) == len(q), score)
        aggs.append(score.alias(name))
    return h.groupBy("id").agg(*aggs)


# ---------------------------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------------------------

def _order_limit(df: DataFrame, order, limit: int) -> DataFrame:
    return df.orderBy(*order, F.col("title"), F.col("id")).limit(limit)


def query_wiki(wiki: DataFrame, postings: DataFrame, search: str, limit: int = 10, stem: bool = False,
               dictionary: DataFrame | None = None, stats: DataFrame | None = None,
               options: IndexOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Blended search: conjunctive and disjunctive title BM25 (k=0), text BM25 (k=1.2, b=0),
    popularity boost ``text * log10(post_count)``; an empty query lists pages by popularity, one of stop
    words alone finds none. ``stem=True`` for an index built with :func:`stem_index`."""
    terms = term_list(search, options)
    if stem and terms:
        terms = stemmed(wiki.sparkSession, terms)
    if not search.strip():
        scored = wiki.select("id", "title", "post_count", F.lit(None).cast("double").alias("t0"),
                             F.lit(None).cast("double").alias("t1"), F.lit(None).cast("double").alias("tx"))
        threshold = 0.0
    else:
        s = bm25_scores(wiki, postings, terms, {
            "t0": BM25(TITLE, 0.0, 0.5, conjunctive=True),
            "t1": BM25(TITLE, 0.0, 0.5),
            "tx": BM25(TEXT, 1.2, 0.0)}, dictionary=dictionary, stats=stats)
        # only documents with a hit can pass the threshold: join the hits, not the whole table
        scored = s.join(wiki.select("id", "title", "post_count"), "id")
        threshold = 0.1
    t0 = F.greatest(F.lit(0.1), F.col("t0"))
    t1 = F.greatest(F.lit(0.1), F.col("t1"))
    tx = F.greatest(F.lit(0.0), F.col("tx")) + 0.1
    res = scored.select("id", "title", "post_count", t0.alias("t0"), t1.alias("t1"), tx.alias("text_score"))
    res = res.where((F.col("t0") > threshold) | (F.col("t1") > threshold) | (F.col("text_score") > threshold))
    res = res.select("id", "title", "post_count", "t0", (F.col("t0") + F.col("t1")).alias("title_score"),
                     "text_score",
                     (F.col("t0") + F.col("t1") + F.col("text_score") * F.log10("post_count")).alias("total_score"))
    return _order_limit(res, [F.col("t0").desc(), F.col("total_score").desc()], limit) \
        .select("title", "post_count", "title_score", "text_score", "total_score")


def title_similarity(wiki: DataFrame, terms: list[str]) -> DataFrame:
    """``(id, title, post_count, title_score)``: mean over query terms of the best Jaro-Winkler
    similarity between the term and the tokens of the original title (split on non ``[a-z0-9]``,
    empty tokens included).

    Jaro-Winkler runs on distinct (term, token) pairs: the token vocabulary is generated against the
    literal term list (a generator, not a join) and joined back on the token."""
    toks = wiki.select("id", "title", "post_count",
                       F.explode(F.split(F.col("title"), TOKEN_SEPARATOR, -1)).alias("token"))
    qterms = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    vocab = toks.select("token").distinct()
    sims = (vocab.select("token", F.inline(qterms))
            .withColumn("sim", jaro_winkler_udf(F.col("term"), F.col("token"))))
    best = (toks.join(sims, "token").groupBy("id", "title", "post_count", "qi")
            .agg(F.max("sim").alias("sim")))
    return best.groupBy("id", "title", "post_count").agg((F.sum("sim") / len(terms)).alias("title_score"))


def _title_matches(wiki: DataFrame, terms: list[str], titles: DataFrame | None, tokens: DataFrame | None) -> DataFrame:
    """Pages whose titles pass, from the written title index where there is one."""
    from tagloom.plans import fuzzy
    titles = fuzzy.title_postings(wiki) if titles is None else titles
    return fuzzy.title_matches(titles, fuzzy.title_tokens(titles) if tokens is None else tokens, terms)


def query_title(wiki: DataFrame, terms: list[str], limit: int = 10, titles: DataFrame | None = None,
                tokens: DataFrame | None = None) -> DataFrame:
    """Fuzzy title search; ``titles`` and ``tokens`` are the written title index (:mod:`tagloom.plans.fuzzy`)."""
    s = _title_matches(wiki, terms, titles, tokens)
    bucket = F.floor(F.round(F.col("title_score"), 6) * 100)
    return _order_limit(s, [bucket.desc(), F.col("post_count").desc()], limit) \
        .select("title", "post_count", "title_score")


def query_title_text(wiki: DataFrame, postings: DataFrame, search: str, title_terms: list[str],
                     limit: int = 10, dictionary: DataFrame | None = None, stats: DataFrame | None = None,
                     options: IndexOptions = DEFAULT_OPTIONS, titles: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Fuzzy title score >= 0.8 AND a text match (text score > 0.1)."""
    terms = term_list(search, options)
    tx = bm25_scores(wiki, postings, terms, {"tx": BM25(TEXT, 1.2, 0.0)}, dictionary=dictionary, stats=stats) \
        .where(F.col("tx").isNotNull())
    s = (_title_matches(wiki, title_terms, titles, tokens)
         .join(tx.select("id", (F.greatest(F.lit(0.0), F.col("tx")) + 0.1).alias("text_score")), "id")
         .where(F.col("text_score") > 0.1))
    bucket = F.floor(F.round(F.col("title_score"), 6) * 100)
    return _order_limit(s, [bucket.desc(), F.col("post_count").desc()], limit) \
        .select("title", "post_count", "text_score", "title_score")


def split_search(search: str) -> tuple[str, list[str]]:
    """Route a search box string: ``"quoted"`` parts are title terms (split on non ``[a-z0-9]``),
    the rest is the text query."""
    quoted = re.findall('".+?"', search)
    for q in quoted:
        search = search.replace(q, "")
    title_terms = [t for q in quoted for t in re.split("[^a-z0-9]+", q.lower()) if t]
    return search.strip(), title_terms


def route_query(wiki: DataFrame, postings: DataFrame, search: str, limit: int = 20,
                dictionary: DataFrame | None = None, stats: DataFrame | None = None, titles: DataFrame | None = None,
                tokens: DataFrame | None = None) -> DataFrame:
    """Three-way dispatch: title terms + text, title terms only, or blended text search.
    Returns ``(title, post_count)``."""
    text, title_terms = split_search(search)
    if title_terms:
        if text:
            found = query_title_text(wiki, postings, text, title_terms, limit, dictionary, stats, titles=titles, tokens=tokens)
        else:
            found = query_title(wiki, title_terms, limit, titles, tokens)
        return found.select("title", "post_count")
    return query_wiki(wiki, postings, text, limit, dictionary=dictionary, stats=stats).select("title", "post_count")


def popular_for_empty(pages: DataFrame, queries: DataFrame, limit: int, qid: str, text: str, options: IndexOptions) -> DataFrame:
    """``(qid, id, title, post_count, t0, t1, text_score, total)``: queries without terms match every page, so the most popular
    ones rank. That list (at most ``limit`` rows) is one scalar array, inlined into each empty query: a generator, not a join."""
    t0 = F.lit(0.1)
    total = t0 + t0 + t0 * F.log10("post_count")
    popular = (pages.select("id", "title", "post_count", t0.alias("t0"), t0.alias("t1"), t0.alias("text_score"), total.alias("total"))
               .orderBy(F.col("total").desc(), "title", "id").limit(limit))
    top = popular.select(F.collect_list(F.struct(*popular.columns)).alias("top")).scalar()
    return queries.where(F.size(options.terms(F.col(text))) == 0).select(F.col(qid).alias("qid"), F.inline(top))


def batch_query_wiki(wiki: DataFrame, postings: DataFrame, queries: DataFrame, limit: int = 10,
                     qid: str = "qid", text: str = "text", dictionary: DataFrame | None = None,
                     stats: DataFrame | None = None, options: IndexOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Many blended searches in one job: top-``limit`` pages per query, ``(qid, rank, title,
    post_count, title_score, text_score, total_score)``.

    The query terms are exploded and joined to the postings of the terms in use; the scores are one
    aggregation on ``(qid, id)``. The per-query top-k is ``row_number() <= limit``, which Spark
    plans with a partial group limit before the shuffle, so a query that matches a third of all
    pages still ships at most ``limit`` rows per task. A query without terms lists the most popular
    pages (the top-k by popularity is computed once and joined on the term count)."""
    qt = queries.select(F.col(qid).alias("qid"), F.array_distinct(options.terms(F.col(text))).alias("terms"))
    qt = qt.select("qid", F.size("terms").alias("nq"), "terms")
    qterm = qt.select("qid", "nq", F.explode("terms").alias("term"))
    used = qterm.select("term").distinct()
    hits = postings.join(used, "term", "left_semi")
    n, avg_len = _scalars(corpus_stats(wiki) if stats is None else stats)
    if dictionary is not None:
        dfs = dictionary.join(used, "term", "left_semi")
    else:
        dfs = hits.groupBy("term").agg(F.countDistinct("id").alias("df"))
    idf = dfs.select("term", F.log10((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    h = qterm.join(hits.join(idf, "term"), "term")

    def w(k, b):
        return F.col("idf") * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("doc_len") / avg_len))
    in_title, in_text = F.col("field") == TITLE, F.col("field") == TEXT
    s = h.groupBy("qid", "id").agg(
        F.when(F.count(F.when(in_title, F.lit(1))) == F.first("nq"), F.sum(F.when(in_title, w(0.0, 0.5)))).alias("t0"),
        F.sum(F.when(in_title, w(0.0, 0.5))).alias("t1"),
        F.sum(F.when(in_text, w(1.2, 0.0))).alias("tx"))
    pages = wiki.select("id", "title", "post_count")
    t0 = F.greatest(F.lit(0.1), F.col("t0"))
    t1 = F.greatest(F.lit(0.1), F.col("t1"))
    tx = F.greatest(F.lit(0.0), F.col("tx")) + 0.1
    hit_rows = (s.join(pages, "id")
                .select("qid", "id", "title", "post_count", t0.alias("t0"), t1.alias("t1"), tx.alias("text_score"))
                .where((F.col("t0") > 0.1) | (F.col("t1") > 0.1) | (F.col("text_score") > 0.1)))
    total = F.col("t0") + F.col("t1") + F.col("text_score") * F.log10("post_count")
    empty = popular_for_empty(pages, queries, limit, qid, text, options).drop("total")
    rows = hit_rows.unionByName(empty).withColumn("total_score", total)
    win = Window.partitionBy("qid").orderBy(F.col("t0").desc(), F.col("total_score").desc(), "title", "id")
    return (rows.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= limit)
            .select("qid", "rank", "title", "post_count", (F.col("t0") + F.col("t1")).alias("title_score"),
                    "text_score", "total_score"))
