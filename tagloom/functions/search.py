"""Search from SQL text: ``match_bm25`` as a SQL table function over the written index.

    SELECT w.title, s.score
    FROM match_bm25('red widget', fields => 'search_title', k => 0.0, b => 0.5, conjunctive => 1) s JOIN wiki w ON w.id = s.id

It returns ``(id, score)`` of the pages that match: those with a query term in one of the fields (a comma list), or with all of
them if ``conjunctive`` is 1. Document frequencies and lengths count all fields, as in ``plans.wiki.bm25_scores``. The function is a
query over the views of the index, so Spark plans it with the statement around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.sql import _q
from tagloom.plans.wiki import ACCENTED, DEFAULT_OPTIONS, PLAIN, IndexOptions

VIEWS = ("wiki_postings", "wiki_terms", "wiki_stats")


def _terms_sql(query: str, options: IndexOptions) -> str:
    text = f"lower({query})"
    if options.strip_accents:
        text = f"translate({text}, {_q(ACCENTED)}, {_q(PLAIN)})"
    stop = ", ".join(_q(w) for w in options.stop_words) or "''"
    return f"array_distinct(filter(split({text}, {_q(options.separator)}, -1), t -> t <> '' AND t NOT IN ({stop})))"


def register_search(spark: SparkSession, postings: DataFrame, dictionary: DataFrame, stats: DataFrame,
                    options: IndexOptions = DEFAULT_OPTIONS) -> None:
    """Views of the index (``VIEWS``) and the table function ``match_bm25`` over them."""
    for name, df in zip(VIEWS, (postings, dictionary, stats), strict=True):
        df.createOrReplaceTempView(name)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION match_bm25(
            query STRING, fields STRING DEFAULT 'search_title,search_text', k DOUBLE DEFAULT 1.2D, b DOUBLE DEFAULT 0.75D, conjunctive INT DEFAULT 0)
        RETURNS TABLE (id INT, score DOUBLE)
        RETURN
            SELECT id, score FROM (
                SELECT id, sum(idf * tf * (p_k + 1) / (tf + p_k * (1 - p_b + p_b * doc_len / avg_len))) AS score,
                       count(DISTINCT term) AS found, max(n) AS n, max(p_all) AS p_all
                FROM (SELECT explode(terms) AS term, size(terms) AS n, transform(split(p_fields, ','), f -> trim(f)) AS p_fields, p_k, p_b, p_all
                      FROM (SELECT {_terms_sql('query', options)} AS terms, fields AS p_fields, k AS p_k, b AS p_b, conjunctive AS p_all)) q
                JOIN (SELECT term, log10(((SELECT n_docs FROM wiki_stats) - df + 0.5D) / (df + 0.5D) + 1) AS idf,
                             (SELECT total_len / n_docs FROM wiki_stats) AS avg_len FROM wiki_terms) d USING (term)
                JOIN wiki_postings p USING (term)
                WHERE array_contains(p_fields, field)
                GROUP BY id)
            WHERE p_all = 0 OR found = n""")
