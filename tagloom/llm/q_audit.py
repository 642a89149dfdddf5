"""The query of the filter interaction audit, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import audit
from tagloom.llm.common import table


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN lab USING (doc_id)),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
j AS (SELECT *, contains(fails, x) AS fail, translate(fails, earlier, '') <> fails AS gone FROM c, s),
r AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM j GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r"""
