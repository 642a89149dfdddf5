"""The query of the vector codes, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import codes
from tagloom.llm.common import table


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Entries after one more round: the floor of the mean of the parts nearest to each, unused entries as they were."""
    return f"""
n{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT x.rid, x.part, e.entry, sum((x.v - e.v) * (x.v - e.v)) AS dist FROM x JOIN e{k} e USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part)"""


def _update(k: int) -> str:
    return f"""
m{k} AS (SELECT x.part, n.entry, pos, sum(x.v)::BIGINT AS s, count(*) AS c FROM x JOIN n{k} n USING (rid, part) GROUP BY ALL),
e{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN c IS NULL THEN e.v ELSE (s - ((s % c) + c) % c) // c END AS v
  FROM e{k} e LEFT JOIN m{k} USING (part, entry, pos))"""


SQL = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (
  SELECT rid, (i * 16) // d AS part, i % (d // 16) AS pos, v FROM (
    SELECT rid, len(embedding) AS d, unnest(range(len(embedding))) AS i, floor(unnest(embedding)::DOUBLE * 256)::BIGINT AS v FROM k)),
e0 AS (SELECT part, rid - 1 AS entry, pos, v FROM x WHERE rid <= 64),""" + ",".join((
    _round(0), _update(0), _round(1), _update(1), _round(2))) + """,
b AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e2),
r AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM n2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), b"""
