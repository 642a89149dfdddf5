"""The query of the exact duplicates, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import exact
from tagloom.llm.common import table


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
