"""Labelled rows for the operators that learn: a bounded, documented sample of the training folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import fold

MAX_LABELLED = 20_000      # rows a classifier learns from at most: those with the least hash of their id


def training_labels(labels: DataFrame, name: str, modulus: int, held_out: int, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, label`` (0 or 1) outside the held-out fold; null ids and labels are left out, an id whose rows
    disagree has their mean's nearer label (a tie: 1). At most ``limit`` rows, so a join may broadcast them."""
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~fold("doc_id", modulus, held_out))
            .groupBy("doc_id").agg(F.avg(name).alias("label"))
            .select("doc_id", F.when(F.col("label") >= 0.5, 1).otherwise(0).alias("label")))
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(limit)
