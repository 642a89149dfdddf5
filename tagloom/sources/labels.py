"""Label vocabularies of tagging models: CSV ``name, category`` (row order = score index) or JSON
maps ``idx_to_tag`` / ``tag_to_category``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.stats import CATEGORY_CODES

GENERAL = "general"


def category_names(labels: DataFrame) -> DataFrame:
    """``(idx, name, category)`` with category codes turned into names (9 rating, 0 general,
    4 character)."""
    expr = None
    for k, v in CATEGORY_CODES.items():
        expr = F.when(F.col("category") == k, v) if expr is None else expr.when(F.col("category") == k, v)
    return labels.select("idx", "name", expr.alias("category"))


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (``name``, ``category`` at least). The score index is the row's place in the file: the file is
    read as one text (a vocabulary is small), its lines are numbered as they stand, and every line is parsed by the
    header. Blank lines are no rows."""
    lines = (spark.read.text(path, wholetext=True)
             .select(F.filter(F.split("value", "\r?\n", -1), lambda x: F.trim(x) != "").alias("lines")))
    header = next(iter(lines.select(F.col("lines")[0]).first()), "") or ""
    schema = ", ".join(f"`{c.strip().strip(chr(34))}` string" for c in header.split(","))
    rows = lines.select(F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("idx", "line"))
    row = F.from_csv("line", schema)
    return rows.select(F.col("idx").cast("long").alias("idx"), row["name"].alias("name"), row["category"].cast("int").alias("category"))


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{"total_tags": n, "idx_to_tag": {"0": "x", ...}, "tag_to_category": {"x": "general"}}``:
    every index below ``total_tags`` is a label; an index missing from ``idx_to_tag`` becomes
    ``unknown-<idx>``, a tag missing from ``tag_to_category`` is ``general``. Without
    ``total_tags`` the indexes of ``idx_to_tag`` are the labels."""
    raw = spark.read.option("multiLine", "true").json(path)
    idx = raw.select(F.explode(F.from_json(F.to_json("idx_to_tag"), "map<string,string>")).alias("idx", "name")) \
        .select(F.col("idx").cast("long").alias("idx"), "name")
    cat = raw.select(F.explode(F.from_json(F.to_json("tag_to_category"), "map<string,string>")).alias("name", "category"))
    if "total_tags" in raw.columns:
        every = raw.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_tags").cast("long") - 1)).alias("idx"))
        idx = every.join(idx, "idx", "left")
    named = idx.select("idx", F.coalesce(F.col("name"), F.concat(F.lit("unknown-"), F.col("idx").cast("string"))).alias("name"))
    return (named.join(cat, "name", "left")
            .select("idx", "name", F.coalesce(F.col("category"), F.lit(GENERAL)).alias("category")))
