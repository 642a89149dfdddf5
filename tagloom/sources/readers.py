"""Readers of the input tables with declared schemas: rows that don't fit are kept aside with their reasons.

A file may hold a column in another type than the declared one (counts as text, ids as long). Its values are cast; a value that
doesn't survive the cast, or is null where a value is required, rejects its row. Columns that have their declared type are
read as they are, so projections and filters reach the scan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources.labels import category_names, read_label_csv, read_label_json

TAGS = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("post_count", T.IntegerType())])
PAGES = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("title", T.StringType()),
                      T.StructField("body", T.StringType())])
TAG_GROUPS = T.StructType([T.StructField("tag", T.StringType(), False), T.StructField("tag_group", T.StringType(), False)])
LABEL_FORMATS = {"csv": read_label_csv, "json": read_label_json}


class Read(NamedTuple):
    """What a reader found: the rows that fit, and ``(reason, row)`` of the others, ``row`` as JSON of the declared columns."""
    rows: DataFrame
    rejected: DataFrame


def read_declared(spark: SparkSession, path: str, schema: T.StructType) -> Read:
    """The declared columns of a Parquet table; a column that is missing from the files is an error that names it."""
    found = spark.read.parquet(path)
    missing = [f.name for f in schema if f.name not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return declared(found, schema)


def declared(found: DataFrame, schema: T.StructType) -> Read:
    typed, fits, reasons = [], F.lit(True), []
    for f in schema:
        raw = F.col(f"`{f.name}`")
        same = found.schema[f.name].dataType == f.dataType
        value = raw if same else raw.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        if not same:
            fits = fits & (value.isNotNull() | raw.isNull())
            reasons.append(F.when(value.isNull() & raw.isNotNull(), f"{f.name} is no {f.dataType.simpleString()}"))
        if not f.nullable:
            fits = fits & raw.isNotNull()
            reasons.append(F.when(raw.isNull(), f"{f.name} is missing"))
    row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema]))
    return Read(found.where(fits).select(*typed), found.where(~fits).select(F.concat_ws(", ", *reasons).alias("reason"), row.alias("row")))


def read_tags(spark: SparkSession, path: str) -> Read:
    """Popularity table ``(name, post_count)``; a tag needs a name, its count may be null."""
    return read_declared(spark, path, TAGS)


def read_pages(spark: SparkSession, path: str) -> Read:
    """Page table ``(id, title, body)``; a page needs an id."""
    return read_declared(spark, path, PAGES)


def read_tag_groups(spark: SparkSession, path: str) -> Read:
    """``(tag, tag_group)``; both are required."""
    return read_declared(spark, path, TAG_GROUPS)


def tag_groups(groups: DataFrame) -> DataFrame:
    return groups.select("tag_group").distinct()


def tags_in_group(groups: DataFrame, group: str) -> DataFrame:
    """Distinct tags of one group; the filter reaches the scan."""
    return groups.where(F.col("tag_group") == group).select("tag").distinct()


def read_labels(spark: SparkSession, path: str, fmt: str) -> Read:
    """Label vocabulary ``(idx, name, category)`` of a tagging model, from CSV with category codes or JSON maps. A label without
    a name or with an unknown code is rejected; the others keep their positions."""
    if fmt not in LABEL_FORMATS:
        raise ValueError(f"unknown label format {fmt!r}; known: {', '.join(LABEL_FORMATS)}")
    labels = LABEL_FORMATS[fmt](spark, path)
    named = category_names(labels) if fmt == "csv" else labels
    nameless = F.coalesce(F.col("name"), F.lit("")) == ""
    fits = ~nameless & F.col("category").isNotNull()
    reason = F.when(nameless, "name is missing").otherwise("category code is unknown")
    return Read(named.where(fits).select("idx", "name", "category"),
                named.where(~fits).select(reason.alias("reason"), F.to_json(F.struct("idx", "name")).alias("row")))
