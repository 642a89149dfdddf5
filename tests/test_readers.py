"""Readers: declared schemas, rows kept aside, missing columns, formats."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.session import write_table
from tagloom.sources import readers as R


def kept(read):
    return sorted((tuple(r) for r in read.rows.collect()), key=str), sorted((tuple(r) for r in read.rejected.collect()), key=str)


def test_counts_as_text(spark):
    rows = [("oak", "5"), ("ash", None), (None, "3"), ("elm", "1.5e9x"), ("fir", str(1 << 40)), ("", " 7 ")]
    path = write_table(spark.createDataFrame(rows, "name string, post_count string"), "t")
    rows, rejected = kept(R.read_tags(spark, path))
    assert rows == sorted([("oak", 5), ("ash", None), ("", 7)], key=str)
    assert rejected == sorted([("name is missing", '{"post_count":"3"}'), ("post_count is no int", '{"name":"elm","post_count":"1.5e9x"}'),
                               ("post_count is no int", json.dumps({"name": "fir", "post_count": str(1 << 40)}, separators=(",", ":")))], key=str)


def test_two_reasons_and_other_columns(spark):
    path = write_table(spark.createDataFrame([(None, "x", 1, 2)], "id long, title string, body int, reason int"), "t")
    rows, rejected = kept(R.read_pages(spark, path))
    assert not rows and [r[0] for r in rejected] == ["id is missing"]
    path = write_table(spark.createDataFrame([(1, "x", 1, 2)], "id long, title string, body int, reason int"), "t")
    assert kept(R.read_pages(spark, path)) == ([(1, "x", "1")], [])


def test_declared_types_leave_the_scan_alone(spark):
    path = write_table(spark.createDataFrame([("oak", "a"), (None, "a"), ("ash", "b")], "tag string, tag_group string"), "t")
    read = R.read_tag_groups(spark, path)
    df = R.tags_in_group(read.rows, "a")
    assert [r.tag for r in df.collect()] == ["oak"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag_group,a)" in plan and "IsNotNull(tag)" in plan
    assert R.tag_groups(read.rows).count() == 2 and read.rejected.count() == 1


def test_missing_column_is_named(spark):
    path = write_table(spark.range(3), "t")
    with pytest.raises(ValueError, match="title, body"):
        R.read_pages(spark, path)


def test_empty_table(spark):
    path = write_table(spark.createDataFrame([], "name string, post_count long"), "t")
    assert kept(R.read_tags(spark, path)) == ([], [])


def test_labels_of_both_formats(spark, tmp_path):
    csv, js = tmp_path / "labels.csv", tmp_path / "labels.json"
    csv.write_text("tag_id,name,category\n9,general,9\n8,oak,0\n7,bad,5\n6,,0\n5,ann,4\n")
    js.write_text(json.dumps({"total_tags": 3, "idx_to_tag": {"0": "oak", "2": "ann"}, "tag_to_category": {"ann": "character"}}))
    rows, rejected = kept(R.read_labels(spark, str(csv), "csv"))
    assert rows == [(0, "general", "rating"), (1, "oak", "general"), (4, "ann", "character")]
    assert [r[0] for r in rejected] == ["category code is unknown", "name is missing"]
    rows, rejected = kept(R.read_labels(spark, str(js), "json"))
    assert rows == [(0, "oak", "general"), (1, "unknown-1", "general"), (2, "ann", "character")] and not rejected
    with pytest.raises(ValueError, match="csv, json"):
        R.read_labels(spark, str(csv), "xml")


def test_rejected_rows_grow_with_the_file(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).otherwise("t").alias("name"), F.col("id").alias("post_count"))
    read = R.read_tags(spark, write_table(df, "t"))
    assert read.rows.count() == 900 and read.rejected.count() == 100
