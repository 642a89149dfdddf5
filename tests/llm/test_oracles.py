"""Registered queries against their SQL on the smallest tables."""

import pytest

from tagloom.llm.queries import ORACLES, QUERIES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, rows) == rows_of(names, cur.fetchall()) and rows


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_results_have_a_row_for_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_quality", "op2_lm", "op3_rules", "op7_toxicity"):
        df = QUERIES[name](spark, SF)
        assert df.count() == n and df.select("doc_id").distinct().count() == n
