"""Every registered query against its DuckDB twin (row count, column names, values) on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tagloom.plans import registry  # noqa: E402
from tools.oracle_check import rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

registry.load_all()
QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)


def test_every_query_registered_has_callable():
    assert len(QUERIES) >= 80
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "tag", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    cur = duck.execute(ORACLES[name])
    ocols = [c[0] for c in cur.description]
    orows = cur.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert rows_of(scols, srows) == rows_of(ocols, orows)


def test_stem_terms_covers_the_dictionary(spark):
    rows = {r.term: r.stem for r in QUERIES["stem_terms"](spark, SF_SMALL).collect()}
    terms = {r.term for r in QUERIES["build_search_index"](spark, SF_SMALL).select("term").distinct().collect()}
    assert rows.keys() == terms and all(s and len(s) <= len(t) + 1 for t, s in rows.items())
    assert any(s != t for t, s in rows.items())


def test_stemmed_search_finds_what_plain_search_finds(spark):
    plain = {r.title for r in QUERIES["query_wiki"](spark, SF_SMALL).collect()}        # "red widget"
    stemmed = {r.title for r in QUERIES["query_wiki_stemmed"](spark, SF_SMALL).collect()}      # "red widgets"
    assert plain and plain == stemmed


def test_every_other_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"stem_terms", "query_wiki_stemmed"}


def test_entry_without_the_training_data_package(monkeypatch):
    import sys

    import __spark_entry__ as entry
    monkeypatch.setitem(sys.modules, "tagloom.llm", None)
    monkeypatch.delitem(sys.modules, "tagloom.llm.queries", raising=False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
