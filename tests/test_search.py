"""Search internals: the term dictionary gives the same scores as counting over hits."""

from pyspark.sql import functions as F

from tagloom.plans import wiki as W


def _wiki(spark):
    rows = [(1, 5, "red_widget", "red widget ", "a red thing and a widget"),
            (2, 50, "blue_bolt", "blue bolt ", "bolt of blue the red"),
            (3, 1, "red_gear", "red gear ", "gear gear gear"),
            (4, 9, "empty", "empty ", "")]
    return spark.createDataFrame(rows, "id int, post_count int, title string, search_title string, search_text string")


def test_dictionary_equals_hit_counts(spark):
    w = _wiki(spark)
    p = W.build_search_index(w)
    d = W.term_dictionary(p)
    specs = {"t": W.BM25(W.TITLE, 0.0, 0.5, conjunctive=True), "x": W.BM25(W.TEXT, 1.2, 0.0)}
    a = {r.id: (r.t, r.x) for r in W.bm25_scores(w, p, ["red", "widget"], specs).collect()}
    b = {r.id: (r.t, r.x) for r in W.bm25_scores(w, p, ["red", "widget"], specs, dictionary=d).collect()}
    assert a == b and set(a) == {1, 2, 3}
    assert a[1][0] is not None and a[3][0] is None          # conjunctive: page 3 lacks "widget" in its title
    q = spark.createDataFrame([(1, "red widget"), (2, ""), (3, "gear")], "qid long, text string")
    x = sorted(tuple(r) for r in W.batch_query_wiki(w, p, q, 2).collect())
    y = sorted(tuple(r) for r in W.batch_query_wiki(w, p, q, 2, dictionary=d).collect())
    assert x == y
    assert [r[2] for r in sorted((r for r in x if r[0] == 2), key=lambda r: r[1])] == ["blue_bolt", "empty"]


def test_index_counts_a_page_at_a_time(spark):
    """Repeated and null ids are pages of their own, without words as rows."""
    rows = [(1, "red boat", "the red red boat"), (1, "Red", None), (None, "a", "blue"), (2, None, ""), (3, "x y", "y y z")]
    wiki = spark.createDataFrame(rows, "id int, search_title string, search_text string")
    postings = W.build_search_index(wiki)
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Generate" not in plan
    assert sorted(map(str, map(tuple, postings.collect()))) == sorted(map(str, [
        ("search_title", "red", 1, 2, 6), ("search_title", "boat", 1, 1, 6), ("search_text", "red", 1, 2, 6), ("search_text", "boat", 1, 1, 6),
        ("search_text", "blue", None, 1, 1), ("search_title", "x", 3, 1, 5), ("search_title", "y", 3, 1, 5),
        ("search_text", "y", 3, 2, 5), ("search_text", "z", 3, 1, 5)]))


def test_sorted_tables_are_cut_by_their_rows(spark, monkeypatch):
    from tagloom import session
    monkeypatch.setattr(session, "SORTED_ROWS", 50)
    table = session.materialize(spark.range(1000).selectExpr("id % 7 AS a", "id AS b"), "cut", sort_by=["a", "b"])
    sizes = [r["count"] for r in table.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 15 and max(sizes) < 150
