"""SQL function surface and cache-aware scoring."""

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions.sql import register_functions
from tagloom.functions.text import escape_brackets, normalise_text, replace_underscores, split_tags
from tagloom.operators.markup import plain_text
from tagloom.operators.scoring import score_files


def test_sql_functions_match_columns(spark):
    names = register_functions(spark)
    assert "jaro_winkler_similarity" in names
    rows = [("Hello_World (x)",), ("^_^",), (" a, ,b ",), ('h2. T [[x|y]] "a":/b',)]
    df = spark.createDataFrame(rows, "s string")
    df.createOrReplaceTempView("fn_input")
    got = spark.sql("""SELECT s, normalise_text(s) AS n, replace_underscores(s) AS r, escape_brackets(s) AS e,
                              split_tags(s) AS t, plain_text(s) AS p, jaro_winkler_similarity(s, 'hello') AS j
                       FROM fn_input""").collect()
    want = df.select("s", normalise_text(F.col("s")).alias("n"), replace_underscores(F.col("s")).alias("r"),
                     escape_brackets(F.col("s")).alias("e"), split_tags(F.col("s")).alias("t"),
                     plain_text(F.col("s")).alias("p")).collect()
    for g, w in zip(sorted(got), sorted(want)):
        assert (g.n, g.r, g.e, list(g.t), g.p) == (w.n, w.r, w.e, list(w.t), w.p)
        assert 0.0 <= g.j <= 1.0


def test_score_files_uses_cache(spark):
    files = spark.createDataFrame([(1, "h1", b"aa"), (2, "h2", b"bbb"), (3, "h2", b"bbb"), (4, "h3", b"c")],
                                  "file_id long, hash string, content binary")
    cache = spark.createDataFrame([("h1", "m", [0.5, 0.5]), ("h3", "other", [0.0, 0.0])],
                                  "hash string, repo_name string, scores array<float>")

    def make_model():
        return lambda contents: np.array([[len(c) / 10.0, 1.0] for c in contents])

    scored, new_rows = score_files(files, cache, "m", make_model)
    got = {r.file_id: [round(x, 4) for x in r.scores] for r in scored.collect()}
    assert got == {1: [0.5, 0.5], 2: [0.3, 1.0], 3: [0.3, 1.0], 4: [0.1, 1.0]}
    assert sorted(r.hash for r in new_rows.collect()) == ["h2", "h3"]   # h2 scored once
