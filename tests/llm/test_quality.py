import random

import numpy as np

from tagloom.llm import quality as Q
from tagloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    from llm.sf import accuracy
    right, kept, passed = accuracy(spark, QUERIES["op1_quality"], "quality")
    assert right > 0.97 and kept > 0.98 and passed < 0.1


def test_isotonic():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        n = rnd.integers(1, 12)
        y, w = rnd.random(n), rnd.integers(1, 5, n).astype(float)
        at = np.sort(rnd.random(n))
        places, values = Q.isotonic(at, y, w)
        assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
        fitted = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]   # min-max formula
        assert np.allclose(sorted(set(np.round(fitted, 9))), sorted(set(np.round(values, 9))))


def test_features_approximate_the_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(Q, "DIMENSIONS", 20_000)
    x = np.random.default_rng(1).normal(size=(20, len(Q.STATISTICS)))
    z = Q.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_partition_sums_give_the_same_weights(spark):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(300, len(Q.STATISTICS))), rnd.integers(0, 2, 300)
    kernel = Q.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    df = spark.createDataFrame([(r.tolist(), int(v), k % 2) for k, (r, v) in enumerate(zip(x, y, strict=True))], "x array<double>, label int, half int")
    half = Q.normal_equations(df.repartition(7), kernel)
    z = kernel(x)
    assert np.allclose(half[0][0] + half[1][0], z.T @ z) and np.allclose(half[0][1] + half[1][1], z.T @ y)
    assert half[0][2] == half[1][2] == 150


def test_odd_rows_and_unlabelled(odd, docs):
    rows = Q.with_statistics(odd, "doc_id", "text")
    none = odd.sparkSession.createDataFrame([], "doc_id long, label int")
    got = Q.score(rows, Q.fit(rows, none)).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 8) for _ in range(40)) for _ in range(60)]
    df = docs([(k, t if k % 3 else t.replace(" ", "### ")) for k, t in enumerate(texts)])
    stats = Q.with_statistics(df, "doc_id", "text")
    marks = df.sparkSession.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in Q.score(stats, Q.fit(stats, marks)).collect()}
    assert min(got[k] for k in got if k % 3) > max(got[k] for k in got if k % 3 == 0)
    assert all(0 <= r["score"] <= 1 for r in Q.score(rows, Q.fit(stats, marks)).collect())
    assert Q.score(Q.with_statistics(docs([]), "doc_id", "text"), Q.fit(stats, marks)).count() == 0
