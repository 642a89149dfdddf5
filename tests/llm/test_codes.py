import hashlib

import numpy as np
import pytest

from tagloom.llm import codes


def brute(rows):
    """(vec_id, code, error, label_error), digest: plain Python integers, every entry against every part."""
    kept = [(i, [int(np.floor(float(c) * 256)) for c in v], m) for i, v, m in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted(((i, v) for i, v, _ in kept if i is not None and v), key=lambda r: r)
    if not named:
        return None
    dims = len(named[0][1])
    width = -(-dims // 16)
    cut = lambda v: [(v + [0] * (width * 16 - dims))[p * width:(p + 1) * width] for p in range(16)]     # noqa: E731
    books = [[cut(v)[p] for i, v in [r for r in named if len(r[1]) == dims][:64]] for p in range(16)]
    coded = [(i, cut(v), m) for i, v, m in kept if len(v) == dims]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))                               # noqa: E731
    near = lambda a, book: min((dist(a, e), k) for k, e in enumerate(book))                                # noqa: E731
    for _ in range(2):
        new = []
        for p in range(16):
            groups = {}
            for _, v, _ in coded:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, m in coded:
        found = [near(v[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), m))
    out += [(i, None, None, m) for i, v, m in kept if len(v) != dims]
    total = {}
    for _, _, e, m in out:
        if e is not None:
            total[m] = total.get(m, 0) + e
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((i, c, e, total.get(m)) for i, c, e, m in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def got(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, parts string")
    done, books = codes.compress(df)
    return sorted((tuple(r) for r in done.select("id", "code", "error", "label_error").collect()), key=str), codes.digest(books)


def vectors(n, dims, seed=1, scale=1.0):
    draw = np.random.default_rng(seed)
    return [(i * 3 % 1009, [float(np.float32(x)) for x in draw.normal(0, scale, dims) * (1 + i % 5)], int(draw.integers(0, 4)) or None)
            for i in range(n)]


@pytest.mark.parametrize("dims", [16, 32, 50])
def test_equals_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 8)
    monkeypatch.setattr(codes, "CHUNK_VALUES", dims * 90)
    rows = vectors(300, dims)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(40, 32) + [(None, [0.5] * 32, 1), (7, None, 1), (8, [None] * 32, 2), (9, [float("nan")] * 32, 2), (10, [float("inf")] + [0.0] * 31, 2),
                              (11, [], None), (2000, [0.1] * 16, 3), (2001, [-0.001] * 32, None), (2001, [-0.001] * 32, None)]
    assert got(spark, rows) == brute(rows)


def test_ties_and_fewer_vectors_than_entries(spark):
    rows = [(1, [0.0] * 16, 1), (2, [0.0] * 16, 1), (3, [2 / 256] * 16, 1), (4, [1 / 256] * 16, 1), (4, [1 / 256] * 16, 1)]
    assert got(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(i, [x * 1e6 for x in v], m) for i, v, m in vectors(70, 16)]
    assert got(spark, rows, "double") == brute(rows)


def test_empty_and_without_ids(spark):
    assert got(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert got(spark, [(None, [1.0] * 16, 2)])[0] == [(None, None, None, None)]


def test_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT_ROWS", 20)
    rows = [(i, v, 1 if i % 3 else i) for i, v, _ in vectors(90, 16)]
    assert got(spark, rows) == brute(rows)


def test_curve_is_a_curve():
    """Consecutive places on the curve are neighbours, and every point has its own place."""
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 2, indexing="ij"), -1).reshape(-1, 2)
    key = codes.hilbert(grid * 4369)        # 4369 * 15 = 2^16 - 1: the grid's cells on the curve
    path = grid[np.argsort(key)]
    assert len(np.unique(key)) == 256
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_the_nearest_entries():
    draw = np.random.default_rng(4)
    rows = draw.integers(-30, 30, (640, 3))
    book = draw.integers(-30, 30, (20, 3))
    order, at, low, high, sums = codes.blocks_of(rows, 16)
    wanted = codes.shortlists(low, high, book)
    dist = ((rows[order][:, None] - book) ** 2).sum(axis=2)
    for b, start in enumerate(at):
        assert (sums[b] == rows[order][start:start + 16].sum(axis=0)).all()
        ties = dist[start:start + 16] == dist[start:start + 16].min(axis=1, keepdims=True)
        assert wanted[b][ties.any(axis=0)].all()
    assert wanted.mean() < 0.9
