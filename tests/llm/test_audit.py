import random
from itertools import permutations

import numpy as np
import pytest

from tagloom.llm import audit


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fails(text):
    words = text.split()
    return "".join(f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                                    ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)), ("D", any(c in "#$%&*|" for c in text))) if bad)


def brute(rows, marks):
    """Every order applied from left to right to every document."""
    docs = []
    for i, text, part in rows:
        text = (text or "").encode().decode()
        repeat = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        mine = [m for m in marks if i is not None and m[0] == i]
        docs.append((part or "", fails(text) + ("E" if repeat else ""), any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    out, sums = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == f for d in failing),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, docs, marks):
    df = audit.interactions(audit.cells(docs, marks))
    rows = df.collect()
    assert len(rows) == len({(r[0], r[1], r[2]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}


def test_equals_every_order_applied(spark, docs):
    draw = random.Random(3)
    texts = [None, "", "  ", "A", "a|b", "Word " * 210, " ".join(map(str, range(300))), " ".join(f"w{i}" for i in range(250)) + " #",
             " ".join(f"W{i}" for i in range(250)), "é " * 500, "tab\tand\nline\x0b\x0c\r" * 90]
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["x", "y", "", None])) for _ in range(150)]
    marks = [(draw.choice([None, *range(70)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    assert got(spark, docs(rows), labels(spark, marks)) == brute(rows, marks)


def test_odd_rows(spark, odd):
    from tests.llm.conftest import ODD
    rows = [(i, t, "s") for i, t in ODD]
    marks = [(4, 1, 1), (None, 1, 1)]
    assert got(spark, odd, labels(spark, marks)) == brute([(i, None if t is None else t, p) for i, t, p in rows], marks)


def test_empty(spark, docs):
    assert not got(spark, docs([]), labels(spark, [(1, 1, 1)]))
    only = got(spark, docs([(1, "#", None)]), labels(spark, []))
    assert set(k[0] for k in only) == {""} and len(only) == 600


@pytest.mark.parametrize("k", [1, 3, 5])
def test_walk_equals_counting(k):
    draw = np.random.default_rng(k)
    counts = draw.integers(0, 9, (4, 1 << k, 3))
    states = audit.survivors(counts, k)
    for s in range(1 << k):
        left = [m for m in range(1 << k) if not m & s]
        assert (states[s] == counts[:, left].sum(axis=1)).all()


@pytest.mark.parametrize("size", [1, 5, 64])
def test_pieces_keep_words_whole(size):
    text = ("ab  cde\n" * 20 + "x" * 100 + " y").encode()
    parts = list(audit.pieces(text, size))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    assert list(audit.pieces(b"", size)) == [b""]


def test_other_columns_and_id_types(spark):
    rows = [("b", "#", 3, 4, "n"), ("a", "#", 3, 4, "n"), ("c", "x", None, 4, "n")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source int, mask int, digest string")
    marks = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    out = got(spark, df, marks)
    assert {k[0] for k in out} == {"", "3"}
    assert out["3", "EABCD", 1] == (1, 1, 0, 0, 1, 0, 120 // 3)     # fails A, D, E: first of the three in a third of the orders
