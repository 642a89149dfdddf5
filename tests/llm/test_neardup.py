import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import neardup as N

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, percent=85):
    """Per (id, text): set size and least id reachable over links between texts."""
    sets = {}
    for i, t in rows:
        if i is not None and (s := shingles(t)):
            sets.setdefault(s, []).append(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    by_size = sorted(range(len(keys)), key=lambda k: len(keys[k]))
    for x, a in enumerate(by_size):
        for b in by_size[x + 1:]:
            if 100 * len(keys[a]) < percent * len(keys[b]):
                break
            both = len(keys[a] & keys[b])
            if 100 * both >= percent * (len(keys[a]) + len(keys[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(keys):
        r = find(k)
        least[r] = min([least.get(r, min(sets[s])), *sets[s]])
    place = {s: least[find(k)] for k, s in enumerate(keys)}
    return sorted((str((i, len(shingles(t)), place.get(shingles(t), i) if i is not None else None)) for i, t in rows))


def corpus(seed, n=250, group=90):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    out = [" ".join(text(rnd.randint(1, 60))) for _ in range(n)]
    base = text(150)
    for _ in range(group):      # copies whose similarities lie on both sides of the threshold
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(" ".join(t))
    chain = text(120)
    for _ in range(12):         # a chain: neighbours are linked, its ends are not
        chain = [*chain[2:], *text(2)]
        out.append(" ".join(chain).upper())
    out += [out[3], out[3], out[-1].lower(), None, "", " \n ", "one", "ONE", "one two", "a b c d e", "A b  c d e"]
    rnd.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


def run(df, **more):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in N.near_duplicates(df, **more).collect())


@pytest.mark.parametrize("node_rows", [N.NODE_ROWS, 30, 8])
def test_against_brute_force(docs, node_rows):
    rows = corpus(node_rows)
    assert run(docs(rows), node_rows=node_rows) == brute(rows)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd) == brute(rows)
    assert all(r["kept"] for r in N.near_duplicates(odd).collect())


def test_same_id_with_other_texts(docs):
    got = run(docs([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of words"), (None, "a b c d e f")]))
    assert got == sorted(["(1, 2, 1)", "(2, 2, 1)", "(2, 1, 2)", "(None, 2, None)"])


def test_empty_table(docs):
    assert N.near_duplicates(docs([])).count() == 0


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    for common, other in ((92, 8), (91, 9)):      # 92 / 108 >= 0.85 > 91 / 109
        b = np.concatenate((a[:common], np.arange(1000, 1000 + other, dtype=np.uint64)))
        want = 100 * common >= 85 * (200 - common)
        assert N.links([a, b], 85)[0, 1] == want and N.links([a, b, a + 5000], 85)[0, 1] == want


def test_large_groups_stay_linear(docs):
    """Of a group that no level can split every member is met, and no step makes rows for all its pairs."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{base} end{k}") for k in range(300)]
    df = docs(rows)
    reps = N.signatures(df.select(F.col("doc_id").alias("doc"), "text"), "doc", "text")
    nodes = N.leaves(reps, node_rows=40)
    assert nodes.groupBy("node").count().agg(F.max("count")).first()[0] <= 80
    stars = N.candidate_stars(nodes, reps, N.PERCENT)
    assert stars.count() < 300 * N.TREES
    assert run(df, node_rows=40) == brute(rows)


@pytest.mark.parametrize("percent", [85, 80])
def test_large_groups_keep_threshold_pairs(spark, percent):
    """1,200 documents that no level splits into small nodes; of 600 pairs at the threshold each shares a node."""
    draw, j = np.random.default_rng(percent), percent / 100
    own = lambda: draw.integers(0, 1 << 32, (600, N.FUNCTIONS), dtype=np.uint32)
    base = draw.integers(0, 1 << 32, N.FUNCTIONS, dtype=np.uint32)
    one = np.where(draw.random((600, N.FUNCTIONS)) < 0.9, base, own())
    two = np.where(draw.random((600, N.FUNCTIONS)) < j, one, own())
    rows = [(2 * k + i, 100, x[k].tobytes()) for k in range(600) for i, x in enumerate((one, two))]
    reps = spark.createDataFrame(rows, "doc long, n_shingles long, least binary")
    more = {"percent": percent} if percent != N.PERCENT else {}
    nodes = N.leaves(reps, node_rows=20, **more).select("node", "doc", F.floor(F.col("doc") / 2).alias("pair"))
    met = nodes.groupBy("node", "pair").agg(F.countDistinct("doc").alias("n")).filter("n = 2")
    assert met.select("pair").distinct().count() == 600


def test_rows_of_a_near_copy_group_grow_with_its_size(docs, monkeypatch):
    """Four times the copies make no more than about four times the rows that sketches and full sets travel in."""
    made = []
    for name in ("candidate_stars", "linked_stars"):
        def counted(rows, *more, step=getattr(N, name), **named):
            made.append(rows.count())
            return step(rows, *more, **named)
        monkeypatch.setattr(N, name, counted)
    total = []
    for n in (150, 600):
        rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" end{k}") for k in range(n)]
        made.clear()
        assert run(docs(rows), node_rows=40) == brute(rows)
        total.append(sum(made))
    assert total[1] < 6 * total[0]


def test_large_candidate_groups_meet_in_pairs_of_blocks(docs, monkeypatch):
    """A group around the threshold, too large for one cell: full sets travel once for a block, not once for a tree."""
    cells = []
    confirm = N.linked_stars
    monkeypatch.setattr(N, "linked_stars", lambda rows, *more: (cells.append(rows.count()), confirm(rows, *more))[1])
    rows = corpus(11, n=20, group=200)
    assert run(docs(rows), node_rows=40) == brute(rows)
    assert cells[-1] < 15 * len(rows)


def test_components(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)} | {(k, k + 1) for k in range(400, 460)}
    edges |= {(500, k) for k in range(501, 700)}
    stars = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "doc long, root long").distinct()
    got = {r["doc"]: r["root"] for r in N.components(stars).collect()}
    label = {v: v for e in edges for v in e}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert got == {v: r for v, r in label.items() if v != r}


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(10,0)"])
def test_id_types(docs, kind):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x"), (None, "x")]
    df = docs(rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {str(r["doc_id"]): str(r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "None": "None"}
