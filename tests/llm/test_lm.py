import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import lm
from tagloom.llm.common import kept_table, utf8
from tagloom.llm.queries import QUERIES


class Small:
    """A vocabulary of 300 head units and three classes."""
    head, units = 300, 303
    mass = np.concatenate((np.linspace(90, 1, 300), [50, 20, 5.5]))


def weights(seed=0):
    w, draw = lm.first_weights(Small), np.random.default_rng(seed)
    return {k: (v + draw.normal(0, 0.3, v.shape) * (v > -20)).astype(np.float32) for k, v in w.items()}


def test_units_are_a_distribution():
    w = weights()
    h = np.random.default_rng(1).normal(0, 1, (5, lm.STATE)).astype(np.float32)
    p = np.exp(np.stack([lm.log_probability(h, np.full(5, u), w, Small.head) for u in range(Small.units)]))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)
    big = {**w, "class": w["class"] * 400}
    assert np.isfinite(lm.log_probability(h, np.zeros(5, int), big, Small.head)).all()


def plain_score(ids, w):
    h, total = np.zeros((1, lm.STATE), np.float32), 0.0
    for u in ids:
        total += float(lm.log_probability(h, np.array([u]), w, Small.head)[0])
        h, _ = lm.step(h, w["vector"][[u]] @ w["inward"] + w["bias"], w["again"])
    return total


def test_batched_scores_equal_one_by_one():
    w, draw = weights(), np.random.default_rng(2)
    texts = [draw.integers(0, Small.units, n).astype(np.int32) for n in (1, 1, 3, 700, 40, 65, 2)]
    assert np.allclose(lm.score_units(texts, w, Small.head), [plain_score(t, w) for t in texts], rtol=1e-4)


def test_first_gradients_equal_differences(monkeypatch):
    """One window of training moves every weight against the difference quotient of the loss."""
    monkeypatch.setattr(lm, "WINDOW", 8)
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, Small.units, 8).astype(np.int32) for _ in range(3)]
    w = {k: v.astype(np.float64) for k, v in weights(5).items()}
    moved = {k: v.astype(np.float32) for k, v in w.items()}
    lm.train(moved, texts, Small.head, rate=1e-3)

    def loss(x):
        return -sum(plain_score(t, x) for t in texts) / len(texts)
    for name in ("again", "inward", "bias", "class", "class_bias"):
        change = moved[name] - w[name]
        for at in [np.unravel_index(i, change.shape) for i in np.argsort(-np.abs(change).ravel())[:3]]:
            up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            slope = (loss(up) - loss(down)) / 2e-2
            g = slope if abs(slope) > 1e-3 else 0
            assert np.sign(change[at]) == -np.sign(g)
            assert abs(change[at]) == pytest.approx(1e-3 * abs(slope) / math.sqrt(0.1 + slope ** 2), rel=0.1)


def test_training_lowers_the_loss():
    draw, w = np.random.default_rng(4), lm.first_weights(Small)
    texts = [np.tile([5, 9, 2, 7], int(n)).astype(np.int32) for n in draw.integers(3, 30, 200)]
    before = lm.score_units(texts, w, Small.head).sum()
    assert lm.train(w, texts, Small.head) == sum(map(len, texts))
    assert lm.score_units(texts, w, Small.head).sum() > 0.5 * before


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \r\n", "\v", "\f"])
def test_every_token_is_learned(docs, blank):
    """Long texts, whatever separates their words, and all others: the written ids are those of all their tokens."""
    rows = [(1, blank.join(f"w{k % 700}" for k in range(9000))), (2, "a"), (3, ""), (4, None), (5, blank * 3 + "a" + blank)]
    texts = docs(rows).select(utf8("text").alias("text"))
    v = lm.Vocabulary(kept_table(lm.token_counts(texts), "token-counts"))
    index = v.index()
    shared = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, v))
    got = sorted(np.frombuffer(r["ids"], np.int32).tolist() for r in lm.stretches(texts, shared).collect())
    assert got == sorted([int(v.unit[index[x]]) for x in (t or "").encode().split()] + [0] for _, t in rows)


def test_gradients_of_words_and_vectors_equal_differences(monkeypatch):
    """The arrays that change by class or by unit, against the difference quotient of the loss."""
    monkeypatch.setattr(lm, "WINDOW", 8)
    draw = np.random.default_rng(7)
    texts = [draw.integers(0, Small.units, 8).astype(np.int32) for _ in range(3)]
    w = {k: v.astype(np.float64) for k, v in weights(8).items()}
    moved = {k: v.astype(np.float32) for k, v in w.items()}
    lm.train(moved, texts, Small.head, rate=1e-3)

    def loss(x):
        return -sum(plain_score(t, x) for t in texts) / len(texts)
    for name in ("word", "word_bias", "vector"):
        change = moved[name] - w[name]
        for at in [np.unravel_index(i, change.shape) for i in np.argsort(-np.abs(change).ravel())[:3]]:
            up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            slope = (loss(up) - loss(down)) / 2e-2
            assert change[at] == pytest.approx(-1e-3 * slope / math.sqrt(0.1 + slope ** 2), rel=0.1)


def test_passes_of_a_window_do_not_grow_with_the_classes(monkeypatch):
    """Softmax and updates run over all classes of a window at once: as many calls for 3 classes as for 24."""
    def calls(head):
        class Wide:
            units, mass = head + 3, np.concatenate((np.linspace(90, 1, head), [50, 20, 5.5]))
        Wide.head = head
        seen = Counter()

        class Counting:
            def __getattr__(self, name):
                if name in ("exp", "sqrt"):
                    seen[name] += 1
                return getattr(np, name)
        w = lm.first_weights(Wide)
        texts = [np.random.default_rng(9).permutation(head)[:lm.WINDOW * 8].astype(np.int32)] * 16
        with monkeypatch.context() as m:
            m.setattr(lm, "np", Counting())
            lm.train(w, texts, head)
        return seen
    assert calls(300) == calls(3000)


def test_long_gradients_are_shortened_item_by_item():
    draw = np.random.default_rng(10)
    gradient = draw.normal(0, 1, (4, lm.STATE + 1, 16)).astype(np.float32) * np.array([0.01, 1, 3, 0], np.float32)[:, None, None]
    gradient[2, -1] *= 5
    w, square = np.zeros_like(gradient), np.full_like(gradient, 0.1)
    want = np.zeros_like(w)
    for g in range(4):
        for part in (slice(0, -1), slice(-1, None)):
            x = gradient[g, part].astype(float)
            x = x * min(1, 5 / max(np.sqrt((x * x).sum()), 1e-9))
            want[g, part] = -0.1 * x / np.sqrt(0.1 + x * x)
    lm._descend(w, square, gradient.copy(), 0.1, split=True)
    assert np.allclose(w, want, atol=1e-5)


def test_lanes_hold_every_token_once():
    draw = np.random.default_rng(6)
    for sizes in ([], [0], [5], [40_000], [1] * 300, [0, 3, 0, 70_000, 2, 9, 1], draw.integers(0, 900, 500)):
        texts = [draw.integers(0, Small.units, n).astype(np.int32) for n in sizes]
        ids, fresh, live = lm.lay(texts)
        assert (ids[live] == np.concatenate([*texts, np.empty(0, np.int32)])).all() and live.sum() == sum(sizes)
        assert live.size - live.sum() < max(1, len(live)) and fresh.sum() <= len(texts) + len(live)
        begins = np.cumsum([0, *sizes])[:-1][np.array(sizes, int) > 0]
        assert fresh.ravel()[begins].all()


def brute_base(rows):
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        out.append((i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    return n, sorted(out, key=str)


def score(df):
    texts = df.filter(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)).select(utf8("text").alias("text"))
    counts = kept_table(lm.token_counts(texts), "token-counts")
    v = lm.Vocabulary(counts)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, v))
    return v, lm.score(df, counts, v, lm.fit(lm.stretches(texts, shared), v))


@pytest.mark.parametrize("dictionary", [lm.DICTIONARY, 3])
def test_base_and_counts(odd, docs, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    df = odd.unionByName(docs([(k, "The cat sat. the Cat ran " * (k % 7) + f"word{k % 11} rare{k}") for k in range(10, 60)]))
    n, want = brute_base([(r["doc_id"], r["text"]) for r in df.collect()])
    v, done = score(df)
    got = done.collect()
    assert v.n == n and sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got), key=str) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_words_share_out_their_class(docs):
    """The model's probabilities of all known words and the unseen type sum to one."""
    df = docs([(k, " ".join(f"w{j}" for j in range(k))) for k in range(2, 40)])
    counts = kept_table(lm.token_counts(df.select(utf8("text").alias("text"))), "token-counts")
    v = lm.Vocabulary(counts)
    w = lm.first_weights(v)
    h = np.zeros((1, lm.STATE), np.float32)
    p = {u: math.exp(lm.log_probability(h, np.array([u]), w, v.head)[0]) for u in range(v.units)}
    known = p[0] + sum(p[int(u)] * 10 ** x for u, x in zip(v.unit[:-1], v.within[:-1], strict=True))
    rest = counts.filter((F.col("c") < v.least) & (F.length("token") > 0)).collect()
    tail = p[v.units - 1] * (sum(r["c"] + 0.5 for r in rest) + 0.5) / v.rest_mass
    assert known + tail == pytest.approx(1, abs=1e-3)


def test_empty_tables(docs):
    v, done = score(docs([]))
    assert v.n == 0 and done.count() == 0


def test_better_than_base_on_held_out_texts(spark):
    rows = QUERIES["op2_lm"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (rows[0] - rows[1]) / rows[2] > 0.08
