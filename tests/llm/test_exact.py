import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import exact


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        named = [j for j in same if j is not None]
        keep = max(named) if named else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 4)


def test_odd_rows(odd):
    from tests.llm.conftest import ODD
    assert got(exact.deduplicate(odd)) == brute(ODD)


ROWS = [(i * 7 % 211, f"text {i % 37}" if i % 3 else f"own {i}") for i in range(300)] + [(None, "text 1"), (None, "nameless"), (None, "nameless")]


def test_equals_brute_force(docs, small):
    assert got(exact.deduplicate(docs(ROWS))) == brute(ROWS)


@pytest.mark.parametrize("cut", [lambda d: d >= 0, lambda d: d < 0, lambda d: d < 90])
def test_any_first_delivery(docs, spark, small, cut):
    from pyspark.sql import functions as F
    assert got(exact.deduplicate(docs(ROWS), earlier=cut(F.col("doc")))) == brute(ROWS)


def test_large_groups_and_large_shards(docs, small, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 50)
    monkeypatch.setattr(exact, "TASK_ROWS", 20)
    rows = [(i, "common") for i in range(200)] + [(1000 + i, f"t{i % 30}") for i in range(400)]
    assert got(exact.deduplicate(docs(rows))) == brute(rows)


def test_history_of_a_former_run(docs):
    first, second = ROWS[:150], ROWS[150:]
    known = exact.History.of(exact.digests(docs(first)), 150)
    df = exact.deduplicate(docs(second), history=known)
    whole = {(r[0], r[4]): r for r in brute(ROWS)}
    rows = got(df)
    assert len(rows) == len(second) and all(r == whole[r[0], r[4]] for r in rows)


def test_string_ids_and_empty(spark, docs):
    df = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), (None, "x", 3)], "doc_id string, text string, digest int")
    assert [(r[0], r[1], r[2], r[3]) for r in got(exact.deduplicate(df))] == [("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False)]
    assert got(exact.deduplicate(docs([]))) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    ph = exact.PerfectHash.unpack(exact.PerfectHash.build(keys).pack())
    assert sorted(ph.slot(keys).tolist()) == list(range(n))          # minimal and perfect
    other = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)), np.uint8).reshape(-1, 32)
    shard = exact.Shard.build(keys, pa.array(range(n), pa.int64()), np.ones(n, np.int64))
    assert (shard.find(other) == -1).all() and (shard.find(keys) >= 0).all()
    assert [shard.winners[int(s)].as_py() for s in shard.find(keys)] == list(range(n))


def test_a_slot_with_other_bytes_is_no_member():
    """Digests that meet in every hash word but differ in the bytes: only the slot's bytes tell them apart."""
    a = np.arange(32, dtype=np.uint8).reshape(1, 32)
    b = a.copy()
    b[0, 0] ^= 1                    # the first word isn't hashed
    shard = exact.Shard.build(a, pa.array([5], pa.int64()), np.array([1]))
    assert shard.levels.slot(b).tolist() == [0] and shard.find(b).tolist() == [-1]
    more = shard.merge(np.array([[9] * 32], np.uint8), pa.array([8], pa.int64()), np.array([2]))
    assert len(more.digests) == 2 and sorted(more.winners.to_pylist()) == [5, 8]
