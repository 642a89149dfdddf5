"""Filter interaction audit: what each of several filters removes, at each place of every order of them.

A document is a mask of the filters that it fails; documents are counted by part and mask, so a part is at most 2^k cells.
A Gray-code walk visits every subset of active filters by toggling one filter at a time: each cell keeps the number of active
filters that it fails, and the running survivors lose a cell when its counter leaves zero and regain it when it returns.
The survivors of all subsets (32 states for five filters) are stored; what a filter removes after others, its redundancy,
unique failures, lost good and toxic documents and Shapley sums are differences of states.

Null and empty texts have no words. A null part is the empty string. A row with a null id has no labels, is never a repeat, and makes
none; a repeated row is no repeat of itself (its id isn't smaller). An id with several label rows counts as good or toxic
if one of them says so. An empty table has no parts and no rows. Other columns are ignored, whatever their names. Long texts
are read in pieces that end at words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import kept_table, map_batches, utf8

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
PIECE_BYTES = 4 << 20
PARTS_AT_ONCE = 64          # whose rows a task makes at a time

_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut where words end."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at:gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def failed_filters(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: under 200 words; fewer distinct words than half; more than 2 % capital
    letters; one of the symbols."""
    n, distinct = 0, set()
    for piece in pieces(text):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    return ((n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2
            | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc, part, failed, digest`` of every row: the bits of A to D, and the text's SHA-256 digest for E."""
    def run(batch: pa.RecordBatch):
        failed = [failed_filters(t or b"") for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(failed, pa.int32())],
                                         ["doc", "part", "digest", "failed"])

    text = F.coalesce(utf8(text_col), F.lit(b""))
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(src, run, f"doc {kind}, part string, digest binary, failed int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and by the set of filters that they fail, E included.

    Rows are combined by (id, part, text) first, so neither copies nor a part can weigh on one task; the least id of every
    text meets them on (text, id)."""
    rows = kept_table(masks(docs, id_col, text_col, part_col), "audit-masks")
    same = rows.groupBy("doc", "part", "digest", "failed").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter("doc is not null").groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    known = same.filter("doc is not null").join(first, ["digest", "doc"], "left")
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")))
    repeat = F.lit(1 << len(FILTERS) - 1)
    known = known.join(marks, "doc", "left").select(
        "part", (F.col("failed") + F.when(F.col("first").isNull(), repeat).otherwise(0)).alias("mask"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    nameless = same.filter("doc is null").select("part", F.col("failed").alias("mask"), "n", F.lit(0).alias("good"),
                                                 F.lit(0).alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])


def survivors(counts: np.ndarray, k: int) -> np.ndarray:
    """States ``(2^k, parts, measures)``: what is left when a subset of the filters is active, from ``counts`` of shape
    ``(parts, 2^k, measures)``. Successive subsets differ by one filter."""
    mask = np.arange(1 << k)
    failing = np.zeros(1 << k, np.int64)            # active filters that each cell fails
    left = counts.sum(axis=1)
    states = np.empty((1 << k, *left.shape), np.int64)
    states[0] = left
    for i in range(1, 1 << k):
        subset, bit = i ^ i >> 1, i & -i            # the Gray code's i-th subset, and the filter that is toggled
        hit = mask & bit != 0
        if subset & bit:
            left = left - counts[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            left = left + counts[:, hit & (failing == 0)].sum(axis=1)
        states[subset] = left
    return states


def steps(states: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """Arrays ``(parts, orders, steps)``: the differences of states for every order of the filters."""
    k, full = len(filters), len(states) - 1
    order = np.array(list(permutations(range(k))))
    bit = 1 << order
    after = np.bitwise_or.accumulate(bit, axis=1)
    before = after ^ bit
    n, good, toxic = (states[:, :, m].T for m in range(3))         # (parts, subsets)
    fails = n[:, [0]] - n[:, 1 << np.arange(k)]
    alone = n[:, full ^ 1 << np.arange(k)] - n[:, [full]]
    share = np.zeros_like(fails)
    for f in range(k):
        for s in range(full + 1):
            if not s >> f & 1:
                size = s.bit_count()
                share[:, f] += factorial(size) * factorial(k - 1 - size) * (n[:, s] - n[:, s | 1 << f])
    removed = n[:, before] - n[:, after]
    return {"kept": n[:, after], "removed": removed, "redundant": fails[:, order] - removed, "unique_fails": alone[:, order],
            "good_lost": good[:, before] - good[:, after], "toxic_lost": toxic[:, before] - toxic[:, after], "shapley": share[:, order]}


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """From ``part, mask, n, good, toxic``: one row per part, order of the filters and step, with the counts of :func:`steps`.
    A part is one row of at most 2^k cells when it is walked."""
    k = len(filters)
    names = ["".join(p) for p in permutations(filters)]

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, PARTS_AT_ONCE):
            rows = batch.slice(at, PARTS_AT_ONCE).to_pylist()
            counts = np.zeros((len(rows), 1 << k, len(MEASURES)), np.int64)
            for i, row in enumerate(rows):
                for c in row["cells"]:
                    counts[i, c["mask"]] = [c[m] for m in MEASURES]
            done = steps(survivors(counts, k), filters)
            each = len(names) * k
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"] for r in rows for _ in range(each)], pa.string()),
                 pa.array([n for n in names for _ in range(k)] * len(rows), pa.string()),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names) * len(rows))),
                 *[pa.array(a.ravel().astype(np.int64)) for a in done.values()]],
                ["part", "filter_order", "step", *done])

    folded = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return map_batches(folded, run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                    "unique_fails long, good_lost long, toxic_lost long, shapley long")
