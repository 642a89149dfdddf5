"""Helpers that the operators of this package share.

Texts travel to Python tasks as UTF-8 bytes: on bytes, ``split()`` cuts exactly at ``[\\x20\\x09-\\x0D]`` and
``lower()`` changes exactly A-Z, which is what the contracts of the operators ask for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize


BATCH_BYTES = 4 << 20      # of an Arrow batch between the JVM and Python


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to ``BATCH_BYTES``, unless the session has a limit of its own. Spark's default of 64 MB is held
    several times over by every task that runs Python: written, sent, read, and the same again for what comes back."""
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def blob(col: pa.Array) -> list[bytes]:
    """Bytes of each row; null gives empty bytes."""
    return [x or b"" for x in col.to_pylist()]


SLICE_ROWS = 1024      # rows that a task holds as Python objects at a time


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch, in slices; a batch holds a bounded number of rows and bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from fn(batch.slice(at, SLICE_ROWS))
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


_WORKER: dict = {}


def worker_state(operator: str, key, part: str, build: Callable):
    """What an operator keeps in a Python worker between tasks, ``part`` by ``part``, made by ``build`` when first asked for. The worker
    forgets it when another operator, or the same one with another ``key``, asks for its own."""
    if _WORKER.get("owner") != (operator, key):
        _WORKER.clear()
        _WORKER["owner"] = (operator, key)
    if part not in _WORKER:
        _WORKER[part] = build()
    return _WORKER[part]


def fold(col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo: true for held-out rows; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus)) == remainder,
                      F.lit(False))


_MULT = np.uint64(0x9E3779B97F4A7C55)      # odd, 5 modulo 8: its powers spread over the low bits too
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _MULT), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby values become unrelated ones."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def spans(data: np.ndarray, is_space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a buffer of bytes."""
    gap = np.concatenate((np.array([True]), is_space[data], np.array([True])))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order; equal words have equal hashes.

    A polynomial over the bytes, taken for all words at once from its prefix sums."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    start, end = spans(data)
    if not len(start):
        return np.empty(0, np.uint64)
    if len(data) > 1 << 20:                # keep the tables of powers small: long texts in pieces that end at words
        cut = int(start[np.searchsorted(start, 1 << 19)]) if start[-1] > 1 << 19 else 0
        if cut:
            return np.concatenate((word_hashes(text[:cut]), word_hashes(text[cut:])))
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words (none when there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _MULT + words[k:k + n]
        return mix(out)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later stages don't redo the work when executors are lost."""
    bound_batches(df.sparkSession)
    return materialize(df, f"llm-{name}")
