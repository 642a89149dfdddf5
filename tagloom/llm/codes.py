"""Vector codes by product quantisation, learned in exact integers over Hilbert-sorted blocks.

A component x is the integer floor(256 x); a vector is cut into ``PARTS`` equal consecutive parts, each with a codebook
that starts as that part of the ``ENTRIES`` smallest ids. A task sorts each part of its vectors along a Hilbert curve and cuts
it into flat blocks that store the box of their minima and maxima and their sums; this table is written once. In each round,
the distances between a block's box and the entries leave a shortlist: entries whose least possible distance isn't above the
least of all greatest possible ones. A block with one entry left adds its stored sums; the others evaluate the exact
integer distances to their shortlist. Only entries' sums and counts leave the tasks, a number that the parameters bound.

Rows whose vector is null, or holds null or non-finite components, are dropped. A dimension that isn't a multiple of ``PARTS`` is
filled up with zeros. The dimension is that of the vector with the smallest id (of equal ids: the first in the order of vectors); vectors of
another one stay, with a null code and a null error, and no part in codebooks or sums. Rows with a null id are coded but
never seed; without any id there are no codebooks and no codes. Repeated rows each count. Fewer ids than entries give
fewer entries; an empty table has no rows. Components of 2^24 and more are computed with Python's integers; an error that exceeds a long is refused.
Other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches, kept_table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
BLOCK = 128                     # vectors of a flat block
CHUNK_VALUES = 1 << 21          # components that a task sorts at a time
HILBERT_DIMS = 16               # components of a part that its curve follows, those with the greatest range
MOST_HOT, HOT_ROWS = 10_000, 1_000      # labels whose totals are broadcast, at most; each has more rows than that
SMALL = 1 << 24                 # components below it (and their distances) fit 64-bit arithmetic


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) exactly; Python integers where some are large."""
    x = np.floor(values.astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= SMALL:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(np.int64)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Each row's place on a Hilbert curve through the box of all rows."""
    n, d = points.shape
    if not n or not d:
        return np.zeros(n, np.uint64)
    low = points.min(axis=0)
    width = (points.max(axis=0) - low).astype(np.float64)
    if d > HILBERT_DIMS:
        dims = np.sort(np.argsort(-width, kind="stable")[:HILBERT_DIMS])
        points, low, width, d = points[:, dims], low[dims], width[dims], HILBERT_DIMS
    bits = min(16, 63 // d)
    top = (1 << bits) - 1
    x = ((points - low).astype(np.float64) * (top / np.maximum(width, 1))).astype(np.uint64).T.copy()
    q = np.uint64(1 << bits - 1)
    while q > 1:                        # undo the excess work of the curve's turns, from the highest bit on
        p = q - np.uint64(1)
        for i in range(d):
            turned = x[i] & q != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, d):               # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.uint64)
    q = np.uint64(1 << bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | x[i] >> np.uint64(b) & np.uint64(1)
    return key


def blocks_of(part: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One part of a chunk's vectors: their order along the curve, the first row of each block, minima, maxima, sums."""
    order = np.argsort(hilbert(part), kind="stable")
    at = np.arange(0, len(part), size)
    rows = part[order]
    return (order, at, np.minimum.reduceat(rows, at, axis=0), np.maximum.reduceat(rows, at, axis=0), np.add.reduceat(rows, at, axis=0))


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether some point of the block's box can be nearest to the entry (or as near as its nearest)."""
    near = far = 0
    for c in range(book.shape[1]):      # component by component: (blocks, entries) at a time
        below, above = low[:, [c]] - book[:, c], book[:, c] - high[:, [c]]
        gap = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(-below, -above)
        near = near + gap * gap
        far = far + reach * reach
    return near <= far.min(axis=1, keepdims=True)


def nearest(rows: np.ndarray, book: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lower of equals) and squared distance of each row's nearest entry among the ``wanted`` ones."""
    gap = 0
    for c in range(book.shape[1]):
        diff = rows[:, [c]] - book[wanted, c]
        gap = gap + diff * diff
    at = gap.argmin(axis=1)
    return wanted[at], gap[np.arange(len(rows)), at]


def assign(rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and distance of every (sorted) row, block by block."""
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), rows.dtype)
    for b, listed in enumerate(shortlists(low, high, book)):
        here = slice(at[b], at[b + 1] if b + 1 < len(at) else len(rows))
        index[here], error[here] = nearest(rows[here], book, np.flatnonzero(listed))
    return index, error


def entry_sums(rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, book: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the rows that are nearest to each entry; blocks with one entry left give their stored sums."""
    total, count = np.zeros(book.shape, rows.dtype), np.zeros(len(book), np.int64)
    for b, listed in enumerate(shortlists(low, high, book)):
        here = slice(at[b], at[b + 1] if b + 1 < len(at) else len(rows))
        wanted = np.flatnonzero(listed)
        if len(wanted) == 1:
            total[wanted[0]] += sums[b]
            count[wanted[0]] += here.stop - here.start
        else:
            index, _ = nearest(rows[here], book, wanted)
            np.add.at(total, index, rows[here])
            np.add.at(count, index, 1)
    return total, count


def pack(a: np.ndarray) -> bytes:
    """Integers of any size as bytes."""
    if a.dtype == object:
        return b"s" + ",".join(str(v) for v in a.ravel()).encode()
    small = not len(a.ravel()) or np.abs(a).max() < 1 << 31
    return (b"i" + a.astype(np.int32).tobytes()) if small else b"l" + a.astype(np.int64).tobytes()


def unpack(data: bytes, dims: int) -> np.ndarray:
    if data[:1] == b"s":
        flat = np.array([int(v) for v in data[1:].split(b",")], object)
    else:
        flat = np.frombuffer(data, np.int32 if data[:1] == b"i" else np.int64, offset=1).astype(np.int64)
    return flat.reshape(-1, dims)


CHUNK_SCHEMA = "ids array<{id}>, labels array<{label}>, coded boolean, parts array<struct<ord:binary,rows:binary,low:binary,high:binary,sums:binary>>"


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
            .filter(v.isNotNull() & finite))


def seeds(kept: DataFrame) -> tuple[int, np.ndarray]:
    """The vectors' dimension, and the integers of the smallest ids' vectors: at most ``ENTRIES`` rows."""
    named = kept.filter("id is not null and size(vector) > 0").select("id", "vector")
    first = named.orderBy("id", "vector").limit(1).collect()
    if not first:
        return 0, np.empty((0, 0), np.int64)
    dims = len(first[0]["vector"])
    rows = named.filter(F.size("vector") == dims).orderBy("id", "vector").limit(ENTRIES).collect()
    return dims, integers(np.array([r["vector"] for r in rows], np.float64))


def split(x: np.ndarray) -> np.ndarray:
    """(rows, dimension) to (rows, PARTS, components of a part), filled up with zeros."""
    fill = -x.shape[1] % PARTS
    if fill:
        x = np.concatenate((x, np.zeros((len(x), fill), x.dtype)), axis=1)
    return x.reshape(len(x), PARTS, -1)


def chunks(kept: DataFrame, dims: int) -> DataFrame:
    """The flat blocks: one row per chunk of vectors, with each part's order, sorted integers, boxes and sums. Vectors of another
    dimension lie in chunks of their own, which are not coded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, held = [], [], [], 0
        schema = None

        def flush():
            x = split(integers(np.concatenate(values).reshape(-1, dims)))
            parts = []
            for p in range(PARTS):
                order, at, low, high, sums = blocks_of(x[:, p])
                parts.append({"ord": order.astype(np.int32).tobytes(), "rows": pack(x[order, p]), "low": pack(low), "high": pack(high),
                              "sums": pack(sums)})
            return row(pa.concat_arrays(ids), pa.concat_arrays(labels), True, parts)

        def row(i, m, coded, parts):
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            blob = pa.struct([(n, pa.binary()) for n in ("ord", "rows", "low", "high", "sums")])
            return pa.RecordBatch.from_arrays([one(i), one(m), pa.array([coded]), pa.array([parts], pa.list_(blob))],
                                              ["ids", "labels", "coded", "parts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            vector = batch.column(2)
            fits = np.diff(vector.offsets.to_numpy()) == dims if dims else np.zeros(batch.num_rows, bool)
            if not fits.all():
                other = batch.filter(pa.array(~fits))
                yield row(other.column(0), other.column(1), False, [])
                batch = batch.filter(pa.array(fits))
                if not batch.num_rows:
                    continue
            ids.append(batch.column(0))
            labels.append(batch.column(1))
            values.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            held += len(values[-1])
            if held >= CHUNK_VALUES:
                yield flush()
                ids, labels, values, held = [], [], [], 0
        if ids:
            yield flush()

    bound_batches(kept.sparkSession)
    names = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    return kept_table(kept.select("id", "label", "vector").mapInArrow(run, CHUNK_SCHEMA.format(**names)), "vector-blocks")


def _loaded(row: dict, p: int, width: int):
    part = row["parts"][p]
    rows = unpack(part["rows"], width)
    return rows, np.arange(0, len(rows), BLOCK), unpack(part["low"], width), unpack(part["high"], width), unpack(part["sums"], width)


def learn(table: DataFrame, first: np.ndarray) -> np.ndarray:
    """The codebooks ``(PARTS, entries, width)`` after all rounds. A task reports its sums once, for all its chunks."""
    books = split(first).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(ROUNDS):
        def run(batches, books=books):
            totals, counts = [0] * PARTS, [0] * PARTS
            for batch in batches:
                for row in batch.to_pylist():
                    for p in range(PARTS):
                        t, c = entry_sums(*_loaded(row, p, width), books[p])
                        totals[p], counts[p] = totals[p] + t, counts[p] + c
            for p in range(PARTS):
                if not isinstance(totals[p], int):
                    entry, at = np.indices(totals[p].shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(entry.size, p, np.int32)), pa.array(entry.ravel().astype(np.int32)), pa.array(at.ravel().astype(np.int32)),
                         pa.array([Decimal(int(v)) for v in totals[p].ravel()], pa.decimal128(38, 0)),
                         pa.array(counts[p][entry.ravel()])], ["part", "entry", "at", "total", "n"])

        sums = (table.filter("coded").select("parts").mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n long")
                .groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0"))
        books = books.copy()
        for r in sums.collect():            # PARTS x ENTRIES x width rows at most
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def encode(table: DataFrame, books: np.ndarray | None) -> DataFrame:
    """``id, label, code, error`` of every kept vector."""
    width = 0 if books is None else books.shape[2]
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids, labels = row.column(0).flatten(), row.column(1).flatten()
                if books is None or not row.column(2)[0].as_py():
                    code, error = [None] * len(ids), [None] * len(ids)
                else:
                    held = row.select(["parts"]).to_pylist()[0]
                    index, total = np.empty((len(ids), PARTS), np.int64), 0
                    for p in range(PARTS):
                        rows, starts, low, high, _ = _loaded(held, p, width)
                        order = np.frombuffer(held["parts"][p]["ord"], np.int32)
                        i, e = assign(rows, starts, low, high, books[p])
                        index[order, p] = i
                        placed = np.empty_like(e)
                        placed[order] = e
                        total = total + placed
                    code, error = ["".join(c) for c in hexes[index].tolist()], [int(t) for t in total]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                                 ["id", "label", "code", "error"])

    elements = [table.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    return table.mapInArrow(run, "id {}, label {}, code string, error long".format(*elements))


def with_totals(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal keys, nulls together. Keys of many rows are few: they are broadcast, so no
    key weighs on one task of the join."""
    each = rows.groupBy(key).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n"))
    each = kept_table(each.withColumnRenamed(key, "_key"), "totals")
    many = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot, cold = F.broadcast(each.filter(F.col("_n") > many)), each.filter(F.col("_n") <= many)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(hot, same).unionByName(rows.join(cold, same)).drop("_key", "_n")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
             ) -> tuple[DataFrame, np.ndarray | None]:
    """(``id, label, code, error, label_error`` of every kept vector, the final codebooks)."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    dims, first = seeds(kept)
    table = chunks(kept, dims)
    books = learn(table, first) if dims else None
    coded = kept_table(encode(table, books), "codes")
    return with_totals(coded, "label", "error", "label_error"), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    text = "" if books is None else ",".join(str(int(v)) for v in books.ravel())
    return hashlib.sha256(text.encode()).hexdigest()
