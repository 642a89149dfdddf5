"""Exact duplicates against a history of digests held in minimal perfect hashes.

The history is a table of shards, cut by the first bits of the digest (SHA-256 of the text). A shard's distinct digests form a
minimal perfect hash: each level has a bit array in which the digests that meet no other set their bit, the rest go on to the
next level; a digest's slot is the rank of its bit. Slots hold the full digest, the winner's locator (the largest id of the
texts with that digest) and how many rows had it. A new digest finds at most one slot and is a member only if the 32
bytes that lie there equal its own.

New rows are combined by digest before they meet the history, so neither a group of copies nor a shard can weigh on one task.
Members move their slot's winner and count on; nonmembers are groups of their own, and all of it is the next history.
Rows then look their verdict up in the new history, shard by shard; digests with a great share of all rows have theirs
looked up once and broadcast instead (at most ``MOST_HOT``, as each holds more than one row in that many).

Null and empty texts are equal. A row with a null id never wins over another; a group of such rows alone keeps all of them, as
nothing tells them apart. Repeated rows of the winning id all stay (``kept`` is a statement about the id). An empty table
has no rows and an empty history. Other columns are ignored, whatever their names. Texts of any length are hashed whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bound_batches, kept_table, mix, utf8

SHARD_DIGESTS = 1 << 16         # of a shard, about
TASK_ROWS = 1 << 18             # rows of a shard that one task looks up, about
MOST_HOT, HOT_ROWS = 10_000, 1_000
DIGEST = 32
GAMMA = 2                       # bits of a level for each digest that reaches it
_BITS = 24                      # of the digest that choose the shard: 2^24 shards at most


class PerfectHash:
    """A minimal perfect hash over distinct digests (an array of shape (n, 32)); ``slot`` maps any digest to a slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(b.sum()) for b in levels]])
        self.ranks = [np.cumsum(b) - 1 for b in levels]

    @staticmethod
    def at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix(words[:, 1] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ words[:, 2]
            return (mix(x ^ words[:, 3]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, levels = digests.view(np.uint64).reshape(-1, 4), []
        while len(words):
            size = GAMMA * len(words) + 1
            at = cls.at(words, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return cls(levels)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        words = digests.view(np.uint64).reshape(-1, 4)
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            at = self.at(words[open_], level, len(bits))
            found = bits[at]
            out[open_[found]] = self.before[level] + self.ranks[level][at[found]]
            open_ = open_[~found]
        return out

    def pack(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool)
                    for b in packed])


def as_bytes(column) -> np.ndarray:
    """A column of digests as an array of shape (n, 32)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


class Shard:
    """One shard's perfect hash with its slots: digest, winner, count."""

    def __init__(self, levels: PerfectHash, digests: np.ndarray, winners: pa.Array, counts: np.ndarray):
        self.levels, self.digests, self.winners, self.counts = levels, digests, winners, counts

    @classmethod
    def build(cls, digests: np.ndarray, winners: pa.Array, counts: np.ndarray) -> Shard:
        levels = PerfectHash.build(digests)
        order = np.argsort(levels.slot(digests))
        return cls(levels, digests[order], winners.take(pa.array(order)), counts[order])

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest that the history has, -1 for the others: the bytes in the slot decide."""
        slot = self.levels.slot(digests)
        held = np.flatnonzero(slot >= 0)
        same = (self.digests[slot[held]] == digests[held]).all(axis=1)
        slot[held[~same]] = -1
        return slot

    def merge(self, digests: np.ndarray, winners: pa.Array, counts: np.ndarray) -> Shard:
        """The next history: members move their slot on, nonmembers are groups of their own."""
        slot = self.find(digests)
        member = np.flatnonzero(slot >= 0)
        kept, counted = self.winners.to_pylist(), self.counts.copy()
        for i, s in zip(member.tolist(), slot[member].tolist(), strict=True):
            new = winners[i].as_py()
            if new is not None and (kept[s] is None or new > kept[s]):
                kept[s] = new
        np.add.at(counted, slot[member], counts[member])
        other = np.flatnonzero(slot < 0)
        moved = pa.array(kept, self.winners.type)
        if not len(other):
            return Shard(self.levels, self.digests, moved, counted)
        return Shard.build(np.concatenate((self.digests, digests[other])),
                           pa.concat_arrays([moved, winners.take(pa.array(other))]), np.concatenate((counted, counts[other])))

    def row(self, shard: int) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int32()), "levels": pa.array([self.levels.pack()], pa.list_(pa.binary())),
                         "digests": pa.array([self.digests.tobytes()], pa.binary()),
                         "winners": pa.array([self.winners.to_pylist()], pa.list_(self.winners.type)),
                         "counts": pa.array([self.counts.tolist()], pa.list_(pa.int64()))})

    @classmethod
    def of(cls, row: pa.Table | pa.RecordBatch, at: int = 0) -> Shard:
        """From a history's row; from an empty table, the shard without digests."""
        kind = row.schema.field("winners").type.value_type
        if not row.num_rows:
            return cls(PerfectHash([]), np.empty((0, DIGEST), np.uint8), pa.array([], kind), np.empty(0, np.int64))
        digests = np.frombuffer(row.column("digests")[at].as_buffer(), np.uint8).reshape(-1, DIGEST)
        return cls(PerfectHash.unpack(row.column("levels")[at].as_py()), digests,
                   pa.array(row.column("winners")[at].as_py(), kind), np.array(row.column("counts")[at].as_py(), np.int64))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, digest`` of every row."""
    text = F.coalesce(utf8(text_col), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc"), F.unhex(F.sha2(text, 256)).alias("digest"))


def shard_of(shards: int) -> F.Column:
    first = F.conv(F.hex(F.substring("digest", 1, _BITS // 8)), 16, 10).cast("long")
    return F.pmod(first, F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class History:
    """A written table of ``shards`` shards: ``shard, levels, digests, winners, counts``."""
    table: DataFrame
    shards: int

    @classmethod
    def of(cls, rows: DataFrame, total: int) -> History:
        """The history of ``rows`` (``doc, digest``), cut for a table of ``total`` rows: a power of two of shards, at least one
        for each shuffle partition."""
        least = max(total // SHARD_DIGESTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        shards = 1 << min(_BITS, (least - 1).bit_length())

        def build(key, t):
            return Shard.build(*_columns(t)).row(key[0].as_py())

        new = _grouped(rows, shards).groupBy("shard").applyInArrow(build, _schema(rows))
        return cls(kept_table(new, "history"), shards)

    def extended(self, rows: DataFrame) -> History:
        """The history after ``rows`` too: each shard meets its new distinct digests."""
        def merge(key, old, t):
            shard = Shard.of(old)
            return (shard.merge(*_columns(t)) if t.num_rows else shard).row(key[0].as_py())

        new = _grouped(rows, self.shards).groupBy("shard")
        return History(kept_table(self.table.groupBy("shard").cogroup(new).applyInArrow(merge, _schema(rows)), "history"), self.shards)


def _schema(rows: DataFrame) -> str:
    return f"shard int, levels array<binary>, digests binary, winners array<{rows.schema['doc'].dataType.simpleString()}>, counts array<bigint>"


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, digest, winner, n``: distinct digests with the largest id and the number of their rows."""
    bound_batches(rows.sparkSession)
    return (rows.groupBy("digest").agg(F.max("doc").alias("winner"), F.count(F.lit(1)).alias("n"))
            .select(shard_of(shards), "digest", "winner", "n"))


def _columns(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    t = t.combine_chunks()
    return as_bytes(t.column("digest")), _flat(t.column("winner")), t.column("n").to_numpy()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def verdicts(rows: DataFrame, history: History, total: int) -> DataFrame:
    """``doc, digest, winner, group_size`` of every one of ``total`` rows, looked up in a history that has its digest.

    A digest of more than ``many`` rows is one of at most ``MOST_HOT``: those are broadcast. A shard with many other
    rows is looked up by several tasks, each with a copy of the shard."""
    kind = rows.schema["doc"].dataType.simpleString()
    many = max(HOT_ROWS, total // MOST_HOT)

    def loads(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.array(batch.column("counts")[i].as_py(), np.int64)
                top = np.flatnonzero(counts > many)
                blob, winners = batch.column("digests")[i].as_py(), batch.column("winners")[i].values
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(i, 1).take(pa.array([0] * (len(top) + 1))),
                     pa.array([int(counts[counts <= many].sum())] + [None] * len(top), pa.int64()),
                     pa.array([None, *(blob[s * DIGEST:(s + 1) * DIGEST] for s in top.tolist())], pa.binary()),
                     pa.array([None, *(winners[s].as_py() for s in top.tolist())], winners.type),
                     pa.array([None, *counts[top].tolist()], pa.int64())],
                    ["shard", "load", "digest", "winner", "group_size"])

    found = kept_table(history.table.select("shard", "digests", "winners", "counts")
                       .mapInArrow(loads, f"shard int, load bigint, digest binary, winner {kind}, group_size bigint"), "history-loads")
    hot = F.broadcast(found.filter("digest is not null").select("digest", "winner", "group_size"))
    parts = F.ceil(F.col("load") / TASK_ROWS).cast("int")
    wide = found.filter(F.col("load") > TASK_ROWS).select("shard", parts.alias("parts"))
    copies = (history.table.join(wide, "shard", "left")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
    cold = (rows.join(hot.select("digest"), "digest", "left_anti").select("doc", "digest", shard_of(history.shards))
            .join(F.broadcast(wide), "shard", "left")
            .withColumn("part", F.pmod(F.xxhash64("doc", "digest"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"))

    def look(key, t, old):
        shard = Shard.of(old)
        slot = shard.find(as_bytes(t.column("digest")))
        if (slot < 0).any():
            raise ValueError("a row's digest is not in the history that its verdict was asked of")
        return pa.table({"doc": t.column("doc"), "digest": t.column("digest"), "winner": shard.winners.take(pa.array(slot)),
                         "group_size": pa.array(shard.counts[slot])})

    looked = (cold.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
              .applyInArrow(look, f"doc {kind}, digest binary, winner {kind}, group_size bigint"))
    return looked.unionByName(rows.join(hot, "digest").select("doc", "digest", "winner", "group_size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: F.Column | None = None,
                history: History | None = None) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` of every row.

    Without a ``history`` of a former run, the rows that ``earlier`` selects (a condition on ``doc``; default: the ids whose
    crc32 is even) are the first delivery: they alone build the history that all others are looked up in. With one,
    winners and group sizes count its rows too."""
    ids = F.col("doc")
    rows = kept_table(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    if history is None:
        if earlier is None:
            earlier = F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(2)) == 0
        earlier = F.coalesce(earlier, F.lit(False))
        known = History.of(rows.filter(earlier), total).extended(rows.filter(~earlier))
    else:
        known = history.extended(rows)
    done = verdicts(rows, known, total)
    return done.select(ids.alias(id_col), F.col("winner").alias("keep_id"), "group_size",
                       ids.eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
