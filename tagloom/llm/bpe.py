"""Byte-level BPE: encode whole texts with a rank file, decode ids back to bytes.

A pretoken's merges run on a segment tree over its byte positions. A leaf holds the rank of the pair that starts
there together with the position, so the root is the leftmost pair of least rank; a merge changes three leaves (the
pair, its left neighbour, the swallowed one), each by a walk to the root. A pretoken of n bytes takes O(n log n),
also a run of a million blanks. The short pretokens of a batch are merged side by side, their trees the rows of one
array. Merged pretokens are remembered in a bounded table per Python worker. Decoding gathers bytes for whole arrays.

Null text is encoded as empty: no ids. An empty table gives an empty one. Repeated rows give repeated rows; other columns
don't take part. An id that the vocabulary lacks stops the decoding."""

from __future__ import annotations

import base64
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, map_batches, worker_state

MAX_VOCABULARY_BYTES = 64 << 20      # a vocabulary file is broadcast; a larger one is refused
CACHE_ENTRIES = 300_000              # remembered pretokens in a Python worker
LONG_TEXT = 1 << 20                  # characters (or pretokens, or ids of a longer text) that are handled at a time
SHORT_PIECE = 64                     # pretokens of at most so many bytes are merged side by side
TREE_CELLS = 1 << 16                 # leaves of the segment trees that are merged at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << max(n - 2, 1).bit_length()
    shift = n.bit_length()
    mask = (1 << shift) - 1
    none = 1 << 62
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 2))      # where the next part starts
    before = list(range(-1, n))        # where the previous part starts

    def put(i: int, value: int) -> None:
        k = leaves + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    while tree[1] != none:
        i = tree[1] & mask
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i:after[end]])
            put(i, none if rank is None else rank << shift | i)
        else:
            put(i, none)
        if j < n - 1:
            put(j, none)
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:end])
            put(p, none if rank is None else rank << shift | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Pairs:
    """(left id, right id) -> rank of their merge, for whole arrays: an open hash table of all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        keys, values = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges' ranks; -1 where there is none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        on = np.flatnonzero((have != keys) & (have != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & self.last
            have = self.keys[slot[on]]
            hit = have == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (have != -1)]
        return out


def merge_all(pieces: list[bytes], pairs: Pairs, byte_ids: np.ndarray) -> list[bytes]:
    """Packed ids of pretokens of at most ``SHORT_PIECE`` bytes: ``merge`` with the segment trees of many pretokens as the
    rows of one array, a merge in each row at a time."""
    out: list[bytes] = [b""] * len(pieces)
    length = np.array([len(p) for p in pieces], np.int64)
    width = 2
    while width <= SHORT_PIECE:
        rows = np.flatnonzero((length <= width) & ((length > width // 2) | (width == 2)))
        step = max(1, TREE_CELLS // width)
        for at in range(0, len(rows), step):
            some = rows[at:at + step].tolist()
            for k, ids in zip(some, _merge_rows([pieces[k] for k in some], length[some], width, pairs, byte_ids), strict=True):
                out[k] = ids
        width *= 2
    return out


def _merge_rows(pieces: list[bytes], n: np.ndarray, width: int, pairs: Pairs, byte_ids: np.ndarray) -> list[bytes]:
    rows, none, shift = len(pieces), 1 << 62, width.bit_length()
    data = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), np.uint8).reshape(rows, width + 1)
    ids = byte_ids[data]
    place = np.arange(width)
    rank = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width)
    tree = np.full((rows, 2 * width), none, np.int64)
    tree[:, width:] = np.where((rank >= 0) & (place < n[:, None] - 1), rank << shift | place, none)
    k = width // 2
    while k:
        tree[:, k:2 * k] = np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2])
        k //= 2
    alive = place < n[:, None]
    after = np.tile(np.arange(1, width + 2), (rows, 1)).ravel()       # where the next part starts
    before = np.tile(np.arange(-1, width), (rows, 1)).ravel()         # where the previous part starts
    tree, ids, row = tree.ravel(), ids.ravel(), np.arange(rows)

    def leaf(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = pairs.rank(left, right)
        return np.where(r >= 0, r << shift | at, none)

    while True:
        root = tree[row * (2 * width) + 1]
        row, root = row[root != none], root[root != none]
        if not len(row):
            break
        part, top = row * (width + 1), row * (2 * width)
        i = root & ((1 << shift) - 1)
        j = after[part + i]
        end = after[part + j]
        ids[part + i] = merged = root >> shift
        after[part + i] = end
        before[part + end] = i
        alive[row, j] = False
        p = before[part + i]
        tree[top + width + j] = none
        tree[top + width + i] = np.where(end < n[row], leaf(merged, ids[part + end], i), none)
        has = p >= 0
        tree[(top + width + p)[has]] = leaf(ids[(part + p)[has]], merged[has], p[has])
        base, node = np.concatenate((top, top, top)), np.concatenate((i, j, np.where(has, p, i))) + width
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
    packed = ids.reshape(rows, width + 1)[:, :-1][alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Pieces(dict):
    """Pretoken -> its ids as little-endian unsigned 32-bit integers; forgets the older half when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.byte_ids = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.complete = all(bytes([b]) in ranks for b in range(256))

    def learn(self, pieces: set[str]) -> None:
        """Remember the pretokens that are new, merged side by side."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > CACHE_ENTRIES:
            for p in list(islice(self, len(self) // 2)):
                del self[p]
        long = []
        for p in new:
            data = p.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self[p] = whole.to_bytes(4, "little")
            elif len(data) <= SHORT_PIECE and self.complete:
                long.append((p, data))
        self.update(zip([p for p, _ in long], merge_all([d for _, d in long], self.pairs, self.byte_ids), strict=True))

    def __missing__(self, piece: str) -> bytes:
        """Longer pretokens, and such as were forgotten meanwhile."""
        return np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()

    def encode(self, texts: list[str | None], splitter: regex.Pattern) -> list[bytes]:
        """Packed ids of whole texts; at most ``LONG_TEXT`` characters, or that many pretokens of one text, at a time."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0

        def flush():
            nonlocal group, held
            self.learn(set().union(*group))
            out.extend(b"".join(map(self.__getitem__, found)) for found in group)
            group, held = [], 0

        for text in texts:
            if len(text or "") <= LONG_TEXT:
                group.append(splitter.findall(text) if text else [])
                held += len(text or "")
                if held > LONG_TEXT:
                    flush()
                continue
            flush()
            matches, parts = splitter.finditer(text), []
            while found := [m.group() for m in islice(matches, LONG_TEXT)]:
                self.learn(set(found))
                parts.append(b"".join(map(self.__getitem__, found)))
            out.append(b"".join(parts))
        flush()
        return out


def _encoder(shared, pattern: str) -> tuple[Pieces, regex.Pattern]:
    """This worker's table for a vocabulary, kept between tasks."""
    path, tokens, ids = shared.value
    return worker_state("bpe", path, "encode " + pattern,
                        lambda: (Pieces(dict(zip(tokens, ids, strict=True))), regex.compile(pattern)))


class Spelling:
    """Ids -> bytes, gathered for whole arrays from one buffer of all tokens."""

    def __init__(self, tokens: list[bytes], ids: list[int]):
        order = np.argsort(np.array(ids, np.int64))
        self.ids = np.array(ids, np.int64)[order]
        self.size = np.array([len(t) for t in tokens], np.int64)[order]
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(order) else self.size
        self.bytes = np.frombuffer(b"".join(tokens[k] for k in order.tolist()), np.uint8)
        self.dense = bool(len(order)) and int(self.ids[-1]) == len(order) - 1

    def decode(self, packed: bytes) -> bytes:
        out = []
        for at in range(0, len(packed), 4 * LONG_TEXT):
            ids = np.frombuffer(packed[at:at + 4 * LONG_TEXT], "<u4").astype(np.int64)
            k = ids if self.dense else np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            if (ids > self.ids[-1]).any() or (self.ids[k] != ids).any():
                raise KeyError("an id that the vocabulary doesn't have")
            size = self.size[k]
            end = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.begin[k] - (end - size), size) + np.arange(int(end[-1]))].tobytes())
        return b"".join(out)


def _share(df: DataFrame, ranks_path: str):
    ranks = read_ranks(ranks_path)
    tokens = sorted(ranks, key=ranks.get)
    return df.sparkSession.sparkContext.broadcast((ranks_path, tokens, [ranks[t] for t in tokens]))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, n_tokens)`` for each row: ``ids`` are packed as little-endian unsigned 32-bit integers."""
    shared = _share(df, ranks_path)

    def run(batch: pa.RecordBatch):
        pieces, splitter = _encoder(shared, pattern)
        out = pieces.encode(batch.column(1).to_pylist(), splitter)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())],
            [id_col, "ids", "n_tokens"])

    src = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary, n_tokens long")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its packed ids stand for."""
    shared = _share(df, ranks_path)
    names = [c for c in df.columns if c != out_col]

    def run(batch: pa.RecordBatch):
        path, tokens, ranks = shared.value
        spelling = worker_state("bpe", path, "decode", lambda: Spelling(tokens, ranks))
        at = batch.schema.get_field_index(ids_col)
        out = [spelling.decode(x) for x in blob(batch.column(at))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return map_batches(df.select(*names), run, f"{schema}, `{out_col}` binary")
