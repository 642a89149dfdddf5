"""Benchmark decontamination: which words of a document lie in a window of ten consecutive benchmark words.

Benchmark text is cut into windows in tasks. All windows go into one Aho-Corasick automaton over words: each word of the
benchmark is one symbol (of two characters), so a window is at most twenty arcs long. A benchmark of more than ``BLOCK_WORDS`` words is cut into
blocks (a longer item into overlapping pieces, which lose no window); each block is scanned by its own automaton, one
after the other, and the hits are united. A document is normalised byte by byte, its words become symbols, and it is
scanned once a block. The word numbers of the matches lead back to offsets in the original text, since the normalising
table keeps every byte's place.

Null or wordless documents have no words and no hits; null or wordless items, and items without an id, are not
searched. An item that occurs in several rows counts once. Repeated documents give repeated rows. An empty benchmark hits
nothing; an empty table of documents gives no rows. A text is held whole by one task, however long. Columns that are kept
pass through under their names; those named like a result column are not to be asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, kept_table, map_batches, spans, utf8, worker_state

WINDOW = 10
BLOCK_WORDS = 200_000       # words of benchmark text that one automaton (and one broadcast) holds; 20 nodes a word at most
BASE = 512                  # a word's number is written in two digits
MISS = "\0\0"               # the symbol of all words that the benchmark doesn't have

#: A-Z become a-z; digits, a-z and all bytes of other scripts stay; the rest separates words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = np.array([b == 32 for b in range(256)])


def symbol(number: int) -> str:
    """The two characters that stand for a word, each of a range of its own, so that matches begin at words. One
    character for all words would give the automaton's root a child a word, which it searches one after the other."""
    return chr(1 + number // BASE) + chr(0x1000 + number % BASE)


def automaton(items: list[tuple[str, bytes]], size: int = WINDOW) -> tuple[ahocorasick.Automaton, Callable[[bytes, str], str]]:
    """The windows' automaton, and the look-up of a word's symbol."""
    symbols: dict[bytes, str] = {}
    owners: dict[str, set[str]] = {}
    for item, text in items:
        words = text.translate(NORMAL).split()
        coded = "".join([symbols.setdefault(w, symbol(len(symbols))) for w in words])
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owners.setdefault(coded[2 * i:2 * (i + size)], set()).add(item)
    found = ahocorasick.Automaton()
    lists: dict[frozenset, tuple] = {}
    while owners:
        window, who = owners.popitem()
        found.add_word(window, (len(window) // 2, lists.setdefault(frozenset(who), tuple(sorted(who)))))
    if len(found):
        found.make_automaton()
    return found, symbols.get


def scan(text: bytes, found: ahocorasick.Automaton, look: Callable[[bytes, str], str]) -> tuple[int, np.ndarray, list[str]]:
    """Number of words, the numbers of the words that are hit, and the items that occur."""
    words = text.translate(NORMAL).split()
    if not words or not len(found):
        return len(words), np.empty(0, np.int64), []
    edge = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for end, (n, who) in found.iter("".join([look(w, MISS) for w in words])):
        k = end // 2
        edge[k - n + 1] += 1
        edge[k + 1] -= 1
        items.update(who)
    return len(words), np.flatnonzero(np.cumsum(edge)[:-1] > 0), sorted(items)


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets ``[begin, end)`` of the original text."""
    if not len(hit):
        return []
    raw = np.frombuffer(text.translate(NORMAL), np.uint8)
    start, end = spans(raw, _GAP)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    first = hit[np.concatenate(([True], np.diff(hit) > 1))]
    final = hit[np.concatenate((np.diff(hit) > 1, [True]))]
    return [{"begin": int(chars[start[a]]), "end": int(chars[end[b]])} for a, b in zip(first, final, strict=True)]


def item_pieces(benchmark: DataFrame, id_col: str, text_col: str, size: int, longest: int) -> DataFrame:
    """``item, words, n`` of the benchmark: normalised words, at most ``longest`` a row; the pieces of a longer item
    overlap by ``size`` - 1 words. Rows are distinct."""
    step = longest - size + 1
    src = (benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
           .select(F.col(id_col).cast("string").alias("item"), utf8(text_col).alias("text")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column(0).to_pylist(), blob(batch.column(1)), strict=True):
            words = text.translate(NORMAL).split()
            for i in range(0, max(1, len(words) - size + 1) if words else 0, step):
                some = words[i:i + longest]
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([b" ".join(some)], pa.binary()),
                                                  pa.array([len(some)], pa.int64())], ["item", "words", "n"])

    return map_batches(src, run, "item string, words binary, n long").distinct()


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most ``limit`` words, dealt by hash; one block at a time is fetched. There is at least
    one, which may be empty."""
    longest = max(limit // 8, 1) + size - 1
    pieces = kept_table(item_pieces(benchmark, id_col, text_col, size, longest), "benchmark-pieces")
    total, rows = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    count = max(1, -(-total // limit))

    def number(n: int):
        return F.pmod(F.xxhash64("item", "words"), F.lit(n))

    while 1 < count < 4 * rows and pieces.groupBy(number(count).alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > limit:
        count *= 2
    for k in range(count):
        yield [(r["item"], bytes(r["words"])) for r in pieces.filter(number(count) == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
                  block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs``' id (and the ``keep`` columns) with ``n_words``, ``hit`` (numbers of hit words, ascending),
    ``spans`` (character offsets of hit runs) and ``items`` (ids that occur, sorted)."""
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], utf8(text_col).alias("text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    at, sc = len(names), docs.sparkSession.sparkContext
    tail = ["n_words", "hit", "items"]
    dealt = blocks(benchmark, item_col, item_text_col, size, min(block_words, 1_000_000))
    block, later = next(dealt), None
    first = True
    while block is not None:
        later = next(dealt, None)
        shared = sc.broadcast((uuid.uuid4().hex, block))

        def run(batch: pa.RecordBatch, shared=shared, first=first, last=later is None):
            key, items_of = shared.value
            found, look = worker_state("decontaminate", (key, size), "automaton", lambda: automaton(items_of, size))
            n, hits, items, places = [], [], [], []
            for k, text in enumerate(blob(batch.column(at))):
                count, hit, who = scan(text, found, look)
                if not first:
                    hit = np.union1d(hit, np.array(batch.column(at + 2)[k].as_py(), np.int64)).astype(np.int64)
                    who = sorted({*who, *batch.column(at + 3)[k].as_py()})
                n.append(count)
                hits.append(hit)
                items.append(who)
                if last:
                    places.append(original_spans(text, hit))
            cols = [*batch.columns[:at + (not last)], pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string()))]
            if last:
                cols.append(pa.array(places, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(
                cols, [*batch.schema.names[:at + (not last)], *tail, *["spans"] * last])

        schema = f"{head if later is not None else head.rpartition(', ')[0]}, n_words long, hit array<long>, items array<string>"
        if later is None:
            schema += ", spans array<struct<begin:bigint,end:bigint>>"
        out = map_batches(out, run, schema)
        if later is not None:           # written, so that no stage holds the automata of two blocks
            out = kept_table(out, "benchmark-hits")
        block, first = later, False
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *tail, "spans")
