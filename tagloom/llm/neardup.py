"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles; equal sets collapse to one representative first. The trees:
a node's documents are branched by the least shingle under a hash function that the path selects, so a pair of Jaccard
similarity J stays together for d levels with probability J^d. Every tree starts with ``FIRST_DEPTH`` levels; nodes with
more documents or shingles than a node may hold branch on, level by level, and small nodes are compared exhaustively.
There are ``TREES`` trees, or more, as ``trees_at`` has it; documents of large nodes enter further trees at each level, so
that a pair at the threshold stays together in one tree with a probability of 1 - ``MISSED`` at any depth.

Before they branch, the documents of large nodes are confirmed around leaders: each joins one block of its largest node,
once for all trees, and a few leaders of the node stand in every block. Links found there are exact, and documents of one
confirmed component are not compared with each other again: a node is followed only while it holds two components. Of
nodes that stay too large down to ``LAST_DEPTH``, the members outside the largest component meet its blocks; if they are
many as well, the node is compared in pairs of blocks.

Nodes first compare sketches (the same minima, one byte each) with a margin of five standard errors. That gives cells:
a connected set of candidates is one cell if it is small, else its pairs of blocks are, or its nodes if these pairs would
be more rows than the trees make. Only then do full shingle sets travel, once for a document of a small cell, and every
link is confirmed on them exactly. A node or cell reports its links as
stars (a member and the least id of its part), never as all pairs. Stars are joined to components by large-star and
small-star rounds in Spark.

Each row is judged by its own text: repeated rows get equal results, an id repeated with other texts may get several. A
null text has the empty set; rows with an empty set are linked with nothing. Rows with a null id are kept, linked with
nothing, and have a null component."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import blob, kept_table, map_batches, mix, utf8, window_hashes, word_hashes

SHINGLE, PERCENT = 5, 85
FUNCTIONS, TREES, FIRST_DEPTH, LAST_DEPTH = 256, 20, 4, 10
MISSED, MARGIN = 1e-4, 5        # of pairs at the threshold, at most; standard errors
NODE_ROWS, NODE_SHINGLES = 1000, 4_000_000
LEADERS, BLOCK = 16, 256        # of a large node, about; documents that its leaders meet at a time
HELD_STARS = 200_000            # that a task holds before it passes them on

_draw = np.random.default_rng(20240501)
_A = _draw.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)


@cache
def path(tree: int) -> np.ndarray:
    """The functions of a tree, level by level: the first trees share none, all others draw theirs."""
    if (tree + 1) * LAST_DEPTH <= FUNCTIONS:
        return np.arange(tree * LAST_DEPTH, (tree + 1) * LAST_DEPTH)
    return np.random.default_rng((20240501, tree)).permutation(FUNCTIONS)[:LAST_DEPTH]


@cache
def trees_at(depth: int, percent: int) -> int:
    """So many trees that at most ``MISSED`` of the pairs at the threshold are parted in each by that depth. Trees that
    draw from the same functions aren't independent: the mean over the number of functions that agree for a pair."""
    j, n = min(percent, 99) / 100, FUNCTIONS
    agree = [math.exp(math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(j) + (n - a) * math.log(1 - j))
             for a in range(n + 1)]
    parted = [1 - math.comb(a, depth) / math.comb(n, depth) for a in range(n + 1)]
    trees = TREES
    while sum(p * q ** trees for p, q in zip(agree, parted, strict=True)) > MISSED:
        trees += 1
    return trees


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text's whole word sequence is its only one."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            np.minimum(out, ((x[i:i + 512, None] ^ _B) * _A).min(axis=0), out=out)
    return out


def node_keys(least: np.ndarray, depth: int, trees: range) -> np.ndarray:
    """The node that each row of minima reaches at a depth, for each tree."""
    out = np.empty((len(least), len(trees)), np.uint64)
    with np.errstate(over="ignore"):
        for k, t in enumerate(trees):
            key = np.full(len(least), (t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
            for f in path(t)[:depth]:
                key = mix(key * np.uint64(0xD1342543DE82EF95) + least[:, f].astype(np.uint64))
            out[:, k] = key
    return out


def sketches(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, n_shingles, print1, print2, least, digest`` for every row: set size, 128-bit fingerprint of the set, minima, and the
    text's SHA-256."""
    def run(batch: pa.RecordBatch):
        n, one, two, least = [], [], [], []
        for text in blob(batch.column(1)):
            s = shingle_set(text)
            n.append(len(s))
            if len(s):
                with np.errstate(over="ignore"):
                    one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)))
                least.append(minima(s).tobytes())
            else:
                one.append(None)
                two.append(None)
                least.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(least, pa.binary()), batch.column(2)], ["doc", "n_shingles", "print1", "print2", "least", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc"), utf8(text_col).alias("text"), text_digest(text_col).alias("digest"))
    return map_batches(src, run, f"doc {kind}, n_shingles long, print1 long, print2 long, least binary, digest string")


def text_digest(text_col: str) -> F.Column:
    """What tells the rows of one id apart: the text's digest (null: that of the empty text)."""
    return F.sha2(F.coalesce(utf8(text_col), F.lit(b"")), 256)


def _sizes(rows: DataFrame, node_rows: int, node_shingles: int) -> DataFrame:
    """``rows`` of nodes with two documents or more (two components, where the rows name theirs), with ``n``, ``load`` and
    whether the node is small enough to compare."""
    w = Window.partitionBy("node")
    sizes = {"n": F.count(F.lit(1)).over(w), "load": F.sum("n_shingles").over(w)}
    if "comp" in rows.columns:
        sizes["mixed"] = F.min("comp").over(w) != F.max("comp").over(w)
    return (rows.withColumns(sizes).filter("mixed" if "mixed" in sizes else "n > 1").drop("mixed")
            .withColumn("small", (F.col("n") <= node_rows) & ((F.col("load") <= node_shingles) | (F.col("n") == 2))))


def _placed(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their document: itself, where none is known."""
    if known is None:
        return rows.withColumn("comp", F.col("doc"))
    return rows.join(known, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def _paths(reps: DataFrame, depth: int, trees: range | None):
    """A function for :func:`map_batches` from ``doc, n_shingles, least[, comp][, tree]`` to node rows, and their schema: one
    row for each of the trees, or for the tree that a row names."""
    def run(batch: pa.RecordBatch):
        least = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
        own = [batch.column(k) for k in ("doc", "n_shingles", "comp") if k in batch.schema.names]
        if trees is None:       # each row has its tree
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            node = np.empty(len(least), np.uint64)
            for t in np.unique(tree):
                at = tree == t
                node[at] = node_keys(least[at], depth, range(t, t + 1))[:, 0]
        else:
            node = node_keys(least, depth, trees).ravel()
            tree = np.tile(np.array(trees), len(least))
            at = pa.array(np.repeat(np.arange(len(least)), len(trees)))
            own = [x.take(at) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(tree.astype(np.int32)), *own],
                                         ["node", "tree", "doc", "n_shingles", "comp"][:2 + len(own)])

    kind = reps.schema["doc"].dataType.simpleString()
    return run, f"node long, tree int, doc {kind}, n_shingles long" + (f", comp {kind}" if "comp" in reps.columns else "")


def first_level(reps: DataFrame, node_rows: int = NODE_ROWS, node_shingles: int = NODE_SHINGLES, first: int = FIRST_DEPTH,
                percent: int = PERCENT) -> DataFrame:
    """The trees' nodes after their first levels, as :func:`_sizes` has them."""
    src = reps.select("doc", "n_shingles", "least")
    return kept_table(_sizes(map_batches(src, *_paths(src, first, range(trees_at(first, percent)))), node_rows, node_shingles), "paths")


def leaves(reps: DataFrame, node_rows: int = NODE_ROWS, node_shingles: int = NODE_SHINGLES, first: int = FIRST_DEPTH,
           last: int = LAST_DEPTH, percent: int = PERCENT, start: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``node, doc, n_shingles``: the trees' nodes that are to be compared exhaustively. ``start`` is their first level;
    ``known`` places documents in components confirmed already (``doc, comp``): large nodes of one alone are left out."""
    level = first_level(reps, node_rows, node_shingles, first, percent) if start is None else start
    done = level.filter("small").select("node", "doc", "n_shingles")
    rows, trees = level.filter("not small").select("node", "tree", "doc", "n_shingles"), trees_at(first, percent)
    if known is None and rows.isEmpty():
        return done
    src, own = reps.select("doc", "n_shingles", "least"), ["doc", "n_shingles", "least", "comp"]
    level = _sizes(_placed(rows, known), node_rows, node_shingles)
    level = level if known is None else kept_table(level, "paths")
    for depth in range(first + 1, last + 1):
        large = level.filter("not small")
        if large.isEmpty():
            return done
        deeper = large.select("doc", "tree", "comp").join(src, "doc").select(*own, "tree")
        nodes, more = map_batches(deeper, *_paths(deeper, depth, None)), trees_at(depth, percent)
        if more > trees:
            again = src.join(large.select("doc", "comp").distinct(), "doc").select(*own)
            nodes = nodes.unionByName(map_batches(again, *_paths(again, depth, range(trees, more))))
            trees = more
        level = kept_table(_sizes(nodes, node_rows, node_shingles), "paths")
        done = done.unionByName(level.filter("small").select("node", "doc", "n_shingles"))
    large = level.filter("not small")
    if large.isEmpty():
        return done
    # what no level could split: the node's largest component in blocks, each with all members outside of it
    half = max(1, node_rows // 2)
    main = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(
        F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    main = main.select("node", F.col("top.comp").alias("main"), F.ceil(F.col("top.m") / half).alias("blocks"),
                       (F.col("all") - F.col("top.m") <= half).alias("few"), F.ceil(F.col("all") * 2 / node_rows).alias("halves"))
    rows = large.join(main, "node").withColumn("blocks", F.when(F.col("few"), F.col("blocks")).otherwise(F.col("halves")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    here = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    outside = rows.filter("few").select("node", "doc", "n_shingles", F.explode(
        F.when(F.col("comp") == F.col("main"), F.array(here)).otherwise(every)).alias("block")).select(
        F.xxhash64("node", F.lit(-1), "block").alias("node"), "doc", "n_shingles")
    # many outside as well: every pair of blocks is a node of its own
    pairs = rows.filter("not few").withColumn("block", here).select("node", "doc", "n_shingles", "block", F.explode(every).alias("other")).select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "doc", "n_shingles")
    return done.unionByName(outside).unionByName(pairs)


def leader_stars(level: DataFrame, docs: DataFrame, percent: int, node_shingles: int = NODE_SHINGLES) -> DataFrame | None:
    """``doc, root``: confirmed links between documents of large nodes; none if no node is large.

    A document meets one block of its largest node, and in each block the node's leaders, which are the documents of lowest
    rank: about ``LEADERS`` of them, fewer of large sets. Nodes that share documents so share leaders."""
    large = level.filter("not small")
    if large.isEmpty():
        return None
    large = large.select("node", "doc", "n", "load", _rank("doc").alias("rank"))
    leaders = F.greatest(F.lit(1), F.least(F.lit(LEADERS), F.floor(F.lit(node_shingles) * F.col("n") / F.col("load"))))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("load") / node_shingles))
    own = large.groupBy("doc", "rank").agg(F.max(F.struct("n", "node", "load")).alias("at")).select(
        "doc", "rank", "at.n", "at.node", "at.load")
    own = own.select("node", F.pmod(F.xxhash64("doc"), blocks).alias("block"), "doc", "rank")
    lead = large.filter(F.col("rank") * F.col("n") < leaders * RANKS).select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "doc", "rank")
    cells = own.unionByName(lead).select(F.xxhash64("node", "block").alias("cell"), "doc", "rank").distinct()
    return kept_table(linked_stars(kept_table(cells, "leader-blocks"), docs, percent), "leader-stars")


RANKS = 1 << 30


def _rank(col: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("rank"), col), F.lit(RANKS))


def led_components(stars: DataFrame) -> DataFrame:
    """``doc, comp``: the document of lowest rank that leader stars lead to in two steps. Equal ones are linked; linked ones
    may differ."""
    up = stars.groupBy("doc").agg(F.min(F.struct(_rank("root").alias("rank"), "root")).alias("up")).select(
        "doc", F.col("up.root").alias("root"))
    above = up.select(F.col("doc").alias("root"), F.col("root").alias("above"))
    return kept_table(up.join(above, "root", "left").select("doc", F.coalesce("above", "root").alias("comp")), "led")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, pa.Array, np.ndarray]]:
    """From rows sorted by their first column: (first row of each group, and the end), ids, values; whole groups only."""
    held = None
    def out(t: pa.Table):
        key = t.column(0).to_numpy()
        at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        return at, t.column(1).to_pylist(), t.column(2).combine_chunks()
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        key = t.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))
        if start:
            yield out(t.slice(0, start))
        held = t.slice(start)
    if held is not None:
        yield out(held)


def _stars(ids: list, linked: np.ndarray, first: bool = False) -> list[tuple]:
    """(member, least id of its part, or the first) for every member that isn't it, from a symmetric matrix of links."""
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    if first:
        return [(i, ids[k]) for i, k in zip(ids, label.tolist(), strict=True) if i != ids[k]]
    best: dict[int, object] = {}
    for i, k in zip(ids, label.tolist(), strict=True):
        best[k] = i if k not in best or i < best[k] else best[k]
    return [(i, best[k]) for i, k in zip(ids, label.tolist(), strict=True) if i != best[k]]


class _Joined:
    """Stars of many nodes as those of their union: one for each member, however many trees report it."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while x in self.up:
            above = self.up[x]
            self.up[x] = x = self.up.get(above, above)
        return x

    def add(self, stars: list[tuple]) -> None:
        for a, b in stars:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def take(self) -> list[tuple]:
        out = [(x, self.root(x)) for x in list(self.up)]
        self.up = {}
        return out


def _star_batch(stars: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], kind), pa.array([s[1] for s in stars], kind)],
                                      ["doc", "root"])


def candidate_stars(leaf_rows: DataFrame, reps: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """``doc, root``: within each node, documents whose sketches agree nearly as often as the threshold asks and that aren't
    in one component by ``known`` (``doc, comp``)."""
    at_least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / FUNCTIONS) ** 0.5

    def sketch(batch: pa.RecordBatch):
        least = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
        comp = batch.column(2).to_numpy().view(np.uint8).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.hstack((sketches(least), comp))], pa.binary())],
                                         ["doc", "sketch"])

    def run(batches):
        joined = _Joined()
        for at, ids, values in _groups(batches):
            s = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, FUNCTIONS + 8)
            s, comp = s[:, :FUNCTIONS], np.ascontiguousarray(s[:, FUNCTIONS:]).view(np.int64).ravel()
            stars, size = [], np.diff(at)
            two = at[:-1][size == 2]
            close = two[((s[two] == s[two + 1]).mean(axis=1) >= at_least) & (comp[two] != comp[two + 1])]
            stars += [(max(ids[i], ids[i + 1]), min(ids[i], ids[i + 1])) for i in close if ids[i] != ids[i + 1]]
            for a, b in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                linked = np.stack([((s[i] == s[a:b]).mean(axis=1) >= at_least) & (comp[i] != comp[a:b]) for i in range(a, b)])
                np.fill_diagonal(linked, True)
                stars += _stars(ids[a:b], linked)
            joined.add(stars)
            if len(joined.up) > HELD_STARS:
                yield _star_batch(joined.take(), kind)
        if joined.up:
            yield _star_batch(joined.take(), kind)

    kind = None
    name = reps.schema["doc"].dataType.simpleString()
    kind = to_arrow_type(reps.schema["doc"].dataType)
    marks = map_batches(_placed(reps.select("doc", "least"), known).select("doc", "least", F.xxhash64("comp").alias("comp")),
                        sketch, f"doc {name}, sketch binary")
    rows = leaf_rows.select("node", "doc").join(marks, "doc").select("node", "doc", "sketch")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, f"doc {name}, root {name}").distinct()


def linked_stars(cells: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``doc, root``: links within each cell (``cell, doc``), confirmed on full sets. The root is the least id of its part, or
    if the cells' rows have a ``rank`` the lowest one."""
    ranked = "rank" in cells.columns
    def sets(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x).tobytes() for x in blob(batch.column(1))],
                                                                    pa.binary())], ["doc", "shingles"])

    def run(batches):
        for at, ids, values in _groups(batches):
            stars = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    members = [np.frombuffer(values[int(k)].as_buffer(), np.uint64) for k in range(a, b)]
                    stars += _stars(ids[a:b], links(members, percent), ranked)
            if stars:
                yield _star_batch(stars, kind)

    name = docs.schema["doc"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc"].dataType)
    wanted = docs.join(cells.select("doc").distinct(), "doc", "left_semi")
    full = map_batches(wanted, sets, f"doc {name}, shingles binary").distinct()
    order = ["cell", "rank", "doc"] if ranked else ["cell"]
    rows = cells.join(full, "doc").select("cell", "doc", "shingles", *order[1:2])
    return rows.repartition("cell").sortWithinPartitions(*order).mapInArrow(run, f"doc {name}, root {name}").distinct()


def links(members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have 100 * intersection >= percent * union: exact counts, from products of incidence matrices."""
    size = np.array([len(m) for m in members], np.int64)
    if len(members) == 2:
        both = np.array([[0, len(np.intersect1d(*members, assume_unique=True))]] * 2)
        both = np.array([[size[0], both[0, 1]], [both[0, 1], size[1]]])
    else:
        values, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(members)), size)
        shared = count > 1
        rank = np.cumsum(shared) - 1
        use = shared[column]
        column, owner = rank[column[use]], owner[use]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(members), len(members)))
        for begin in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, (begin, begin + 4096))
            m = np.zeros((len(members), 4096), np.float32)
            m[owner[a:b], column[a:b] - begin] = 1
            both += m @ m.T
        both = both.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    out = 100 * both >= percent * union
    np.fill_diagonal(out, True)
    return out


def components(stars: DataFrame) -> DataFrame:
    """``doc, root``: every vertex that isn't the least of its component, and that least vertex. Rounds of large-star
    (each vertex hands its larger neighbours to its least one) and small-star (the same for its smaller neighbours)
    until a round changes nothing; each round is a written table."""
    edges, before = kept_table(stars, "stars"), None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("doc"), F.col("doc").alias("root")))
        least = F.least(F.col("doc"), F.min("root").over(Window.partitionBy("doc")))
        large = (both.withColumn("least", least).filter("root > doc").select(F.col("root").alias("doc"), F.col("least").alias("root"))
                 .filter("doc != root").distinct())
        down = large.select(F.greatest("doc", "root").alias("doc"), F.least("doc", "root").alias("root"))
        w = F.min("root").over(Window.partitionBy("doc"))
        small = (down.withColumn("least", w)
                 .select(F.explode(F.array(F.struct("doc", "least"), F.struct(F.col("root").alias("doc"), "least"))).alias("e"))
                 .select("e.doc", F.col("e.least").alias("root")).filter("doc != root").distinct())
        edges = kept_table(small, "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges
        before = tuple(state)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    node_rows: int = NODE_ROWS, node_shingles: int = NODE_SHINGLES, digest: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row, and with ``digest`` the text's (:func:`text_digest`)."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    marks = kept_table(signatures(src, "doc", "text"), "signatures")
    live = marks.filter("doc is not null and n_shingles > 0")
    alike = ["print1", "print2", "n_shingles"]
    reps = (live.groupBy(*alike).agg(F.min(F.struct("doc", "least")).alias("r"))
            .select("r.doc", "n_shingles", "r.least", "print1", "print2"))
    reps = kept_table(reps, "representatives")
    text = src.select("doc", utf8("text").alias("text")).filter("doc is not null and text is not null")
    level = first_level(reps, node_rows, node_shingles, percent=percent)
    led = leader_stars(level, text, percent, node_shingles)
    known = None if led is None else led_components(led)
    nodes = leaves(reps, node_rows, node_shingles, percent=percent, start=level, known=known)
    near = components(candidate_stars(nodes, reps, percent, known))
    member = near.unionByName(near.select(F.col("root").alias("doc"), "root").distinct())
    load = member.join(reps.select("doc", "n_shingles"), "doc").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"))
    load = kept_table(load, "cells")
    fits = (F.col("n") <= node_rows) & ((F.col("load") <= node_shingles) | (F.col("n") == 2))
    blocks = F.when(fits, 1).otherwise(F.greatest(F.ceil(F.col("n") * 2 / node_rows), F.ceil(F.col("load") * 2 / node_shingles)))
    sized = member.join(load, "root").select("doc", "root", blocks.cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    pairs = sized.filter(F.col("blocks") <= TREES).withColumns(
        {"block": block, "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    cells = (pairs.select(F.xxhash64(F.lit(0), "root", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "doc")
             .unionByName(nodes.join(sized.filter(F.col("blocks") > TREES).select("doc", "root"), "doc")
                          .select(F.xxhash64(F.lit(1), "node", "root").alias("cell"), "doc").distinct()))
    stars = linked_stars(kept_table(cells, "cell-members"), text, percent)
    root = components(stars if led is None else stars.unionByName(led))
    place = (reps.join(root, "doc", "left").select(*alike, F.coalesce("root", "doc").alias("component_id")))
    own = ["digest"] if digest else []
    return (marks.select("doc", *alike, *own).join(place, alike, "left")
            .withColumn("component_id", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")))
            .select(F.col("doc").alias(id_col), "n_shingles", "component_id",
                    F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"), *own))
