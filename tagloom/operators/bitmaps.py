"""Facet filters from bitmaps: many selections of tags are answered by bit operations, without reading the captions again.

``tag_bitmaps`` holds, for every tag, one bitmap of 32,768 bits for each range of file ids that it occurs in
(``bitmap_construct_agg``). A selection is the intersection of its tags' bitmaps, range by range; counts are bit counts. Ids are
whole numbers; the denser they are, the fewer bitmaps there are. A tag that occurs in every file is as many rows as there
are ranges, so no tag weighs on one task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.stats import caption_tags
from tagloom.session import materialize

BITS = 32_768           # of a bitmap: fixed by Spark's bitmap functions
HELD_COUNTS = 200_000   # that a task sums before it passes them on


def tag_bitmaps(captions: DataFrame, id_col: str = "file_id", caption_col: str = "caption") -> DataFrame:
    """``(tag, bucket, bits)``; the empty tag stands for every file with a caption."""
    tags = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(caption_tags(captions, caption_col)))
    rows = captions.where(F.col(caption_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(tags).alias("tag"))
    return (rows.groupBy("tag", F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))


def selected_bitmaps(bitmaps: DataFrame, selections: DataFrame) -> DataFrame:
    """``(selection, bucket, bits)`` of the files that have all tags of a selection (``selection, tags``); no tags select all files."""
    wanted = selections.select("selection", F.explode(F.when(F.size("tags") > 0, F.array_distinct("tags"))
                                                      .otherwise(F.array(F.lit(None).cast("string")))).alias("tag"),
                               F.greatest(F.size(F.array_distinct("tags")), F.lit(1)).alias("n"))
    met = wanted.join(bitmaps, wanted.tag.eqNullSafe(bitmaps.tag)).select("selection", "n", "bucket", "bits")
    return (met.groupBy("selection", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
            .where((F.col("found") == F.col("n")) & (F.bitmap_count("bits") > 0)).select("selection", "bucket", "bits"))


def selection_counts(selected: DataFrame, selections: DataFrame) -> DataFrame:
    """``(selection, n_files)``, zero for selections that no file meets."""
    counts = selected.groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("n_files"))
    return selections.select("selection").join(counts, "selection", "left").select("selection", F.coalesce("n_files", F.lit(0)).alias("n_files"))


SELECTIONS_HELD = 256           # whose bitmaps of one range a task holds at a time


def selection_facets(bitmaps: DataFrame, selected: DataFrame) -> DataFrame:
    """``(selection, tag, n_files)``: how many of a selection's files have each tag.

    Selections are dealt into blocks; for every range and block one task holds the selections' bitmaps and lets the tags' pass
    by, so a bitmap travels once (a tag's once a block) and the pairs are only counts, summed in the task first."""
    mine = materialize(selected.where(F.col("bucket").isNotNull()), "selected-bitmaps")
    blocks = max(1, -(-mine.select("selection").distinct().count() // SELECTIONS_HELD))
    mine = mine.select("bucket", F.pmod(F.xxhash64("selection"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"),
                       F.col("selection").alias("name"), "bits")
    tags = (bitmaps.where(F.col("tag").isNotNull()).join(mine.select("bucket", "block").distinct(), "bucket")
            .select("bucket", "block", F.lit(1).alias("kind"), F.col("tag").alias("name"), "bits"))
    rows = mine.unionByName(tags).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind")
    return (rows.mapInArrow(_facet_counts, "selection string, tag string, n_files long")
            .groupBy("selection", "tag").agg(F.sum("n_files").alias("n_files")).where(F.col("n_files") > 0))


def _facet_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``selection, tag, n_files`` from rows ``bucket, block, kind, name, bits``: selections (kind 0) before tags."""
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], ["selection", "tag", "n_files"])
    place, names, held, matrix = None, [], [], None
    for batch in batches:
        for bucket, block, kind, name, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (bucket, block) != place:
                place, names, held, matrix = (bucket, block), [], [], None
            words = np.frombuffer(bits, np.uint64)
            if kind == 0:
                names.append(name)
                held.append(words)
                continue
            matrix = np.stack(held) if matrix is None else matrix
            both = np.bitwise_count(matrix & words).sum(axis=1, dtype=np.int64)
            for i in np.flatnonzero(both):
                counts[names[i], name] += int(both[i])
            if len(counts) > HELD_COUNTS:
                yield out()
                counts.clear()
    if counts:
        yield out()


def selected_files(selected: DataFrame) -> DataFrame:
    """``(selection, file_id)``: the set bits as ids again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, bucket, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                # the inverse of bitmap_bucket_number and bitmap_bit_position: positive ids count from 1, the others downwards from 0
                ids = (bucket - 1) * BITS + at + 1 if bucket > 0 else bucket * BITS - at
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(ids)), pa.array(ids, pa.int64())],
                                                 ["selection", "file_id"])
    return selected.select("selection", "bucket", "bits").mapInArrow(run, "selection string, file_id long")
