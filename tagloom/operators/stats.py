"""Caption statistics, caption filters and model-output decoding (long form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Category codes of a label vocabulary (fixed values).
CATEGORY_CODES = {9: "rating", 0: "general", 4: "character"}


def _category_name(code) -> F.Column:
    expr = None
    for k, v in CATEGORY_CODES.items():
        expr = F.when(code == k, v) if expr is None else expr.when(code == k, v)
    return expr


def caption_tags(captions: DataFrame, caption_col: str = "caption") -> F.Column:
    """Stripped comma parts of a caption (blank parts kept, as in the UI counters)."""
    return F.transform(F.split(F.col(caption_col), ","), lambda t: F.trim(t))


def tag_facets(captions: DataFrame, caption_col: str = "caption") -> DataFrame:
    """Occurrences of each caption tag over the dataset (no per-file dedupe): ``(tag, n)``.
    A partial aggregate: hot tags are combined map-side before the shuffle."""
    return (captions.select(F.explode(caption_tags(captions, caption_col)).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def filter_by_tags(captions: DataFrame, selected: list[str], caption_col: str = "caption") -> DataFrame:
    """Files whose caption tag set contains every selected tag (none selected -> all files).
    A per-row predicate: no shuffle."""
    if not selected:
        return captions
    want = F.array(*[F.lit(t) for t in selected])
    tags = caption_tags(captions, caption_col)
    return captions.where(F.forall(want, lambda t: F.array_contains(tags, t)))


def decode_scores(vectors: DataFrame, labels: DataFrame, vec_col: str = "scores") -> DataFrame:
    """Score vectors x label vocabulary -> ``(vec_id, category, tag, score)``.

    The vectors are exploded in place; the vocabulary (one row per model output) is joined on the
    index. It is not force-broadcast: AQE broadcasts it after measuring it, and falls back to a
    shuffle join if a vocabulary were ever too large."""
    long = vectors.select("vec_id", F.posexplode(vec_col).alias("idx", "score"))
    # labels of other categories (artist, copyright, meta, ...) are not part of a prediction
    lab = (labels.select("idx", F.col("name").alias("tag"), _category_name(F.col("category")).alias("category"))
           .where(F.col("category").isNotNull()))
    return long.join(lab, "idx").select("vec_id", "category", "tag", "score")


def decode_caption_scores(captions: DataFrame, id_col: str = "file_id", caption_col: str = "caption") -> DataFrame:
    """A generated comma caption becomes general tags of score 1.0 (a set: duplicates collapse)."""
    return (captions.select(id_col, F.explode(caption_tags(captions, caption_col)).alias("tag"))
            .distinct()
            .select(id_col, F.lit("general").alias("category"), "tag", F.lit(1.0).alias("score")))
