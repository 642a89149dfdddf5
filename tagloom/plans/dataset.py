"""Dataset tagging job (the flagship): predictions -> captions + dataset statistics.

Plan shape: caption and mapped result lists are built with ONE read of the predictions and ONE
shuffle on ``file_id``, then trimmed and rewritten with native higher-order functions; the results without
mapping rules come from such a list as well, with the file's vocabulary in it; the statistics are partial
aggregates per tag (map-side combine, so a tag present in a third of all files is still cheap) over
a scalar file count (a one-row scalar subquery, never a collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import replace_underscores, strip_rating_prefix, word_key
from tagloom.operators import tags as T
from tagloom.operators.tags import CHARACTER, GENERAL, RATING, TagSettings


def kept_tags(pred: DataFrame, st: TagSettings) -> DataFrame:
    """Thresholded character rows ++ thresholded (and trimmed) general rows, long form."""
    p = T.prepare_predictions(pred, st.replace_underscores)
    th = T.threshold_scores(p.where(F.col("category") != RATING), st.general_threshold, st.character_threshold,
                            st.general_mcut, st.character_mcut)
    gen = th.where(F.col("category") == GENERAL)
    if st.trim_general_tag_dupes:
        gen = T.trim_contained_tags(gen)
    return th.where(F.col("category") == CHARACTER).unionByName(gen)


def _lists(pred: DataFrame, st: TagSettings, shift: float) -> DataFrame:
    """One sorted tag list per file of ``pred`` (an empty list for files with no kept tag).

    Rows below their threshold go into the same ``groupBy(file_id)`` as null entries, which ``collect_list`` skips, and a
    file's list is trimmed where it lies: the predictions are read once and move once."""
    p = T.prepare_predictions(pred, st.replace_underscores)
    p = T.mark_threshold(p, st.general_threshold, st.character_threshold, st.general_mcut, st.character_mcut)
    general = F.col("category") == GENERAL
    s = F.when(general, F.col("score") + F.lit(shift)).otherwise(F.col("score"))
    key = F.when(general, word_key(F.col("tag"))) if st.trim_general_tag_dupes else F.lit(None).cast("string")
    entry = F.struct((-s).alias("k"), F.when(general, 1).otherwise(0).alias("cat"), F.col("ord").alias("o"), F.col("tag"),
                     s.alias("score"), key.alias("key"))
    rows = p.select("file_id", F.when(F.col("passes"), entry).alias("e"))
    kept = T.trim_tag_list(F.col("_e"))
    # rows without a file contain no other's tags
    trimmed = F.when(F.col("file_id").isNull(), F.col("_e")).otherwise(kept) if st.trim_general_tag_dupes else F.col("_e")
    return (rows.groupBy("file_id").agg(F.array_sort(F.collect_list("e")).alias("_e")).select("file_id", trimmed.alias("_e"))
            .select("file_id", F.transform("_e", lambda x: F.struct(x["tag"].alias("tag"),
                                                                     x["score"].alias("score"))).alias("tags")))


def n_files(pred: DataFrame) -> DataFrame:
    return pred.select(F.countDistinct("file_id").alias("n"))


def captions(pred: DataFrame, st: TagSettings = TagSettings()) -> DataFrame:
    """``(file_id, caption)`` for every file of the prediction table."""
    lists = _lists(pred, st, shift=-1.0)
    return lists.select("file_id", T.join_caption(T.caption_list(F.col("tags"), st), st.escape_brackets).alias("caption"))


def result_scores(pred: DataFrame, st: TagSettings = TagSettings()) -> DataFrame:
    """Per-file category results ``(file_id, category, tag, score)`` after map/ban: a result tag
    belongs to every category whose (pre-threshold) vocabulary of that file contains it;
    duplicates collapse to the last, i.e. lowest, score."""
    if T.parse_mapping_rules(st.map_tags):
        lists = _lists(pred, st, shift=0.0)
        out = lists.select("file_id", F.posexplode(T.result_list(F.col("tags"), st)).alias("pos", "e")) \
            .select("file_id", F.col("e.tag").alias("tag"), F.col("e.score").alias("score"))
    else:
        return _unmapped_results(pred, st)
    # the vocabulary is the whole prediction table: no distinct (a duplicate vocabulary row only
    # repeats a result row, which the min below absorbs), so it is shuffled once, for the join
    vocab = (T.prepare_predictions(pred, st.replace_underscores)
             .where(F.col("category") != RATING).select("file_id", "category", "tag"))
    return (out.join(vocab, ["file_id", "tag"])
            .groupBy("file_id", "category", "tag").agg(F.min("score").alias("score")))


def _unmapped_results(pred: DataFrame, st: TagSettings) -> DataFrame:
    """:func:`result_scores` without mapping rules: the kept rows minus banned tags.

    A file's rows move once, as one list that holds its vocabulary and is trimmed where it lies; the categories of its tags are
    then gathered among the rows of its own list, which lie together already."""
    p = pred.where(F.col("category") != RATING)
    marked = T.mark_threshold(p, st.general_threshold, st.character_threshold, st.general_mcut, st.character_mcut)
    ordered = "ord" in pred.columns         # else a tag's own text is its place: it need not move twice
    entry = F.struct("category", "tag", "score", "passes", *(["ord"] if ordered else []))
    files = marked.select("file_id", entry.alias("e")).groupBy("file_id").agg(F.collect_list("e").alias("_all"))

    def named(e):
        return replace_underscores(e["tag"]) if st.replace_underscores else e["tag"]

    def keyed(e):
        key = F.when(e["category"] == GENERAL, word_key(named(e))) if st.trim_general_tag_dupes else F.lit(None).cast("string")
        return F.struct(named(e).alias("tag"), e["ord" if ordered else "tag"].alias("o"), e["score"].alias("score"), key.alias("key"))
    files = files.select("file_id", "_all", F.transform(F.filter("_all", lambda e: e["passes"]), keyed).alias("_e"))
    if st.trim_general_tag_dupes:       # rows without a file contain no other's tags
        files = files.withColumn("_e", F.when(F.col("file_id").isNull(), F.col("_e")).otherwise(T.trim_tag_list(F.col("_e"))))
    kind, none = marked.schema["score"].dataType, F.lit(None)
    vocabulary = F.transform("_all", lambda e: F.struct(e["category"].alias("category"), named(e).alias("tag"), none.cast(kind).alias("score"),
                                                        F.lit(False).alias("kept")))
    kept = F.transform(T.ban_tags_list(F.col("_e"), st.ban_tags), lambda e: F.struct(
        none.cast("string").alias("category"), e["tag"].alias("tag"), e["score"].alias("score"), F.lit(True).alias("kept")))
    rows = files.select("file_id", F.explode(F.concat(vocabulary, kept)).alias("r"))
    found = rows.groupBy("file_id", F.col("r.tag").alias("tag")).agg(
        F.collect_set("r.category").alias("_in"), F.min("r.score").alias("score"), F.max("r.kept").alias("kept"))
    return found.where("kept").select("file_id", F.explode("_in").alias("category"), "tag", "score")


def tag_document_frequency(result: DataFrame, n: DataFrame) -> DataFrame:
    """Per (category, tag): files holding the tag / all processed files."""
    total = n.scalar()
    return (result.groupBy("category", "tag").agg(F.count(F.lit(1)).alias("k"))
            .select("category", "tag", (F.col("k") / total).alias("value")))


def rating_mean(pred: DataFrame, n: DataFrame) -> DataFrame:
    """Per rating: sum of scores / all processed files (absent counts as 0, so not ``avg``)."""
    total = n.scalar()
    r = pred.where(F.col("category") == RATING)
    return (r.groupBy(strip_rating_prefix(F.col("tag")).alias("tag")).agg(F.sum("score").alias("s"))
            .select(F.lit(RATING).alias("category"), "tag", (F.col("s") / total).alias("value")))


def tag_dataset(pred: DataFrame, st: TagSettings = TagSettings(), sidecars: DataFrame | None = None,
                edits: DataFrame | None = None, whitelist: list[str] | None = None,
                merge_existing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whole tagging job: ``(captions, statistics)``.

    Statistics rows are ``(category, tag, value)`` for rating means and general/character
    frequencies. Without ``sidecars``/``edits`` the captions are the model captions
    ``(file_id, caption)``; with them, every file's caption is merged with its human edits (merge
    base chosen per file from the stored edit and the sidecar caption, whitelist applied to the
    model's changes) and the result is ``(file_id, caption, merged, store_previous, store_new)``,
    the last two being the edit rows to upsert."""
    from tagloom.operators import merge as M
    n = n_files(pred)
    stats = tag_document_frequency(result_scores(pred, st), n).unionByName(rating_mean(pred, n))
    caps = captions(pred, st)
    if sidecars is None and edits is None:
        return caps, stats
    spark = pred.sparkSession
    side = sidecars if sidecars is not None else spark.createDataFrame([], "file_id long, caption string")
    ed = edits if edits is not None else spark.createDataFrame([], "file_id long, previous_edit string, new_edit string")
    base = M.choose_merge_base(caps, side, ed, merge_existing=merge_existing)
    merged = M.merge_captions(base, whitelist)
    return (merged.select("file_id", F.col("new").alias("caption"), "merged", "store_previous", "store_new"),
            stats)
