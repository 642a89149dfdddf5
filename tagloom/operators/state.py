"""Dataset state as keyed tables with natural keys (W4).

Tables
------
``cache(hash, repo_name, data, n_bytes)``         score cache, unique on (hash, repo_name)
``membership(dataset, hash)``                      which dataset used which file content
``history(seq, dataset)``                          runs, newest kept
``settings(dataset, key, value, seq)``             last write per (dataset, key) wins
``edits(dataset, hash, previous_edit, new_edit, seq)`` last write per (dataset, hash) wins

Writes are append + keyed reduction (``max_by``/``min_by`` over a sequence number), so concurrent
appends and out-of-order arrival give the same answer, and every reduction is a partial aggregate
(a hot key is combined map-side). Deletes are anti-joins producing the new table version.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


# ---- cache -----------------------------------------------------------------------------------

def insert_cache(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Insert-or-ignore: the first writer of a (hash, repo_name) wins. ``log`` carries
    ``(hash, repo_name, data, seq)``; rows already in ``existing`` are kept as they are."""
    new = (log.groupBy("hash", "repo_name")
           .agg(F.min_by("data", "seq").alias("data"))
           .withColumn("n_bytes", F.octet_length("data")))
    if existing is None:
        return new
    fresh = new.join(existing.select("hash", "repo_name"), ["hash", "repo_name"], "left_anti")
    return existing.unionByName(fresh)


def membership(log: DataFrame) -> DataFrame:
    """``(dataset, hash)`` pairs, insert-or-ignore; writes without a dataset are no member of any."""
    return log.where(F.col("dataset").isNotNull()).select("dataset", "hash").distinct()


def cache_lookup(files: DataFrame, cache: DataFrame, repo: str) -> DataFrame:
    """Cached scores of the files for one model: an inner equi-join on the content hash."""
    return files.join(cache.where(F.col("repo_name") == repo).select("hash", "data"), "hash")


def cache_misses(files: DataFrame, cache: DataFrame, repo: str) -> DataFrame:
    """Files without a cached score for the model (they go to the scorer)."""
    return files.join(cache.where(F.col("repo_name") == repo).select("hash"), "hash", "left_anti")


def cached_repos(cache: DataFrame) -> DataFrame:
    return cache.select("repo_name").distinct()


def usage_by_repo(cache: DataFrame) -> DataFrame:
    return cache.groupBy("repo_name").agg(F.sum("n_bytes").alias("bytes"))


def _attributed(cache: DataFrame, members: DataFrame) -> DataFrame:
    """Cache rows with the datasets that use them; unattributed rows get ``UNKNOWN``. A row shared
    by several datasets appears once per dataset."""
    return (cache.join(members, "hash", "left")
            .withColumn("dataset", F.coalesce(F.col("dataset"), F.lit(UNKNOWN))))


def cached_datasets(cache: DataFrame, members: DataFrame) -> DataFrame:
    return _attributed(cache, members).select("dataset").distinct()


def usage_by_dataset(cache: DataFrame, members: DataFrame) -> DataFrame:
    return _attributed(cache, members).groupBy("dataset").agg(F.sum("n_bytes").alias("bytes"))


def exclusive_hashes(members: DataFrame, dataset: str) -> DataFrame:
    """Hashes used by ``dataset`` and by no other dataset (min = max avoids a distinct count)."""
    return (members.groupBy("hash")
            .agg(F.min("dataset").alias("lo"), F.max("dataset").alias("hi"))
            .where((F.col("lo") == dataset) & (F.col("hi") == dataset))
            .select("hash"))


def drop_cache_by_repo(cache: DataFrame, repo: str) -> DataFrame:
    """New cache version without one model's rows (a partition drop when partitioned by repo)."""
    return cache.where(F.col("repo_name") != repo)


def drop_dataset(dataset: str | None, *tables: DataFrame) -> list[DataFrame]:
    """The rest of a dataset's deletion: its rows in every table keyed by ``dataset`` (the list of datasets, history,
    settings, edits) go with it. ``None`` matches nothing; rows without a dataset stay."""
    if dataset is None:
        return list(tables)
    return [t.where(~F.col("dataset").eqNullSafe(dataset)) for t in tables]


def drop_cache_by_dataset(cache: DataFrame, members: DataFrame, dataset: str | None) -> tuple[DataFrame, DataFrame]:
    """Delete the cache rows used only by ``dataset``, then the dataset's memberships (``drop_dataset`` deletes its rows
    in the other tables). ``None`` (an unattributed selection) matches nothing. Returns ``(cache, membership)``."""
    if dataset is None:
        return cache, members
    gone = exclusive_hashes(members, dataset)
    return (cache.join(gone, "hash", "left_anti"),
            members.where(F.col("dataset") != dataset))


# ---- the cache as a table with a partition per model ------------------------------------------

CACHE_SCHEMA = "hash string, data string, n_bytes int, repo_name string"


def write_cache(cache: DataFrame, path: str) -> None:
    """The cache as Parquet, one partition per model: a model's deletion touches its own files alone."""
    cache.select("hash", "data", "n_bytes", "repo_name").repartition("repo_name", F.xxhash64("hash") % 16).write.partitionBy("repo_name").parquet(path)


def read_cache(spark, path: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def drop_repo_partition(spark, path: str, repo: str) -> bool:
    """Delete one model's rows in place: its partition is overwritten by an empty one; no other file is read or written.
    False if the table has no such model."""
    rows = read_cache(spark, path)
    at = rows.where(F.col("repo_name") == repo).select("_metadata.file_path").limit(1).collect()
    if not at:
        return False
    folder = unquote(at[0]["file_path"]).rpartition("/")[0]
    spark.createDataFrame([], rows.drop("repo_name").schema).write.mode("overwrite").parquet(folder)
    return True


def drop_dataset_rows(spark, path: str, members: DataFrame, dataset: str | None) -> list[str]:
    """Delete the rows that only ``dataset`` uses, in place: the partitions of the models that have such rows are written anew (a
    dynamic partition overwrite), the others stay as they are. Returns those models: at most all of them, a short list."""
    if dataset is None:
        return []
    gone = exclusive_hashes(members, dataset)
    rows = read_cache(spark, path)
    touched = [r["repo_name"] for r in rows.join(gone, "hash", "left_semi").select("repo_name").distinct().collect()]
    kept = rows.where(F.col("repo_name").isin(touched)).join(gone, "hash", "left_anti")
    left = {r["repo_name"] for r in kept.select("repo_name").distinct().collect()}
    if left:
        kept.select(*rows.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(path)
    for repo in set(touched) - left:
        drop_repo_partition(spark, path, repo)
    return sorted(touched)


# ---- history ---------------------------------------------------------------------------------

def record_run(history: DataFrame, dataset: str, seq: int | None = None, keep: int = 10) -> DataFrame:
    """Append a run (by default with the next sequence number) and keep the newest ``keep`` runs."""
    nxt = F.coalesce(F.max("seq"), F.lit(0)) + 1 if seq is None else F.lit(seq)
    run = history.agg(nxt.cast("long").alias("seq")).select("seq", F.lit(dataset).alias("dataset"))
    return history_trim(history.select("seq", "dataset").unionByName(run), keep)


def history_trim(history: DataFrame, keep: int = 10) -> DataFrame:
    """Newest ``keep`` runs overall (a top-k: TakeOrderedAndProject, no global sort)."""
    return history.orderBy(F.col("seq").desc()).limit(keep)


def datasets(*logs: DataFrame) -> DataFrame:
    """Known datasets with the sequence number of their first appearance."""
    u = None
    for lg in logs:
        part = lg.select("dataset", "seq")
        u = part if u is None else u.unionByName(part)
    return u.where(F.col("dataset").isNotNull()).groupBy("dataset").agg(F.min("seq").alias("first_seq"))


def recent_datasets(known: DataFrame, history: DataFrame, n: int = 10) -> DataFrame:
    """Datasets by latest run (never-run ones last, then newest first): ``(dataset, last_run)``."""
    last = history.groupBy("dataset").agg(F.max("seq").alias("last_run"))
    j = known.join(last, "dataset", "left")
    return (j.orderBy(F.col("last_run").desc_nulls_last(), F.col("first_seq").desc(), "dataset").limit(n)
            .select("dataset", "last_run"))


# ---- settings and edits ----------------------------------------------------------------------

def upsert_settings(log: DataFrame) -> DataFrame:
    """Replace on ``(dataset, key)``: the value of the highest ``seq`` wins."""
    return log.groupBy("dataset", "key").agg(F.max_by("value", "seq").alias("value"))


def get_setting(settings: DataFrame, dataset: str, key: str, default: str | None = None) -> DataFrame:
    """One row ``(dataset, key, value)``; ``default`` when the key was never written."""
    spark = settings.sparkSession
    want = spark.createDataFrame([(dataset, key)], "dataset string, key string")
    got = settings.where((F.col("dataset") == dataset) & (F.col("key") == key))
    return (want.join(got, ["dataset", "key"], "left")
            .select("dataset", "key", F.coalesce(F.col("value"), F.lit(default)).alias("value")))


def upsert_edit(log: DataFrame) -> DataFrame:
    """Replace on ``(dataset, hash)``: the edit pair of the highest ``seq`` wins."""
    return (log.groupBy("dataset", "hash")
            .agg(F.max_by(F.struct("previous_edit", "new_edit"), "seq").alias("e"))
            .select("dataset", "hash", "e.previous_edit", "e.new_edit"))


def edit_lookup(edits: DataFrame, dataset: str, hash_hex: str) -> DataFrame:
    return edits.where((F.col("dataset") == dataset) & (F.col("hash") == hash_hex)) \
        .select("previous_edit", "new_edit")


# ---- maintenance -----------------------------------------------------------------------------

def compact_table(spark, path: str, out_path: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a parquet table into files of about ``file_bytes`` (the re-aim of a database vacuum): as many as its
    stored bytes ask for, each written by a task of its own. Checks that the row count is unchanged and returns it.
    Writes to a new location: the caller swaps the table pointer, so a failed job leaves the old version intact."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stored = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    df = spark.read.parquet(path)
    n = df.count()
    df.repartition(max(1, -(-stored // file_bytes))).write.mode("overwrite").parquet(out_path)
    m = spark.read.parquet(out_path).count()
    if m != n:
        raise RuntimeError(f"compaction changed the row count: {n} -> {m}")
    return n


# ---- typed dataset settings -----------------------------------------------------------------

# The per-dataset setting keys and their types.
SETTING_TYPES = {
    "model_repo": "string", "general_thresh": "double", "character_thresh": "double",
    "replace_underscores": "bool", "trim_general_tag_dupes": "bool", "escape_brackets": "bool",
    "overwrite_current_caption": "bool", "merge_existing_captions": "bool", "prefix_tags": "string",
    "keep_tags": "string", "ban_tags": "string", "map_tags": "string", "whitelist_tags": "string",
    "whitelist_tag_group": "string",
}
SETTING_DEFAULTS = {"general_thresh": 0.35, "character_thresh": 0.9, "replace_underscores": True,
                    "trim_general_tag_dupes": True, "escape_brackets": False}


def typed_settings(settings: DataFrame) -> DataFrame:
    """One row per dataset with one typed column per known key (latest value; NULL when never
    saved). A pivot over the fixed key list: no driver round trip. Booleans are saved as
    ``'True'``/``'False'`` and read back by comparing with ``'True'`` (for every key, including
    ``escape_brackets``)."""
    latest = upsert_settings(settings.where(F.col("key").isin(list(SETTING_TYPES))))
    wide = latest.groupBy("dataset").pivot("key", list(SETTING_TYPES)).agg(F.first("value"))
    cols = [F.col("dataset")]
    for k, t in SETTING_TYPES.items():
        c = F.col(k)
        cols.append((c == "True").alias(k) if t == "bool" else c.cast(t).alias(k) if t == "double" else c.alias(k))
    return wide.select(*cols)


def tag_settings_for(typed: DataFrame, dataset: str):
    """``TagSettings`` of one dataset (its single row of configuration), defaults for unsaved keys."""
    from tagloom.operators.tags import TagSettings
    row = typed.where(F.col("dataset") == dataset).limit(1).collect()
    vals = row[0].asDict() if row else {}

    def get(k):
        v = vals.get(k)
        return SETTING_DEFAULTS.get(k) if v is None else v
    return TagSettings(general_threshold=get("general_thresh"), character_threshold=get("character_thresh"),
                       replace_underscores=get("replace_underscores"),
                       trim_general_tag_dupes=get("trim_general_tag_dupes"),
                       escape_brackets=get("escape_brackets"), prefix_tags=get("prefix_tags") or None,
                       keep_tags=get("keep_tags") or None, ban_tags=get("ban_tags") or None,
                       map_tags=get("map_tags") or None)
