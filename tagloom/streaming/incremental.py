"""Structured Streaming versions of the incremental state jobs.

Re-running a folder only scores content that is not cached yet (first writer wins). As a stream: new score rows arrive as files,
and keyed state (a streaming aggregation) remembers the earliest write of every (hash, repo_name) and when it arrived. New
keys, and writes that turn out to be earlier, are appended as the batch's version; repeats are not. No batch reads what
earlier ones wrote. The state expires by windows of ``expiry`` over the time of arrival: a repeat in a later window is
appended once more, and the reader takes the earliest write per key, so results never depend on the expiry or on the order
in which files arrive. A replayed batch overwrites its own version.

Paths live under the cluster's shared ``spark.checkpoint.dir`` (never a machine-local folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.state import insert_cache
from tagloom.session import ensure_checkpoint_dir
from tagloom.sources.tables import SCHEMAS


def _work_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _cache_rows(events: DataFrame) -> DataFrame:
    h = F.sha2(F.concat(F.get_json_object("props", "$.k"), F.lit(":"), F.col("user_id").cast("string")), 256)
    return events.select(h.alias("hash"), F.col("event_type").alias("repo_name"), F.concat_ws("#", "props", F.col("event_id").cast("string")).alias("data"),
                         F.col("event_id").alias("seq"))


_SCORE_ROW = "hash string, repo_name string, data string, seq bigint"
EXPIRY = "7 days"


def stream_incremental_scores(spark: SparkSession, source_dir: str, table_path: str | None = None,
                              max_files_per_trigger: int = 1, glob: str = "events*.parquet", expiry: str = EXPIRY) -> str:
    """Run the incremental cache fill over every file in ``source_dir`` (events schema) until no
    input is left (``availableNow``); returns the path of the versions, which :func:`streamed_scores` reads."""
    table_path = table_path or _work_dir(spark, "cache")
    ckpt = table_path + "_ckpt"

    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch's keys: those whose earliest write arrived just now are new or corrected, the others were written before
        fresh = batch.where(F.col("first.arrived") == F.col("last"))
        fresh.select("hash", "repo_name", "first.data", "first.seq").write.mode("overwrite").parquet(f"{table_path}/version={batch_id}")

    src = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", glob).parquet(source_dir))
    # time of arrival, the same for all rows of a batch: no row is ever late, only the state's expiry looks at it
    rows = _cache_rows(src).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 minute")
    firsts = (rows.groupBy(F.window("arrived", expiry), "hash", "repo_name")
              .agg(F.min(F.struct("seq", "arrived", "data")).alias("first"), F.max("arrived").alias("last")))
    q = (firsts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table_path


def streamed_scores(spark: SparkSession, table_path: str) -> DataFrame:
    """``(hash, repo_name, data, n_bytes)`` from the stream's versions: the earliest write of each key."""
    rows = spark.read.schema(_SCORE_ROW + ", version bigint").parquet(table_path)
    return insert_cache(rows)


def stream_latest_settings(spark: SparkSession, source_dir: str, table_path: str | None = None,
                           glob: str = "events*.parquet") -> str:
    """Last write per (dataset, key) as a streaming aggregation (``max_by`` over the sequence
    number, so arrival order does not matter); returns the table's path.

    Every trigger writes the keys that changed as a version of its own, numbered by its batch; a version is complete
    before a reader can be sent to it (``latest_settings``), and no version is overwritten while it may be read."""
    table_path = table_path or _work_dir(spark, "settings")
    ckpt = table_path + "_ckpt"
    src = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", glob).parquet(source_dir)
    log = src.select(F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("dataset"),
                     F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                     F.col("event_id").alias("seq"))
    agg = log.groupBy("dataset", "key").agg(F.max_by("value", "seq").alias("value"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/version={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table_path


def latest_settings(spark: SparkSession, table_path: str) -> DataFrame:
    """``(dataset, key, value)`` from the stream's versions: per key the one of the newest version."""
    rows = spark.read.parquet(table_path)
    return rows.groupBy("dataset", "key").agg(F.max_by("value", "version").alias("value"))
