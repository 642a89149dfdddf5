"""SparkSession construction and cluster-safe helpers."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (a side only becomes a
# broadcast when its measured size is under the threshold), coalesces small shuffle partitions and
# splits skewed ones.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a sort-merge join becomes a shuffled hash join only when every post-shuffle partition measures
    # under this size (a runtime check; large partitions keep the sort-merge join, which can spill)
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tagloom", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("TAGLOOM_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local test session without one
    gets a scratch folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext on the client
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tagloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        sc.setCheckpointDir(d)
    return d


SORTED_ROWS = 2_000_000         # of a sorted table that one task sorts


#: Spark then drops the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind: what a written table was made from is on disk only meanwhile."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def by_range(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` of about ``rows`` rows in ranges of the columns, as many as keep the sort of each small."""
    ranges = -(-rows // SORTED_ROWS)
    many = [max(ranges, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if ranges > 1 else []
    return df.repartitionByRange(*many, *cols)


def delete_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more, through its own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, name: str, sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet under the shared checkpoint folder, in a folder for each value of ``partition_by``; returns the path."""
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    out = df
    with shuffles_dropped(spark):
        if sort_by:
            # written as it comes first: the sample that cuts the ranges would compute it a second time, and its rows say how
            # many ranges keep each task's sort small
            df.write.mode("overwrite").parquet(f"{path}-unsorted")
            out = spark.read.parquet(f"{path}-unsorted")
            out = by_range(out, out.count(), *sort_by).sortWithinPartitions(*sort_by)
        out.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    if sort_by:
        delete_table(spark, f"{path}-unsorted")
    return path


def materialize(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Used where one job reads an expensive intermediate several times (an index scanned by a query
    and by its statistics): the written table cuts the lineage, survives executor loss, and its
    reads get filter pushdown (``sort_by`` clusters the rows so a pushed ``IN`` prunes row groups)."""
    return df.sparkSession.read.parquet(write_table(df, name, sort_by))


_TABLES: dict[tuple, str] = {}


def _input_signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and time of every file below the paths, as their own file system lists them: a file that is added,
    replaced or removed anywhere in an input gives another signature, on any store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    sig = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            found = fs.listFiles(at, True)
            while found.hasNext():
                f = found.next()
                sig.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(sig))


def write_once(spark: SparkSession, name: str, inputs: list[str], build, sort_by: list[str] | None = None) -> str:
    """Path of the table ``build()``, written once per application and input version.

    The prediction table and the search index are, in production, tables that one job writes and
    every later job reads; this keeps that shape inside one application. The key holds the input
    files' path, size and modification time, so changed inputs are rebuilt."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        app = spark.conf.get("spark.app.id", "connect")
    key = (app, name, _input_signature(spark, inputs), tuple(sort_by or ()))
    path = _TABLES.get(key)
    if path is not None:
        try:
            spark.read.parquet(path)
            return path
        except Exception:  # noqa: BLE001 - table gone (folder cleaned): rebuild
            _TABLES.pop(key, None)
    _TABLES[key] = write_table(build(), name, sort_by)
    return _TABLES[key]


def materialize_once(spark: SparkSession, name: str, inputs: list[str], build, sort_by: list[str] | None = None
                     ) -> DataFrame:
    """The table of :func:`write_once`, read back."""
    return spark.read.parquet(write_once(spark, name, inputs, build, sort_by))
