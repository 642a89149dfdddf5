"""Registered queries of the dataset-state workload (W4)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import state as S
from tagloom.plans.oracle import with_
from tagloom.plans.registry import register
from tagloom.session import ensure_checkpoint_dir
from tagloom.sources import fixtures as X

# Fixed query parameters.
DATASET = "ds3"
REPO = "click"
SETTING = ("ds1", "click")
MISSING_SETTING = ("ds1", "no_such_key")
EDIT_DATASET = "ds2"
EDIT_USER = "7"

CACHE_CTES = """,
cache AS (SELECT hash, repo_name, arg_min(data, seq) AS data, CAST(strlen(arg_min(data, seq)) AS INTEGER) AS n_bytes
          FROM cache_log GROUP BY hash, repo_name),
mem AS (SELECT DISTINCT dataset, hash FROM cache_log WHERE dataset IS NOT NULL)"""


def _cache(spark, d):
    return S.insert_cache(X.cache_log(spark, d))


def _mem(spark, d):
    return S.membership(X.cache_log(spark, d))


@register("insert_cache", with_("cache_log", extra=CACHE_CTES[2:]) + "SELECT hash, repo_name, data, n_bytes FROM cache")
def q_insert_cache(spark, d):
    return _cache(spark, d)


@register("insert_cache_existing", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
, old AS (SELECT * FROM cache WHERE repo_name <> '{REPO}')
SELECT hash, repo_name, data, n_bytes FROM old
UNION ALL
SELECT c.hash, c.repo_name, c.data, c.n_bytes FROM cache c
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.hash = c.hash AND o.repo_name = c.repo_name)""")
def q_insert_existing(spark, d):
    """Insert into a non-empty table: existing rows win, only unseen keys are appended."""
    full = _cache(spark, d)
    old = full.where(F.col("repo_name") != REPO)
    return S.insert_cache(X.cache_log(spark, d), existing=old)


@register("cache_lookup", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT m.dataset, m.hash, c.data FROM mem m JOIN cache c ON c.hash = m.hash
WHERE m.dataset = '{DATASET}' AND c.repo_name = '{REPO}'""")
def q_cache_lookup(spark, d):
    files = _mem(spark, d).where(F.col("dataset") == DATASET)
    return S.cache_lookup(files, _cache(spark, d), REPO).select("dataset", "hash", "data")


@register("cache_misses", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT m.dataset, m.hash FROM mem m WHERE m.dataset = '{DATASET}'
AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.hash = m.hash AND c.repo_name = '{REPO}')""")
def q_cache_misses(spark, d):
    files = _mem(spark, d).where(F.col("dataset") == DATASET)
    return S.cache_misses(files, _cache(spark, d), REPO).select("dataset", "hash")


@register("cached_repos", with_("cache_log", extra=CACHE_CTES[2:]) + "SELECT DISTINCT repo_name FROM cache")
def q_cached_repos(spark, d):
    return S.cached_repos(_cache(spark, d))


@register("usage_by_repo", with_("cache_log", extra=CACHE_CTES[2:]) + """
SELECT repo_name, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM cache GROUP BY repo_name""")
def q_usage_repo(spark, d):
    return S.usage_by_repo(_cache(spark, d))


@register("cached_datasets", with_("cache_log", extra=CACHE_CTES[2:]) + """
SELECT DISTINCT coalesce(m.dataset, 'UNKNOWN') AS dataset FROM cache c LEFT JOIN mem m ON m.hash = c.hash""")
def q_cached_datasets(spark, d):
    return S.cached_datasets(_cache(spark, d), _mem(spark, d))


@register("usage_by_dataset", with_("cache_log", extra=CACHE_CTES[2:]) + """
SELECT coalesce(m.dataset, 'UNKNOWN') AS dataset, CAST(sum(c.n_bytes) AS BIGINT) AS bytes
FROM cache c LEFT JOIN mem m ON m.hash = c.hash GROUP BY coalesce(m.dataset, 'UNKNOWN')""")
def q_usage_dataset(spark, d):
    return S.usage_by_dataset(_cache(spark, d), _mem(spark, d))


EXCL = f"""SELECT hash FROM mem GROUP BY hash
HAVING count(DISTINCT dataset) = 1 AND bool_or(dataset = '{DATASET}')"""


@register("exclusive_hashes", with_("cache_log", extra=CACHE_CTES[2:]) + EXCL)
def q_exclusive(spark, d):
    return S.exclusive_hashes(_mem(spark, d), DATASET)


@register("drop_cache_by_dataset", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT hash, repo_name FROM cache WHERE hash NOT IN ({EXCL})""")
def q_drop_dataset(spark, d):
    c, _ = S.drop_cache_by_dataset(_cache(spark, d), _mem(spark, d), DATASET)
    return c.select("hash", "repo_name")


@register("drop_membership_by_dataset", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT dataset, hash FROM mem WHERE dataset <> '{DATASET}'""")
def q_drop_members(spark, d):
    _, m = S.drop_cache_by_dataset(_cache(spark, d), _mem(spark, d), DATASET)
    return m


@register("drop_dataset_rows", with_("history_log", "edit_log", "settings_log") + f"""
SELECT 'history' AS of, dataset, count(*) AS n FROM history_log WHERE dataset <> '{DATASET}' GROUP BY dataset
UNION ALL SELECT 'edits', dataset, count(DISTINCT hash) FROM edit_log WHERE dataset <> '{DATASET}' GROUP BY dataset
UNION ALL SELECT 'settings', dataset, count(DISTINCT key) FROM settings_log WHERE dataset <> '{DATASET}' GROUP BY dataset""")
def q_drop_dataset_rows(spark, d):
    """What a dataset's deletion leaves in the history, the edits and the settings (rows per dataset)."""
    left = S.drop_dataset(DATASET, X.history_log(spark, d), S.upsert_edit(X.edit_log(spark, d)), S.upsert_settings(X.settings_log(spark, d)))
    return functools.reduce(DataFrame.unionByName, [
        t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select(F.lit(of).alias("of"), "dataset", "n")
        for of, t in zip(("history", "edits", "settings"), left)])


@register("drop_cache_by_repo", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT hash, repo_name FROM cache WHERE repo_name <> '{REPO}'""")
def q_drop_repo(spark, d):
    return S.drop_cache_by_repo(_cache(spark, d), REPO).select("hash", "repo_name")


def _written_cache(spark, d):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/cache-{uuid.uuid4().hex}"
    S.write_cache(_cache(spark, d), path)
    return path


@register("drop_repo_partition", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT hash, repo_name FROM cache WHERE repo_name <> '{REPO}'""")
def q_drop_partition(spark, d):
    """A model's rows deleted in place from the written cache: its partition alone is overwritten."""
    path = _written_cache(spark, d)
    S.drop_repo_partition(spark, path, REPO)
    return S.read_cache(spark, path).select("hash", "repo_name")


@register("drop_dataset_partitions", with_("cache_log", extra=CACHE_CTES[2:]) + f"""
SELECT hash, repo_name FROM cache WHERE hash NOT IN ({EXCL})""")
def q_drop_dataset_partitions(spark, d):
    """A dataset's own rows deleted in place from the written cache: the partitions that hold such rows are overwritten."""
    path = _written_cache(spark, d)
    S.drop_dataset_rows(spark, path, _mem(spark, d), DATASET)
    return S.read_cache(spark, path).select("hash", "repo_name")


@register("history_trim", with_("history_log") + "SELECT seq, dataset FROM history_log ORDER BY seq DESC LIMIT 10")
def q_history_trim(spark, d):
    return S.history_trim(X.history_log(spark, d))


@register("record_run", with_("history_log") + """
SELECT seq, dataset FROM (SELECT seq, dataset FROM history_log
                          UNION ALL SELECT (SELECT max(seq) + 1 FROM history_log), 'ds_new') u
ORDER BY seq DESC LIMIT 10""")
def q_record_run(spark, d):
    """Append one run (next sequence number) and trim to the newest ten."""
    return S.record_run(X.history_log(spark, d), "ds_new")


@register("recent_datasets", with_("history_log", "cache_log") + """,
known AS (SELECT dataset, min(seq) AS first_seq FROM (SELECT dataset, seq FROM cache_log
                                                       UNION ALL SELECT dataset, seq FROM history_log) u
          WHERE dataset IS NOT NULL GROUP BY dataset),
h AS (SELECT seq, dataset FROM history_log ORDER BY seq DESC LIMIT 10),
last AS (SELECT dataset, max(seq) AS last_run FROM h GROUP BY dataset)
SELECT k.dataset, l.last_run FROM known k LEFT JOIN last l ON l.dataset = k.dataset
ORDER BY l.last_run DESC NULLS LAST, k.first_seq DESC, k.dataset LIMIT 10""")
def q_recent(spark, d):
    known = S.datasets(X.cache_log(spark, d), X.history_log(spark, d))
    return S.recent_datasets(known, S.history_trim(X.history_log(spark, d)))


@register("upsert_settings", with_("settings_log") + """
SELECT dataset, key, arg_max(value, seq) AS value FROM settings_log GROUP BY dataset, key""")
def q_settings(spark, d):
    return S.upsert_settings(X.settings_log(spark, d))


def _get_setting_sql(dataset, key, default):
    dflt = "NULL" if default is None else f"'{default}'"
    return with_("settings_log") + f""",
s AS (SELECT dataset, key, arg_max(value, seq) AS value FROM settings_log GROUP BY dataset, key)
SELECT w.dataset, w.key, coalesce(s.value, {dflt}) AS value
FROM (SELECT '{dataset}' AS dataset, '{key}' AS key) w LEFT JOIN s ON s.dataset = w.dataset AND s.key = w.key"""


@register("get_setting", _get_setting_sql(*SETTING, "0"))
def q_get_setting(spark, d):
    return S.get_setting(S.upsert_settings(X.settings_log(spark, d)), *SETTING, default="0")


@register("get_setting_default", _get_setting_sql(*MISSING_SETTING, "0.35"))
def q_get_setting_default(spark, d):
    return S.get_setting(S.upsert_settings(X.settings_log(spark, d)), *MISSING_SETTING, default="0.35")


@register("upsert_edit", with_("edit_log") + """
SELECT dataset, hash, arg_max(previous_edit, seq) AS previous_edit, arg_max(new_edit, seq) AS new_edit
FROM edit_log GROUP BY dataset, hash""")
def q_upsert_edit(spark, d):
    return S.upsert_edit(X.edit_log(spark, d))


@register("edit_lookup", with_("edit_log") + f"""
SELECT arg_max(previous_edit, seq) AS previous_edit, arg_max(new_edit, seq) AS new_edit
FROM edit_log WHERE dataset = '{EDIT_DATASET}' AND hash = sha256('{EDIT_USER}')
GROUP BY dataset, hash""")
def q_edit_lookup(spark, d):
    return S.edit_lookup(S.upsert_edit(X.edit_log(spark, d)), EDIT_DATASET,
                         __import__("hashlib").sha256(EDIT_USER.encode()).hexdigest())
