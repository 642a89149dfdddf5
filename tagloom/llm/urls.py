"""URL filters: nested host rules found by one sorted sweep.

A host's labels, reversed and each ended by a comma, are its canonical key: ``m.example.org`` -> ``org,example,m,``.
A rule's host covers exactly the keys that begin with its own key, an interval [key, key + largest character). Two such
intervals are nested or apart, so in key order the active rules form a stack. Rules and page hosts are merged in key
order; at a rule's begin the stack is its ancestors and itself, behind its end its ancestors again, and a page takes
the stack of the nearest event before it. The path decides among the rules on the stack; the longest text wins.

The merge is a shuffle by salt and a sort: each salt holds all rule events (refused above a documented number) and a
share of the distinct page hosts, so a host with a third of all pages is one row. DataFrame functions only.

Null urls, and those without ``://``, have an empty host and path and fit no rule; pages that no rule fits are
allowed. Rules with a null part are left out; of equal (host, path) with both verdicts, block wins. Repeated pages
give repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import kept_table

MAX_RULES = 1_000_000       # every salt gets all rule events
LAST = "\U0010ffff"         # sorts behind every key that continues a prefix
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty when it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a comma, which sorts before every character of a label's continuation. Commas
    backslashes and the last character of the host itself are escaped."""
    safe = F.replace(F.replace(F.replace(host, F.lit("\\"), F.lit("\\b")), F.lit(","), F.lit("\\c")), F.lit(LAST), F.lit("\\z"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), ","), F.lit(","))


def rule_events(rules: DataFrame) -> DataFrame:
    """``key, order, stack`` per interval end: the stack of rules (outermost first) that is active from there on."""
    r = (rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))     # 'block' > 'allow'
    hosts = (r.withColumn("key", host_key(F.col("host"))).groupBy("key")
             .agg(F.sort_array(F.collect_list(F.struct("host", "path", "verdict"))).alias("own")))
    labels = F.slice(F.split("key", ",", -1), 1, F.size(F.split("key", ",", -1)) - 1)
    begins = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), ","), F.lit(",")))
    up = (hosts.select("key", F.explode(begins).alias("above"))
          .join(hosts.select(F.col("key").alias("above"), "own"), "above")
          .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.length("above").alias("depth"), "above", "own"))).alias("chain")))
    rules_of = lambda chain: F.flatten(F.transform(chain, lambda x: x["own"]))
    up = up.select("key", rules_of(F.col("chain")).alias("stack"),
                   rules_of(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("below"))    # the last is itself
    return (up.select("key", F.lit(0).alias("order"), "stack")
            .union(up.select(F.concat("key", F.lit(LAST)), 1 - F.length("key"), "below")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", salts: int | None = None) -> DataFrame:
    """``id_col, host, path, rule, verdict`` per page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    events = kept_table(rule_events(rules), "rule-events")
    if events.count() > 2 * MAX_RULES:
        raise ValueError("too many rules for a sweep in which every salt holds all of them")
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hosts = rows.select("host").distinct()
    swept = (hosts.select(F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int").alias("salt"), host_key(F.col("host")).alias("key"),
                          F.lit(2).alias("order"), F.lit(None).cast(events.schema["stack"].dataType).alias("stack"), "host")
             .unionByName(events.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "order",
                                        "stack", F.lit(None).cast("string").alias("host"))))
    # equal keys: ends (inner ones first) before begins before pages
    w = Window.partitionBy("salt").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, 0)
    found = (swept.withColumn("stack", F.last("stack", ignorenulls=True).over(w)).filter("host is not null")
             .select("host", "stack"))
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(F.concat(r["host"], r["path"])).alias("size"), F.length(r["host"]).alias("labels"),
        r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return (rows.join(found, "host", "left").withColumn("best", best)
            .select(F.col("page").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
