"""Input views derived from the driver tables.

The driver tables carry no images, tags or wiki markup, so the inputs of the tagging, search and
state workloads are derived from them by plain joins and projections (FIXTURES.md §3). Every view is
lazy and grows with the tables it reads. The SQL twin of each view lives in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import write_once
from tagloom.sources.tables import table


def tags_raw(spark: SparkSession, d: str) -> DataFrame:
    """Popularity table ``(name, post_count)``; names repeat (max wins downstream)."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return (p.join(li, li.l_partkey == p.p_partkey, "left")
            .groupBy("p_partkey", "p_name")
            .agg(F.count("l_orderkey").cast("int").alias("post_count"))
            .select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"), "post_count"))


def wiki_raw(spark: SparkSession, d: str) -> DataFrame:
    """Wiki page table ``(id, title, body)``; titles carry namespaces and qualifiers."""
    docs = _spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    title = F.concat(
        F.when(F.col("source") == "src0", F.lit("help:")).when(F.col("source") == "src1", F.lit("api:"))
        .otherwise(F.lit("")),
        F.coalesce(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.concat(F.lit("page_"), F.col("doc_id").cast("string"))),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_("), F.col("source"), F.lit(")"))).otherwise(F.lit("")))
    return (docs.join(p, p.p_partkey == docs.doc_id, "left")
            .select(F.col("doc_id").cast("int").alias("id"), title.alias("title"), F.col("text").alias("body")))


def tag_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tag-group vocabulary ``(tag, tag_group)``."""
    return (table(spark, d, "part")
            .select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("tag"), F.lower("p_type").alias("tag_group"))
            .distinct())


def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Model label vocabulary ``(idx, name, category)``, one label per position of the score
    vectors (width read from the data). Category codes: 9 rating, 0 general, 4 character. (The
    driver's own ``labels`` table is a different thing: document quality labels.)"""
    e = table(spark, d, "embeddings").select("embedding")
    idx = F.col("idx")
    width = e.select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("idx")).distinct()
    return width.select(
        idx.cast("long").alias("idx"),
        F.concat(F.when(idx < 4, F.lit("rating_")).otherwise(F.lit("tag_")), idx.cast("string")).alias("name"),
        F.when(idx < 4, 9).when(idx < 52, 0).otherwise(4).alias("category"))


def score_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs ``(vec_id, scores array<double>)`` aligned with the label vocabulary."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    sig = F.transform("embedding", lambda x: F.round(1 / (1 + F.exp(-10 * x.cast("double"))), 6))
    return e.select("vec_id", sig.alias("scores"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Per-file predictions in long form ``(file_id, category, tag, score)``.

    One row per (file, category, tag), max score over three derivations from ``lineitem ⨝ part``."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_tax", "l_quantity",
                                            "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    # the tables meet once, and a file's rows move once, as the columns that they have, before they become three derivations
    # each: an exploded list of numbers picks their columns (a generator over an array of structs evaluates them interpreted)
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("file_id"), "p_name", (F.col("p_type") == "PROMO").alias("promo"), "l_discount", "l_tax",
        "l_quantity", "l_returnflag").repartition("file_id").select(
        "file_id", F.when(F.col("promo"), "character").otherwise("general").alias("c1"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("t1"),
        F.round(F.col("l_discount") * 10, 2).alias("s1"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("t2"),
        F.round(1 - F.col("l_tax") * 10, 2).alias("s2"),
        F.concat(F.lit("rating_"), F.lower("l_returnflag")).alias("t3"),
        F.round(F.col("l_quantity") / 50, 2).alias("s3"))
    n = F.col("n")

    def pick(first, second, third):
        return F.when(n == 1, first).when(n == 2, second).otherwise(third)
    u = j.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "file_id", pick(F.col("c1"), F.lit("general"), F.lit("rating")).alias("category"),
        pick(F.col("t1"), F.col("t2"), F.col("t3")).alias("tag"), pick(F.col("s1"), F.col("s2"), F.col("s3")).alias("score"))
    return u.groupBy("file_id", "category", "tag").agg(F.max("score").alias("score"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Dataset files ``(file_id, hash, n_bytes)``: content-addressed by sha256."""
    pg = table(spark, d, "pages").select("page_id", "html")
    return pg.select(F.col("page_id").alias("file_id"), F.sha2("html", 256).alias("hash"),
                     F.octet_length("html").alias("n_bytes"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar captions ``(file_id, caption)``, one per order. A fifth of them belong to files of the dataset (every
    tenth of those is empty); the others lie beside files that it doesn't hold (negative ids)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    return o.select(F.when(key % 5 == 0, key).otherwise(-key).alias("file_id"),
                    F.when(key % 50 == 5, "").otherwise(F.concat_ws(", ", F.lit("edited"), F.lower("o_orderpriority"))).alias("caption"))


def cache_log(spark: SparkSession, d: str) -> DataFrame:
    """Score-cache write log ``(hash, repo_name, dataset, data, seq)``: every write has data of its own; those of some
    users come from no dataset (null)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    h = F.sha2(F.concat(F.get_json_object("props", "$.k"), F.lit(":"), F.col("user_id").cast("string")), 256)
    return ev.select(h.alias("hash"), F.col("event_type").alias("repo_name"),
                     F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("ds"), (F.col("event_id") % 7).cast("string"))).alias("dataset"),
                     F.concat_ws("#", "props", F.col("event_id").cast("string")).alias("data"), F.col("event_id").alias("seq"))


def history_log(spark: SparkSession, d: str) -> DataFrame:
    """Run log ``(seq, dataset)``."""
    ev = table(spark, d, "events").select("event_id")
    return ev.select(F.col("event_id").alias("seq"),
                     F.concat(F.lit("ds"), (F.col("event_id") * F.col("event_id") % 23).cast("string")).alias("dataset"))


def settings_log(spark: SparkSession, d: str) -> DataFrame:
    """Settings write log ``(dataset, key, value, seq)``."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return ev.select(F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("dataset"),
                     F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                     F.col("event_id").alias("seq"))


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Manual-edit write log ``(dataset, hash, previous_edit, new_edit, seq)``."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    return ev.select(F.concat(F.lit("ds"), (F.col("event_id") % 7).cast("string")).alias("dataset"),
                     F.sha2(F.col("user_id").cast("string"), 256).alias("hash"),
                     F.col("event_type").alias("previous_edit"), F.col("props").alias("new_edit"),
                     F.col("event_id").alias("seq"))


def file_edits(spark: SparkSession, d: str) -> DataFrame:
    """Stored manual edits ``(file_id, previous_edit, new_edit)``, one per order. A tenth of them belong to files of the
    dataset (half of those still equal the sidecar caption, the others are stale); the rest to files that it doesn't
    hold (negative ids)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    key = F.col("o_orderkey")
    return o.select(F.when(key % 10 == 0, key).otherwise(-key).alias("file_id"),
                    F.concat_ws(", ", F.lit("edited"), F.lit("widget")).alias("previous_edit"),
                    F.when(key % 20 == 0, F.concat_ws(", ", F.lit("edited"), F.lower("o_orderpriority")))
                    .otherwise(F.concat_ws(", ", F.lit("edited"), F.lower("o_orderstatus"))).alias("new_edit"))


def markup_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with markup ``(id, form, title, source, rest, body)``: every document, in one of 13 markup forms about its
    part's name and its source, in front of its own text (in which characters that could be markup become blanks)."""
    docs = _spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = docs.join(p, p.p_partkey == docs.doc_id, "left")
    t = F.coalesce(F.col("p_name"), F.concat(F.lit("page "), F.col("doc_id").cast("string")))
    rest = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), '[]{}<>"*@#|\r', " " * 12), "h([0-9])", "h $1")
    rest = F.replace(rest, F.lit("http"), F.lit("hxxp"))
    rows = j.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 13).alias("form"), t.alias("title"),
                    F.coalesce("source", F.lit("none")).alias("source"), rest.alias("rest"))
    t, s, n = F.col("title"), F.col("source"), F.col("id").cast("string")
    forms = [("h4. ", t), ("h2#sec-", n, ". ", t), ("[[", t, "]]s"), ("see [[", t, "#History|the ", s, " page]]"),
             ("{{", t, " (", s, ")|}}"), ('"', t, '":[/posts/', n, "]"), ("[https://example.com/", n, "](", t, ")"),
             ("<https://example.com/", n, "> and https://example.org/", n), ("[b]", t, "\n", s, "[/b] [s] ", t, " [/s]"),
             ("[table][tr][td colspan=2]", t, "[/td][th]", s, "[/th][/tr][/table]"), ("* ", t, "\n** ", s),
             ("[nodtext][u]", t, "[/u] @", s, "[/nodtext]"), ("ask @", s, " about [tr]")]
    piece = None
    for k, parts in enumerate(forms):
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        piece = F.when(F.col("form") == k, text) if piece is None else piece.when(F.col("form") == k, text)
    return rows.withColumn("body", F.concat(piece, F.lit("\n\n"), F.col("rest")))


# ---- input files: the views above as the tables that a user brings, written once and read by the package's readers -------

def _files(d: str, *tables: str) -> list[str]:
    return [f"{d.rstrip('/')}/{t}.parquet" for t in tables]


def _spread(df: DataFrame, key: str) -> DataFrame:
    """A table of as many files as the session has shuffle partitions, so its readers share the work. Spread by the key that
    it is joined on next, its texts are moved once for both."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def tags_file(spark: SparkSession, d: str) -> str:
    """The popularity table with its counts as text; suppliers' rows have no number, nations' rows no name."""
    def build():
        good = tags_raw(spark, d).select("name", F.col("post_count").cast("string").alias("post_count"))
        odd = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("many").alias("post_count"))
        none = table(spark, d, "nation").select(F.lit(None).cast("string").alias("name"), F.col("n_nationkey").cast("string").alias("post_count"))
        return good.unionByName(odd).unionByName(none)
    return write_once(spark, "tags-file", _files(d, "part", "lineitem", "supplier", "nation"), build)


def pages_file(spark: SparkSession, d: str) -> str:
    """The page table with long ids; customers' rows have ids that are no int, regions' rows none."""
    def build():
        good = wiki_raw(spark, d).select(F.col("id").cast("long").alias("id"), "title", "body")
        odd = table(spark, d, "customer").select((F.col("c_custkey") + F.lit(1 << 40)).alias("id"), F.col("c_name").alias("title"),
                                                 F.lit(None).cast("string").alias("body"))
        none = table(spark, d, "region").select(F.lit(None).cast("long").alias("id"), F.col("r_name").alias("title"),
                                                F.lit(None).cast("string").alias("body"))
        return good.unionByName(odd).unionByName(none)
    return write_once(spark, "pages-file", _files(d, "documents", "part", "customer", "region"), build)


def tag_groups_file(spark: SparkSession, d: str) -> str:
    """The tag groups; brands' rows have no group."""
    def build():
        odd = table(spark, d, "part").select(F.col("p_brand").alias("tag"), F.lit(None).cast("string").alias("tag_group")).distinct()
        return tag_groups(spark, d).unionByName(odd)
    return write_once(spark, "tag-groups-file", _files(d, "part"), build)


def labels_file(spark: SparkSession, d: str, fmt: str) -> str:
    """The label vocabulary as one CSV (with category codes) or JSON file: a text as long as the score vectors are wide. The CSV ends
    with a label of an unknown code."""
    def build():
        rows = label_vocab(spark, d)
        each = F.struct("idx", "name", "category")
        if fmt == "csv":
            lines = F.transform(F.array_sort(F.collect_list(each)), lambda r: F.concat_ws(",", r["idx"].cast("string"), r["name"],
                                                                                          r["category"].cast("string")))
            text = F.concat(F.lit("tag_id,name,category\n"), F.array_join(lines, "\n"), F.lit("\n-1,odd,7\n"))
        else:
            kinds = F.create_map(*[F.lit(x) for x in (9, "rating", 0, "general", 4, "character")])
            named = F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string"), F.col("name"))))
            kind = F.map_from_entries(F.collect_list(F.struct(F.col("name"), F.element_at(kinds, F.col("category")))))
            text = F.to_json(F.struct(named.alias("idx_to_tag"), kind.alias("tag_to_category")))
        return rows.agg(text.alias("text"))
    from tagloom.sources.folder import write_files
    path = write_once(spark, f"labels-{fmt}", _files(d, "embeddings"), build)
    folder = f"{path}-file"
    write_files(spark.read.parquet(path).withColumn("name", F.lit("labels")), folder, "name", "text", f".{fmt}")
    return f"{folder}/labels.{fmt}"


def markup_file(spark: SparkSession, d: str) -> str:
    """The pages with markup ``(id, title, body)`` as a table of its own: a body ends with the rest, which isn't written twice."""
    return write_once(spark, "markup-file", _files(d, "documents", "part"), lambda: markup_pages(spark, d).select("id", "title", "body"))
