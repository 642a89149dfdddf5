"""Registered queries: caption merge and whitelist, caption sinks, sources, formatting functions,
streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.text import BREAK, escape_brackets, human_bytes, natural_sort_key, selection_label, \
    selection_title
from tagloom.operators import merge as M
from tagloom.operators import state as S
from tagloom.operators.tags import TagSettings
from tagloom.plans import dataset as D
from tagloom.plans.oracle import FIX, with_
from tagloom.plans.q_dataset import caption_ctes
from tagloom.plans.registry import register
from tagloom.session import materialize
from tagloom.sources import fixtures as X
from tagloom.sources.readers import read_labels
from tagloom.sources.tables import table
from tagloom.streaming.incremental import latest_settings, stream_incremental_scores, stream_latest_settings, streamed_scores

# Fixed query parameters.
WL_TAGS = "widget, bolt"
WL_GROUP = "promo"


def _auto(spark, d):
    from tagloom.plans.q_dataset import _pred
    return D.captions(_pred(spark, d), TagSettings())


# ---- merge base and merges ---------------------------------------------------------------------

BASE_SQL = with_("pred", "captions", "file_edits", extra=caption_ctes()) + """,
j AS (SELECT c.file_id, c.caption AS auto, s.caption AS side, e.previous_edit, e.new_edit
      FROM cap c LEFT JOIN captions s ON s.file_id = c.file_id LEFT JOIN file_edits e ON e.file_id = c.file_id),
b AS (SELECT *, previous_edit IS NOT NULL AS has_edit,
             previous_edit IS NOT NULL AND side IS NOT NULL AND new_edit <> side AS refresh,
             previous_edit IS NULL AND coalesce(side, '') <> '' AS side_only FROM j)
"""


@register("choose_merge_base", BASE_SQL + """
SELECT file_id,
       CASE WHEN refresh THEN auto WHEN has_edit THEN previous_edit WHEN side_only THEN auto ELSE '' END AS initial,
       CASE WHEN refresh THEN side WHEN has_edit THEN new_edit WHEN side_only THEN side ELSE '' END AS edited,
       auto AS new
FROM b""")
def q_merge_base(spark, d):
    """Caption context per file (model caption, sidecar caption, stored edit) -> merge inputs."""
    b = M.choose_merge_base(_auto(spark, d), X.captions(spark, d), X.file_edits(spark, d))
    return b.select("file_id", "initial", "edited", "new")


# The merge restated with joins and windows: the edit's tags are the frame; a tag that only the model has goes in front
# of the next of its followers that the frame holds, else behind the frame.
MERGE_SQL = """,
lists AS (SELECT file_id, {tags_of}(initial) AS i, {tags_of}(edited) AS e, {tags_of}(new) AS n FROM src),
frame AS (SELECT file_id, generate_subscripts(e, 1) AS pos, unnest(e) AS tag FROM lists),
model AS (SELECT file_id, generate_subscripts(n, 1) AS pos, unnest(n) AS tag FROM lists),
place AS (SELECT file_id, tag, min(pos) AS pos FROM frame GROUP BY file_id, tag),
met AS (SELECT m.file_id, m.pos, m.tag, p.pos AS slot FROM model m LEFT JOIN place p USING (file_id, tag)),
added AS (
  SELECT file_id, pos, tag, first_value(slot IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS before, slot FROM met),
entries AS (
  SELECT file_id, pos AS k, 1 AS kind, 0 AS pos, tag FROM frame
  UNION ALL SELECT a.file_id, coalesce(before, 1000000000), 0, a.pos, a.tag FROM added a JOIN lists l USING (file_id)
  WHERE a.slot IS NULL AND NOT list_contains(l.i, a.tag){only})
SELECT l.file_id, coalesce(string_agg(x.tag, ', ' ORDER BY k, kind, x.pos), '') AS merged
FROM lists l LEFT JOIN entries x USING (file_id) GROUP BY l.file_id"""


def merge_sql(src: str, only: str = "") -> str:
    body = MERGE_SQL.replace("{only}", only)
    for c in ("initial", "edited", "new"):
        body = body.replace("{tags_of}(%s)" % c, f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')")
    return f",\nsrc AS (SELECT file_id, initial, edited, new FROM ({src}) q)" + body


MERGE_SRC = """SELECT file_id,
       CASE WHEN refresh THEN auto WHEN has_edit THEN previous_edit WHEN side_only THEN auto ELSE '' END AS initial,
       CASE WHEN refresh THEN side WHEN has_edit THEN new_edit WHEN side_only THEN side ELSE '' END AS edited,
       auto AS new FROM b"""


@register("merge_captions", BASE_SQL + merge_sql(MERGE_SRC))
def q_merge_captions(spark, d):
    """Three-way merge of every file's caption with its human edits."""
    b = M.choose_merge_base(_auto(spark, d), X.captions(spark, d), X.file_edits(spark, d))
    return M.merge_captions(b).select("file_id", "merged")


WL_SQL_CTE = f"""wl AS (SELECT DISTINCT replace(tag, '_', ' ') AS tag FROM (
        SELECT trim(unnest(string_split('{WL_TAGS}, {BREAK}', ','))) AS tag
        UNION ALL SELECT tag FROM tag_groups WHERE tag_group = '{WL_GROUP}') u)"""


def _whitelist(spark, d):
    return M.whitelist_tags(WL_TAGS, WL_GROUP, X.tag_groups(spark, d), extras=(BREAK,), replace_underscores=True)


@register("whitelist_tags", with_("tag_groups", extra=WL_SQL_CTE) + "SELECT tag FROM wl")
def q_whitelist(spark, d):
    """Allowed tags: the list, the tags of a tag group, ``BREAK`` (underscores replaced)."""
    return _whitelist(spark, d)


@register("merge_whitelist", with_("pred", "tag_groups", extra=caption_ctes() + ",\n" + WL_SQL_CTE) + """,
t0 AS (SELECT file_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS tag
       FROM (SELECT file_id, string_split(caption, ',') AS parts FROM cap) x),
t AS (SELECT file_id, pos, trim(tag) AS tag FROM t0 WHERE trim(tag) <> '')
SELECT c.file_id, coalesce(string_agg(t.tag, ', ' ORDER BY t.pos) FILTER (WHERE t.tag IN (SELECT tag FROM wl)), '') AS caption
FROM cap c LEFT JOIN t ON t.file_id = c.file_id GROUP BY c.file_id""")
def q_merge_whitelist(spark, d):
    """Merge of files without human edits under a whitelist: the model caption filtered to the
    allowed tags, order kept (native, semi-join on the allowed set)."""
    return M.filter_to_whitelist(_auto(spark, d), _whitelist(spark, d))


@register("merge_captions_whitelist", BASE_SQL + ",\n" + FIX["tag_groups"] + ",\n" + WL_SQL_CTE
          + merge_sql(MERGE_SRC, " AND a.tag IN (SELECT tag FROM wl)"))
def q_merge_captions_whitelist(spark, d):
    """Three-way merge of edited and unedited files under a whitelist that comes from a tag group (joined)."""
    b = M.choose_merge_base(_auto(spark, d), X.captions(spark, d), X.file_edits(spark, d))
    return M.merge_captions(b, _whitelist(spark, d)).select("file_id", "merged")


@register("tag_dataset_captions", BASE_SQL + merge_sql(MERGE_SRC).replace(
    "\nSELECT l.file_id, coalesce(", ",\nmerged AS (SELECT l.file_id, coalesce(") + """)
SELECT b.file_id, auto AS caption, merged,
  CASE WHEN refresh OR side_only THEN auto END AS store_previous, CASE WHEN refresh OR side_only THEN side END AS store_new
FROM b JOIN merged m ON m.file_id = b.file_id""")
def q_tag_dataset_captions(spark, d):
    """The tagging job's captions: the model's, the one merged with human edits, and the edit rows to store."""
    from tagloom.plans.q_dataset import _pred
    caps, _ = D.tag_dataset(_pred(spark, d), TagSettings(), sidecars=X.captions(spark, d), edits=X.file_edits(spark, d))
    return caps.select("file_id", "caption", "merged", "store_previous", "store_new")


# ---- caption sinks -----------------------------------------------------------------------------

@register("write_captions", with_("pred", "captions", extra=caption_ctes()) + """
SELECT file_id, caption FROM captions
UNION ALL SELECT file_id, caption FROM cap c WHERE NOT EXISTS (SELECT 1 FROM captions s WHERE s.file_id = c.file_id)""")
def q_write_captions(spark, d):
    """Caption files after a run without overwrite: existing files are kept, missing ones written."""
    from tagloom.sources.folder import merge_caption_files
    return merge_caption_files(_auto(spark, d), X.captions(spark, d), overwrite=False)


@register("write_captions_overwrite", with_("pred", "captions", extra=caption_ctes()) + """
SELECT coalesce(c.file_id, s.file_id) AS file_id, coalesce(c.caption, s.caption) AS caption
FROM cap c FULL OUTER JOIN captions s ON s.file_id = c.file_id""")
def q_write_captions_overwrite(spark, d):
    from tagloom.sources.folder import merge_caption_files
    return merge_caption_files(_auto(spark, d), X.captions(spark, d), overwrite=True)


# ---- sources -----------------------------------------------------------------------------------

@register("content_hash", with_("files") + "SELECT file_id, hash, n_bytes FROM files")
def q_content_hash(spark, d):
    """sha256 of every file's bytes as its identity."""
    return X.files(spark, d)


_LABEL_SQL = with_("label_vocab") + """
SELECT idx, name, CASE category WHEN 9 THEN 'rating' WHEN 0 THEN 'general' WHEN 4 THEN 'character' END AS category
FROM label_vocab"""


@register("scan_label_table", _LABEL_SQL)
def q_labels(spark, d):
    """A model's labels from their CSV file: category codes become names, places in the file indexes."""
    return read_labels(spark, X.labels_file(spark, d, "csv"), "csv").rows


@register("scan_label_maps", _LABEL_SQL)
def q_label_maps(spark, d):
    """A model's labels from JSON maps."""
    return read_labels(spark, X.labels_file(spark, d, "json"), "json").rows


def _length_model():
    """A deterministic scorer: two labels from the length and the first byte of the content."""
    import numpy as np
    return lambda contents: np.array([[len(c) % 97 / 97, (c[0] if c else 0) / 255] for c in contents], dtype=np.float32).reshape(-1, 2)


@register("score_files", """
WITH f AS (SELECT page_id, sha256(html) AS hash, html FROM pages),
c AS (SELECT DISTINCT hash FROM f WHERE page_id % 3 = 0)
SELECT page_id AS file_id, round(CASE WHEN c.hash IS NULL THEN octet_length(encode(html)) % 97 / 97.0 ELSE 0.5 END, 4) AS s0,
       round(CASE WHEN c.hash IS NULL THEN CASE WHEN html = '' THEN 0 ELSE ascii(html) END / 255.0 ELSE 0.25 END, 4) AS s1
FROM f LEFT JOIN c ON c.hash = f.hash""")
def q_score_files(spark, d):
    """Every page scored by a deterministic model; a third of them come from the cache."""
    from tagloom.operators.scoring import score_files
    f = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.sha2("html", 256).alias("hash"), F.col("html").cast("binary").alias("content"))
    cache = (f.where(F.col("file_id") % 3 == 0).select("hash").distinct()
             .select("hash", F.lit("length").alias("repo_name"), F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>").alias("scores")))
    done, _ = score_files(f, cache, "length", _length_model)
    return done.select("file_id", *[F.round(F.col("scores")[i].cast("double"), 4).alias(f"s{i}") for i in (0, 1)])


def _share_model(repo):
    """A deterministic model: three labels from the length, its parity and the repository's name."""
    import numpy as np
    return lambda contents: np.array([[len(c) % 89 / 89, len(c) % 2, len(repo) / 100] for c in contents], dtype=np.float32).reshape(-1, 3)


def _length_of(repo):
    return _length_model()


@register("score_files_models", """
WITH f AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages)
SELECT page_id AS file_id, 'length/v1' AS repo_name, round(n % 97 / 97.0, 4) AS s0, round(CASE WHEN html = '' THEN 0 ELSE ascii(html) END / 255.0, 4) AS s1,
  NULL::DOUBLE AS s2 FROM f
UNION ALL SELECT page_id, 'share/two', round(n % 89 / 89.0, 4), round(n % 2, 4), 0.09 FROM f""")
def q_score_files_models(spark, d):
    """Every page as a file, listed, hashed and scored by two models that a registry finds by their prefixes; contents are read
    only where they are scored."""
    from tagloom.operators.models import ModelRegistry, score_listed
    from tagloom.sources.folder import read_contents, scan_image_folder
    registry = ModelRegistry({"length/": _length_of, "share/": _share_model})
    none = spark.createDataFrame([], "hash string, repo_name string, scores array<float>")

    def scored(*folders):
        files = materialize(scan_image_folder(spark, *folders, check_decodable=False), "listed")
        read = lambda m: read_contents(m.join(files.select("path", "folder"), "path"))
        out = None
        for repo in ("length/v1", "share/two"):
            done, _ = score_listed(files, none, repo, registry, read)
            at = lambda i: F.round(F.get("scores", F.lit(i)).cast("double"), 4).alias(f"s{i}")
            rows = done.select(F.col("stem").cast("long").alias("file_id"), F.lit(repo).alias("repo_name"), at(0), at(1), at(2))
            out = rows if out is None else out.unionByName(rows)
        return out
    return _from_page_folders(spark, d, scored)


@register("typed_settings", with_("settings_log") + """,
k AS (SELECT dataset, CASE key WHEN 'click' THEN 'general_thresh' WHEN 'view' THEN 'character_thresh' WHEN 'purchase' THEN 'model_repo' ELSE key END AS key,
             arg_max(value, seq) AS value FROM settings_log GROUP BY ALL)
SELECT dataset, max(CAST(value AS DOUBLE)) FILTER (key = 'general_thresh') AS general_thresh,
       max(CAST(value AS DOUBLE)) FILTER (key = 'character_thresh') AS character_thresh, max(value) FILTER (key = 'model_repo') AS model_repo
FROM k WHERE key IN ('general_thresh', 'character_thresh', 'model_repo') GROUP BY dataset""")
def q_typed_settings(spark, d):
    """Saved settings as one typed row per dataset."""
    key = F.when(F.col("key") == "click", "general_thresh").when(F.col("key") == "view", "character_thresh").when(
        F.col("key") == "purchase", "model_repo").otherwise(F.col("key"))
    typed = S.typed_settings(X.settings_log(spark, d).withColumn("key", key))
    return typed.select("dataset", "general_thresh", "character_thresh", "model_repo")


# ---- formatting functions ----------------------------------------------------------------------

@register("fn_human_bytes", with_("cache_log", extra="""
cache AS (SELECT hash, repo_name, CAST(strlen(arg_min(data, seq)) AS INTEGER) AS n_bytes FROM cache_log GROUP BY hash, repo_name),
u AS (SELECT repo_name, sum(n_bytes) * 1000 AS b FROM cache GROUP BY repo_name)""") + """
SELECT repo_name, CASE WHEN b < 1024 THEN printf('%.2f B', b)
                       WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0)
                       WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576.0)
                       WHEN b < 1099511627776 THEN printf('%.2f GiB', b / 1073741824.0)
                       ELSE printf('%.2f TiB', b / 1099511627776.0) END AS size
FROM u""")
def q_human_bytes(spark, d):
    """Cache usage per model as a human-readable size (scaled x1000 to reach the larger units)."""
    u = S.usage_by_repo(S.insert_cache(X.cache_log(spark, d)))
    return u.select("repo_name", human_bytes(F.col("bytes") * 1000).alias("size"))


@register("natural_sort", """
SELECT title, list_transform(regexp_extract_all(title, '([0-9]+|[^0-9]+)', 1),
                             lambda x: CASE WHEN regexp_full_match(x, '[0-9]+')
                                            THEN printf('%010d', len(ltrim(x, '0'))) || ltrim(x, '0') ELSE lower(x) END) AS sort_key
FROM (SELECT DISTINCT url AS title FROM pages) t""")
def q_natural_sort(spark, d):
    """Sort key comparing digit runs as numbers and text case-insensitively (page URLs)."""
    t = table(spark, d, "pages").select(F.col("url").alias("title")).distinct()
    return t.select("title", natural_sort_key(F.col("title")).alias("sort_key"))


@register("parse_selection", with_("tags_raw", "wiki_raw") + """,
t AS (SELECT name, max(post_count) AS post_count FROM tags_raw GROUP BY name),
l AS (SELECT p.id, printf('%s (%d)', p.title, greatest(t.post_count, 1)) AS label
      FROM wiki_raw p LEFT JOIN t ON p.title = t.name)
SELECT id, label, regexp_extract(label, '^(.+?) \\(.+\\)', 1) AS title FROM l""")
def q_parse_selection(spark, d):
    """Search-result labels ``"title (count)"`` and the title parsed back out of them."""
    from tagloom.plans.wiki import clamp_post_count, join_pages_counts
    w = join_pages_counts(X.wiki_raw(spark, d).select("id", "title"), X.tags_raw(spark, d))
    lab = w.select("id", selection_label(F.col("title"), clamp_post_count("post_count")).alias("label"))
    return lab.select("id", "label", selection_title(F.col("label")).alias("title"))


@register("fn_escape_title", with_("wiki_raw") + """
SELECT id, replace(replace(title, '(', '\\('), ')', '\\)') AS escaped FROM wiki_raw""")
def q_escape_title(spark, d):
    return X.wiki_raw(spark, d).select("id", escape_brackets(F.col("title")).alias("escaped"))


@register("sql_functions", with_("tags_raw") + """
SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') AS normalised, replace(name, '_', ' ') AS words,
       replace(replace(name || '_(x)', '(', '\\('), ')', '\\)') AS escaped, regexp_extract_all(lower(name), '([a-z0-9]+)', 1) AS terms,
       greatest(max(post_count), 1) AS posts, round(jaro_winkler_similarity('red', split_part(name, '_', 1)), 6) AS alike
FROM tags_raw GROUP BY name""")
def q_sql_functions(spark, d):
    """The helpers as SQL functions, called from SQL text over the popularity table."""
    from tagloom.functions.sql import register_functions
    register_functions(spark)
    X.tags_raw(spark, d).createOrReplaceTempView("tags_raw_view")
    return spark.sql("""
        SELECT name, normalise_text(name) AS normalised, replace_underscores(name) AS words, escape_brackets(name || '_(x)') AS escaped,
               query_terms(name) AS terms, clamp_post_count(max(post_count)) AS posts,
               round(jaro_winkler_similarity('red', split_part(name, '_', 1)), 6) AS alike
        FROM tags_raw_view GROUP BY name""")


# ---- streams -----------------------------------------------------------------------------------

@register("stream_incremental_scores", with_("cache_log", extra="""
cache AS (SELECT hash, repo_name, arg_min(data, seq) AS data, CAST(strlen(arg_min(data, seq)) AS INTEGER) AS n_bytes
          FROM cache_log GROUP BY hash, repo_name)""") + "SELECT hash, repo_name, data, n_bytes FROM cache")
def q_stream_scores(spark, d):
    """Incremental cache fill as a stream over the events files (equals the batch
    ``insert_cache``; checked in tests)."""
    return streamed_scores(spark, stream_incremental_scores(spark, d))


@register("stream_latest_settings", with_("settings_log") + """
SELECT dataset, key, arg_max(value, seq) AS value FROM settings_log GROUP BY dataset, key""")
def q_stream_settings(spark, d):
    """Last write per (dataset, key) as a streaming aggregation (equals ``upsert_settings``)."""
    return latest_settings(spark, stream_latest_settings(spark, d))


# ---- folders of files (written from the given tables, then read back with the file sources) -----

FOLDER_BYTES, FILE_BLOCK = 1 << 29, 4096        # of the files that lie on disk at a time; what the least file takes
FOLDER_FILES = 4096                             # that a folder holds before others are written beside it


def _from_page_folders(spark, d, use):
    """``use(*folders)`` over every page of the ``pages`` table as a file ``<page_id>.html`` plus every sidecar caption as
    ``<file_id>.txt``, written by the executors into folders under the checkpoint folder.

    A small file takes a whole block of its store, many times its bytes, so the files are dealt by their names into as many
    rounds as keep each near ``FOLDER_BYTES``. Names are entered into a folder one at a time, so many files lie in folders of
    which each is written, listed and removed by a task of its own. They are removed once the rows found in them are written,
    before the next round."""
    import uuid
    from pyarrow import fs as pafs
    from tagloom.session import ensure_checkpoint_dir, write_table
    from tagloom.sources.folder import _uri, delete_folders, write_files
    top = ensure_checkpoint_dir(spark).rstrip("/")
    kinds = [(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", ".html"),
             (X.captions(spark, d), "file_id", "caption", ".txt")]
    taken = sum(rows.agg(F.sum(F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) + 1) / FILE_BLOCK) * FILE_BLOCK).alias("n")).first()["n"] or 0
                for rows, _, text, _ in kinds)
    parts = max(1, -(-int(taken) // FOLDER_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = min(tasks, max(1, -(-int(taken) // (parts * FILE_BLOCK * FOLDER_FILES))))
    dealt = []
    for rows, name, text, suffix in kinds:
        place = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(parts * within)).cast("int")
        rows = rows.withColumn("_within", F.pmod(place, F.lit(within))).withColumn("_part", F.floor(place / within).cast("int"))
        if parts > 1:       # written by part once, so that no round reads the tables again
            path = write_table(rows.repartition(tasks, "_part"), "files-by-folder", partition_by=["_part"])
            rows = spark.read.schema(rows.schema).parquet(path)
        dealt.append((rows, name, text, suffix))
    out = f"{top}/tables/folder-rows-{uuid.uuid4().hex}"
    for k in range(parts):
        folder = f"{top}/folders/pages-{uuid.uuid4().hex}"
        folders = [f"{folder}/{i}" for i in range(within)]
        fs, base = pafs.FileSystem.from_uri(_uri(folder))
        for i in range(within):
            fs.create_dir(f"{base}/{i}", recursive=True)
        for rows, name, text, suffix in dealt:
            write_files(rows.where(F.col("_part") == k).repartitionById(within, "_within"), folder, name, text, suffix, within_col="_within")
        use(*folders).write.mode("append").parquet(out)
        delete_folders(spark, *folders)
        fs.delete_dir(base)
    return spark.read.parquet(out)


@register("scan_image_folder", with_("files") + """
SELECT CAST(file_id AS VARCHAR) AS stem, hash, CAST(n_bytes AS BIGINT) AS n_bytes FROM files""")
def q_scan_folder(spark, d):
    """Folder listing + content hash with the ``binaryFile`` source (sidecars excluded). The page
    files are HTML, so the image-signature filter is off here; it is tested on image bytes."""
    from tagloom.sources.folder import scan_image_folder
    return _from_page_folders(
        spark, d, lambda *folders: scan_image_folder(spark, *folders, check_decodable=False).select("stem", "hash", "n_bytes"))


@register("read_sidecar_captions", with_("captions") + """
SELECT CAST(file_id AS VARCHAR) AS stem, caption FROM captions""")
def q_read_sidecars(spark, d):
    """Sidecar captions read back from ``<stem>.txt`` files (whole texts, whitespace-stripped)."""
    from tagloom.sources.folder import read_sidecar_captions
    return _from_page_folders(spark, d, lambda *folders: read_sidecar_captions(spark, *folders))


@register("compact_tables", with_("cache_log", extra="""
cache AS (SELECT hash, repo_name, arg_min(data, seq) AS data, CAST(strlen(arg_min(data, seq)) AS INTEGER) AS n_bytes
          FROM cache_log GROUP BY hash, repo_name)""") + "SELECT hash, repo_name, data, n_bytes FROM cache")
def q_compact(spark, d):
    """The cache table rewritten into files of about 256 KB (row count checked), read back."""
    from tagloom.session import write_table
    src = write_table(S.insert_cache(X.cache_log(spark, d)).repartition(16), "cache")
    out = src + "-compact"
    S.compact_table(spark, src, out, 1 << 18)
    return spark.read.parquet(out)
