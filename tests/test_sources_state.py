"""Sources over files (folder scan, sidecars, label tables), state maintenance, search helpers."""

import json
import os
import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.functions.jaro import jaro_winkler
from tagloom.operators import state as S
from tagloom.plans.wiki import IndexOptions, split_search, term_list
from tagloom.sources.folder import read_sidecar_captions, scan_image_folder, with_sidecars
from tagloom.sources.labels import read_label_csv, read_label_json

PNG = bytes.fromhex("89504E470D0A1A0A") + b"\x00" * 24
JPG = bytes.fromhex("FFD8FFE0") + b"\x00" * 24


@pytest.fixture()
def folder():
    d = tempfile.mkdtemp(prefix="tagloom-folder-")
    files = {"a.png": PNG, "b.jpg": JPG, "c.png": PNG + b"x", "junk.bin": b"not an image",
             "a.txt": b"  cat, dog \n", "c.txt": b"", "meta.json": b"{}", "x.npz": b"zz"}
    for n, b in files.items():
        with open(os.path.join(d, n), "wb") as f:
            f.write(b)
    os.mkdir(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "deep.png"), "wb") as f:
        f.write(PNG)
    return d


def test_scan_image_folder(spark, folder):
    rows = {r.stem: r for r in scan_image_folder(spark, folder).collect()}
    assert set(rows) == {"a", "b", "c"}
    import hashlib
    assert rows["a"].hash == hashlib.sha256(PNG).hexdigest()
    assert rows["a"].hash != rows["c"].hash


def test_sidecars(spark, folder):
    caps = {r.stem: r.caption for r in read_sidecar_captions(spark, folder).collect()}
    assert caps == {"a": "cat, dog", "c": ""}      # an emptied file is an empty caption, not a missing one
    j = {r.stem: r.caption for r in with_sidecars(scan_image_folder(spark, folder), read_sidecar_captions(spark, folder)).collect()}
    assert j == {"a": "cat, dog", "b": "", "c": ""}


def test_label_csv(spark):
    d = tempfile.mkdtemp(prefix="tagloom-labels-")
    p = os.path.join(d, "selected_tags.csv")
    with open(p, "w") as f:
        f.write("tag_id,name,category,count\n1,general,9,0\n2,1girl,0,5\n3,hatsune_miku,4,3\n")
    got = [(r.idx, r.name, r.category) for r in read_label_csv(spark, p).orderBy("idx").collect()]
    assert got == [(0, "general", 9), (1, "1girl", 0), (2, "hatsune_miku", 4)]


def test_label_json(spark):
    d = tempfile.mkdtemp(prefix="tagloom-labels-")
    p = os.path.join(d, "info.json")
    with open(p, "w") as f:
        json.dump({"total_tags": 3, "idx_to_tag": {"0": "cat", "1": "miku"},
                   "tag_to_category": {"miku": "character"}}, f)
    got = sorted((r.idx, r.name, r.category) for r in read_label_json(spark, p).collect())
    assert got == [(0, "cat", "general"), (1, "miku", "character"), (2, "unknown-2", "general")]


def test_state_helpers(spark):
    h = spark.createDataFrame([(i, f"ds{i % 3}") for i in range(15)], "seq long, dataset string")
    assert [r.seq for r in S.record_run(h, "dsX", 100).orderBy(F.col("seq").desc()).collect()] == \
        [100] + list(range(14, 5, -1))
    st = spark.createDataFrame([("d", "k", "1", 1), ("d", "k", "2", 3), ("d", "k", "3", 2)],
                               "dataset string, key string, value string, seq long")
    up = S.upsert_settings(st)
    assert S.get_setting(up, "d", "k").collect()[0].value == "2"
    assert S.get_setting(up, "d", "missing", default="x").collect()[0].value == "x"
    cache = spark.createDataFrame([("h1", "r", "aa", 2)], "hash string, repo_name string, data string, n_bytes int")
    mem = spark.createDataFrame([("d", "h1")], "dataset string, hash string")
    c2, m2 = S.drop_cache_by_dataset(cache, mem, None)
    assert c2.count() == 1 and m2.count() == 1


def test_compact_table(spark):
    d = tempfile.mkdtemp(prefix="tagloom-compact-")
    spark.range(1000).repartition(10).write.parquet(os.path.join(d, "t"))
    n = S.compact_table(spark, os.path.join(d, "t"), os.path.join(d, "t2"), 1 << 20)
    assert n == 1000
    assert len([f for f in os.listdir(os.path.join(d, "t2")) if f.endswith(".parquet")]) <= 2


def test_split_search():
    assert split_search('"red widget" blue') == ("blue", ["red", "widget"])
    assert split_search("plain words") == ("plain words", [])
    assert term_list("Ocean, 3boats of Élan!") == ["ocean", "boats", "elan"]
    assert term_list("Ocean of 3boats", options=IndexOptions(separator="[^a-z0-9]+", stop_words=())) == ["ocean", "of", "3boats"]
    assert term_list("the of") == []


def test_jaro_winkler_matches_duckdb():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcde1") for _ in range(rng.randint(0, 9))),
              "".join(rng.choice("abcde1") for _ in range(rng.randint(0, 9)))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p(a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    for a, b, s in con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM p").fetchall():
        assert jaro_winkler(a, b) == pytest.approx(s, abs=1e-12)


def test_write_caption_files(spark, folder):
    from tagloom.sources.folder import write_caption_files
    caps = spark.createDataFrame([("a", "new a"), ("b", "new b")], "stem string, caption string")
    write_caption_files(caps, folder, overwrite=False)
    read = lambda n: open(os.path.join(folder, n)).read()
    assert read("a.txt") == "  cat, dog \n"        # existing caption kept
    assert read("b.txt") == "new b"
    write_caption_files(caps, folder, overwrite=True)
    assert read("a.txt") == "new a"


def test_typed_settings(spark):
    rows = [("d1", "general_thresh", "0.5", 1), ("d1", "escape_brackets", "True", 2), ("d1", "ban_tags", "x, y", 3),
            ("d1", "general_thresh", "0.4", 4), ("d2", "replace_underscores", "False", 5), ("d2", "other", "z", 6)]
    df = spark.createDataFrame(rows, "dataset string, key string, value string, seq long")
    typed = S.typed_settings(df)
    r = typed.where(F.col("dataset") == "d1").collect()[0]
    assert (r.general_thresh, r.escape_brackets, r.ban_tags, r.replace_underscores) == (0.4, True, "x, y", None)
    st = S.tag_settings_for(typed, "d1")
    assert (st.general_threshold, st.escape_brackets, st.ban_tags, st.replace_underscores) == (0.4, True, "x, y", True)
    st2 = S.tag_settings_for(typed, "d2")
    assert st2.replace_underscores is False and st2.general_threshold == 0.35


def test_unattributed_usage(spark):
    cache = spark.createDataFrame([("h1", "m", "aaaa", 4), ("h2", "m", "bb", 2), ("h3", "m", "c", 1)],
                                  "hash string, repo_name string, data string, n_bytes int")
    mem = spark.createDataFrame([("d1", "h1"), ("d2", "h1"), ("d2", "h2")], "dataset string, hash string")
    usage = {r.dataset: r.bytes for r in S.usage_by_dataset(cache, mem).collect()}
    assert usage == {"d1": 4, "d2": 6, "UNKNOWN": 1}          # a shared row counts once per dataset
    assert {r.dataset for r in S.cached_datasets(cache, mem).collect()} == {"d1", "d2", "UNKNOWN"}
    assert [r.hash for r in S.exclusive_hashes(mem, "d2").collect()] == ["h2"]
    c2, m2 = S.drop_cache_by_dataset(cache, mem, "d2")
    assert sorted(r.hash for r in c2.collect()) == ["h1", "h3"]
    assert sorted((r.dataset, r.hash) for r in m2.collect()) == [("d1", "h1")]


def test_write_wiki_requires_unique_ids(spark):
    from tagloom.plans.wiki import build_wiki, write_wiki
    pages = spark.createDataFrame([(1, "red_widget", "a [b]bold[/b] page"), (2, "help:x", "skip"), (3, "bolt", None)],
                                  "id int, title string, body string")
    tags = spark.createDataFrame([("red_widget", 5), ("red_widget", 9)], "name string, post_count int")
    d = tempfile.mkdtemp(prefix="tagloom-wiki-")
    w = build_wiki(pages, tags)
    write_wiki(w, os.path.join(d, "wiki"))
    got = {r.id: (r.post_count, r.markdown, r.search_text) for r in spark.read.parquet(os.path.join(d, "wiki")).collect()}
    assert got == {1: (9, "a <b>bold</b> page", "a bold page"), 3: (1, None, None)}
    with pytest.raises(ValueError):
        write_wiki(w.unionByName(w), os.path.join(d, "wiki2"))


def test_natural_sort_long_numbers(spark):
    from tagloom.functions.text import natural_sort_key
    names = ["p9", "p10", "P0010b", "p" + "1" * 24, "p" + "1" * 25, "p" + "9" * 30, "p1" + "0" * 30, "p000"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", natural_sort_key(F.col("n")).alias("k"))
    assert len({tuple(r.k) for r in df.collect()}) == len(names)
    want = ["p000", "p9", "p10", "P0010b", "p" + "1" * 24, "p" + "1" * 25, "p" + "9" * 30, "p1" + "0" * 30]
    assert [r.n for r in df.orderBy("k").collect()] == want


def test_image_signatures(spark):
    from tagloom.sources.folder import skipped_files
    d = tempfile.mkdtemp(prefix="tagloom-sig-")
    good = {"a.webp": b"RIFF\x10\x00\x00\x00WEBPVP8 ", "b.avif": b"\x00\x00\x00\x20ftypavif\x00\x00\x00\x00", "c.heic": b"\x00\x00\x00\x18ftypheic\x00\x00",
            "d.ico": b"\x00\x00\x01\x00\x01\x00", "e.jxl": b"\xff\x0a\x00", "f.ppm": b"P6\n1 1\n255\n\x00\x00\x00"}
    bad = {"g.wav": b"RIFF\x10\x00\x00\x00WAVEfmt ", "h.mp4": b"\x00\x00\x00\x20ftypisom", "i.bin": b"xPNG", "j.png": b""}
    for name, data in {**good, **bad}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    found = {r.path.rpartition("/")[2] for r in scan_image_folder(spark, d).collect()}
    left = {r.path.rpartition("/")[2] for r in skipped_files(spark, d).collect()}
    assert found == set(good) and left == set(bad)


def test_written_tables_follow_their_inputs(spark):
    from tagloom.session import materialize_once
    d = tempfile.mkdtemp(prefix="tagloom-once-")
    src = os.path.join(d, "t")
    spark.range(5).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(src)
    read = lambda: materialize_once(spark, "once", [src], lambda: spark.read.parquet(src).select("id"))
    assert read().count() == 5 and read().count() == 5
    spark.range(7).selectExpr("id", "id % 2 AS part").write.mode("append").partitionBy("part").parquet(src)
    assert read().count() == 12
