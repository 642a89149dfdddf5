"""Folder source, model registry, cache partitions, bitmaps, search from SQL text."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions.search import register_search
from tagloom.operators import bitmaps as B
from tagloom.operators import state as S
from tagloom.operators.models import ModelRegistry, score_listed
from tagloom.plans import wiki as W
from tagloom.sources import folder as FO


def put(at, files):
    os.makedirs(at, exist_ok=True)
    for name, content in files.items():
        with open(os.path.join(at, name), "wb") as f:
            f.write(content)


def test_folders_are_listed_on_executors(spark, tmp_path):
    put(tmp_path / "a", {"x.png": b"", "y.txt": b"t", "ü z.jpg": b"123"})
    put(tmp_path / "b", {"x.png": b"12345"})
    os.mkdir(tmp_path / "a" / "sub")
    df = FO.list_folders(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert df.rdd.getNumPartitions() == 2           # one task a folder
    rows = {(os.path.basename(r.folder), r.name): r.length for r in df.collect()}
    assert rows == {("a", "x.png"): 0, ("a", "y.txt"): 1, ("a", "ü z.jpg"): 3, ("b", "x.png"): 5}
    got = {r.name: bytes(r.content) for r in FO.read_contents(df.where(F.col("folder").endswith("a"))).collect()}
    assert got == {"x.png": b"", "y.txt": b"t", "ü z.jpg": b"123"}
    with pytest.raises(Exception, match="folders"):
        spark.read.format("tagloom_folder").load().collect()


def test_page_folders_are_bounded(spark, tmp_path, monkeypatch):
    from tagloom.plans import q_misc as Q
    spark.createDataFrame([(i, f"u{i}", None if i == 7 else "x" * i) for i in range(60)], "page_id long, url string, html string"
                          ).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, f"{i}-P") for i in range(300)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = {q: sorted(map(str, f(spark, str(tmp_path)).collect())) for q, f in
            (("scan", Q.q_scan_folder), ("captions", Q.q_read_sidecars), ("scores", Q.q_score_files_models))}
    assert [len(want[q]) for q in ("scan", "captions", "scores")] == [60, 300, 120]
    monkeypatch.setattr(Q, "FOLDER_BYTES", 180 * Q.FILE_BLOCK)
    held, real = [], FO.list_folders

    def listed(spark, *folders):
        held.append((folders[0], len(os.listdir(folders[0]))))
        return real(spark, *folders)
    monkeypatch.setattr(FO, "list_folders", listed)
    for q, f in (("scan", Q.q_scan_folder), ("captions", Q.q_read_sidecars), ("scores", Q.q_score_files_models)):
        held.clear()
        assert sorted(map(str, f(spark, str(tmp_path)).collect())) == want[q]
        assert len(held) == 2 and sum(n for _, n in held) == 360 and max(n for _, n in held) < 240
        assert not any(os.path.exists(folder) for folder, _ in held)


def test_many_files_lie_in_several_folders(spark, tmp_path, monkeypatch):
    """A folder takes names one at a time: many files are written, listed and removed in folders of their own."""
    from tagloom.plans import q_misc as Q
    spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(60)], "page_id long, url string, html string"
                          ).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, f"{i}-P") for i in range(300)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    held, real = [], FO.list_folders

    def listed(spark, *folders):
        held.append([(f, len(os.listdir(f))) for f in folders])
        return real(spark, *folders)
    monkeypatch.setattr(FO, "list_folders", listed)
    monkeypatch.setattr(Q, "FOLDER_BYTES", 180 * Q.FILE_BLOCK)
    monkeypatch.setattr(Q, "FOLDER_FILES", 60, raising=False)
    for q, n in ((Q.q_scan_folder, 60), (Q.q_read_sidecars, 300), (Q.q_score_files_models, 120)):
        held.clear()
        assert q(spark, str(tmp_path)).count() == n
        assert [len(x) for x in held] == [3, 3] and sum(n for x in held for _, n in x) == 360
        assert max(n for x in held for _, n in x) < 120
        assert not any(os.path.exists(f) for x in held for f, _ in x)


def test_models_are_found_by_prefix(spark, tmp_path):
    registry = ModelRegistry({"a/": lambda repo: lambda c: np.array([[len(x), 1] for x in c])})
    registry.register("a/b-", lambda repo: lambda c: np.array([[len(repo)] for _ in c]))
    with pytest.raises(ValueError, match="no model for 'c/x'; known prefixes: a/, a/b-"):
        registry.scorer("c/x")
    put(tmp_path, {"1.bin": b"xx", "2.bin": b"xx", "3.bin": b"yyy"})
    files = FO.scan_image_folder(spark, str(tmp_path), check_decodable=False)
    three = files.where("stem = '3'").select("hash", F.lit("a/v").alias("repo_name"), F.array(F.lit(9.0)).cast("array<float>").alias("scores"))
    read = lambda m: FO.read_contents(m.join(files.select("path", "folder"), "path"))
    done, fresh = score_listed(files, three, "a/v", registry, read)
    assert {r.stem: list(r.scores) for r in done.collect()} == {"1": [2, 1], "2": [2, 1], "3": [9]} and fresh.count() == 1
    done, _ = score_listed(files, three, "a/b-1", registry, read)
    assert {tuple(r.scores) for r in done.collect()} == {(5.0,)}


def listing(path):
    return {os.path.join(os.path.basename(d), f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_partitions_are_dropped_in_place(spark, tmp_path):
    rows = [(f"h{i % 40}", repo, f"d{i}", 3) for i, repo in enumerate(["o/one", "two words", "123", "three%"] * 40)]
    cache = spark.createDataFrame(rows, "hash string, repo_name string, data string, n_bytes int").dropDuplicates(["hash", "repo_name"])
    path = str(tmp_path / "cache")
    S.write_cache(cache, path)
    before, n = listing(path), cache.count()
    gone = cache.where("repo_name = 'o/one'").count()
    assert S.drop_repo_partition(spark, path, "o/one") and not S.drop_repo_partition(spark, path, "no such")
    left = S.read_cache(spark, path)
    assert left.count() == n - gone and {r.repo_name for r in left.select("repo_name").distinct().collect()} == {"two words", "123", "three%"}
    after = listing(path)
    assert {k: v for k, v in before.items() if "one" not in k} == {k: v for k, v in after.items() if "one" not in k}

    members = spark.createDataFrame([("ds", "h1"), ("ds", "h2"), ("other", "h2")], "dataset string, hash string")
    want = S.drop_cache_by_dataset(left, members, "ds")[0].select("hash", "repo_name").collect()
    models = sorted({r.repo_name for r in left.where("hash = 'h1'").collect()})
    assert models and S.drop_dataset_rows(spark, path, members, "ds") == models
    assert sorted(S.read_cache(spark, path).select("hash", "repo_name").collect()) == sorted(want)
    assert S.drop_dataset_rows(spark, path, members, None) == []
    assert S.drop_dataset_rows(spark, path, members, "other") == []


def test_bitmaps_hold_any_id(spark):
    ids = [-70_000, -32_768, -1, 0, 1, 2, 32_768, 32_769, 1 << 40]
    rows = [(i, "a, b" if k % 2 else "a,c, a") for k, i in enumerate(ids)] + [(5, ""), (6, None)]
    bitmaps = B.tag_bitmaps(spark.createDataFrame(rows, "file_id long, caption string"))
    sel = spark.createDataFrame([("a", ["a"]), ("ab", ["b", "a", "b"]), ("bc", ["b", "c"]), ("none", []), ("x", ["x"])],
                                "selection string, tags array<string>")
    got = {}
    for r in B.selected_files(B.selected_bitmaps(bitmaps, sel)).collect():
        got.setdefault(r.selection, []).append(r.file_id)
    assert {k: sorted(v) for k, v in got.items()} == {"a": sorted(ids), "ab": sorted(ids[1::2]), "none": sorted([*ids, 5])}
    chosen = B.selected_bitmaps(bitmaps, sel)
    assert {r.selection: r.n_files for r in B.selection_counts(chosen, sel).collect()} == {"a": 9, "ab": 4, "bc": 0, "none": 10, "x": 0}
    facets = {(r.selection, r.tag): r.n_files for r in B.selection_facets(bitmaps, chosen).collect()}
    assert facets == {("a", "a"): 9, ("a", "b"): 4, ("a", "c"): 5, ("ab", "a"): 4, ("ab", "b"): 4,
                      ("none", "a"): 9, ("none", "b"): 4, ("none", "c"): 5, ("none", ""): 1}


def test_facets_shuffle_no_pairs_of_bitmaps(spark, monkeypatch):
    """Selections in several blocks give the counts of one, and no step holds a row for each pair of bitmaps."""
    rows = [(i, ", ".join(f"t{k}" for k in range(12) if (i >> k) & 1 or i % 5 == k)) for i in range(0, 90_000, 7)]
    bitmaps = B.tag_bitmaps(spark.createDataFrame(rows, "file_id long, caption string"))
    sel = spark.createDataFrame([(f"s{k}", [f"t{k}"]) for k in range(12)] + [(None, [])], "selection string, tags array<string>")
    monkeypatch.setattr(B, "SELECTIONS_HELD", 3)
    facets = B.selection_facets(bitmaps, B.selected_bitmaps(bitmaps, sel))
    assert "bitmap_and_agg" not in facets._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for _, caption in rows:
        tags = caption.split(", ") if caption else [""]
        for s in [None, *(f"s{t[1:]}" for t in tags if t)]:
            for t in tags:
                want[s, t] = want.get((s, t), 0) + 1
    assert {(r.selection, r.tag): r.n_files for r in facets.collect()} == want


def test_search_from_sql_text(spark):
    pages = [(1, 5, "red boat", "a red boat and a blue one"), (2, 1, "blue boat", "blue"), (3, 9, "harbour", "boats of the harbour")]
    wiki = spark.createDataFrame([(i, n, t, t, x) for i, n, t, x in pages], "id int, post_count int, title string, search_title string, search_text string")
    postings = W.build_search_index(wiki)
    register_search(spark, postings, W.term_dictionary(postings), W.corpus_stats(wiki))
    for fields, k, b, every in (("search_title", 0.0, 0.5, 1), ("search_text", 1.2, 0.0, 0), ("search_title", 1.2, 0.75, 0)):
        want = W.bm25_scores(wiki, postings, ["blue", "boat"], {"s": W.BM25(fields, k, b, bool(every))}).where("s is not null")
        got = spark.sql(f"SELECT * FROM match_bm25('The BLUE boat', fields => '{fields}', k => {k}D, b => {b}D, conjunctive => {every})")
        assert {r.id: round(r.score, 9) for r in got.collect()} == {r.id: round(r.s, 9) for r in want.collect()}
    assert {r.id for r in spark.sql("SELECT id FROM match_bm25('harbour red', fields => 'search_title, search_text')").collect()} == {1, 3}
    assert spark.sql("SELECT * FROM match_bm25('the of')").count() == spark.sql("SELECT * FROM match_bm25('')").count() == 0


def test_pages_of_one_title_are_spread(spark, tmp_path):
    """Documents are moved once, by id: pages that share a title don't share a file, and a body's text isn't written twice."""
    from tagloom.sources import fixtures as X
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(3 * i + 1, "text", "en", "s", 4) for i in range(64)], "doc_id long, text string, lang string, source string, n_chars long")
    put("part", [(i, "red widget", "b", "PROMO", 1, 1.0) for i in range(200)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    put("customer", [(1, "c", 1, 1.0, "m")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("region", [(1, "r")], "r_regionkey int, r_name string")
    pages = spark.read.parquet(X.pages_file(spark, str(tmp_path))).where("title = 'red_widget'")
    sizes = [r["count"] for r in pages.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 64 and len(sizes) >= 4 and max(sizes) < 32
    markup = spark.read.parquet(X.markup_file(spark, str(tmp_path)))
    assert markup.columns == ["id", "title", "body"] and markup.count() == 64
