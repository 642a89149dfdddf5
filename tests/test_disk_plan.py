"""What the tagging statistics and the search index leave on disk: one shuffle where a file's or a page's rows meet, and no
shuffle files of a table that is written."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tagloom.operators import tags as T
from tagloom.operators.tags import TagSettings
from tagloom.plans import dataset as D
from tagloom.plans import topk as K
from tagloom.plans import wiki as W
from tagloom.session import delete_table, materialize, write_table

PRED = "file_id long, category string, tag string, score double"


def predictions(spark, ordered=False):
    draw = random.Random(3)
    words = ["red", "bolt", "cold_bolt", "red cold bolt", " red  bolt", "red_bolt", "gear", "", None, "bolt gear"]
    rows = [(draw.choice([None, *range(30)]), draw.choice(["general", "general", "character", "rating", "artist", None]), draw.choice(words),
             draw.choice([None, 0.2, 0.35, 0.5, 0.9, 0.95, 1.0]), draw.randrange(9)) for _ in range(900)]
    df = spark.createDataFrame(rows, f"{PRED}, ord int")
    return df if ordered else df.drop("ord").distinct()


def joined(pred, st):
    """The results by joins: every kept row meets the categories of its file's tag."""
    p = T.prepare_predictions(pred, st.replace_underscores).where(F.col("category") != "rating")
    vocab = p.select(F.col("file_id").alias("f"), "category", F.col("tag").alias("t")).distinct()
    kept = T.ban_tags(D.kept_tags(pred, st), st.ban_tags).drop("category")
    on = kept["file_id"].eqNullSafe(vocab["f"]) & kept["tag"].eqNullSafe(vocab["t"])
    return kept.join(vocab, on).groupBy("file_id", "category", "tag").agg(F.min("score").alias("score"))


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("st", [TagSettings(), TagSettings(ban_tags="gear, red bolt"), TagSettings(replace_underscores=False),
                                TagSettings(trim_general_tag_dupes=False), TagSettings(general_mcut=True, character_mcut=True)])
def test_results_equal_those_by_joins(spark, st, ordered):
    pred = materialize(predictions(spark, ordered), "pred")
    got = sorted(map(str, D.result_scores(pred, st).select("file_id", "category", "tag", "score").collect()))
    assert got == sorted(map(str, joined(pred, st).collect())) and len(got) > 50


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_results_move_the_predictions_once(spark):
    pred = materialize(predictions(spark), "pred")
    assert exchanges(D.result_scores(pred)) == 1
    assert exchanges(D.tag_document_frequency(D.result_scores(pred), pred.select(F.lit(1).alias("n")).limit(1))) <= 3


def test_block_index_moves_the_weights_once(spark):
    rows = [(i, 1 + i, f"t{i}", f"t{i}", " ".join(f"w{chr(97 + i % 7)} x{chr(97 + k)}" for k in range(i % 9))) for i in range(300)]
    wiki = materialize(spark.createDataFrame(rows, "id int, post_count int, title string, search_title string, search_text string"), "w")
    postings = materialize(W.build_search_index(wiki), "p", sort_by=["term", "id"])
    blocks = K.block_index(wiki, postings, materialize(W.corpus_stats(wiki), "s"))
    assert exchanges(blocks) == 1
    found = spark.read.parquet(write_table(blocks, "b"))
    assert found.select(F.sum(F.size("entries"))).first()[0] == postings.select("id", "term").distinct().count()
    twice = K.block_index(wiki.unionByName(wiki.where("id = 8")), postings, materialize(W.corpus_stats(wiki), "s"))
    assert twice.select(F.explode("entries.id").alias("id")).where("id = 8").groupBy("id").count().first()[1] == \
        2 * postings.where("id = 8").select("term").distinct().count()      # an entry for each row of a page
    for part in found.select("term", "block").rdd.glom().collect():
        assert part == sorted(part)


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found, names = files.getAllFiles().iterator(), set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}
    before = shuffles()
    df = spark.range(50_000).select("id", F.xxhash64("id").alias("h")).repartition(5, "h")
    path = write_table(df, "dealt", sort_by=["h"])
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}-unsorted")
    assert spark.read.parquet(path).count() == 50_000
    delete_table(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
