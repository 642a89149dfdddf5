"""Block-max search and the fuzzy title index: the same rows as scoring everything, from fewer scored pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.jaro import jaro_winkler
from tagloom.plans import fuzzy as Z
from tagloom.plans import topk as T
from tagloom.plans import wiki as W
from tagloom.session import materialize

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Pages whose words have very different frequencies, some of them popular, some with the same words."""
    draw = random.Random(11)
    def words(n):
        return " ".join(WORDS[min(int(draw.expovariate(0.04)), len(WORDS) - 1)] for _ in range(n))
    rows = [(i, draw.choice([1, 1, 30, 900, 50_000]), f"{words(2).replace(' ', '_')}", "", words(draw.randrange(1, 60))) for i in range(1500)]
    rows += [(2000 + i, 30, "twin", "", "balbal bal") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, post_count int, title string, _t string, search_text string")
    wiki = materialize(df.select("id", "post_count", "title", F.replace("title", F.lit("_"), F.lit(" ")).alias("search_title"), "search_text"), "w")
    postings = materialize(W.build_search_index(wiki), "p", sort_by=["term", "id"])
    written = {"dictionary": materialize(W.term_dictionary(postings), "d"), "stats": materialize(W.corpus_stats(wiki), "s")}
    return wiki, postings, written, materialize(T.block_index(wiki, postings, written["stats"]), "b")


@pytest.fixture(scope="module")
def queries(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate([*texts, "", "the and", "nosuchword", "bal", "twin", "bal the bal"])), "qid int, text string")


def rows_of(df):
    return sorted((r.qid, r.rank, r.title, r.post_count, *[round(r[c], 6) for c in ("title_score", "text_score", "total_score")]) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 5, 30])
def test_same_rows_as_scoring_every_page(corpus, queries, limit):
    wiki, postings, written, blocks = corpus
    want = rows_of(W.batch_query_wiki(wiki, postings, queries, limit, **written))
    assert rows_of(T.batch_top_k(wiki, blocks, queries, limit=limit, **written)) == want and want


def test_fewer_scored_pairs(corpus, queries):
    wiki, postings, written, blocks = corpus
    terms = materialize(T.query_terms(queries, written["dictionary"], written["stats"].select("n_docs").scalar(), "qid", "text", W.DEFAULT_OPTIONS), "t")
    every = terms.join(postings, "term").select("qid", "id").distinct().count()
    assert T.top_pages(terms, blocks, 5).count() < 0.5 * every


def test_no_page_exceeds_its_blocks_bound(corpus, queries):
    wiki, postings, written, blocks = corpus
    terms = T.query_terms(queries, written["dictionary"], written["stats"].select("n_docs").scalar(), "qid", "text", W.DEFAULT_OPTIONS)
    bounds = T.block_bounds(terms, blocks).select("qid", "block", F.struct("t0", "total").alias("bound"))
    place = T.page_blocks(wiki).select("id", "block")
    scores = T.scored_pages(bounds, terms, blocks).join(place, "id").join(bounds, ["qid", "block"])
    assert scores.where(F.struct("t0", "total") > F.col("bound")).count() == 0 and scores.count() > 1000


def test_every_posting_is_in_one_block(corpus):
    wiki, postings, _, blocks = corpus
    held = blocks.select("term", F.inline("entries")).select("term", "id")
    assert held.count() == held.distinct().count() == postings.select("term", "id").distinct().count()
    assert T.page_blocks(wiki).groupBy("block").count().agg(F.max("count")).first()[0] < 4 * T.BLOCK_PAGES


def test_title_search_scores_few_tokens(corpus):
    wiki, *_ = corpus
    titles = materialize(Z.title_postings(wiki), "tp")
    tokens = materialize(Z.title_tokens(titles), "tt")
    for terms in (["balbal"], ["bal", "dem"], ["bel", "dur", "xq"], ["a", "b", "c", "d", "e"], ["dum"], ["DUM"], ["d-m"]):
        every = W.title_similarity(wiki, terms).where("title_score >= 0.8")
        want = sorted((r.id, round(r.title_score, 9)) for r in every.collect())
        assert sorted((r.id, round(r.title_score, 9)) for r in Z.title_matches(titles, tokens, terms).collect()) == want
    pairs = Z.candidates(tokens, ["balbal"]).count()
    assert 0 < pairs < 0.2 * tokens.count()


def test_bound_is_never_below_the_similarity(spark):
    draw = random.Random(2)
    make = lambda: "".join(draw.choice("abc1") for _ in range(draw.randrange(0, 8)))
    tokens = sorted({make() for _ in range(300)})
    df = Z.title_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"))
    terms = [make() or "a" for _ in range(25)]
    rows = df.select("token", *[Z.similarity_bound(t).alias(f"b{i}") for i, t in enumerate(terms)]).collect()
    for r in rows:
        for i, t in enumerate(terms):
            assert r[f"b{i}"] >= jaro_winkler(t, r.token) - 1e-9, (t, r.token)
