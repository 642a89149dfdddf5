import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from tagloom.llm import bpe
from llm.test_decontaminate import brute as leaks
from llm.test_neardup import brute as duplicates

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against a brute-force version over what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {name: None for name, _ in P.STAGES}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        rows = after.collect()
        left[name] = len(rows)
        if name != "bpe":
            assert after.columns == docs.columns
            kept = {r["doc_id"] for r in rows}
            assert len(kept) == len(rows) and all(before[k] == r for k, r in ((r["doc_id"], r) for r in rows))
        if name == "neardup":
            firsts = {eval(x)[2] for x in duplicates([(k, r["text"]) for k, r in before.items()], 80)}
            assert kept == firsts
        if name == "decontaminate":
            assert kept == {k for k, r in before.items() if not leaks(r["text"], bench)[1]}
        if name == "bpe":
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = {k: hashlib.sha256(np.array(enc.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest() for k, r in before.items()}
            assert {r["doc_id"]: r["ids_sha256"] for r in rows} == want
            assert all(r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]]["text"] or "").encode()).hexdigest() for r in rows)
        docs = spark.createDataFrame(rows, after.schema)
    assert 0 < left["bpe"] < 200
    assert P.run(spark, SF).count() == left["bpe"]


def test_copies_from_four_fifths_go(docs, spark):
    """Pairs at Jaccard 0.80 and 0.83 lose their later document, a pair at 0.78 keeps both."""
    rows = []
    for k, shared in enumerate((88, 91, 87)):       # of 99 shingles each: 88 / 110, 91 / 107, 87 / 111
        a, b = ([f"{t}{k}-{j}" for j in range(99 - shared)] for t in "ab")
        both = [f"w{k}-{j}" for j in range(shared + 4)]
        rows += [(2 * k, " ".join(both + a)), (2 * k + 1, " ".join(both + b))]
    assert sorted(r["doc_id"] for r in P.drop_near_duplicates(spark, docs(rows), SF).collect()) == [0, 2, 4, 5]


def test_repeated_ids_are_judged_by_their_texts(docs, spark):
    """A unique text stays though its id also bears a copy; the copy goes; an exact repeat of a kept row goes."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a text of its own that no other has"), (3, "x y"), (3, "x y"), (3, "z")]
    got = sorted((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs(rows), SF).collect())
    assert got == [(1, "a b c d e f g"), (2, "a text of its own that no other has"), (3, "x y"), (3, "z")]


def test_clean_documents_stay(spark):
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    clean = docs.join(marks.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    long = clean.filter("n_chars > 300")
    for stage in (P.drop_toxic, P.drop_rejected):
        kept = stage(spark, docs, "/root/testdata/sf0.1")
        assert kept.join(long, "doc_id", "left_semi").count() > 0.98 * long.count()


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_odd_and_empty_rows(odd, docs, spark, name, stage):
    out = stage(spark, odd, SF)
    assert out.count() <= odd.count() and (name == "bpe" or out.columns == odd.columns)
    if name != "bpe":
        assert out.schema == odd.schema and {r["n_words"] for r in out.collect()} <= {7}
    if name == "neardup":
        rows = out.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "None", "5", "6"])
    assert stage(spark, docs([]), SF).count() == 0
