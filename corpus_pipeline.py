"""The corpus pipeline: five stages over ``documents``, each written and read again before the next one.

1. toxicity: documents whose toxicity score reaches 0.3 go.
2. rules: documents that the quality rules or their host's verdict reject go.
3. neardup: of the documents of a near-duplicate component (Jaccard 0.8 or more), its least id stays, in one row for each
   different text that bears it.
4. decontaminate: documents with words of a benchmark window go.
5. bpe: every document is encoded; the digests of its ids and of the bytes they decode to are returned.

All stages but the last return the columns of their input. Rows with a null id take part in every stage; they have no
labels to learn from and no duplicates. An empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, neardup, rules, toxicity
from tagloom.llm.common import kept_table, table
from tagloom.llm.labels import training_labels

TOXIC_FROM = 0.3
ALIKE_FROM = 80     # percent of shared five-word shingles; op9_neardup has its own threshold


def filtered(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep`` over the documents, whose other columns bear plain numbers meanwhile: none can clash with its own."""
    names = {c if c in ("doc_id", "text", "source") else f"_c{i}": c for i, c in enumerate(docs.columns)}
    return keep(docs.toDF(*names)).select(*[F.col(a).alias(b) for a, b in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return filtered(docs, lambda d: toxicity.score(d, model).filter(F.col("score") < TOXIC_FROM))


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counted once for the hosts' rates and once for the verdicts: the counts are cheaper than moving the texts."""
    return filtered(docs, lambda d: rules.judge(d).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged by id and text: only the (id, text digest) pairs to drop meet the documents. Of rows that repeat a
    kept id and its text one stays."""
    found = kept_table(neardup.near_duplicates(docs, percent=ALIKE_FROM, digest=True), "near-duplicates")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.withColumnsRenamed(names).withColumn("digest", neardup.text_digest("text"))
    gone = found.filter("not kept").select("doc_id", "digest").distinct()
    left = rows.join(gone, ["doc_id", "digest"], "left_anti")
    again = (found.filter("kept and doc_id is not null").groupBy("doc_id", "digest").count().filter("count > 1")
             .select("doc_id", "digest"))
    if not again.isEmpty():
        one = left.join(again, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
        left = left.join(again, ["doc_id", "digest"], "left_anti").unionByName(one)
    return left.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return filtered(docs, lambda d: decontaminate.decontaminate(d, items, keep=d.columns).filter(F.size("hit") == 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("rules", drop_rejected), ("neardup", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Learned scores and BPE have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
