"""The queries of this package, with the digests that their contracts ask for, and DuckDB SQL where it can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, chat, decontaminate, lm, neardup, q_audit, q_codes, q_exact, quality, rules, toxicity, urls, warc
from tagloom.llm.common import fold, kept_table, table, utf8
from tagloom.llm.labels import training_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sha256_of(col) -> F.Column:
    return F.sha2(col, 256)


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select("doc_id", "n_tokens", sha256_of("ids").alias("ids_sha256"),
                                         sha256_of("decoded").alias("decoded_sha256"))


CONFLICT = "</s>[INST] ok [/INST]"      # fixed by the contract: a text full of control strings


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], rows.schema)
    done = chat.format_conversations(rows.unionByName(planted))
    loss = chat.under_mask(F.col("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumns({"loss": loss, "spoken": spoken})
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_of(utf8("spoken")).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), sha256_of(utf8("loss")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op5_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (
  SELECT *, CASE WHEN contains(role || chr(10) || text, '</s>') OR contains(role || chr(10) || text, '<s>')
    OR contains(role || chr(10) || text, '<s esc>') OR contains(role, chr(10))
    THEN length('<s esc></s>') + 1 + length(role || text) + length(regexp_replace(role || text, '[^~<]', '', 'g'))
         + length(regexp_replace(role, '[^\n]', '', 'g'))
    ELSE length('<s></s>') + 1 + length(role || text) END AS shown FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return done.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       sha256_of(F.array_join("items", ",").cast("binary")).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))


ORACLES["op6_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
slots AS (
  SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS MATERIALIZED (SELECT row_id, item, i, a.size FROM slots a JOIN wins b ON a.size = b.size AND a.win = b.win),
words AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)"""


#: Fixed by the contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


ORACLES["op8_urls"] = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS row_id, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
m AS (
  SELECT row_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (row_id)"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files, folder = warc.archive(spark, pages)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(files, folder).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


ORACLES["op10_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (html)"""


@query
def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op9_neardup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n"""


@query
def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = kept_table(rules.with_counts(docs).drop("text"), "rule-counts")
    return rules.judge_counted(counted).select("doc_id", *rules.COUNTS, "base_failed", "kept")


_RULE_NAMES = ["symbols", "lines", "repeats", "lengths"]
_each = ", ".join
ORACLES["op3_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
c AS MATERIALIZED (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (rid) LEFT JOIN hit USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    (n_symbols > 0.1 * n_words)::INT AS symbols, (n_dup_lines > 0.02 * n_words)::INT AS lines,
    (n_repeat_words > 0.1 * n_words)::INT AS repeats,
    (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 7.5 * n_words))::INT AS lengths,
    n_symbols > 0.3 * n_words OR n_dup_lines > 0.2 * n_words AS strong FROM c),
h AS (SELECT source, count(*) AS n, """ + _each(f"sum({r}) AS {r}" for r in _RULE_NAMES) + """ FROM f GROUP BY source),
a AS (SELECT sum(n) AS n, """ + _each(f"sum({r}) / sum(n) AS m_{r}" for r in _RULE_NAMES) + """ FROM h),
v AS (SELECT """ + _each(f"sum(h.n * pow({r} / h.n - m_{r}, 2) / a.n - m_{r} * (1 - m_{r}) / a.n) AS v_{r}" for r in _RULE_NAMES) + """ FROM h, a),
s AS (SELECT """ + _each(
    f"CASE WHEN v_{r} > 0 THEN greatest(1.0, least(1000.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1000.0 END AS s_{r}"
    for r in _RULE_NAMES) + """ FROM v, a),
post AS (SELECT source, """ + _each(f"h.n + s_{r} AS w_{r}, ({r} + s_{r} * m_{r}) / (h.n + s_{r}) AS p_{r}, m_{r}" for r in _RULE_NAMES) + """ FROM h, a, s),
bad AS (SELECT source, """ + _each(
    f"p_{r} - m_{r} > 0.6745 * sqrt(p_{r} * (1 - p_{r}) / (w_{r} + 1)) AS bad_{r}" for r in _RULE_NAMES) + """ FROM post)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT strong AND """ + " + ".join(_RULE_NAMES) + """ < 2 AND NOT (""" + " OR ".join(
    f"{r} = 1 AND bad_{r}" for r in _RULE_NAMES) + """) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return toxicity.score(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_table(quality.with_statistics(table(spark, sf_dir, "documents"), "doc_id", "text"), "statistics")
    model = quality.fit(rows, training_labels(table(spark, sf_dir, "labels"), "quality", 5, 0))
    return quality.score(rows, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = docs.filter(~fold("doc_id", 5, 1)).select(utf8("text").alias("text"))
    counts = kept_table(lm.token_counts(texts), "token-counts")
    vocabulary = lm.Vocabulary(counts)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary))
    weights = lm.fit(kept_table(lm.stretches(texts, shared), "stretches"), vocabulary)
    return lm.score(docs, counts, vocabulary, weights).select(
        "doc_id", fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")


query(q_audit.op11_audit)
ORACLES["op11_audit"] = q_audit.SQL

query(q_exact.op13_exact)
ORACLES["op13_exact"] = q_exact.SQL

query(q_codes.op12_codes)
ORACLES["op12_codes"] = q_codes.SQL
