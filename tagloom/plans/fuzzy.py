"""Fuzzy title search over an index of title tokens: only tokens that can reach the needed similarity are scored.

The index holds every distinct title token once, with its length and how often each letter and digit occurs in it, and the pages of
every token. For a term a and a token b with c characters in common (as multisets), at most c can match, so

    Jaro(a, b) <= (c / |a| + c / |b| + 1) / 3        (0 if c = 0)

and Jaro-Winkler, which grows with Jaro, is at most this bound raised by the length of the common prefix. A page passes with
a mean of ``PASS`` over T terms, so each term needs a token of at least 1 - T (1 - PASS) similarity: tokens whose bound lies
below are never scored, and pages that lack a token for some term are dropped before any sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.jaro import jaro_winkler_udf
from tagloom.functions.text import TOKEN_SEPARATOR

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"       # of title tokens
PASS = 0.8
SLACK = 1e-9


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def title_postings(wiki: DataFrame) -> DataFrame:
    """``(token, id, title, post_count)``, a row per distinct token of a page's title; titles are cut outside ``[a-z0-9]``."""
    tokens = F.array_distinct(F.split("title", TOKEN_SEPARATOR, -1))
    return wiki.select(F.explode(tokens).alias("token"), "id", "title", "post_count")


def title_tokens(postings: DataFrame) -> DataFrame:
    """``(token, size, counts)`` of every distinct token: its signature."""
    token = F.col("token")
    return postings.select("token").distinct().select(
        "token", F.length(token).alias("size"), F.array(*[_count(token, c).cast("tinyint") for c in ALPHABET]).alias("counts"))


def needed(terms: int) -> float:
    """The similarity that each of so many terms needs for a page to pass."""
    return max(0.0, 1 - terms * (1 - PASS))


def similarity_bound(term: str) -> Column:
    """An upper bound of the term's Jaro-Winkler similarity to a row of :func:`title_tokens`."""
    token, size, counts, length = F.col("token"), F.col("size"), F.col("counts"), len(term.encode())
    shared = F.lit(0)
    for i, c in enumerate(ALPHABET):
        if c in term:
            shared = shared + F.least(F.lit(term.count(c)), counts[i].cast("int"))
    jaro = F.when(shared > 0, (shared / length + shared / size + 1) / 3).otherwise(0.0)
    prefix = F.lit(0)
    for k in range(1, min(4, len(term)) + 1):
        prefix = prefix + F.when(token.startswith(term[:k]), 1).otherwise(0)
    return F.when(jaro > 0.7 - SLACK, jaro + prefix * 0.1 * (1 - jaro)).otherwise(jaro)


def candidates(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """``(qi, term, token)``: the pairs to be scored."""
    least = needed(len(terms)) - SLACK
    listed = F.array(*[F.when((similarity_bound(t) >= least) & (similarity_bound(t) > 0), F.struct(F.lit(i).alias("qi"), F.lit(t).alias("term")))
                       for i, t in enumerate(terms)])
    return tokens.select("token", F.inline(F.filter(listed, lambda x: x.isNotNull()))).select("qi", "term", "token")


def title_matches(postings: DataFrame, tokens: DataFrame, terms: list[str]) -> DataFrame:
    """``(id, title, post_count, title_score)`` of the pages with a mean similarity of at least ``PASS``."""
    sims = candidates(tokens, terms).withColumn("sim", jaro_winkler_udf(F.col("term"), F.col("token")))
    least = needed(len(terms))
    sims = sims.where(F.col("sim") >= least - SLACK)
    best = postings.join(sims, "token").groupBy("id", "title", "post_count", "qi").agg(F.max("sim").alias("sim"))
    score = F.sum("sim") / len(terms)
    scored = best.groupBy("id", "title", "post_count").agg(score.alias("title_score"), F.count(F.lit(1)).alias("n"))
    if least > 0:
        scored = scored.where(F.col("n") == len(terms))
    return scored.where(F.col("title_score") >= PASS).drop("n")
