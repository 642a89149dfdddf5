"""Quality rules judged per host.

Each document is held against rules on its whole text. A strong failure is junk on any host, and so are two failures of
one document. A single weak failure (some repeated passages, long words, ...) says little by itself, so the host tips the
balance: weak failures are summed per host; the hosts' failure rates have an empirical beta prior (its mean is the
corpus's rate, its strength comes from the spread of the hosts' rates), and each host's rate is shrunk towards it. A host
whose posterior probability of being worse than the corpus in a rule is above 75 % (by the normal approximation of the
beta posterior) is not trusted in that rule: its documents that fail the rule go; on other hosts they stay. A document
that fails no rule is always kept, whatever its host; one that fails the base rule always goes.

The host is ``documents.source``; a null host is a host of its own. Null and empty texts have no words and fail the base
rule. Repeated rows count and are judged each; an empty table gives no rows. Columns named like a result are replaced, all
others pass through. A text is held whole by one task, however long. Sums are integers per host, gathered before they are
shuffled, so a host with a third of all rows is one row a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, free_name, kept_table, map_batches, utf8, window_hashes, word_hashes

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
HOST_DOUBT = 0.6745         # standard deviations that a host's posterior rate lies above the corpus's rate: 75 % of a normal
MAX_STRENGTH = 1000.0       # documents that the prior weighs as much as, at most
SYMBOLS = b"#*$%&|<>"
#: Weak failures: symbols, repeated lines, repeated words (per word), characters per word.
RULES = {"symbols": "100 * n_symbols > 10 * n_words", "lines": "50 * n_dup_lines > n_words",
         "repeats": "100 * n_repeat_words > 10 * n_words",
         "lengths": "n_words > 0 and (word_chars < 2 * n_words or 2 * word_chars > 15 * n_words)"}
#: Strong failures. Word length has none: scripts without blanks have long words everywhere.
STRONG = ["100 * n_symbols > 30 * n_words", "5 * n_dup_lines > n_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of a text, in the order of ``COUNTS``."""
    if not text:
        return 0, 0, 0, 0, 0
    hashes = word_hashes(text)
    data = np.frombuffer(text, np.uint8)
    blanks = int((((data >= 9) & (data <= 13)) | (data == 32)).sum())
    chars = int(((data & 0xC0) != 0x80).sum()) - blanks
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = window_hashes(hashes, WINDOW)
    repeated = 0
    if len(windows):
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        edge = np.zeros(len(hashes) + 1, np.int64)
        begin = np.flatnonzero(n[at] > 1)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + WINDOW, -1)
        repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(hashes), chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (such columns of its own are replaced)."""
    kept = docs.drop(*COUNTS)
    src = kept.withColumn(free_name(kept, "_utf8"), utf8(text_col))

    def run(batch: pa.RecordBatch):
        found = zip(*(counts(t) for t in blob(batch.column(batch.num_columns - 1))), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in found)],
                                         [*batch.schema.names[:-1], *COUNTS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(src, run, f"{schema}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(rows: DataFrame, host_col: str) -> DataFrame:
    """``host, n`` and, per rule, ``<rule>_rate`` (shrunk failure rate) and ``<rule>_worse`` (the host is not trusted in
    it). ``rows`` has the counts.

    The prior per rule is fitted by moments over the hosts, weighted by documents: mean m = failures / documents, and
    strength s = m (1 - m) / v - 1 with v the variance of the hosts' rates around m beyond binomial noise (kept between
    1 and ``MAX_STRENGTH``; the latter where there is none). The posterior is a beta distribution of failures + s m and
    successes + s (1 - m): its mean is the shrunk rate."""
    sums = rows.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"CAST({e} AS BIGINT)")).alias(r) for r, e in RULES.items()])
    total = sums.agg(F.sum("n").alias("all_n"), *[F.sum(r).alias(f"all_{r}") for r in RULES])
    sums = sums.crossJoin(F.broadcast(total))      # one row: the totals
    mean = {r: F.col(f"all_{r}") / F.col("all_n") for r in RULES}
    spread = sums.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], 2) / F.col("all_n")
                              - mean[r] * (1 - mean[r]) / F.col("all_n")).alias(f"v_{r}") for r in RULES])
    sums = sums.crossJoin(F.broadcast(spread))     # one row: the variances
    out = []
    for r in RULES:
        strength = F.when(F.col(f"v_{r}") > 0, F.greatest(F.lit(1.0), F.least(
            F.lit(MAX_STRENGTH), mean[r] * (1 - mean[r]) / F.col(f"v_{r}") - 1))).otherwise(MAX_STRENGTH)
        weight = F.col("n") + strength
        rate = (F.col(r) + strength * mean[r]) / weight
        worse = rate - mean[r] > HOST_DOUBT * F.sqrt(rate * (1 - rate) / (weight + 1))
        out += [rate.alias(f"{r}_rate"), worse.alias(f"{r}_worse")]
    return sums.select("host", "n", *out)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``. The counts are taken twice, for the hosts' rates and for the
    verdicts; a caller who would rather write them down calls ``judge_counted`` on the written rows."""
    return judge_counted(with_counts(docs, text_col), host_col)


def judge_counted(rows: DataFrame, host_col: str = "source") -> DataFrame:
    """``rows`` (with the counts) and the verdicts of their hosts."""
    rows = rows.drop("base_failed", "kept")
    rates = kept_table(host_rates(rows, host_col), "host-rates")
    host, worse = free_name(rows, "_host"), {r: free_name(rows, f"_{r}") for r in RULES}
    rates = rates.select(F.col("host").alias(host), *[F.col(f"{r}_worse").alias(worse[r]) for r in RULES])
    failed = {r: F.expr(e) for r, e in RULES.items()}
    n_failed = sum((f.cast("int") for f in failed.values()), F.lit(0))
    gone = n_failed > 1
    for e in STRONG:
        gone = gone | F.expr(e)
    for r in RULES:
        gone = gone | (failed[r] & F.coalesce(worse[r], F.lit(False)))
    joined = rows.join(rates, F.col(host_col).eqNullSafe(F.col(host)), "left")
    return (joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~gone)
            .select(*[F.col(f"`{c}`") for c in rows.columns], "base_failed", "kept"))
