"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, a clause into tokens. A lexicon transducer turns each token into a symbol: insult (with a
weight), threat, target, negation, report or other. The clause transducer reads the symbols from left to right; its
states say whether a target was named, whether a negation still reaches, and whether speech is being reported, and its
arcs for insults and threats emit a weighted match of the kind that the state says: plain, aimed (a target near it),
negated or reported. A document's score is the logistic of its matches' summed weights by kind.

The insult lexicon, its weights and the kinds' weights are learned from labelled texts: tokens and token beginnings
that occur in toxic texts far more often than in others. Threat, target, negation and report words are fixed lists of
function words and verbs of the four languages.

Null and empty texts have no clauses and get the score of no match. Repeated rows get equal scores; ids and other
columns take no part. A learning set without toxic texts gives an empty lexicon and the base rate as every score."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, free_name, map_batches, utf8, worker_state

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PLAIN, AIMED, NEGATED, REPORTED = range(4)      # kinds of a match
REACH = 3                                       # tokens a target or a negation reaches to
MIN_TEXTS = 3                                   # toxic learning texts that a lexicon entry occurs in at least
MIN_LOG_ODDS = 2.5
MAX_ENTRIES = 5_000                             # lexicon entries with the highest weight; it is broadcast
CACHE_ENTRIES = 150_000
N_FEATURES = 9
COUNTER_KEYS = 200_000                          # keys that a learning task holds before it passes their counts on

#: Fixed word lists.
TARGETS = "you your yours yourself u he she they them his her their tu te toi vous votre vos il elle ils du dich dir ihr euch dein deine sie usted ustedes ti vosotros ellos ellas"
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún ninguna"
REPORTS = "said says say called calls wrote writes quoted told claims dit disait appelle écrit sagt sagte nennt nannte schrieb dijo dice llamó escribió"
THREATS = "kill hurt destroy beat tuer frapper détruire töten schlagen zerstören matar golpear destruir"
_WORDS = {w.encode(): s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))
          for w in ws.split()}
_EDGE = b".,;:!?\"'()[]{}<>#*$%&|-_~/\\"
_CLAUSE_END = re.compile(rb"[.!?;\n]+")
_LENGTHS = range(3, 9)                          # characters of a token's beginning


def beginnings(token: bytes) -> list[bytes]:
    """Lexicon keys of a token: its beginnings, marked by ``*``, and itself."""
    word = token.decode("utf-8", "replace")
    return [f"{word[:n]}*".encode() for n in _LENGTHS if n <= len(word)] + [token]


class Symbols(dict):
    """Token -> (symbol, weight), remembered; forgets all when full."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: bytes) -> tuple[int, float]:
        word = token.strip(_EDGE)
        known = _WORDS.get(word, OTHER)
        best = max((self.lexicon.get(k, 0.0) for k in beginnings(word)), default=0.0) if word else 0.0
        out = (INSULT, best) if best and known == OTHER else (known, MIN_LOG_ODDS if known == THREAT else 0.0)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = out
        return out


def read_clause(symbols: list[tuple[int, float]]) -> list[tuple[int, float, int]]:
    """The clause transducer: (kind, weight, token number) of each match."""
    out: list[tuple[int, float, int]] = []
    target = negation = -REACH - 1      # where the last one was
    reported = False
    open_at = None                      # a plain match that a target may still follow
    threat = None                       # a threat that a target may still follow
    for i, (symbol, weight) in enumerate(symbols):
        if symbol == TARGET:
            target = i
            if open_at is not None and i - out[open_at][2] <= REACH:
                out[open_at] = (AIMED, *out[open_at][1:])
            if threat is not None and i - threat[2] <= REACH:
                out.append(threat)
            open_at = threat = None
        elif symbol == NEGATION:
            negation = i
        elif symbol == REPORT:
            reported = True
        elif symbol in (INSULT, THREAT):
            if reported:
                kind = REPORTED
            elif i - negation <= REACH:
                kind = NEGATED
            elif i - target <= REACH:
                kind = AIMED
            elif symbol == THREAT:
                threat = (AIMED, weight, i)     # it counts once someone is named whom it is aimed at
                continue
            else:
                kind, open_at = PLAIN, len(out)
            out.append((kind, weight, i))
    return out


def features(text: bytes, symbols: Symbols) -> np.ndarray:
    """Per kind: log of 1 + summed weight of the matches, and their strongest weight; last, the log of 1 + all weight
    per 100 tokens."""
    total, top = np.zeros(4), np.zeros(4)
    found = matches(text, symbols)
    for kind, weight, _ in found:
        total[kind] += weight
        top[kind] = max(top[kind], weight)
    share = 100 * total.sum() / len(text.split()) if found else 0.0
    return np.concatenate((np.log1p(total), top, [np.log1p(share)]))


def matches(text: bytes, symbols: Symbols) -> list[tuple[int, float, int]]:
    """Matches of all clauses; clauses without an insult or threat are not read."""
    text = text.lower()
    look = symbols.__getitem__
    found = [s for s in set(map(look, set(text.split()))) if s[0] in (INSULT, THREAT)]
    if not found:
        return []
    out: list[tuple[int, float, int]] = []
    for clause in _CLAUSE_END.split(text):
        read = list(map(look, clause.split()))
        if any(s[0] in (INSULT, THREAT) for s in read):
            out += read_clause(read)
    return out


def learn_lexicon(texts: DataFrame) -> dict[bytes, float]:
    """Entries and weights (log odds) from ``text, label`` rows: text counts per key are summed by Spark, and only
    keys of enough toxic texts, at most ``MAX_ENTRIES``, come to the driver."""
    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            keys = list(seen[1].keys() | seen[0].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                               pa.array([seen[0][k] for k in keys], pa.int64())], ["k", "pos", "neg"])
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(_EDGE) for w in (text.as_py() or b"").lower().split()} - {b""}
                seen[label].update({k for w in words for k in beginnings(w)})
                if len(seen[0]) + len(seen[1]) > COUNTER_KEYS:
                    yield out()
                    seen = {0: Counter(), 1: Counter()}
        yield out()

    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = texts.mapInArrow(run, "k binary, pos long, neg long").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = (F.log((F.col("pos") + 0.1) / (n.get(1, 0) + 0.2)) - F.log((F.col("neg") + 0.1) / (n.get(0, 0) + 0.2)))
    rows = (counts.withColumn("odds", odds).filter((F.col("pos") >= MIN_TEXTS) & (F.col("odds") >= MIN_LOG_ODDS))
            .orderBy(F.desc("odds"), F.desc("pos"), "k").limit(MAX_ENTRIES).collect())
    return {bytes(r["k"]): float(r["odds"]) for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(rate / (1 - rate))
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * np.append(w[:-1], 0))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, np.ndarray]:
    """Lexicon and weights of the kinds. ``labelled`` has a bounded number of rows (``doc_id, label``): it is broadcast
    to the documents. The kinds' weights are learned on texts the lexicon was not learned from: each half of the texts
    is read with the other half's lexicon; scoring then uses the lexicon of all."""
    texts = (docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
             .join(F.broadcast(labelled), "doc_id").select("text", "label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16 < 8).alias("half")))
    texts = texts.persist()
    try:
        data = []
        for half in (True, False):
            other = learn_lexicon(texts.filter(F.col("half") != half).select("text", "label"))

            def run(batch: pa.RecordBatch, lexicon=other):
                symbols = Symbols(lexicon)
                rows = [features(t, symbols) for t in blob(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

            data += map_batches(texts.filter(F.col("half") == half).select("text", "label"), run, "x array<double>, label int").collect()
        x = np.array([r["x"] for r in data]).reshape(-1, N_FEATURES)
        y = np.array([r["label"] for r in data], float)
        return learn_lexicon(texts.select("text", "label")), fit_logistic(x, y)
    finally:
        texts.unpersist()


def score(docs: DataFrame, model: tuple[dict, np.ndarray], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity score; all columns pass through (one of the score's name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))
    kept = docs.drop(score_col)
    src = kept.withColumn(free_name(kept, "_utf8"), utf8(text_col))

    def run(batch: pa.RecordBatch):
        key, lexicon, weights = shared.value
        symbols = worker_state("toxicity", key, "symbols", lambda: Symbols(lexicon))
        x = np.array([features(t, symbols) for t in blob(batch.column(batch.num_columns - 1))])
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(src, run, f"{schema}, `{score_col}` double")
