"""Language-model scoring: a gated recurrent network with a class-factored output.

Tokens are lower-cased words and one end per text. Counts of all training tokens are summed by Spark. The commonest words
(``HEAD`` at most, five occurrences at least) are predicted one by one: a class softmax, then a softmax among the class's
words. All other words belong to classes of like counts: the network predicts the class, and within it a word has the
share (c + 0.5) / sum (c + 0.5). The last class holds the words outside the broadcast dictionary and everything unseen,
so the model gives every text a probability, and the counts of its words meet them in a join instead of in memory.

Training: all tokens of every training text are written as ids; tasks run truncated backpropagation over them, the state
carried across windows, and their weights are averaged by Spark after each round. A text is cut only where a lane ends;
the next lane goes on with its next token, from the empty state. Scoring carries the state across windows from a text's
first token to its end.

Null text is empty: it has one token, its end. Repeated rows get equal rows. Null ids belong to the training texts."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, kept_table, utf8, worker_state

HEAD, HEAD_COUNT, GROUP = 4096, 5, 128      # words predicted one by one; their least count; words in a class
DICTIONARY = 1 << 18                        # words whose counts are broadcast, at most
STATE, INPUT = 32, 24                       # width of the recurrent state and of the input vectors
WINDOW, LANES, RATE, ROUNDS = 16, 128, 0.08, 2
LANE_TOKENS = 1024                          # a task has a lane for so many tokens, or for each text if that is more
COUNTER_KEYS = 300_000                      # distinct tokens a task holds before it passes their counts on
BUFFER_TOKENS, BUFFER_TEXTS = 3_000_000, 8192
SIDE, SCORED = 512, 8192                    # texts scored side by side; states that meet the outputs at once, about
LN10 = float(np.log(10.0))
ONE = np.float32(1)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


# ---- counts and vocabulary -------------------------------------------------------------------------------------

def token_counts(texts: DataFrame) -> DataFrame:
    """``token, c`` over all texts; the end of a text is the empty token."""
    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              ["token", "c"])
        for batch in batches:
            for text in blob(batch.column(0)):
                held.update(tokens(text))
                held[b""] += 1
                if len(held) > COUNTER_KEYS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a task needs to know of the counts: the dictionary's words (index -> unit, log shares) and the layout.

    Units of the network: 0 the end, then the head words, then the classes of like counts, then the class of the rest.
    Index ``len(words)`` stands for every word outside the dictionary."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total["n"] or 0), int(total["v"])
        step = F.floor(F.log2("c") * 32)
        sizes = counts.filter("length(token) > 0").groupBy(step.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
        limit, held = 1 << 62, 0      # the least count of a dictionary word
        for r in sizes:
            held += r["n"]
            if held > DICTIONARY or r["c"] < 2:
                break
            limit = r["c"]
        rows = counts.filter((F.col("c") >= limit) & (F.length("token") > 0)).collect() if limit < 1 << 62 else []
        rows = sorted(((int(r["c"]), bytes(r["token"])) for r in rows), key=lambda x: (-x[0], x[1]))
        self.least = limit
        end = counts.filter("length(token) = 0").first()
        self.end_count = int(end["c"]) if end else 0
        self.words = [w for _, w in rows]
        c = np.array([x for x, _ in rows] + [0], float)
        head = int(min(HEAD - 1, (c >= HEAD_COUNT).sum()))
        self.head = head + 1                                    # with the end
        kind = np.floor(np.log2(np.maximum(c, 1))).astype(int)
        kinds = {k: i for i, k in enumerate(sorted(set(kind[head:-1].tolist()), reverse=True))}
        self.units = self.head + len(kinds) + 1
        self.unit = np.array([i + 1 if i < head else self.head + kinds[k] for i, k in enumerate(kind[:-1].tolist())]
                             + [self.units - 1], np.int32)
        rest = counts.filter((F.col("c") < limit) & (F.length("token") > 0)).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.rest_mass = float(rest["n"] or 0) + 0.5 * (rest["v"] + 1)      # one type more for all that is unseen
        self.log_all = float(np.log10(self.n + 0.5 * (self.v + 1)))
        self.base = (np.log10(c + 0.5) - self.log_all)          # by index; the last is filled by the join
        self.base[-1] = 0.0
        mass = np.zeros(self.units)
        np.add.at(mass, self.unit[:-1], c[:-1] + 0.5)
        mass[0], mass[-1] = self.end_count + 0.5, self.rest_mass
        self.mass = mass
        self.within = np.zeros(len(c))                          # log10 share of a word within its class
        tail = np.arange(len(c) - 1) >= head
        self.within[:-1][tail] = np.log10((c[:-1][tail] + 0.5) / mass[self.unit[:-1][tail]])
        self.base_end = float(np.log10(self.end_count + 0.5) - self.log_all)

    def index(self) -> dict[bytes, int]:
        rest = len(self.words)

        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                return rest

        return Index((w, i) for i, w in enumerate(self.words))


# ---- the network -----------------------------------------------------------------------------------------------

def first_weights(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the outputs' biases are the logs of the counts."""
    draw = np.random.default_rng(3)
    head, units = vocabulary.head, vocabulary.units
    groups = -(-head // GROUP)
    classes = groups + units - head
    mass = np.zeros(groups * GROUP)
    mass[:head] = vocabulary.mass[:head]
    by_class = np.concatenate((mass.reshape(groups, GROUP).sum(axis=1), vocabulary.mass[head:]))
    log = lambda x: np.log(np.maximum(x, 1e-9))
    w = {"vector": draw.normal(0, 0.1, (units, INPUT)), "inward": draw.normal(0, INPUT ** -0.5, (INPUT, 3 * STATE)),
         "again": draw.normal(0, 0.5 * STATE ** -0.5, (STATE, 3 * STATE)), "bias": np.zeros(3 * STATE),
         "class": np.zeros((STATE, classes)), "class_bias": log(by_class) - log(by_class.sum()),
         "word": np.zeros((groups, STATE, GROUP)),
         "word_bias": np.where(mass > 0, log(mass), -30.0).reshape(groups, GROUP)}
    w["word_bias"] -= w["word_bias"].max(axis=1, keepdims=True)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _parts(x: np.ndarray) -> np.ndarray:
    """The three parts (keep, look, new) of the last axis, one behind the other: products then write each in one piece."""
    return np.array(np.moveaxis(x.reshape(*x.shape[:-1], 3, STATE), -2, 0), order="C")


def _turned(parts: np.ndarray) -> np.ndarray:
    """The sign of what goes into the gates is turned: a sigmoid is 1 / (1 + exp of minus its argument)."""
    np.negative(parts[:2], out=parts[:2])
    return parts


def _advance(h: np.ndarray, into: np.ndarray, again: np.ndarray, gates: np.ndarray, new: np.ndarray, after: np.ndarray) -> None:
    """One step of the gated unit over ``_turned`` parts. ``gates`` gets keep, look and the old state's share, ``after``
    the new state."""
    np.matmul(h, again, out=gates)
    keep, look, old = gates
    both = gates[:2]
    both += into[:2]
    with np.errstate(over="ignore"):           # an infinite exponential closes the gate
        np.exp(both, out=both)
    both += ONE
    np.divide(ONE, both, out=both)
    np.multiply(look, old, out=new)
    new += into[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=after)
    after *= keep
    after += new


def step(h: np.ndarray, into: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of the gated unit: the new state, and the gates."""
    kind = np.result_type(h, into, again)
    gates, new, after = np.empty((3, *h.shape), kind), np.empty(h.shape, kind), np.empty(h.shape, kind)
    _advance(h, _turned(_parts(into)), _turned(_parts(again)), gates, new, after)
    return after, (*gates, new)


def _exponentials(x: np.ndarray, picked: np.ndarray | None = None) -> np.ndarray:
    """Puts the exponentials of ``x`` in its place and gives their sums by row; ``picked`` is shifted as its row is."""
    if len(x) and x.max() > 60:                # far from usual; the plain form would overflow
        top = x.max(axis=1)
        if picked is not None:
            picked -= top
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_shares(x: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Log share of the picked column in each row's softmax. ``x`` is overwritten."""
    picked = x[np.arange(len(x)), pick]
    total = _exponentials(x, picked)
    return picked - np.log(total)


def _outputs(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of each class's words, the biases as one row more."""
    return (np.concatenate((w["class"], w["class_bias"][None])),
            np.concatenate((w["word"], w["word_bias"][:, None]), axis=1))


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), STATE + 1), h.dtype)      # the last column carries the biases
    out[:, :STATE], out[:, STATE] = h, 1
    return out


def _by_unit(unit: np.ndarray, head: int, groups: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places in the order of their units, the units so ordered, and ``class, begin, end`` of the head words in it."""
    order = np.argsort(unit.astype(np.int16), kind="stable")
    unit = unit[order]
    cut = np.searchsorted(unit, np.minimum(np.arange(groups + 1) * GROUP, head)).tolist()
    return order, unit, [(g, cut[g], cut[g + 1]) for g in range(groups) if cut[g] < cut[g + 1]]


def _log_units(h: np.ndarray, unit: np.ndarray, classes: np.ndarray, words: np.ndarray, head: int) -> np.ndarray:
    h = _with_ones(h)
    out = _log_shares(h @ classes, np.where(unit < head, unit // GROUP, unit - head + len(words)))
    order, unit, runs = _by_unit(unit, head, len(words))
    if runs:
        at, unit = order[:runs[-1][2]], unit[:runs[-1][2]]
        some, x = h[at], np.empty((len(at), GROUP), np.result_type(h, words))
        for g, begin, end in runs:
            np.matmul(some[begin:end], words[g], out=x[begin:end])
        out[at] += _log_shares(x, unit % GROUP)
    return out


def log_probability(h: np.ndarray, unit: np.ndarray, w: dict, head: int) -> np.ndarray:
    """Natural log probability of each unit after each state."""
    return _log_units(h, unit, *_outputs(w), head)


def lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, fresh, live`` by lane and place: the texts one after the other, cut into lanes of equal length. A lane
    starts afresh where a text begins, and at its own start; what follows the last text isn't live."""
    size = np.array([len(t) for t in texts], np.int64)
    total = int(size.sum())
    lanes = min(LANES, max(1, len(texts), total // LANE_TOKENS))
    length = -(-total // lanes)
    ids, fresh = np.zeros(lanes * length, np.int32), np.zeros(lanes * length, bool)
    if total:
        ids[:total] = np.concatenate(texts)
        fresh[(np.cumsum(size) - size)[size > 0]] = True
        fresh[::length] = True
    live = np.arange(lanes * length) < total
    return ids.reshape(lanes, length), fresh.reshape(lanes, length), live.reshape(lanes, length)


def _descend(w: np.ndarray, square: np.ndarray, gradient: np.ndarray, rate: float, split: bool = False) -> None:
    """A step of Adagrad, in place; ``gradient`` is overwritten. Gradients longer than 5 are shortened: the whole array,
    or with ``split`` each item of the first axis by itself, and its last row (the biases) apart from the others."""
    squares = gradient * gradient
    if split:
        of_bias = squares[:, -1].sum(axis=1)
        of_all = squares.reshape(len(squares), -1) @ np.ones(squares[0].size, np.float32)
        lengths = np.sqrt(np.maximum(np.stack((of_all - of_bias, of_bias), axis=1), 0))
        if lengths.max() > 5:
            cut = np.minimum(1, 5 / np.maximum(lengths, 5))
            gradient[:, :-1] *= cut[:, :1, None].astype(np.float32)
            gradient[:, -1] *= cut[:, 1:].astype(np.float32)
            np.multiply(gradient, gradient, out=squares)
    elif (length := float(np.sqrt(squares.sum()))) > 5:
        gradient *= np.float32(5 / length)
        np.multiply(gradient, gradient, out=squares)
    square += squares
    np.sqrt(square, out=squares)
    gradient *= np.float32(rate)
    gradient /= squares
    w -= gradient


def train(w: dict, texts: list[np.ndarray], head: int, rate: float = RATE) -> int:
    """Truncated backpropagation with Adagrad over all tokens of the texts, side by side in lanes; changes ``w``, gives
    the number of tokens.

    Arrays run by place in the window, then lane; what can be had for a whole window at once is, so that only the two
    passes along the state go step by step."""
    ids, fresh, live = lay(texts)
    lanes, length = ids.shape
    fresh_at, all_live = fresh.any(axis=0).tolist(), bool(live.all())
    classes, words = _outputs(w)
    classes, groups = classes[None], len(words)
    vector, inward, again, bias = w["vector"], w["inward"], w["again"], w["bias"]
    square = {k: np.full(v.shape, 0.1, np.float32) for k, v in
              {"classes": classes, "words": words, "vector": vector, "inward": inward, "again": again, "bias": bias}.items()}
    empty = lambda *shape: np.empty(shape, np.float32)
    states, gates_all, new_all = empty(WINDOW + 1, lanes, STATE), empty(3, WINDOW, lanes, STATE), empty(WINDOW, lanes, STATE)
    slope_all, carry_all, back = empty(3, WINDOW, lanes, STATE), empty(WINDOW, lanes, STATE), empty(3, lanes, STATE)
    d_words, share = empty(*words.shape), np.float32(1 / lanes)
    h = np.zeros((lanes, STATE), np.float32)

    for begin in range(0, length, WINDOW):
        n = min(WINDOW, length - begin)
        unit = ids[:, begin:begin + n].T.ravel()
        gates, new, slope, carried = gates_all[:, :n], new_all[:n], slope_all[:, :n], carry_all[:n]
        # along the state
        order, sorted_unit, runs = _by_unit(unit, head, groups)
        new_unit = np.concatenate(([True], sorted_unit[1:] != sorted_unit[:-1]))
        first, which = np.flatnonzero(new_unit), np.empty(len(unit), np.intp)
        which[order] = np.cumsum(new_unit) - 1
        seen = sorted_unit[first]
        of_seen, inward_parts = vector[seen], _parts(inward)
        into = np.matmul(of_seen, inward_parts)
        into += _parts(bias)[:, None]
        into, forth = _turned(into).take(which, axis=1).reshape(3, n, lanes, STATE), _turned(_parts(again))
        states[0] = h
        for t in range(n):
            if fresh_at[begin + t]:
                states[t][fresh[:, begin + t]] = 0
            _advance(states[t], into[:, t], forth, gates[:, t], new[t], states[t + 1])
        h, before = states[n].copy(), states[:n]
        # outputs
        flat = _with_ones(before.reshape(-1, STATE))
        on = share if all_live else live[:, begin:begin + n].T.ravel() * share
        p = flat @ classes[0]
        p *= (on / _exponentials(p))[:, None]
        p[np.arange(len(p)), np.where(unit < head, unit // GROUP, unit - head + groups)] -= on
        d_classes, dh = (flat.T @ p)[None], p @ classes[0, :-1].T
        if runs:
            at = order[:runs[-1][2]]
            some, p, d_some = flat[at], empty(len(at), GROUP), empty(len(at), STATE)
            for g, i, j in runs:
                np.matmul(some[i:j], words[g], out=p[i:j])
            on = share if all_live else on[at]
            p *= (on / _exponentials(p))[:, None]
            p[np.arange(len(at)), sorted_unit[:len(at)] % GROUP] -= on
            if len(runs) < groups:
                d_words[:] = 0
            for g, i, j in runs:
                np.matmul(some[i:j].T, p[i:j], out=d_words[g])
                np.matmul(p[i:j], words[g, :-1].T, out=d_some[i:j])
            dh[at] += d_some
            _descend(words, square["words"], d_words, rate, split=True)
        _descend(classes, square["classes"], d_classes, rate, split=True)
        # back along the state: slopes by keep, look and the old state's share, first for a carry of one
        keep, look, old = gates
        lose = 1 - keep
        np.subtract(before, new, out=slope[0])
        slope[0] *= keep
        slope[0] *= lose
        new *= new
        np.subtract(1, new, out=new)
        new *= lose                            # of the new state's argument
        np.multiply(new, look, out=slope[2])
        np.subtract(1, look, out=slope[1])
        slope[1] *= slope[2]
        slope[1] *= old
        dh, hence, carry = dh.reshape(n, lanes, STATE), _parts(again).transpose(0, 2, 1), np.zeros((lanes, STATE), np.float32)
        for t in range(n - 1, -1, -1):
            carried[t] = carry
            d_back = slope[:, t]
            d_back *= carry
            np.matmul(d_back, hence, out=back)
            carry *= keep[t]
            carry += back[0]
            carry += back[1]
            carry += back[2]
            carry += dh[t]
            if fresh_at[begin + t]:
                carry[fresh[:, begin + t]] = 0
        together = lambda x: np.moveaxis(x, 0, -2).reshape(*x.shape[1:-1], 3 * STATE)
        slope = slope.reshape(3, -1, STATE) if n == WINDOW else slope.copy().reshape(3, -1, STATE)
        d_again = together(np.matmul(flat[:, :-1].T, slope))
        np.multiply(new, carried, out=slope[2].reshape(new.shape))
        d_inward = together(np.matmul(of_seen[which].T, slope))
        d_given = np.matmul(slope, inward_parts.transpose(0, 2, 1))
        d_given[0] += d_given[1]
        d_given[0] += d_given[2]
        d_vector = np.add.reduceat(d_given[0][order], first, axis=0)
        _descend(bias, square["bias"], together(np.matmul(np.ones(slope.shape[1], np.float32), slope)), rate)
        _descend(again, square["again"], d_again, rate)
        _descend(inward, square["inward"], d_inward, rate)
        squares_of_seen = square["vector"][seen]
        _descend(of_seen, squares_of_seen, d_vector, rate)
        vector[seen], square["vector"][seen] = of_seen, squares_of_seen
    w["class"][:], w["class_bias"][:] = classes[0, :-1], classes[0, -1]
    w["word"][:], w["word_bias"][:] = words[:, :-1], words[:, -1]
    return int(live.sum())


def stretches(texts: DataFrame, shared) -> DataFrame:
    """``ids`` (packed 32-bit units) of every training text: all its tokens and its end."""
    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary, index = _worker(shared)
        unit, get = vocabulary.unit, index.__getitem__
        for batch in batches:
            out = []
            for text in blob(batch.column(0)):
                words = tokens(text)
                out.append(np.append(unit[np.fromiter(map(get, words), np.int64, len(words))], np.int32(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return texts.select("text").mapInArrow(run, "ids binary")


def _pack(w: dict) -> bytes:
    return b"".join(w[k].tobytes() for k in sorted(w))


def _unpack(data: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].nbytes
        out[k] = np.frombuffer(data, np.float32, like[k].size, at).reshape(like[k].shape).copy()
        at += n
    return out


def fit(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict:
    """Weights after ``rounds`` of local training and averaging over all tasks, weighted by their tokens."""
    w = first_weights(vocabulary)
    head, sc = vocabulary.head, rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            mine = {k: v.copy() for k, v in shared.value.items()}
            held, size, n = [], 0, 0
            for batch in batches:
                for x in blob(batch.column(0)):
                    held.append(np.frombuffer(x, np.int32))
                    size += len(held[-1])
                    if size > BUFFER_TOKENS:
                        n += train(mine, held, head)
                        held, size = [], 0
            if held:
                n += train(mine, held, head)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8]), pa.array([n]),
                                                  pa.array([_pack(mine)], pa.binary())], ["bucket", "n", "w"])

        def add(batches: Iterator[pa.RecordBatch]):
            total, n = None, 0
            for batch in batches:
                for m, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    v = np.frombuffer(x, np.float32).astype(np.float64) * m
                    total, n = v if total is None else total + v, n + m
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "w"])

        parts = (rows.mapInArrow(run, "bucket long, n long, w binary").repartition(8, "bucket")
                 .mapInArrow(add, "n long, w binary").collect())
        if parts:
            n = sum(p["n"] for p in parts)
            w = _unpack((sum(np.frombuffer(bytes(p["w"]), np.float32).astype(np.float64) * p["n"] for p in parts) / n)
                        .astype(np.float32).tobytes(), w)
    return w


# ---- scoring ---------------------------------------------------------------------------------------------------

def _worker(shared) -> tuple[Vocabulary, dict]:
    key, vocabulary = shared.value
    return vocabulary, worker_state("lm", key, "index", vocabulary.index)


def score_units(texts: list[np.ndarray], w: dict, head: int) -> np.ndarray:
    """Natural log probability of each text (its units, the end included). Texts of like lengths advance together, a
    block of ``SIDE`` and a step at a time, longest first, and keep their state until their end."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    into_all = _turned(_parts(w["vector"] @ w["inward"] + w["bias"]))
    again, outputs, total = _turned(_parts(w["again"])), _outputs(w), np.zeros(len(texts))
    for block in range(0, len(texts), SIDE):
        rows = order[block:block + SIDE]
        size = np.array([len(texts[i]) for i in rows])
        begin, flat = np.cumsum(size) - size, np.concatenate([texts[i] for i in rows])
        done, longest = np.zeros(len(rows)), int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), side="left").tolist()      # texts longer than each place
        h, t = np.zeros((len(rows), STATE), np.float32), 0
        while t < longest:
            upto, held = t, 0
            while upto < longest and (not held or held + active[upto] <= SCORED):
                held += active[upto]
                upto += 1
            states, units = np.empty((held, STATE), np.float32), np.empty(held, np.int32)
            ends = np.cumsum([0, *active[t:upto]]).tolist()
            for k, n in enumerate(active[t:upto]):
                if n < len(h):
                    h = h[:n].copy()
                here = slice(ends[k], ends[k + 1])
                states[here], units[here] = h, flat[begin[:n] + (t + k)]
                _advance(states[here], into_all[:, units[here]], again, np.empty((3, n, STATE), np.float32),
                         np.empty((n, STATE), np.float32), h)
            logs = _log_units(states, units, *outputs, head)
            for k, n in enumerate(active[t:upto]):
                done[:n] += logs[ends[k]:ends[k + 1]]
            t = upto
        total[rows] = done
    return total


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, w: dict, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score`` per row. The network runs once; its sums and the words outside
    the dictionary are written down, and these words meet their counts in a join."""
    sc = docs.sparkSession.sparkContext
    shared, model = sc.broadcast((uuid.uuid4().hex, vocabulary)), sc.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]):
        v, index = _worker(shared)
        get, rest = index.__getitem__, len(v.words)
        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def out():
            nonlocal row
            logs = score_units([x[1] for x in held], model.value, v.head) / LN10
            cols = [pa.array(range(row, row + len(held)), pa.int64()), pa.array([x[0] for x in held], kind),
                    pa.array([len(x[1]) for x in held], pa.int64()), pa.array([x[2] for x in held], pa.int64()),
                    pa.array([x[3] for x in held]), pa.array([x[4] + s for x, s in zip(held, logs.tolist(), strict=True)]),
                    pa.array([list(x[5]) for x in held], pa.list_(pa.binary())),
                    pa.array([list(x[5].values()) for x in held], pa.list_(pa.int32()))]
            row += len(held)
            return pa.RecordBatch.from_arrays(cols, ["row", "id", "n_tokens", "n_known", "base", "score", "words", "times"])

        for batch in batches:
            kind = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), blob(batch.column(1)), strict=True):
                words = tokens(text)
                at = np.fromiter(map(get, words), np.int32, len(words))
                unknown = np.flatnonzero(at == rest)
                base = float(v.base[at].sum()) + v.base_end
                within = float(v.within[at].sum())
                held.append((i, np.append(v.unit[at], 0), len(at) - len(unknown) + (v.end_count > 0), base, within,
                             Counter(words[k] for k in unknown)))
                size += len(at) + 1
                if size > BUFFER_TOKENS or len(held) >= BUFFER_TEXTS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    kind_name = docs.schema[id_col].dataType.simpleString()
    scored = kept_table(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(
        run, f"row long, id {kind_name}, n_tokens long, n_known long, base double, score double, "
             "words array<binary>, times array<int>"), "lm-scores")
    rare = counts.filter(F.col("c") < vocabulary.least)
    seen = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    met = (seen.join(rare, seen["words"] == rare["token"], "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("log"), F.sum("times").alias("times"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known")))
    add = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("words", "times").join(met, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + add("known")).cast("long").alias("n_known"),
        (F.col("base") + add("log") - add("times") * vocabulary.log_all).alias("base_score"),
        (F.col("score") + add("log") - add("times") * float(np.log10(vocabulary.rest_mass))).alias("score"))
