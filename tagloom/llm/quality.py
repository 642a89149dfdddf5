"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Every whole text is reduced to ``STATISTICS`` once; that narrow table is all that learning and scoring read. cos(Wx + b)
with normal W approximates a Gaussian kernel on the standardised statistics. Partitions sum their normal equations; the
sums of two halves give the final weights (both) and scores of each half by the other's weights, on which the isotonic
calibration (pool adjacent violators over score bins) is learned.

Null and empty texts have statistics of zero and get a score like any other. Without labelled rows every score is 0.5.
Repeated rows get equal scores; ids and other columns take no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import blob, kept_table, map_batches, utf8, window_hashes, word_hashes

STATISTICS = ["words", "chars_per_word", "symbols", "bars", "bangs", "upper", "digits", "points", "distinct",
              "commonest", "echo", "line_copies", "word_lines", "window_copies", "other_scripts", "capitals"]
DIMENSIONS, RIDGE, BINS, SEED = 256, 1.0, 2000, 11
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".,;:?"), 1):
    _CLASS[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    hashes = word_hashes(text)
    n = len(hashes)
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=7)
    blank = ((data >= 9) & (data <= 13)) | (data == 32)
    chars = int(((data & 0xC0) != 0x80).sum()) - int(blank.sum())
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    _, count = np.unique(hashes, return_counts=True)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = window_hashes(hashes, 4)
    copies = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0
    return [np.log1p(n), min(chars / n, 40.0), kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / chars,
            kinds[5] / chars, kinds[6] / n, len(count) / n, float(count.max()) / n,
            float((hashes[1:] == hashes[:-1]).sum()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            copies, float((data >= 0xC0).sum()) / chars, float((_CLASS[data[begins]] == 4).sum()) / n]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, x`` for every row."""
    def run(batch: pa.RecordBatch):
        x = [[float(v) for v in statistics(t)] for t in blob(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")), run,
                       f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


class Kernel:
    """The feature map: standardise, then cosines of a fixed random projection, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(0, 1 / np.sqrt(len(STATISTICS)), (len(STATISTICS), DIMENSIONS))
        self.b = draw.uniform(0, 2 * np.pi, DIMENSIONS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((np.sqrt(2 / DIMENSIONS) * np.cos(z @ self.w + self.b), np.ones(len(x))))


def normal_equations(rows: DataFrame, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Z'Z, Z'y and the row count of each half from ``x, label, half``: a sum per partition, then their sum."""
    size = DIMENSIONS + 1

    def run(batches):
        sums = {h: np.zeros((size, size + 1)) for h in (0, 1)}
        n = {0: 0, 1: 0}
        for batch in batches:
            z, y = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
            half = batch.column(2).to_numpy()
            for h in (0, 1):
                at = half == h
                sums[h][:, :size] += z[at].T @ z[at]
                sums[h][:, size] += z[at].T @ y[at]
                n[h] += int(at.sum())
        have = [h for h in (0, 1) if n[h]]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([n[h] for h in have], pa.int64()),
                                          pa.array([sums[h].tobytes() for h in have], pa.binary())], ["half", "n", "sums"])

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for h, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(h, [0, np.zeros(size * (size + 1))])
                held[0] += n
                held[1] += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()),
                                          pa.array([v[1].tobytes() for v in total.values()], pa.binary())], ["half", "n", "sums"])

    schema = "half int, n long, sums binary"
    parts = rows.select("x", "label", "half").mapInArrow(run, schema).repartition(2, "half").mapInArrow(add, schema).collect()
    out = {h: (np.zeros((size, size)), np.zeros(size), 0.0) for h in (0, 1)}
    for r in parts:
        s = np.frombuffer(bytes(r["sums"])).reshape(size, size + 1)
        out[r["half"]] = (s[:, :size], s[:, size], float(r["n"]))
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    keep = np.eye(len(b)) * RIDGE
    keep[-1, -1] = 1e-6
    return np.linalg.solve(a + keep, b)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by ``at``: places and non-decreasing values to interpolate."""
    blocks: list[list[float]] = []      # weight, weighted value, weighted place
    for x, m, w in zip(at, mean, weight, strict=True):
        blocks.append([w, w * m, w * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(rows: DataFrame, labelled: DataFrame) -> tuple[Kernel, np.ndarray, np.ndarray, np.ndarray]:
    """Kernel, weights, and the calibration's places and values, from ``doc_id, x`` and bounded ``doc_id, label``."""
    both = kept_table(rows.join(labelled, "doc_id").select(
        "x", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int").alias("half")), "quality-labels")
    moments = both.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(STATISTICS))]).agg(
        *[f(f"x{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return Kernel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))), np.zeros(DIMENSIONS + 1), np.zeros(1), np.full(1, 0.5)
    kernel = Kernel(np.array(moments[0::2]), np.maximum(np.array(moments[1::2]), 1e-3))
    half = normal_equations(both, kernel)
    weights = solve(half[0][0] + half[1][0], half[0][1] + half[1][1])
    other = {h: solve(half[1 - h][0], half[1 - h][1]) if half[1 - h][2] else weights for h in (0, 1)}

    def run(batch: pa.RecordBatch):
        z, h = kernel(_matrix(batch.column(0))), batch.column(2).to_numpy()
        s = np.where(h == 0, z @ other[0], z @ other[1])
        yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], ["s", "label"])

    bins = (map_batches(both.select("x", "label", "half"), run, "s double, label int")
            .groupBy(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "s")) * (BINS / 3)).alias("bin"))
            .agg(F.avg("s").alias("s"), F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    places, values = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("s", "mean", "n")))
    return kernel, weights, places, np.clip(values, 0.001, 0.999)


def score(rows: DataFrame, model: tuple) -> DataFrame:
    """``doc_id, score`` of ``doc_id, x``: the calibrated score between 0 and 1."""
    def run(batch: pa.RecordBatch):
        kernel, weights, places, values = model
        raw = kernel(_matrix(batch.column(1))) @ weights
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(raw, places, values))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "x"), run, f"doc_id {kind}, score double")
