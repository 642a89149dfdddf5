"""The captions' plans: the predictions are read and moved once, and a file's list is trimmed where it lies. Results are held against plain-Python versions."""

import random
import re

import pytest

from tagloom.operators.tags import TagSettings, trim_contained_tags
from tagloom.plans import dataset as D
from tagloom.sources import fixtures as X

WORDS = ["a", "b", "c", "d"]
PRED = "file_id long, category string, tag string, score double, ord int"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(seed=3):
    rng, rows = random.Random(seed), []
    for f in [None, *range(1, 120)]:
        for k in range(rng.randint(0, 9)):
            sep = rng.choice([" ", " ", " ", "  ", "\t", "_"])
            tag = rng.choice([sep.join(rng.choices(WORDS, k=rng.randint(1, 5))), "", " ", "a", "a b"])
            rows.append((f, rng.choice(["general", "general", "general", "character", "rating"]), tag,
                         round(rng.random(), 2), rng.randint(0, 9)))
        rows.append((f, "general", None, 0.5, None) if f and f % 9 == 0 else (f, "rating", "rating_x", 0.5, 0))
    return rows


def _key(tag):
    return re.sub(r"\s+", " ", tag.strip(" "))


def _contained(a, b):
    """Whether row ``b`` of the same file drops ``a``."""
    if a[2] is None or b[2] is None or a[2] == b[2]:
        return False
    x, y = _key(a[2]), _key(b[2])
    if x == y:
        return a[4] is not None and b[4] is not None and b[4] < a[4]
    return x == "" or f" {x} " in f" {y} "


def _captions(rows):
    out = {}
    for f in {r[0] for r in rows}:
        mine = [(r[0], r[1], r[2] and r[2].replace("_", " "), *r[3:]) for r in rows if r[0] == f]
        gen = [r for r in mine if r[1] == "general" and r[3] >= 0.35]
        if f is not None:
            gen = [r for r in gen if not any(_contained(r, b) for b in gen)]
        every = [(-r[3], 0, r) for r in mine if r[1] == "character" and r[3] >= 0.9] + [(-(r[3] - 1.0), 1, r) for r in gen]
        every.sort(key=lambda e: (e[0], e[1], -1 if e[2][4] is None else e[2][4], e[2][2] or ""))
        out[f] = ", ".join(e[2][2] for e in every if e[2][2] is not None)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_captions_as_brute_force_from_one_read(spark, seed):
    rows = _rows(seed)
    caps = D.captions(spark.createDataFrame(rows, PRED), TagSettings())
    assert {r["file_id"]: r["caption"] for r in caps.collect()} == _captions(rows)
    plan = _plan(caps)
    assert "Join" not in plan and "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_trim_expands_in_one_read(spark):
    rows = [r for r in _rows(5) if r[0] is not None]
    out = trim_contained_tags(spark.createDataFrame(rows, PRED))
    want = [r for r in rows if not any(r[0] == b[0] and _contained(r, b) for b in rows)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "Union" not in _plan(out)


def test_predictions_from_one_read(spark, tmp_path):
    lines = [(1, 1, 0.05, 0.02, 10.0, "A"), (1, 2, 0.07, 0.01, 20.0, "R"), (1, 1, 0.09, 0.05, 5.0, "A"), (2, 2, None, 0.0, 50.0, "N"),
             (None, 1, 0.01, 0.03, 25.0, "A"), (3, 9, 0.01, 0.03, 25.0, "A")]
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double, l_tax double, l_quantity double, l_returnflag string")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "red widget", "PROMO"), (2, "hot bolt", "STANDARD")], "p_partkey long, p_name string, p_type string") \
        .write.parquet(f"{tmp_path}/part.parquet")
    pred = X.pred(spark, str(tmp_path))
    got = {(r["file_id"], r["category"], r["tag"]): r["score"] for r in pred.collect()}
    assert got == {(1, "character", "red_widget"): 0.9, (1, "general", "widget"): 0.8, (1, "rating", "rating_a"): 0.2,
                   (1, "general", "hot_bolt"): 0.7, (1, "general", "bolt"): 0.9, (1, "rating", "rating_r"): 0.4,
                   (2, "general", "hot_bolt"): None, (2, "general", "bolt"): 1.0, (2, "rating", "rating_n"): 1.0,
                   (None, "character", "red_widget"): 0.1, (None, "general", "widget"): 0.7, (None, "rating", "rating_a"): 0.5}
    assert _plan(pred).count("Join") == 1 and "Union" not in _plan(pred)
