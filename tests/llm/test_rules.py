import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts():
    rnd = random.Random(3)
    texts = [None, "", " \n", "a\n a\na\n\na", "é ü|#", "x " * 40_000, "\x1c \x85 \xa0 b\x0bc"]
    texts += ["".join(rnd.choice("ab é\n #\t") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 200))) for _ in range(50)]
    for t in texts:
        assert rules.counts((t or "").encode()) == brute(t), t


def good(k):
    rnd = random.Random(k)
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "to"]) + str(rnd.randint(0, 999)) for _ in range(40))


NOISE = "".join(f" #{k}" for k in range(8))        # some symbols, no repeats: a weak failure
JUNK = "".join(f" #|{k}" for k in range(30))       # many: a strong one


def copied_lines():
    rnd = random.Random(6)
    return "".join(f"\n{rnd.choice('abcdefghij')}" for _ in range(45))


@pytest.fixture
def hosts(docs):
    rows = [(k, good(k), "clean") for k in range(400)] + [(1000 + k, good(k) + NOISE, "bad") for k in range(60)]
    rows += [(2000 + k, good(k + 500), "bad") for k in range(40)] + [(3000, good(7) + NOISE, "clean"), (3001, good(8) + NOISE + copied_lines(), "clean"), (3002, good(9) + JUNK, "clean")]
    rows += [(4000, good(9) + NOISE, None), (4001, "short", "clean"), (4002, None, "clean"), (4003, good(1) + " " + good(1), "clean")]
    return docs(rows)


def test_verdicts(hosts):
    got = {r["doc_id"]: r for r in rules.judge(hosts).collect()}
    assert all(got[k]["kept"] for k in [*range(400), *range(2000, 2040)])            # clean texts, on whatever host
    assert not any(got[k]["kept"] for k in range(1000, 1060))                        # failures on a distrusted host
    assert got[3000]["kept"] and not got[3001]["kept"]                               # one failure is forgiven, two are not
    assert not got[3002]["kept"]                                                     # a strong failure goes on any host
    assert not any(got[k]["base_failed"] for k in (3000, 3001, 3002))
    assert [got[k]["base_failed"] for k in (4001, 4002, 4003)] == [True] * 3 and not got[4001]["kept"]


def test_rates_are_shrunk(hosts):
    counted = rules.with_counts(hosts)
    rate = {r["host"]: r["symbols_rate"] for r in rules.host_rates(counted, "source").collect()}
    raw = {r["source"]: r["f"] for r in counted.groupBy("source").agg(F.avg(F.expr(rules.RULES["symbols"]).cast("double")).alias("f")).collect()}
    total = counted.agg(F.avg(F.expr(rules.RULES["symbols"]).cast("double"))).first()[0]
    for h in raw:
        assert min(raw[h], total) <= rate[h] <= max(raw[h], total)
    assert abs(rate[None] - raw[None]) > abs(rate["clean"] - raw["clean"])         # one document says less than hundreds


def test_odd_and_empty(odd, docs):
    got = rules.judge(odd).collect()
    assert len(got) == odd.count() and set(rules.judge(odd).columns) >= {"doc_id", "text", "source", "kept", *rules.COUNTS}
    assert [tuple(r[c] for c in rules.COUNTS) for r in got] == [brute(r["text"]) for r in got]
    assert rules.judge(docs([])).count() == 0


def test_clashing_names(docs):
    rows = docs([(1, good(1), "a"), (2, good(2) + JUNK, None)]).withColumns({c: F.lit(f"own {c}") for c in ("_utf8", "_host", "_symbols", "kept")})
    got = {r["doc_id"]: r for r in rules.judge(rows).collect()}
    assert got[1]["kept"] is True and got[2]["kept"] is False
    assert all(r[c] == f"own {c}" for r in got.values() for c in ("_utf8", "_host", "_symbols"))


def test_equal_hosts_are_trusted(docs):
    """A single weak failure is forgiven where no host stands out."""
    rows = [(100 * h + k, good(100 * h + k) + NOISE * (k < 3), f"h{h}") for h in range(4) for k in range(30)]
    assert all(r["kept"] for r in rules.judge(docs(rows)).collect())
