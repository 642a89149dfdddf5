import random

import pytest

from tagloom.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.com", "/de/x", "allow"), ("A.com", "", "block"), ("b.a.com", "/", "allow"), ("", "/root", "block"),
         ("a,b.com", "/", "block"), (None, "/", "block"), ("com", "/de/", "allow")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in RULES:
        if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            key = (len(h + p), len(h), v, h.lower() + p)
            best = key if best is None or key > best else best
    return host, path, best[3] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("salts", [1, 3])
def test_against_brute_force(spark, salts):
    rnd = random.Random(2)
    hosts = ["org", "x.org", "example.org", "m.example.org", "notexample.org", "com", "a.com", "B.a.com", "ab.com", "c.b.a.com", "net", "",
             "a,b.com", "x.a,b.com", "com.", "orgx", "or", "a.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/es/", "/fr/x#y", "/de/", "/de/x/y", "?/de/", "#/es/", "/root"]
    data = [f"http{rnd.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]
    data += [None, "", "no scheme/es/", "http:/x.org/", "a://b://c.org/", "http://x.org/\nq"] + ["https://example.org/es/1"] * 50
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(data)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, rules, salts=salts).collect()}
    assert len(got) == len(data)
    for i, u in enumerate(data):
        assert got[i] == brute(u), u


def test_deep_nesting_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://d.c.b.a/x"), (2, "http://z.b.a/x"), (3, "http://e.a/x"), (3, "http://e.a/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", "allow"), ("b.a", "/", "block"), ("c.b.a", "/", "allow"), ("d.c.b.a", "/q", "block")],
                                  "host string, path string, verdict string")
    got = sorted((r["page_id"], r["rule"]) for r in urls.judge(pages, rules).collect())
    assert got == [(1, "c.b.a/"), (2, "b.a/"), (3, "a/"), (3, "a/")]
    assert [r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()] == ["allow"] * 4
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urls.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
