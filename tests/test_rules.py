"""Tag rules: mapping-rule grammar, the higher-order-function rewrite against a plain-Python
restatement (brute force over the small fixture), keep/prefix/ban invariants."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import tags as T
from tagloom.operators.tags import TagSettings, parse_mapping_rules
from tagloom.plans import dataset as D
from tagloom.plans.q_dataset import BAN, KEEP, MAP_RULES, PREFIX
from tagloom.sources import fixtures as X

from conftest import SF_SMALL


def brute_map(tags, rules, passes=20, compat=False):
    tags = list(tags)
    for _ in range(passes):
        changed = False
        for r in rules:
            def present(t):
                return any(x == t and (not compat or s != 0) for x, s in tags)
            if not all(present(t) for t in r.positives) or any(present(t) for t in r.negatives):
                continue
            first = {}
            for x, s in tags:
                first.setdefault(x, s)
            top = max(first[t] for t in r.positives)
            changed = changed or not all(t in r.targets for t in r.positives)
            tags = [(x, s) for x, s in tags if x not in r.positives] + [(t, top) for t in r.targets]
        if not changed:
            break
    return tags


def brute_caption(tags, st: TagSettings):
    tags = brute_map(tags, parse_mapping_rules(st.map_tags), compat=st.compat)
    keep = T.csv_list(st.keep_tags)
    if keep:
        m = max([0] + [s for _, s in tags])
        tags = [(x, 5.0 + (1.0 - keep.index(x) / len(keep)) if x in keep else s) for x, s in tags]
        tags.append(("BREAK", m + 1.0))
    pre = T.csv_list(st.prefix_tags)
    if pre:
        m = max([0] + [s for _, s in tags])
        tags = [(t, i + 1.0 + m) for i, t in enumerate(reversed(pre))] + tags
    ban = T.csv_list(st.ban_tags, drop_empty=False)
    tags = [(x, s) for x, s in tags if x not in ban]
    tags = sorted(tags, key=lambda e: e[1], reverse=True)   # stable
    return ", ".join(x for x, _ in tags)


def test_parse_grammar():
    rules = parse_mapping_rules('# comment\n\na, b & -c : x, y\n"p & q" & r : z\n')
    assert [(r.positives, r.negatives, r.targets) for r in rules] == [
        (("a",), (), ("x", "y")),
        (("b",), ("c",), ("x", "y")),
        (("p & q", "r"), (), ("z",)),
    ]


@pytest.mark.parametrize("text", ["a & \"b : c", "-a : b", "no separator here"])
def test_parse_errors(text):
    with pytest.raises(ValueError):
        parse_mapping_rules(text)


CASES = [
    ("fire", [("a", 0.9), ("b", 0.5)], "a & b : c", []),
    ("negated", [("a", 0.9), ("b", 0.5)], "a & -b : c", []),
    ("chain", [("a", 0.9)], "a : b\nb : c", []),
    ("self target", [("a", 0.9), ("b", 0.4)], "a : a, b", []),
    ("duplicate target", [("a", 0.9), ("c", 0.2)], "a : b\nc : b", []),
    ("loop capped", [("a", 0.9)], "a : b\nb : a", []),
    ("zero score", [("a", 0.0), ("b", 0.5)], "a : c", []),
]


@pytest.mark.parametrize("name,tags,rules,_", CASES, ids=[c[0] for c in CASES])
@pytest.mark.parametrize("compat", [False, True])
def test_hof_matches_brute_force(spark, name, tags, rules, _, compat):
    rs = parse_mapping_rules(rules)
    df = spark.createDataFrame([(1, [{"tag": t, "score": float(s)} for t, s in tags])],
                               "file_id long, tags array<struct<tag:string,score:double>>")
    got = df.select(T.apply_mapping_rules(F.col("tags"), rs, compat=compat).alias("t")).collect()[0].t
    assert [(e.tag, e.score) for e in got] == brute_map(tags, rs, compat=compat)


@pytest.mark.parametrize("st", [
    TagSettings(map_tags=MAP_RULES, keep_tags=KEEP, ban_tags=BAN),
    TagSettings(map_tags=MAP_RULES, prefix_tags=PREFIX, compat=True),
    TagSettings(keep_tags=KEEP, prefix_tags=PREFIX, ban_tags=BAN),
], ids=["map-keep-ban", "map-prefix-compat", "keep-prefix-ban"])
def test_caption_path_matches_brute_force(spark, st):
    pred = X.pred(spark, SF_SMALL)
    lists = {r.file_id: [(e.tag, e.score) for e in r.tags] for r in D._lists(pred, st, -1.0).collect()}
    got = {r.file_id: r.caption for r in D.captions(pred, st).collect()}
    assert set(lists) == set(got)
    for fid, tags in lists.items():
        assert got[fid] == brute_caption(tags, st), fid


def test_banned_never_in_caption(spark):
    st = TagSettings(keep_tags=KEEP, prefix_tags="gear, photo", ban_tags=BAN)
    banned = set(T.csv_list(BAN))
    for r in D.captions(X.pred(spark, SF_SMALL), st).collect():
        assert not banned & {t.strip() for t in r.caption.split(",")}


def test_trim_leaves_no_contained_pair(spark):
    pred = T.prepare_predictions(X.pred(spark, SF_SMALL))
    g = T.threshold_scores(pred.where(F.col("category") == "general"))
    per_file = {}
    for r in T.trim_contained_tags(g).collect():
        per_file.setdefault(r.file_id, []).append(r.tag)
    for tags in per_file.values():
        for a in tags:
            for b in tags:
                if a != b:
                    assert f" {' '.join(a.split())} " not in f" {' '.join(b.split())} "


def test_trim_edge_cases(spark):
    rows = [(1, "cold widget", "0"), (1, "widget", "1"), (1, "cold  widget", "2"), (1, "", "3"),
            (2, "a b c", "0"), (2, "b c", "1"), (2, "c", "2"), (2, "d", "3"),
            (3, "x", "0"), (3, "x", "1")]
    df = spark.createDataFrame(rows, "file_id long, tag string, ord string")
    got = sorted((r.file_id, r.tag) for r in T.trim_contained_tags(df).collect())
    # equal word lists: the lower ord stays; blank tags are contained in anything; identical strings stay
    assert got == [(1, "cold widget"), (2, "a b c"), (2, "d"), (3, "x"), (3, "x")]


def test_mcut(spark):
    rows = [(1, "general", "a", 0.9), (1, "general", "b", 0.8), (1, "general", "c", 0.3), (1, "general", "d", 0.2),
            (2, "general", "a", 0.5)]
    df = spark.createDataFrame(rows, "file_id long, category string, tag string, score double")
    cuts = {r.file_id: r.cut for r in T.mcut_threshold(df).collect()}
    assert cuts == {1: pytest.approx(0.55)}
    kept = T.threshold_scores(df, general=0.1, general_mcut=True).collect()
    assert sorted((r.file_id, r.tag) for r in kept) == [(1, "a"), (1, "b"), (2, "a")]


def test_result_path_with_rules_matches_brute_force(spark):
    st = TagSettings(map_tags=MAP_RULES, ban_tags=BAN)
    pred = X.pred(spark, SF_SMALL)
    lists = {r.file_id: [(e.tag, e.score) for e in r.tags] for r in D._lists(pred, st, 0.0).collect()}
    vocab = {}
    for r in T.prepare_predictions(pred).where(F.col("category") != "rating").collect():
        vocab.setdefault((r.file_id, r.category), set()).add(r.tag)
    want = {}
    rules = parse_mapping_rules(st.map_tags)
    ban = set(T.csv_list(st.ban_tags, drop_empty=False))
    for fid, tags in lists.items():
        res = sorted([(x, s) for x, s in brute_map(tags, rules) if x not in ban], key=lambda e: e[1], reverse=True)
        for cat in ("character", "general"):
            d = {}
            for x, s in res:
                if x in vocab.get((fid, cat), set()):
                    d[x] = s            # a later (lower) duplicate overwrites, as in a dict
            for x, s in d.items():
                want[(fid, cat, x)] = s
    got = {(r.file_id, r.category, r.tag): r.score for r in D.result_scores(pred, st).collect()}
    assert got == want
