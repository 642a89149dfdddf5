"""Caption merge: cases derived from the merge's meaning, properties, and the Spark path against a list version."""

import random

import pytest

from tagloom.operators.merge import merge_captions


def merged(base, edit, new, allowed=None):
    """The merge on Python lists: the edit is the frame, the model's own tags are put in front of what follows them."""
    tags = lambda s: [t.strip() for t in s.split(",") if t.strip()]
    base, edit, new = tags(base), tags(edit), tags(new)
    gaps = {k: [] for k in range(len(edit) + 1)}
    for p, tag in enumerate(new):
        if tag not in edit and tag not in base and (allowed is None or tag in allowed):
            after = [t for t in new[p + 1:] if t in edit]
            gaps[edit.index(after[0]) if after else len(edit)].append(tag)
    out = []
    for k in range(len(edit) + 1):
        out += gaps[k] + edit[k:k + 1]
    return ", ".join(out)


CASES = [
    ("the human adds", "sky, tree", "sky, tree, bird", "sky, tree", "sky, tree, bird"),
    ("the human removes", "sky, tree, bird", "sky", "sky, tree, bird", "sky"),
    ("the human swaps two", "sky, tree, bird", "tree, sky, bird", "sky, tree, bird", "tree, sky, bird"),
    ("the model appends", "sky, tree", "sky, tree", "sky, tree, bird, sun", "sky, tree, bird, sun"),
    ("the model inserts", "sky, tree", "sky, tree", "sky, sun, tree", "sky, sun, tree"),
    ("both: removed and appended", "sky, tree, bird", "sky, tree", "sky, tree, bird, sun", "sky, tree, sun"),
    ("both: moved and inserted", "sky, BREAK, tree", "sky, tree, BREAK", "sky, sun, BREAK, tree", "sky, tree, sun, BREAK"),
    ("the model drops a tag the human kept", "sky, tree", "sky, tree", "sky", "sky, tree"),
    ("both add the same", "sky", "sky, sun", "sun, sky", "sky, sun"),
    ("nothing was edited", "", "", "sky, sky, tree", "sky, sky, tree"),
    ("all is empty", "", "", " , ", ""),
]


@pytest.mark.parametrize("name,base,edit,new,want", CASES, ids=[c[0] for c in CASES])
def test_cases(name, base, edit, new, want):
    assert merged(base, edit, new) == want


def _rand_caption(rng, vocab):
    return ", ".join(rng.sample(vocab, rng.randint(0, len(vocab))))


def test_properties():
    rng = random.Random(1)
    vocab = ["tag", "tags", "tag a", "tag b", "blue sky", "blue skies", "BREAK", "x", "xy"]
    for _ in range(3000):
        i, e, n = (_rand_caption(rng, vocab) for _ in range(3))
        tags = lambda s: [t.strip() for t in s.split(",") if t.strip()]
        assert merged(i, e, i) == ", ".join(tags(e))                             # model unchanged -> the edit
        assert merged("", "", n) == ", ".join(tags(n))                           # no edit -> the model
        out = tags(merged(i, e, n))
        assert [t for t in out if t in tags(e)] == tags(e)                       # an edit is never lost, nor its order
        assert not set(tags(i)) - set(tags(e)) & set(out)                        # what the human removed stays out


def test_spark_merge(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "BREAK", "tag one", "tag two"]
    rows = [(k, *c[1:4]) for k, c in enumerate(CASES)]
    rows += [(100 + k, *(_rand_caption(rng, vocab) for _ in range(3))) for k in range(300)]
    rows += [(1000 + k, "", "", _rand_caption(rng, vocab)) for k in range(50)] + [(2000, "a, b", "b, a", "a, b, d, d")]
    df = spark.createDataFrame(rows, "file_id long, initial string, edited string, new string")
    allowed = ["a", "BREAK", "tag one"]
    frame = spark.createDataFrame([(t,) for t in allowed], "tag string")
    for wl, plain in ((None, None), (allowed, allowed), (frame, allowed), ([], [])):
        done = merge_captions(df, whitelist=wl)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        got = {r.file_id: r.merged for r in done.collect()}
        for k, i, e, n in rows:
            assert got[k] == merged(i, e, n, plain), (k, i, e, n, plain)


def test_tag_dataset_with_edits(spark):
    from tagloom.operators.tags import TagSettings
    from tagloom.plans import dataset as D
    from tagloom.sources import fixtures as X
    from conftest import SF_SMALL
    pred = X.pred(spark, SF_SMALL)
    side, edits = X.captions(spark, SF_SMALL), X.file_edits(spark, SF_SMALL)
    caps, stats = D.tag_dataset(pred, TagSettings(), sidecars=side, edits=edits)
    rows = {r.file_id: r for r in caps.collect()}
    sides = {r.file_id: r.caption for r in side.collect()}
    stored = {r.file_id: (r.previous_edit, r.new_edit) for r in edits.collect()}
    assert len(rows) == pred.select("file_id").distinct().count()
    for fid, r in rows.items():
        if fid in stored:
            prev, new = stored[fid]
            if fid in sides and sides[fid] != new:        # stale stored edit: refreshed from the sidecar
                assert r.merged == merged(r.caption, sides[fid], r.caption)
                assert (r.store_previous, r.store_new) == (r.caption, sides[fid])
            else:
                assert r.merged == merged(prev, new, r.caption)
        elif sides.get(fid):
            assert r.merged == merged(r.caption, sides[fid], r.caption)
        else:
            assert r.merged == r.caption
    assert stats.count() > 0
