import random

import pytest

from tagloom.llm import labels
from tagloom.llm import toxicity as T
from tagloom.llm.queries import QUERIES

LEXICON = {b"idiot": 4.0, b"scum": 3.0, "bocoé".encode(): 3.0, b"boco*": 2.6}


def kinds(text):
    return [k for k, _, _ in T.matches(text.encode(), T.Symbols(LEXICON))]


@pytest.mark.parametrize("text, want", [
    ("You are an IDIOT!", [T.AIMED]), ("idiot, you", [T.AIMED]), ("an idiot. You", [T.PLAIN]), ("not an idiot", [T.NEGATED]),
    ("not a word in this long clause idiot", [T.PLAIN]), ("she said you idiot", [T.REPORTED]), ("she said so; idiot", [T.PLAIN]),
    ("kill the lights", []), ("i will hurt nobody", []), ("they will kill", [T.AIMED]), ("i will kill all of you", [T.AIMED]), ("kill it", []), ("you we kill", [T.AIMED]), ("scum***", [T.PLAIN]),
    ("bocorra", [T.PLAIN]), ("clean text", []), ("", []), ("idiotic", []), ("idiot scum\nidiot", [T.PLAIN] * 3)])
def test_grammar(text, want):
    assert kinds(text) == want


def test_weights_are_the_best_key():
    s = T.Symbols(LEXICON)
    assert s["bocoé!".encode()] == (T.INSULT, 3.0) and s[b"bocox"] == (T.INSULT, 2.6) and s[b"not"][0] == T.NEGATION


def test_held_out_accuracy(spark):
    from llm.sf import accuracy
    right, caught, false = accuracy(spark, QUERIES["op7_toxicity"], "toxic")
    assert right > 0.95 and caught > 0.85 and false < 0.03


@pytest.fixture
def trained(docs):
    rnd = random.Random(1)
    words = "the of and river stone green light paper".split()
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, marks = [], []
    for k in range(200):
        t = text(30)
        if k % 4 == 0:
            t[rnd.randrange(30)] = "scumbag"
        rows.append((k, " ".join(t)))
        marks.append((k, int(k % 4 == 0)))
    df = docs(rows)
    return df, df.sparkSession.createDataFrame(marks, "doc_id long, label int")


def test_learns_an_unknown_word(trained, odd):
    model = T.fit(*trained)
    got = {r["doc_id"]: r["score"] for r in T.score(trained[0], model).collect()}
    assert min(s for k, s in got.items() if k % 4 == 0) > 0.8 and max(s for k, s in got.items() if k % 4) < 0.1
    rest = T.score(odd, model)
    assert rest.count() == odd.count() and rest.columns == [*odd.columns, "score"]
    assert all(0 <= r["score"] < 0.3 for r in rest.collect())


def test_nothing_to_learn_from(trained, odd, docs):
    df, marks = trained
    for few in (marks.limit(0), marks.filter("label = 0")):
        model = T.fit(df, few)
        assert model[0] == {} and len({r["score"] for r in T.score(odd, model).collect()}) == 1
    assert T.score(docs([]), T.fit(df, marks)).count() == 0


def test_labels_outside_the_fold_and_bounded(spark, monkeypatch):
    import zlib
    rows = [(k, k % 2) for k in range(100)] + [(None, 1), (1, None), (2, 1), (2, 1)]
    df = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r["doc_id"]: r["label"] for r in labels.training_labels(df, "toxic", 4, 2).collect()}
    assert got.keys() == {k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2} and got.get(2, 1) == 1
    assert labels.training_labels(df, "toxic", 4, 2, limit=10).count() == 10
