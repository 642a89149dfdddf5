import random
import re

import pytest

from tagloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    words = WORD.findall(low(text))
    hit, who = set(), set()
    for item, it in items:
        w = WORD.findall(low(it))
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == w[j:j + size]:
                    hit.update(range(i, i + size))
                    who.add(item)
    return len(words), sorted(hit), sorted(who)


ITEMS = [("a", "One two THREE four five six seven eight nine ten eleven twelve"), ("b", "short item"), ("c", "é1"),
         ("d", None), ("e", " ... "), ("f", "one two three four five six seven eight nine ten"), ("a", "other words"), (None, "free")]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 12])
def test_against_brute_force(docs, bench, block_words):
    rnd = random.Random(1)
    vocabulary = "One two three four five six seven eight nine ten eleven twelve short item é1 É1 other words x free".split()
    texts = [None, "", " -- ", "short-item", "a short ITEM short item", "é1",
             "zz " + ", ".join("one two three four five six seven eight nine ten eleven twelve".split()) + "! End",
             "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    texts += [texts[-1], "x " * 50_000 + "short item"]
    items = [(i, t) for i, t in ITEMS if i]
    got = D.decontaminate(docs(list(enumerate(texts))), bench, block_words=block_words).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["hit"], r["items"]) == (brute(text, items) if len(text or "") < 9999 else (50_002, [50_000, 50_001], ["b"]))
        pieces = [text[s["begin"]:s["end"]] for s in r["spans"]]
        assert sum(len(WORD.findall(low(p))) for p in pieces) == len(r["hit"])
        assert all(p == p.strip(" -,!.") for p in pieces)


def test_empty_tables(docs, bench):
    assert D.decontaminate(docs([]), bench).count() == 0
    assert D.decontaminate(docs([(1, "short item")]), bench.limit(0)).first()["hit"] == []


def test_kept_columns(odd, bench):
    got = D.decontaminate(odd, bench, keep=["source", "text"])
    assert got.columns == ["doc_id", "source", "text", "n_words", "hit", "items", "spans"] and got.count() == odd.count()


def test_pieces_of_long_items_lose_no_window(spark):
    rnd = random.Random(3)
    words = [rnd.choice("abc") for _ in range(100)]
    rows = spark.createDataFrame([("long", " ".join(words)), ("long", " ".join(words)), ("short", "A-b"), ("none", "--")], "item_id string, text string")
    got = D.item_pieces(rows, "item_id", "text", 10, 14).collect()
    want = {tuple(words[i:i + 10]) for i in range(91)}
    cut = [bytes(r["words"]).decode().split() for r in got if r["item"] == "long"]
    assert {tuple(w[i:i + 10]) for w in cut for i in range(len(w) - 9)} == want and max(map(len, cut)) == 14
    assert [bytes(r["words"]) for r in got if r["item"] != "long"] == [b"a b"]
    dealt = list(D.blocks(rows, "item_id", "text", 10, 40))
    assert len(dealt) > 2 and sum(map(len, dealt)) == len(got)
    assert all(sum(len(t.split()) for _, t in block) <= 40 for block in dealt)


def test_symbols_are_distinct():
    shown = [D.symbol(k) for k in range(1_000_000)]
    assert len(set(shown)) == len(shown) and {len(x) for x in shown} == {2} and "".join(shown).encode()
    assert D.MISS not in shown and not {x[0] for x in shown} & {x[1] for x in shown}
