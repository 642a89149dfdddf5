import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from tagloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = bpe.read_ranks(RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library():
    ranks, enc = library()
    split, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(4)
    for _ in range(1500):
        text = "".join(rnd.choice("ab é中  \n\t'sl19<|>endoftext") for _ in range(rnd.randint(0, 80)))
        assert [i for p in split.findall(text) for i in bpe.merge(p.encode(), ranks)] == enc.encode_ordinary(text)


def test_long_runs():
    ranks, enc = library()
    for piece in (" " * 20_000, "ab" * 3_000, "!" * 5_000):
        assert bpe.merge(piece.encode(), ranks) == enc._encode_single_piece(piece)


def random_pieces(rnd, count, longest):
    return [bytes(rnd.randrange(256) if rnd.random() < 0.3 else rnd.choice(b"etaoin sh") for _ in range(rnd.randint(2, longest)))
            for _ in range(count)]


def test_side_by_side_equals_one_by_one(monkeypatch):
    ranks, _ = library()
    pieces = bpe.Pieces(ranks)
    data = [p for p in random_pieces(random.Random(5), 4000, bpe.SHORT_PIECE) if p not in ranks]
    for cells in (1, 1 << 16):
        monkeypatch.setattr(bpe, "TREE_CELLS", cells)
        some = data if cells > 1 else data[:100]
        assert bpe.merge_all(some, pieces.pairs, pieces.byte_ids) == [np.array(bpe.merge(p, ranks), "<u4").tobytes() for p in some]
    assert bpe.merge_all([], pieces.pairs, pieces.byte_ids) == []


def test_small_tables_forget_and_stay_right(monkeypatch):
    ranks, enc = library()
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.choice([3, 9, 90]))) for _ in range(rnd.randint(0, 30))) for _ in range(60)] + [None, ""]
    got = bpe.Pieces(ranks).encode(texts, regex.compile(public_tokenizers.PATTERN))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t or "") for t in texts]


def test_vocabularies_with_gaps():
    ranks = {b"a": 0, b"b": 5, b"ab": 9}
    packed = bpe.Pieces(ranks).encode(["abba", ""], regex.compile("[ab]+"))
    assert np.frombuffer(packed[0], "<u4").tolist() == [9, 5, 0]
    spelling = bpe.Spelling(list(ranks), list(ranks.values()))
    assert [spelling.decode(x) for x in packed] == [b"abba", b""]
    for unknown in (3, 10):
        with pytest.raises(KeyError):
            spelling.decode(np.array([unknown], "<u4").tobytes())


def test_ties_take_the_leftmost_pair():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3}
    assert bpe.merge(b"aaa", ranks) == [2, 0]
    assert bpe.merge(b"aaab", ranks) == [2, 3]


def test_documents(odd, docs, monkeypatch):
    _, enc = library()
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    want = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(want)
    assert sorted(bytes(r["decoded"]) for r in got) == sorted(t.encode() for t in texts)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    from tagloom.llm.queries import QUERIES
    _, enc = library()
    got = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = enc.encode_ordinary(row["text"] or "")
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
