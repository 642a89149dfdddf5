"""English stemmer: published vocabulary pairs; stemmed index search."""

from tagloom.functions.stem import stem_terms
from tagloom.plans import wiki as W

PAIRS = """consign consign|consigned consign|consigning consign|consignment consign|consistency consist|
consistently consist|consolation consol|consolatory consolatori|consolidating consolid|consolingly consol|
consonant conson|conspicuously conspicu|conspiracy conspiraci|conspirators conspir|constables constabl|
constancy constanc|knackeries knackeri|knaves knave|kneaded knead|kneeling kneel|knees knee|knightly knight|
knitting knit|knives knive|knockers knocker|running run|generously generous|cries cri|ties tie|gaps gap|gas gas|
kiwis kiwi|ponies poni|happy happi|agreed agre|skies sky|dying die|news news|communication communic"""


def test_stem_pairs(spark):
    pairs = dict(p.split() for p in PAIRS.replace("\n", "").split("|"))
    done = stem_terms(spark.createDataFrame([(w,) for w in [*pairs, None, "ab"]], "term string"))
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    got = {r.term: r.stem for r in done.collect()}
    assert got.pop(None) is None and got.pop("ab") == "ab"
    assert got == pairs


def test_stemmed_index_search(spark):
    wiki = spark.createDataFrame([(1, 5, "knights", "knights ", "a knight rides"), (2, 9, "cats", "cats ", "dogs")],
                                 "id int, post_count int, title string, search_title string, search_text string")
    ps = W.stem_index(W.build_search_index(wiki))
    assert {r.term for r in ps.collect()} >= {"knight", "ride", "cat", "dog"}
    got = W.query_wiki(wiki, ps, "Knight", 5, stem=True).collect()
    assert [r.title for r in got] == ["knights"]
