"""Markup: rendering cases (all in one Spark job), errors, link and heading extraction, plain text."""

import pytest
from pyspark.sql import functions as F

from golden_markup import ALL, SEARCH, USER, WIKI
from tagloom.operators.markup import extract_headings, extract_wiki_links, plain_text
from tagloom.operators.render import render_corpus, render_markdown


def _norm(s):
    return s.lstrip("\n").rstrip(" \t\n")


@pytest.fixture(scope="module")
def rendered(spark):
    df = spark.createDataFrame([(i, _norm(d)) for i, (_, d, _) in enumerate(ALL)], "id int, body string")
    return {r.id: (r.markdown, r.error) for r in render_corpus(df).collect()}


@pytest.mark.parametrize("i", range(len(ALL)), ids=[c[0] for c in ALL])
def test_render(rendered, i):
    assert rendered[i] == (_norm(ALL[i][2]), None)


def test_render_null_body(spark):
    df = spark.createDataFrame([(1, None)], "id int, body string")
    assert df.select(render_markdown(F.col("body")).alias("m")).collect()[0].m is None


def test_errors_stop_no_other_page(spark):
    pages = [(1, "[td]oak[/td]"), (2, "[table][colgroup][col][/colgroup][/table]"), (3, "[url=x][b]y[/b][/url]"),
             (4, "[quote][table][/table][/quote]"), (5, "[nodtext][td][/nodtext]"), (6, "fine"), (7, None), (8, "[tr](https://example.org/x)"),
             (9, "[table][b]x[/b][/table]"), (10, "a\r\nb [table][tr][td][td]")]
    got = {r.id: (r.markdown, r.error, r.error_at) for r in render_corpus(spark.createDataFrame(pages, "id int, body string")).collect()}
    wrong = {k: v[1:] for k, v in got.items() if v[1]}
    assert wrong == {1: ("a table part outside of a table", 0), 2: ("a column tag has no rendering", 7), 3: ("a tag inside [url]", 7),
                     4: ("a table inside [quote]", 7), 9: ("a tag between a table's cells", 7), 10: ("a table part outside of a table", 19)}
    assert all(got[k][0] is None for k in (*wrong, 7))
    assert got[5][:2] == ("[td]", None) and got[6][:2] == ("fine", None) and got[7][:2] == (None, None) and got[8][1] is None


NESTED = [
    ("same tag in itself", "[b]a [b]c[/b] d[/b] e", "<b>a <b>c</b> d</b> e"),
    ("three deep", "[quote]1[quote]2[quote]3[/quote]2[/quote]1[/quote]",
     "<blockquote>1<blockquote>2<blockquote>3</blockquote>2</blockquote>1</blockquote>"),
    ("crossing ends", "[b]a [i]c[/b] d[/i]", "<b>a <i>c</i></b> d[/i]"),
    ("unclosed in closed", "[b]a [i]c\nd[/b]", "<b>a <i>c</i></b>\n<b>d</b>"),
    ("unclosed quote ends with the page", "[quote]a [b]c[/b]", "<blockquote>a <b>c</b></blockquote>"),
    ("unclosed side by side", "[b]a[i]c\nd", "<b>a<i>c</i></b>\nd"),
    ("end without a beginning", "a[/b] [/quote]", "a[/b] [/quote]"),
    ("table in table", "[table][tr][td]a[/td][/tr][tr][table][tr][td]c[/td][/tr][/table][/tr][/table]",
     "<table><tr><td>a</td></tr><tr><table><tr><td>c</td></tr></table></tr></table>"),
    ("table in expand", "[expand=More][table][tr][td]a[/td][/tr][/table][/expand]",
     "<h5>More</h5>\n<hr>\n<table><tr><td>a</td></tr></table>"),
    ("unclosed cells", "[table][tr][td]a[/table] b", "<table><tr><td>a</td></tr></table> b"),
    ("tags in a quoted link", '"[b]a[/b]":/x', '<a href="/x"><b>a</b></a>'),
    ("nodtext in bold", "[b]a [nodtext][i]x[/i][/nodtext] c[/b]", "<b>a [i]x[/i] c</b>"),
    ("unclosed nodtext", "a [nodtext][b]x[/b]", "a [b]x[/b]"),
    ("code in quote", "[quote][code]h1. x[/code][/quote]", "<blockquote>```\nh1. x\n```</blockquote>"),
    ("bold in a list item", "* [b]a[/b] c\n* d", "<ul>\n<li><b>a</b> c</li>\n<li>d</li>\n</ul>"),
    ("heading in a cell", "[table][tr][td]h2. a[/td][/tr][/table]", None),
    ("brackets that are no tags", "[ [x] [bold] [b", "[ [x] [bold] [b"),
    ("expand with quotes", '[expand="A b"]c[/expand]', "<h5>A b</h5>\n<hr>\nc"),
]


def test_nesting(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(NESTED)], "id int, body string")
    got = {r.id: (r.markdown, r.error) for r in render_corpus(df).collect()}
    for i, (name, _, want) in enumerate(NESTED):
        assert got[i][1] is None, name
        if want is not None:
            assert got[i][0] == want, name


@pytest.mark.parametrize("line", ["[b]some text of a line\n", "[b]x[/b] and [[y]]\n", "[quote]x ", "[/b] text\n", "[ [ [\n", '{{ "a [[ <http://\n', "[url=x] [code] "])
def test_long_pages_take_time_in_proportion(spark, line):
    """Eight times the page takes clearly less than the 64-fold time of a quadratic pass."""
    import time
    def seconds(n):
        df = spark.createDataFrame([(1, line * n)], "id int, body string").repartition(1).cache()
        df.count()
        times = []
        for _ in range(2):
            t = time.perf_counter()
            render_corpus(df).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        return min(times)
    seconds(100)
    assert seconds(8000) < 16 * max(seconds(1000), 0.2)


def test_extract_links(spark):
    body = ("old[[Glass Bridge#Builders]]s [[b|c#Sec]], {{Boat (toy)|}} [https://example.org/1](one) [two](/2) "
            '"@ann":http://example.org/3 "four":[/4] <https://example.org/5> https://example.org/6 ann@quay '
            "[nodtext][[no]] @no[/nodtext][code]<https://example.org/no>[/code] [url=/7]seven[/url]")
    df = spark.createDataFrame([(7, body), (8, None), (9, "")], "id int, body string")
    got = [(r.kind, r.url, r.label) for r in extract_wiki_links(df).orderBy("pos").collect()]
    assert got == [
        ("wiki", WIKI + "glass_bridge#dtext-builders", "oldGlass Bridges"), ("wiki", WIKI + "b#dtext-sec", "c"),
        ("search", SEARCH + "boat (toy)", "Boat"), ("md_url", "https://example.org/1", "one"), ("md_text", "/2", "two"),
        ("text_url", "http://example.org/3", "@ann"), ("text_url", "/4", "four"),
        ("angle_url", "https://example.org/5", "https://example.org/5"), ("bare_url", "https://example.org/6", "https://example.org/6"),
        ("user", USER + "quay", "@quay"), ("tag_url", "/7", "seven")]


def test_extract_headings(spark):
    body = "h1. Harbour\ntext\nh3#east-quay. The east quay\n[code]h2. not one[/code]"
    got = [(r.pos, r.level, r.anchor, r.text) for r in
           extract_headings(spark.createDataFrame([(1, body)], "id int, body string")).orderBy("pos").collect()]
    assert got == [(0, 1, None, "Harbour"), (1, 3, "east-quay", "The east quay")]


def test_plain_text(spark):
    body = 'h2. Harbour\n[b]old[/b] [[Bridge (glass)|]] [[Bridge|that#Sec]] {{red boat|Boats}} "rules":[/help]\n* oak\n* ash'
    df = spark.createDataFrame([(1, body)], "id int, body string")
    got = df.select(plain_text(F.col("body")).alias("p")).collect()[0].p
    assert got.split() == ["Harbour", "old", "Bridge", "that", "Boats", "rules", "oak", "ash"]
