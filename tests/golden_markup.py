"""Markup -> markdown cases ``(rule, input, expected)``, written per rule from the output format. Inputs and outputs are
compared after stripping leading newlines and trailing blanks."""

SITE = "https://danbooru.donmai.us"      # fixed value: where page, search and user links lead
WIKI, SEARCH, USER = f"{SITE}/wiki_pages/", f"{SITE}/posts?tags=", f"{SITE}/users?name="


def a(url, label):
    return f'<a href="{url}">{label}</a>'


def inline_cases():
    """Every inline tag: one line, several lines with blanks, an empty line, two on a line, nested, unclosed."""
    html = {"b": ("<b>", "</b>"), "i": ("<i>", "</i>"), "u": ("<ins>", "</ins>"), "s": ("<s>", "</s>"), "tn": ("<sub><sup>", "</sub></sup>")}
    for tag, (x, y) in html.items():
        yield f"{tag}: one line", f"a [{tag}]quiet lake[/{tag}] b", f"a {x}quiet lake{y} b"
        yield f"{tag}: blanks go", f"[{tag}]  quiet [/{tag}]", f"{x}quiet{y}"
        yield f"{tag}: each line", f"[{tag}]north \n south\n\nwest[/{tag}]", f"{x}north{y}\n{x}south{y}\n{x}west{y}"
        yield f"{tag}: twice", f"[{tag}]up[/{tag}] and [{tag}]down[/{tag}]", f"{x}up{y} and {x}down{y}"
        if tag != "tn":
            yield f"{tag}: unclosed", f"[{tag}]to the end of the line\nnext line", f"{x}to the end of the line{y}\nnext line"


def link_cases():
    out = "https://example.org/river/9?x=1"
    yield "bare url", f"visit {out} today", f"visit {a(out, out)} today"
    yield "angle url", f"(<{out}>)", f"({a(out, out)})"
    yield "quoted text and bracket", f'"the river":[{out}].', f"{a(out, 'the river')}."
    yield "quoted text and url", f'"the river":{out} ends', f"{a(out, 'the river')} ends"
    yield "quoted text and path", '"rules":/help/rules', a("/help/rules", "rules")
    yield "quoted text and section", '"below":#dtext-notes', a("#dtext-notes", "below")
    yield "text before url", f"[the river]({out})", a(out, "the river")
    yield "url before text", f"[{out}](the river)", a(out, "the river")
    yield "url tag", f"[url]{out}[/url]", a(out, out)
    yield "url tag with text", f"[url={out}]the river[/url]", a(out, "the river")
    yield "html stays", a(out, "the river"), a(out, "the river")
    yield "page", "[[Glass Bridge]]", a(WIKI + "glass_bridge", "Glass Bridge")
    yield "page and section", "[[Glass Bridge#Builders]]", a(WIKI + "glass_bridge#dtext-builders", "Glass Bridge")
    yield "page, small hash is no section", "[[Glass#bridge]]", a(WIKI + "glass#bridge", "Glass#bridge")
    yield "page with label", "[[Glass Bridge| that bridge ]]", a(WIKI + "glass_bridge", "that bridge")
    yield "page, section and label", "[[Glass Bridge#Builders|who built it]]", a(WIKI + "glass_bridge#dtext-builders", "who built it")
    yield "section behind the label", "[[Glass Bridge|who built it#Builders]]", a(WIKI + "glass_bridge#dtext-builders", "who built it")
    yield "empty label drops the qualifier", "[[Bridge (glass)|]]", a(WIKI + "bridge_(glass)", "Bridge")
    yield "adjoining letters", "old[[Bridge]]s here", a(WIKI + "bridge", "oldBridges") + " here"
    yield "search", "{{Red_Boat harbour}}", a(SEARCH + "red_boat harbour", "Red_Boat harbour")
    yield "search with label", "{{red_boat|red boats}}", a(SEARCH + "red_boat", "red boats")
    yield "search, empty label", "{{boat (toy)|}}", a(SEARCH + "boat (toy)", "boat")
    yield "user", "thanks, @ann_lee-2!", f"thanks, {a(USER + 'ann_lee-2', '@ann_lee-2')}!"
    yield "user after a word", "ann@harbour", "ann" + a(USER + "harbour", "@harbour")
    yield "user mark inside a label", "[[Old Quay|mail to quay@north]]", a(WIKI + "old_quay", "mail to quay@north")
    yield "user as link text", f'"@ann":{out}', a(out, "@ann")
    yield "quoted link inside quotes", f'she wrote ""see the map":[{out}]" twice', f'she wrote "{a(out, "see the map")}" twice'
    yield "two forms side by side", f"[[bridge]] {{{{boat}}}} @ann <{out}>", " ".join(
        [a(WIKI + "bridge", "bridge"), a(SEARCH + "boat", "boat"), a(USER + "ann", "@ann"), a(out, out)])


def block_cases():
    yield "break", "first[br]second", "first<br>\nsecond"
    yield "rule", "first[hr]second", "first\n<hr>\nsecond"
    yield "spoilers go", "the [spoilers]gardener[/spoilers] did it", "the gardener did it"
    yield "expand", "[expand]more[/expand]", "more"
    yield "expand with a title", "[expand=Details]more[/expand]", "<h5>Details</h5>\n<hr>\nmore"
    yield "expand with a word", "[expand now]more[/expand]", "more"
    yield "quote in quote", "[quote]\nhe said\n[quote]\nshe said\n[/quote]\n[/quote]", \
        "<blockquote>\nhe said\n<blockquote>\nshe said\n</blockquote>\n</blockquote>"
    for n in (1, 2, 6):
        yield f"heading {n}", f"h{n}. The   harbour ", f"<h{n}>The   harbour</h{n}>"
        yield f"heading {n} with a name", f"h{n}#quay-{n}. The quay\ntext", f'<h{n} id="quay-{n}">The quay</h{n}>\ntext'
    yield "heading with a link", "h3. On [[Quay]]", f"<h3>On {a(WIKI + 'quay', 'Quay')}</h3>"
    yield "list", "* oak\n* ash\n* elm", "<ul>\n<li>oak</li>\n<li>ash</li>\n<li>elm</li>\n</ul>"
    yield "list in list", "* tree\n** oak\n** ash\n* bush", \
        "<ul>\n<li>tree</li>\n<ul>\n<li>oak</li>\n<li>ash</li>\n</ul>\n<li>bush</li>\n</ul>"
    yield "list with links", '* "oak":#dtext-oak\n* [url=http://example.net/ash]ash[/url]', \
        f"<ul>\n<li>{a('#dtext-oak', 'oak')}</li>\n<li>{a('http://example.net/ash', 'ash')}</li>\n</ul>"
    yield "text after a list", "* oak\n\nthe end", "<ul>\n<li>oak</li>\n</ul>\nthe end"
    yield "table", "[table][tr][th]tree[/th][/tr][tr][td]oak[/td][/tr][/table]", \
        "<table><tr><th>tree</th></tr><tr><td>oak</td></tr></table>"
    yield "table with attributes", '[table][tr class="x"][td colspan=2]oak[/td][th align=left]ash[/th][/tr][/table]', \
        "<table><tr><td>oak</td><th>ash</th></tr></table>"
    yield "text between cells is one line end", "[table]\n \n[tr]\n\n[td]oak[/td] ,, [td]ash[/td]\n[/tr]\n[/table]", \
        "<table>\n<tr>\n<td>oak</td>\n<td>ash</td>\n</tr>\n</table>"
    yield "table groups", "[table][thead][tr][th]tree[/th][/tr][/thead][tbody][tr][td]oak[/td][/tr][/tbody][/table]", \
        "<table><tr><th>tree</th></tr><tr><td>oak</td></tr></table>"


def protected_cases():
    for inner in ("[b]oak[/b]", "h2. oak", "[[oak]] @ann", "<https://example.org/>", "* oak"):
        yield f"nodtext: {inner}", f"x [nodtext]{inner}[/nodtext] y", f"x {inner} y"
        yield f"code: {inner}", f"[code]{inner}[/code]", f"```\n{inner}\n```"
    yield "code keeps one line end", "[code]\noak\n[/code]", "```\n\noak\n```"
    yield "control characters stay", "\x01 [b]oak[/b] \x02\x07", "\x01 <b>oak</b> \x02\x07"


ALL = [c for cases in (inline_cases, link_cases, block_cases, protected_cases) for c in cases()]
