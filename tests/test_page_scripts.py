"""Tokens and trees of page scripts, and what they tell without being run."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborfold.functions import script_tree
from arborfold.functions.page import Page
from arborfold.functions.script_tokens import ScriptSyntaxError, tokens
from arborfold.functions.script_tree import tree, walk
from arborfold.operators import pages

GAPS = r"(?:[ \t\r\n]|//[^\n]*|/\*.*?\*/)*"


def rejoined(script):
    """The script, where tokens keep their texts and nothing but space and comments lies between them."""
    at, out = 0, []
    for t in tokens(script):
        assert re.fullmatch(GAPS, script[at : t.at], re.S)
        out += [script[at : t.at], t.text]
        at = t.at + len(t.text)
    return "".join(out)


PIECES = ["a", "b1", "$_", "return", "typeof", "1", ".5", "0x1F", "1e3", "'s\\'t'", '"d\\n"', "`t`", "`a${", "}b`", "/re[/]g/gi", "//c\n", "/*c\n*/", " ", "\n", "(", ")", "[", "]", "{", "}", ";", ",", "+", "++", "/", "=", "=>", "?.", "??", "?", ":", ">>>=", "..."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_texts_rejoin(pieces):
    script = "".join(pieces)
    try:
        assert rejoined(script) == script
    except ScriptSyntaxError:
        pass


def kinds(script):
    return [(t.kind, t.text) for t in tokens(script)][:-1]


def test_tokens():
    assert kinds("a/b/c") == [("name", "a"), ("mark", "/"), ("name", "b"), ("mark", "/"), ("name", "c")]
    assert kinds("x = /b/c")[2] == ("pattern", "/b/c") and kinds("return /b/")[1] == ("pattern", "/b/") and kinds("f(a)/b/c")[4] == ("mark", "/")
    assert kinds("i++ / 2 / 3")[2] == ("mark", "/") and kinds("/[/]/.test(a)")[0] == ("pattern", "/[/]/")
    assert kinds("`a${`b${1}`}c`/2") == [("template", "`a${"), ("template", "`b${"), ("number", "1"), ("template", "}`"), ("template", "}c`"), ("mark", "/"), ("number", "2")]
    assert kinds("a?.b a?.1:2 a??b")[1] == ("mark", "?.") and ("number", ".1") in kinds("a?.1:2")
    assert [t.value for t in tokens(r"""'\x41B\u{1F600}\
c' 0b101 0o17 1. ab '😀'""")][:-1] == ["AB😀c", 5.0, 15.0, 1.0, "ab", "😀"]
    assert [t.line_before for t in tokens("a\nb /*\n*/ c d")] == [False, True, True, False, False]
    assert tokens("`\\u00`")[0].value is None
    for bad in ("/* x", "'a\n'", "`a", "}", "0x", "é", "x = /a", "'\\u12'", "a = /b\n/"):
        with pytest.raises(ScriptSyntaxError):
            tokens(bad)


def shape(node):
    inner = " ".join(shape(n) for _, n in node.parts)
    head = node.kind if node.value is None else f"{node.kind}:{node.value}"
    return f"({head} {inner})" if inner else head


def value(script):
    return shape(tree(script).parts[0][1].parts[0][1])


def test_precedence():
    assert value("a + b * c ** d ** e - f") == "(binary:- (binary:+ name:a (binary:* name:b (binary:** name:c (binary:** name:d name:e)))) name:f)"
    assert value("a ?? b || c && d == e < f") == "(binary:?? name:a (binary:|| name:b (binary:&& name:c (binary:== name:d (binary:< name:e name:f)))))"
    assert value("a = b ? c : d, -e.f[g](h)") == "(sequence (assign:= name:a (choice name:b name:c name:d)) (unary:- (call (index (member:f name:e) name:g) name:h)))"
    assert value("async (a, {b = 1, ...c}, [d, , e] = []) => a") == "(arrow:async name:a (object_pattern (pair:b key:b (default name:b number:1)) (rest name:c)) (default (array_pattern name:d hole name:e) array) name:a)"
    assert value("new a.b(1)(2)") == "(call (new (member:b name:a) number:1) number:2)" and value("t`a${1}`") == "(tagged name:t (template string:a number:1 string:))"
    assert value("[a, b] = [b, a]") == "(assign:= (array_pattern name:a name:b) (array name:b name:a))"
    assert value("({a, 'b': 1, [c]: 2, get d() {}, async *e() {}, ...f})").startswith("(object (pair:a key:a name:a) (pair:b key:b number:1) (pair (computed name:c) number:2) (method:get key:d block) (method:async generator key:e block) (spread")


def test_statements():
    good = ["for (const [k, v] of m) continue;", "for (var i = 0, n = 3; i < n; i++);", "for (x in y) {}", "l: while (1) { break l }", "do x; while (y) z", "if (a) b; else c", "try {} catch {} finally {}", "try {} catch (e) {}"]
    good += ["switch (a) { case 1: x; break; default: y }", "class A extends B { static x = 1; get y() { return super.y } async *z() { yield 1 } }", "function* g() { yield* a; const x = yield }", "a = b\nc = d", "x = async", "throw new E", "async function f() { for await (x of y); }", "var {a: {b}} = c", "a?.b?.[c]?.(d)", "new.target", "(() => { return })()"]
    for script in good:
        assert len(list(walk(tree(script)))) > 2
    for bad in ["return", "a b", "break", "while (1) { (() => { break })() }", "continue l", "throw\nx", "1 = 2", "a++ ++", "try {}", "switch (a) { default: default: }", "((((", "var [a]", "function () {}", "f(...a", "[...a, b] = c", "{", "`a${1"]:
        with pytest.raises(ScriptSyntaxError):
            tree(bad)
    for deep in ("(" * 380 + "1" + ")" * 380, "{" * 390 + "}" * 390, "a+" * 5000 + "1"):
        tree(deep)
    for too_deep in ("(" * 500 + "1" + ")" * 500, "-" * 2000 + "1", "{" * 401 + "}" * 401, "a**" * 1000 + "b", "x=>" * 500 + "1"):
        with pytest.raises(ScriptSyntaxError, match="too deeply"):
            tree(too_deep)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES + ["if (a) ", "function f(", "for (", "class A {", "x => "]), max_size=30))
def test_trees_are_relations(pieces):
    try:
        rows = list(walk(tree("".join(pieces))))
    except ScriptSyntaxError:
        return
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1] is None
    for k, parent, part, depth, node in rows[1:]:
        assert parent < k and part and depth == rows[parent][3] + 1 and (part, node) in rows[parent][4].parts


def test_fetches():
    found = lambda script: list(script_tree.fetches(tree(script)))
    assert found('fetch("/a", {headers: {"x": "y"}, method: "post", body: "k=1"})') == [("POST", "/a", "k=1")]
    assert found('// fetch("/a")\n/* fetch("/b") */ x = "fetch(\'/c\')"; y = /fetch("d")/; z = `fetch("/e")`') == []
    assert found('const at = "/v" + 1, how = {body: JSON.stringify({a: [1, "b", null]}), method: `PUT`}; window.fetch(`${at}/x`, how)') == [("PUT", "/v1/x", '{"a":[1,"b",null]}')]
    assert found("fetch(at); fetch('/a', how); fetch('/b', {method: m}); fetch('/c', {...o}); fetch(); my.fetch('/d'); fetch('/e', {body: b})") == [("GET", "/e", "")]
    assert found("const a = '/a'; function f(a) { fetch(a) }") == [] and found("b.then(() => fetch('/x'))") == [("GET", "/x", "")]


BRIDGED = [
    ("<a id=l href='/next#x'>n</a><form id=f action='/s' method=post><input name=a value=1></form><script>const el = document.getElementById('l'); el.click(); document.forms[0].submit()</script>", ("link", "GET", "http://h/next#x", "")),
    ("<form action='/s'><input name=a value=1></form><script>document.querySelector('form').submit()</script>", ("submit", "GET", "http://h/s?a=1", "")),
    ("<form action='/p' method=post><input type=hidden name=__EVENTTARGET value=old><input name=u value=v></form><script>__doPostBack('t$1', '')</script>", ("postback", "POST", "http://h/p", "__EVENTTARGET=t%241&u=v&__EVENTARGUMENT=")),
    ("<form method=post></form><a id=j href=\"javascript:__doPostBack('t','a')\">go</a><script>(function () { document.links[0].click() })()</script>", ("postback", "POST", "http://h/", "__EVENTTARGET=t&__EVENTARGUMENT=a")),
    ("<a id=l href='/next'>n</a><script>function go() { document.getElementById('l').click() } // document.links[0].click()\n</script>", None),
    ("<a id=l href='mailto:x@y'>n</a><script>document.getElementById('l').click(); document.getElementById('no').click(); document.body.submit()</script>", None),
    ("<script>__doPostBack('a', 'b')</script>", None),
    ("<a id=l href='/next'>n</a><script>document.getElementById('l').click(</script>", None),
]


def test_bridge(spark):
    for html, want in BRIDGED:
        assert Page(html, "http://h/").bridge() == want
    df = spark.createDataFrame([(k, "http://h/", html) for k, (html, _) in enumerate(BRIDGED)] + [(99, None, None)], "page_id long, url string, html string")
    held = spark.createDataFrame([(1, "http://h/next", "GET", "", "<p>next</p>"), (2, "http://h/p", "POST", "__EVENTTARGET=t%241&u=v&__EVENTARGUMENT=", "<p>back</p>")], "page_id long, url string, method string, form string, html string")
    got = {r["page_id"]: (r["kind"], r["html"], r["error"]) for r in pages.bridge(df, held).collect()}
    assert got == {0: ("link", "<p>next</p>", None), 1: ("submit", None, "not found"), 2: ("postback", "<p>back</p>", None), 3: ("postback", None, "not found")}


def test_relations_of_scripts(spark):
    df = spark.createDataFrame([(1, "<script>a(1)</script><script src=x></script><script>b(</script>"), (2, None), (None, "<script type=module>1</script>")], "page_id long, html string")
    rows = pages.script_tokens(df).orderBy("page_id", "script", "seq").collect()
    assert [(r["page_id"], r["script"], r["kind"], r["text"], r["value"]) for r in rows if r["page_id"] is None or r["script"] == 0] == [(None, 0, "number", "1", "1"), (None, 0, "end", "", ""), (1, 0, "name", "a", "a"), (1, 0, "mark", "(", "("), (1, 0, "number", "1", "1"), (1, 0, "mark", ")", ")"), (1, 0, "end", "", "")]
    nodes = pages.script_nodes(df).where("page_id = 1").orderBy("script", "node").collect()
    assert [(r["script"], r["node"], r["parent"], r["part"], r["kind"], r["value"]) for r in nodes[:5]] == [(0, 0, None, None, "program", None), (0, 1, 0, "item", "expression", None), (0, 2, 1, "value", "call", None), (0, 3, 2, "callee", "name", "a"), (0, 4, 2, "argument", "number", "1")]
    assert nodes[5]["kind"] == "error" and nodes[5]["value"].startswith("unexpected token at 2")


WRITING = """<title>old</title><p id="a" class="x y">one</p><p id="b" hidden>two</p><input id="c" type="checkbox"><div id="d"></div><script>
document.title = "new"; const a = document.getElementById("a"), by = document.querySelector("#b"); a.textContent = "1 < 2"; a.classList.add("z", "x"); a.classList.remove("y"); a.style.backgroundColor = "red"; a.style.color = "blue"; a.style.color = "";
by.hidden = false; by.title = `t${1}`; document.getElementById("c").checked = true; document.querySelector("#d").innerHTML = "<b>hi</b>"; document.querySelector("#d b").setAttribute("Data-K", "v" + 1); document.getElementById("d").insertAdjacentHTML("beforeend", "<i>x</i>");
by.remove(); by.title = "gone"; a.title = unknown; if (1) { a.textContent = "no" } function f() { a.remove() } document.body.remove(); a.removeAttribute("id"); x = y; 1 + 1; a.foo = 3; a.title = {}; document.querySelector("[").remove()
</script>"""


def test_plain_writes(spark):
    from arborfold.functions.tree import written

    html, n = written(Page(WRITING, "http://h/"))
    assert html.split("<script>")[0] == '<title>new</title><p class="x z" style="background-color: red;">1 &lt; 2</p><input id="c" type="checkbox" checked=""><div id="d"><b data-k="v1">hi</b><i>x</i></div>' and n == 15
    df = spark.createDataFrame([(1, "http://h/", WRITING), (2, None, None), (3, "http://h/", "<p id=p>x</p><script>broken(</script>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in pages.written(df).collect()}
    assert rows[1]["writes"] == 15 and rows[2]["html"] == "" and rows[3]["writes"] == 0 and rows[3]["html"].startswith('<p id="p">x</p>')


def test_navigation(spark):
    from arborfold.operators.nodes import navigate, parse_pages

    df = spark.createDataFrame([(1, "<ul>t<li>a</li><!--c--><li>b</li></ul><p></p>"), (2, None)], "page_id long, html string")
    rows = {(r["page_id"], r["node_id"]): r for r in navigate(parse_pages(df)).collect()}
    assert len(rows) == 10
    pick = lambda page, node: tuple(rows[page, node][c] for c in ("tag", "parent_tag", "first_child", "last_child", "children", "first_element", "last_element", "previous", "next", "previous_element", "next_element"))
    assert pick(1, 0) == (None, None, 1, 8, 2, 1, 8, None, None, None, None)
    assert pick(1, 1) == ("ul", None, 2, 6, 4, 3, 6, None, 8, None, 8)
    assert pick(1, 3) == ("li", "ul", 4, 4, 1, None, None, 2, 5, None, 6) and pick(1, 6)[7:] == (5, None, 3, None) and pick(1, 2)[7:] == (None, 3, None, 3)
    assert pick(2, 0)[1:] == (None, None, None, 0, None, None, None, None, None, None)
