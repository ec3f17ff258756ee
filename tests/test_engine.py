import random

import duckdb
import pytest

import __spark_entry__
from arborfold import registry
from arborfold.functions import css
from arborfold.functions.html import parse
from arborfold.functions import regexes, tree
from arborfold.functions.page import Page
from arborfold.operators import controls, cookies, pages
from arborfold.operators.nodes import parse_pages
from arborfold.plans import selectors
from arborfold.sources import responses

DATA = "/root/testdata/sf0.001"


def nodes_of(spark, *pages):
    return parse_pages(spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "page_id long, html string"))


def naive(rows, selector):
    """Right-to-left matching on one page's rows."""
    kids = {}
    for r in rows:
        kids.setdefault(r.parent_id, []).append(r)

    def own(r, c):
        attr = dict(reversed(r.attrs))
        tests = {"": lambda a, v: True, "=": str.__eq__, "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"), "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}
        if c.tag not in (None, r.tag) or c.id is not None and attr.get("id") != c.id or not set(c.classes) <= set(attr.get("class", "").split()):
            return False
        if not all(n in attr and tests[op](attr[n], v) for n, op, v in c.attrs):
            return False
        for name, arg in c.pseudos:
            below = kids.get(r.node_id, [])
            ok = {"first-child": r.elem_ord == 1, "last-child": r.elem_ord == r.elem_total, "only-child": r.elem_total == 1, "empty": not any(k.kind == "element" or k.kind == "text" and k.text.strip() for k in below)}.get(name)
            if name == "nth-child":
                ok = any(arg[0] * n + arg[1] == r.elem_ord for n in range(100))
            elif name == "not":
                ok = not own(r, arg)
            if not ok:
                return False
        return True

    def fits(r, s, k):
        if not own(r, s.compounds[k]):
            return False
        if k == 0:
            return True
        comb, parent = s.combinators[k - 1], rows[r.parent_id] if r.parent_id else None
        before = [x for x in kids[r.parent_id] if x.kind == "element" and x.elem_ord < r.elem_ord]
        if comb == ">":
            return bool(parent) and fits(parent, s, k - 1)
        if comb == "+":
            return bool(before) and fits(before[-1], s, k - 1)
        if comb == "~":
            return any(fits(x, s, k - 1) for x in before)
        while parent:
            if fits(parent, s, k - 1):
                return True
            parent = rows[parent.parent_id] if parent.parent_id else None
        return False

    return {r.node_id for r in rows if r.kind == "element" and any(fits(r, s, len(s.compounds) - 1) for s in css.parse(selector))}


def test_selectors_against_naive_matching(spark):
    rng = random.Random(5)

    def page(depth=0):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "span", "b", "section"])
            attrs = rng.choice(["", " class='x'", " class='y x'", " id=a", " lang=es-AR", " href='/to'"])
            out += f"<{tag}{attrs}>{page(depth + 1) if depth < 3 and rng.random() < 0.7 else rng.choice(['', 't', ' '])}</{tag}>"
        return out

    pages = [page() for _ in range(12)]
    nodes = nodes_of(spark, *pages).cache()
    for s in ("div", "*", ".x", "#a b", "div > span", "div span", "span + b", "div ~ section", ":first-child", "b:last-child", ":only-child", ":nth-child(2n+1)", ":nth-child(-n+2)", ":empty", "div:not(.x)", "[lang|=es]", "[class~=y]", "[href$=to], .x > b", "div > .x + span b"):
        got = {(r.page_id, r.node_id) for r in selectors.select(nodes, s).select("page_id", "node_id").collect()}
        assert got == {(k, n) for k, p in enumerate(pages) for n in naive(parse(p), s)}, s


FORM = "<form action='/go?old=1#f'><input name=u value=x><input type=checkbox name=c><input type=checkbox name=ok checked><textarea name=n>he llo</textarea><select name=s><option value=1>one<option selected>two</select><input type=submit name=b><input name=d disabled></form><a href='x y'>l</a><button>b</button>"


def one_page(spark, html, url="https://h/p"):
    return spark.createDataFrame([(0, url, html)], "page_id long, url string, html string")


def test_forms_and_clicks(spark):
    df = one_page(spark, FORM)
    assert [(r["name"], r["value"]) for r in pages.form_fields(df).orderBy("seq").collect()] == [("u", "x"), ("ok", "on"), ("n", "he llo"), ("s", "two")]
    assert pages.submit_requests(df).first()["url"] == "https://h/go?u=x&ok=on&n=he+llo&s=two#f"
    sent = pages.submit_requests(df, "form", [("u", "~é"), ("z", "1")]).first()
    assert (sent["method"], sent["url"], sent["body"]) == ("GET", "https://h/go?u=%7E%C3%A9&ok=on&n=he+llo&s=two&z=1#f", None)
    assert pages.submit_requests(df, "a").count() == 0
    clicks = {r["ref"]: (r["action"], r["url"]) for r in pages.click_requests(df).collect()}
    assert clicks[8] == ("link", "https://h/x%20y") and clicks[6][0] == "submit" and clicks[9] == ("unsupported", None)
    multi = pages.submit_requests(one_page(spark, "<form enctype='multipart/form-data' method=post>")).first()
    assert multi["error"] == "unsupported: multipart/form-data" and multi["url"] is None


def test_fill_pages_and_nodes(spark):
    page = Page(FORM, "https://h/p")
    for ref, value in ((1, "new"), (2, "on"), (3, "off")):
        page.fill(ref, value)
    assert page.form_fields(page.find_form()) == [("u", "new"), ("c", "on"), ("n", "he llo"), ("s", "two")]
    values = spark.createDataFrame([(0, 1, "new"), (0, 2, "on"), (0, 3, "off")], "page_id long, ref int, value string")
    filled = {r["ref"]: dict(map(tuple, r["attrs"])) for r in controls.fill(parse_pages(one_page(spark, FORM)), values).where("ref <= 3").collect()}
    assert filled[1]["value"] == "new" and "checked" in filled[2] and "checked" not in filled[3]


def test_json_blocks_and_scripts(spark):
    html = "<script id=__NEXT_DATA__ type='application/json'>{\"a\":  1}</script><script src=a.js></script><script src=a.js></script><script>run()</script><script type=text/x>no</script><script src='ftp://x/y'></script><script type='application/json'>{</script>"
    df = one_page(spark, html)
    assert [(r["selector"], r["raw"]) for r in pages.json_blocks(df).collect()] == [("script#__NEXT_DATA__", '{"a": 1}'), ('script[type="application/json"]', "{")]
    assert [r["line"].split("\n")[1][:6] for r in pages.json_lines(df, "a").orderBy("seq").collect()] == ["1", "(parse"]
    got = spark.createDataFrame([("https://h/a.js", "A()")], "url string, body string")
    assert [(r["src"], r["body"]) for r in pages.script_sources(df, got).orderBy("seq").collect()] == [("https://h/a.js", "A()"), (None, "run()")]
    assert [tuple(r)[1:5] for r in pages.fetch_calls(one_page(spark, "<script>fetch('/x'); fetch(\"y\", {method: 'put', body: 'a\"'})</script>")).collect()] == [(0, "GET", "https://h/x", ""), (1, "PUT", "https://h/y", 'a"')]


def test_edits_and_serializer(spark):
    df = one_page(spark, "<div class=a><p>1 &lt; 2<br>x</p><!--c--><p>3</p></div>")
    assert pages.serialize(df).first()["html"] == '<div class="a"><p>1 &lt; 2<br>x</p><!--c--><p>3</p></div>'
    assert [r["html"] for r in pages.serialize(df, "p", inner=True).collect()] == ["1 &lt; 2<br>x", "3"]
    edits = [("set", "p", "id", 'a"&'), ("unset", "div", "class"), ("text", "p:first-child", "t<"), ("append", "div", "<i>new</i>"), ("before", "i", "<hr>"), ("wrap", "i", "b"), ("remove", "p:last-child"), ("html", "b", "<u>z</u>")]
    out = pages.edit(df, edits).first()
    assert out["html"] == '<div><p id="a&quot;&amp;">t&lt;</p><!--c--><p id="a&quot;&amp;">3</p><hr><b><u>z</u></b></div>' and out["edited"] == 8
    root = tree.from_rows(parse("<ul><li>1<li>2</ul>"))[0]
    ul = root.children[0]
    first, second = ul.children
    ul.insert(second, first)
    assert root.outer_html() == "<ul><li>2</li><li>1</li></ul>" and first.parent is ul and ul.holds(first) and not first.holds(ul)
    copy = ul.clone()
    ul.clear()
    assert copy.outer_html() == "<ul><li>2</li><li>1</li></ul>" and copy.parent is None and root.outer_html() == "<ul></ul>"
    with pytest.raises(ValueError, match="below itself"):
        copy.children[0].insert(copy)


def test_walker(spark):
    page = Page("<ul><li>a<b>x</b><li>c</ul><!--n--><nav><li>no</nav>")
    shown = [r.tag or r.kind for r in pages.walk(page, 5, lambda r: pages.REJECT if r.tag == "nav" else pages.SKIP if r.tag == "b" else pages.ACCEPT)]
    assert shown == ["ul", "li", "text", "text", "li", "text"]
    with pytest.raises(ValueError, match="verdict"):
        list(pages.walk(page, 1, lambda r: 9))
    rows = pages.walked(one_page(spark, "<p>1<p>2"), mask=1).orderBy("node_id").collect()
    assert [(r["previous_id"], r["next_id"]) for r in rows] == [(None, rows[1]["node_id"]), (rows[0]["node_id"], None)]


def test_plans_parse_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = one_page(spark, FORM)
    assert plan(pages.count(df, "html body form > input ~ select option")).count("MapInArrow") == 1
    assert "Exchange" not in plan(pages.select(df, "form a, form input", text=True))
    stored = plan(selectors.select(parse_pages(df), "html body form > input ~ select option"))
    assert stored.count("Exchange hashpartitioning") == 1 and stored.count("MapInArrow") == 2  # the parse and the match


def test_back_references(spark):
    from pyspark.sql import functions as F

    cases = [(r"(a)\1b", "ab", False), (r"(a)\1b", "aab", True), (r"(a)?\1b", "b", True), (r"^(?:(x)|y)\1z$", "yz", True), (r"^(?:(x)|y)\1z$", "xz", False), (r"^(a)(b)\2\1$", "abba", True), (r"^\1(a)$", "a", True)]
    df = spark.createDataFrame([(0,)], "i int").select(*(F.regexp_like(F.lit(t), F.lit(regexes.to_java(p))).alias(str(k)) for k, (p, t, _) in enumerate(cases)))
    assert list(df.first()) == [want for _, _, want in cases]
    assert regexes.group_numbers(r"(a)(b)\1(c)") == [1, 3, 4]


def test_cookies(spark):
    rows = [("p", 1, "https://a.example.com/x/y", "s=1; Secure"), ("p", 2, "https://a.example.com/x/y", "d=2; Domain=.Example.com; Path=/"), ("p", 3, "https://evil.com/", "v=1; Domain=victim.com"), ("p", 4, "https://a.example.com/x/y", "s=3%; secure"), ("p", 5, "https://a.example.com/", "h=4; HttpOnly; Path=/x")]
    jar = cookies.store(spark.createDataFrame(rows, "profile string, seq long, url string, header string")).cache()
    assert {(r["name"], r["value"], r["domain"], r["path"]) for r in jar.collect()} == {("s", "3%", "a.example.com", "/x"), ("d", "2", "example.com", "/"), ("h", "4", "a.example.com", "/x")}
    asked = [(1, "p", "https://a.example.com/x/z"), (2, "p", "http://a.example.com/x"), (3, "p", "https://b.example.com/x"), (4, "p", "https://badexample.com/")]
    asked = spark.createDataFrame(asked, "request_id long, profile string, url string")
    assert {r["request_id"]: r["header"] for r in cookies.header_for(asked, jar).collect()} == {1: "d=2; s=3%; h=4", 2: "d=2; h=4", 3: "d=2", 4: None}
    assert {r["request_id"]: r["header"] for r in cookies.header_for(asked, jar, script=True).collect()}[1] == "d=2; s=3%"
    back = cookies.from_lines(cookies.to_lines(jar)).select(*jar.columns)
    assert back.exceptAll(jar).count() == 0 and jar.exceptAll(back).count() == 0


def test_redirects(spark):
    hops = [("http://h/a", 302, "b"), ("http://h/b", 307, "/c"), ("http://h/l", 301, "l"), ("http://h/n", 303, None)]
    hops = spark.createDataFrame(hops, "url string, status int, location string")
    asked = spark.createDataFrame([(1, "POST", "http://h/a"), (2, "POST", "http://h/b"), (3, "GET", "http://h/l"), (4, "GET", "http://h/n"), (5, "GET", "http://h/z")], "request_id long, method string, url string")
    got = {r["request_id"]: (r["method"], r["url"], r["hops"], r["error"]) for r in responses.follow(asked, hops).collect()}
    assert got[1] == ("GET", "http://h/c", 2, None) and got[2] == ("POST", "http://h/c", 1, None) and got[5] == ("GET", "http://h/z", 0, None)
    assert got[3][3] == "too many redirects" and got[4][3] == "protocol"


def test_redirects_beyond_a_million_rows(spark):
    from pyspark.sql import functions as F

    asked = spark.range(1_100_000).select(F.col("id").alias("request_id"), F.lit("POST").alias("method"), F.concat(F.lit("http://h/"), "id").alias("url"))
    hops = spark.createDataFrame([("http://h/7", 301, "8"), ("http://h/8", 302, "//o/9")], "url string, status int, location string")
    end = responses.follow(asked, hops)
    assert end.count() == 1_100_000
    assert [tuple(r)[1:] for r in end.where("request_id = 7").collect()] == [("GET", "http://o/9", 2, True, None)]


def test_send(spark):
    ok = "array<struct<name: string, value: string>>"
    got = spark.createDataFrame([("GET", "http://h/a", None, 200, [("x", "1")], "A"), ("POST", "http://o/b", "k=1", 201, [], "B")], f"method string, url string, form string, status int, headers {ok}, body string")
    hops = spark.createDataFrame([("http://h/r", 307, "http://o/b"), ("http://h/t", 303, "/a")], "url string, status int, location string")
    asked = [(1, "get", "http://h/a#x", [("Cookie", "c")], None), (2, "post", "http://h/r", [("Authorization", "s"), ("X", "y")], "k=1"), (3, "post", "http://h/t", None, "k=1"), (4, "get", "http://h/none", None, None)]
    asked = spark.createDataFrame(asked, f"request_id long, method string, url string, headers {ok}, body string")
    out = {r["request_id"]: r for r in responses.send(asked, got, hops).collect()}
    assert out[1]["body"] == "A" and [h["name"] for h in out[1]["sent"]] == ["Cookie"]
    assert (out[2]["status"], out[2]["hops"], [h["name"] for h in out[2]["sent"]]) == (201, 1, ["X"])
    assert (out[3]["method"], out[3]["body"], out[3]["sent_body"]) == ("GET", "A", "") and out[4]["error"] == "not found"


def test_charset_of_responses(spark):
    rows = [([("content-type", "text/html; charset=latin1")], b"caf\xe9"), ([], "é".encode())]
    df = spark.createDataFrame(rows, "headers array<struct<name string, value string>>, body binary")
    assert {r["text"] for r in responses.texts(df).collect()} == {"café", "é"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(df, sql, con):
    cols = sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    names = [d[0] for d in con.execute(sql).description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in con.execute(sql).fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLE_SQL:
        same(df, registry.ORACLE_SQL[name], duck)
    else:
        df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
