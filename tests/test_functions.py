import gzip
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborfold.functions import bytes as by
from arborfold.functions import css, json_text, text, url
from arborfold.functions.entities import decode
from arborfold.functions.html import parse
from arborfold.functions.regexes import RegexError, to_java
from arborfold.functions.snapshot import snapshot, truncate
from arborfold.sources.responses import parse_headers


@pytest.mark.parametrize(
    ("text", "want"),
    [("a &amp; b", "a & b"), ("&ampx", "&x"), ("&AMP;", "&AMP;"), ("&#65;&#x42;", "AB"), ("&#65 x", "A x"), ("&#150;", "–"), ("&#0;", "�"), ("&#xD800;", "�"), ("&#99999999999;", "&#99999999999;"), ("&eacute;&Omega;", "éΩ"), ("&eacute", "&eacute"), ("& &;", "& &;"), ("&copyright", "©right")],
)
def test_entities(text, want):
    assert decode(text) == want


def tree(html):
    return [(r.node_id, r.parent_id, r.tag or r.kind, r.text) for r in parse(html)[1:]]


def test_parser_rules():
    assert tree("<P>a<p>b") == [(1, 0, "p", None), (2, 1, "text", "a"), (3, 0, "p", None), (4, 3, "text", "b")]
    assert [t[2] for t in tree("<ul><li>a<ul><li>b</ul>")] == ["ul", "li", "text", "ul", "li", "text"]
    assert tree("<ul><li><ul><li>")[3][1] == 1  # the inner item ends the outer one, list included
    assert tree("<script>var t='</p>';</script>x")[1][3] == "var t='</p>';"
    assert tree("<title>a &amp; b</title>")[1][3] == "a & b"
    assert tree("a<3") == [(1, 0, "text", "a<3")]
    assert tree("<!-- x") == [(1, 0, "comment", " x")]
    assert parse("<a HREF=/x y='1' z>")[1].attrs == [("HREF", ""), ("x", ""), ("y", "1"), ("z", "")]
    assert [t[2] for t in tree("<br/><div/>x")] == ["br", "div", "text"]
    assert parse("") == parse("   ")


@given(st.text(alphabet="<>/ab p!-=\"'&;", max_size=60))
@settings(max_examples=150, deadline=None)
def test_parser_keeps_document_order(html):
    rows = parse(html)
    for r in rows[1:]:
        assert r.parent_id < r.node_id < rows[r.parent_id].subtree_end
        assert r.subtree_end <= rows[r.parent_id].subtree_end


def test_css_reads_and_refuses():
    s = css.parse("div > p.x:not(.y) + a[href^='/t'], li:nth-child(2n+1)")
    assert s[0].combinators == [">", "+"] and s[0].compounds[2].attrs == [("href", "^=", "/t")]
    assert s[1].compounds[0].pseudos == [("nth-child", (2, 1))]
    for bad in ("", "[", "a >", "a:has(b)", "a[b!=c]", "a,,b"):
        with pytest.raises(css.CssError):
            css.parse(bad)


def test_urls():
    u = url.parse(" HTTP://User:pw@Shop.EXAMPLE.org:9090/x/./y/../z;k=1?q=a b#top ")
    assert (u.scheme, u.host, u.port, u.path, u.query, u.fragment) == ("http", "shop.example.org", 9090, "/x/z;k=1", "q=a%20b", "top")
    assert url.parse("wss://live.example.org").path == "/" and url.parse("https://[fe80::2]:444/").host_header == "[fe80::2]:444"
    base = url.parse("http://shop.example.org:81/list/items?page=3")
    wanted = {"4": "http://shop.example.org:81/list/4", "../up": "http://shop.example.org:81/up", "//cdn.example.net": "http://cdn.example.net/", "#end": "http://shop.example.org:81/list/items?page=3#end", "?page=4": "http://shop.example.org:81/list/items?page=4", "mailto:me@x.org": "mailto:me@x.org", "straße": "http://shop.example.org:81/list/stra%C3%9Fe"}
    assert {rel: str(url.join(base, rel)) for rel in wanted} == wanted
    for bad, why in {" ": "Empty", "shop.example.org": "MissingScheme", "7up://x": "BadScheme", "https:///p": "MissingHost", "http://x:70000": "BadPort"}.items():
        with pytest.raises(url.UrlError, match=why):
            url.parse(bad)


def test_json():
    for text in ('{"z":1,"a":[true,null,"x\\n"]}', "[]", '"\U0001f600"', '{"a":1,"a":2}'):
        assert json_text.dump(json_text.parse(text)) == text
    v = json_text.parse('{"a":[{"b":1},2.5],"0":"k"}')
    assert json_text.get(v, "a.0.b") == 1 and json_text.get(v, "0") == "k" and json_text.get(v, "a.9") is json_text.MISSING
    assert json_text.parse('"\\ud83d\\ude00"') == "\U0001f600" and json_text.parse("[01]") == [1.0]
    for bad in ("1 2", "{", "[1,]", "nul", "[" * 300 + "]" * 300, '{"a" 1}'):
        with pytest.raises(json_text.JsonError):
            json_text.parse(bad)


def test_bytes():
    data = b"hello " * 50
    assert by.gzip_decode(gzip.compress(data)) == data == by.zlib_decode(zlib.compress(data)) == by.zlib_decode(zlib.compress(data)[2:-4])
    for bad in (b"", gzip.compress(data)[:-9], gzip.compress(data)[:20] + b"x" * 30):
        with pytest.raises(ValueError, match=None):
            by.gzip_decode(bad)
    with pytest.raises(ValueError, match="too large"):
        by.zlib_decode(zlib.compress(data), 10)
    assert by.dechunk(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert zlib.adler32(b"123456789") == 0x091E01DE
    assert by.decode(b"caf\xe9 \x80\x81", "windows-1252") == "café €\x81"
    assert by.detect(b"<meta charset=latin1>") == "windows-1252" and by.detect(b"<meta charset=latin1>", "utf-8") == "utf-8"
    assert by.charset_of('text/html; charset="UTF-8"; x') == "UTF-8"
    assert by.decode("aé".encode("utf-16le") + b"x", "utf-16le") == "aé"


def test_snapshot():
    page = "<title>Seed list</title><main><h2>Beans <small>(dry)</small></h2><ul><li><a href='/b/1'>Borlotti</a><li>none</ul><form><input type=submit value=Buy></form></main>"
    assert snapshot(page).split("\n") == ["page 'Seed list'", "  - heading 'Beans (dry)'", "  - list", "    - link #1 'Borlotti' -> /b/1", "    - listitem 'none'", "  - form", "    - button #2 [type=submit] [value=Buy]", ""]
    assert snapshot("<section>" * 40 + "deep") == "page\n  'deep'\n"
    assert snapshot("<template><a href=x>n</a></template><textarea name=note title=t></textarea>") == "page\n  - textbox #1 [name=note] [title=t]\n"
    assert truncate("ü" * 70, 121) == "ü" * 60


def test_framing_and_checksums(spark):
    from pyspark.sql import functions as F

    assert by.frame(204, [("Content-Length", "3")], b"abc") == b"" and by.frame(200, [("Content-Length", "2")], b"abc") == b"ab" and by.frame(200, [], b"abc") == b"abc"
    assert by.frame(200, [("transfer-encoding", "Chunked"), ("Content-Length", "1")], b"2\r\nab\r\n0\r\n\r\n") == b"ab" and by.frame(200, [("Content-Length", "9")], b"abc") == b"abc"
    head = [("Content-Encoding", "gzip")]
    df = spark.createDataFrame([(200, head, gzip.compress(b"hello"), b"123456789"), (200, head, b"bad", None)], "status int, headers array<struct<name string, value string>>, raw binary, data binary")
    rows = df.select(by.response_body("status", "headers", "raw").alias("b"), by.adler32("data").alias("a"), F.crc32("data").alias("c")).collect()
    assert [(r["b"] and bytes(r["b"]), r["a"], r["c"]) for r in rows] == [(b"hello", 0x091E01DE, 0xCBF43926), (None, None, None)]
    lines = spark.createDataFrame([("A: 1\r\nset-cookie: x=1\nSet-Cookie: y:2\nno",)], "h string").select(parse_headers("h").alias("h")).first()["h"]
    assert [tuple(h) for h in lines] == [("a", "1"), ("set-cookie", "x=1"), ("set-cookie", "y:2")]


def test_text_forms(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("b  a\tb", "Color:red;--My-Var: 1; background-color : blue", "https://h:8443/p?q#f", 1536)], "k string, s string, u string, n int")
    pairs = text.style_pairs(F.col("s"))
    found = one.select(
        text.class_add(F.col("k"), "c", "a").alias("add"), text.class_toggle(F.col("k"), "b").alias("off"), text.class_toggle(F.col("k"), "b", True).alias("on"), text.class_replace(F.col("k"), "b", "z").alias("swap"),
        text.class_contains(F.col("k"), "a").alias("has"), text.style_text(text.style_set(pairs, "color", "green")).alias("style"), text.camel(F.lit("background-color")).alias("camel"),
        text.kebab(F.lit("backgroundColor")).alias("kebab"), text.location(url.url_parts("u"))["host"].alias("host"), text.format_bytes(F.col("n")).alias("size"), text.format_ms(F.lit(2500)).alias("ms"), text.request_target(url.url_parts("u")).alias("target"),
        url.same_origin(url.url_parts("u"), url.url_parts(F.lit("https://h/x"))).alias("same"), json_text.json_normal(F.lit('{"b": 1.0, "a" : 2e3}')).alias("json"),
    ).first()
    assert found.asDict() == {
        "add": "b a c", "off": "a", "on": "b a", "swap": "z a", "has": True, "style": "color: green; --My-Var: 1; background-color: blue;", "camel": "backgroundColor",
        "kebab": "background-color", "host": "h:8443", "size": "1.5 KB", "ms": "2500ms", "target": "/p?q", "same": False, "json": '{"b":1,"a":2000}',
    }
    with pytest.raises(ValueError, match="token"):
        text.class_add(F.col("k"), "a b")


@pytest.mark.parametrize(("pattern", "flags", "text", "want"), [("a$", "", "a\n", False), (".", "", "\x85", True), (r"\bé", "", "é", False), ("É", "i", "é", True), ("[]", "", "a", False), ("[^]", "", "\n", True), ("a{", "", "a{", True), ("^b", "m", "a\nb", True), (r"[\d-x]", "", "-", True), (r"(a)?\1b", "", "b", True), (r"\s", "", "\xa0", False)])
def test_regex_rewrite(spark, pattern, flags, text, want):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_like("t", F.lit(to_java(pattern, flags))).alias("m")).first()
    assert row["m"] is want


def test_regex_refuses():
    for bad in ("(", ")", "(?<n>a)", "[a", "\\"):
        with pytest.raises(RegexError):
            to_java(bad)
    with pytest.raises(RegexError):
        to_java("a", "x")
