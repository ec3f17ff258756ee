"""More of the engine's queries: scripts, patterns, SQL functions, files, streams and forms of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .functions import patterns, sql, text
from .functions.bytes import decode_auto, response_body
from .functions.regexes import to_java
from .functions.snapshot import page_snapshot
from .functions.url import same_origin, url_join, url_parts
from .operators import cookies, metrics, pages, scripts
from .operators.nodes import dom_nodes, navigate
from .plans import selectors
from .registry import query, spread, table
from .sources import files, responses, store
from .streaming import sessions

# Scripts ------------------------------------------------------------------------------------------------------------

_SCRIPT = "regexp_extract(html, '<script>(.*?)</script>', 1)"


@query(f"SELECT page_id, 11::BIGINT AS tokens, replace({_SCRIPT}, ' ', '') AS text FROM pages")
def script_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every page's script: their number, the end among them, and their texts put together again."""
    found = pages.script_tokens(table(spark, sf_dir, "pages")).groupBy("page_id", "script")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "")
    return found.agg(F.count("*").alias("tokens"), joined.alias("text")).select("page_id", "tokens", "text")


@query(f"SELECT page_id, 'track' AS name, regexp_extract({_SCRIPT}, 'track\\(([0-9]+)\\)', 1) AS argument FROM pages")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with a plain first argument, read off the relation of script trees by two joins."""
    nodes = store.materialise(pages.script_nodes(table(spark, sf_dir, "pages")).select("page_id", "script", "node", "parent", "part", "kind", "value"), "script-nodes")
    place = ["page_id", "script", "node"]
    called = nodes.where("kind = 'call'").select(*place)
    named = nodes.where("part = 'callee' AND kind = 'name'").select("page_id", "script", F.col("parent").alias("node"), F.col("value").alias("name"))
    given = nodes.where("part = 'argument' AND kind IN ('number', 'string')").groupBy("page_id", "script", F.col("parent").alias("node")).agg(F.min_by("value", "node").alias("argument"))
    return called.join(named, place).join(given, place).select("page_id", "name", "argument")


def _scripted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a customer whose script clicks a link, sends a form or posts back."""
    c = registry._customers(spark, sf_dir)
    start = """concat('<a id="l" href="../next/', c_custkey, '">n</a><a id="j" href="javascript:__doPostBack(\\'t', c_custkey, '\\', \\'\\')">p</a><form method="post" action="/go"><input name="seg" value="', c_mktsegment, '"></form><script>// document.links[1].click()\\n')"""
    what = """element_at(array('const el = document.getElementById("l"); el.click()', 'document.forms[0].submit()', 'if (1) { document.querySelector("#j").click() }', 'function later() { document.forms[0].submit() }'), CAST(c_custkey % 4 + 1 AS INT))"""
    return c.selectExpr("c_custkey AS page_id", "concat('https://shop.example/c/', c_custkey) AS url", f"concat({start}, {what}, '</script>') AS html")


@query("""SELECT c_custkey AS page_id, CASE c_custkey % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'submit' ELSE 'postback' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN c_custkey % 4 = 0 THEN 'https://shop.example/next/' || c_custkey ELSE 'https://shop.example/go' END AS url,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'seg=' || c_mktsegment ELSE 'seg=' || c_mktsegment || '&__EVENTTARGET=t' || c_custkey || '&__EVENTARGUMENT=' END AS body,
  CASE c_custkey % 4 WHEN 0 THEN '<p>next ' || c_custkey || '</p>' WHEN 1 THEN '<p>sent ' || c_mktsegment || '</p>' END AS html, CASE WHEN c_custkey % 4 = 2 THEN 'not found' END AS error FROM customer WHERE c_custkey % 4 < 3""")
def script_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one navigation each page's script asks for, followed by a join; scripts that only define functions ask for none."""
    c = table(spark, sf_dir, "customer")
    links = c.selectExpr("c_custkey AS page_id", "concat('https://shop.example/next/', c_custkey) AS url", "'GET' AS method", "'' AS form", "concat('<p>next ', c_custkey, '</p>') AS html")
    forms = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("page_id")).selectExpr("page_id", "'https://shop.example/go' AS url", "'POST' AS method", "concat('seg=', c_mktsegment) AS form", "concat('<p>sent ', c_mktsegment, '</p>') AS html")
    return pages.bridge(_scripted_pages(spark, sf_dir), links.unionByName(forms)).select("page_id", "kind", "method", "url", "body", "html", "error")


@query("""SELECT c_custkey AS page_id, unnest([0, 1, 3])::INTEGER AS seq, unnest(['https://shop.example/js/' || c_custkey % 10 || '.js', NULL, 'http://cdn.example/x.js']) AS src,
  unnest([CASE WHEN c_custkey % 10 < 7 THEN 'shared(' || c_custkey % 10 || ')' END, 'own(' || c_custkey || ')', NULL]) AS body FROM customer""")
def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages would run: scripts of other addresses by a join, each address once, and their own."""
    c = registry._customers(spark, sf_dir)
    html = """concat('<script src="../js/', c_custkey % 10, '.js"></script><script>own(', c_custkey, ')</script><script src="/js/', c_custkey % 10, '.js"></script><script src="http://cdn.example/x.js"></script><script type="text/plain">no()</script>')"""
    held = c.selectExpr("c_custkey % 10 AS k").distinct().where("k < 7").selectExpr("concat('https://shop.example/js/', k, '.js') AS url", "concat('shared(', k, ')') AS body")
    return pages.script_sources(c.selectExpr("c_custkey AS page_id", "concat('https://shop.example/c/', c_custkey) AS url", f"{html} AS html"), held)


@query("""SELECT c_custkey AS page_id, (CASE WHEN c_acctbal > 0 THEN 5 ELSE 4 END)::INTEGER AS writes, '<h1 class="on">' || c_name || ' &lt;' || c_mktsegment || '&gt;</h1>' || CASE WHEN c_acctbal > 0 THEN '' ELSE '<p id="p">low</p>' END || '<div id="d" title="n' || c_custkey || '"><b>' || c_mktsegment || '</b></div>' AS body FROM customer""")
def script_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after what their scripts plainly write: text, attributes, parsed HTML, a removed element."""
    html = """concat('<h1>old</h1><p id="p">low</p><div id="d">x</div><script>const h = document.querySelector("h1"), d = document.getElementById("d"); h.textContent = "', c_name, ' <" + "', c_mktsegment, '>"; h.className = "on"; d.innerHTML = "<b>', c_mktsegment, '</b>"; d.setAttribute("title", `n${', c_custkey, '}`); ',
      if(c_acctbal > 0, 'document.querySelector("#p").remove()', 'function later() { h.remove() }'), '</script>')"""
    done = pages.written(registry._customers(spark, sf_dir).selectExpr("c_custkey AS page_id", "'https://shop.example/' AS url", f"{html} AS html"))
    return done.select("page_id", "writes", F.substring_index("html", "<script>", 1).alias("body"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<li>'))::BIGINT - 1 AS followed, 'ul' AS holder, 1::BIGINT AS lists FROM pages""")
def node_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scripts would reach from stored nodes: items of the menu, those with a next element, what they stand in, lists whose last
    element is the menu's last item."""
    nav = navigate(dom_nodes(spark, sf_dir))
    items = nav.where("tag = 'li'").groupBy("page_id").agg(F.count("*").alias("items"), F.count("next_element").alias("followed"), F.max("parent_tag").alias("holder"), F.max("node_id").alias("last"))
    lists = nav.where("tag = 'ul'").select("page_id", "last_element")
    return items.join(lists, "page_id").where("last = last_element").groupBy("page_id", "items", "followed", "holder").agg(F.count("*").alias("lists"))


# Patterns, SQL functions, text --------------------------------------------------------------------------------------

_WORD_PAIR = "\\b([a-z]+)(ing|tion) ([a-z]{2,4})\\b"


@query(f"SELECT doc_id, regexp_replace(text, '{_WORD_PAIR.replace('\\\\', '\\')}', '\\3 \\1', 'g') AS text, nullif(regexp_extract(text, '{_WORD_PAIR}', 1), '') AS first FROM documents WHERE text IS NOT NULL")
def bounded_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a pattern replaced, and the first one's group, by the matcher that counts its steps."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    fuel, p = F.lit(100_000_000), F.lit(_WORD_PAIR)
    found = d.select("doc_id", patterns.regex_replace("text", p, F.lit("g"), F.lit("$3 $1"), fuel).alias("r"), patterns.regex_exec("text", p, F.lit(""), fuel).alias("m"))
    return found.select("doc_id", F.col("r.text").alias("text"), F.get("m.groups", F.lit(0)).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size % 25 >= 10 THEN 'out of fuel' END AS error FROM part")
def pattern_fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern whose steps double with each letter ends, in an error, once its fuel is burnt."""
    subject = F.concat(F.repeat(F.lit("a"), F.col("p_size") % 25), F.lit("!"))
    m = patterns.regex_exec(subject, F.lit("(a+)+$"), F.lit(""), F.lit(10_000))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return spread(parts, "p_partkey").select("p_partkey", m["error"].alias("error"))


@query("SELECT doc_id, string_split_regex(text, '[.!?]+ ')::VARCHAR[] AS parts FROM (SELECT doc_id, regexp_replace(text, '[.!?]+ $', '') || '' AS text FROM documents) WHERE text <> ''", "split_patterns")
def split_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences between marks, by the same matcher."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[.!?]+ \z", "").alias("text")).where("text <> ''")
    return d.select("doc_id", patterns.regex_split("text", F.lit("[.!?]+ "), F.lit("g"), F.lit(100_000_000))["parts"].alias("parts"))


def _view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal > 0 AS big FROM customer), f AS (SELECT c_custkey AS page_id, unnest(['id', 'big', 'seg', 't']) AS name, unnest([c_custkey::VARCHAR, CASE WHEN big THEN 'on' END, c_mktsegment, c_name]) AS value FROM c)
SELECT name, count(*) AS n, count(DISTINCT value) AS texts FROM f WHERE value IS NOT NULL GROUP BY name""")
def sql_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields in SQL: a table function beside each page, grouped."""
    sql.register(spark)
    _view(registry._form_pages(spark, sf_dir), "arborfold_form_pages")
    return spark.sql("SELECT f.name, count(*) AS n, count(DISTINCT f.value) AS texts FROM arborfold_form_pages p, LATERAL form_fields(p.html) f GROUP BY f.name")


@query("""SELECT event_id AS page_id, 0 AS seq, event_type AS value FROM events UNION ALL SELECT event_id, 1, NULL FROM events""")
def sql_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded JSON in SQL, with what stands at a path."""
    sql.register(spark)
    _view(registry._data_pages(spark, sf_dir), "arborfold_data_pages")
    return spark.sql("SELECT p.page_id, b.seq, get_json_object(b.raw, '$.e.type') AS value FROM arborfold_data_pages p, LATERAL json_blocks(p.html) b")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag")
def sql_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pages in SQL, by the table function that takes whole batches."""
    sql.register(spark)
    _view(table(spark, sf_dir, "pages"), "arborfold_pages")
    return spark.sql("SELECT tag, count(*) AS n FROM pages_nodes(TABLE(SELECT page_id, html FROM arborfold_pages)) WHERE kind = 'element' GROUP BY tag")


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024) ELSE format('{:.1f} MB', n / 1048576) END AS size, format('{:.0f}ms', n / 8) AS ms
FROM (SELECT o_orderkey, o_orderkey * 128 AS n FROM orders)""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes up to megabytes and times, ties among them."""
    n = F.col("o_orderkey") * 128
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes(n).alias("size"), text.format_ms(n / 8).alias("ms"))


@query("SELECT doc_id, base64(encode(text)) AS encoded, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as base64, and the number of bytes that come back."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.to_base64(F.col("text")).alias("encoded"))
    return d.select("doc_id", "encoded", F.octet_length(text.from_base64(F.col("encoded"))).cast("long").alias("bytes"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'none' ELSE 'block' END AS display, CASE o_orderstatus WHEN 'F' THEN 'Sans' WHEN 'O' THEN 'Mono' ELSE 'Arial' END AS family,
  CASE o_orderstatus WHEN 'P' THEN 'red' ELSE 'rgba(0, 0, 0, 0)' END AS background, '' AS absent, (CASE o_orderstatus WHEN 'F' THEN 12 ELSE 11 END)::INTEGER AS properties FROM orders""")
def computed_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for elements: their own declarations, without priorities, over the defaults."""
    own = F.when(F.col("o_orderstatus") == "O", "display: none !important; font-family: Mono").when(F.col("o_orderstatus") == "F", "font: 12px 'Sans' !IMPORTANT").otherwise("BACKGROUND-COLOR:red")
    style = text.computed_style(own)
    names = {"display": "display", "fontFamily": "family", "backgroundColor": "background", "float": "absent"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(text.style_value(style, k).alias(v) for k, v in names.items()), F.size(style).alias("properties"))


@query("SELECT count(*) AS pages, sum(strlen(html))::BIGINT AS bytes_in, sum(strlen(html) // 4)::BIGINT AS tokens_in, 0::BIGINT AS empty FROM pages")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a run of snapshots, observed while it is written, in the one pass it takes."""
    shots = table(spark, sf_dir, "pages").select("page_id", page_snapshot("html").alias("snapshot"), F.octet_length("html").alias("html_bytes"))
    watched, seen = metrics.snapshot_metrics(shots)
    watched.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.range(1).select(*(F.lit(got[k]).cast("long").alias(k) for k in ("pages", "bytes_in", "tokens_in", "empty")))


_DIALECT = [("boundary", r"\b[a-z]+(?:tion|ung|ción)\b", "i"), ("group", r"(\w+) (?:the|der|la|le) (\w)", ""), ("line", r"^[A-Z]\S*$", "m"), ("lazy", r"a.+?e{1,2}", "s"), ("end", r"[^\s.]+\.?$", ""), ("odd", r"[\d-x]{2,}|a{|\u0041b", "")]
_RE2 = {"boundary": "(?i)\\b[a-z]+(?:tion|ung|ción)\\b", "group": "([0-9A-Za-z_]+) (?:the|der|la|le) ([0-9A-Za-z_])", "line": "(?m)^[A-Z][^ \\t\\n\\r\\f\\v]*$", "lazy": "(?s)a.+?e{1,2}", "end": "[^ \\t\\n\\r\\f\\v.]+\\.?\\z", "odd": "[0-9\\-x]{2,}|a\\{|Ab"}


@query("SELECT doc_id, " + ", ".join(f"regexp_extract(text, '{p}') AS {k}" for k, p in _RE2.items()) + " FROM documents WHERE text IS NOT NULL")
def regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matches of patterns of the script dialect, rewritten for the JVM's engine, without a Python worker."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", *(F.regexp_extract("text", to_java(p, flags), 0).alias(k) for k, p, flags in _DIALECT))


def _little(n: Column, size: int) -> Column:
    """A number as ``size`` bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1))))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' WHEN 1 THEN substr(text, 1, 10) ELSE text END AS body, (CASE doc_id % 5 WHEN 3 THEN 2 ELSE 3 END)::INTEGER AS headers, 'a=1,b=2' AS cookies
FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)""")
def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses put together by turns as chunks, with a stated length, gzipped, without a body and in 16 bits, read back as text;
    headers of any case, some repeated."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F\\xA0-\\xFF]", "").alias("text"))
    data, size, k = F.col("text").cast("binary"), F.octet_length("text"), F.col("doc_id") % 5
    bytes_of = lambda t: F.lit(t).cast("binary")
    chunks = F.concat(F.lower(F.hex(size.cast("long"))).cast("binary"), bytes_of(";x=y\r\n"), data, bytes_of("\r\n0\r\nt: 1\r\n\r\n"))
    chunks = F.when(size == 0, bytes_of("0\r\n\r\n")).otherwise(chunks)
    most = 65_535  # bytes of a block that is stored as it is
    n = F.greatest(F.lit(1), F.ceil(size / most).cast("int"))
    length = lambda i: F.least(F.lit(most), size - i * most)
    block = lambda i: F.concat(F.when(i == n - 1, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), _little(length(i), 2), _little(most - length(i), 2), F.substring(data, i * most + 1, F.lit(most)))
    blocks = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), block), F.lit(b""), lambda a, b: F.concat(a, b))
    stored = F.concat(F.unhex(F.lit("1f8b0800000000000003")), blocks, _little(F.crc32(data), 4), _little(size, 4))
    raw = F.when(k == 0, chunks).when(k == 2, stored).when(k == 4, F.encode("text", "UTF-16LE")).otherwise(data)
    stated = F.octet_length(F.substring("text", 1, 10)).cast("string")
    head = F.when(k == 0, "Transfer-Encoding: Chunked").when(k == 1, F.concat(F.lit("Content-Length: "), stated)).when(k == 2, "CONTENT-ENCODING: gzip").when(k == 4, "Content-Type: text/plain; charset=UTF-16LE")
    lines = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Set-Cookie: a=1"), head, F.lit("set-cookie:b=2"))
    r = d.select("doc_id", F.when(k == 3, 204).otherwise(200).alias("status"), responses.parse_headers(lines).alias("headers"), raw.alias("raw"))
    body = decode_auto(response_body("status", "headers", "raw"), F.get(F.filter("headers", lambda h: h["name"] == "content-type"), F.lit(0))["value"])
    cookie = F.array_join(F.transform(F.filter("headers", lambda h: h["name"] == "set-cookie"), lambda h: h["value"]), ",")
    return r.select("doc_id", body.alias("body"), F.size("headers").alias("headers"), cookie.alias("cookies"))


_NL = "' || chr(10) || '"


@query(f"""SELECT c_custkey AS page_id, 'page ' || chr(39) || c_name || chr(39) || '{_NL}  - navigation{_NL}    - list{_NL}      - link #1 ' || chr(39) || 'Next' || chr(39) || ' -> /n' || c_custkey || '{_NL}  - heading ' || chr(39) || 'No ' || c_custkey || chr(39)
  || '{_NL}  - paragraph ' || chr(39) || substr(repeat(c_name, 10), 1, 120) || chr(39) || '{_NL}  - form [id=f]{_NL}    - textbox #2 [name=q] [placeholder=Find]{_NL}    - checkbox #3 [type=checkbox]{_NL}    - combobox #4 [name=s]{_NL}      - option ' || chr(39) || c_mktsegment || chr(39)
  || '{_NL}  - table{_NL}    - cell ' || chr(39) || c_custkey || chr(39) || '{_NL}    - image -> /i.png [alt=pic]{_NL}' AS snapshot, 4::BIGINT AS actions FROM customer""")
def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole snapshots of pages with every kind of line: title, wrappers that vanish, long text, controls, images, skipped parts."""
    c = registry._customers(spark, sf_dir)
    html = """concat('<html><head><title>', c_name, '</title><style>p {}</style></head><body><nav><ul><li><a href="/n', c_custkey, '">Next</a></ul></nav><div><h2>No <b>', c_custkey, '</b></h2><section><p>', repeat(c_name, 10), '</p></section></div><form id="f"><input name="q" placeholder="Find"><input type="checkbox"',
      if(c_acctbal > 0, ' checked', ''), '><select name="s"><option>', c_mktsegment, '</select></form><table><tr><td>', c_custkey, '<td><img alt="pic" src="/i.png"></table><noscript>no</noscript><!-- c -->')"""
    shots = c.select(F.col("c_custkey").alias("page_id"), page_snapshot(F.expr(html)).alias("snapshot"))
    return shots.withColumn("actions", F.size(F.regexp_extract_all("snapshot", F.lit("- [a-z-]+ (#[0-9]+)"), 1)).cast("long"))


_JOINS = [("../x", "http://h.example/a/x"), ("./y?z=1", "http://h.example/a/b{}/y?z=1"), ("//user@h2.example:8443/p", "http://h2.example:8443/p"), ("?q=2", "http://h.example/a/b{}/c?q=2"), ("#f", "http://h.example/a/b{}/c?d#f"),
  ("https://H.example:443", "https://h.example:443/"), ("", "http://h.example/a/b{}/c?d"), ("/r/../s//t/.", "http://h.example/s//t/"), ("g;x=1/../y", "http://h.example/a/b{}/y"), ("../../../up", "http://h.example/up"), ("http://[::1]:80/z", "http://[::1]:80/z")]


@query(f"""WITH j AS (SELECT event_id, replace([{", ".join(f"'{t}'" for _, t in _JOINS)}][event_id % {len(_JOINS)} + 1], '{{}}', event_id::VARCHAR) AS url FROM events)
SELECT event_id, url, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), ':(80|443)$', '') AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS target, regexp_matches(url, '^http://h[.]example/') AS same FROM j""")
def url_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every form resolved against a base, with what a request would name and whether the origin is the same."""
    refs = F.array(*(F.lit(r) for r, _ in _JOINS))
    base = F.concat(F.lit("HTTP://h.example/a/b"), F.col("event_id").cast("string"), F.lit("/c?d#e"))
    e = spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", base.alias("base"), F.get(refs, (F.col("event_id") % len(_JOINS)).cast("int")).alias("ref"))
    e = e.select("event_id", url_parts("base").alias("b"), url_join("base", "ref").alias("u"))
    return e.select("event_id", F.col("u.href").alias("url"), text.authority(F.col("u")).alias("host"), text.request_target(F.col("u")).alias("target"), same_origin(F.col("b"), F.col("u")).alias("same"))


@query("""SELECT c_custkey::VARCHAR AS tab, unnest([1, 2, 3, 4, 5])::INTEGER AS line, unnest(['extract', 'submit', 'expect', 'dom', 'click']) AS op, unnest(['textarea', '-f #f -d who=' || c_name, 'thanks ' || c_name, '', '#9']) AS arg,
  unnest(['200', '200', '200', '200', '200']) AS status, unnest(['true', 'true', 'true', 'true', 'false']) AS ok FROM customer""")
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's audit as JSON lines, read back; times are left out, as they are the clock's."""
    lines = scripts.audit_lines(registry._script(spark, sf_dir))
    return lines.select("tab", F.col("seq").alias("line"), *(F.get_json_object("line", f"$.{k}").alias(k) for k in ("op", "arg", "status", "ok")))


@query("SELECT page_id, least(1, len(regexp_extract_all(html, '<li>')))::BIGINT AS first, len(regexp_extract_all(html, '<li>'))::BIGINT AS linked FROM pages")
def node_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored nodes match a selector, and which stand within a hit of another."""
    nodes = store.materialise(dom_nodes(spark, sf_dir), "nodes")
    items = nodes.where("tag = 'li'")
    first = selectors.matched(nodes, items, "nav li:first-child").groupBy("page_id").agg(F.count("*").alias("first"))
    linked = selectors.within(selectors.select(nodes, "a"), selectors.select(nodes, "li")).groupBy("page_id").agg(F.count("*").alias("linked"))
    return first.join(linked, "page_id")


# Cookies, files, streams --------------------------------------------------------------------------------------------

_SITES = ["https://a.example.com/x/y", "http://b.example.com/x", "https://example.com/", "https://other.org/p/q"]


def _varied_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set-Cookie headers of events from four hosts: by turns for the host alone, its parent domain, another's domain, a path."""
    e = table(spark, sf_dir, "events").withColumn("k", (F.col("event_id") % 4).cast("int")).withColumn("d", F.floor(F.col("event_id") / 4) % 4)
    at = F.get(F.array(*map(F.lit, _SITES)), F.col("k"))
    more = F.when(F.col("d") == 0, "").when(F.col("d") == 1, "; Domain=.Example.com; Path=/").when(F.col("d") == 2, "; Domain=elsewhere.net").otherwise("; Path=/x; Secure; HttpOnly")
    return e.select(F.col("user_id").alias("profile"), F.col("event_id").alias("seq"), at.alias("url"), F.concat("event_type", F.lit("="), F.col("event_id").cast("string"), more).alias("header"))


_VARIED_SQL = """
h AS (SELECT user_id AS profile, event_id AS seq, event_type AS name, event_id::VARCHAR AS value, event_id % 4 AS k, event_id // 4 % 4 AS d FROM events),
w AS (SELECT *, ['a.example.com', 'b.example.com', 'example.com', 'other.org'][k + 1] AS host, ['/x', '/', '/', '/p'][k + 1] AS fallback FROM h WHERE d <> 2 AND NOT (d = 1 AND k = 3)),
c AS (SELECT profile, seq, name, value, CASE WHEN d = 1 THEN 'example.com' ELSE host END AS domain, CASE d WHEN 1 THEN '/' WHEN 3 THEN '/x' ELSE fallback END AS path, d = 3 AS secure, d <> 1 AS host_only, d = 3 AS http_only FROM w),
jar AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY profile, name, domain, path ORDER BY seq DESC) = 1)"""


@query(f"WITH {_VARIED_SQL} SELECT profile, name, value, domain, path, secure, host_only, http_only FROM jar")
def cookie_jars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jars of all users from four hosts, with domains, paths and headers that are refused."""
    return cookies.store(_varied_cookies(spark, sf_dir)).drop("seq")


@query(f"""WITH {_VARIED_SQL}, r AS (SELECT DISTINCT user_id AS profile, k FROM events, unnest([0, 1, 2, 3]) AS s(k)),
u AS (SELECT *, ['a.example.com', 'b.example.com', 'example.com', 'other.org'][k + 1] AS host, ['/x/y', '/x', '/', '/p/q'][k + 1] AS p, k <> 1 AS tls FROM r)
SELECT u.profile * 4 + k AS request_id, string_agg(name || '=' || value, '; ' ORDER BY seq) AS header FROM u LEFT JOIN jar ON jar.profile = u.profile
  AND (CASE WHEN host_only THEN host = domain ELSE host = domain OR ends_with(host, '.' || domain) END) AND (p = path OR starts_with(p, CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END)) AND (tls OR NOT secure) GROUP BY ALL""")
def cookie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Cookie headers of each user's requests to all four hosts."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    asked = users.select(F.col("user_id").alias("profile"), F.posexplode(F.array(*map(F.lit, _SITES))).alias("k", "url")).withColumn("request_id", F.col("profile") * 4 + F.col("k"))
    return cookies.header_for(asked, cookies.store(_varied_cookies(spark, sf_dir)))


@query(f"WITH {_VARIED_SQL} SELECT profile::VARCHAR AS profile, name, value, domain, path, secure, host_only, http_only FROM jar")
def jar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same jars written as a file a user, each once, and read back by the source of such files."""
    jar = cookies.store(_varied_cookies(spark, sf_dir))
    path = store.new_path(spark, "jars")
    files.write(cookies.to_lines(jar.withColumn("profile", F.col("profile").cast("string"))).withColumnRenamed("profile", "name"), "jars", path)
    return cookies.from_lines(files.read(spark, "jars", path)).drop("seq")


@query(f"SELECT page_id::VARCHAR AS name, {_SCRIPT} || chr(10) AS body FROM pages")
def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scripts kept as files of their own and read back whole."""
    own = pages.script_sources(table(spark, sf_dir, "pages"), table(spark, sf_dir, "pages").select("url", F.col("html").alias("body")))
    path = store.new_path(spark, "script-files")
    files.write(own.select(F.col("page_id").cast("string").alias("name"), "seq", F.col("body").alias("line")), "script_files", path)
    return files.read(spark, "script_files", path)


@query(f"SELECT c_custkey::VARCHAR AS name, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 4 = 1 GROUP BY ALL")
def failed_jars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies that tabs leave behind, of tabs that fail too: each tab's jar is written once and read back."""
    c = table(spark, sf_dir, "customer")
    held = c.selectExpr("c_custkey AS page_id", "concat('https://shop.example/c/', c_custkey) AS url", "concat('<p>', c_custkey % 4, '</p>') AS html", "if(c_custkey % 4 = 3, CAST(array() AS ARRAY<STRING>), array('seen=1; Path=/')) AS cookies")
    ends = scripts.outcomes(scripts.parse("expect 0"), c.selectExpr("CAST(c_custkey AS STRING) AS tab", "concat('https://shop.example/c/', c_custkey) AS url"), held)
    path = store.new_path(spark, "tab-jars")
    files.write(files.jar_rows(ends), "jars", path)
    return files.read(spark, "jars", path).groupBy(F.col("profile").alias("name")).agg(F.count("*").alias("n"))


@query(registry.ORACLE_SQL["session_ops"])
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of ``session_ops`` as a stream: sessions are state, kept between micro-batches."""
    schema = table(spark, sf_dir, "customer").schema
    customers = spark.readStream.schema(schema).parquet(f"{sf_dir}/customer.parquet*")
    with sessions.stateful(spark):
        done = store.drained(sessions.run_stream(registry._session_ops(customers), registry._form_pages(spark, sf_dir)), "sessions")
    return registry._op_results(done)
