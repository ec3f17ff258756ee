import pytest
from pyspark.sql import functions as F

from arborfold.operators import scripts
from arborfold.streaming import events, sessions


def test_parse_and_substitute():
    steps = scripts.parse('# note\nfetch http://h/a\n\nexpect "two \\"words\\""\nclick #3\n')
    assert [(s.line, s.op, s.args) for s in steps] == [(2, "fetch", ("http://h/a",)), (4, "expect", ('two "words"',)), (5, "click", ("#3",))]
    for bad, line in (("jump x", 1), ("snap\nfetch", 2), ('expect "x', 1)):
        with pytest.raises(scripts.ScriptError, match=f"^{line}:"):
            scripts.parse(bad)
    assert scripts.substitute("$A ${B}c $$ $X", {"A": "1", "B": "2"}) == "1 2c $ $X"


def test_run_for_many_tabs(spark):
    pages = [(1, "http://h/", "<h1>Home</h1><a href='two'>go</a>"), (2, "http://h/two", "<p>second</p>")]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    tabs = spark.createDataFrame([("a", "http://h/"), ("b", "http://h/two"), ("c", "http://h/none")], "tab string, url string")
    steps = scripts.parse("extract h1\nclick #1\nexpect second\nsnap")
    got = {(r["tab"], r["line"]): (r["ok"], r["out"]) for r in scripts.run(steps, tabs, pages).collect()}
    assert got == {("a", 1): (True, "- h1 'Home'"), ("a", 2): (True, None), ("a", 3): (True, None), ("a", 4): (True, "page\n  - paragraph 'second'\n"), ("b", 1): (True, ""), ("b", 2): (False, None), ("c", 1): (False, None)}
    assert scripts.run(steps, tabs.limit(0), pages).count() == 0


SHOP = [
    (1, "http://h/", "GET", "", "<form id=f method=post action=go><input name=q><input type=checkbox name=all></form><script type='application/json'>{\"a\": {\"b\": [1, 2]}}</script>", ["s=1; Path=/", "h=2; HttpOnly"]),
    (2, "http://h/go", "POST", "q=red+hat&all=on&x=1", "<p>found</p><script>fetch('/api')</script>", ["s=9; Path=/"]),
    (3, "http://h/api", "PUT", "b", "raw", []),
]


def test_forms_jars_and_requests_in_scripts(spark):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, method string, form string, html string, cookies array<string>")
    text = "json a.b.1\nfill #1 \"$WHAT hat\"\nfill #2 on\nreq http://h/api -X put -d b\nsubmit -f #f -d x=1\nexpect found\nnet\ndom"
    hops = spark.createDataFrame([("http://h/start", 302, "/")], "url string, status int, location string")
    tabs = spark.createDataFrame([("a", "http://h/start", {"WHAT": "red"}), ("b", "http://h/", {"WHAT": "blue"})], "tab string, url string, vars map<string,string>")
    audit = scripts.run(scripts.parse(text), tabs, pages, hops)
    rows = {(r["tab"], r["line"]): r for r in audit.collect()}
    assert rows["a", 1]["out"] == '== script[type="application/json"]\n2' and rows["a", 2]["arg"] == "#1 red hat"
    assert rows["a", 4]["out"] == "== 200 http://h/api\nraw" and rows["a", 6]["ok"] and rows["a", 7]["out"] == "== GET http://h/api\nreplay: req http://h/api -X GET"
    assert rows["a", 8]["out"].endswith("cookies 2") and rows["a", 8]["status"] == 200
    assert not rows["b", 5]["ok"] and rows["b", 5]["error"] == "submit failed: not found" and ("b", 6) not in rows
    ends = {r["tab"]: r for r in scripts.outcomes(scripts.parse(text), tabs, pages, hops).collect()}
    assert ends["a"]["ok"] and '"value":"9"' in ends["a"]["jar"] and ends["a"]["url"] == "http://h/go" and ends["b"]["error"] == "line 5: submit failed: not found"
    line = scripts.audit_lines(audit.where("tab = 'a' AND line = 6")).first()["line"]
    assert line.startswith('{"line":6,"op":"expect","arg":"found","tab":"a","status":200,"ms":') and line.endswith('"ok":true}')
    one = scripts.run(scripts.parse("extract p\n" * 5), tabs, pages)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # five steps, one parse


OPS = [("s", 1, "open", '{"url": "http://h/"}'), ("s", 2, "fill", '{"ref": 1, "value": "red hat"}'), ("s", 3, "submit", '{"form": "#f", "data": {"all": "on"}}'), ("s", 4, "extract", '{"css": "input"}'), ("s", 5, "extract", "{}"), ("s", 6, "fly", "{}"), ("s", 7, "snap", "no json"), ("s", 8, "close", None), ("s", 9, "snap", "{}"), ("t", 1, "open", "{}"), ("t", 2, "snap", "{}"), ("t", 3, "net", "{}"), ("t", 4, "goto", '{"url": "http://h/none"}')]
WANT = {("s", 1): 200, ("s", 2): 200, ("s", 3): 200, ("s", 4): 200, ("s", 5): 400, ("s", 6): 404, ("s", 7): 400, ("s", 8): 200, ("s", 9): 404, ("t", 1): 200, ("t", 2): 409, ("t", 3): 400, ("t", 4): 400}


def test_sessions(spark):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, method string, form string, html string, cookies array<string>")
    ops = spark.createDataFrame(OPS, "session string, seq long, op string, args string")
    rows = {(r["session"], r["seq"]): r for r in sessions.run_batch(ops, pages).collect()}
    assert {k: r["status"] for k, r in rows.items()} == WANT
    assert rows["s", 3]["asks"] == '["POST", "http://h/go", "q=red+hat&all=on"]' and '"ref": 1, "role": "textbox"' in rows["s", 4]["body"]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read(spark, str(tmp_path / "in")), late="40 days")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    got = spark.table("tumbled").select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
