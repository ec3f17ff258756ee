"""Text files as sources and sinks, table functions in SQL, metrics, stateful sessions."""

import os

import pytest
from pyspark.sql import functions as F

from arborfold.functions import sql, text
from arborfold.operators import cookies, metrics, scripts
from arborfold.sources import files, store
from arborfold.streaming import sessions
from test_scripts_and_streams import OPS, SHOP


def listed(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_files_prune_partitions(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("p/"), F.col("id") % 8).alias("name"), F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("line"))
    files.write(rows, "jars", str(tmp_path))
    whole = files.read(spark, "jars", f"file://{tmp_path}", partitionBytes=1)
    assert whole.rdd.getNumPartitions() == 8 and whole.count() == 40
    one = whole.where("profile = 'p/3'")
    assert one.rdd.getNumPartitions() == 1 and [(r["profile"], r["seq"], r["line"]) for r in one.orderBy("seq").collect()] == [("p/3", k, f"line {3 + 8 * k}") for k in range(5)]
    assert whole.where("profile IN ('p/1', 'p/2', 'no') AND line LIKE '%1%'").rdd.getNumPartitions() == 2
    assert whole.where("profile = 'no'").count() == 0 and files.read(spark, "jars", str(tmp_path / "none")).count() == 0
    assert files.read(spark, "jars", str(tmp_path)).rdd.getNumPartitions() == 1  # small files together
    files.write(rows.where("name = 'p/3'").withColumn("line", F.lit("new")), "jars", str(tmp_path))
    again = files.read(spark, "jars", str(tmp_path))
    assert again.where("line = 'new'").count() == 5 and again.count() == 40  # the latest run of a name counts
    files.write(rows.limit(1), "jars", str(tmp_path), mode="overwrite")
    assert files.read(spark, "jars", str(tmp_path)).count() == 1 and not [p for p in os.listdir(tmp_path) if p.startswith("_")]


def test_a_task_that_runs_twice_writes_once(spark, tmp_path):
    """The writer by hand, as tasks run it: two attempts of one task, of which one counts; a job that fails leaves nothing."""
    from pyspark import TaskContext

    class Attempt(TaskContext):
        def __new__(cls, part, number):
            made = object.__new__(cls)
            made._partitionId, made._taskAttemptId = part, number
            return made

    def as_task(writer, part, number, rows):
        kept, TaskContext._taskContext = TaskContext._taskContext, Attempt(part, number)
        try:
            return writer.write(iter(rows))
        finally:
            TaskContext._taskContext = kept

    source = files._source("arborfold_jars", *files.FORMATS["arborfold_jars"])({"path": str(tmp_path)})
    writer = source.writer(None, False)
    first, second = (as_task(writer, 0, number, [("a", "1"), ("a", "2"), ("b", "3")]) for number in (7, 8))
    other = as_task(writer, 1, 9, [("c", "4")])
    assert first.folder != second.folder and listed(tmp_path)
    writer.commit([second, other, None])
    assert [p.rsplit("/", 1)[1] for p in listed(tmp_path)] == ["a.jar", "b.jar", "c.jar"] and open(listed(tmp_path)[0]).read() == "1\n2\n"
    failed = source.writer(None, False)
    as_task(failed, 0, 1, [("d", "5")])
    failed.abort([])
    assert len(listed(tmp_path)) == 3
    for bad in ([("e", "1"), ("f", "1"), ("e", "2")], [(None, "1")]):
        with pytest.raises(ValueError):
            as_task(failed, 0, 2, bad)


def test_scripts_and_script_files(spark, tmp_path):
    (tmp_path / "ok.txt").write_text('# note\nfetch http://h/a\nexpect "two words"\n')
    (tmp_path / "bad.txt").write_text("snap\njump x\n")
    (tmp_path / "x.js").write_bytes(b"a()\xff\n")
    got = sorted(tuple(r) for r in files.read(spark, "scripts", str(tmp_path)).select("script", "line", "op", F.to_json("args"), "error").collect())
    assert got == [("bad", 2, None, None, "2: unknown operation 'jump'"), ("ok", 2, "fetch", '["http://h/a"]', None), ("ok", 3, "expect", '["two words"]', None)]
    assert [tuple(r) for r in files.read(spark, "script_files", str(tmp_path)).collect()] == [("x", "a()�\n")]


def test_jars_of_failed_tabs(spark, tmp_path):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, method string, form string, html string, cookies array<string>")
    tabs = spark.createDataFrame([("a", "http://h/"), ("b", "http://h/"), ("c", "http://h/none")], "tab string, url string")
    ends = scripts.outcomes(scripts.parse("expect Nowhere"), tabs, pages)
    assert {r["tab"]: r["ok"] for r in ends.collect()} == {"a": False, "b": False, "c": False}
    files.write(files.jar_rows(ends), "jars", str(tmp_path))
    back = cookies.from_lines(files.read(spark, "jars", str(tmp_path)))
    assert sorted((r["profile"], r["name"], r["value"], r["http_only"]) for r in back.collect()) == [("a", "h", "2", True), ("a", "s", "1", False), ("b", "h", "2", True), ("b", "s", "1", False)]


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "http://h/x", "<form><input name=a value=1><input name=b></form><script type='application/json'>{\"k\": 1}</script><script>fetch('y')</script>"), (2, None, None)], "page_id long, url string, html string").createOrReplaceTempView("some_pages")
    ask = lambda what: [tuple(r) for r in spark.sql(f"SELECT p.page_id, f.* FROM some_pages p, LATERAL {what} f ORDER BY 1, 2, 3").collect()]
    assert ask("form_fields(p.html)") == [(1, 1, 1, "a", "1"), (1, 1, 2, "b", "")] and ask("json_blocks(p.html)") == [(1, 0, 'script[type="application/json"]', '{"k": 1}')]
    assert ask("page_fetches(p.html, p.url)") == [(1, 0, "GET", "http://h/y", "")] and ask("html_select(p.html, 'input')")[0] == (1, 2, "input", "", {"name": "a", "value": "1"})
    nodes = ask("html_nodes(p.html)")
    assert [n[5] for n in nodes if n[0] == 1] == ["document", "element", "element", "element", "element", "text", "element", "text"] and len([n for n in nodes if n[0] == 2]) == 1
    assert spark.sql("SELECT count(*) AS n FROM pages_nodes(TABLE(some_pages))").first()["n"] == len(nodes)
    assert spark.sql("SELECT regex_exec('abc', 'b', '', 100).matched AS m, json_get('{\"a\": [5]}', 'a.0') AS j").first().asDict() == {"m": "b", "j": "5"}


def test_observed_metrics(spark):
    df = spark.createDataFrame([("page\n", 10), ("é", 7), (None, 3), ("", 0)], "snapshot string, html_bytes int")
    watched, seen = metrics.snapshot_metrics(df)
    rows = watched.collect()
    assert seen.get == {"pages": len(rows), "bytes_in": 20, "bytes_out": 7, "tokens_in": 3, "tokens_out": 1, "empty": 2}
    assert metrics.line(seen.get) == "pages=4 bytes_in=20 bytes_out=7 tokens_in=3 tokens_out=1 empty=2"
    none, seen = metrics.snapshot_metrics(df.limit(0))
    none.collect()
    assert metrics.line(seen.get).startswith("pages=0 bytes_in=0")


def test_formats(spark):
    sizes = [0, 1023, 1024, 1280, 1281, 1331, 1536, 1792, 1048575, 1048576, 1310720, 1835008, 5 << 40]
    got = [tuple(r) for r in spark.createDataFrame([(n, n / 8) for n in sizes], "n long, ms double").select(text.format_bytes(F.col("n")), text.format_ms(F.col("ms"))).collect()]
    assert got == [(f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB", f"{n / 8:.0f}ms") for n in sizes]
    data = spark.createDataFrame([("aGk=", ), ("aGk",), (" a G\nk = ",), ("a",), ("a$==",), ("",), (None,)], "t string").select(text.from_base64(F.col("t")).cast("string").alias("v"))
    assert [r["v"] for r in data.collect()] == ["hi", "hi", "hi", None, None, "", None]
    assert spark.range(1).select(text.to_base64(F.lit("x" * 100)).alias("v")).first()["v"] == "eHh4" * 33 + "eA=="


def test_computed_style(spark):
    df = spark.createDataFrame([("COLOR: red !important; --My-Var: 1; font: 12px 'Comic Sans' !IMPORTANT",), (None,)], "s string")
    own, none = df.select(*(text.style_value(text.computed_style(F.col("s")), k).alias(k) for k in ("color", "--My-Var", "fontFamily", "font-family", "backgroundColor", "float")), F.size(text.computed_style(F.col("s"))).alias("n")).collect()
    assert tuple(own) == ("red", "1", "Sans", "Sans", "rgba(0, 0, 0, 0)", "", 13) and tuple(none) == ("rgb(0, 0, 0)", "", "Arial", "Arial", "rgba(0, 0, 0, 0)", "", 11)


def as_stream(spark, ops, path, cuts):
    """``ops`` in files of their own for each range of seq, one a micro-batch."""
    for low, high in zip([0, *cuts], [*cuts, 1 << 40], strict=True):
        ops.where(f"seq > {low} AND seq <= {high}").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_of_operations_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, method string, form string, html string, cookies array<string>")
    ops = spark.createDataFrame([*OPS, (None, 1, "open", '{"url": "http://h/"}'), (None, 2, "snap", "{}"), *[("long", k, "open" if k == 1 else "snap", '{"url": "http://h/"}') for k in range(1, 3000)]], "session string, seq long, op string, args string")
    with sessions.stateful(spark):
        done = store.drained(sessions.run_stream(as_stream(spark, ops, tmp_path / "in", [2, 5, 1500]), pages), "sessions-test")
    batch = sessions.run_batch(ops, pages)
    assert done.exceptAll(batch).count() == 0 and batch.exceptAll(done).count() == 0 and done.count() == len(OPS) + 3001
    assert [tuple(r) for r in sessions.live(done).collect()] == [(None, 2), ("long", 2999), ("t", 4)]


def test_idle_sessions_end(spark, tmp_path):
    """A timer in event time closes a session that has been left alone; one that goes on stays."""
    pages = spark.createDataFrame(SHOP, "page_id long, url string, method string, form string, html string, cookies array<string>")
    rows = [("a", 1, "open", 0), ("b", 1, "open", 0), ("b", 2, "snap", 40), ("b", 3, "snap", 80), ("b", 4, "snap", 120), ("a", 5, "snap", 121), ("b", 6, "snap", 122)]
    ops = spark.createDataFrame(rows, "session string, seq long, op string, minute int").selectExpr("session", "seq", "op", """'{"url": "http://h/"}' AS args""", "timestamp_seconds(1700000000 + 60 * minute) AS at")
    stream = as_stream(spark, ops, tmp_path / "in", [1, 2, 3, 4]).withWatermark("at", "1 minute")
    with sessions.stateful(spark):
        done = {(r["session"], r["seq"], r["op"]): r["status"] for r in store.drained(sessions.run_stream(stream, pages, idle=60 * 60_000), "sessions-idle").collect()}
    assert done["a", None, "expire"] == 200 and done["a", 5, "snap"] == 404 and done["b", 6, "snap"] == 200 and ("b", None, "expire") not in done
