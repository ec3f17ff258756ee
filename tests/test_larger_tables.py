"""What queries do as tables grow: rows that make much work are dealt over tasks, and equal work is done once."""

import random
import re

import pyarrow as pa
import pytest
from arborfold import registry
from arborfold.functions import patterns, tree, url
from arborfold.functions.entities import decode
from arborfold.functions.page import Page
from arborfold.operators import pages


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, each of one file that a single task would read."""
    at = str(tmp_path_factory.mktemp("tables"))
    made = {
        "part": spark.range(4000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size"),
        "customer": spark.range(4000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 9 - 4 AS DOUBLE) AS c_acctbal", "element_at(array('BUILDING', 'MACHINERY'), CAST(id % 2 + 1 AS INT)) AS c_mktsegment"),
        "events": spark.range(4000).selectExpr("id AS event_id", "id % 70 AS user_id", "element_at(array('click', 'view'), CAST(id % 2 + 1 AS INT)) AS event_type"),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def tasks(df) -> int:
    return df.rdd.getNumPartitions()


def test_equal_rows_are_matched_once():
    asked = []
    column = pa.array(["a", "b", None, "a", "a"])
    got = patterns._rows((column,), [("n", pa.int32())], lambda t: asked.append(t) or {"n": ord(t)})
    assert asked == ["a", "b"]
    assert got.to_pylist() == [{"n": 97, "error": None}, {"n": 98, "error": None}, None, {"n": 97, "error": None}, {"n": 97, "error": None}]


def test_pattern_fuel_is_dealt(spark, tables):
    assert tasks(registry.table(spark, tables, "part")) == 1
    found = registry.QUERIES["pattern_fuel"](spark, tables)
    assert tasks(found) == 8
    assert found.where("error = 'out of fuel'").count() == 4000 * 15 // 25


def test_cut_references_stay_where_sql_leaves_them(spark, tmp_path):
    """Titles of larger tables end within a reference; queries with SQL read those that a semicolon ends."""
    html = "<title>a &amp; b &amp</title><nav><ul><li><a href='/x?a&amp=1'>c &copy</a></ul></nav><h1>a &amp; b &amp</h1>"
    spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.title for r in run("titles")] == ["a & b &amp"]
    assert [r.text for r in run("text_content_h1")] == [r.text for r in run("raw_text_h1")] == ["a & b &amp"]
    assert [r.html for r in run("serialized_h1")] == ["<h1>a &amp; b &amp;amp</h1>"]
    assert [(r.text, r.href) for r in run("nav_links")] == [("c &copy", "/x?a&amp=1")]
    assert [r.html for r in run("edited_links")] == ['<a href="/x?a&amp;amp=1" rel="next">go</a>']
    df = registry.table(spark, str(tmp_path), "pages")
    assert pages.titles(df).first().title == "a & b &"
    assert decode("&#65 &amp &amp;", bare=False) == "A &amp &"


@pytest.mark.parametrize("name", ["click_forms", "script_writes", "submit_requests", "submit_overrides", "script_sources", "snapshot_texts", "form_fields", "sel_id", "fetch_calls", "json_lines", "sql_json_blocks", "url_joined"])
def test_pages_made_of_narrow_rows_are_dealt(spark, tables, name):
    assert tasks(registry.QUERIES[name](spark, tables)) >= 4


def test_forms_are_read_once_for_all_that_send_them(spark, monkeypatch):
    page = Page("<form id='f' action='/go'><input name='a' value='1'><input type='submit'><button>b</button></form>", "http://h/p")
    assert [page.form_of(page.refs()[k]).tag for k in (1, 2, 3)] == ["form"] * 3
    read = []
    monkeypatch.setattr(url, "parse", lambda text, parse=url.parse: read.append(text) or parse(text))
    assert [page.click(k) for k in (1, 2, 3)] == [("GET", "http://h/go?a=1", "")] * 3
    assert read == ["http://h/p"]


def test_writes_keep_the_tree_between_them(monkeypatch):
    made = []
    monkeypatch.setattr(tree, "from_rows", lambda rows, f=tree.from_rows: made.append(len(rows)) or f(rows))
    page = Page("<p id=a>x</p><p id=b>y</p><script>document.getElementById('a').title = 'q'; document.getElementById('b').remove(); document.getElementById('a').textContent = 'z'</script>", "http://h/")
    html, n = tree.written(page)
    assert (html.partition("<script>")[0], n, len(made)) == ('<p id="a" title="q">z</p>', 3, 1)


def test_places_without_the_pattern_s_beginning_are_not_tried(monkeypatch):
    tried = []
    monkeypatch.setattr(patterns.Pattern, "_try", lambda self, pc, text, at, *more, f=patterns.Pattern._try: tried.append(at) or f(self, pc, text, at, *more))
    p = patterns.Pattern(r"\b([a-z]+)(ing|tion) ([a-z]{2,4})\b", "g")
    text = "plain words, string of nation xs, tin ion " * 50
    assert patterns.replace(p, text, "$3 $1") == re.sub(r"\b([a-z]+)(ing|tion) ([a-z]{2,4})\b", r"\3 \1", text)
    assert len(tried) == 100  # the matches alone
    with pytest.raises(patterns.OutOfFuel):  # what a glance reads is burnt as well
        patterns.Pattern("[a-z]+x").match("a" * 2000, 0, 100_000)


def test_glances_change_no_match():
    dealt = random.Random(3)
    ways = [r"a+b", r"\ba{1,2}(b|ca)c", r"(a|bb)+c", r"[ab]*?c\B", r"a(?:b|c){2}", r"(a)b\1", r"a?b+c", r"(?=ab)a[bc]+a", r"A+b|c", r"ab{0}c", r"(a*)(b|c)"]
    for _ in range(3000):
        text = "".join(dealt.choice("aabbc C ") for _ in range(dealt.randrange(14)))
        for way in ways:
            for flags in ("", "i"):
                want = re.compile(way, re.IGNORECASE if flags else 0).search(text)
                got = patterns.compiled(way, flags).match(text)
                assert (got and (got.start, got.end)) == (want and want.span()), (way, flags, text)


def test_batches_are_full_by_their_text(monkeypatch):
    schema = pa.schema([("page_id", pa.int64()), ("html", pa.string())])
    monkeypatch.setattr(pages, "TEXT", 10, raising=False)
    got = [b.to_pylist() for b in pages._batches([[(1, "x" * 6), (2, None)], [], [(3, "y" * 5)], [(4, "z")]], schema)]
    assert [[r["page_id"] for r in b] for b in got] == [[1, 2, 3], [4]]
    assert list(pages._batches([[]], schema)) == []
