"""Sessions over a table or a stream of operations.

A session is a tab of ``operators.scripts``, keyed by its id; operations of a session run in order of their sequence,
sessions side by side. A page's answers are joined to the operations first, so a session never looks anything up itself.
Over a stream, its page and cookies are state of a ``StatefulProcessor``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import css
from ..functions.jar import Jar
from ..functions.page import ActionError, role
from ..operators.pages import replay
from ..operators.scripts import Tab, answers
from ..sources.responses import key_of

#: Statuses of what an operation can come to.
OK, BAD, UNKNOWN, NO_PAGE = 200, 400, 404, 409
#: Operations and the arguments they need.
OPS = {"open": ("url",), "close": (), "snap": (), "goto": ("url",), "click": ("ref",), "fill": ("ref", "value"), "submit": (), "extract": ("css",), "expect": ("text",), "json": (), "net": (), "list": ()}
MOST = 256  # sessions kept, by last use
RESULT = "session string, seq long, op string, status int, body string, asks string"


def act(tab: Tab | None, op: str, args: dict, got: dict | None) -> tuple[Tab | None, int, object, tuple | None]:
    """(the session's tab afterwards, status, body, request it asks for) of one operation.

    Unknown operations and sessions are 404, operations without a page 409 (net: 400), bad arguments 400. ``got`` is the
    answer to the address an operation brings with it (open, goto).
    """
    if op not in OPS:
        return tab, UNKNOWN, {"error": f"unknown op: {op}"}, None
    if op == "open":
        tab = Tab(None, None)
        if not args.get("url"):
            return tab, OK, {"opened": True}, None
    if tab is None:
        return None, UNKNOWN, {"error": "unknown session"}, None
    if op == "close":
        return None, OK, {"closed": True}, None
    missing = [a for a in OPS[op] if args.get(a) in (None, "")]
    if missing:
        return tab, BAD, {"error": f"missing {missing[0]}"}, None
    if op in ("open", "goto"):
        if got is None or got.get("r_url") is None or got.get("r_error"):
            return tab, BAD, {"error": f"fetch failed: {(got or {}).get('r_error') or 'not found'}"}, None
        for header in got["r_cookies"] if got["r_cookies"] is not None else ():
            tab.jar.store(got["r_at"], header)
        tab.load(got)
        return tab, OK, {"url": tab.at, "snapshot": tab.page.snapshot()}, None
    if tab.html is None:
        return tab, BAD if op == "net" else NO_PAGE, {"error": "no page"}, None
    try:
        if op == "snap":
            return tab, OK, {"snapshot": tab.page.snapshot()}, None
        if op == "extract":
            return tab, OK, [{"ref": r.ref or 0, "role": role(r), "text": tab.page.text(r)} for r in tab.page.select(str(args["css"]))], None
        if op == "fill":
            tab.page.fill(int(args["ref"]), str(args["value"]))
            tab.fills.append([int(args["ref"]), str(args["value"])])
            return tab, OK, {"filled": int(args["ref"])}, None
        if op in ("click", "submit"):
            form = tab.page.find_form(args.get("form")) if op == "submit" else None
            if op == "submit" and form is None:
                return tab, BAD, {"error": "no form"}, None
            asked = tab.page.click(int(args["ref"])) if op == "click" else tab.page.submit(form, list((args.get("data") or {}).items()))
            return tab, OK, {"method": asked[0], "url": asked[1], "body": asked[2]}, asked
        if op == "expect":
            found = str(args["text"]) in tab.page.snapshot()
            return tab, OK if found else BAD, {"found": found}, None
        if op == "json":
            return tab, OK, tab.page.json_lines(args.get("path")), None
        if op == "net":
            return tab, OK, [replay(*c) for c in tab.page.fetches()], None
        return tab, OK, {"url": tab.at, "status": tab.status}, None
    except (ActionError, css.CssError, ValueError) as e:
        return tab, BAD, {"error": str(e)}, None


def with_answers(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """Operations (session, seq, op, args as JSON, more) with the answer to the address they bring."""
    held = answers(pages).where("r_method = 'GET' AND r_form = ''").drop("r_method", "r_form")
    asked = ops.withColumn("asked", F.when(F.col("op").isin("open", "goto"), key_of(F.get_json_object("args", "$.url"))))
    return asked.join(held, F.col("asked") == F.col("r_url"), "left").drop("asked")


def _args(text: object) -> dict | None:
    try:
        args = json.loads(text) if isinstance(text, str) and text else {}
    except ValueError:
        return None
    return args if isinstance(args, dict) else None


def _step(tab: Tab | None, r: dict) -> tuple[Tab | None, tuple]:
    args = _args(r["args"])
    got = {k: r[k] for k in ("r_url", "r_at", "r_html", "r_status", "r_cookies", "r_error")} if r["r_url"] is not None else None
    tab, status, body, asked = (tab, BAD, {"error": "bad arguments"}, None) if args is None else act(tab, r["op"], args, got)
    return tab, (r["session"], r["seq"], r["op"], status, json.dumps(body, ensure_ascii=False), json.dumps(asked) if asked else None)


def run_batch(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """Every operation's result over a whole table of them: session, seq, op, status, body (JSON), asks (the request it leads to).

    A session's operations go through one task in order, ties by operation and arguments; the task holds one session's
    page at a time, whatever the number of operations. Rows with null sessions form one session, null places come first.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, session, any_yet = None, None, False
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not any_yet or r["session"] != session:
                    tab, session, any_yet = None, r["session"], True
                tab, row = _step(tab, r)
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ordered = with_answers(ops.select("session", F.col("seq").cast("long").alias("seq"), "op", "args"), pages).repartition("session")
    return ordered.sortWithinPartitions("session", "seq", "op", "args").mapInArrow(run, RESULT)


_COOKIE = T.StructType([T.StructField(n, T.BooleanType() if n in ("secure", "host_only", "http_only") else T.StringType()) for n in ("name", "value", "domain", "path", "secure", "host_only", "http_only")])
_PAGE = T.StructType([T.StructField("at", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("html", T.StringType()), T.StructField("fills", T.StringType())])
EXPIRED = "expire"


def restored(page: tuple, cookies: Iterator[tuple]) -> Tab:
    """The tab that state (at, status, html, fills; cookies) stands for."""
    tab = Tab(None, page[2])
    tab.at, tab.status, tab.fills = page[0], page[1], json.loads(page[3])
    tab.jar = Jar([dict(zip(_COOKIE.names, c, strict=True)) for c in cookies])
    return tab


def stored(tab: Tab) -> tuple[tuple, list[tuple]]:
    """A tab as state."""
    return (tab.at, tab.status, tab.html, json.dumps(tab.fills)), [tuple(c[n] for n in _COOKIE.names) for c in tab.jar.dump()]


def steps(tab: Tab | None, rows: list[dict]) -> tuple[Tab | None, list[tuple]]:
    """A micro-batch's share of a session, in order."""
    out = []
    for r in sorted(rows, key=lambda r: (r["seq"] is not None, r["seq"] or 0, r["op"] or "", r["args"] or "")):
        tab, row = _step(tab, r)
        out.append(row)
    return tab, out


def _processor(idle: int | None) -> StatefulProcessor:
    """A session's page as a value and its cookies as a list, kept between micro-batches; with ``idle`` a timer closes a
    session that has been left alone for so many milliseconds of event time, and says so in a row of its own.

    The class goes to workers by value and imports this module where rows are at hand: the worker that sets
    state up beforehand need not know this library.
    """
    page_kind, cookie_kind, closed = _PAGE, _COOKIE, (EXPIRED, OK, json.dumps({"closed": True}), None)
    result = Row(*(f.split()[0] for f in RESULT.split(", ")))

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.page, self.jar = handle.getValueState("page", page_kind), handle.getListState("jar", cookie_kind)

        def drop(self) -> None:
            self.page.clear()
            self.jar.clear()

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
            from arborfold.streaming import sessions

            tab = sessions.restored(self.page.get(), self.jar.get() if self.jar.exists() else iter(())) if self.page.exists() else None
            held = [r.asDict(recursive=True) for r in rows]
            tab, done = sessions.steps(tab, held)
            yield from (result(*row) for row in done)
            self.drop()
            if tab is not None:
                page, cookies = sessions.stored(tab)
                self.page.update(page)
                if cookies:
                    self.jar.put(cookies)
            if idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                last = max((r["at"] for r in held if r["at"] is not None), default=None)
                if tab is not None and last is not None:
                    self.handle.registerTimer(int(last.timestamp() * 1000) + idle)

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
            if self.page.exists():
                self.drop()
                yield result(key[0][1:] if key[0] else None, None, *closed)

        def close(self) -> None:
            pass

    return Sessions()


def run_stream(ops: DataFrame, pages: DataFrame, idle: int | None = None) -> DataFrame:
    """The results of ``run_batch`` for a stream of operations, as they come; sessions live on between micro-batches.

    Within a micro-batch a session's operations go in order; those of a later one come after. A task holds a
    micro-batch's share of a session, so a session may be of any length. With ``idle`` (milliseconds) operations need a
    column ``at`` with a watermark. State is in RocksDB (``stateful`` sets the provider).
    """
    given = ops.select("session", F.col("seq").cast("long").alias("seq"), "op", "args", *(["at"] if idle is not None else []))
    keyed = with_answers(given, pages).withColumn("key", F.when(F.col("session").isNull(), "").otherwise(F.concat(F.lit("s"), "session")))
    return keyed.groupBy("key").transformWithState(_processor(idle), RESULT, "Append", "None" if idle is None else "EventTime")


@contextmanager
def stateful(spark: SparkSession):
    """Streaming queries started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def live(done: DataFrame) -> DataFrame:
    """The sessions that results of operations leave open, by name: session, seq (of the last operation)."""
    opened = F.max(F.when((F.col("op") == "open") & (F.col("status") != UNKNOWN), F.col("seq")))
    closed = F.max(F.when((F.col("op") == "close") & (F.col("status") == OK), F.col("seq")))
    gone = F.max(F.col("op") == EXPIRED)
    last = done.groupBy("session").agg(opened.alias("opened"), closed.alias("closed"), gone.alias("gone"), F.max("seq").alias("seq"))
    return last.where("opened IS NOT NULL AND NOT gone AND (closed IS NULL OR closed < opened)").select("session", "seq").orderBy("session")


def kept(uses: DataFrame, most: int = MOST) -> DataFrame:
    """The sessions (session, last_used) that stay open: the ``most`` used last, ties to the smaller name; a limit every
    task applies to its share first. Columns: session, last_used, place."""
    last = uses.groupBy("session").agg(F.max("last_used").alias("last_used"))
    order = [F.desc("last_used"), F.col("session")]
    return last.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
