"""Line-by-line page scripts: parsing, variables, and a run over a relation of pages for many tabs at once.

A script is read on the driver and cut into runs of steps that need no other page. A tab is a row with its page, jar
and audit; each run of steps is one pass over the tabs, in which a tab's page is parsed once, and one join fetches what the
tabs ask for between two runs. Tabs share nothing; one whose step fails stops there, the others go on.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css, url
from ..functions.jar import Jar
from ..functions.page import ActionError, Page
from ..sources.responses import key_of
from .pages import replay


class ScriptError(ValueError):
    """A line that can't be read; its text starts with the line number."""


#: Operations and the fewest and most words behind them.
ARITY = {
    "snap": (0, 1), "fetch": (1, 1), "click": (1, 1), "fill": (2, 2), "submit": (0, 1 << 10), "extract": (1, 1), "json": (0, 1), "expect": (1, 1), "net": (0, 0), "req": (1, 1 << 10), "dom": (0, 0),
}
#: Options that take a word, by operation.
OPTIONS = {"submit": {"-f": "form", "--form": "form", "-d": "data", "--data": "data"}, "req": {"-X": "method", "--method": "method", "-H": "header", "--header": "header", "-d": "data", "--data": "data"}}


@dataclass(frozen=True)
class Step:
    line: int
    op: str
    args: tuple[str, ...]

    def fetches(self) -> bool:
        return self.op in ("fetch", "click", "submit", "req") or self.op == "snap" and bool(self.args)


def tokenize(line: str) -> list[str]:
    """Words; quoted ones keep their spaces, and a backslash there stands for the character behind it."""
    out, at = [], 0
    piece = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))', re.S)
    while at < len(line.rstrip()):
        m = piece.match(line, at)
        if m is None or (m[2] or "").startswith('"'):
            raise ScriptError("unterminated quote")
        out.append(re.sub(r"\\(.)", r"\1", m[1], flags=re.S) if m[1] is not None else m[2])
        at = m.end()
    return out


def options(op: str, words: tuple[str, ...]) -> dict[str, list[str]]:
    """The words behind each option; those before any under ""."""
    found: dict[str, list[str]] = {}
    known, at = OPTIONS[op], 0
    if op == "req":
        found[""], at = [words[0]], 1
    while at < len(words):
        if words[at] not in known or at + 1 == len(words):
            raise ScriptError(f"bad argument of {op}: {words[at]}")
        name, value = known[words[at]], words[at + 1]
        if name == "header" and ":" not in value or op == "submit" and name == "data" and "=" not in value:
            raise ScriptError(f"bad argument of {op}: {value}")
        found.setdefault(name, []).append(value)
        at += 2
    return found


def parse(text: str) -> list[Step]:
    """The steps of a script; blank lines and lines that start with # and no digit are left out."""
    steps = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or re.match(r"\s*#(?!\d)", line):
            continue
        try:
            op, *args = tokenize(line)
            if op not in ARITY:
                raise ScriptError(f"unknown operation {op!r}")
            low, high = ARITY[op]
            if not low <= len(args) <= high:
                raise ScriptError(f"{op} takes {low} to {high} arguments")
            if op in ("click", "fill") and not re.fullmatch(r"#*[0-9]+", args[0]):
                raise ScriptError(f"bad ref: {args[0]}")
            if op in OPTIONS:
                options(op, tuple(args))
        except ScriptError as e:
            raise ScriptError(f"{n}: {e}") from None
        steps.append(Step(n, op, tuple(args)))
    return steps


def substitute(text: str, values: dict[str, str]) -> str:
    """$NAME and ${NAME} by value, $$ as $; unknown names stay."""
    return re.sub(r"\$(?:(\$)|([A-Za-z_]\w*)|\{(\w+)\})", lambda m: "$" if m[1] else values.get(m[2] or m[3], m[0]), text)


def answers(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """What requests get: r_method, r_url, r_form, r_status, r_at, r_html, r_cookies, r_error, one row a request.

    ``pages`` has url and html, and may have method, form, status and cookies (its Set-Cookie headers); of rows that
    answer the same request the one with the smallest page_id counts. Redirects (url, status, location) lead there.
    """
    given = lambda c, other: F.col(c) if c in pages.columns else other
    number = given("page_id", F.xxhash64("url", "html"))
    fields = F.struct(given("status", F.lit(200)).cast("int").alias("status"), F.col("url").alias("at"), "html", given("cookies", F.array().cast("array<string>")).alias("cookies"))
    rows = pages.groupBy(F.upper(given("method", F.lit("GET"))).alias("r_method"), key_of(F.col("url")).alias("r_url"), F.coalesce(given("form", F.lit("")), F.lit("")).alias("r_form"))
    rows = rows.agg(F.min_by(fields, number).alias("r")).select("r_method", "r_url", "r_form", F.col("r.status").alias("r_status"), F.col("r.at").alias("r_at"), F.col("r.html").alias("r_html"), F.col("r.cookies").alias("r_cookies"), F.lit(None).cast("string").alias("r_error"))
    if redirects is None:
        return rows
    from ..sources.responses import chains

    ends = chains(redirects.withColumn("url", key_of(F.col("url")))).select(F.col("url").alias("from"), key_of(F.col("target")).alias("r_url"), "turned", "error")
    led = ends.join(rows, "r_url", "left")
    kept = ~F.col("turned") | (F.col("r_method") == "GET")
    led = led.where(kept | F.col("error").isNotNull() | F.col("r_method").isNull()).select(F.coalesce("r_method", F.lit("GET")).alias("r_method"), F.col("from").alias("r_url"), F.coalesce("r_form", F.lit("")).alias("r_form"), "r_status", "r_at", "r_html", "r_cookies", F.coalesce("error", F.when(F.col("r_status").isNull(), "not found")).alias("r_error"), "turned")
    every = led.where("turned").select(F.lit("POST").alias("r_method"), "r_url", F.lit(None).cast("string").alias("r_form"), "r_status", "r_at", "r_html", "r_cookies", "r_error")
    return rows.join(ends.select(F.col("from").alias("r_url")), "r_url", "left_anti").unionByName(led.drop("turned")).unionByName(every)


class Tab:
    """A tab's state between two passes; ``page`` is parsed when first asked for."""

    def __init__(self, state: str | None, html: str | None):
        s = json.loads(state or "{}")
        self.vars, self.at, self.status = s.get("vars", {}), s.get("at"), s.get("status", 0)
        self.jar, self.fills, self.alive, self.audit, self.waits = Jar(s.get("jar", [])), s.get("fills", []), s.get("alive", True), s.get("audit", []), s.get("waits")
        self.html, self._page = html, None

    def dump(self) -> str:
        return json.dumps({"vars": self.vars, "at": self.at, "status": self.status, "jar": self.jar.dump(), "fills": self.fills, "alive": self.alive, "audit": self.audit, "waits": self.waits})

    @property
    def page(self) -> Page:
        if self.html is None:
            raise ActionError("no page")
        if self._page is None:
            self._page = Page(self.html, self.at)
            for ref, value in self.fills:
                self._page.fill(ref, value)
        return self._page

    def report(self, step: Step, began: float, out: str | None = None, error: str | None = None) -> None:
        """The step's line in the audit; an error stops the tab."""
        args = [substitute(a, self.vars) for a in step.args]
        self.audit.append([step.line, step.op, " ".join(args), self.status, round((time.perf_counter() - began) * 1000, 3), error is None, out, error])
        self.alive = error is None

    def load(self, got: dict) -> None:
        """A response becomes the page at hand."""
        self.html, self.at, self.status, self.fills, self._page = got["r_html"] or "", got["r_at"], got["r_status"], [], None

    def request(self, step: Step) -> tuple[str, str, str]:
        args = [substitute(a, self.vars) for a in step.args]
        if step.op in ("snap", "fetch"):
            return "GET", str(url.parse(args[0])), ""
        if step.op == "click":
            return self.page.click(int(args[0].lstrip("#")))
        found = options(step.op, tuple(args))
        if step.op == "submit":
            form = self.page.find_form(found.get("form", [None])[-1])
            if form is None:
                raise ActionError("no form")
            return self.page.submit(form, [tuple(d.split("=", 1)) for d in found.get("data", [])])
        body = found.get("data", [""])[-1]
        return found.get("method", ["POST" if "data" in found else "GET"])[-1].upper(), str(url.parse(found[""][0])), body

    def ask(self, step: Step) -> tuple[str | None, str | None, str | None]:
        """The request a step makes; none if it fails."""
        began = time.perf_counter()
        try:
            method, at, body = self.request(step)
        except (ActionError, css.CssError, url.UrlError) as e:
            self.report(step, began, error=f"{step.op} failed: {e}")
            return None, None, None
        self.waits = at
        return method, at.partition("#")[0], body

    def answer(self, step: Step, got: dict) -> None:
        began = time.perf_counter()
        if got["r_url"] is None or got["r_error"]:
            return self.report(step, began, error=f"{step.op} failed: {got['r_error'] or 'not found'}")
        for header in got["r_cookies"] or ():
            self.jar.store(got["r_at"], header)
        if step.op == "req":
            return self.report(step, began, f"== {got['r_status']} {got['r_at']}\n{got['r_html'] or ''}")
        self.load(got)
        return self.report(step, began, self.page.snapshot() if step.op == "snap" else None)

    def do(self, step: Step) -> None:
        """A step on the page at hand."""
        began = time.perf_counter()
        args = [substitute(a, self.vars) for a in step.args]
        out, error = None, None
        try:
            if step.op == "snap":
                out = self.page.snapshot()
            elif step.op == "extract":
                out = "\n".join(self.page.lines(args[0]))
            elif step.op == "json":
                out = "\n".join(self.page.json_lines(args[0] if args else None))
            elif step.op == "expect":
                if args[0] not in self.page.snapshot():
                    error = f"expect failed: '{args[0]}' not in snapshot"
            elif step.op == "fill":
                self.page.fill(int(args[0].lstrip("#")), args[1])
                self.fills.append([int(args[0].lstrip("#")), args[1]])
            elif step.op == "dom":
                nodes, names = self.page.stats()
                out = f"nodes {nodes}\nstrings {names}\ncookies {len(self.jar.cookies)}"
            else:
                calls = self.page.fetches()
                lines = [f"== {m} {at}\n" + (f"  send: {b}\n" if b else "") + replay(m, at, b) for m, at, b in calls]
                out = "\n".join(lines) or "(no fetch() calls recorded on this page)"
        except (ActionError, css.CssError) as e:
            error = str(e)
        self.report(step, began, out, error)


_STATE = "tab string, state string, html string, q_method string, q_url string, q_form string"
_GOT = ("r_url", "r_status", "r_at", "r_html", "r_cookies", "r_error")


def _pass(first: Step | None, steps: list[Step], ask: Step | None):
    """One pass over the tabs: take the answer to ``first``, do ``steps``, make the request of ``ask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                tab = Tab(r["state"], r["html"])
                if tab.alive and first is not None:
                    tab.answer(first, r)
                for step in steps:
                    if tab.alive:
                        tab.do(step)
                asked = tab.ask(ask) if ask is not None and tab.alive else (None, None, None)
                # the page goes along only where the answer that comes does not replace it
                stays = ask is None or ask.op == "req" and tab.alive
                rows.append((r["tab"], tab.dump(), tab.html if stays else None, *asked))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _STATE.split(", ")])

    return run


def states(steps: list[Step], tabs: DataFrame, pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Tabs after a run: tab, state (JSON), html (null once a tab has failed). ``tabs`` has tab, and may have url (the page it starts from), vars (a map
    of names to values) and jar (the JSON of a jar)."""
    held = answers(pages, redirects)
    given = lambda c, kind: F.col(c) if c in tabs.columns else F.lit(None).cast(kind)
    state = F.to_json(F.struct(F.coalesce(given("vars", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("vars")))
    rows = tabs.select(F.col("tab").cast("string").alias("tab"), state.alias("state"), F.lit(None).cast("string").alias("html"), given("url", "string").alias("start"))
    if "jar" in tabs.columns:
        rows = tabs.select(F.col("tab").cast("string").alias("tab"), F.concat(F.substring(state, 1, F.length(state) - 1), F.lit(', "jar": '), F.coalesce("jar", F.lit("[]")), F.lit("}")).alias("state"), F.lit(None).cast("string").alias("html"), given("url", "string").alias("start"))
    opening = Step(0, "fetch", ("",))
    rows = rows.select("tab", "state", "html", F.when(F.col("start").isNotNull(), "GET").alias("q_method"), key_of(F.col("start")).alias("q_url"), F.lit("").alias("q_form"))
    cuts = [k for k, s in enumerate(steps) if s.fetches()] + [len(steps)]
    first, at = opening, 0
    for cut in cuts:
        fits = (F.col("q_method") == F.col("r_method")) & (F.col("q_url") == F.col("r_url")) & (F.col("r_form").isNull() | (F.col("q_form") == F.col("r_form")))
        joined = rows.join(held, fits, "left").select("tab", "state", "html", *_GOT)
        ask = steps[cut] if cut < len(steps) else None
        run = _opening(steps[at:cut], ask) if first is opening else _pass(first, steps[at:cut], ask)
        rows = joined.mapInArrow(run, _STATE)
        first, at = ask, cut + 1
    return rows.select("tab", "state", "html")


def _opening(steps: list[Step], ask: Step | None):
    """The first pass: the page a tab starts from is at hand before any step, and not in the audit."""
    later = _pass(None, steps, ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                tab = Tab(r["state"], None)
                if r["r_url"] is not None and not r["r_error"]:
                    for header in r["r_cookies"] or ():
                        tab.jar.store(r["r_at"], header)
                    tab.load(r)
                rows.append({"tab": r["tab"], "state": tab.dump(), "html": tab.html})
            if rows:
                kinds = pa.schema([("tab", pa.string()), ("state", pa.string()), ("html", pa.string())])
                yield from later(iter([pa.RecordBatch.from_pylist(rows, kinds)]))

    return run


_AUDIT = "array<array<string>>"


def run(steps: list[Step], tabs: DataFrame, pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """The audit of a run: tab, line, op, arg, status, ms, ok, out (text; null where a step says nothing), error.

    Every step that ran has a row, the one that failed too. Empty tables give no rows; a tab without a page fails at
    its first step that needs one; null tabs are tabs; tabs that repeat a name each run.
    """
    audit = states(steps, tabs, pages, redirects).select("tab", F.explode(F.from_json(F.get_json_object("state", "$.audit"), _AUDIT)).alias("a"))
    at = lambda k: F.get("a", F.lit(k))
    return audit.select("tab", at(0).cast("int").alias("line"), at(1).alias("op"), at(2).alias("arg"), at(3).cast("int").alias("status"), at(4).cast("double").alias("ms"), (at(5) == "true").alias("ok"), at(6).alias("out"), at(7).alias("error"))


def outcomes(steps: list[Step], tabs: DataFrame, pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """A row a tab: tab, ok, error (with its line), out (what its steps said, one behind the other), jar (JSON), url, status."""
    end = states(steps, tabs, pages, redirects).withColumn("audit", F.from_json(F.get_json_object("state", "$.audit"), _AUDIT))
    failed = F.get(F.filter("audit", lambda a: a[5] != "true"), F.lit(0))
    said = F.array_join(F.transform("audit", lambda a: a[6]), "")
    error = F.when(failed.isNotNull(), F.concat(F.lit("line "), failed[0], F.lit(": "), failed[7]))
    return end.select("tab", failed.isNull().alias("ok"), error.alias("error"), said.alias("out"), F.get_json_object("state", "$.jar").alias("jar"), F.get_json_object("state", "$.at").alias("url"), F.get_json_object("state", "$.status").cast("int").alias("status"))


def audit_lines(audit: DataFrame) -> DataFrame:
    """The audit as JSON lines: tab, seq, line."""
    fields = F.struct("line", "op", "arg", "tab", "status", F.round("ms", 3).alias("ms"), "ok")
    return audit.select("tab", F.col("line").alias("seq"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("line"))
