"""Whitening, URL filters and the divergence audit against brute force and exact fractions; what small tables cost."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from arborfold.llm import common, divergence, minhash_dedup, url_filter, whitening


def test_error_free_parts():
    rng = np.random.default_rng(4)
    hi, lo = whitening.two_sum(rng.normal(size=(40, 3)) * 10.0 ** rng.integers(-6, 6, (40, 3)), rng.normal(size=(40, 3)) * 1e-9)
    parts = whitening.slices(hi, lo)
    top = max(abs(Fraction(x)) for x in hi.ravel())
    for i in range(40):
        for j in range(3):
            whole = sum((Fraction(float(p[i, j])) for p in parts), Fraction(0))
            assert abs(whole - Fraction(float(hi[i, j])) - Fraction(float(lo[i, j]))) <= top / 2**98
    got_hi, got_lo = whitening.outer(hi, lo)
    for a in range(3):
        for b in range(3):
            want = sum((Fraction(float(hi[k, a])) + Fraction(float(lo[k, a]))) * (Fraction(float(hi[k, b])) + Fraction(float(lo[k, b]))) for k in range(40))
            assert abs(Fraction(float(got_hi[a, b])) + Fraction(float(got_lo[a, b])) - want) <= top * top / 2**90
    assert not whitening.outer(np.zeros((3, 2)), np.zeros((3, 2)))[0].any()


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"]))


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.1]) + 7).tolist()
    rows = [(k, [float(x) for x in v], "clash") for k, v in enumerate(data)]
    rows += [(100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("inf")] * 5, "x"), (104, [], "x"), (105, [2.0**31] * 5, "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(7)
    out = rows_of(whitening.whiten(df))
    kept = [v for _, v, _ in rows if v and None not in v and np.isfinite(v).all() and max(v) < 2**30]
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[sum(Fraction(n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / Fraction(n) ** 3 for j in range(5)] for i in range(5)]
    e, v = np.linalg.eigh(np.array([[float(c) for c in line] for line in exact]))
    assert len(out) == n * 5 and {r["n"] for r in out} == {n}
    assert out[0]["identity_error"] < 1e-9 and {r["vec_id"] for r in out} == {*range(60), None}
    for r in out:
        at = 1 if r["vec_id"] is None else r["vec_id"]
        u = [n * a - s for a, s in zip(x[at], sums, strict=True)]
        k = 5 - r["component"]
        assert r["deviation"] == sum(c * c for c in u)
        assert abs(r["whitened"]) == pytest.approx(abs(np.array(u, float) / n @ v[:, k]) / np.sqrt(e[k]), rel=1e-7, abs=1e-9)
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(5, [1.0] * 3)], kind)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(k, 0, 0.0, 0.0, 0.0) for k in (1, 2, 3)]
    mixed = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0] * 12), (4, [2.0] * 12), (5, [2.0, 5.0])], kind)).collect()
    assert Counter((r["vec_id"], r["n"]) for r in mixed) == {(1, 3): 2, (2, 3): 2, (5, 3): 2, (3, 2): 8, (4, 2): 8}
    assert max(r["identity_error"] for r in mixed) < 1e-9 and sum(r["whitened"] ** 2 for r in mixed if r["n"] == 2) == pytest.approx(2)
    assert whitening.deviations(np.array([[2.0**40, 0.0]]), 10**9, [0, 0]) == [None]


def fitting(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = max(((len(h), len(p or ""), v == "block", h.lower() + (p or ""), v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")), default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filters_against_brute_force(spark):
    rng = random.Random(5)
    labels, tails = ["a", "b", "xn", "net", "B", "", "é"], ["", "/", "/a", "/a/", "/a/b", "/ab", "?q=://x.net/", "#f", "/a?b#c", "/é/日"]
    rules = [("net", "/", "block"), ("b.net", "/a", "allow"), ("b.NET", "/a/", "block"), ("a.b.net", None, "allow"), ("a.b.net", "", "block"), ("net", "/a", "allow"), ("", "/", "block"), (None, "/", "block"), ("é", "/é", "block"), ("a", "/" + "x" * 500, "block")]
    rules += [(".".join(rng.choice(labels[:4]) for _ in range(rng.randint(1, 4))), rng.choice(["", "/a", "/a/b"]), "allow") for _ in range(30)]
    rules = list({(h and h.lower(), p or ""): (h, p, v) for h, p, v in reversed(rules)}.values())
    urls = [None, "", "no host", "://", "http://", "http:///x", "http://a/" + "x" * 3000, "HTTP://A.B.Net:80/a", "http://x.net./a", "http://a.b.net/a\nb"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 5)))}{rng.choice(tails)}" for _ in range(400)] + ["http://b.net/a/1"] * 200
    rows = [(k if k % 9 else None, u, "clash", "clash") for k, u in enumerate(urls)] + [(1, urls[20], "x", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rid string, key string").repartition(6)
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(r[0], *fitting(r[1], rules)) for r in rows]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert len({w[3] for w in want}) > 8
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_url_filters_of_nothing(spark):
    none, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    some = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert url_filter.query_rules(spark).count() == 4
    assert url_filter.filter_urls(none, url_filter.query_rules(spark)).count() == 0
    assert [tuple(r) for r in url_filter.filter_urls(some, rules, "block").collect()] == [(1, "a.net", "/x", None, "block")]
    both = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block")], rules.schema)
    assert url_filter.filter_urls(some, both).first()["verdict"] == "block"


def plain_audit(docs, least):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in docs]
    df, n = Counter((g, t) for g, _, w in words for t in set(w)), Counter((g, s, t) for g, s, w in words for t in w)
    groups, out = sorted({(g, s) for g, s, _ in words}), set()
    for lang in {g for g, _ in groups}:
        terms = sorted(t for g, t in df if g == lang and df[g, t] >= least)
        sources = [s for g, s in groups if g == lang]
        shares = {}
        for name, c in [(s, [n[lang, s, t] for t in terms]) for s in sources] + [(None, [sum(n[lang, s, t] for s in sources) for t in terms])]:
            shares[name] = [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(terms)) for x in c]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(map(f, shares[s], shares[o])), o) for o in sources if o != s]
            high = [(f(p, q), t) for t, p, q in zip(terms, shares[s], shares[None], strict=True) if n[lang, s, t] and p > q]
            for part, found in (("pair", pairs), ("term", high)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 10}
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_divergence_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "SPAN", 2)
    rng = random.Random(6)
    words = ["Alpha", "beta", "é", "É", "a1b", "日本", "ALPHA", "x\x00y", "z" * 40, "o'k", "😀", "common", "common"]
    docs = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s10", None])) for _ in range(160)]
    docs += [(None, "en", "none"), ("", "fr", "a"), ("once", "fr", "b"), ("lone " * 20, "xx", "only"), ("common " * 5000, "en", "s1")] + [docs[0]] * 3
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n long").repartition(5)
    got = [tuple(r) for r in divergence.audit(df, least=5, chunk=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, 5)


def test_divergence_of_nothing_and_large_numbers(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    rng = random.Random(7)
    for _ in range(200):
        rows = rng.randrange(1, 1 << 52)
        n = rng.randrange(0, rows + 1)
        assert int(divergence.share(n, rows)) == 1 + 10**9 * n // rows
    text = b"ab " * 10 + b"c" * 50 + b" d"
    divergence_piece = divergence.PIECE
    try:
        divergence.PIECE = 7
        assert [t for p in divergence._pieces(text) for t in p] == text.split()
    finally:
        divergence.PIECE = divergence_piece


def test_tables_of_few_rows_have_few_files_and_rounds(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(base[:k] + [f"v{rng.randrange(5000)}"] + base[k + 1 :]) for k in (5, 25, 45)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files, real = [], common.materialise

    def seen(df, name, *more, **args):
        out = real(df, name, *more, **args)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(common, "materialise", seen)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, words=2).collect()}
        tables, files[:] = list(files), []
        stars = common.components(spark.createDataFrame([(1, k) for k in range(2, 90)] + [(100, 101), (7, 7)], "u long, v long"), rows=90)
        placed = {r["node"]: r["component"] for r in stars.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: k - k % 3 for k in range(180)}
    assert placed == {k: 1 for k in range(1, 90)} | {100: 100, 101: 100}
    most = 2 * spark.sparkContext.defaultParallelism
    assert {name for name, n in tables if n > most} == set() and [name for name, _ in files] == ["components-edges"]
