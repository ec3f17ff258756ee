import itertools
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborfold.llm import embedding_dedup, hilbert, html_extract, html_tree, lm_score, minhash_dedup, mixing, packing, sharding, token_files, tokens, topk, toxicity
from arborfold.llm.shingles import word_hashes

DATA = "/root/testdata/sf0.001"
SMALL_TEXTS = [None, "", " ", "a", "Hello  world \n x", "It's <|endoftext|> 12.5% é日本 ", "word " * 300, "a" * 3000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", "clash", "clash") for k, t in enumerate(SMALL_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, node string, rank string").cache()


def plain_ids(text):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    rng, enc = random.Random(2), tokens.Encoder(tokens.tokenizer_path(), limit=64)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "'ll", ".", ",", "1", "<|endoftext|>", "日", "\x1c", "_", "$$", "\r\n", "😀", "word"]
    for text in SMALL_TEXTS + ["".join(rng.choice(alphabet) for _ in range(20)) for _ in range(400)]:
        assert enc.encode(text).tolist() == plain_ids(text)


def test_encoder_takes_texts_together():
    """Texts of a batch, whatever stands where they meet, have the ids that each has alone."""
    rng, enc = random.Random(8), tokens.Encoder(tokens.tokenizer_path(), limit=64)
    alphabet = ["a", "É", " ", " ", "  ", "\n", "\n ", "\t", "'", "'s", "'re", ".", "1", "²", "Ⅷ", "\u0301", "\u180e", "\u200b", "\xa0", "\x85", "\x1c", "\x00", "<|endoftext|>", "日", "😀", "\U000323b0"]
    texts = [None, "", *("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 20]))) for _ in range(1500)), None]
    library = Tokenizer.from_file(tokens.tokenizer_path())
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 100, 1 << 22):
        assert [ids.tolist() for ids in enc.encode_all(pa.array(texts, pa.string()), size)] == want
        assert [ids.tolist() for ids in enc.encode_all(pa.array(texts, pa.string())[3:200], size)] == want[3:200]
    assert list(enc.encode_all(pa.array([], pa.string()))) == [] and next(enc.encode_all(pa.array([None], pa.string()))).size == 0


def test_encoder_asks_once_for_what_repeats(monkeypatch):
    """Words go to the library once, whatever marks or line breaks stand beside them, though few are kept."""
    enc, asked = tokens.Encoder(tokens.tokenizer_path(), limit=64), Counter()
    ids_of = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda part: asked.update([part]) or ids_of(part))
    rng = random.Random(9)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    text = "".join(f"{rng.choice(words)}{mark}" for _ in range(600) for mark in (" ", ", ", ".\n", "!? ", ".")) + "end"
    assert enc.encode(text).tolist() == plain_ids(text)
    assert max(asked.values()) == 1 and len(asked) <= 2 * len(words) + 5


@pytest.mark.parametrize("vocab", [2, 5, 256, 50257, 70000])
def test_pack_round_trip(vocab):
    ids = np.random.default_rng(1).integers(0, vocab, 10_001).astype("<u4")
    bits = token_files.bits_for(vocab)
    assert len(token_files.pack(ids, bits)) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, len(ids)) == ids).all()


def test_token_files(spark, docs, tmp_path):
    more = docs.unionByName(docs.where("doc_id = 6")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    manifest = token_files.write_token_files(more, f"file://{tmp_path}/t", tokens.tokenizer_path(), ids_a_file=500)
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    want = [(None, [0])] + [(k, plain_ids(t) + [0]) for k, t in enumerate(SMALL_TEXTS) for _ in range(2 if k == 6 else 1)]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows] == want
    assert [r["start"] for r in rows] == np.cumsum([0] + [len(i) for _, i in want])[:-1].tolist()
    digest = token_files.read_token_files(manifest, digest=True).orderBy("start").collect()
    assert [r["ids_crc32"] for r in digest] == [zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in want]
    file = token_files.TokenFile(manifest.orderBy("part", "seq").first()["path"])
    assert file.ids(1, 3).tolist() == [i for _, d in want for i in d][1:3]
    none = token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/n", tokens.tokenizer_path())
    assert token_files.read_token_files(none).count() == 0


def best_fit(lengths, window):
    room, used = [], []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        k = min(fits, key=lambda k: (room[k], k)) if fits else len(room)
        if not fits:
            room.append(window)
        used.append((n, k, window - room[k]))
        room[k] -= n
    return used, len(room)


def test_best_fit_decreasing_equals_piece_by_piece():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.choice([1, 2, 3, 5, 7, 8, 13, 16]) for _ in range(rng.randint(0, 60))]
        runs = packing.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, 16)
        placed = [(n, first + g // a, off + g % a * n) for n, lo, hi, a, first, off in runs for g in range(hi - lo)]
        want, windows = best_fit(lengths, 16)
        assert len({s for _, s, _ in placed}) == windows
        assert sorted((n, o) for n, _, o in placed) == sorted((n, o) for n, _, o in want)


def test_packing(docs):
    window = 64
    rows = packing.pack_documents(docs, tokens.tokenizer_path(), window).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: [i for _, p in sorted(v) for i in p] for k, v in by_doc.items()} == {k: plain_ids(t) + [1] for k, t in enumerate(SMALL_TEXTS)}
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= window
    assert packing.pack_digest(docs.limit(0), tokens.tokenizer_path()).count() == 0
    assert packing.padded_length(64) == 64 and packing.padded_length(65) == 2048


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = [(k, (base[k % 30] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3])).tolist()) for k in range(220)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 8)]
    return spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, n string"), rows


def test_embedding_near_dedup(spark):
    df, rows = vectors(spark)
    good = {k: np.array(v) for k, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95}
    comp = {k: k for k, _ in rows}
    for _ in range(len(rows)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=32).collect()}
    assert got == {k: (sum(k in p for p in links), comp[k], comp[k] == k) for k, _ in rows}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_topk(spark):
    df, rows = vectors(spark)
    q = {k: np.floor(256 * np.array(v)) for k, v in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for a in (k for k in q if k % 50 == 0):
        best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a])))[:5]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(best)}
    got = topk.search(df.where("vec_id % 50 = 0"), df.unionByName(df.where("vec_id = 7")), block=3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk.search(df.limit(0), df).count() == 0


def test_minhash(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(400)]
    texts = [None, "", "  ", "one", "One"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts.append(texts[-1])
    rows = list(enumerate(texts)) + [(5, texts[5])]
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} or ({tuple(w)} if w else set())
    comp = {k: k for k in sets}
    for _ in range(20):
        for a, b in combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(None, "one", "x")], "doc_id long, text string, node string")
    for small in (32, 2):  # few buckets in tiles, then most
        got = minhash_dedup.near_duplicates(df, words=2, rounds=1, small=small).where("doc_id IS NOT NULL").collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(k, len(sets[k]), comp[k], comp[k] == k) for k in sets} and len(got) == len(rows)


def test_topk_ties_over_blocks(spark):
    """Equal scores at the last rank, over several blocks of queries and of rows; repeated rows and extra columns."""
    rng = random.Random(5)
    rows = [(k, [float(rng.choice([-1, 0, 1])) for _ in range(4)], "x") for k in range(400)]
    df = spark.createDataFrame(rows + rows[:9], "vec_id long, embedding array<double>, score string").repartition(7)
    q = {k: 256 * np.array(v) for k, v, _ in rows}
    want = set()
    for a in range(0, 400, 10):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:5]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(best)}
    got = topk.search(df.where("vec_id % 10 = 0"), df, block=16, group=2).collect()
    assert len(got) == 200 and {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_topk_survivors_reach_the_cutoff():
    rng = np.random.default_rng(2)
    q, x = (np.floor(256 * rng.normal(size=(n, 16))) for n in (20, 3000))
    whole = (q @ x.T).astype(np.int64)
    lists = topk._lists(16, 4)
    low = np.stack([(q[:, i] @ x[:, i].T).min(axis=1) for i in lists], 1)
    for rank in (1, 5, 3000):
        cutoff = np.sort(whole, axis=1)[:, -rank].astype(np.int64)
        share = low + ((cutoff - low.sum(axis=1)) / 4)[:, None]
        a, c, s = topk.survivors(q, x, cutoff, share, lists)
        assert (whole[a, c] == s).all() and set(zip(a.tolist(), c.tolist(), strict=True)) >= set(zip(*(y.tolist() for y in np.nonzero(whole >= cutoff[:, None])), strict=True))
    big = np.full((2, 3), 2.0**40)
    assert topk.each_product(big, big).tolist() == [(3 << 80) % (1 << 64) - (0 if (3 << 80) % (1 << 64) < 1 << 63 else 1 << 64)] * 2  # whole numbers of 64 bits, as the products


def test_links_between_equals_products():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 20))
    x[50:60] = x[40:50] + 0.01 * rng.normal(size=(10, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.95, 0.2, -1.0):
        short = embedding_dedup.bounded(x)
        want = np.nonzero(x @ x.T >= threshold)
        got = embedding_dedup.links_between(x, x, short, short, threshold)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert (short @ short.T >= x @ x.T - 1e-6).all()


def near_pairs(n, rng):
    """Pairs of texts whose two-word sets have a similarity of 0.80 to 0.85: words in a row are replaced by others."""
    out = []
    for k in range(n):
        size = rng.randint(60, 400)
        a = [f"w{k}x{j}" for j in range(size)]
        low, high = (1 - 0.85) / 1.85 * (size - 1), (1 - 0.80) / 1.80 * (size - 1)
        gone = rng.randint(int(np.ceil(low)), int(high))  # pairs that only one has
        b = list(a)
        at = rng.randrange(0, size - gone)
        for j in range(at + 1, at + gone):
            b[j] = f"v{k}x{j}"
        out.append((" ".join(a), " ".join(b)))
    return out


def test_minhash_recall_at_the_threshold(spark):
    """Of 20,000 such pairs none was missed; of these none may be."""
    pairs = near_pairs(300, random.Random(12))
    for a, b in pairs:
        x, y = (set(zip(t.split(), t.split()[1:], strict=False)) for t in (a, b))
        assert 0.8 <= len(x & y) / len(x | y) <= 0.851
    df = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, words=2).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(300))


def test_minhash_of_nothing_and_of_very_long_texts(spark):
    kind = "doc_id long, text string"
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"w{k % 90_000}" for k in range(150_000))
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], kind)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in rows) == [(1, 1, 90_000), (2, 1, 90_001), (3, 3, 1)]


def test_tiles_and_filters(monkeypatch, spark):
    """Shared shingles of two blocks by column blocks, and class sets by a set of bits and by a join."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k * 100 : k * 100 + 1500], rng.integers(0, 1 << 62, 50, dtype=np.uint64)])) for k in range(12)]
    ids, comp, sig = np.arange(12), np.arange(12), np.zeros((12, 4), "<u2")
    want = {(i, j) for i, j in combinations(range(12), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 64)
    joined = {tuple(sorted((int(u), int(v)))) for x, y in minhash_dedup.tile_links(ids, comp, sig, sets, ids, comp, sig, sets, 0.8, 1e-4) for u, v in zip(x, y, strict=True) if u != v}
    reach = lambda links: {k: min([k, *(min(p) for p in links if k in p)]) for k in range(12)}
    assert joined <= {(min(p), max(p)) for p in combinations(range(12), 2)} and {k for p in joined for k in p} == {k for p in want for k in p} and reach(joined)[11] <= 11
    docs = spark.createDataFrame([(k, f"a b c{k} d e f g") for k in range(50)], "doc_id long, text string")
    signed = minhash_dedup.signatures(docs, 2, minhash_dedup.Scheme())
    needed = signed.where("doc_id % 7 = 0").select("node", signed["doc_id"].alias("rep"))
    by_bits = sorted((r["node"], bytes(r["shingles"])) for r in minhash_dedup._sets(docs, needed, 2).collect())
    monkeypatch.setattr(minhash_dedup, "FEW", 0)
    assert by_bits == sorted((r["node"], bytes(r["shingles"])) for r in minhash_dedup._sets(docs, needed, 2).collect()) and len(by_bits) == 8


def test_least_matches_keeps_likely_pairs():
    assert minhash_dedup.least_matches(280, 0.8, 1e-4) < 0.8 * 280
    assert minhash_dedup.least_matches(40, 0.8, 1e-4) > 0.4 * 40


def test_mixing_equals_sql_and_meets_budget(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = mixing.query(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got["copies"] == want["copies"]).all() and np.allclose(got["expected_copies"], want["expected_copies"])
    assert abs((got["n_tokens"] * got["expected_copies"]).sum() / got["n_tokens"].sum() - mixing.BUDGET) < 0.01


def test_mixing_edges(docs):
    mixed = mixing.mix(docs.withColumn("source", F.when(F.col("doc_id") > 2, F.col("source"))))
    assert mixed.count() == docs.count() and {"node", "rank"} <= set(mixed.columns)
    assert mixed.where("mix_kept IS NULL OR mix_probability NOT BETWEEN 0 AND 1").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_with_copies_meets_the_targets_of_a_hot_source(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source"))).cache()
    raked = mixing.rake(mixing.cells_of(docs))
    capped, whole = (mixing.marginals(f(raked)).toPandas() for f in (mixing.probabilities, mixing.copies))
    assert abs(capped["achieved"] - capped["target"]).max() > 0.02 and abs(whole["achieved"] - whole["target"]).max() < 0.002
    n = mixing.tokens_of(F.col("text"))
    mixed = mixing.mix(docs, repeat=True)
    total, want = mixed.agg(F.sum(n), F.sum(n * F.col("mix_probability"))).first()
    assert abs(want / total - mixing.BUDGET) < 1e-6
    assert mixed.where("abs(mix_copies - mix_probability) >= 1 OR mix_kept <> (mix_copies > 0)").count() == 0
    out = corpus_pipeline.mix(spark, docs, DATA)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("mix_copies")).first()[0]
    target = {r.value: r.target for r in whole.itertuples() if r.dimension == "lang"}
    got = {r["lang"]: r["n"] for r in out.groupBy("lang").agg(F.sum(n).alias("n")).collect()}
    assert all(abs(got[k] / sum(got.values()) - target[k]) < 0.03 for k in target)


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        points = sorted(np.ndindex(*[1 << bits] * dims), key=lambda p: hilbert.index_of(p, bits))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


def test_hilbert_expression(spark):
    df = spark.range(512).selectExpr("id % 8 AS x", "id DIV 8 % 8 AS y", "id DIV 64 AS z")
    rows = df.withColumn("h", hilbert.index([F.col("x"), F.col("y"), F.col("z")], 3)).collect()
    assert all(r["h"] == hilbert.index_of((r["x"], r["y"], r["z"]), 3) for r in rows)


def test_sharding(spark, docs):
    rows = sharding.shard(docs.unionByName(docs), shards=7).collect()
    by = {}
    for r in rows:
        text = SMALL_TEXTS[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def plain_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text, source, lang), worked out in plain Python."""
    code = {}
    for c in (2, 3):
        values = sorted({r[c] for r in rows}, key=lambda v: (v is not None, v or ""))
        code[c] = {v: k * 32 // len(values) for k, v in enumerate(values)}
    done = []
    for doc_id, text, source, lang in rows:
        size = len((text or "").encode()) + 16
        own = hilbert.index_of((code[2][source], code[3][lang], max(0, min(31, int(np.floor(np.log2(size) * 2)) - 8))), 5)
        done.append([doc_id, text, size, zlib.crc32((text or "").encode()), own])
    groups = {}
    for r in done:
        groups.setdefault(r[1], []).append(r)
    late = lambda d: (d is None, d or 0)
    for g in groups.values():
        lead = min(g, key=lambda r: (late(r[0]), r[4]))[4]
        for r in g:
            r.append(lead if len(g) > 1 else r[4])
    order = sorted(done, key=lambda r: (r[5], r[3], r[1] is not None, r[2], r[0] is not None, r[0] or 0))
    total, bound = len(rows), lambda k: -(-k * len(rows) // shards)
    whole, at, out = {}, {}, []
    for k, r in enumerate(order):
        g = groups[r[1]]
        if len(g) > 1 and r[1] not in at:
            at[r[1]] = k
    ahead = {}
    for text in sorted(at, key=at.get):
        s, n = at[text] * shards // total, len(groups[text])
        if ahead.setdefault(s, 0) + n <= bound(s + 1) - bound(s):
            whole[text] = s, ahead[s]
        ahead[s] += n
    held = {s: sum(len(groups[t]) for t, (x, _) in whole.items() if x == s) for s in range(shards)}
    free = [(s, held[s] + k) for s in range(shards) for k in range(bound(s + 1) - bound(s) - held[s])]
    loose = iter(free)
    for k, r in enumerate(order):
        s, slot = (whole[r[1]][0], whole[r[1]][1] + k - at[r[1]]) if r[1] in whole else next(loose)
        out.append((r[0], r[2], r[3], s, slot))
    return out, {zlib.crc32((t or "").encode()): len(groups[t]) for t in whole}


def test_sharding_against_plain_python(spark):
    rng = random.Random(4)
    texts = ["same", "other", None, "", *(f"pair {k}" for k in range(30)), *("x" * rng.randint(1, 3000) for _ in range(20))]
    for n, shards in ((300, 10), (97, 7), (5, 10), (1, 3)):
        rows = [(k if k % 17 else None, rng.choice([rng.choice(texts), f"own {k}", f"own {k}"]), rng.choice(["a", "b", "c", None]), rng.choice(["en", None])) for k in range(n)]
        docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, lang string, place string, rank int").repartition(5)
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, shards=shards).collect()]
        want, whole = plain_shards(rows, shards)
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
        for s in range(shards):
            assert sorted(r[4] for r in got if r[3] == s) == list(range(-(-(s + 1) * n // shards) - -(-s * n // shards)))
        assert all(len({r[3] for r in got if r[2] == crc and crc}) <= 1 for crc in whole)
    assert len(whole) <= 1


def test_sharding_writes_rows_that_repeat_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "s", "en"), (1, "b", "s", "en"), (1, "a", "s", "de"), (None, "c", None, None)], "doc_id long, text string, source string, lang string")
    out = sharding.write(docs, str(tmp_path / "repeated"), shards=2)
    assert sorted(r["text"] for r in out.collect()) == ["a", "a", "b", "c"] and {r["shard"] for r in out.collect()} == {0, 1}


def test_sharding_writes_files_that_prune(spark, tmp_path):
    rows = [(k, f"{k} " + "t" * (1 << (k % 12)), f"s{k % 5}", "en" if k % 3 else "de") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = sharding.write(docs, str(tmp_path / "shards"), shards=20)
    assert out.count() == 600 and set(out.columns) == {"doc_id", "text", "source", "lang", "slot", "shard"}
    for c in ("source", "lang"):  # a value's rows stand in far fewer than all shards
        ranges = out.groupBy("shard").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        assert ranges.where("lo <= 's0' AND 's0' <= hi" if c == "source" else "lo <= 'de' AND 'de' <= hi").count() <= 12


def test_toxicity_learns(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    bad = ["zorgwort", "quibblex", "vexnarf"]

    def text(toxic):
        w = [rng.choice(words[:200] if rng.random() < 0.5 else words) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    rows = [(k, text(k % 3 == 0), k % 3 == 0) for k in range(1800)]  # enough text for zstandard to train on
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, weights string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows if k < 1200] + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[k] >= 0.7, y) for k, _, y in rows if k >= 1200]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and got[9000] == got[9001] < 0.7 and len(got) == 1802
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.where("score <> 0").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0
    kept = [toxicity.train_dictionary([text(y) for _ in range(900)], 16_000) for y in (True, False)]
    assert all(len(d) == 16_000 for d in kept) and b"zorgwort" in kept[0] and b"zorgwort" not in kept[1]
    assert sum(w.encode() in kept[0] for w in words) > 100  # text of the class, no list of its marks


def labelled(sf):
    """(text, toxic, held out) of the labelled documents."""
    rows = duckdb.sql(f"SELECT d.doc_id, text, toxic FROM '/root/testdata/{sf}/documents.parquet' d JOIN '/root/testdata/{sf}/labels.parquet' l ON d.doc_id = l.doc_id ORDER BY hash(d.doc_id), d.doc_id").fetchall()
    return [(text or "", toxic, zlib.crc32(str(k).encode()) % 3 == 1) for k, text, toxic in rows]


def test_toxicity_in_other_words():
    """Held-out rows, and the same with all words in new surroundings, so that no passage of a training text is left."""
    rows = labelled("sf0.1")
    model = toxicity.train([t for t, y, h in rows if y and not h][:2000], [t for t, y, h in rows if not y and not h][:6000])
    held, rng = [(t, y) for t, y, h in rows if h], random.Random(1)

    def shuffled(text):
        words = text.split()
        rng.shuffle(words)
        return " ".join(words)

    for texts in ([t for t, _ in held], [shuffled(t) for t, _ in held]):
        found = toxicity.features(texts, model.toxic, model.ordinary) @ np.array(model.weights) >= np.log(0.7 / 0.3)
        hit = sum(p and y for p, (_, y) in zip(found, held, strict=True))
        assert hit >= 0.4 * sum(y for _, y in held) and hit >= 0.8 * found.sum()


def test_toxicity_edges(spark):
    long = "alpha beta " * 100_000
    docs = spark.createDataFrame([(1, "some text here", "x"), (1, "some text here", "x"), (2, long, "x"), (3, None, "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.weights == ()  # one text is toxic (so labelled once), one is not: too few
    out = toxicity.score(docs, model).collect()
    assert len(out) == 5 and all(r["score"] == 0 for r in out)
    assert toxicity.windows(long)[-1].split()[-1] == b"beta" and len(toxicity.windows(long)) == -(-(200_000 - toxicity.WINDOW) // toxicity.STEP) + 1


def test_html_blocks():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>m</a></nav><div class="cookie-notice">We use cookies</div><div><article>
    <h1>Title &amp; co</h1><p>One<br>two <b>three</b> <span class="ad">buy</span> end<p>Next &nbsp; para<ul><li>a<li>b</ul><aside>rel</aside><form>f<p>in form</p></form><div class="share">s</div>
    <section id="comments"><p>comment</p></section></article></div><aside>side</aside><footer>f</footer></body>"""
    left = [t for _, t, out in html_extract.blocks_of(page)[1] if not out]
    assert left == ["Title & co", "One two three end", "Next para", "a", "b"]
    assert html_extract.blocks_of(None)[1] == [] and html_extract.blocks_of("<p>a<p>b</div>c<")[1][1][1] == "bc<"
    deep = html_extract.blocks_of("<div>" * 3000 + "<p>x</p>")
    assert [t for _, t, _ in deep[1]] == ["x"]


def test_html_induction_needs_no_names(spark):
    rng = random.Random(3)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def page(k):
        menu = "".join(f"<div><a href=/{k}{i}>{w(2)}</a></div>" for i in range(5))
        body = "".join(f"<p>{w(40)}</p>" for _ in range(rng.randint(1, 6)))
        title = w(5)
        more = "".join(f"<li><a href=/r{i}>{w(6)}</a></li>" for i in range(rng.randint(2, 6)))
        html = f"<html><body><div>{menu}</div><div>{w(3)}</div><div><div><h1>{title}</h1>{body}<p>Share this page</p></div><ul>{more}</ul></div><div><span>made by {w(2)}</span><p>All rights kept</p></div></body></html>"
        text = [title, *(p.removesuffix("</p>") for p in body.split("<p>")[1:])]
        return html, "\n".join(text)

    pages = [page(k) for k in range(30)]
    df = spark.createDataFrame([(k if k else None, f"https://h.example/{k}", h) for k, (h, _) in enumerate(pages)] + [(99, "https://h.example/9", pages[9][0]), (100, "https://none.example/", None)], "page_id long, url string, html string")
    rows = html_extract.extract(df, trace=True).collect()
    got = {(r["page_id"], r["url"]): r for r in rows}
    assert len(rows) == 32 and all(got[(k if k else None), f"https://h.example/{k}"]["text"] == t for k, (_, t) in enumerate(pages))
    assert got[99, "https://h.example/9"]["text"] == pages[9][1] and got[100, "https://none.example/"]["text"] == ""
    assert any(r["markup_text"] != r["text"] for r in rows)  # markup alone keeps notices and footers
    assert html_extract.extract(df.limit(0)).count() == 0


def nameless_page(k, rng):
    """A page without a name or semantic tag, with its article's text: menu, notice, article with a list, comments by
    readers (a third of the text), a list of other pages with their leads, a footer."""
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    title, paragraphs, items = w(6), [w(rng.randint(25, 60)) for _ in range(rng.randint(3, 6))], [w(4) for _ in range(rng.choice([0, 3]))]
    listed = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if items else ""
    comments = "".join(f"<div><span>{w(2)}</span><p>{w(rng.randint(15, 35))}</p></div>" for _ in range(rng.randint(2, 4)))
    more = "".join(f"<li><a href=/r{i}>{w(5)}</a><div>{w(9)}</div></li>" for i in range(rng.randint(3, 5)))
    menu = "".join(f"<div><a href=/{k}{i}>{w(2)}</a></div>" for i in range(5))
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + listed
    where = rng.random() < 0.5  # comments beside the article, or in its container
    html = f"<html><body><div>{menu}</div><div>{w(8)}</div><div><div>{inner}{comments if where else ''}</div>{'' if where else f'<div>{comments}</div>'}</div><ul>{more}</ul><div><p>All rights kept by {w(1)}</p></div></body></html>"
    return html, "\n".join([title, *paragraphs, *items])


def test_html_slots_bound_the_content(spark):
    """Of 240 pages on six hosts, each of which keeps comments in one place, all give the article alone."""
    rows, want = [], {}
    for host in range(6):
        for k in range(40):
            rng = random.Random(1000 * host + k)
            rng_random, rng.random = rng.random, lambda host=host: host / 6
            html, text = nameless_page(k, rng)
            rng.random = rng_random
            rows.append((40 * host + k, f"http://h{host}.example/{k}", html))
            want[40 * host + k] = text
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    good = sum(got[k] == want[k] for k in want)
    assert good >= 0.98 * len(want), (good, len(want), [(want[k], got[k]) for k in want if got[k] != want[k]][:1])


def test_html_edges(spark):
    page = "<html><body><article><h1>T</h1><p>text</p></article></body></html>"
    long = "<html><body><article>" + "<p>word word word word</p>" * 50_000 + "</article></body></html>"
    df = spark.createDataFrame([(None, "http://h/1", page, "x"), (1, "http://h/1", page, "x"), (1, "http://h/1", page, "x"), (2, None, long, "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [6, 6, 6, 50_000 * 20 - 1] and {r["page_id"] for r in rows} == {None, 1, 2}


def plain_content(reference, mass, repeats):
    """What ``content_slots`` gives, by looking at every container in turn."""
    nodes, parent = [], {}

    def read(node, up):
        nodes.append(node)
        parent[node[1]] = up
        for kid in node[2]:
            read(kid, node)

    read(html_tree.read_skeleton(reference), None)
    up = lambda n: [] if n is None else [n, *up(parent[n[1]])]
    is_group = lambda n: n[1] in repeats and (n[0] == "li" or n[2] and n[0] in html_extract._GROUPS)
    text = lambda n: sum(plain for slot, (_, plain) in mass.items() if (slot if slot >= 0 else -2 - slot) == n[1])
    grouped = [n for n in nodes if any(map(is_group, up(n)))]
    if not sum(map(text, nodes)):
        return [], []
    apart = sum(map(text, grouped)) <= sum(text(n) for n in nodes if n not in grouped)
    counts = lambda n: not (apart and n in grouped)
    outer = lambda n: is_group(n) and not any(map(is_group, up(parent[n[1]]))) and apart
    below = lambda n: [m for m in nodes if n in up(m)]
    whole = sum(text(n) for n in nodes if counts(n))
    holds = lambda n: sum(text(m) for m in below(n) if counts(m)) >= 0.8 * whole
    region = max((n for n in nodes if all(m is nodes[0] or m[0] in html_extract._HOLDERS and holds(m) and not outer(m) for m in up(n))), key=lambda n: (len(up(n)), -n[1]))
    heads = [k for n in up(region)[1:] for k in n[2] if k[0] in html_extract._HEADINGS]
    inside = [*heads, *below(region)]
    bare = {k[1] for k in heads}
    gone = [m for n in below(region) if outer(n) and (n[0] != "li" or n[2]) and not any(m[0] in html_extract._HEADINGS for m in below(n)) for m in below(n)]
    slots = {s for n in inside for s in ((n[1],) if n[1] in bare else (n[1], -2 - n[1]))}
    lost = {s for n in gone for s in (n[1], -2 - n[1])}
    return sorted(slots), sorted(s for s in slots - lost if mass.get(s, (0, 0))[0] <= mass.get(s, (0, 0))[1])


def test_content_slots_against_brute_force():
    rng = random.Random(9)

    def shape(depth):
        tag = rng.choice(["div", "section", "ul", "p", "li", "h2", "table"]) if depth else "#root"
        kids = [shape(depth + 1) for _ in range(rng.randint(0, 3) if depth < 4 and tag not in ("p", "h2") else 0)] or ([shape(1)] if not depth else [])
        return f"{tag}({' '.join(kids)})" if kids else tag

    seen = 0
    for _ in range(400):
        reference = shape(0)
        n = len([t for t in reference.replace("(", " ").replace(")", " ").split()])
        mass = {s: (rng.choice([0, 0, 50]), rng.choice([0, 5, 100])) for k in range(n) for s in ((k, -2 - k) if rng.random() < 0.2 else (k,)) if rng.random() < 0.7}
        repeats = {k for k in range(n) if rng.random() < 0.3}
        assert html_extract.content_slots(reference, mass, repeats) == plain_content(reference, mass, repeats), (reference, mass, repeats)
        seen += bool(html_extract.content_slots(reference, mass, repeats)[0])
    assert seen > 300


def test_tree_matching_against_brute_force():
    rng = random.Random(2)

    def tree(depth):
        return (rng.choice("ab"), 0, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def brute(a, b):
        if a[0] != b[0]:
            return 0
        best = 0
        x, y = a[2], b[2]
        for n in range(min(len(x), len(y)) + 1):
            for i in itertools.combinations(range(len(x)), n):
                for j in itertools.combinations(range(len(y)), n):
                    best = max(best, sum(brute(x[p], y[q]) for p, q in zip(i, j, strict=True)))
        return 1 + best

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert html_tree.match(a, b)[0] == brute(a, b)


def left_of(body):
    return [t for _, t, out in html_extract.blocks_of(f"<html><body>{body}</body></html>")[1] if not out]


def test_html_keeps_outermost_regions_and_siblings():
    long = "long text " * 20
    body = long.strip()
    assert left_of(f"<p>site<div class=post><h1 class=entry-title>Title</h1><p class=post-lead>lead<div class=entry-content><p>{long}</div></div>") == ["Title", "lead", body]
    assert left_of(f"<main>intro<div class=content><p>{long}</div><p>end</main><p>outside") == ["intro", body, "end"]
    assert left_of(f"<main><header><h1>Title</h1><p>by me</header><p>{long}</main>") == ["Title", body]
    assert left_of(f"<article>one</article><article>{long}<article>nested</article></article><ul><li><article>other</article></ul>") == ["one", body, "nested"]
    assert left_of(f"<ul><li><article>one</article><li><article>{long}</article></ul>") == ["one", body]
    assert left_of(f"<div><article>see also</article></div><main>{long}</main>") == [body]
    assert left_of(f"<article>see also</article><div id=content>{long}</div>") == [body]
    assert left_of(f"<h1 class=entry-title>Title</h1><p>by<div class=entry-lead>lead</div><div class=entry-content>{long}</div>") == ["Title", "lead", body]


def test_html_names_rule_out_no_holder_of_the_article():
    long = "long text " * 20
    body = long.strip()
    assert left_of(f"<div class='layout with-sidebar'><article><p>{long}</article><div class=sidebar>side</div></div>") == [body]
    assert left_of(f"<div class='layout with-sidebar'><p>{long}</div>") == [body]
    assert left_of(f"<div class='content no-sidebar'><p>{long}</div><p>outside") == [body]
    assert left_of(f"<article class='post comments-open'><p>{long}<div class=post-comments>c</div></article>") == [body]
    assert left_of(f"<div class=sidebar-layout><article class='post share'>{long}</article><article class='post share'>two</article></div>") == [body, "two"]
    assert left_of(f"<article>teaser</article><div id=social-page><main>{long}</main></div>") == [body]
    assert left_of(f"<main>intro<div class=sidebar-right><div class=content>{long}</div></div></main>") == ["intro", body]
    assert left_of("<div class=promo-page><main>short</main></div><p>a longer paragraph") == ["short"]
    assert left_of(f"<article>short<div class=entry-header><h1>Title</h1></div></article><div class=comments><article class=comment>{long}</article></div>") == ["short", "Title"]
    assert left_of(f"<p>{long}<div class=footer><div class=footer-content>f</div></div><div class=related><article>t</article></div>") == [body]


def test_html_template_goes_and_copies_stay(spark):
    words = [f"w{k}" for k in range(500)]
    rng = random.Random(9)

    def page(body):
        return f"<html><body><div><p>Subscribe to our letter today</p>{body}<p>All rights reserved by us</p></div></body></html>"

    bodies = ["".join(f"<p>{' '.join(rng.choice(words) for _ in range(12))}</p>" for _ in range(rng.randint(2, 5))) for _ in range(20)]
    bodies += [bodies[0]] * 30
    rows = [(k, f"http://h.org/{k}", page(b), "x") for k, b in enumerate(bodies)] + [(90, None, None, "x"), (91, "http://o.org/", "", "x"), (92, "http://o.org/1", page("<p>alone here</p>"), "x")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for k, b in enumerate(bodies):
        assert got[k] == "\n".join(b[3:-4].split("</p><p>"))
    assert got[90] == got[91] == "" and got[92] == "Subscribe to our letter today\nalone here\nAll rights reserved by us"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lm_score(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "the the")], "doc_id long, text string"))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = df.withColumn("train", ~F.coalesce(held, F.lit(False))).cache()
    got = lm_score.score_documents(rows).collect()
    texts = [((r["text"] or "").encode().lower().split() + [None], r["train"]) for r in rows.collect()]
    count = Counter(w for t, train in texts if train for w in t)
    n, v = sum(count.values()), len(count)
    base = sorted(round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t), 6) for t, _ in texts)
    assert np.allclose(sorted(r["base_score"] for r in got), base) and {r["train_tokens"] for r in got} == {n}
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def plain_lm_scores(texts):
    """Scores of (words, train) texts by counts alone (weights of 0), worked out word by word."""
    hashed = {w: int(word_hashes(w)[1][0]) if w is not None else int(lm_score.END) for t, _ in texts for w in t}
    learnt = [t for t, train in texts if train]
    count, pair = Counter(w for t in learnt for w in t), Counter((b, w) for t in learnt for b, w in zip([""] + t[:-1], t, strict=True))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    head = sorted(count, key=lambda w: (-count[w], signed(hashed[w])))[: lm_score.HEAD]
    rank = {w: k for k, w in enumerate(head)}
    heads, bands = lm_score.HEAD // lm_score.CLASS, len(lm_score.BANDS)
    band = lambda c: int(lm_score.band(np.array([c]))[0])
    cls = lambda w: rank[w] // lm_score.CLASS if w in rank else heads + band(count[w])
    of_class, of_band, types = Counter(), Counter(), Counter()
    for w, c in count.items():
        if w in rank:
            of_class[rank[w] // lm_score.CLASS] += c
        else:
            of_band[band(c)] += c
            types[band(c)] += 1
    mass = {k: of_class[k] for k in range(heads) if of_class[k]} | {heads: of_band[1]} | {heads + k: of_band.get(k + 1, 0) for k in range(1, bands) if types[k]}
    total = sum(m + 0.5 for m in mass.values())
    seen, kinds, once, twice = Counter(), Counter(), Counter(), Counter()
    for (b, w), c in pair.items():
        seen[b, cls(w)] += c
        kinds[b, cls(w)] += 1
        once[cls(w)] += c == 1
        twice[cls(w)] += c == 2
    out = []
    for t, _ in texts:
        score = 0.0
        for b, w in zip([""] + t[:-1], t, strict=True):
            k = cls(w)
            q = count[w] / of_class[k] if w in rank else max(count[w], 1) / max(of_band[band(count[w])] if count[w] else 1, 1)
            d = (once[k] + 0.5) / (once[k] + 2 * twice[k] + 0.5)
            n = seen[b, k]
            p = (max(pair[b, w] - d, 0) + d * kinds[b, k] * q) / n if n else q
            score += np.log10((mass[k] + 0.5) / total * p)
        out.append(score)
    return out


def test_lm_scores_against_plain_counts(spark):
    """More words than the head holds, frequent words that stand before many, and words that training does not have."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(2500)]
    docs = [(k, " ".join(rng.choice(words[:3] if rng.random() < 0.3 else words[:80] if rng.random() < 0.5 else words) for _ in range(rng.randint(1, 120))), k % 4 != 0) for k in range(200)]
    docs += [(900, "only here twice only here", False), (901, "", True), (902, None, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean").repartition(5)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(df, rate=0.0, tokens_a_chunk=700).collect()}
    want = plain_lm_scores([((t or "").encode().split() + [None], train) for _, t, train in docs])
    assert np.allclose([got[k] for k, _, _ in docs], want, rtol=1e-4, atol=1e-3)


def test_lm_probabilities_add_up():
    counts = [50, 20, 9, 3, 1, 1, 2, 1]
    stats = [float(len(counts)), float(sum(counts))]
    for k in range(len(lm_score.BANDS)):
        own = [c for c in counts if lm_score.band(np.array([c]))[0] == k]
        stats += [float(len(own)), float(sum(own))]
    m = lm_score._start(stats, [(k + 1, c) for k, c in enumerate(counts[:4])])
    p = lm_score.predict(m, lm_score.rows_of(np.array([5]), np.array([6])))[0]
    head = lm_score.predict_head(m, np.array([0]), np.array([3]))[0]
    words = [p[0] * head[k] for k in range(4)] + [p[lm_score.HEAD // lm_score.CLASS + lm_score.band(np.array([c]))[0]] * c / m.sums[lm_score.band(np.array([c]))[0]] for c in counts[4:]]
    assert abs(sum(words) + p[lm_score.HEAD // lm_score.CLASS] - 1) < 1e-5


def test_lm_context_grows_with_the_input(spark):
    assert lm_score.bits_for(4_000_000) == 12 and lm_score.bits_for(10**8) > 12 and lm_score.bits_for(10**10) > lm_score.bits_for(10**8)
    assert lm_score.band(np.array([200]))[0] < lm_score.band(np.array([2000]))[0] < lm_score.band(np.array([10**9]))[0]
    # 4,000 tokens with equal counts, most outside the head, each known by the one before alone
    words = [f"w{k}" for k in range(4000)]
    rng, rows = random.Random(3), []
    for k in range(400):
        at = rng.sample(range(0, 4000, 2), 100)
        rows.append((k, " ".join(f"{words[a]} {words[a + 1]}" for a in at), k < 300))
    shuffled = [(1000 + k, " ".join(f"{words[a]} {words[b]}" for a, b in zip(rng.sample(range(0, 4000, 2), 100), rng.sample(range(1, 4000, 2), 100), strict=True)), False) for k in range(100)]
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(spark.createDataFrame(rows + shuffled, "doc_id long, text string, train boolean")).collect()}
    told = np.mean([got[k] for k in range(300, 400)]) - np.mean([got[1000 + k] for k in range(100)])
    assert told > 100  # a decade for each of the 100 tokens that have their own token before


def test_lm_inside_class_adds_up():
    q, own = np.array([0.5, 0.25, 0.125, 0.125]), np.array([3, 1, 0, 0])
    for d in (0.3, 1.0):
        assert abs(lm_score.inside_class(q, own, np.full(4, 4), np.full(4, 2), np.full(4, d)).sum() - 1) < 1e-12
    assert (lm_score.inside_class(q, own * 0, np.zeros(4, int), np.zeros(4, int), np.full(4, 0.5)) == q).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = out.cache()
        assert 0.5 * len(ids) < kept.count() <= len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_pipeline_copies_go_row_by_row(spark):
    import corpus_pipeline

    one, near = " ".join(f"a{k}" for k in range(100)), " ".join(f"a{k}" for k in range(99))
    rows = [(1, one), (2, near), (2, "a text of its own that nothing else is like"), (3, "said twice " * 9), (3, "said twice " * 9), (None, "no id here at all " * 9), (None, "no id here at all " * 9), (None, one), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_copies(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5], rows[8], rows[9]], key=str)


def test_pipeline_takes_nulls_and_nothing(spark):
    """Every stage on rows with nulls in any column and on none; columns of the stages' own names are kept or replaced as stated."""
    import corpus_pipeline

    rows = [(None, None, None, None, None, 1.0), (1, "", "en", None, 0, 2.0), (1, "", "en", None, 0, 2.0), (2, "some words here", None, "s", 15, 3.0), (3, "word " * 5000, "de", "s", 25_000, 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), DATA)
        assert none.count() == 0
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3}
        else:
            assert out.columns == none.columns == docs.columns
            kept = Counter(tuple(r) for r in out.collect())
            assert set(kept) <= set(rows) and (name == "mixing" or set(kept) == set(rows)) and (name != "near_dedup" or kept[rows[1]] == 2)


def test_pipeline_packs_token_ids(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.pack(spark, docs, DATA).orderBy("doc_id", "start").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {k: plain_ids(t) + [1] for k, t in enumerate(SMALL_TEXTS)}


def test_mixing_takes_topics_and_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("about", F.when(F.col("doc_id") % 4 == 0, "law").when(F.col("doc_id") % 4 == 1, "art"))
    want = {"topic": {"law": 2, "art": 1, None: 1, "absent": 5}}
    mixed = mixing.mix(docs, repeat=True, topic="about", targets=want).groupBy("about").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("n")).collect()
    total = sum(r["n"] for r in mixed)
    assert all(abs(r["n"] / total - {"law": 0.5, "art": 0.25, None: 0.25}[r["about"]]) < 0.001 for r in mixed) and len(mixed) == 3


def test_added_strings_are_the_library_s(spark):
    """A text with an added string has the ids that the stated call gives."""
    path = tokens.tokenizer_path()
    plain = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n", "a <|endoftex|> b", "<|end oftext|>"):
        assert enc.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_lm_edges(spark):
    """Empty tables, no training rows, very long texts, repeated rows and clashing columns; scores by their definitions."""
    kinds = "doc_id long, text string, train boolean, score string, chunk string"
    rows = [(1, "a b c " * 30_000, True, "s", "c"), (1, "a b c", True, None, None), (1, "a b c", True, None, None), (None, "", False, None, None), (3, None, True, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    got = lm_score.score_documents(docs).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [1, 1, 4, 4, 90_001]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got) and {r["train_tokens"] for r in got} == {90_010}
    held = lm_score.score_documents(docs.withColumn("train", F.lit(False))).collect()
    assert len(held) == 5 and all(r["base_score"] == 0 for r in held)
    assert lm_score.score_documents(docs.limit(0)).count() == 0
