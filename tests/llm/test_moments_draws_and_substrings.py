"""Whitening, importance resampling and removal of repeated word sequences against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cerulea.llm import resampling, substrings, whitening
from cerulea.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties and columns whose names operators use themselves."""
    rows = [(0, None), (1, ""), (2, " \n "), (3, "alpha " * 30000), (4, "tie"), (5, "tie"), (5, "tie"), (None, "tie"), (None, None), (6, "123 456 !!"), (7, "W" * 300 + " É É")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "score", "own", "same", "copy", "spans", "tie", "row", "n_words", "weight", "x", "n")})


# --- whitening ---------------------------------------------------------------------------------------------------------


def brute_whitening(rows, scale=256):
    """Exact sums by fractions, eigenvectors of the covariance: (deviation, n, whitened, explained) by vector."""
    x = [tuple(math.floor(scale * c) for c in v) for v in rows]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return {v: (sum((n * a - b) ** 2 for a, b in zip(v, s)), n, [float(sum((a - b / n) * c for a, b, c in zip(v, s, u[:, k]))) / math.sqrt(e[k]) for k in range(min(4, d))], [e[k] / e.sum() for k in range(min(4, d))]) for v in fit}


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300, endpoint=True), [0, -1, 1, -(2**63), 2**63 - 1, 2**19, -(2**19), 2**19 - 1]])
    part = whitening.limbs(x)
    assert all(abs(p).max() <= 2**19 for p in part) and [sum(int(p[k]) << (whitening.LIMB * i) for i, p in enumerate(part)) for k in range(len(x))] == x.tolist()
    m = rng.integers(-(2**62), 2**62, (50, 3))
    wide = np.column_stack([m, np.ones(50, np.int64)]).astype(object)
    assert (whitening.moments(m) == wide.T @ wide).all()


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5] + 1000).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(900 + k, base[0]) for k in range(200)] + [(None, base[1]), (0, base[0])]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("n", "dim", "component", "x", "w0")}).repartition(5)
    got = whitening.whitened(v).collect()
    want = brute_whitening(base)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e) for k in range(1, 5))
    x = {i: tuple(math.floor(256 * c) for c in e) for i, e in rows[:60]}
    for k in range(1, 5):
        sign = 0
        for r in (r for r in got if r.component == k and r.vec_id is not None and r.vec_id < 60):
            deviation, n, w, share = want[x[r.vec_id]]
            sign = sign or math.copysign(1, r.whitened * w[k - 1])
            assert r.deviation == deviation and r.n == n == 60 and abs(r.whitened - sign * w[k - 1]) < 1e-8 and abs(r.explained - share[k - 1]) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_far_few_and_flat_vectors(spark):
    far = [(k, [2.0**50 + k * 2.0**40, -(2.0**50) * (k % 3)]) for k in range(12)] + [(50, [1e300, -1e300])]
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(table(far)).collect()
    assert len(got) == 26 and all(r.n == 13 and r.identity_error < 1e-6 for r in got) and all(r.deviation is None for r in got)
    mixed = whitening.whitened(table([(k, [float(k)]) for k in range(4)] + [(9, [1.0, 2.0]), (10, [3.0, float(1)] * 3)])).collect()
    one = {(r.vec_id, r.component): r for r in mixed}
    assert one[0, 1].n == 4 and abs(abs(one[0, 1].whitened) - 1.5 / math.sqrt(1.25)) < 1e-12 and one[9, 1].whitened is None and one[9, 2].explained == 0 and one[10, 4].identity_error is None
    assert whitening.whitened(table([(1, None)])).count() == 0 and whitening.whitened(table([])).count() == 0


def test_whitening_query_on_a_table(spark):
    rows = whitening.op11_digit_whitening(spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in read_table(spark, SF, "embeddings").collect()}
    want = brute_whitening(list(vectors.values()))
    assert len(rows) == 4 * len(vectors)
    for r in rows[:400]:
        deviation, n, w, share = want[tuple(math.floor(256 * c) for c in vectors[r.vec_id])]
        assert (r.deviation, r.n) == (deviation, n) and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-6 and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9


# --- importance resampling ---------------------------------------------------------------------------------------------


def brute_resampling(docs, target, percent=10, least=20, run=1, buckets=10_000, seed=2024):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def spread(text):
        w = word(text)
        return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, run + 1) for k in range(len(w) - n + 1))

    s, t = sum((spread(x) for _, x in docs), Counter()), sum(map(spread, target), Counter())
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for i, text in docs:
        held = spread(text)
        weight = sum(n * gain(b) for b, n in held.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(held.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(word(text)) >= least])
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    return out, [(-a, None if b else c) for a, b, c in able[: percent * len(able) // 100]]


@pytest.mark.parametrize("run", [1, 3])
def test_resampling_against_brute_force(spark, run):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()] + [(None, "word " * 25), (None, "word " * 25), (3, "again " * 30), (9001, "Straße ÉTÉ über " * 30 + "x" * 100), (9002, ""), (9003, None)]
    target = [r.text for r in read_table(spark, SF, "benchmark").collect()] + [None]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), run=run, percent=30).collect()
    want, order = brute_resampling(docs, target, 30, run=run)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(r[:4]) for r in want)
    placed = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [(s, i) for _, s, i in placed] == order and [p for p, _, _ in placed] == list(range(1, len(order) + 1)) and order


def test_resampling_of_odd_rows_and_ties(spark, odd):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = resampling.resampled(odd, odd).collect()
    assert len(rows) == odd.count() and all(r.weight == 0 for r in rows if not r.n_features) and resampling.resampled(none, odd).count() == 0
    assert resampling.resampled(odd, none).where("n_features = 30000").count() == 1
    same = spark.createDataFrame([(7, "tie " * 20)] * 500, "doc_id long, text string").repartition(6)
    drawn = [r["rank"] for r in resampling.resampled(same, none).collect()]
    assert sorted(x for x in drawn if x) == list(range(1, 51)) and drawn.count(None) == 450


def test_blocks_of_the_matrix_are_not_rows_of_a_table(spark, monkeypatch):
    """What is written has a few numbers a document, however long its text; blocks of one text and of many give the same."""
    docs = [(k, " ".join(f"w{(k + 1) * j % 997}" for j in range(30 + 900 * (k % 3)))) for k in range(40)] + [(None, None), (7, "")]
    target = ["w1 w2 w3 w5 w8 " * 9]
    held, kinds = resampling.stored, []
    monkeypatch.setattr(resampling, "stored", lambda df, name: [kinds.extend(kind for _, kind in df.dtypes), held(df, name)][1])
    want, order = brute_resampling(docs, target)
    for size in (1, 5000, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK_CHARS", size)
        assert sum(hi - lo for lo, hi, _ in resampling.csr_blocks([t for _, t in docs], 1, 10_000)) == len(docs)
        got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(r[:4]) for r in want)
        assert [(r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == order
    assert kinds and set(kinds) == {"bigint"}


def test_checksums_of_ranges():
    rng = random.Random(0)
    parts = [bytes(rng.randrange(33, 256) for _ in range(n)) for n in (1, 2, 3, 63, 64, 65, 900, *(rng.randrange(1, 12) for _ in range(200)))]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    assert resampling.crc32_of(data, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(p) for p in parts]


# --- repeated word sequences -------------------------------------------------------------------------------------------


def brute_substrings(docs, words):
    """(n_words, n_removed, text) of each row, in order; rows that repeat id and text are one document."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda i, t: (i is None, i or 0, hashlib.md5((("" if i is None else str(i)) + "\t" + t).encode()).digest())
    first, gone = {}, {}
    for k, t in sorted({(key(i, t), t) for i, t in docs if t is not None}):
        w, out = split(t), set()
        for s in range(len(w) - words + 1):
            if first.setdefault(tuple(w[s : s + words]), (k, s)) != (k, s):
                out |= set(range(s, s + words))
        gone[k] = out
    rows = []
    for i, t in docs:
        w, out = split(t), gone.get(key(i, t), set()) if t is not None else set()
        rows.append((i, len(w), len(out), " ".join(x for k, x in enumerate(w) if k not in out)))
    return Counter(rows)


def planted(seed, words):
    rng = random.Random(seed)
    line = lambda n, most=900: [f"w{rng.randrange(most)}" for _ in range(n)]
    passages = [line(rng.randrange(words, 5 * words)) for _ in range(6)] + [["same"] * 3 * words, (["a", "b", "c"] * words)]
    docs = []
    for i in range(60):
        text = line(rng.randrange(0, 2 * words), 4 if i % 7 == 0 else 900)
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            low = rng.randrange(0, max(1, len(p) - words))
            text += p[low:] + line(rng.randrange(0, 12))
        docs.append((rng.choice([None, i, i, i, i, i - 1]), rng.choice([" ", "\n", "\t "]).join(text)))
    return docs + [docs[5], docs[5], (200, docs[5][1]), (201, docs[5][1].replace(" ", "  ")), (None, None), (3, None), (4, ""), (202, " \n")]


@pytest.mark.parametrize("words", [20, 5, 2])
def test_repeats_against_brute_force(spark, words):
    docs = planted(words, words)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("copy", F.lit("x")).repartition(4)
    got = Counter(map(tuple, substrings.without_repeats(table, words).collect()))
    want = brute_substrings(docs, words)
    assert got == want and sum(r[2] for r in want) > 100


def test_repeats_with_every_join_and_split(spark, monkeypatch):
    """Hot anchors followed to whole windows, many groups, and shuffles in place of broadcasts give the same."""
    docs = planted(9, 20)
    table, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), brute_substrings(docs, 20)
    for hot, rows, most, numbers in ((1, 10, 500_000, 2_000_000), (3, 4, 0, 0), (10**6, 1, 0, 5), (0, 10, 0, 0)):
        for name, value in (("HOT", hot), ("GROUP_ROWS", rows), ("BROADCAST_ROWS", most), ("BROADCAST_NUMBERS", numbers)):
            monkeypatch.setattr(substrings, name, value)
        assert Counter(map(tuple, substrings.without_repeats(table).collect())) == want


def test_repeats_of_odd_rows(spark, odd):
    rows = Counter((r.doc_id, r.n_words, r.n_removed, r.text[:5]) for r in substrings.without_repeats(odd).collect())
    # a word 30,000 times: every window but the first repeats it, so all words but the first go
    assert sum(rows.values()) == odd.count() and rows[3, 30000, 29999, "alpha"] == 1 and rows[5, 1, 0, "tie"] == 2 and rows[None, 0, 0, ""] == 1
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_copies_go_but_for_the_first(spark):
    body = " ".join(f"x{k}" for k in range(60))
    docs = spark.createDataFrame([(k, body) for k in range(300)] + [(k, "a b c") for k in range(300, 310)] + [(-1, body + " tail")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_removed, r.text) for r in substrings.without_repeats(docs).collect()}
    assert rows[-1] == (0, body + " tail") and all(rows[k] == (60, "") for k in range(300)) and all(rows[k] == (0, "a b c") for k in range(300, 310))
