"""Operators for training data: odd rows, brute force, held-out accuracy and properties."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cerulea.llm import decontam, langid, licenses, linededup, mixing, neardup, pii, quality, sharding, stages, topk
from cerulea.llm.common import read_table, sample_texts
from cerulea.llm.graph import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties and columns whose names operators use themselves."""
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n ", "en", "a", 3), (3, "alpha " * 30000, "en", None, 1), (4, "tie", "de", "b", 3), (5, "tie", "de", "b", 3), (5, "tie", "de", "b", 3), (None, "tie", "de", "b", 3), (6, "123 456 !!", "fr", "c", 9)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("rank", "size", "shard", "block", "score", "rep", "node", "lines", "h", "gone", "w", "part", "lang_pred")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_mixing_is_whole_and_less_than_a_block_off(spark, odd, none):
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(none).count() == 0
    docs = read_table(spark, SF, "documents")
    rows = mixing.mixed(docs, {f"src{k}": k + 1 for k in range(20)}, block_rows=1).collect()
    assert len(rows) == docs.count() and all(r.release <= r.mix_slot < r.deadline for r in rows)
    slots = {"a": 3, "b": 5, "c": 1}
    sent = Counter()
    for t, (s, _, _) in enumerate(sorted(mixing.one_period(slots), key=lambda x: x[2]), 1):
        sent[s] += 1
        assert all(abs(sent[x] - t * w / 9) < 1 for x, w in slots.items())


def test_sharding_is_gapless_and_near_equal(spark, odd, none):
    for docs in (odd, read_table(spark, SF, "documents")):
        by = defaultdict(list)
        for r in sharding.shard(docs, 4).collect():
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == docs.count()
    assert sharding.shard(none).count() == 0
    size = {s: random.Random(s).randrange(1, 500) for s in range(400)}
    new = sharding.rebalanced(sharding.initial_map(400, 7), size, 7)
    loads = Counter()
    for s, k in enumerate(new):
        loads[k] += size[s]
    assert max(loads.values()) - min(loads.values()) <= 0.002 * max(loads.values())
    more = sharding.grown(new, size, 7)
    assert all(a == b or b == 7 for a, b in zip(new, more)) and 7 in more


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)] + [(200, None), (201, [float("nan")] * 6), (202, []), (203, [None] * 6), (None, [1.0] * 6), (204, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in topk.top_k(v.where("vec_id % 20 = 0"), v, 7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    held = {i: np.floor(64 * np.array(e)).astype(int) for i, e in rows[:120]}
    for q in range(0, 120, 20):
        best = sorted((-int(held[q] @ e), i) for i, e in held.items() if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 120, 20)) and topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_license_blocks(spark, odd, none):
    docs = spark.createDataFrame([(0, "x\nLICENSED under the Apache license, version 2.0!"), (1, "cc by cc by all rights reserved"), (2, "Licensed under the apache"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert rows[0].labels == "apache-2.0" and rows[0].n_base == 0 and rows[0].score == 1
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert rows[2].labels == "" and rows[3].n_words == 0 and rows[3].first_word is None
    assert licenses.scanned(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and licenses.scanned(none).count() == 0


def test_license_labels_by_row_and_beyond_ascii(spark):
    """Each row has the labels of its own text: one id with other texts, null ids, repeated rows; a template with letters that only the A-Z rule keeps apart."""
    own = (*licenses.TEMPLATES, ("etat", "ÉTAT ÖL ΑΣ"))
    texts = ["x\n" + t for _, t in own] + ["plain", None, "ÉTAT ÖL ΑΣ.Α", "état öl ας", "Released under\nthe MIT License."]
    rows = [(1 if k % 2 else None, t, None, None, 0) for k, t in enumerate(texts)] + [(7, "Released under the MIT License.", "en", "a", 1)] * 2
    want = Counter()
    for i, text, *_ in rows:
        lines = [set(licenses.tokens(x)) for x in (text or "").split("\n")]
        hit = {label for label, t in own if any(len(b & set(licenses.tokens(t))) >= licenses.needed(len(licenses.tokens(t)), licenses.CONTAINMENT) for b in lines)}
        flat = " " + " ".join(re.findall(licenses.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))) + " "
        want[i, ",".join(sorted(hit | {label for phrase, label in licenses.PHRASES if f" {phrase} " in flat}))] += 1
    got = Counter((r.doc_id, r.labels) for r in licenses.scanned(spark.createDataFrame(rows, DOC), own).collect())
    assert got == want and any("etat" in k[1] for k in got)


def test_pii_patterns_against_regular_expressions(spark, odd, none):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "1", "22", ".", "@", "-", " ", "+", "(", "x.y", "4111111111111111", "+1 (415) 555-0132", "10.0.0.1"]) for _ in range(rng.randrange(1, 14)))
        ok = (lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 14 <= len(pii._digits(x)) <= 19 and pii._luhn(pii._digits(x)), lambda x: 10 <= len(pii._digits(x)) <= 15)
        patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
        assert pii.base_spans(text) == sorted((m.start(), k, m.end()) for k, (p, f) in enumerate(zip(patterns, ok)) for m in re.finditer(p, text) if f(m[0])), text
    model = pii.train(read_table(spark, SF, "documents"))
    rows = pii.marked(odd, model).collect()
    assert len(rows) == odd.count() and all(r.n_card == 0 for r in rows)
    assert pii.marked(none, pii.train(none)).count() == 0


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert quality.scored(odd, None).count() == odd.count() and quality.scored(none, quality.train(none, labels)).count() == 0


def test_quality_knows_words_and_not_only_how_they_are_written(spark):
    """Texts of one form whose label lies in their words alone; with other letters in place of theirs, scores change."""
    rng = random.Random(5)
    good, bad = ([w for w in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))] for _ in range(2))
    made = [(k, " ".join(rng.choice((bad, good)[k % 2] if rng.random() < 0.8 else good + bad) for _ in range(40)), k % 2) for k in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string, quality int")
    model = quality.train(docs, docs)
    rows = quality.scored(docs, model).where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == r.doc_id % 2 for r in rows) >= 0.95 * len(rows)
    other = docs.withColumn("text", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"))
    new = {r.doc_id: r.score for r in quality.scored(other, model).collect()}
    assert sum(abs(new[r.doc_id] - r.score) > 0.05 for r in rows) >= 0.9 * len(rows)


def test_quality_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, empty) is None
    same = quality.train(odd, spark.createDataFrame([(4, 1), (6, 1), (1, 1), (1, None), (None, 0)], "doc_id long, quality int"))
    assert all(r.score == 1.0 for r in quality.scored(odd, same).collect())


def test_language_on_held_out_rows(spark, odd, none):
    docs = read_table(spark, SF, "documents")
    model = langid.train(docs)
    rows = langid.identified(docs, model).where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    found = [(r.doc_id, r.lang_pred) for r in langid.identified(odd, model).collect()]
    assert len(found) == odd.count() and {(0, "und"), (1, "und"), (2, "und"), (6, "und")} <= set(found)
    assert langid.identified(none, langid.train(none)).count() == 0


def test_chains_of_many_languages_stay_within_their_memory(monkeypatch):
    """Whole chains give what pieces give, and hold no matrices."""
    rng = np.random.default_rng(8)
    emit, step, first = rng.random((3000, 12)) + 0.01, rng.random((12, 12)) + 0.1, np.array([0, 7, 2500])
    forward, p = langid.forward_backward(emit, step, first)
    monkeypatch.setattr(langid, "FEW", 1)
    again = langid.forward_backward(emit, step, first)
    assert np.allclose(forward, again[0]) and np.allclose(p, again[1])
    emit, step = rng.random((20_000, 200)) + 0.01, rng.random((200, 200)) + 0.1
    tracemalloc.start()
    _, p = langid.forward_backward(emit, step, np.arange(0, 20_000, 50))  # 400 chains: their matrices alone would be 128 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * emit.nbytes < 400 * 200**2 * 8 * 2 and np.allclose(p.sum(1), 1)


def test_chains_in_pieces_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    emit, step, first = rng.random((500, 3)) + 0.01, rng.random((3, 3)) + 0.1, np.array([0, 1, 200])
    _, p = langid.forward_backward(emit, step, first)
    for lo, hi in ((0, 1), (1, 200), (200, 500)):
        a, b = [np.full(3, 1 / 3)], [np.ones(3)]
        for e in emit[lo:hi]:
            a.append((a[-1] @ step) * e / ((a[-1] @ step) @ e))
        for e in emit[lo + 1 : hi][::-1]:
            x = step @ (e * b[-1])
            b.append(x / x.sum())
        q = np.array(a[1:]) * np.array(b[::-1])
        assert np.allclose(p[lo:hi], q / q.sum(1, keepdims=True))


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in texts}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sets, root


def test_sets_are_alike_with_and_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b c d e f {k % 3}") for k in range(9)] + [(None, "a b c d e f 0"), (4, None)], "doc_id long, text string")
    nodes = docs.where("text is not null").select(neardup.row_key().alias("own"), F.coalesce("doc_id", F.lit(99)).alias("node")).where("node < 4 or node = 99")
    found = []
    for most in (neardup.BROADCAST_NODES, 2):
        monkeypatch.setattr(neardup, "BROADCAST_NODES", most)
        found.append(sorted(map(tuple, neardup.shingles_of(docs, nodes, 5).collect())))
    assert found[0] == found[1] and [n for n, _ in found[0]] == [0, 1, 2, 3, 99] and all(len(x) == 3 for _, x in found[0])


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng, texts = random.Random(2), {}
    for i in range(160):
        if i % 4 and rng.random() < 0.7:
            w = texts[rng.randrange(i)].split() or ["x"]
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 4, 5, 40, 90])))
    sets, root = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.grouped(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}
    rows = [(r.doc_id, r.component_id, r.kept) for r in neardup.grouped(odd).collect()]
    assert len(rows) == odd.count() and rows.count((5, 4, False)) == 2 and (None, None, True) in rows and (1, 1, True) in rows
    assert neardup.grouped(none).count() == 0


def test_near_copies_that_are_linked_hand_on_no_more_links(spark, monkeypatch):
    """All of a large group of near copies are linked by the pivots they meet most; their links to other pivots are never formed."""
    rng, texts = random.Random(5), {}
    base = [rng.choice(WORDS) + str(k) for k in range(200)]
    for i in range(400):
        w = list(base)
        w[rng.randrange(len(w))] = f"own{i}"
        w[rng.randrange(len(w))] = f"own{i}"
        texts[i] = " ".join(w)
    seen, agreeing = [], neardup.agreeing
    monkeypatch.setattr(neardup, "agreeing", lambda links, *more: (seen.append(links.count()), agreeing(links, *more))[1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in neardup.grouped(docs).collect()} == {0}
    signed = neardup.signatures(docs).withColumn("node", F.col("doc_id"))
    met = neardup.candidates(signed, neardup.HALF_KEYS, neardup.MINHASHES).cache()
    every = met.select(F.sum(F.size("pivots"))).first()[0]
    alone = spark.createDataFrame([], "node long, root long")
    assert every > 2 * len(texts) and sum(seen) < 1.1 * len(texts) and neardup.links_between(met, alone).count() == every


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    item = [rng.choice(WORDS) + str(k) for k in range(40)]
    near = item[:20] + ["changed"] + item[21:]
    far = [x if k % 4 else "no" for k, x in enumerate(item)]
    noise = [rng.choice(WORDS) for _ in range(300)]
    docs = spark.createDataFrame([(0, " ".join(noise + item)), (1, " ".join(noise[:7] + near + noise).upper()), (2, " ".join(far + noise)), (3, None), (4, " ".join(item[:34]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.leaks(docs, items).collect()}
    assert set(rows) == {0, 1, 4} and rows[0].start_word == 300 and rows[0].similarity == 1 and rows[1].start_word == 7
    assert decontam.leaks(odd, items).count() == 0 and decontam.leaks(none, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_line_dedup(spark, odd, none):
    body = "\n".join(f"line {k} of a passage" for k in range(30))
    docs = spark.createDataFrame([(0, "own\n" + body), (1, "other\nwords\n" + body + "\nend"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in linededup.without_repeats(docs).collect()}
    assert rows[0].text == "own\n" + body and rows[1].n_removed > 15 and rows[1].text.startswith("other\nwords") and rows[1].text.endswith("end")
    assert rows[2].text is None and rows[3].text == "" and linededup.without_repeats(odd).count() == odd.count() and linededup.without_repeats(none).count() == 0


def test_passages_go_whole(spark, odd, none):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n))
    planted = [[line(20) for _ in range(n)] for n in (2, 3, 4, 5, 6)] * 4 + [["head", "", "", "", "foot"]] * 2
    texts = {k: [line(6) for _ in range(rng.randrange(1, 4))] + p + [line(6) for _ in range(rng.randrange(1, 4))] for k, p in enumerate(planted)}
    texts |= {100 + k: texts[k] for k in range(20)} | {200: ["", "", "x", "y", "", ""], 201: ["", "", "x", "y", "", ""], 202: ["own", "head", "own too"], 203: ["z"] * 4}
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()] + [(5, "same id\nother text"), (None, "null\nid"), (None, "null\nid"), (300, None), (301, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.n_lines): r for r in linededup.without_passages(docs.repartition(3)).collect()}
    for k, p in enumerate(planted):
        own = texts[k] if k < 5 or k == 20 else [x for x in texts[k] if x not in p]
        r = rows[k, len(texts[k])]
        assert r.text.split("\n") == own and r.n_removed == len(texts[k]) - len(own)
    assert all(rows[100 + k, len(texts[k])].text == "" and rows[100 + k, len(texts[k])].n_removed == len(texts[k]) for k in range(20))
    assert rows[200, 6].n_removed == 0 and rows[201, 6].n_removed == 6 and rows[202, 3].n_removed == 0 and rows[203, 4].text == "z"
    assert rows[5, 2].text == "same id\nother text" and rows[None, 2].n_removed == 0 and rows[300, 0].text is None and rows[301, 1].text == ""
    assert linededup.without_passages(odd).count() == odd.count() and linededup.without_passages(none).count() == 0


def test_passages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    first, gone, lines = {}, defaultdict(set), {r.doc_id: r.text.split("\n") for r in docs.where("text IS NOT NULL").collect()}
    for i in sorted(lines):
        for k, two in enumerate(zip(lines[i], lines[i][1:])):
            if "".join(two).strip() and first.setdefault(two, (i, k)) != (i, k):
                gone[i] |= {k, k + 1}
    got = {r.doc_id: (r.n_removed, r.text) for r in linededup.without_passages(docs).where("text IS NOT NULL").collect()}
    assert got == {i: (len(gone[i]), "\n".join(x for k, x in enumerate(v) if k not in gone[i])) for i, v in lines.items()} and gone


A, B = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
AGAIN = [(1, A), (1, B), (2, A + " tail"), (3, B + " tail"), (None, A + " tail"), (None, B), (None, "q w e"), (None, "q w e"), (2, A + " tail"), (5, None), (5, None), (6, "")]


@pytest.mark.parametrize("step", [1, -1])
def test_rows_of_one_id_and_of_none_are_told_apart(spark, step):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in AGAIN[::step]], DOC).withColumn("own", F.lit("x")).repartition(3)
    short = lambda t: (t or "")[:3] + (t or "")[-4:]
    rows = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept, r.stays) for r in neardup.grouped(docs).collect())
    assert rows == Counter({(1, 56, 1, True, True): 2, (2, 57, 1, False, False): 2, (3, 57, 1, False, False): 1, (None, 57, None, True, False): 1, (None, 56, None, True, False): 1, (None, 1, None, True, True): 2, (5, 0, 5, True, True): 2, (6, 0, 6, True, True): 1})
    left = Counter((r.doc_id, short(r.text)) for r in stages.drop_near_duplicates(spark, docs, "").collect())
    assert left == Counter({(1, short(A)): 1, (1, short(B)): 1, (None, short("q w e")): 1, (5, ""): 2, (6, ""): 1})
    items = spark.createDataFrame([(7, A), (7, B), (None, "c " * 30), (8, None)], "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.start_word) for r in decontam.leaks(docs, items).collect())
    assert found == Counter({(1, 7, 0): 2, (2, 7, 0): 1, (3, 7, 0): 1, (None, 7, 0): 2})


def test_no_line_goes_uncompared(spark):
    body, own = "\n".join(f"line {k} of a passage" for k in range(30)), "\n".join(f"unique {k}" for k in range(12))
    docs = spark.createDataFrame([(1, body), (2, body), (2, own), (None, own.replace("unique", "single") + "\nx"), (None, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_lines): r for r in linededup.without_repeats(docs).collect()}
    assert rows[2, 12].text.startswith("unique 0") and rows[1, 30].n_removed == 0 and rows[2, 30].n_removed > 15 and rows[None, 13].n_removed == 0
    many = spark.createDataFrame([(k, f"own {k}\n" + body) for k in range(2500)], "doc_id long, text string")
    assert linededup.without_repeats(many).where("n_removed > 15").count() == 2499


def test_windows_near_an_item_are_found_by_their_fingerprints(spark):
    """Items with up to two words changed, from 0.75 on: what the radius loses against no radius at all."""
    rng = random.Random(11)
    items, texts = [], []
    for k in range(400):
        w = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(rng.randrange(30, 90))]
        items.append((k, " ".join(w)))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append((k, " ".join([rng.choice(WORDS) for _ in range(rng.randrange(40))] + w + [rng.choice(WORDS) for _ in range(40)])))
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, table, 63).collect()}
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs, table).collect()}
    assert len(every) > 250 and set(found) <= every and len(found) >= 0.99 * len(every) and sum(x < 0.9 for x in found.values()) > 50


def test_shared_weight_counts_repeats(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(9))], [rng.randrange(6) for _ in range(rng.randrange(9))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontam.shared_weight("a", "b").alias("n")).collect()
    assert all(r.n == sum((Counter(r.a) & Counter(r.b)).values()) for r in got)


def test_mixing_of_far_null_and_repeated_ids(spark):
    ids = [-(2**63), 2**63 - 1, None, None, 7, 7, 7, *range(200)]
    docs = spark.createDataFrame([(i, "t", "en", "hot" if k % 3 else None, 1) for k, i in enumerate(ids)], DOC).repartition(5)
    rows = mixing.mixed(docs, block_rows=4).collect()
    at = [(r.mix_source, r.block, r.place) for r in rows]
    assert len(rows) == len(ids) and len(set(at)) == len(ids)
    for s in ("hot", None):
        mine = [r.doc_id for r in sorted((r for r in rows if r.mix_source == s), key=lambda r: (r.block, r.place))]
        assert mine == sorted(mine, key=lambda i: (i is not None, i or 0)) and {(b, p) for x, b, p in at if x == s} == {(k // 4, k % 4) for k in range(len(mine))}


def test_a_null_source_is_no_source_named_so(spark):
    docs = spark.createDataFrame([(k, "t", "en", (None, "", "(none)", "=")[k % 4], 1) for k in range(400)], DOC)
    for weights in (None, {None: 3, "": 1, "(none)": 1, "=": 1}):
        rows = mixing.mixed(docs, weights, block_rows=1).collect()
        assert Counter(r.mix_source for r in rows) == {None: 100, "": 100, "(none)": 100, "=": 100} and len({r.mix_slot for r in rows}) == 400
        early = Counter(r.mix_source for r in rows if r.mix_slot < 120)
        assert early == ({None: 60, "": 20, "(none)": 20, "=": 20} if weights else dict.fromkeys((None, "", "(none)", "="), 30))


def test_sources_without_a_weight_get_one_slot_each():
    assert mixing.target_weights({"": 5, "=a": 9}, {"=b": 2.0}) == {"": 1, "=a": 1}
    assert mixing.target_weights({"": 5, "=a": 9}, {"=a": 2.0}, 10) == {"": 1, "=a": 10}


def test_shards_stay_even_when_rows_repeat(spark):
    docs = spark.createDataFrame([(None, "x" * 1000, None, None, None)] * 400 + [(3, "y" * 1000, "en", "s", 1)] * 300 + [(k, "x" * 1000, "en", "s", 1) for k in range(400)], DOC).repartition(4)
    rows, load, by = sharding.shard(docs).collect(), Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        by[r.shard].append(r.slot)
        assert r.text_crc32 in (zlib.crc32(b"x" * 1000), zlib.crc32(b"y" * 1000)) and r.size == 1016
    assert len(rows) == 1100 and max(load.values()) <= 1.2 * sum(load.values()) / 40 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_the_map_is_read_back_edited_and_kept_in_versions(spark, tmp_path):
    folder, docs = f"file://{tmp_path}/map", read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    few = docs.where("doc_id % 10 <> 3")

    def run(rows, shards):
        found = sharding.shard(rows, shards, 512, folder, 0.02).collect()
        load = Counter()
        for r in found:
            load[r.shard] += r.size
        assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / shards + 1 and len(load) == shards
        return {r.doc_id: r.shard for r in found}

    first = run(few, 8)
    assert sharding.map_versions(spark, folder) == [0, 1]
    assert run(few, 8) == first and sharding.map_versions(spark, folder) == [0, 1, 2]  # already even: nothing moves
    more = run(docs, 8)
    assert sum(more[i] != k for i, k in first.items()) < 0.1 * len(first)
    nine = run(docs, 9)
    assert sum(nine[i] != k for i, k in more.items()) < 0.2 * len(more) and sum(nine[i] not in (k, 8) for i, k in more.items()) < 0.05 * len(more)
    seven = run(docs, 7)
    assert sum(seven[i] != k for i, k in nine.items() if k < 7) < 0.2 * len(nine)
    assert sharding.map_versions(spark, folder) == [0, 1, 2, 3, 4, 5]
    old = {(r.vslot, r.part): r.shard for r in sharding.read_map(spark, folder, 1).collect()}
    assert {s for s, _ in old} == set(range(512)) and sharding.read_map(spark, folder).first().n_shards == 7
    with pytest.raises(ValueError, match="512 slots"):
        sharding.shard(docs, 7, 64, folder)
    (tmp_path / "map" / "version-000006").mkdir()  # a writer that died: the version does not count and is written over
    assert run(docs, 7) == seven and sharding.map_versions(spark, folder)[-1] == 6


def test_shards_follow_the_stored_map(spark):
    """The shard and slot of every row replayed from the ids and texts alone."""
    docs = read_table(spark, SF, "documents")
    rows = {r.doc_id: r for r in sharding.shard(docs, 8, 64).collect()}
    slot, size = {}, Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        slot[r.doc_id] = int(hashlib.md5(f"{r.doc_id}:{zlib.crc32(raw)}".encode()).hexdigest()[:8], 16) % 64
        size[slot[r.doc_id]] += len(raw) + 16
    hot = {s for s, b in size.items() if b > sharding.HOT * -(-sum(size.values()) // 64)}
    new = sharding.rebalanced(sharding.initial_map(64, 8), size, 8)
    assert not hot and all(rows[i].vslot == s and rows[i].shard == new[s] and rows[i].part == 0 for i, s in slot.items())
    order = sorted(slot, key=lambda i: (slot[i], i))
    for k in range(8):
        assert [rows[i].slot for i in order if new[slot[i]] == k] == list(range(sum(new[s] == k for s in slot.values())))


def test_samples_are_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(1, "x" * k) for k in range(50)] + [(2, "y" * 90), (3, None), (4, "z" * 5), (None, "n")], "doc_id long, text string")
    got = sample_texts(docs, [2, 1, 3, 4, 9], 120)
    assert [i for i, _ in got][-2:] == [3, 4] and sum(len(t) for _, t in got) <= 120 and len({i for i, _ in got}) == len(got) and sample_texts(docs, []) == []


def test_quality_votes_against_brute_force(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    odd = docs.limit(60).collect() + [SimpleNamespace(doc_id=-1, text=None), SimpleNamespace(doc_id=-2, text=""), SimpleNamespace(doc_id=-3, text="Word " * 40000), SimpleNamespace(doc_id=None, text="null id")]
    rows = quality.scored(spark.createDataFrame([(r.doc_id, r.text) for r in odd], "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd)
    for r in odd:
        z = model.latent([r.text])[0].astype(np.float64)
        cosine = model.vectors.astype(np.float64) @ z
        near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** 4
        assert abs(got[r.doc_id].score - (weight * model.labels[near]).sum() / weight.sum()) < 0.02 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_language_of_a_document_is_the_mean_of_its_words(spark):
    docs = read_table(spark, SF, "documents")
    model = langid.train(docs)
    for r in docs.limit(30).collect():
        names, score = langid.predicted(model, [r.text])
        w = langid.features([r.text])
        if not len(w.text):
            assert names == ["und"]
            continue
        emit, step = model.potentials(w), np.exp(model.transition)
        ahead, behind = [], [np.ones(len(step))]
        for e in emit:
            x = ((ahead[-1] if ahead else np.ones(len(step))) @ step) * e
            ahead.append(x / x.sum())
        for e in emit[1:][::-1]:
            x = step @ (e * behind[-1])
            behind.append(x / x.sum())
        p = np.array(ahead) * np.array(behind[::-1])
        mean = (p / p.sum(1, keepdims=True)).mean(0)
        assert names == [model.languages[int(mean.argmax())]] and abs(score[0] - mean.max()) < 1e-4


def test_zeros_before_a_part_do_not_matter():
    assert pii.base_spans("1." + "0" * 6000 + ".3.4") == [(0, 1, 6006)] and pii.base_spans("0256.1.1.1") == []


def test_skip_edges_against_enumeration():
    """On trees the messages are exact; the edge between two equal tokens carries what one of them says to the other."""
    text = "card 4000123412341234 was charged and later 4000123412341234 again"
    g = pii.graph([text])
    rng = np.random.default_rng(2)
    model = pii.Model(rng.normal(size=(1 << 14, 5)) * 0.3, rng.normal(size=(3, 5, 5)))
    assert len(g.start) == 2 and [e[2] for e in g.edges.tolist()] == [1]
    own = model.unary[g.features].sum(1)
    joint = np.exp(own[0][:, None] + own[1][None, :] + model.pair[1])
    want = np.stack([joint.sum(1), joint.sum(0)]) / joint.sum()
    assert np.allclose(model.marginals(g, 60), want, atol=1e-6)
    alone = pii.Graph(g.text, g.start, g.end, g.features, g.edges[:0])
    assert not np.allclose(model.marginals(alone), want, atol=1e-2)


def test_broken_mentions_are_no_base_spans():
    rng = random.Random(3)
    for turn in range(400):
        number = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(number + c for c in "0123456789" if pii._luhn(number + c))
        for kind, span in enumerate((f"bob.{turn}@mail{turn}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), " ".join(card[k : k + 4] for k in range(0, 16, 4)), "+1 (415) 555-0132")):
            assert pii.base_spans(f"to {span} now") == [(3, kind, 3 + len(span))]
            assert kind not in {k for _, k, _ in pii.base_spans(f"to {pii.broken(kind, span, turn)} now")} and pii.possible(kind, pii.broken(kind, span, turn))
    ((text, spans),) = pii.with_broken("write bob@a.example.com here, or 10.0.0.1 there")
    assert len(spans) == 4 and pii.base_spans(text) == spans[:2] and {k for _, k, _ in spans[2:]} == {0, 1} and all(pii.broken(k, text[a:b], 0) for a, k, b in spans[:2])
    assert pii.with_broken("") == [("", [])] and pii.with_broken("1 of 2") == [("1 of 2", [])]
    (_, both), (lone, none) = pii.with_broken("pay 4111111111111111 now")
    assert len(both) == 2 and not none and lone.split()[0] == "pay" and not pii.base_spans(lone)


def test_labels_of_tokens_against_all_pairs():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "1", "22 ", ".", "@", "-", " ", "+", "4111111111111111 ", "+1 (415) 555-0132", "10.0.0.1 ", "b@c.d "]) for _ in range(rng.randrange(30))) for _ in range(3)]
        g, spans = pii.graph(texts), [pii.base_spans(t) for t in texts]
        want = [next((k + 1 for a, k, b in spans[n] if a < e and s < b), 0) for n, s, e in zip(g.text, g.start, g.end)]
        assert pii.silver(g, spans).tolist() == want


def test_the_field_finds_what_patterns_reject(spark):
    """Broken mentions beside whole ones are found, numbers of another sort are left alone, and without skip edges a whole table loses spans."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = pii.train(docs)
    planted = {"pay by 4111111111111111 or maybe 4111111111111112 then": "card:33:49", "call +1 (415) 555-0132 or 1 (415) 555-0132 now": "phone:26:42", "mail bob.12@mail.example.com or ann.3@mail now": "email:32:42", "from 10.20.30.40 and 10.20.300.41 up": "ip:21:33"}
    clean = ["order 4111111111111112 was made", "heat 4736 in 2020 and 17", "chapter 3.1.2 of 12 pages", "see @handle"]
    rows = pii.marked(spark.createDataFrame(enumerate([*planted, *clean]), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert all(want in r.spans.split(",") and r.n_added == 1 for r, want in zip(rows, planted.values())) and [r.n_added for r in rows[len(planted) :]] == [0] * len(clean)
    apart = pii.Model(model.unary, np.concatenate([model.pair[:1], 0 * model.pair[1:]]))
    assert pii.marked(docs, model).where("n_added > 0").count() <= 0.01 * docs.count()  # numbers that are no cards stay alone
    slips, want = [], {}
    for r in docs.where("doc_id is not null").select("doc_id", "text").collect():
        cards = [(s, e) for s, k, e in pii.base_spans(r.text or "") if k == 2]
        for s, e in cards[:1]:
            slip = r.text[s:e][:7] + str((int(r.text[s + 7]) + 3) % 10) + r.text[s + 8 : e]
            want[r.doc_id] = f"card:{len(r.text) + 14}:{len(r.text) + 14 + e - s}"
            slips.append((r.doc_id, f"{r.text} or maybe as: {slip} then"))
    table = docs.join(spark.createDataFrame(slips, "doc_id long, more string"), "doc_id", "left").withColumn("text", F.coalesce("more", "text"))
    found, lost = ({r.doc_id for r in pii.marked(table, m).collect() if want.get(r.doc_id) in r.spans.split(",")} for m in (model, apart))
    assert len(want) > 15 and len(found) >= 0.95 * len(want) and len(lost) <= 0.1 * len(want)


def test_pii_query_against_regular_expressions(spark):
    """Every row of the query by regular expressions alone; spans hold the base spans, and those added touch none of them."""
    sf = "/root/testdata/sf0.01"
    fits = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 14 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0, "phone": lambda x: 10 <= len(re.sub("[^0-9]", "", x)) <= 15}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = {r.doc_id: r.text or "" for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = pii.op4_skip_chain_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = {k: [(m.start(), m.end()) for m in re.finditer(p, texts[r.doc_id]) if fits[k](m[0])] for k, p in patterns.items()}
        order = sorted((s, n, k, e) for n, k in enumerate(base) for s, e in base[k])
        marks = [f"{k}:{s}:{e}" for s, _, k, e in order]
        assert r.base_sha256 == hashlib.sha256(",".join(marks).encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in base]
        found = r.spans.split(",") if r.spans else []
        added = [(int(a), int(b)) for _, a, b in (x.split(":") for x in found if x not in marks)]
        assert [x for x in found if x in marks] == marks and len(found) == len(marks) + r.n_added and not any(a < e and s < b for a, b in added for s, _, _, e in order)


def test_items_and_texts_meet_by_rare_shingles(spark):
    """Items that begin alike: texts that only share the beginning meet none of them, and what is planted is found as without the filter."""
    rng = random.Random(12)
    start = [f"instruction{k}" for k in range(12)]
    some = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, " ".join(start + some(40))) for k in range(150)] + [(900, " ".join(start)), (901, "one two three four five " * 9), (902, "one two three four five " * 9), (903, " ".join(["same"] * 30))]
    held = dict(items)
    texts = [(k, " ".join(some(20) + start + some(40))) for k in range(150)]
    texts += [(1000 + k, " ".join(some(10)) + " " + held[k] + " " + " ".join(some(10))) for k in range(0, 150, 5)]
    texts += [(2000 + k, " ".join(held[k].split()[:22] + ["changed"] + held[k].split()[23:])) for k in range(0, 150, 7)] + [(3000, "x " + held[901] + "y"), (3001, " ".join(["same"] * 200))]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shingled = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, w in ((k, t.split()) for k, t in items)}
    among = Counter(h for s in shingled.values() for h in set(s))
    chosen = defaultdict(set)
    for r in decontam.rarest(decontam.item_table(table)).join(decontam.item_table(table).select("key", "item_id", "item"), "key").collect():
        chosen[r.item_id] |= {shingled[r.item_id][i] for i, h in enumerate(r.item) if h == r.h}
    for k, s in shingled.items():
        times, mine = Counter(s), chosen[k]
        left = len(s) - sum(times[h] for h in mine)
        assert left < -(-3 * len(s) // 4) and max(among[h] for h in mine) <= min((among[h] for h in times if h not in mine), default=10**6)  # the rest alone never reaches 0.75
    want = set()
    for d, text in texts:
        w = text.split()
        own = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for k, s in shingled.items():
            if set(own) & set(s):
                for at in range(max(1, len(own) - len(s) + 1)):
                    both = (Counter(own[at : at + len(s)]) & Counter(s)).total()
                    if both / (len(own[at : at + len(s)]) + len(s) - both) >= 0.75:
                        want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, table).collect()} == want and len(want) > 200
    begun = {d for d, k in want if k == 900}
    assert begun >= set(range(150))
