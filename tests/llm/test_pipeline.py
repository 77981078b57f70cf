"""The whole pipeline against plain Python, stage by stage, on documents with planted cases."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from cerulea.llm import langid
from cerulea.llm.common import read_table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def linked(texts: dict) -> dict:
    """The smallest id reachable from each, by comparing every two shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root, ids = {i: i for i in texts}, sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def runs(text: str) -> list:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def leaked(text: str, items: list) -> bool:
    """Whether any window as long as an item reaches 0.75, every window being tried; without a shared shingle none can."""
    own = runs(text)
    for item in (x for x in items if not set(own).isdisjoint(x)):
        want = Counter(item)
        for s in range(max(len(own) - len(item), 0) + 1):
            window = Counter(own[s : s + len(item)])
            common = sum((want & window).values())
            if common and common >= 0.75 * (len(item) + window.total() - common):
                return True
    return False


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = [r for r in read_table(spark, SF, "documents").collect() if r.text and len(r.text) < 2500]
    passages = [r for r in read_table(spark, SF, "benchmark").collect() if r.text]
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in base]
    long = [r for r in base if len(r.text.split()) > 60][:6]
    new = 10_000_000
    for k, r in enumerate(long):
        words = r.text.split()
        words[len(words) // 2] = "changed"
        rows += [(new + 3 * k, r.text, r.lang, r.source, r.n_chars), (new + 3 * k + 1, " ".join(words), r.lang, None, None), (new + 3 * k + 2, r.text + "\n" + passages[k].text, r.lang, r.source, None)]
    rows += [(new + 100, None, "en", "src0", None), (new + 101, "", "en", None, 0), (new + 102, "12 34 !!", None, "src1", 8)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    read_table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = read_table(spark, str(tmp_path), "documents")
    score = {r.doc_id: r for r in langid.identified(docs, langid.train(docs)).select("doc_id", "lang_pred", "lang_score").collect()}
    letters = {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {i for i, r in score.items() if r.lang_pred == langid.UNKNOWN} == {r[0] for r in rows} - letters
    told = {r[0]: r for r in rows if r[0] in letters and score[r[0]].lang_score >= 0.3}
    assert len(told) >= 0.99 * len(letters)

    root = linked({i: r[1] for i, r in told.items()})
    single = {i: r for i, r in told.items() if root[i] == i}
    items = [x for x in (runs(p.text) for p in passages) if x]
    left = {i: r for i, r in single.items() if not leaked(r[1], items)}
    assert len(told) > len(single) > len(left) > 0

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} == set(left.values()) and len(got) == len(left)
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += len(r.text.encode()) + 16
    assert all(0 <= k < 40 and sorted(v) == list(range(len(v))) for k, v in slots.items())
    total, largest = sum(load.values()), max(len(r.text.encode()) + 16 for r in got)
    assert max(load.values()) <= math.ceil(total / 40) + largest


def test_slots_of_a_shard_follow_the_mix(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randrange(1, 40), "en", "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]), 1) for i in rng.sample(range(10**6), 6000)]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("mixing", "sharding"):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    by = defaultdict(list)
    for r in rows:
        by[r[3] or "(none)"].append(r[0])
    roots = {s: math.sqrt(len(v)) for s, v in by.items()}
    weights = {s: max(1, math.floor(1000 * x / sum(roots.values()) + 0.5)) for s, x in roots.items()}
    total, sent, at = sum(weights.values()), Counter(), {}
    for t in range(total):
        ready = [s for s in weights if sent[s] < weights[s] and sent[s] * total // weights[s] <= t]
        s = min(ready, key=lambda s: (-(-(sent[s] + 1) * total // weights[s]), s))
        at[s, sent[s]] = t
        sent[s] += 1
    place = {i: (p // 16 // weights[s] * total + at[s, p // 16 % weights[s]], p % 16) for s, v in by.items() for p, i in enumerate(sorted(v))}
    shards = defaultdict(list)
    for r in docs.collect():
        shards[r.shard].append((r.slot, r.doc_id))
    assert sum(map(len, shards.values())) == len(rows) and len(shards) == 40
    for found in shards.values():
        ids = [i for _, i in sorted(found)]
        assert [k for k, _ in sorted(found)] == list(range(len(found))) and ids == sorted(ids, key=place.get)
