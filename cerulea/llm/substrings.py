"""Removal of repeated word sequences by prefix-partitioned suffix trees.

The suffixes of all texts, word by word, are split into groups that fit a task's memory, and a tree is built for each group. Its nodes at a depth of a window or more
have the places where one sequence of that many words stands; all but the first of them are repeats, and repeats at successive places make up the maximal ones.

Suffixes are dealt by prefixes of variable length, counted from an anchor: the smallest hash among the half-window runs of words in a window. Equal windows have equal
anchors, and successive windows mostly share one, so they travel together as one segment of text. Anchors that stand once cannot lie in a repeat and are dropped;
those that stand up to ``HOT`` times are packed into groups. The segments of a more frequent one are dealt over groups of about ``HOT``; what comes first in such a group
meets the first ones of the others by a longer prefix, the whole window. A group's tree is its sorted suffixes: a node is a run of suffixes that share its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cerulea.llm.common import RollingHash, mix64, read_table, row_key, stored, text_blocks, word_bounds

WORDS = 20
#: Segments of a group, and of an anchor beyond which its segments are dealt over several groups.
GROUP_ROWS, HOT = 20_000, 1_000
#: Rows up to which a table of keys is sent to every task; larger ones are joined by a shuffle. Numbers alone take less room.
BROADCAST_ROWS, BROADCAST_NUMBERS = 500_000, 2_000_000
#: Bytes of whole texts that a kernel takes at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

_COEFFICIENTS = np.random.default_rng(23).integers(1, 2**63, 1 << 10, dtype=np.uint64) | np.uint64(1)


def few(table: DataFrame, most: int) -> DataFrame:
    """The table, marked for a broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text, hash) of the words of texts whose words are joined by one space."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = word_bounds(data != 0x20)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return data, start, end, of, RollingHash(data).of(start, end)


def _lowest(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v, have = np.minimum(v[:-step], v[step:]), have + step
    return v


def runs(of: np.ndarray, h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, anchor, weight) of the runs of successive windows of one text that share their anchor. The weight is 2 where the anchor stands
    more than once in a run, so that a run whose windows repeat each other counts as repeated, else 1."""
    half, n = max(1, words // 2), len(h) - words + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    gram = mix64(sum((h[k : len(h) - half + 1 + k] * _COEFFICIENTS[k] for k in range(half)), np.zeros(len(h) - half + 1, np.uint64)))
    span = words - half + 1
    low = _lowest(gram, span)
    twice = sum(((gram[k : k + n] == low).astype(np.int8) for k in range(span)), np.zeros(n, np.int8)) > 1 if span < 128 else np.ones(n, bool)
    window = np.flatnonzero(of[:n] == of[words - 1 :])
    if not len(window):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (low[window[1:]] != low[window[:-1]])]))
    size = np.diff(np.append(new, len(window)))
    again = np.maximum.reduceat(twice[window].astype(np.int64), new) | (size > span)
    return window[new], size, low[window[new]].view(np.int64), 1 + again


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    column = batch.column("text").cast(pa.binary())
    block = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // BLOCK_BYTES
    edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield lo, hi, [b" ".join((t or b"").split()) for t in column[lo:hi].to_pylist()]


def _anchors(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch):
                _, _, _, of, h = word_hashes(texts)
                _, _, anchor, weight = runs(of, h, words)
                one, at = np.unique(anchor, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.bincount(at, weights=weight, minlength=len(one)).astype(np.int64))], names=["anchor", "m"])

    return run


def _sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Ranges of a byte array as binary values."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


def _segments(words: int, whole: bool):
    """(anchor, doc_id, own, start, n) of each run, and its words where ``whole``. Where rows name wanted runs (their starts), only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _texts(batch):
                data, start, end, of, h = word_hashes(texts)
                first, n, anchor, _ = runs(of, h, words)
                doc = of[first] if len(first) else np.zeros(0, np.int64)
                begin = first - np.searchsorted(of, doc)
                if "wanted" in batch.schema.names:
                    wanted = batch.column("wanted")[lo:hi]
                    asked = np.repeat(np.arange(hi - lo), np.diff(wanted.offsets.to_numpy())) << 32 | wanted.flatten().to_numpy().astype(np.int64)
                    kept = np.isin(doc << 32 | begin, asked)
                    first, n, anchor, doc, begin = (v[kept] for v in (first, n, anchor, doc, begin))
                at = pa.array(doc + lo)
                columns = [pa.array(anchor), batch.column("doc_id").take(at), batch.column("own").take(at), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))]
                names = ["anchor", "doc_id", "own", "start", "n"]
                if whole:
                    columns, names = [*columns, _sliced(data, start[first], end[first + n + words - 2])], [*names, "words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_NARROW = "anchor long, doc_id long, own binary, start int, n int"


def segments(docs: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """(anchor, doc_id, own, start, n, words, m): the segments of ``docs`` (doc_id, own, text; each own once) whose anchor is among ``repeated`` (anchor, m).

    Up to ``BROADCAST_NUMBERS`` anchors no text is shuffled here: segments are dropped where they are cut. Beyond, places are joined with the anchors first, and only
    the wanted segments of the texts are cut.
    """
    if repeated.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS:
        return docs.mapInArrow(_segments(words, True), f"{_NARROW}, words binary").join(F.broadcast(repeated), "anchor")
    places = docs.mapInArrow(_segments(words, False), _NARROW).join(repeated, "anchor").groupBy("own").agg(F.collect_list("start").alias("wanted"))
    return docs.join(places, "own").mapInArrow(_segments(words, True), f"{_NARROW}, words binary").join(repeated, "anchor")


def suffix_ranks(token: np.ndarray, suffix: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix (the place of its first token) among all runs of ``depth`` tokens, sorted: prefixes are doubled until they are that long."""
    rank, have = np.unique(token, return_inverse=True)[1], 1
    while have < depth:
        step = min(have, depth - have)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        have += step
    return rank[suffix]


_NODES = pa.schema([("doc_id", pa.int64()), ("own", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("node", pa.binary())])


def _deep_nodes(words: int):
    def spans(rows: pa.Table) -> pa.Table:
        """The words of a group's segments that a window covers which stands earlier in the group: first and last word of each stretch. Of an anchor that is dealt over
        several groups also the first window of each deep node, with the MD5 of its words as the node's name."""
        ids, own, n = rows["doc_id"].to_pylist(), rows["own"].to_pylist(), rows["n"].to_numpy().astype(np.int64)
        text, start = rows["words"].to_pylist(), rows["start"].to_numpy().astype(np.int64)
        token = np.concatenate([word_hashes(text[lo:hi])[4] for lo, hi in text_blocks(text, BLOCK_BYTES)])
        number = {key: k for k, key in enumerate(sorted({(i is None, i or 0, o) for i, o in zip(ids, own, strict=True)}))}
        doc = np.array([number[i is None, i or 0, o] for i, o in zip(ids, own, strict=True)])
        size = n + words - 1
        segment = np.repeat(np.arange(len(n)), n)
        moved = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        node = suffix_ranks(token, (np.cumsum(size) - size)[segment] + moved, words)
        place = doc[segment] << 32 | (start[segment] + moved)
        order = np.lexsort((place, node))
        head = np.concatenate([[True], np.diff(node[order]) != 0])
        gone = np.zeros(len(order), bool)
        gone[order] = place[order] != place[order][head][np.cumsum(head) - 1]
        at = np.flatnonzero(gone)
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(segment[at]) != 0)]) if len(at) else np.zeros(0, bool)
        begin, end = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
        names = [None] * len(begin)
        if rows["hot"][0].as_py():
            heads = np.sort(order[head])
            parts, whose = [], -1
            for i in heads.tolist():
                if segment[i] != whose:
                    whose = segment[i]
                    parts = text[whose].split(b" ")
                names.append(hashlib.md5(b" ".join(parts[moved[i] : moved[i] + words])).digest())
            begin, end = np.append(begin, heads), np.append(end, heads)
        of = pa.array(segment[begin])
        first = start[segment] + moved
        where = [pa.array(v.astype(np.int32)) for v in (first[begin], first[end] + words - 1)]
        return pa.table([rows["doc_id"].combine_chunks().take(of), rows["own"].combine_chunks().take(of), *where, pa.array(names, pa.binary())], schema=_NODES)

    return spans


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(own, first, last): stretches of words of ``docs`` (doc_id, own, text; each own once) that windows cover whose words stand earlier too, by (doc_id, own, start), a
    null id last. Stretches of one text may overlap or touch; together they are its repeats, each from its true first to its true last word."""
    repeated = docs.mapInArrow(_anchors(words), "anchor long, m long").groupBy("anchor").agg(F.sum("m").alias("m")).where("m > 1")
    repeated = stored(repeated, "repeated-anchors")
    total = repeated.agg(F.sum(F.when(F.col("m") <= HOT, F.col("m")))).first()[0] or 0
    groups = -(-total // GROUP_ROWS) or 1
    hot, dealt = F.col("m") > HOT, F.pmod(F.xxhash64("own", "start"), F.ceil(F.col("m") / max(1, HOT)))
    # numbers of dealt groups are far beyond those of the packed ones
    group = F.when(hot, F.xxhash64("anchor", dealt).bitwiseOR(F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    packed = segments(docs, repeated, words).select("doc_id", "own", "start", "n", "words", hot.alias("hot"), group.alias("group"))
    found = packed.groupBy("group").applyInArrow(_deep_nodes(words), "doc_id long, own binary, first int, last int, node binary")
    found = stored(found, "deep-nodes")  # read twice
    earlier = Window.partitionBy("node").orderBy(F.col("doc_id").isNull(), "doc_id", "own", "first")
    later = found.where("node IS NOT NULL").withColumn("nth", F.row_number().over(earlier)).where("nth > 1")  # a row of each group at most
    return found.where("node IS NULL").select("own", "first", "last").union(later.select("own", "first", "last"))


def joined_up(spans: str):
    """Sorted stretches (first, last) of an array column, with those that overlap or touch made one: the maximal repeats of a text."""
    last = lambda acc: F.element_at(acc, -1)
    span = lambda first, end: F.array(F.struct(first.alias("first"), end.alias("last")))
    touches = lambda acc, s: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"] - 1)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), span(last(acc)["first"], F.greatest(last(acc)["last"], s["last"])))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first: int, last: int>>"), lambda acc, s: F.when(touches(acc, s), grown(acc, s)).otherwise(F.concat(acc, span(s["first"], s["last"]))))


def _cleaned(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copy, spans = (batch.column(c) for c in ("text", "copy", "spans"))
            count, gone, kept = [], [], []
            for k in range(batch.num_rows):
                held = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                stays = np.ones(len(held), bool)
                if copy[k].as_py():
                    stays[:] = len(held) < words
                elif spans[k].is_valid:
                    edge = np.zeros(len(held) + 1, np.int64)
                    both = spans[k].values
                    np.add.at(edge, both.field("first").to_numpy(), 1)
                    np.add.at(edge, both.field("last").to_numpy() + 1, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                count.append(len(held))
                gone.append(len(held) - int(stays.sum()))
                kept.append(b" ".join(compress(held, stays)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every row of ``docs`` (doc_id, text) without the words that a window of ``words`` words covers whose words stand earlier too.

    Earlier is a smaller doc_id, null last, or an earlier start in one document; windows are judged on the texts as given. Words are split at ASCII white space, and
    those that stay are joined by one space. A row is its id and its text: rows of one id and other texts are told apart (ordered by a hash), and rows that repeat both
    are one document and share one decision. Null texts, and those of fewer words than a window, lose nothing. An empty table gives no rows. Equal texts are not compared word by
    word: all but the first of them go whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("own"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"))
    known = stored(rows.where(F.col("text").isNotNull()).groupBy("own", "same").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("m")), "texts")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "own")).alias("lead")
    copies = known.groupBy("same").agg(lead, F.count("*").alias("k")).where("k > 1").select("same", F.col("lead.own").alias("lead"))
    marked = rows.join(few(stored(copies, "copies"), BROADCAST_ROWS), "same", "left").withColumn("copy", F.coalesce(F.col("own") != F.col("lead"), F.lit(False)))
    judged = marked.where(F.col("text").isNotNull() & ~F.col("copy")).select("doc_id", "own", "text")
    again = few(known.where("m > 1").select("own"), BROADCAST_ROWS)  # rows that repeat id and text take part once
    judged = judged.join(again, "own", "left_anti").union(judged.join(again, "own", "left_semi").dropDuplicates(["own"]).select("own", "doc_id", "text")).select("doc_id", "own", "text")
    spans = repeats(judged, words).groupBy("own").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = stored(spans.select("own", joined_up("spans").alias("spans")), "repeats")
    size = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    held = F.broadcast(spans) if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_NUMBERS else spans
    return marked.join(held, "own", "left").select("doc_id", "text", "copy", "spans").mapInArrow(_cleaned(words), "doc_id long, n_words long, n_removed long, text string")


def op13_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op13_suffix_tree_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - {WORDS - 1})) AS s FROM d WHERE len(w) >= {WORDS}),
g AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {WORDS}], ' ')) AS g FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WORDS})) AS i FROM r WHERE nth > 1),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
}
