"""MinHash near-dedup with tensored banding.

Banding with T tables of k minhashes each would need T*k minhashes a document. Here two collections of t half keys, of m minhashes each, are kept, and table
(i, j) has the pair of half keys A[i], B[j] as its key: t*t tables from 2*t*m minhashes. Two documents of similarity s meet in a table with probability
(1 - (1 - s**m)**t)**2: for m = 3 and t = 20 that is 0.99997 at s = 0.75. Documents that meet are compared on their whole shingle sets.

Documents with equal sets are one node of the graph. Verification is in rounds, so that a large group of near copies does not cost all its pairs: first every document against the pivot that it
meets most often, next against those of its other pivots that are in other groups then, and last, where buckets still join groups that no confirmed link joins, the documents of one group against those of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import RollingHash, mix64, read_table, row_key, stored, text_blocks, word_bounds
from cerulea.llm.graph import SALTS, components

WORDS = 5
HALF_KEYS = 20
MINHASHES = 3
PERCENT = 75
LEAST_AGREEMENT = 0.4
#: Documents, and shingles, of a block; a longer text is a block of its own.
TILE_ROWS, TILE_SHINGLES = 256, 1 << 19
#: Up to so many linked documents, 64 bits of each one's key are sent to every task (about 200 MB at most), so that other texts are not exchanged.
BROADCAST_NODES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_COEFFICIENTS = np.random.default_rng(7).integers(1, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``words``-word shingles of each text as sorted 64-bit fingerprints, all in one array, and where each text's begin (one more than texts).

    A-Z are lower-cased, words are split at ASCII white space. A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    start, end = word_bounds(~_SPACE[data])
    of = np.searchsorted(np.cumsum(sizes), start, side="right")
    word = RollingHash(data).of(start, end)
    n = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    full = np.flatnonzero(of[: len(of) - words + 1] == of[words - 1 :]) if len(of) >= words else np.zeros(0, np.int64)
    value = sum((word[full + k] * _COEFFICIENTS[k] for k in range(words)), np.zeros(len(full), np.uint64))
    short = np.flatnonzero((n > 0) & (n < words))
    whole = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        has = n[short] > k
        whole[has] += word[first[short[has]] + k] * _COEFFICIENTS[k]
    whole += n[short].astype(np.uint64) * _COEFFICIENTS[words]
    value, of = mix64(np.concatenate([value, whole])), np.concatenate([of[full], short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])


def _sign(half_keys: int, minhashes: int, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.binary()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.list_(pa.int32()))])
    rng = np.random.default_rng(11)
    a = rng.integers(1, 2**31, 2 * half_keys * minhashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, 2 * half_keys * minhashes, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, texts = batch.column("doc_id"), batch.column("own"), batch.column("text").to_pylist()
            for lo, hi in text_blocks(texts, 1 << 20):
                value, at = shingle_sets(texts[lo:hi], words)
                n = np.diff(at)
                some, begin = np.flatnonzero(n), at[:-1][n > 0]
                sums, sig = np.zeros((2, hi - lo), np.uint64), np.zeros((len(some), len(a)), np.uint32)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix64(value ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    sums[1, some] = np.add.reduceat(mix64(value + np.uint64(0x14057B7EF767814F)), begin)
                    low = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
                    for k in range(len(a)):
                        sig[:, k] = np.minimum.reduceat(low * a[k] + b[k], begin)
                offsets = np.zeros(hi - lo + 1, np.int32)
                offsets[1:] = np.cumsum((n > 0) * len(a))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.view(np.int32).ravel()))
                h1, h2 = sums.view(np.int64)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], own[lo:hi], pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), lists], schema=schema)

    return run


def signatures(docs: DataFrame, half_keys: int = HALF_KEYS, minhashes: int = MINHASHES, words: int = WORDS) -> DataFrame:
    """(doc_id, own, n_shingles, h1, h2, sig): the key of each row, the size, a 128-bit digest and the minhashes of its shingle set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("own"), "text")
    return rows.mapInArrow(_sign(half_keys, minhashes, words), "doc_id long, own binary, n_shingles long, h1 long, h2 long, sig array<int>")


def candidates(sets: DataFrame, half_keys: int, minhashes: int) -> DataFrame:
    """(node, best, pivots) of the nodes that meet others in a table, for (node, n_shingles, sig): in each bucket every document has a pivot, the smallest node, which keeps the
    bucket connected; best is the pivot that it meets most often.

    A half key that only one document has cannot meet another, so it is dropped before the pairs of half keys are formed. A bucket holds sizes of two successive steps
    of 4/3 only; similar documents lie in one step or in two successive ones, so they share such a bucket, and a long document that quotes both cannot be their pivot.
    """

    def half(side: int) -> DataFrame:
        keys = [F.xxhash64(F.lit(side * half_keys + i), *[F.col("sig")[(side * half_keys + i) * minhashes + k] for k in range(minhashes)]) for i in range(half_keys)]
        rows = sets.select("node", F.explode(F.array(*keys)).alias("half"))
        shared = rows.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
        return rows.join(shared, "half", "left_semi").groupBy("node").agg(F.collect_list("half").alias(f"half{side}"))

    step = F.floor(F.log("n_shingles") / np.log(4 / 3)).cast("int")
    sizes = sets.select("node", F.explode(F.array(step, step + 1)).alias("step"))
    pairs = half(0).join(half(1), "node").join(sizes, "node")
    buckets = pairs.select("node", "step", F.explode("half0").alias("x"), "half1").select("node", "step", "x", F.explode("half1").alias("y")).select("node", F.xxhash64("x", "y", "step").alias("bucket"))
    buckets = stored(buckets, "buckets")
    pivots = buckets.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("bucket", "b")
    met = buckets.join(pivots, "bucket").where("node <> b").groupBy("node", "b").agg(F.count("*").alias("n"))
    return met.groupBy("node").agg(F.max_by("b", F.struct("n", "b")).alias("best"), F.collect_list("b").alias("pivots"))


def agreeing(links: DataFrame, sets: DataFrame, half_keys: int, minhashes: int) -> DataFrame:
    """The links (a, b) whose minhashes agree in 40 % of the places or more: at similarity 0.75 less is nine standard deviations off."""
    left, right = sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return links.join(left, "a").join(right, "b").where(same >= LEAST_AGREEMENT * 2 * half_keys * minhashes).select("a", "b")


def links_between(met: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): of all links of ``met`` (node, pivots) those whose ends are in different groups, for the groups (node, root) of the nodes that have one.

    A node's pivots stay in its row until the group of each is known: the groups are joined to the nodes, and to the distinct pairs of a group and a pivot, so a large group
    that is linked already hands on none of its links.
    """
    own = met.join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), "pivots")
    spread = own.select(F.col("node").alias("a"), "comp", F.explode("pivots").alias("b"))
    pairs = spread.select("comp", "b").distinct().join(comps.select(F.col("node").alias("b"), "root"), "b", "left")
    apart = pairs.where(F.coalesce("root", "b") != F.col("comp")).select("comp", "b")
    return spread.join(apart, ["comp", "b"], "left_semi").select("a", "b")


def _against(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        """(member, pivot) of the members whose whole sets confirm the link; sets are sorted, so one search each tells what a member has in common."""
        rows, b = rows.combine_chunks(), key[0].as_py()
        nodes, lists = rows["node"].to_numpy(), rows["shingles"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint64)
        size = np.diff(at)
        flat, at = flat, at - at[0]
        p = int(np.flatnonzero(nodes == b)[0])
        pivot = flat[at[p] : at[p + 1]]
        place = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.add.reduceat((pivot[place] == flat).astype(np.int64), at[:-1])
        hit = (100 * common >= percent * (size + len(pivot) - common)) & (nodes != b)
        return pa.table([pa.array(nodes[hit]), pa.array(np.full(int(hit.sum()), b, np.int64))], schema=schema)

    return links


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: pa.Table) -> pa.Table:
        """Links of a tile, confirmed on full sets and thinned to a tree per component: (member, smallest member)."""
        rows = rows.combine_chunks()
        nodes = rows["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        lists = rows["shingles"].combine_chunks().take(pa.array(order))
        size = np.diff(lists.offsets.to_numpy())
        _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(nodes)), size)
        shared = count[column] > 1
        column, row = np.cumsum(count > 1)[column[shared]] - 1, row[shared]
        by = np.argsort(column, kind="stable")
        column, row = column[by], row[by]
        common, step = np.zeros((len(nodes), len(nodes)), np.float32), 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            part = slice(*np.searchsorted(column, [low, low + step]))
            held = np.zeros((len(nodes), step), np.float32)
            held[row[part], column[part] - low] = 1
            common += held @ held.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        label = np.arange(len(nodes))
        while True:
            better = np.where(linked, label[None, :], len(nodes)).min(1)
            better = np.minimum(label, better)
            better = np.minimum(better, better[better])
            if (better == label).all():
                break
            label = better
        nodes, far = nodes[order], np.flatnonzero(label != np.arange(len(label)))
        return pa.table([pa.array(nodes[far]), pa.array(nodes[label[far]])], schema=schema)

    return links


def _shingled(words: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_blocks(texts):
                value, at = shingle_sets(texts[lo:hi], words)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node")[lo:hi], lists], schema=schema)

    return run


def shingles_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the whole set of each node of ``nodes`` (node, own), a stored table, sorted; read from one row with that key.

    Beyond ``BROADCAST_NODES`` nodes all texts are exchanged by key once; the result is the same.
    """
    texts = docs.select(row_key().alias("own"), "text")
    if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        few = F.broadcast(nodes.select(F.xxhash64("own").alias("key")))
        texts = texts.withColumn("key", F.xxhash64("own")).join(few, "key", "left_semi").drop("key")
    texts = texts.join(nodes, "own").select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(_shingled(words), "node long, shingles array<bigint>")


def pivot_links(links: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that whole sets confirm, b being a pivot. The members of a pivot are dealt into blocks, and each meets the pivot's set: linear in the members."""
    members = links.join(sizes.select(F.col("node").alias("a"), "n_shingles"), "a")
    blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES)).cast("int")
    parts = stored(members.groupBy("b").agg(blocks.alias("blocks")), "pivots")
    copies = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), ["b", "salt"])
    dealt = salted.select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int").alias("part"))
    pivots = parts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    return dealt.union(pivots).join(sets, "node").groupBy("b", "part").applyInArrow(_against(percent), "a long, b long")


def tiled_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links between different groups of a cluster, for members (node, n_shingles, comp, root).

    Groups of 256 documents or more are dealt into blocks of their own, the smaller ones of a cluster into mixed blocks. A tile is two blocks of different groups, or
    two mixed ones; blocks of one group never meet. A tile returns a tree for each set of linked documents, not its pairs.
    """
    blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES)).cast("int")
    large = members.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= TILE_ROWS).select("comp", F.col("comp").alias("large"))
    owned = stored(members.join(large, "comp", "left").select("node", "n_shingles", "root", F.coalesce("large", F.lit(-1)).alias("owner")), "tile-members")
    owners = owned.groupBy("root", "owner").agg(blocks.alias("blocks"))
    p, q = owners.toDF("root", "p", "ps"), owners.toDF("root", "q", "qs")
    pairs = p.join(q, "root").where("p < q OR (p = -1 AND q = -1)")
    tiles = pairs.select("root", "p", "q", "qs", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("i")).select("root", "p", "q", "i", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("j")).where("p < q OR i <= j")
    tiles = tiles.withColumn("tile", F.xxhash64("root", "p", "i", "q", "j"))  # two tiles of one number are compared as one
    sides = tiles.select("tile", "root", F.col("p").alias("owner"), F.col("i").alias("block")).union(tiles.select("tile", "root", "q", "j")).distinct()
    dealt = owned.join(owners, ["root", "owner"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = dealt.join(sides, ["root", "owner", "block"]).select("tile", "node")
    return placed.join(sets, "node").groupBy("tile").applyInArrow(_verify(percent), "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, half_keys: int = HALF_KEYS, minhashes: int = MINHASHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, own, stays): documents linked by 100 * common >= percent * union of shingles, directly or over others.

    component_id is the smallest doc_id of the group, and the documents with that id are kept. Texts without words, null ones included, are linked with nothing. Equal
    sets are one node of the graph, however many documents have them. A row is its id and its text (own, their key): rows with one id and other texts are judged each
    by its own text. Rows with null ids link others and are linked like others, but have no id to be named by: component_id is null and kept true. stays marks one row key of each
    group, that of the smallest id (null last) and then the smallest key; rows that repeat id and text share it. Shingles are compared by 64-bit fingerprints. An
    empty table gives no rows.
    """
    signed = stored(signatures(docs, half_keys, minhashes, words), "signatures")
    lead = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "own")
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(lead).alias("lead"), F.first(F.struct("sig", "n_shingles")).alias("x"))
    classes = classes.select("h1", "h2", "lead", "x.sig", "x.n_shingles", F.monotonically_increasing_id().alias("node"))
    classes = stored(classes, "classes")  # numbers are drawn once
    sigs = classes.select("node", "n_shingles", "sig")
    met = stored(candidates(sigs, half_keys, minhashes), "met")

    def linked(links: DataFrame) -> DataFrame:
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        return classes.select("node", "n_shingles", F.col("lead.own").alias("own")).join(nodes, "node")

    first_links = stored(agreeing(met.select(F.col("node").alias("a"), F.col("best").alias("b")), sigs, half_keys, minhashes), "links")
    nodes = stored(linked(first_links), "linked")
    sets = stored(shingles_of(docs, nodes.select("own", "node"), words), "sets")
    confirmed = stored(pivot_links(first_links, sets, nodes, percent), "confirmed")

    # a link inside a group changes nothing, so only those between groups are formed
    links = stored(agreeing(links_between(met, components(confirmed)), sigs, half_keys, minhashes), "links")
    new = stored(linked(links).join(nodes, "node", "left_anti"), "linked")
    sets = sets.union(stored(shingles_of(docs, new.select("own", "node"), words), "sets"))
    nodes = nodes.union(new)
    untried = links.join(first_links, ["a", "b"], "left_anti")
    near = components(confirmed.union(pivot_links(untried, sets, nodes, percent)))
    comps = stored(nodes.select("node", "n_shingles").join(near, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("comp")), "groups")

    def over(edges: DataFrame) -> DataFrame:
        """Edges between the groups of their ends."""
        named = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        both = edges.join(named("a"), "a").join(named("b"), "b").where("a_comp <> b_comp")
        return both.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))

    apart = components(over(links)).select(F.col("node").alias("comp"), "root")
    more = components(over(tiled_links(comps.join(apart, "comp"), sets, percent))).select(F.col("node").alias("comp"), "root")
    found = comps.join(more, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))

    named = stored(found.join(classes.select("node", "lead"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "roots")
    first = named.groupBy("root").agg(F.min("lead").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.join(first.hint("merge"), ["root", "salt"]).select("node", "first")
    component = classes.select("h1", "h2", "node", "lead").join(named, "node", "left").select("h1", "h2", F.coalesce("first", "lead").alias("first"))
    rows = signed.select("doc_id", "own", "n_shingles", "h1", "h2").join(component, ["h1", "h2"], "left")
    linked = F.col("n_shingles") > 0
    group = F.when(linked & F.col("doc_id").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stays = F.when(linked, F.col("own") == F.col("first.own")).otherwise(True)
    return rows.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"), "own", stays.alias("stays"))


def without_near_duplicates(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns (doc_id and text among them) of one row of each group, the one that ``stays``; of rows that repeat its id and text one. Texts without words all stay."""
    gone = grouped(docs.select(*columns)).where(~F.col("stays")).select("own").distinct()
    # repeated rows meet before the shuffle; a row without words gets a key of its own, so it meets none. One exchange serves both steps
    number = F.unhex(F.md5(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary")))
    key = F.when(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), row_key()).otherwise(number)
    rows = docs.select(*columns, key.alias("own")).dropDuplicates(["own"])
    return rows.join(gone, "own", "left_anti").select(*columns)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(read_table(spark, sf_dir, "documents")).drop("own", "stays")


ORACLE_SQL = {
    "op6_minhash_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct([array_to_string(words[i : i + 4], ' ') for i in range(1, len(words) - 3)]) END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 75 * (len(p.sh) + len(q.sh) - k)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT a, a FROM sides UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.node),
low AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM s LEFT JOIN low ON node = doc_id
"""
}
