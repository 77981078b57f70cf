"""Benchmark decontamination by SimHash of item-sized windows.

Windows of a document as long as a benchmark item get a 64-bit SimHash of their five-word shingles, weighted by how often they occur. Fingerprints are looked up by
blocks of bits: with one block more than the radius, any two fingerprints within the radius agree in a block. What is found is verified by the exact weighted
similarity of the shingles, sum of minima over sum of maxima.

A window can only reach similarity 0.75 if at least three quarters of the item's shingles stand in it, so only such windows are fingerprinted, and are looked up in the
blocks of those items. This drops no window that could qualify. Such a window holds one of any set of the item's shingles that make up more than a quarter of it, so texts
and items meet by those that the fewest items have, and all shingles are counted only for the pairs that met: an instruction that thousands of items begin with joins
nothing. It is needed because the blocks alone select nothing at this similarity: fingerprints then differ in 17 % of their bits, so a radius that loses nothing leaves blocks of less than
1 / 0.17 bits, at any width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, row_key, stored

WORDS = 5
SIMILARITY = 0.75
RADIUS = 23
BITS = 64
BROADCAST_ROWS = 1_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Words of lower-cased text: letters and digits, and everything outside ASCII."""
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def shingles(word_array, n: int = WORDS):
    """Hash of each run of ``n`` words, in order; none if there are fewer.

    ``word_array`` must be a plain column, as inside the lambda an expression would be computed for each run; slice() there would copy the array each time.
    """
    last = F.size(word_array) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(word_array, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def lanes(hashes, width: int = 16):
    """How many of an array of hashes have each bit: counts in lanes of ``width`` bits, 64 / width to a long, bits j, j + width, ... in the j-th."""
    ones = F.lit(sum(1 << k for k in range(0, 64, width)))

    def added(j: int):
        return lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(ones)

    return F.array(*[F.aggregate(hashes, F.lit(0).cast("long"), added(j)) for j in range(width)])


def _bits(packed, n, width: int):
    """64-bit SimHash from the lanes of ``n`` hashes: a bit is set if more than half of them have it."""
    out = F.lit(0).cast("long")
    for j in range(width):
        for low in range(0, 64, width):
            more = F.shiftrightunsigned(packed[j], low).bitwiseAND(F.lit((1 << width) - 1)) * 2 > n
            bit = (1 << (low + j)) - (1 << 64 if low + j == 63 else 0)
            out = out.bitwiseOR(F.when(more, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def with_simhash(df: DataFrame, hashes: str, width: int = 16) -> DataFrame:
    """``df`` with the column fp; lanes of 16 bits count up to 65,535 hashes, of 32 bits any array."""
    return df.withColumn("lanes", lanes(F.col(hashes), width)).withColumn("fp", _bits(F.col("lanes"), F.size(hashes), width)).drop("lanes")


def index_keys(fp, radius: int = RADIUS):
    """One (block number, bits) key for each of radius + 1 blocks."""
    n, keys, low = radius + 1, [], 0
    for k in range(n):
        width = BITS // n + (k < BITS % n)
        keys.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")))
        low += width
    return F.array(*keys)


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, key, n_words, need, item): the shingles of the items that have any, each id and text once; need is how many of them a similar window must hold."""
    rows = items.select("item_id", row_key("item_id").alias("key"), words(F.col("text")).alias("w")).where(F.size("w") >= WORDS).dropDuplicates(["key"])
    rows = rows.select("item_id", "key", F.size("w").alias("n_words"), shingles(F.col("w")).alias("item"))
    return rows.withColumn("need", F.ceil(SIMILARITY * F.size("item") - 1e-9).cast("int"))


def rarest(items: DataFrame) -> DataFrame:
    """(key, h): of each item the shingles that the fewest items have (ties: by hash), as many as make up the item less ``need`` and one more; each h once."""
    each = items.select("key", "need", F.size("item").alias("n"), F.explode("item").alias("h")).groupBy("key", "need", "n", "h").agg(F.count("*").alias("times"))
    common = each.groupBy("h").agg(F.count("*").alias("among"))
    # an item is one row, so its own shingles are a bounded group
    ranked = each.join(common, "h").groupBy("key", "need", "n").agg(F.array_sort(F.collect_list(F.struct("among", "h", "times"))).alias("s"))
    before = F.transform("s", lambda x, i: F.struct(x["h"].alias("h"), F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["times"]).alias("before")))
    return ranked.select("key", F.explode(F.filter(before, lambda x: x["before"] <= F.col("n") - F.col("need"))).alias("x")).select("key", "x.h")


def shared_weight(a, b):
    """How many elements two arrays of hashes have in common, each as often as it occurs in both: one pass over both, sorted together."""
    side = lambda hashes, k: F.transform(hashes, lambda h: F.struct(h.alias("h"), F.lit(k).alias("k")))
    state = lambda h, n, m, total: F.struct(h.alias("h"), n.alias("n"), m.alias("m"), total.alias("total"))
    start = state(F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(0))
    done = lambda s: s["total"] + F.least(s["n"], s["m"])
    step = lambda s, x: F.when(s["h"] == x["h"], state(x["h"], s["n"] + 1 - x["k"], s["m"] + x["k"], s["total"])).otherwise(state(x["h"], 1 - x["k"], x["k"], done(s)))
    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), start, step, done)


def leaks(docs: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, own): documents with an item-sized window of weighted similarity 0.75 or more to a benchmark item.

    One row for a document and item, with the most similar window (ties: the first). A document shorter than an item counts as one window. Null texts, texts and items
    of fewer than five words match nothing. A document is its id and its text (own, their key), and so is an item: null ids, and ids that repeat with other texts, are
    searched and reported like others, and rows that repeat both count as one; of the items of one id and length the most similar is reported. Empty tables give no
    rows. Items are broadcast only up to 1,000,000 shingles, and their index up to as many rows; beyond that they are shuffled.
    """
    items = stored(item_table(items), "items")
    size = items.agg(F.sum(F.size("item")), F.max("n_words"), F.count("*")).first()
    within = lambda rows: F.broadcast if rows <= BROADCAST_ROWS else (lambda x: x)
    small, small_index = within(size[0] or 0), within(size[2] * (radius + 1))
    width = 16 if (size[1] or 0) < 1 << 16 else 32

    docs = docs.select("doc_id", "text", row_key().alias("own"))
    seen = docs.select("own", words(F.col("text")).alias("w")).select("own", F.explode(F.array_distinct(shingles(F.col("w")))).alias("h"))
    met = stored(seen.join(small(rarest(items)), "h").select("own", "key").distinct(), "met")
    texts = docs.join(met.select("own").distinct(), "own", "left_semi").select("own", "doc_id", words(F.col("text")).alias("w")).dropDuplicates(["own"])
    texts = stored(texts.select("own", "doc_id", F.size("w").alias("total"), shingles(F.col("w")).alias("all")), "texts")  # read twice
    wanted = met.join(small(items.select("key", "n_words", "need", F.array_distinct("item").alias("item"))), "key").select("own", "key", "n_words", "need", F.explode("item").alias("h"))
    places = texts.select("own", F.posexplode("all").alias("pos", "h"))
    hits = places.join(wanted, ["own", "h"]).groupBy("own", "key", "n_words", "need").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # a window with enough shared shingles begins between the last of ``need`` successive places, less its length, and the first of them
    n, need = F.col("n_words") - WORDS + 1, F.col("need")
    first = lambda i: F.element_at("at", i)
    after = lambda i: F.when(i > 1, F.try_element_at("at", F.greatest(i - 1, F.lit(1))) + 1).otherwise(F.lit(-(2**30)))
    span = lambda i: F.when(F.element_at("at", i + need - 1) - first(i) < n, F.sequence(F.greatest(F.element_at("at", i + need - 1) - n + 1, after(i)), first(i)))
    starts = F.flatten(F.array_compact(F.transform(F.sequence(F.lit(1), F.size("at") - need + 1), span)))
    wanted = hits.where(F.size("at") >= need).select("own", "key", "n_words", starts.alias("starts")).where(F.size("starts") > 0)
    wanted = wanted.groupBy("own").agg(F.collect_list(F.struct("key", "n_words", "starts")).alias("windows"))

    texts = texts.join(wanted, "own")
    texts = texts.select("own", "doc_id", "total", "all", F.explode("windows").alias("x"))
    room = F.greatest(F.col("total") - F.col("x.n_words"), F.lit(0))
    kept = F.array_distinct(F.transform("x.starts", lambda s: F.least(F.greatest(s, F.lit(0)), room)))
    windows = texts.select("own", "doc_id", "x.key", "x.n_words", "all", F.explode(kept).alias("start_word"))
    windows = windows.select("own", "doc_id", "key", "n_words", "start_word", F.expr(f"array_compact(transform(sequence(start_word, start_word + n_words - {WORDS}), i -> get(all, i)))").alias("window"))
    windows = stored(with_simhash(windows, "window", width).withColumnRenamed("fp", "fp_w"), "windows")  # read twice
    index = with_simhash(items, "item", width).select("key", "fp", F.explode(index_keys(F.col("fp"), radius)).alias("bits"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_w"))) <= radius
    place = ["own", "key", "start_word"]
    looked = windows.select(*place, "fp_w", F.explode(index_keys(F.col("fp_w"), radius)).alias("bits"))
    found = looked.join(small_index(index), ["key", "bits"]).where(near).select(*place).distinct()
    both = windows.join(found, place, "left_semi").join(small(items.select("item_id", "key", "item")), "key")
    scored = both.select("own", "doc_id", "item_id", "n_words", "start_word", (F.size("item") + F.size("window")).alias("sizes"), shared_weight("item", "window").alias("common"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("sizes") - F.col("common"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"))).alias("best")
    rows = scored.groupBy("own", "doc_id", "item_id", "n_words").agg(best)
    return rows.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "own")


def op8_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("own")


def _shingle_sql(name: str, key: str, table: str) -> str:
    return rf"""{name}w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '{_GAP}'), lambda w: w <> '') AS w FROM {table} WHERE text IS NOT NULL),
{name} AS (SELECT {key}, len(w) AS n_words, [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] AS s FROM {name}w WHERE len(w) >= {WORDS})"""


ORACLE_SQL = {
    "op8_simhash_decontam": f"""
WITH {_shingle_sql("d", "doc_id", "documents")},
{_shingle_sql("i", "item_id", "benchmark")},
dp AS (SELECT doc_id, n_words AS total, unnest(s) AS g, unnest(range(len(s))) AS pos FROM d),
ip AS (SELECT item_id, n_words, unnest(list_distinct(s)) AS g FROM i),
hits AS (SELECT DISTINCT doc_id, item_id, total, n_words, pos FROM dp JOIN ip USING (g)),
st AS (SELECT doc_id, item_id, total, n_words, unnest(range(pos - n_words + {WORDS}, pos + 1)) AS s0 FROM hits),
cnt AS (SELECT doc_id, item_id, total, n_words, s0, count(*) AS k FROM st GROUP BY ALL HAVING count(*) >= ceil({SIMILARITY} * (n_words - {WORDS - 1}) - 1e-9)),
win AS (SELECT DISTINCT doc_id, n_words, least(greatest(s0, 0), greatest(total - n_words, 0)) AS start_word FROM cnt),
pairs AS (SELECT win.doc_id, i.item_id, win.n_words, start_word, d.s[start_word + 1 : start_word + win.n_words - {WORDS - 1}] AS a, i.s AS b FROM win JOIN d USING (doc_id) JOIN i ON i.n_words = win.n_words),
sc AS (SELECT doc_id, item_id, n_words, start_word, len(a) + len(b) AS sizes,
  list_sum(list_transform(list_intersect(a, b), lambda h: least(len(list_filter(a, lambda x: x = h)), len(list_filter(b, lambda x: x = h))))) AS common FROM pairs),
ok AS (SELECT *, common / (sizes - common) AS similarity FROM sc WHERE common > 0)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_min(start_word, (-similarity, start_word))::BIGINT AS start_word, n_words::BIGINT AS n_words
FROM ok WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id, n_words
"""
}
