"""Importance resampling towards a target distribution over hashed word runs.

Documents become a sparse matrix of counts, documents by buckets, in compressed sparse row (CSR) blocks. Column sums of the blocks give the two distributions, their
ratio a gain for each bucket, and the product of the matrix with the gains a weight for each document. The matrix is made twice and never kept: as rows of a table,
blocks would be read, and handed on, thousands at once. Random keys of the ids turn weights into a draw without replacement: the highest sums of weight and key.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, stored, text_blocks, word_bounds
from cerulea.operators.ordering import numbered

WORD_RUN, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Characters of the texts of a block of the matrix; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Features of more bytes than this are hashed one by one.
LONG = 64

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_POLYNOMIAL = np.uint32(0xEDB88320)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return table


_TABLE = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes, all ranges together byte by byte."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    begin, length = start[order], size[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    far = np.searchsorted(-length, -LONG, side="left")  # the ranges before it are longer
    for k in range(int(length[far]) if far < len(length) else 0):
        live = slice(far, int(np.searchsorted(-length, -k, side="left")))
        crc[live] = _TABLE[(crc[live] ^ data[begin[live] + k]) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for i in order[:far]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def counts(texts: list[str | None], run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, row starts, buckets, counts): the CSR block of these texts."""
    joined = [b" ".join(_WORD.findall((t or "").encode("utf-8", "surrogatepass").lower())) for t in texts]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    start, end = word_bounds(data != 0x20)
    of = np.searchsorted(np.cumsum([len(j) + 1 for j in joined]), start, side="right")
    keys = []
    for k in range(run):
        first = np.flatnonzero(of[: len(of) - k] == of[k:])
        keys.append(of[first] * buckets + crc32_of(data, start[first], end[first + k]) % buckets)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(texts) + 1) * buckets)
    return np.bincount(of, minlength=len(texts)), starts, key % buckets, count


def csr_blocks(texts: list[str | None], run: int, buckets: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first text, end, ``counts`` of these texts), one block of the matrix after another: a task holds one at a time."""
    for lo, hi in text_blocks(texts, BLOCK_CHARS):
        yield lo, hi, counts(texts[lo:hi], run, buckets)


def column_sums(docs: DataFrame, run: int = WORD_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the sums of the columns of the matrix of ``docs`` (text) that have any; each task adds up its blocks before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, (_, _, at, n) in csr_blocks(batch.column("text").to_pylist(), run, buckets):
                np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the target's to the source's smoothed share of each bucket: as many numbers as buckets, whatever the tables' sizes."""
    spark = source.sparkSession
    some = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(some.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket", "left")
    held = each.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    sums = held.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    found = held.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of sums
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, gain: np.ndarray, run: int = WORD_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight): the product of the matrix of ``docs`` (doc_id, text) with the gains, block by block; tie is a hash of the text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "tie", "n_words", "n_features", "weight"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, (words, starts, at, n) in csr_blocks(batch.column("text").to_pylist(), run, buckets):
                summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[starts])  # noqa: E731, B023
                ids, tie = batch.column("doc_id")[lo:hi], batch.column("tie")[lo:hi]
                yield pa.RecordBatch.from_arrays([ids, tie, pa.array(words), pa.array(summed(n)), pa.array(summed(held.value[at] * n))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(multiply, ", ".join(f"{c} long" for c in names))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = WORD_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of ``docs`` (doc_id, text), and the place in the draw of those that are drawn towards ``target`` (text).

    Of the N rows of at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller id (null last), then by a hash of the
    text. A null or empty text has no features and weight 0; a null id draws its key as the empty text does. Rows that repeat an id have one key, each is a row of its
    own with its own weight, and those that repeat the text too get successive ranks. An empty target leaves only smoothing; an empty table gives no rows.
    """
    gain = gains(column_sums(docs, run, buckets), column_sums(target, run, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((key + 0.5) / 4294967296)))
    scored = stored(weights(docs, gain, run, buckets).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    # the row's number splits rows that repeat id and text over several ranges
    placed = numbered(able.withColumn("row", F.monotonically_increasing_id()), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")], "rank", 1)
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.union(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op12_importance_resampling": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS f FROM d),
b AS (SELECT unnest({_WORDS_SQL}) AS f FROM benchmark),
h AS (SELECT f, hex(encode(f)) AS hx FROM (SELECT f FROM x UNION SELECT f FROM b)),
y AS (SELECT f, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT) AS bytes FROM h),
c AS (SELECT f, xor(list_reduce(bytes, lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM y),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM x JOIN c USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN c USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM x)::DOUBLE + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
p AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM x JOIN c USING (f) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN p USING (doc_id)),
n AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM n) // 100 THEN place END::BIGINT AS rank FROM r LEFT JOIN n USING (doc_id)
"""
}
