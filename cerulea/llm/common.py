"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.sinks.shared import stored as stored  # the operators take it from here

#: Characters of whole texts that a model may be fitted on: what the driver holds at once.
SAMPLE_CHARS = 32_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents that no model may learn from: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """128 bits of a row's id and text, null ones included: rows of one id with other texts, and texts of null ids, are told apart; rows that repeat both are not."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.when(F.col(text).isNull(), "\n").otherwise("\t"), F.coalesce(text, F.lit(""))).cast("binary")))


def sample_texts(docs: DataFrame, ids: list, most_chars: int = SAMPLE_CHARS) -> list[tuple]:
    """(doc_id, text) of the documents with these ids, in the order of ``ids``: one whole text for each id, whichever of its texts has the smallest hash.

    ``ids`` must be bounded. A text that would bring the sum beyond ``most_chars`` characters is left out, so neither an id with very many rows nor very long texts
    can fill the driver. Null texts count as empty.
    """
    if not ids:
        return []
    spark, key = docs.sparkSession, F.xxhash64("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema))  # as many rows as ids
    sizes = rows.select("doc_id", key.alias("key"), F.length("text").alias("n")).join(wanted, "doc_id").groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("x"))
    found, left, picked = {r["doc_id"]: r["x"] for r in sizes.collect()}, most_chars, []
    for i in dict.fromkeys(ids):
        if i in found and found[i]["n"] <= left:
            left -= found[i]["n"]
            picked.append((i, found[i]["key"]))
    if not picked:
        return []
    chosen = F.broadcast(spark.createDataFrame([(i, k) for i, k in picked], docs.select("doc_id").schema.add("key", "long")))
    texts = rows.withColumn("key", key).join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    held = {r["doc_id"]: r["text"] for r in texts.select("doc_id", "text").collect()}
    return [(i, held[i]) for i, _ in picked]


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- texts as one byte array -------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any byte range of an array from one prefix sum (a polynomial hash modulo 2**64 over random byte values)."""

    def __init__(self, data: np.ndarray):
        power = np.full(len(data) + 1, _ODD)
        power[0] = 1
        np.cumprod(power, out=power)
        self.inverse = np.full(len(data) + 1, _INV)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def word_bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_blocks(texts: list[str | None], size: int = 1 << 21, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` characters together and ``rows`` texts at most, one text at least; bounds the memory of a kernel."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text or "") + 1
        if total >= size or i + 1 - begin >= rows:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
