"""Exact top-k search by inner product.

Queries are dealt into blocks and candidates into shards; a block meets a shard as one matrix product, a partial selection keeps the best k of the tile
for each query, and the lists of a query are merged in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cerulea.llm.common import read_table

SCALE = 64
QUERY_BLOCK = 512
SHARD_ROWS = 8192
FAN_IN = 64
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in rising order and their vectors of whole numbers."""
    table = table.combine_chunks()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    values = np.floor(SCALE * table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(ids), -1)
    return ids[order], values[order]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def best_of_tile(k: int):
    """The best k candidates of a tile for each query: higher scores first, ties to the smaller id. A query never meets its own id."""

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _OUT.empty_table()
        q_ids, q = _matrix(queries)
        c_ids, c = _matrix(candidates)
        out = []
        for start in range(0, len(c_ids), SHARD_ROWS):  # a shard larger than planned is taken in parts
            ids, scores = c_ids[start : start + SHARD_ROWS], _products(q, c[start : start + SHARD_ROWS])
            n, most = len(ids), int(np.abs(scores).max(initial=0)) + 1
            other = q_ids[:, None] != ids[None, :]
            if most < 2**62 // n:
                key = np.where(other, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
                top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (len(q_ids), n))
            else:
                top = np.array([np.lexsort((ids, -s, ~o))[:k] for s, o in zip(scores, other, strict=True)])
            hit = np.take_along_axis(other, top, 1)
            out.append((np.repeat(q_ids, top.shape[1])[hit.ravel()], ids[top][hit], np.take_along_axis(scores, top, 1)[hit]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_OUT)

    return tile


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector that is not empty and holds only finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all candidates but those of its own id; all, if fewer.

    Both tables hold vec_id and embedding; each component x counts as floor(64 x). Rows with a null id or a null, empty or non-finite vector take no part,
    vectors meet only those of their own length; a query id that repeats counts once, with its smallest vector; candidates that repeat count as often as they
    come. Ties go to the smaller id. An empty side gives no rows. A tile holds about 512 queries and 8,192 candidates.
    """
    q, c = usable(queries), usable(candidates)
    q = q.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, shards = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // SHARD_ROWS))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """To a block or shard of its own by hash, and once to each of the other side."""
        return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    keys = ("block", "shard", "dim")
    tiles = dealt(q, "block", blocks, "shard", shards).groupBy(*keys).cogroup(dealt(c, "shard", shards, "block", blocks).groupBy(*keys))
    kernel = best_of_tile(k)

    def with_shard(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = kernel(queries, candidates)
        return out.append_column("shard", pa.array(np.full(out.num_rows, key[1].as_py(), np.int32)))

    lists = tiles.applyInArrow(with_shard, "query_id long, vec_id long, score long, shard int")
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


ORACLE_SQL = {
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
