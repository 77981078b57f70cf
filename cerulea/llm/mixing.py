"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Block i of a source that should get w of every W slots may go out from floor(i*W/w) on (its release) and must
be out before ceil((i+1)*W/w) (its deadline). Earliest deadline first among the released blocks meets all deadlines, as the weights fill every slot,
so after any number of slots each source is less than one block away from its share. The pattern repeats every W slots: one period is laid out
once from the weights alone, and every block finds its slot by arithmetic.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cerulea.llm.common import read_table, stored

BLOCK_ROWS = 16
PERIOD = 1000
MOST_SOURCES = 10_000


def key_of(source: str | None) -> str:
    """What a source goes by inside: a null one is told from every name, and sorts first."""
    return "" if source is None else "=" + source


def quantised(share: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole slots of a period of about ``period``: rounded half up, 1 at least."""
    total = sum(share.values())
    return {s: max(1, math.floor(period * x / total + 0.5)) for s, x in share.items()}


def one_period(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, i, slot) for a whole period, earliest deadline first; equal deadlines go by source name. Its size is that of the weights."""
    total, out = sum(slots.values()), []
    deadline = lambda s, i: (-(-(i + 1) * total // slots[s]), s, i)
    later, ready = [(0, s, 0) for s in sorted(slots)], []
    for t in range(total):
        while later and later[0][0] <= t:
            _, s, i = heapq.heappop(later)
            heapq.heappush(ready, deadline(s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, t))
        if i + 1 < slots[s]:
            heapq.heappush(later, ((i + 1) * total // slots[s], s, i + 1))
    return out


def target_weights(counts: dict[str, int], weights: dict[str, float] | None, period: int = PERIOD) -> dict[str, int]:
    """Slots a period by key of the source. Without ``weights``: as the square root of the rows, which lifts small sources. A source without a weight gets one slot."""
    if weights is None:
        return quantised({s: math.sqrt(n) for s, n in counts.items()}, period) if counts else {}
    known = {s: w for s, w in weights.items() if s in counts and w > 0}
    given = quantised(known, period) if known else {}
    return {s: given.get(s, 1) for s in counts}


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, mix_source, block, place, release, deadline, mix_slot) for every row, and the columns named in ``keep``: sorted by mix_slot and place, the corpus is mixed.

    Rows of a source go by doc_id; a null source is a source of its own (mix_source is null, its weight goes by None), null ids come first, equal ids in any order, each row with a place of its own; no other column
    is read. No row is dropped or repeated: when a source runs out its slots stay empty and the others keep their ratio. An empty table gives no rows. Rows are dealt
    in ranges of (source, doc_id) that Spark draws from a sample, equal ids included, so neither a source with most rows, an id far off nor an id that repeats fills a
    task; the place within a source comes from the numbers of the rows in their range and the counts of the ranges before.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), *keep)  # as key_of
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = stored(rows.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "mix-order")  # numbers are drawn once

    ranges = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    found = rows.groupBy("key").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: weights are kept per source, so map the sources to fewer groups first")
    slots = target_weights({r["key"]: r["n"] for r in found}, weights and {key_of(s): w for s, w in weights.items()}, period)
    total = max(1, sum(slots.values()))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a source has a row here for each range it has rows in
    starts = ranges.select(F.col("key").alias("s_key"), F.col("part").alias("s_part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    weight = spark.createDataFrame(sorted(slots.items()), "key string, w long")  # MOST_SOURCES rows at most
    pattern = spark.createDataFrame(one_period(slots), "key string, i long, at long")  # a row for each slot of a period
    place = F.col("seq") + F.col("shift")
    block = F.floor(place / block_rows).cast("long")
    return (
        rows.join(starts, (F.col("key") == F.col("s_key")) & (F.col("part") == F.col("s_part")))
        .select("doc_id", "key", block.alias("block"), (place % block_rows).alias("place"), *keep)
        .join(F.broadcast(weight), "key")
        .withColumn("i", F.col("block") % F.col("w"))
        .join(F.broadcast(pattern), ["key", "i"])
        .select(
            "doc_id",
            F.expr("CASE WHEN key <> '' THEN substr(key, 2) END").alias("mix_source"),
            "block",
            "place",
            F.expr(f"(block * {total}) div w").alias("release"),
            F.expr(f"((block + 1) * {total} + w - 1) div w").alias("deadline"),
            F.expr(f"(block div w) * {total} + at").alias("mix_slot"),
            *keep,
        )
    )


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"))


_SQL = f"""
WITH RECURSIVE named AS (SELECT doc_id, coalesce('=' || source, '') AS key FROM documents),
counts AS (SELECT key, count(*) AS n FROM named GROUP BY 1),
weights AS (SELECT key, greatest(1, floor({PERIOD} * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) + 0.5))::BIGINT AS w, row_number() OVER (ORDER BY key) AS k FROM counts),
lists AS (SELECT list(w ORDER BY k) AS ws, sum(w)::BIGINT AS total, count(*) AS n FROM weights),
edf(t, sent, pick) AS (
  SELECT 0::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, list_transform(sent, lambda x, k: CASE WHEN k = best % 100000 THEN x + 1 ELSE x END), best % 100000
  FROM (SELECT t, sent, list_min(list_transform(ws, lambda w, k: CASE WHEN sent[k] < w AND (sent[k] * total) // w <= t
          THEN (((sent[k] + 1) * total + w - 1) // w) * 100000 + k ELSE 9000000000000000000 END)) AS best FROM edf, lists WHERE t < total)
),
pattern AS (SELECT pick AS k, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS i, t - 1 AS slot_at FROM edf WHERE t > 0),
placed AS (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS p FROM named)
SELECT doc_id, CASE WHEN key <> '' THEN substr(key, 2) END AS mix_source, p // {BLOCK_ROWS} AS block, p % {BLOCK_ROWS} AS place,
  ((p // {BLOCK_ROWS}) * total) // w AS release, ((p // {BLOCK_ROWS} + 1) * total + w - 1) // w AS deadline,
  ((p // {BLOCK_ROWS}) // w) * total + slot_at AS mix_slot
FROM placed JOIN weights USING (key) CROSS JOIN lists JOIN pattern ON pattern.k = weights.k AND pattern.i = (p // {BLOCK_ROWS}) % w
"""

ORACLE_SQL = {"op1_pfair_mix": _SQL}
