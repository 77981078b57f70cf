"""Which release of the imagery a scan saw: the last one of its tile that is not younger than the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a period. A tile's rows of one period are sorted together, so a tile that is scanned very often is split.
PERIOD = 30 * 24 * 3600


def as_of(scans: DataFrame, releases: DataFrame, key: list[str], at: str = "at", period: int = PERIOD) -> DataFrame:
    """``scans`` with the columns of the release that was current: of the same key, the one with the greatest ``at`` up to the scan's own, else nulls.

    Both sides are put into one table and sorted by time within a tile and a period; the last release so far is carried over the scans. What was current when a period
    began comes from a row for each tile and period. No range join, no pairs. Releases of one key and time count as one, the one with the greatest other columns; rows
    with a null key or time meet nothing. ``at`` is in seconds; the release's is returned as ``released_at``.
    """
    facts = [c for c in releases.columns if c not in (*key, at)]
    slot = F.floor(F.col(at) / period)
    best = F.max(F.struct(F.col(at).alias("released_at"), *facts)).alias("release")
    known = releases.dropna("any", subset=[*key, at]).select(*key, at, *facts)
    ends = known.groupBy(*key, slot.alias("_slot")).agg(best)
    # the last release before a period, for each period of a tile that holds anything
    used = scans.select(*key, slot.alias("_slot")).distinct().join(ends, [*key, "_slot"], "full")
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = used.select(*key, "_slot", F.last("release", ignorenulls=True).over(before).alias("_carried"))
    old = known.groupBy(*key, at).agg(best).withColumns({"_slot": slot, "_scan": F.lit(None).cast(scans.schema)})
    new = scans.select(*key, at, F.lit(None).cast(old.schema["release"].dataType).alias("release"), slot.alias("_slot"), F.struct(*scans.columns).alias("_scan"))
    within = Window.partitionBy(*key, "_slot").orderBy(at, F.col("_scan").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = old.select(*new.columns).union(new).withColumn("_last", F.last("release", ignorenulls=True).over(within)).where(F.col("_scan").isNotNull())
    rows = seen.join(carried, [*key, "_slot"], "left").select("_scan", F.coalesce("_last", "_carried").alias("_release"))
    return rows.select("_scan.*", "_release.released_at", *[F.col(f"_release.{c}").alias(c) for c in facts])
