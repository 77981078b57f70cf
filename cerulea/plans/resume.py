"""Scans that can be taken up again: which tiles are finished, and their fragments, each once.

A batch of tiles writes its fragments to ``folder``/fragments/batch=N and then its tiles to ``folder``/finished/batch=N, whose end is the mark that the batch counts. Both
replace what an earlier try of the same batch left, so a batch may be killed anywhere and run again; readers see the fragments of marked batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.operators.raster import key_of
from cerulea.sinks.shared import file_system


def _marked(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that ended: names of folders only."""
    system, where = file_system(spark, f"{folder}/finished/batch=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in system.globStatus(where) or [])


def finished(spark: SparkSession, folder: str, plan: DataFrame) -> DataFrame:
    """The tiles of the batches that ended, with the columns that name a tile in ``plan``."""
    paths = [f"{folder}/finished/batch={n}" for n in _marked(spark, folder)]
    tiles = plan.select(*key_of(plan))
    return spark.read.schema(tiles.schema).parquet(*paths) if paths else tiles.limit(0)


def pending(plan: DataFrame, folder: str) -> DataFrame:
    """The rows of ``plan`` (tile, idx, perhaps more) that no batch has finished."""
    return plan.join(finished(plan.sparkSession, folder, plan), key_of(plan), "left_anti")


def fragments(spark: SparkSession, folder: str) -> DataFrame | None:
    """The fragments of the batches that ended; None if there are none. What a killed batch left is not read."""
    paths = [f"{folder}/fragments/batch={n}" for n in _marked(spark, folder)]
    return spark.read.parquet(*paths) if paths else None


def step(plan: DataFrame, folder: str, scan: Callable[[DataFrame], DataFrame], tiles: int) -> bool:
    """Scans the next ``tiles`` tiles of ``plan`` by idx, and tells whether there were any. ``scan`` takes tiles to their fragments, by nothing but the tiles.

    The batch is named by its first idx, so the batch that a killed run left is the one that is run again. Tiles are taken by a range of idx, which needs no sort.
    """
    spark = plan.sparkSession
    first = pending(plan, folder).agg(F.min("idx")).first()[0]
    if first is None:
        return False
    batch = plan.where(F.col("idx").between(first, first + tiles - 1)).join(finished(spark, folder, plan), key_of(plan), "left_anti")
    scan(batch).write.mode("overwrite").parquet(f"{folder}/fragments/batch={first}")
    batch.select(*key_of(plan)).write.mode("overwrite").parquet(f"{folder}/finished/batch={first}")
    return True


def run(plan: DataFrame, folder: str, scan: Callable[[DataFrame], DataFrame], tiles: int) -> DataFrame | None:
    """Scans what is left of ``plan`` in batches of ``tiles`` tiles and gives the fragments of all of it."""
    while step(plan, folder, scan, tiles):
        pass
    return fragments(plan.sparkSession, folder)
