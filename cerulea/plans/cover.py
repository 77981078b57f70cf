"""Which tiles cover an area, and in which order to visit them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.functions import geo
from cerulea.operators.ordering import numbered

EXACT_TILES = 50_000


def box_of(ring: list[tuple[float, float]], z: int) -> tuple[int, int, int, int]:
    """First and last column, first and last row of the tiles in the ring's box."""
    n = 2**z
    across = lambda lon: min(max(math.floor((lon + 180) / 360 * n), 0), n - 1)

    def down(lat: float) -> int:
        bounded = math.radians(max(-geo.MAX_LATITUDE, min(geo.MAX_LATITUDE, lat)))
        return min(max(math.floor((1 - math.asinh(math.tan(bounded)) / math.pi) / 2 * n), 0), n - 1)

    lon, lat = [p[0] for p in ring], [p[1] for p in ring]
    return across(min(lon)), across(max(lon)), down(max(lat)), down(min(lat))


def candidates(spark: SparkSession, ring: list[tuple[float, float]], z: int) -> DataFrame:
    """(tx, ty) of the tiles in the ring's box."""
    lon, lat = [p[0] for p in ring], [p[1] for p in ring]
    zoom = F.lit(z)
    span = lambda axis, a, b: F.sequence(geo.tile_of(axis(F.lit(a), zoom), zoom), geo.tile_of(axis(F.lit(b), zoom), zoom))
    return spark.range(1).select(F.explode(span(geo.world_x, min(lon), max(lon))).alias("tx")).select("tx", F.explode(span(geo.world_y, max(lat), min(lat))).alias("ty"))


def cover(spark: SparkSession, ring: list[tuple[float, float]], z: int) -> DataFrame:
    """(tx, ty) of the tiles that touch the ring. The ring is a literal, so no join is needed; a tile's bounds are computed once and bound to a variable."""
    bounds = geo.tile_bounds(F.col("tx"), F.col("ty"), F.lit(z))
    box = F.array(F.struct(*[c.alias(k) for k, c in bounds.items()]))
    return candidates(spark, ring, z).where(F.exists(box, lambda b: geo.box_meets_ring({k: b[k] for k in bounds}, ring)))


def serpentine(tiles: DataFrame, low_y: int) -> DataFrame:
    """Row by row from the north, every other row backwards; rows are counted from the box's first one."""
    key = F.when((F.col("ty") - low_y) % 2 == 0, F.col("tx")).otherwise(-F.col("tx"))
    return numbered(tiles, [F.col("ty"), key], "idx")


def spiral(tiles: DataFrame, centre_x: int, centre_y: int) -> DataFrame:
    """Rings around the centre; in each: top from the west, right side down, bottom from the east, left side up. The order is a closed-form key."""
    dx, dy = F.col("tx") - centre_x, F.col("ty") - centre_y
    r = F.greatest(F.abs(dx), F.abs(dy))
    side = F.when(dy == -r, 0).when(dx == r, 1).when(dy == r, 2).otherwise(3)
    along = F.when(side == 0, dx).when(side == 1, dy).when(side == 2, -dx).otherwise(-dy)
    return numbered(tiles, [r, side, along], "idx")


def estimate(spark: SparkSession, ring: list[tuple[float, float]], z: int, exact: int = EXACT_TILES) -> DataFrame:
    """(tiles, approximate): the tiles of the ring, counted, or those of its box where these are more than ``exact``."""
    x0, x1, y0, y1 = box_of(ring, z)
    boxed = (x1 - x0 + 1) * (y1 - y0 + 1)
    if boxed > exact:
        return spark.range(1).select(F.lit(boxed).cast("long").alias("tiles"), F.lit(True).alias("approximate"))
    return cover(spark, ring, z).agg(F.count("*").alias("tiles"), F.lit(False).alias("approximate"))


def grid(points: DataFrame, n: int, z: int) -> DataFrame:
    """``points`` (with lon and lat) and tx, ty: n x n tiles around the tile of each point, row by row, one more before than after it if n is even."""
    zoom, steps = F.lit(z), F.sequence(F.lit(-(n // 2)), F.lit(n - 1 - n // 2))
    at = lambda axis, c: geo.tile_of(axis(F.col(c), zoom), zoom)
    rows = points.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return rows.withColumns({"tx": at(geo.world_x, "lon") + F.col("dx"), "ty": at(geo.world_y, "lat") + F.col("dy")}).drop("dx", "dy")
