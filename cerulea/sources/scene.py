"""A raster scene derived by arithmetic from a key column: one coloured rectangle a key on a lattice of tiles, later keys on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZOOM, TILE_X, TILE_Y = 19, 250400, 201560
#: Fixed colours: water, pale water, grass, blue roof, grey.
COLOURS = ((45, 170, 190), (150, 205, 215), (80, 140, 60), (60, 80, 200), (120, 118, 115))

#: Pixels that a task paints, about.
TASK_PIXELS = 1 << 17


def rectangles(keys: DataFrame) -> DataFrame:
    """(k, gx, gy, w, h, r, g, b) of a one-column table of keys."""
    k = F.col("k")
    channel = lambda c: F.element_at(F.array(*[F.lit(x[c]) for x in COLOURS]), (k % 5 + 1).cast("int"))
    return keys.select(
        "k",
        ((k % 16) * 128 + (k * 37) % 120).alias("gx"),
        (F.floor(k / 16) * 128 + (k * 53) % 120).alias("gy"),
        (8 + (k * 11) % 40).alias("w"),
        (6 + (k * 7) % 24).alias("h"),
        *(channel(c).alias(n) for c, n in enumerate("rgb")),
    )


def pixels(rects: DataFrame) -> DataFrame:
    """(tx, ty, px, py, r, g, b): the painted pixels, the highest key winning; positions may be negative."""
    painted = rects.agg(F.sum(F.col("w") * F.col("h"))).first()[0] or 0  # one number
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / 256), F.floor((F.col(at) + F.col(size) - 1) / 256)))
    parts = rects.select("*", span("gx", "w").alias("cx")).select("*", span("gy", "h").alias("cy"))
    place = [(TILE_X + F.col("cx")).cast("int").alias("tx"), (TILE_Y + F.col("cy")).cast("int").alias("ty")]
    ends = [f(F.col(at), F.col(cell) * 256) - F.col(cell) * 256 for f, at, cell in ((F.greatest, "gx", "cx"), (F.greatest, "gy", "cy"))]
    ends += [F.least(F.col(at) + F.col(size) - 1 - F.col(cell) * 256, F.lit(255)) for at, size, cell in (("gx", "w", "cx"), ("gy", "h", "cy"))]
    parts = parts.select("k", "r", "g", "b", *place, *[c.cast("int").alias(n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)])
    # the rectangles of a tile meet before they are painted: the exchange is of rectangles, and no task paints many tiles
    dealt = parts.repartition(max(1, -(-painted // TASK_PIXELS)), "tx", "ty")
    across = dealt.select("*", F.explode(F.sequence("x0", "x1")).alias("px"))
    grid = across.select("k", "tx", "ty", "px", "r", "g", "b", F.explode(F.sequence("y0", "y1")).alias("py"))
    top = grid.groupBy("tx", "ty", "px", "py").agg(F.max_by(F.struct("r", "g", "b"), "k").alias("c"))
    return top.select("tx", "ty", "px", "py", "c.r", "c.g", "c.b")


def supplier_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(rectangles(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))))


def supplier_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, ty) of the tiles that the rectangles reach, from their corners: no pixel is painted for it."""
    rects = rectangles(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")))
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / 256), F.floor((F.col(at) + F.col(size) - 1) / 256)))
    cells = rects.select("gy", "h", span("gx", "w").alias("x")).select("x", span("gy", "h").alias("y"))
    return cells.select((TILE_X + F.col("x")).cast("int").alias("tx"), (TILE_Y + F.col("y")).cast("int").alias("ty")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, lon, lat): a point on the map for each event."""
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (-179.0 + F.lit(358.0) * ((e * 104729) % 100003) / 100003).alias("lon"), (-85.0 + F.lit(170.0) * ((e * 7919) % 100003) / 100003).alias("lat"))


#: One rectangle of water above the lattice that is larger than any pool: west, north and side in pixels.
LAKE = (300, -900, 600)


def scanned_scene(spark: SparkSession, sf_dir: str, table: str = "supplier", key: str = "s_suppkey") -> tuple[DataFrame, DataFrame]:
    """Pixels of the lattice and the lake, and (tx, ty) of all tiles that were looked at: whole rows of tiles, from the lake's down to the last painted one but for
    each fifth column, so that there are tiles without water, and tiles beyond the edge of what was scanned."""
    rects = rectangles(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k")))
    x, y, side = LAKE
    lake = spark.range(1).select(F.lit(-1).cast("long").alias("k"), *[F.lit(v).cast("long").alias(c) for c, v in (("gx", x), ("gy", y), ("w", side), ("h", side))], *[F.lit(COLOURS[0][k]).alias(c) for k, c in enumerate("rgb")])
    painted = pixels(rects.unionByName(lake))
    rows = rects.select(F.floor(F.col("gy") / 256).alias("row")).union(rects.select(F.floor((F.col("gy") + F.col("h") - 1) / 256))).agg(F.max("row").alias("last"))
    rows = rows.select(F.explode(F.sequence(F.lit(y // 256).cast("long"), "last")).alias("row"))
    tiles = rows.select((TILE_Y + F.col("row")).cast("int").alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("column")).where("column % 5 <> 4")
    return painted, tiles.select((TILE_X + F.col("column")).cast("int").alias("tx"), "ty")


def analytic_fragments(rects: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """Fragments as of rectangles of water, by formula: for (tx, ty, x, y, w, h) and perhaps z and scan, the columns that merging reads."""
    from cerulea.functions import geo

    z = F.col("z") if "z" in rects.columns else F.lit(zoom)
    left, top = F.col("tx") * geo.TILE + F.col("x"), F.col("ty") * geo.TILE + F.col("y")
    rows = rects.withColumns({"pixels": F.col("w") * F.col("h"), "lon": geo.lon_of(left + F.col("w") / 2, z), "lat": geo.lat_of(top + F.col("h") / 2, z), "west": geo.lon_of(left, z), "east": geo.lon_of(left + F.col("w"), z), "north": geo.lat_of(top, z), "south": geo.lat_of(top + F.col("h"), z)})
    rows = rows.withColumns({"mpp": geo.metres_per_pixel(F.col("lat"), z), "hue": F.lit(188.0), "saturation": F.lit(0.7), "value": F.lit(0.7), "strict": F.lit(0.9), "fill": F.lit(1.0), "texture": F.lit(0.01), "min_px": F.col("x"), "min_py": F.col("y")})
    rows = rows.withColumns({"area": F.col("pixels") * F.col("mpp") * F.col("mpp"), "at_e": F.col("x") + F.col("w") >= 256, "at_s": F.col("y") + F.col("h") >= 256, "n": F.col("y") <= 0}).drop("w", "h")
    rows = rows.withColumns({"w": F.col("x") <= 0}).withColumnsRenamed({"at_e": "e", "at_s": "s"}).withColumn("edge", F.col("n") | F.col("e") | F.col("s") | F.col("w"))
    name = F.format_string("%d/%d/%d:%d,%d", z.cast("long"), F.col("tx"), F.col("ty"), F.col("min_px"), F.col("min_py"))
    return rows.withColumn("frag", F.concat(F.col("scan").cast("string"), F.lit("/"), name) if "scan" in rects.columns else name).drop("x", "y")
