"""From component statistics to fragments, merged detections and their ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cerulea.functions import geo
from cerulea.functions.color import confidence
from cerulea.operators.graph import components
from cerulea.operators.ordering import numbered
from cerulea.operators.raster import SIDE, key_of, tile_components
from cerulea.sinks.shared import stored
from cerulea.sources.scene import ZOOM


@dataclass(frozen=True)
class Limits:
    """Fixed values of the filters."""

    min_pixels: int = 12
    max_aspect: float = 8
    min_fill: float = 0.22
    max_texture: float = 0.14
    min_area: float = 3
    max_area: float = 2000
    min_merged: float = 8
    hot_tub: float = 10
    adjacency_px: float = 2.5
    shown: float = 0.55


def fragments(stats: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Components (as ``raster.tile_components`` gives them) that may be pools, with their place on the map. Shapes cut by the tile's edge are spared the tests of form,
    but not those of texture and of sheer size. A table without z is of zoom 19."""
    rows = stats.where(F.col("pixels") >= limits.min_pixels)
    width, height = F.col("max_px") - F.col("min_px") + 1, F.col("max_py") - F.col("min_py") + 1
    z = F.col("z") if "z" in stats.columns else F.lit(ZOOM)
    x, y = F.col("tx") * geo.TILE, F.col("ty") * geo.TILE
    rows = rows.withColumns({"n": F.col("min_py") == 0, "w": F.col("min_px") == 0, "s": F.col("max_py") == SIDE - 1, "e": F.col("max_px") == SIDE - 1, "fill": F.round(F.col("pixels") / (width * height), 6)})
    rows = rows.withColumns({"lon": geo.lon_of(x + F.col("sum_px") / F.col("pixels") + 0.5, z), "lat": geo.lat_of(y + F.col("sum_py") / F.col("pixels") + 0.5, z), "edge": F.col("n") | F.col("w") | F.col("s") | F.col("e")})
    rows = rows.withColumns({"mpp": geo.metres_per_pixel(F.col("lat"), z), "west": geo.lon_of(x + F.col("min_px"), z), "east": geo.lon_of(x + F.col("max_px") + 1, z), "north": geo.lat_of(y + F.col("min_py"), z), "south": geo.lat_of(y + F.col("max_py") + 1, z)})
    rows = rows.withColumn("area", F.col("pixels") * F.col("mpp") * F.col("mpp"))
    formed = (F.greatest(width, height) / F.least(width, height) <= limits.max_aspect) & (F.col("fill") >= limits.min_fill) & F.col("area").between(limits.min_area, limits.max_area)
    kept = rows.where((F.col("texture") <= limits.max_texture) & F.when(F.col("edge"), F.col("area") <= 4 * limits.max_area).otherwise(formed))
    return kept.withColumn("frag", fragment_name(stats.columns, z))


def fragment_name(columns: list[str], z):
    """z/x/y:first column,first row of its box, after the scan where there is one."""
    name = F.format_string("%d/%d/%d:%d,%d", z.cast("long"), F.col("tx"), F.col("ty"), F.col("min_px"), F.col("min_py"))
    return F.concat(F.col("scan").cast("string"), F.lit("/"), name) if "scan" in columns else name


def merge_pairs(frags: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(a, b): fragments of the same or a neighbouring tile, both cut by an edge, the box of one grown by 2.5 pixels meeting the other's.

    The range condition is an equi-join on the tile: each fragment is sent to its 3 x 3 neighbourhood. Scans and zooms do not mix.
    """
    key = key_of(frags)
    cut = frags.where("edge").select("frag", *key, "west", "south", "east", "north", "mpp")
    around = F.array(*[F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    grown = geo.expanded(F.col("west"), F.col("south"), F.col("east"), F.col("north"), limits.adjacency_px * F.col("mpp"))
    probe = cut.select(F.col("frag").alias("a"), *key[:-2], *[c.alias(f"p_{k}") for k, c in grown.items()], F.explode(around).alias("t")).select("*", "t.tx", "t.ty").drop("t")
    met = geo.boxes_meet({k: F.col(f"p_{k}") for k in grown}, {k: F.col(k) for k in grown})
    pairs = probe.join(cut.withColumnRenamed("frag", "b"), key).where((F.col("a") != F.col("b")) & met)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def clusters(frags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frag, cluster): every fragment with the smallest name of its cluster. A coast may be one chain of thousands of tiles: the rounds grow with the logarithm of its length."""
    named = components(pairs).select(F.col("node").alias("frag"), "root")
    return frags.select("frag").join(named, "frag", "left").select("frag", F.coalesce("root", "frag").alias("cluster"))


def truncated(frags: DataFrame, scanned: DataFrame) -> DataFrame:
    """(frag): fragments that touch a side whose neighbouring tile is not in ``scanned``, the tiles that were looked at, with water or without."""
    key = key_of(frags)
    sides = F.array(*[F.when(F.col(side), F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"))) for side, dx, dy in (("n", 0, -1), ("s", 0, 1), ("w", -1, 0), ("e", 1, 0))])
    return frags.select("frag", *key[:-2], F.explode(F.array_compact(sides)).alias("t")).select("frag", *key[:-2], "t.tx", "t.ty").join(scanned, key, "left_anti").select("frag").distinct()


def merged(frags: DataFrame, labels: DataFrame, scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each cluster: sums, pixel-weighted means, the box, the truncation and the confidence. ``open_water`` marks what exceeds a legal pool, ``shown`` what is
    emitted. Which tiles and outlines a cluster has is in ``parts_of``, a table, as a coast has very many."""
    rows = frags.join(labels, "frag").join(truncated(frags, scanned).withColumn("cut", F.lit(True)), "frag", "left")
    return summed(rows, limits)


def summed(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each cluster of fragments with their cluster and ``cut``, true where a side is open."""
    n = F.sum("pixels")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("pixels")) / n, 6)
    once = [F.first(c).alias(c) for c in key_of(rows)[:-2]]
    rows = rows.groupBy("cluster").agg(
        *once, n.alias("pixels"), F.sum("area").alias("area"), F.count("*").alias("parts"), F.count_distinct("tx", "ty").alias("tiles"),
        *[mean(c).alias(c) for c in ("hue", "saturation", "value", "strict", "fill", "texture")],
        F.round(F.sum(F.col("lon") * F.col("pixels")) / n, 8).alias("lon"), F.round(F.sum(F.col("lat") * F.col("pixels")) / n, 8).alias("lat"),
        *[f(c).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))],
        F.coalesce(F.max("cut"), F.lit(False)).alias("truncated"), F.max_by("frag", F.struct("pixels", "frag")).alias("main"),
    )
    sure = confidence(F.col("strict"), F.col("hue"), F.col("saturation"), F.col("texture"), F.col("fill"), F.round("area", 6), F.col("truncated"))
    return rows.withColumns({"confidence": sure, "kind": F.when(F.col("area") <= limits.hot_tub, "hot_tub").otherwise("pool"), "open_water": F.col("area") > limits.max_area, "shown": F.col("area").between(limits.min_merged, limits.max_area), "area": F.round("area", 6)})


def parts_of(frags: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, tile, frag): the tiles of each cluster."""
    return frags.join(labels, "frag").select("cluster", F.substring_index("frag", ":", 1).alias("tile"), "frag")


#: Pixels around a fragment that its picture shows, and the largest side of a picture.
CROP_MARGIN, CROP_SIDE = 6, 120


def crop_boxes(frags: DataFrame) -> DataFrame:
    """(frag, tile, x0, y0, width, height): the part of the tile that shows a fragment, cut at the tile's edge, and at the largest side to the east and south."""
    rows = frags.select("frag", *key_of(frags), *[F.greatest(F.lit(0), F.col(c) - CROP_MARGIN).cast("long").alias(n) for c, n in (("min_px", "x0"), ("min_py", "y0"))], "max_px", "max_py")
    side = lambda last, first: F.least(F.lit(CROP_SIDE), F.least(F.lit(SIDE), F.col(last) + 1 + CROP_MARGIN) - F.col(first)).cast("long")
    return rows.withColumns({"width": side("max_px", "x0"), "height": side("max_py", "y0")}).drop("max_px", "max_py")


def detections(pixels: DataFrame, scanned: DataFrame, limits: Limits = Limits(), detector=tile_components) -> DataFrame:
    """Pixels to merged detections. ``scanned`` names the tiles that were looked at; ``detector`` takes pixels to components and may be any other with its columns."""
    frags = stored(fragments(detector(pixels), limits), "fragments")  # read by each step of the merging
    return merged(frags, clusters(frags, merge_pairs(frags, limits)), scanned, limits)


def visible(found: DataFrame, hot_tubs: bool = True, limits: Limits = Limits()) -> DataFrame:
    """What a list of results shows: emitted, sure enough, and with or without hot tubs."""
    rows = found.where(F.col("shown") & (F.col("confidence") >= limits.shown))
    return rows if hot_tubs else rows.where("kind <> 'hot_tub'")


def totals(found: DataFrame) -> DataFrame:
    """(n, area): how many detections, and their area together."""
    return found.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 3).alias("area"))


ORDER = (F.desc, "area"), (F.desc, "confidence"), (F.asc, "cluster")


def ranked(found: DataFrame, *scan: str) -> DataFrame:
    """Largest area first, then confidence, then name; ranks run within each scan, or over all: then rows are ranked in ranges, no task sees all of them."""
    order = [f(c) for f, c in ORDER]
    if scan:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*scan).orderBy(*order)))
    return numbered(found, order, "rank", 1).withColumn("rank", F.col("rank").cast("int"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k of the ranking, ranked: each task hands on k rows."""
    order = [f(c) for f, c in ORDER]
    return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
