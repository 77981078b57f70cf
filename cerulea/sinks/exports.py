"""Detections as GeoJSON and CSV, and tiles as PNG images."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cerulea.functions import geo
from cerulea.functions.text import CSV_HEADER, csv_line, fixed, google_link
from cerulea.operators.detect import ZOOM, crop_boxes
from cerulea.operators.ordering import numbered
from cerulea.operators.raster import BACKGROUND, SIDE, key_of


def closed(ring) -> Column:
    """A ring that ends where it begins; an empty one stays empty."""
    return F.when((F.size(ring) == 0) | (F.get(ring, 0) == F.try_element_at(ring, F.lit(-1))), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def features(ranked: DataFrame, parts: DataFrame, link: bool = False) -> DataFrame:
    """(rank, line): a GeoJSON feature for each detection. ``parts`` has (cluster, frag, ring), a ring of (lon, lat) for each fragment; one polygon a fragment, by name.

    A detection that is shown spans a few tiles, so its rings are few. With ``link`` a feature also has the address of a map.
    """
    shut = F.transform(closed(F.col("ring")), lambda p: F.array(p["lon"], p["lat"]))
    shapes = parts.select("cluster", F.struct("frag", F.array(shut).alias("polygon")).alias("part")).groupBy("cluster").agg(F.array_sort(F.collect_list("part")).alias("shapes"))
    number = lambda c, d: fixed(F.col(c), d).cast("double").alias(c)
    rows = ranked.join(shapes, "cluster", "left").select("*", number("area", 1).alias("area_m2"), number("lat", 6).alias("lat6"), number("lon", 6).alias("lon6"))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.coalesce(F.transform("shapes", lambda p: p["polygon"]), F.array()).alias("coordinates"))
    facts = F.struct(F.col("cluster").alias("id"), "rank", "kind", "area_m2", "confidence", F.col("lat6").alias("lat"), F.col("lon6").alias("lon"), "truncated", *([google_link(F.col("lat"), F.col("lon")).alias("google_maps")] if link else []))
    return rows.select("rank", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), facts.alias("properties"))).alias("line"))


def _write_ordered(lines: DataFrame, path: str, head: str, foot: str | None) -> None:
    """(rank, line) as text whose part files, put together in order of their names, are one document: range partitions, no single writer."""
    spark = lines.sparkSession
    ends = [(-1, head)] + ([(2**62, foot)] if foot is not None else [])
    rows = lines.select(F.col("rank").cast("long"), "line").unionByName(spark.createDataFrame(ends, "rank long, line string"))
    rows.repartitionByRange("rank").sortWithinPartitions("rank").select(F.col("line").alias("value")).write.text(path)


def write_geojson(found: DataFrame, path: str, **facts) -> None:
    """A FeatureCollection of (rank, line) with further top-level facts, such as zoom, imagery and time."""
    head = json.dumps({"type": "FeatureCollection", "generator": "cerulea", **facts})[:-1] + ', "features": ['
    comma = F.when(F.col("rank") > 1, ",").otherwise("")
    _write_ordered(found.select("rank", F.concat(comma, "line").alias("line")), path, head, "]}")


def write_csv(ranked: DataFrame, path: str) -> None:
    line = csv_line(*[F.col(c) for c in ("rank", "cluster", "kind", "lat", "lon", "area", "confidence", "truncated")])
    _write_ordered(ranked.select("rank", line.alias("line")), path, CSV_HEADER, None)


def png(rgb: np.ndarray) -> bytes:
    """An image of height x width x 3 bytes."""
    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], 1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _painted(tile: pa.Table) -> np.ndarray:
    image = np.empty((SIDE, SIDE, 3), np.uint8)
    image[:] = BACKGROUND
    image[tile["py"].to_numpy(), tile["px"].to_numpy()] = np.stack([tile[c].to_numpy() for c in "rgb"], 1)
    return image


def tile_images(pixels: DataFrame) -> DataFrame:
    """(tile, png) of tiles, by scan and zoom where the table has them, of at most 65,536 pixels (px, py, r, g, b); the rest is background."""
    key, types = key_of(pixels), dict(pixels.dtypes)
    rows = pixels.select(*key, *[F.col(c).cast("int").alias(c) for c in ("px", "py", "r", "g", "b")])

    def drawn(tile: pa.Table) -> pa.Table:
        return pa.table([pa.array([tile[c][0].as_py()], tile[c].type) for c in key] + [pa.array([png(_painted(tile))], pa.binary())], names=[*key, "png"])

    return rows.groupBy(*key).applyInArrow(drawn, ", ".join(f"{c} {types[c]}" for c in key) + ", png binary")


def _cropped(tile: pa.Table, crops: pa.Table) -> pa.Table:
    image, rows = _painted(tile), crops.to_pylist()
    shown = [png(image[c["y0"] : c["y0"] + c["height"], c["x0"] : c["x0"] + c["width"]]) for c in rows]
    return pa.table([pa.array([c["frag"] for c in rows], pa.string()), pa.array(shown, pa.binary())], names=["frag", "png"])


def thumbnails(frags: DataFrame, pixels: DataFrame) -> DataFrame:
    """(frag, png): a picture of each fragment. Pixels and fragments of a tile meet in one task; a tile has 65,536 pixels at most. Pixels that are not given are background."""
    key = key_of(frags)
    rows = pixels.select(*key, *[F.col(c).cast("int").alias(c) for c in ("px", "py", "r", "g", "b")])
    return rows.groupBy(*key).cogroup(crop_boxes(frags).groupBy(*key)).applyInArrow(_cropped, "frag string, png binary")


def with_thumbnails(found: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Detections with the picture of their main fragment; null where there is none."""
    return found.join(thumbs.withColumnRenamed("frag", "main"), "main", "left")


def _feature(geometry: Column, facts: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), facts.alias("properties")))


def tile_features(tiles: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """(rank, line): the square of each tile (tx, ty, perhaps scan and z) as a GeoJSON feature, for the grid of a plan or the area that was scanned. Without z all are of ``zoom``."""
    key = key_of(tiles)
    box = geo.tile_bounds(F.col("tx"), F.col("ty"), F.col("z") if "z" in key else F.lit(zoom))
    corners = [F.array(box[x], box[y]) for x, y in (("west", "north"), ("east", "north"), ("east", "south"), ("west", "south"), ("west", "north"))]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*corners)).alias("coordinates"))
    rows = numbered(tiles.select(*key).distinct(), [F.col(c) for c in key], "rank", 1)
    return rows.select("rank", _feature(shape, F.struct(*key)).alias("line"))


#: Fixed value: how many markers a map shows.
MARKERS = 250


def markers(ranked: DataFrame, most: int = MARKERS) -> DataFrame:
    """(rank, line): the first ``most`` of a ranking as GeoJSON points."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    facts = F.struct(F.col("cluster").alias("id"), "rank", "kind", "area", "confidence")
    return ranked.where(F.col("rank") <= most).select("rank", _feature(shape, facts).alias("line"))


def area_feature(ring) -> Column:
    """A ring as a GeoJSON feature; null for a null ring."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed(ring), lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))))
