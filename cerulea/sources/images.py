"""Tiles from image files laid out as z=/x=/y=, or kept in one folder under names made of their place and address, read by Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.functions.text import cache_key, tile_url
from cerulea.operators.raster import SIDE

_PIXELS = pa.schema([("z", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), *[(c, pa.int32()) for c in ("px", "py", "r", "g", "b", "a")]])


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            width, height, channels = row["width"], row["height"], row["channels"]
            data = np.frombuffer(row["data"], np.uint8).reshape(height * width, channels).astype(np.int32)
            blue, green, red = (data[:, min(k, channels - 1)] for k in range(3))
            alpha = data[:, 3] if channels == 4 else np.full(len(data), 255, np.int32)
            place = np.arange(len(data), dtype=np.int32)
            parts = max(1, width // SIDE)  # tiles on a side, of a deeper zoom
            across, down = place % width, place // width
            key = np.full(len(data), row["z"] + parts.bit_length() - 1, np.int32), row["x"] * parts + across // SIDE, row["y"] * parts + down // SIDE
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (*key, across % SIDE, down % SIDE, red, green, blue, alpha)], schema=_PIXELS)


_IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
#: Names of kept tiles: zoom, column, row and 24 hex digits of their address's digest. Fixed format.
_KEPT = "^[0-9]{1,2}-[0-9]{1,9}-[0-9]{1,9}-[0-9a-f]{24}[.]bin$"


def _placed(files: DataFrame, tile: dict[str, Column], chosen: Column | str | None) -> DataFrame:
    """Every image file with its tile, its size (-1 if it cannot be read) and whether its pixels can be placed: up to 256 x 256, or a square of 256 times a power of two."""
    named = files.select(*[c.cast("int").alias(n) for n, c in tile.items()], "image")
    if chosen is not None:  # by names of files and folders only, so files left out are not opened
        named = named.where(chosen)
    plain = named.select("z", F.col("tx").alias("x"), F.col("ty").alias("y"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    fits = (F.col("height") <= SIDE) & (F.col("width") <= SIDE)
    square = (F.col("height") == F.col("width")) & (F.col("width") % SIDE == 0) & (F.bit_count(F.col("width")) == 1)
    return plain.withColumn("usable", (F.col("height") > 0) & (F.col("width") > 0) & (fits | square))


def _in_folders(spark: SparkSession, folder: str, chosen: Column | str | None) -> DataFrame:
    return _placed(spark.read.format("image").load(folder), {"z": F.col("z"), "tx": F.col("x"), "ty": F.col("y")}, chosen)


def _kept(spark: SparkSession, folder: str, template: str | None, chosen: Column | str | None, live: bool = False) -> DataFrame:
    """Kept tiles by their names; with a template only those of its addresses, as two providers may share a folder."""
    reader = (spark.readStream if live else spark.read).schema(_IMAGE).option("pathGlobFilter", "*-*-*-*.bin")
    files, name = reader.format("image").load(folder), F.col("_metadata.file_name")
    z, x, y = (F.split(name, "-")[k].cast("int") for k in range(3))
    files = files.where(name.rlike(_KEPT))
    if template is not None:
        files = files.where(name == cache_key(z, x, y, tile_url(template, z, x, y)))
    return _placed(files, {"z": z, "tx": x, "ty": y}, chosen)


def _unfolded(files: DataFrame) -> DataFrame:
    return files.where("usable").drop("usable").mapInArrow(_pixels, "z int, tx int, ty int, px int, py int, r int, g int, b int, a int")


def _failed(files: DataFrame) -> DataFrame:
    return files.where("NOT usable").select("z", F.col("x").alias("tx"), F.col("y").alias("ty"))


def image_pixels(spark: SparkSession, folder: str, chosen: Column | str | None = None) -> DataFrame:
    """(z, tx, ty, px, py, r, g, b, a) of every usable image; the others are in ``failed_images``. ``chosen`` is a condition on z, tx and ty, such as "z = 19": folders of
    other tiles are not opened.

    An image of 512 x 512 pixels shows its tile twice as fine, so it is cut into the four tiles of the next zoom, and so on for larger ones: a tile has 256 x 256 pixels.
    """
    return _unfolded(_in_folders(spark, folder, chosen))


def failed_images(spark: SparkSession, folder: str, chosen: Column | str | None = None) -> DataFrame:
    """(z, tx, ty): tiles whose image cannot be read or has a size that cannot be placed. They were not looked at, so what touches them stays truncated."""
    return _failed(_in_folders(spark, folder, chosen))


def kept_pixels(spark: SparkSession, folder: str, template: str | None = None, chosen: Column | str | None = None, live: bool = False) -> DataFrame:
    """As ``image_pixels``, of one folder of tiles kept under their ``cache_key``; ``live`` reads them as a stream as they are added.

    Tiles that are not ``chosen``, and those of other templates, are left out by their names before any file is opened; other files in the folder are passed over. Spark
    deals the files over tasks by their sizes, opens them by whatever file system the folder is in, and reads PNG, JPEG, GIF and BMP alike. An empty folder gives no rows.
    """
    return _unfolded(_kept(spark, folder, template, chosen, live))


def kept_failures(spark: SparkSession, folder: str, template: str | None = None, chosen: Column | str | None = None, live: bool = False) -> DataFrame:
    """As ``failed_images``, of kept tiles: those that hold no image, such as an error page that was kept."""
    return _failed(_kept(spark, folder, template, chosen, live))


def not_kept(plan: DataFrame, folder: str, template: str) -> DataFrame:
    """The rows of ``plan`` (z, tx, ty, perhaps more) whose tile is not in the folder: what is left to fetch. Only names are read; a file without bytes does not count."""
    kept = _kept(plan.sparkSession, folder, template, None).select("z", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return plan.join(kept, ["z", "tx", "ty"], "left_anti")
