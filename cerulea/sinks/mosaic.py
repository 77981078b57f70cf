"""Annotated mosaics: blocks of tiles as one image each, with the water masks tinted and the fragments boxed, to judge thresholds by eye."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cerulea.operators.raster import BACKGROUND, SIDE, key_of, tile_masks
from cerulea.sinks.exports import png

#: Tiles on a side of a block: 1,024 x 1,024 pixels, 3 MB.
BLOCK = 4
# Colours and shares of the tints of cleaned and of uncleaned water, of boxes by their share of strict pixels, and of the lines between tiles.
CLEANED, UNCLEANED = ((255, 0, 255), 0.35), ((255, 160, 0), 0.3)
BOXES = ((0.5, (0, 255, 60)), (0.25, (255, 220, 0)), (-1.0, (255, 60, 60)))
LINE = 90


def _tint(image: np.ndarray, where: np.ndarray, colour: tuple[int, int, int], share: float) -> None:
    image[where] = np.rint(image[where] * (1 - share) + np.array(colour) * share)


def annotated(tile: pa.Table, boxes: list[dict]) -> np.ndarray:
    """The image of a tile (px, py, r, g, b, perhaps a) with tints, and with a frame one pixel around each box (min_px, max_px, min_py, max_py, strict), inside the tile."""
    image = np.empty((SIDE, SIDE, 3), np.uint8)
    image[:] = BACKGROUND
    image[tile["py"].to_numpy(), tile["px"].to_numpy()] = np.stack([tile[c].to_numpy() for c in "rgb"], 1)
    raw, cleaned, _ = tile_masks(tile)
    _tint(image, cleaned, *CLEANED)
    _tint(image, raw & ~cleaned, *UNCLEANED)
    for box in boxes:
        colour = next(c for least, c in BOXES if box["strict"] > least)
        x0, y0, x1, y1 = max(0, box["min_px"] - 1), max(0, box["min_py"] - 1), min(SIDE - 1, box["max_px"] + 1), min(SIDE - 1, box["max_py"] + 1)
        image[[y0, y1], x0 : x1 + 1] = colour
        image[y0 : y1 + 1, [x0, x1]] = colour
    return image


def mosaics(pixels: DataFrame, frags: DataFrame, tiles: int = BLOCK) -> DataFrame:
    """(scan, z, bx, by, png): an image for each block of ``tiles`` x ``tiles`` tiles that has pixels; bx and by count blocks. Tiles without pixels are background.

    Pixels and fragments meet by tile, and only finished tiles, compressed, go to their block: 16 rows at most. A pixel that is given twice is drawn once, as either.
    Without fragments there are no boxes.
    """
    key, types = key_of(pixels), dict(pixels.dtypes)
    block = [*key[:-2], "bx", "by"]
    rows = pixels.select(*key[:-2], *[F.col(c).cast("int").alias(c) for c in ("tx", "ty", "px", "py", "r", "g", "b", "a") if c in pixels.columns])
    boxes = frags.select(*key[:-2], *[F.col(c).cast("int").alias(c) for c in ("tx", "ty", "min_px", "max_px", "min_py", "max_py")], "strict", "frag")

    def drawn(held: pa.Table, found: pa.Table) -> pa.Table:
        images = [zlib.compress(annotated(held, sorted(found.to_pylist(), key=lambda r: r["frag"])).tobytes(), 1)] if held.num_rows else []
        return pa.table([pa.array([held[c][0].as_py() for _ in images], held.schema.field(c).type) for c in key] + [pa.array(images, pa.binary())], names=[*key, "image"])

    def assembled(held: pa.Table) -> pa.Table:
        image = np.empty((tiles * SIDE, tiles * SIDE, 3), np.uint8)
        image[:] = BACKGROUND
        for tx, ty, part in zip(*(held[c].to_pylist() for c in ("tx", "ty", "image")), strict=True):
            left, top = tx % tiles * SIDE, ty % tiles * SIDE
            image[top : top + SIDE, left : left + SIDE] = np.frombuffer(zlib.decompress(part), np.uint8).reshape(SIDE, SIDE, 3)
        image[SIDE::SIDE], image[:, SIDE::SIDE] = LINE, LINE
        return pa.table([pa.array([held[c][0].as_py()], held[c].type) for c in block] + [pa.array([png(image)], pa.binary())], names=[*block, "png"])

    names = [f"{c} {types[c]}" for c in key[:-2]]
    finished = rows.groupBy(*key).cogroup(boxes.groupBy(*key)).applyInArrow(drawn, ", ".join([*names, "tx int", "ty int", "image binary"]))
    placed = finished.withColumns({"bx": F.floor(F.col("tx") / tiles).cast("int"), "by": F.floor(F.col("ty") / tiles).cast("int")})
    return placed.groupBy(*block).applyInArrow(assembled, ", ".join([*names, "bx int", "by int", "png binary"]))
