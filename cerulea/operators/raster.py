"""Masks as tables of set pixels: morphology, labels and statistics per tile.

A tile is named by the columns scan, z, tx and ty, of which tables may leave out scan and z. Tiles are 256 x 256 pixels. ``tile_components`` takes pixels to statistics
with one shuffle, a kernel for each tile; the relational forms say the same step by step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cerulea.functions.color import WaterThresholds, hsv, is_strict, is_water

SIDE = 256
TILE_KEY = ("tx", "ty")
PIXEL = (*TILE_KEY, "px", "py")
OPAQUE = 255
BACKGROUND = (120, 118, 115)
_CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def key_of(df: DataFrame) -> list[str]:
    """The columns that name a tile in this table."""
    return [c for c in ("scan", "z", *TILE_KEY) if c in df.columns]


def pixel_of(df: DataFrame) -> list[str]:
    return [*key_of(df), "px", "py"]


def with_hsv(pixels: DataFrame) -> DataFrame:
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({"h": h, "s": s, "v": v})


def water_mask(pixels: DataFrame) -> DataFrame:
    """The pixels with the water signature, opaque enough; without a column a all are. The gate reads doubles."""
    alpha = F.col("a") if "a" in pixels.columns else F.lit(OPAQUE)
    return with_hsv(pixels).where(is_water(F.col("r"), F.col("g"), F.col("b"), alpha, F.col("h"), F.col("s"), F.col("v"))).select(*pixel_of(pixels))


def _reached(mask: DataFrame) -> DataFrame:
    """Every pixel of the tile that a set pixel's cross covers, once for each such pixel."""
    around = F.array(*[F.struct((F.col("px") + dx).alias("px"), (F.col("py") + dy).alias("py")) for dx, dy in _CROSS])
    moved = mask.select(*key_of(mask), F.explode(around).alias("p")).select(*key_of(mask), "p.px", "p.py")
    return moved.where(F.col("px").between(0, SIDE - 1) & F.col("py").between(0, SIDE - 1))


def dilate(mask: DataFrame) -> DataFrame:
    """Grown by the 4-neighbour cross, clipped to the tile."""
    return _reached(mask).distinct()


def erode(mask: DataFrame) -> DataFrame:
    """Pixels whose whole cross is set; what lies outside the tile counts as set, so shapes keep their cut edge."""
    outside = sum(F.col(c).isin(k).cast("int") for c in ("px", "py") for k in (0, SIDE - 1))
    return _reached(mask).groupBy(*pixel_of(mask)).agg(F.count("*").alias("n")).where(F.col("n") + outside == len(_CROSS)).select(*pixel_of(mask))


def clean(mask: DataFrame) -> DataFrame:
    """Opened, then closed: specks go, pinholes fill."""
    return erode(dilate(dilate(erode(mask))))


def _numbered(held: np.ndarray) -> np.ndarray:
    """8-connected components of a tile, numbered from 1 by their first pixel in raster order, 0 elsewhere: the smallest position spreads until nothing changes."""
    none = SIDE * SIDE
    grid = np.full((SIDE + 2, SIDE + 2), none, np.int64)
    inner = grid[1:-1, 1:-1]
    inner[held] = np.flatnonzero(held)
    while True:
        wide = np.minimum(np.minimum(grid[:, :-2], grid[:, 1:-1]), grid[:, 2:])
        low = np.where(held, np.minimum(np.minimum(wide[:-2], wide[1:-1]), wide[2:]), none)
        low = np.minimum(low, np.append(low.ravel(), none)[low])
        if (low == inner).all():
            break
        inner[:] = low
    out = np.zeros((SIDE, SIDE), np.int64)
    out[held] = np.unique(inner[held], return_inverse=True)[1] + 1
    return out


def _places(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x, y = tile["px"].to_numpy(), tile["py"].to_numpy()
    if len(x) and (min(x.min(), y.min()) < 0 or max(x.max(), y.max()) >= SIDE):
        raise ValueError(f"a tile has pixels beyond {SIDE} x {SIDE}")
    return x, y


def _fields(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in names)


def components(mask: DataFrame) -> DataFrame:
    """``mask`` with its labels. A tile is one bounded group: 65,536 pixels at most."""
    key = key_of(mask)
    rows = mask.select(*key, *[F.col(c).cast("int").alias(c) for c in ("px", "py")]).distinct()

    def labelled(tile: pa.Table) -> pa.Table:
        x, y = _places(tile)
        held = np.zeros((SIDE, SIDE), bool)
        held[y, x] = True
        return tile.append_column("label", pa.array(_numbered(held)[y, x].astype(np.int32)))

    return rows.groupBy(*key).applyInArrow(labelled, f"{_fields(rows, [*key, 'px', 'py'])}, label int")


def _moved(held: np.ndarray, outside: bool) -> list[np.ndarray]:
    """A mask and itself moved by a pixel to each side."""
    wide = np.pad(held, 1, constant_values=outside)
    return [wide[1 + dy : 1 + dy + SIDE, 1 + dx : 1 + dx + SIDE] for dx, dy in _CROSS]


def _hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``functions.color.hsv``, for arrays."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d == 0, 1.0, d)
    hue = 60 * np.select([d == 0, top == r, top == g], [0.0, np.fmod((g - b) / safe, 6), (b - r) / safe + 2], (r - g) / safe + 4)
    return np.where(hue < 0, hue + 360, hue), d / np.where(top == 0, 1.0, top), top


def tile_masks(tile: pa.Table, t: WaterThresholds = WaterThresholds()) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """A tile's water before and after cleaning, and hue, saturation and value of all its pixels; what is not painted is background."""
    x, y = _places(tile)
    r, g, b, a = (np.full((SIDE, SIDE), c, np.int64) for c in (*BACKGROUND, OPAQUE))
    for image, name in ((r, "r"), (g, "g"), (b, "b"), (a, "a")):
        if name in tile.column_names:
            image[y, x] = tile[name].to_numpy()
    h, s, v = _hsv(r, g, b)
    colour = (h >= t.hue_low) & (h <= t.hue_high) & (v >= t.min_value) & ((s >= t.min_saturation) | ((s >= t.pale_saturation) & (v >= t.pale_value)))
    raw = held = colour & (a >= t.min_alpha) & (b - r >= t.blue_over_red) & (g - r >= t.green_over_red) & (b - g >= t.blue_over_green_low) & (b - g <= t.blue_over_green_high)
    for grows in (False, True, True, False):
        held = np.logical_or.reduce(_moved(held, False)) if grows else np.logical_and.reduce(_moved(held, True))
    return raw, held, (h, s, v)


def _cleaned_labels(tile: pa.Table, t: WaterThresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of a tile's water after cleaning, and hue, saturation and value of all its pixels in single precision."""
    _, held, hsv = tile_masks(tile, t)
    return (_numbered(held), *(c.astype(np.float32).astype(np.float64) for c in hsv))


def _painted(pixels: DataFrame) -> tuple[list[str], DataFrame]:
    key = key_of(pixels)
    return key, pixels.select(*key, *[F.col(c).cast("int").alias(c) for c in ("px", "py", "r", "g", "b", "a") if c in pixels.columns])


def tile_labels(pixels: DataFrame, thresholds: WaterThresholds = WaterThresholds()) -> DataFrame:
    """``components(clean(water_mask(pixels)))`` in one kernel for each tile."""
    key, rows = _painted(pixels)

    def labelled(tile: pa.Table) -> pa.Table:
        label = _cleaned_labels(tile, thresholds)[0]
        y, x = np.nonzero(label)
        first = [pa.array([tile[c][0].as_py()] * len(x), tile[c].type) for c in key]
        return pa.table([*first, *(pa.array(v.astype(np.int32)) for v in (x, y, label[y, x]))], names=[*key, "px", "py", "label"])

    return rows.groupBy(*key).applyInArrow(labelled, f"{_fields(rows, key)}, px int, py int, label int")


def tile_components(pixels: DataFrame, thresholds: WaterThresholds = WaterThresholds()) -> DataFrame:
    """Statistics and texture of every component, as ``component_stats`` and ``component_texture`` give them, in one kernel for each tile and with one shuffle.

    ``pixels`` holds a tile's columns, px, py, r, g, b and perhaps a; a pixel counts once, and what is not given is background. Tables of another detector with these
    columns may take its place in ``detect.detections``.
    """
    key, rows = _painted(pixels)
    whole, real = ("pixels", "min_px", "max_px", "sum_px", "min_py", "max_py", "sum_py"), ("hue", "saturation", "value", "strict")

    def measured(tile: pa.Table) -> pa.Table:
        label, h, s, v = _cleaned_labels(tile, thresholds)
        y, x = np.nonzero(label)
        at, n = label[y, x] - 1, int(label.max())
        count = np.bincount(at, minlength=n)
        low, high = np.full((2, n), SIDE), np.full((2, n), -1)
        for k, place in enumerate((x, y)):
            np.minimum.at(low[k], at, place)
            np.maximum.at(high[k], at, place)
        total = lambda values: np.bincount(at, weights=values, minlength=n)
        narrow = (h >= thresholds.strict_low) & (h <= thresholds.strict_high) & (s >= thresholds.min_saturation)
        means = [total(c[y, x]) / np.maximum(count, 1) for c in (h, s, v, narrow.astype(float))]
        mid = label[1:-1, 1:-1]
        inner = (mid > 0) & (label[1:-1, 2:] == mid) & (label[1:-1, :-2] == mid) & (label[2:, 1:-1] == mid) & (label[:-2, 1:-1] == mid)
        steps = np.abs(v[1:-1, 2:] - v[1:-1, 1:-1]) + np.abs(v[2:, 1:-1] - v[1:-1, 1:-1])
        samples = np.bincount(mid[inner] - 1, minlength=n)
        rough = np.bincount(mid[inner] - 1, weights=steps[inner], minlength=n)
        texture = np.where(samples >= np.maximum(6.0, count * 0.12), rough / np.maximum(samples, 1), 0.0)
        numbers = (count, low[0], high[0], total(x), low[1], high[1], total(y))
        columns = [pa.array([tile[c][0].as_py()] * n, tile[c].type) for c in key] + [pa.array(np.arange(1, n + 1).astype(np.int32))]
        columns += [pa.array(v.astype(np.int64)) for v in numbers] + [pa.array(v.astype(np.float64)) for v in means] + [pa.array(samples.astype(np.int64)), pa.array(texture)]
        return pa.table(columns, names=[*key, "label", *whole, *real, "samples", "texture"])

    types = [f"{c} long" for c in whole] + [f"{c} double" for c in real] + ["samples long", "texture double"]
    found = rows.groupBy(*key).applyInArrow(measured, f"{_fields(rows, key)}, label int, {', '.join(types)}")
    return found.withColumns({c: F.round(c, 6) for c in (*real, "texture")})


def component_stats(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """A row for each component: size, extent, sums, means of single-precision colour and the share of strict pixels.

    Closing may have added pixels that failed the gate; their own colour, or the background's where nothing was painted, enters the means.
    Pixels are never broadcast: a table made by exploding is larger than Spark takes it to be.
    """
    filled = labels.join(pixels.hint("merge"), pixel_of(labels), "left").select(*pixel_of(labels), "label", *[F.coalesce(c, F.lit(k)).alias(c) for c, k in zip("rgb", BACKGROUND, strict=True)])
    rows = with_hsv(filled).withColumns({c: F.col(c).cast("float").cast("double") for c in "hsv"})
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(*key_of(labels), "label").agg(
        F.count("*").alias("pixels"),
        *[f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))],
        mean("h").alias("hue"),
        mean("s").alias("saturation"),
        mean("v").alias("value"),
        mean(is_strict(F.col("h").cast("float"), F.col("s").cast("float")).cast("double")).alias("strict"),
    )


def component_texture(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    """(tx, ty, label, samples, texture): mean forward difference of value over pixels whose four neighbours share their label, off the tile's border.

    With fewer samples than 6 or 12 % of the component the texture is 0. Neighbours meet by an equi-join on shifted positions.
    """
    painted = labels.join(pixels.hint("merge"), pixel_of(labels), "left").select(*pixel_of(labels), "label", *[F.coalesce(c, F.lit(k)).alias(c) for c, k in zip("rgb", BACKGROUND, strict=True)])
    own = with_hsv(painted).select(*pixel_of(labels), "label", F.col("v").cast("float").cast("double").alias("v"))
    sent = F.array(*[F.struct((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.lit(k).alias("side")) for k, (dx, dy) in enumerate(_CROSS)])
    met = own.select(*key_of(labels), "label", "v", F.explode(sent).alias("s")).select(*key_of(labels), "s.px", "s.py", "label", "v", "s.side")
    value = lambda k: F.max(F.when(F.col("side") == k, F.col("v")))
    at = met.groupBy(*pixel_of(labels), "label").agg(F.count("*").alias("n"), value(0).alias("v0"), value(1).alias("v1"), value(3).alias("v3"))
    inner = (F.col("n") == len(_CROSS)) & F.col("px").between(1, SIDE - 2) & F.col("py").between(1, SIDE - 2)
    steps = F.abs(F.col("v1") - F.col("v0")) + F.abs(F.col("v3") - F.col("v0"))
    sums = at.groupBy(*key_of(labels), "label").agg(F.count(F.when(F.col("v0").isNotNull(), 1)).alias("pixels"), F.count(F.when(inner, 1)).alias("samples"), F.sum(F.when(inner, steps)).alias("total"))
    enough = F.col("samples") >= F.greatest(F.lit(6.0), F.col("pixels") * 0.12)
    return sums.select(*key_of(labels), "label", "samples", F.round(F.when(enough, F.col("total") / F.col("samples")).otherwise(0.0), 6).alias("texture"))
