"""Outlines of labelled components: boundary sides as a relation, and their rings, simplified and placed on the map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cerulea.functions import geo
from cerulea.operators.raster import SIDE, key_of

EPSILON = 1.2
#: Ways to walk, clockwise from east; and for each the pixel side that is walked so, with the pixel on the right hand.
_STEP = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])
_ACROSS = ((0, -1), (1, 0), (0, 1), (-1, 0))
_FROM = ((0, 0), (1, 0), (1, 1), (0, 1))


def boundary_sides(labels: DataFrame) -> DataFrame:
    """(tile, label, top, right, bottom, left): how many pixel sides of each component face another label, no label or the tile's edge.

    Every pixel tells its four neighbours its label; what a pixel does not hear is a boundary. One shuffle on the pixel, none on the component's own shape.
    """
    key = key_of(labels)
    told = F.array(F.struct("px", "py", F.lit(-1).alias("side")), *[F.struct((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.lit(k).alias("side")) for k, (dx, dy) in enumerate(_ACROSS)])
    heard = labels.select(*key, "label", F.explode(told).alias("s")).groupBy(*key, "label", "s.px", "s.py").agg(*[F.max((F.col("s.side") == k).cast("int")).alias(f"s{k}") for k in range(-1, 4)])
    return heard.where("`s-1` = 1").groupBy(*key, "label").agg(*[F.sum(1 - F.col(f"s{k}")).alias(n) for k, n in enumerate(("top", "right", "bottom", "left"))])


def outer_rings(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
    """The corners of the outer boundary of each label of a tile, clockwise from its first pixel in raster order; straight runs have no corner inside.

    Where two pixels touch over a corner the walk turns left, so a shape joined over corners has one outer boundary; holes have boundaries of their own, which are left out.
    """
    grid = np.zeros((SIDE + 2, SIDE + 2), np.int64)
    grid[y + 1, x + 1] = label
    width = SIDE + 1
    sides = []
    for way, ((ax, ay), (fx, fy)) in enumerate(zip(_ACROSS, _FROM, strict=True)):
        bare = grid[y + 1 + ay, x + 1 + ax] != label
        sides.append(((label[bare] * width + y[bare] + fy) * width + x[bare] + fx) * 4 + way)
    key = np.sort(np.concatenate(sides))
    place, way = key // 4, key % 4
    end = place + _STEP[way, 1] * width + _STEP[way, 0]
    after = np.full(len(key), -1)
    for turn in (1, 0, -1):
        want = end * 4 + (way + turn) % 4
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        after = np.where(key[at] == want, at, after)
    of = place // (width * width)
    found = {}
    for one in np.unique(label):
        # the smallest place of a label is the top left corner of its first pixel, and its smallest way east
        first = at = int(np.searchsorted(of, one))
        walk = []
        while True:
            walk.append(at)
            at = int(after[at])
            if at == first:
                break
        walk = np.array(walk)
        turning = walk[way[walk] != way[np.roll(walk, 1)]]
        spot = place[turning] % (width * width)
        found[int(one)] = np.stack([spot % width, spot // width], 1)
    return found


def simplified(ring: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """A closed ring without the corners that lie within ``epsilon`` of the line between those kept.

    It is cut at the farthest pair of corners half the ring's count apart, and either part is halved at its farthest corner until none lies off. Rings of up to four corners stay, and so
    do those that would keep fewer than three.
    """
    n = len(ring)
    if n <= 4 or epsilon <= 0:
        return ring
    a = int(((ring - np.roll(ring, -(n // 2), 0)) ** 2).sum(1).argmax())
    low, high = sorted((a, (a + n // 2) % n))
    path = np.vstack([np.roll(ring, -low, 0), ring[low]]).astype(float)
    keep = np.zeros(n + 1, bool)
    keep[[0, high - low, n]] = True
    parts = [(0, high - low), (high - low, n)]
    while parts:
        i, j = parts.pop()
        if j - i < 2:
            continue
        d, off = path[j] - path[i], path[i + 1 : j] - path[i]
        length = np.hypot(*d)
        away = np.abs(d[1] * off[:, 0] - d[0] * off[:, 1]) / length if length else np.hypot(off[:, 0], off[:, 1])
        k = int(away.argmax())
        if away[k] > epsilon:
            keep[i + 1 + k] = True
            parts += [(i, i + 1 + k), (i + 1 + k, j)]
    out = path[:-1][keep[:-1]]
    return out if len(out) >= 3 else ring


_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def outlines(labels: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(tile, label, ring): the simplified outer ring of each component in pixel corners of its tile. A tile, by scan and zoom where the table has them, is one bounded
    group: 65,536 pixels at most."""
    key, types = key_of(labels), dict(labels.dtypes)

    def traced(tile: pa.Table) -> pa.Table:
        x, y, label = (tile[c].to_numpy().astype(np.int64) for c in ("px", "py", "label"))
        rings = outer_rings(x, y, label)
        rows = [[{"x": float(p), "y": float(q)} for p, q in simplified(r, epsilon)] for r in rings.values()]
        return pa.table([pa.array([tile[c][0].as_py()] * len(rings), tile[c].type) for c in key] + [pa.array(list(rings), pa.int32()), pa.array(rows, _RING)], names=[*key, "label", "ring"])

    fields = ", ".join(f"{c} {types[c]}" for c in key)
    return labels.groupBy(*key).applyInArrow(traced, f"{fields}, label int, ring array<struct<x: double, y: double>>")


def on_map(ring: str, z):
    """A ring in pixel corners of the tile (tx, ty) of zoom ``z``, a number or a column, as one of (lon, lat)."""
    x, y, zoom = F.col("tx") * geo.TILE, F.col("ty") * geo.TILE, F.lit(z)
    return F.transform(ring, lambda p: F.struct(geo.lon_of(x + p["x"], zoom).alias("lon"), geo.lat_of(y + p["y"], zoom).alias("lat")))


def rings_of(labels: DataFrame, frags: DataFrame, named: DataFrame, zoom: int = 19) -> DataFrame:
    """(cluster, frag, ring): the outer ring of each fragment on the map, for the labels of the tiles and the clusters ``named`` (frag, cluster). Without z all are of ``zoom``."""
    key = [*key_of(labels), "label"]
    parts = frags.select(*key, "frag").join(named, "frag")
    z = F.col("z") if "z" in key else zoom
    return outlines(labels.join(parts.select(*key), key, "left_semi")).join(parts, key).select("cluster", "frag", on_map("ring", z).alias("ring"))


def shoelace(ring: str):
    """Area of a plane ring of (x, y), whatever its direction."""
    other = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, other, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
