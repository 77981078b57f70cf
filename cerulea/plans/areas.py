"""Tile plans for a table of areas: which tiles cover each ring, how many they are, and in which order to visit them.

A ring descends a quadtree from the one to four tiles, about as large as its box, that hold it: a tile that no side meets lies inside as a whole, and is kept as it is, or outside, and goes; a
tile that sides meet is split in four, each with the sides that meet it. So the work follows a ring's length, not its area, and a step is a projection without a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cerulea.functions import geo
from cerulea.plans.cover import EXACT_TILES
from cerulea.sinks.shared import stored

#: Levels after which the open tiles are dealt out again, as one long ring becomes very many of them.
DEAL_LEVELS = 3
#: Rings that a task follows, about: a file of rings is small, their tiles are many.
TASK_RINGS = 1000
#: Tiles of a band of the Hilbert order, as a power of two.
HILBERT_BAND = 12


def tile_box(areas: DataFrame, z: int) -> dict[str, Column]:
    """First and last column and row of the tiles of each ring's box."""
    zoom = F.lit(z)
    lon, lat = F.col("ring.lon"), F.col("ring.lat")
    at = lambda axis, c: geo.tile_of(axis(c, zoom), zoom)
    return {"x0": at(geo.world_x, F.array_min(lon)), "x1": at(geo.world_x, F.array_max(lon)), "y0": at(geo.world_y, F.array_max(lat)), "y1": at(geo.world_y, F.array_min(lat))}


def _meets(box: dict[str, Column]):
    return lambda side: geo.side_meets(side, box)


#: Meridians and parallels that bound the four parts of a tile, from the west and from the south.
_GRID = ("west", "middle", "east", "south", "level", "north")


def _grid() -> dict[str, Column]:
    """Bounds of the parts of the tile (z, tx, ty), as columns of their own: inside a lambda they would be computed for each side."""
    z, x, y = F.col("z") + 1, F.col("tx") * 2, F.col("ty") * 2
    low, high = geo.tile_bounds(x, y + 1, z), geo.tile_bounds(x + 1, y, z)
    return dict(zip(_GRID, (low["west"], high["west"], high["east"], low["south"], high["south"], high["north"]), strict=True))


def _children() -> Column:
    """The four parts of the tile (z, tx, ty), each with the sides that meet it and whether its south-west corner is inside the ring.

    The corner is told from the parent's: on the way to it the ring is crossed by sides that meet the parent.
    """
    west, middle, east, south, level, north = (F.col(c) for c in _GRID)
    odd = lambda hits: F.size(F.filter("sides", hits)) % 2 == 1
    along = lambda lat: odd(lambda s: geo.crosses_level(s, lat) & (geo.lon_at(s, lat) > west) & (geo.lon_at(s, lat) <= middle))
    lat_at = lambda s: s["y"] + s["dy"] * ((west - s["x"]) / F.when(s["dx"] != 0, s["dx"]))
    up = odd(lambda s: ((s["x"] > west) != (s["x"] + s["dx"] > west)) & (lat_at(s) > south) & (lat_at(s) <= level))
    corner, spans = F.col("inside"), ((west, middle), (middle, east))
    parts = []
    for dx, dy, inside in ((0, 1, corner), (1, 1, corner != along(south)), (0, 0, corner != up), (1, 0, (corner != up) != along(level))):
        box = {"west": spans[dx][0], "east": spans[dx][1], "south": (level, south)[dy], "north": (north, level)[dy]}
        place = (F.col("z") + 1).alias("z"), (F.col("tx") * 2 + dx).alias("tx"), (F.col("ty") * 2 + dy).alias("ty")
        parts.append(F.struct(*place, F.filter("sides", _meets(box)).alias("sides"), inside.alias("inside")))
    return F.array(*parts)


def ranges(areas: DataFrame, z: int) -> DataFrame:
    """(area, z, tx, ty, whole): for each ring (area, ring) the largest tiles that lie inside it as a whole, and the tiles of zoom ``z`` that it cuts.

    A ring is an array of (lon, lat), open or closed; null rings and those of fewer than three points have no tiles, and rings that cross themselves count by the
    even-odd rule. Areas that repeat are covered once for each row. An empty table gives no rows.
    """
    boxed = areas.where(F.size("ring") >= 3).select("area", geo.sides_of("ring").alias("sides"), *[c.alias(n) for n, c in tile_box(areas, z).items()])
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("long")
    rows = boxed.withColumn("depth", F.when(wide > 0, F.length(F.bin(wide))).otherwise(0))
    steps, many = rows.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count("*")).first()  # two numbers
    tasks = max(1, -(-many // TASK_RINGS))
    rows = rows.repartition(tasks, "area")
    roots = lambda c: F.explode(F.expr(f"sequence(shiftright({c}0, depth), shiftright({c}1, depth))"))
    rows = rows.withColumn("tx", roots("x")).withColumn("ty", roots("y")).withColumn("z", F.lit(z) - F.col("depth"))
    rows = rows.withColumns(geo.tile_bounds(F.col("tx"), F.col("ty"), F.col("z")))
    kept, box = ["area", "x0", "x1", "y0", "y1"], ["z", "tx", "ty", "sides", "inside"]
    frame = {c: F.col(c) for c in ("west", "south", "east", "north")}
    rows = rows.select(*kept, "z", "tx", "ty", F.filter("sides", _meets(frame)).alias("sides"), geo.in_sides(F.col("west"), F.col("south"), F.col("sides")).alias("inside"))
    rows = rows.where((F.size("sides") > 0) | F.col("inside"))
    same = F.array(F.struct(*box))
    grid, parts = _grid(), F.explode(F.when((F.size("sides") > 0) & (F.col("z") < z), _children()).otherwise(same)).alias("t")
    for step in range(steps):
        if step % DEAL_LEVELS == DEAL_LEVELS - 1:
            rows = rows.repartition(tasks, "area", "tx", "ty")
        rows = rows.withColumns(grid).select(*kept, parts).select(*kept, *[f"t.{c}" for c in box]).where("size(sides) > 0 OR inside")
    whole = F.size("sides") == 0
    held = rows.where(whole | (F.col("tx").between(F.col("x0"), F.col("x1")) & F.col("ty").between(F.col("y0"), F.col("y1"))))
    return held.select("area", "z", "tx", "ty", whole.alias("whole"))


def tiles(found: DataFrame, z: int) -> DataFrame:
    """(area, tx, ty, whole): the tiles of zoom ``z`` in ``ranges``."""
    wide = F.expr(f"shiftleft(1, {z} - z)")
    span = lambda c: F.explode(F.sequence((F.col(c) * wide).cast("int"), ((F.col(c) + 1) * wide - 1).cast("int")))
    return found.select("area", "whole", "ty", "z", span("tx").alias("x")).select("area", F.col("x").alias("tx"), span("ty").alias("y"), "whole").withColumnRenamed("y", "ty")


def cover(areas: DataFrame, z: int) -> DataFrame:
    return tiles(ranges(areas, z), z)


def estimates(areas: DataFrame, z: int, exact: int = EXACT_TILES) -> DataFrame:
    """(area, tiles, approximate): the tiles of each ring, summed over its ranges, or those of its box where these are more than ``exact``."""
    box = tile_box(areas, z)
    boxed = ((box["x1"] - box["x0"] + 1).cast("long") * (box["y1"] - box["y0"] + 1)).alias("boxed")
    sized = areas.where(F.size("ring") >= 3).select("area", "ring", boxed)
    counted = ranges(sized.where(F.col("boxed") <= exact), z).groupBy("area").agg(F.sum(F.expr(f"shiftleft(1L, 2 * ({z} - z))")).alias("tiles"))
    large = sized.where(F.col("boxed") > exact).select("area", F.col("boxed").alias("tiles"), F.lit(True).alias("approximate"))
    return counted.select("area", "tiles", F.lit(False).alias("approximate")).union(large)


def _placed(rows: DataFrame, band: Column, along: list[Column], name: str) -> DataFrame:
    """Positions from 0 within each area, by band and then along it: places are numbered inside a band, which is bounded, and come after the tiles of the bands before."""
    rows = rows.withColumn("_band", band)
    before = Window.partitionBy("area").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("area", "_band").agg(F.count("*").alias("n")).select("area", "_band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("area", "_band").orderBy(*along))
    return rows.withColumn("_in", inside).join(shift, ["area", "_band"]).withColumn(name, F.col("_in") + F.col("_shift") - 1).drop("_band", "_in", "_shift")


def serpentine(covered: DataFrame) -> DataFrame:
    """``covered`` (area, tx, ty) with idx: row by row from the north, every other row backwards, counted from each area's first row."""
    first = covered.groupBy("area").agg(F.min("ty").alias("_y0"))
    rows = covered.join(first, "area")
    return _placed(rows, F.col("ty"), [F.when((F.col("ty") - F.col("_y0")) % 2 == 0, F.col("tx")).otherwise(-F.col("tx"))], "idx").drop("_y0")


def spiral(covered: DataFrame) -> DataFrame:
    """``covered`` with idx: squares around the middle of each area's tiles; in each the top from the west, the right side down, the bottom from the east, the left side up."""
    half = lambda c: F.floor((F.min(c) + F.max(c)) / 2 + 0.5)
    rows = covered.join(covered.groupBy("area").agg(half("tx").alias("_mx"), half("ty").alias("_my")), "area")
    dx, dy = F.col("tx") - F.col("_mx"), F.col("ty") - F.col("_my")
    r = F.greatest(F.abs(dx), F.abs(dy))
    side = F.when(dy == -r, 0).when(dx == r, 1).when(dy == r, 2).otherwise(3)
    along = F.when(side == 0, dx).when(side == 1, dy).when(side == 2, -dx).otherwise(-dy)
    return _placed(rows, r, [side, along], "idx").drop("_mx", "_my")


def hilbert_index(x: Column, y: Column, order: int) -> Column:
    """Place of the cell (x, y) on the Hilbert curve over 2**order x 2**order cells: a fold over the bits from the highest, which turns what is left of the cell."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        right, low = F.when(s["x"] >= side, 1).otherwise(0), F.when(s["y"] >= side, 1).otherwise(0)
        rx, ry = s["x"] - right * side, s["y"] - low * side
        flip = (low == 0) & (right == 1)
        fx, fy = F.when(flip, side - 1 - rx).otherwise(rx), F.when(flip, side - 1 - ry).otherwise(ry)
        d = s["d"] * 4 + F.when(right == 1, 3 - low).otherwise(low)
        return F.struct(F.when(low == 0, fy).otherwise(fx).alias("x"), F.when(low == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), state, step, lambda s: s["d"])


def hilbert(covered: DataFrame, z: int) -> DataFrame:
    """``covered`` with idx: along the Hilbert curve over the tiles of the whole zoom ``z``, so that neighbours in the order are neighbours on the map."""
    rows = covered.withColumn("_d", hilbert_index(F.col("tx"), F.col("ty"), max(1, z)))
    return _placed(rows, F.shiftright("_d", HILBERT_BAND), [F.col("_d")], "idx").drop("_d")


#: Tiles of a ring's box times its corners up to which a kernel visits the ring as a whole, such products of a step of the kernel, rings of a task, and degrees up to which it reckons.
WHOLE_RING, RING_STEP, RING_TASK, FAR = 1 << 20, 1 << 18, 4000, 1e6
#: Degrees, beyond what rounding moves a crossing or the edge of a tile.
SLACK = 1e-9


def _steps(load: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of successive rows of about ``most`` load together, one row at least."""
    total, at, out = np.cumsum(load), 0, []
    while at < len(load):
        end = max(at + 1, int(np.searchsorted(total, most + (total[at - 1] if at else 0), side="right")))
        out.append((at, end))
        at = end
    return out


def _places(first: np.ndarray, ring: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions from 0 within each ring by a key; ``first``: where each ring's rows begin."""
    out = np.empty(len(key), np.int64)
    order = np.lexsort((key, ring))
    out[order] = np.arange(len(key)) - first[ring[order]]
    return out


def _hilbert(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """``hilbert_index`` of arrays."""
    x, y, d = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for k in range(order - 1, -1, -1):
        right, low = (x >> k) > 0, (y >> k) > 0
        x, y = x & ((1 << k) - 1), y & ((1 << k) - 1)
        d = d * 4 + np.where(right, 3 - low, low)
        flip = right & ~low
        x, y = np.where(flip, (1 << k) - 1 - x, x), np.where(flip, (1 << k) - 1 - y, y)
        x, y = np.where(low, x, y), np.where(low, y, x)
    return d


def _spans(start: np.ndarray, way: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``span`` in ``geo.side_meets``."""
    level, step = way == 0, np.where(way == 0, 1.0, way)
    p, q, within = (low - start) / step, (high - start) / step, (start >= low) & (start <= high)
    return np.where(level, np.where(within, 0.0, 1.0), np.minimum(p, q)), np.where(level, np.where(within, 1.0, 0.0), np.maximum(p, q))


def _sides(rings: pa.ListArray, z: int) -> tuple[np.ndarray, ...]:
    """(starts, x, y, dx, dy, box) of rings without missing corners: where each ring's sides start, as ``geo.sides_of`` gives them, and ``tile_box``."""
    at, flat, n = rings.offsets.to_numpy().astype(np.int64), rings.flatten(), 2.0**z
    at = at - at[0]
    lon, lat = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
    after = np.arange(1, len(lon) + 1)
    after[at[1:] - 1] = at[:-1]
    dx, dy = lon[after] - lon, lat[after] - lat
    some = np.flatnonzero((dx != 0) | (dy != 0))
    tile = lambda part: np.clip(np.floor(part * n), 0, n - 1).astype(np.int64)
    across = lambda c: tile((c + 180) / 360)
    down = lambda c: tile((1 - np.arcsinh(np.tan(np.radians(np.clip(c, -geo.MAX_LATITUDE, geo.MAX_LATITUDE)))) / np.pi) / 2)
    low, high = (lambda c: np.minimum.reduceat(c, at[:-1])), (lambda c: np.maximum.reduceat(c, at[:-1]))
    box = across(low(lon)), across(high(lon)), down(high(lat)), down(low(lat))
    return np.searchsorted(some, at), lon[some], lat[some], dx[some], dy[some], box


def _met(at: np.ndarray, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, box: tuple[np.ndarray, ...], z: int) -> tuple[np.ndarray, ...]:
    """(ring, tx, ty, cut, near): the tiles of each ring, row by row, by each tile of its box against each side, as ``ranges`` in the end decides; whether a side meets the tile, and
    for those that one meets the sides that a ray to the east from a point there may cross, as (which of these tiles, side)."""
    x0, x1, y0, y1 = box
    many, wide, tall = np.diff(at), x1 - x0 + 1, y1 - y0 + 1
    cells = np.where(many > 0, wide * tall, 0)
    ring = np.repeat(np.arange(len(cells)), cells)
    place = np.arange(len(ring)) - np.repeat(np.cumsum(cells) - cells, cells)
    row, tx = place // wide[ring], x0[ring] + place % wide[ring]
    ty, size = y0[ring] + row, 2.0**z
    # parallels of each ring's rows, once
    top = np.cumsum(tall + 1) - tall - 1
    level = np.repeat(y0 - top, tall + 1) + np.arange(int((tall + 1).sum()))
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * level / size))))
    west, east, north, south = tx / size * 360 - 180, (tx + 1) / size * 360 - 180, lat[top[ring] + row], lat[top[ring] + row + 1]
    # a row for each tile and side
    each = many[ring]
    first = np.cumsum(each) - each
    side = np.arange(int(each.sum())) + np.repeat(at[ring] - first, each)
    if not len(side):
        return *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool), (side, side)
    w, e, s, n = (np.repeat(c, each) for c in (west, east, south, north))
    sx, sy, sdx, sdy = x[side], y[side], dx[side], dy[side]
    across, up = _spans(sx, sdx, w, e), _spans(sy, sdy, s, n)
    meets = np.logical_or.reduceat(np.maximum(np.maximum(across[0], up[0]), 0.0) <= np.minimum(np.minimum(across[1], up[1]), 1.0), first)
    crosses = ((sy > s) != (sy + sdy > s)) & (w < sx + sdx * ((s - sy) / np.where(sdy == 0, 1.0, sdy)))
    kept = np.flatnonzero(meets | np.logical_xor.reduceat(crosses, first))
    near = np.flatnonzero(np.repeat(meets, each) & (np.minimum(sy, sy + sdy) <= n + SLACK) & (np.maximum(sy, sy + sdy) >= s - SLACK) & (np.maximum(sx, sx + sdx) >= w - SLACK))
    return ring[kept], tx[kept], ty[kept], meets[kept], (np.repeat(np.cumsum(meets) - 1, each)[near], side[near])


def _visited(rings: pa.Table, z: int) -> pa.Table:
    """(area, tx, ty, serpentine, spiral, hilbert): the tiles of rings and the three orders."""
    ring, tx, ty, _, _ = _met(*_sides(rings["ring"].combine_chunks(), z), z)
    held, first, n = np.unique(ring, return_index=True, return_counts=True)
    ring = np.repeat(np.arange(len(held)), n)  # numbered anew
    last = first + n - 1
    # tiles lie row by row from the north, in each from the west
    line = np.flatnonzero((np.diff(ring, prepend=-1) != 0) | (np.diff(ty, prepend=-1) != 0))
    long = np.diff(line, append=len(ring))
    begin, here = np.repeat(line, long), np.arange(len(ring))
    back = (ty - ty[first[ring]]) % 2 == 1
    serpentine = np.where(back, 2 * begin + np.repeat(long, long) - 1 - here, here) - first[ring]
    middle = lambda low, high: (low + high + 1) // 2
    ends = (np.minimum.reduceat(tx, first), np.maximum.reduceat(tx, first)) if len(first) else (tx, tx)
    mx, my = middle(*ends)[ring], middle(ty[first], ty[last])[ring]
    right, down = tx - mx, ty - my
    r = np.maximum(np.abs(right), np.abs(down))
    turns = [down == -r, right == r, down == r]
    along = np.select(turns, [right, down, -right], -down)
    spiral = _places(first, ring, (r * 4 + np.select(turns, [0, 1, 2], 3)) * (4 * WHOLE_RING) + along + 2 * WHOLE_RING)
    hilbert = _places(first, ring, _hilbert(tx, ty, max(1, z)))
    area = rings["area"].take(pa.array(held[ring]))
    return pa.table([area, tx.astype(np.int32), ty.astype(np.int32), serpentine, spiral, hilbert], names=["area", "tx", "ty", "serpentine", "spiral", "hilbert"])


def _small(rings: pa.ListArray, z: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a kernel takes each ring: its corners are known and not far, and its box's tiles times its corners are ``most`` at most; and this product."""
    flat, at = rings.flatten(), rings.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    for c in ("lon", "lat"):
        known = known & (np.abs(flat.field(c).to_numpy(zero_copy_only=False)) <= FAR)  # a missing number is no number
    known = np.logical_and.reduceat(known, at[:-1])
    x0, x1, y0, y1 = np.zeros((4, len(known)), np.int64)
    x0[known], x1[known], y0[known], y1[known] = _sides(rings.filter(pa.array(known)), z)[-1]
    load = (x1 - x0 + 1) * (y1 - y0 + 1) * np.diff(at)
    return known & (load <= most), load


def _ring_by_ring(areas: DataFrame, z: int, most: int, kernel, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """What a kernel makes of the rings (area, ring) that are ``_small``, and the other rings, if there are any."""

    def pick(batches):
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(~_small(batch.column("ring"), z, most)[0]))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            small, load = _small(batch.column("ring"), z, most)
            rings = pa.Table.from_batches([batch.filter(pa.array(small))])
            for low, high in _steps(load[small], RING_STEP):
                yield from kernel(rings.slice(low, high - low), z).to_batches()

    dealt = areas.where(F.size("ring") >= 3).select("area", "ring").repartition(max(1, -(-areas.count() // RING_TASK)), "area")
    others = dealt.mapInArrow(pick, dealt.schema)
    return dealt.mapInArrow(run, schema), others if others.count() else None


def orders(areas: DataFrame, z: int) -> DataFrame:
    """(area, tx, ty, serpentine, spiral, hilbert): the tiles of ``cover`` with their places in the three orders. Areas have different names.

    A ring whose box holds few tiles, as most do, is covered and ordered by itself in a kernel, so its tiles are dealt to no other task; the tiles of others are placed by bands.
    """
    names = ["area", "tx", "ty", "serpentine", "spiral", "hilbert"]
    found, others = _ring_by_ring(areas, z, WHOLE_RING, _visited, f"area {dict(areas.dtypes)['area']}, tx int, ty int, serpentine long, spiral long, hilbert long")
    if others is None:
        return found
    covered = stored(cover(others, z), "covered")
    rows, key = serpentine(covered).withColumnRenamed("idx", "serpentine"), ["area", "tx", "ty"]
    for name, placed in (("spiral", spiral(covered)), ("hilbert", hilbert(covered, z))):
        rows = rows.join(placed.select(*key, F.col("idx").alias(name)), key)
    return found.union(rows.select(*key, *[F.col(c).cast("long").alias(c) for c in names[3:]]))


def located(points: DataFrame, areas: DataFrame, z: int) -> DataFrame:
    """``points`` (lon, lat, other columns) once for each area (area, ring) that holds them: an equi-join on the tile; only in tiles that a ring cuts is its ring asked."""
    zoom = F.lit(z)
    placed = points.withColumns({"tx": geo.tile_of(geo.world_x(F.col("lon"), zoom), zoom), "ty": geo.tile_of(geo.world_y(F.col("lat"), zoom), zoom)})
    met = placed.join(cover(areas, z), ["tx", "ty"]).drop("tx", "ty")
    tested = met.where(~F.col("whole")).join(areas.select("area", geo.sides_of("ring").alias("sides")), "area").where(geo.in_sides(F.col("lon"), F.col("lat"), F.col("sides")))
    return met.where("whole").drop("whole").unionByName(tested.drop("whole", "sides"))


#: Points of a cell, a tile of the zoom at which rings meet points, about; its zoom is three levels deeper than the one asked for at most.
TILE_POINTS, DEEPER = 1 << 16, 3
#: Points and rings of a block, numbers of a step of its kernel, and tiles of a ring's box times its corners up to which a kernel cuts the ring into cells.
BLOCK_POINTS, BLOCK_RINGS, STEP, CUT_RING = 1 << 17, 1 << 14, 1 << 18, 1 << 14


def _packed(sides: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows (x, y, dx, dy) of sides as bytes, those from each start to the next together."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 32).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sides, np.float64))])


def _cut(rings: pa.Table, z: int) -> pa.Table:
    """(area, tx, ty, whole, sides): the cells of rings; of one that sides meet, those that count there, as bytes."""
    at, *sides, box = _sides(rings["ring"].combine_chunks(), z)
    ring, tx, ty, cut, (cell, near) = _met(at, *sides, box, z)
    ends = np.zeros(len(ring), np.int64)
    ends[cut] = np.bincount(cell, minlength=int(cut.sum()))
    packed = _packed(np.column_stack([c[near] for c in sides]), np.concatenate([[0], np.cumsum(ends)]))
    return pa.table([rings["area"].take(pa.array(ring)), pa.array(tx.astype(np.int32)), pa.array(ty.astype(np.int32)), pa.array(~cut), packed], names=["area", "tx", "ty", "whole", "sides"])


def _rows_of(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def _inside(at: np.ndarray, sides: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """How many of some points each ring holds, by the even-odd rule as in ``geo.in_sides``, over sides (x, y, dx, dy) that can be crossed here.

    The points lie in a grid of rows and columns. In a row, sides cut some columns, whose points are tested against the ring's sides in this row; points of the columns
    between lie all inside or all outside, and are counted as they lie in order.
    """
    n = np.zeros(len(at) - 1, np.int64)
    if not len(lat) or not len(sides):
        return n
    known = max(np.abs(c).max() for c in (lon, lat, sides)) <= 2 * FAR  # else the grid is one place, which every side cuts
    rows = max(1, int(len(lat) ** 0.5 / 3)) if known else 1
    columns = 4 * rows if known else 1
    west, south = lon.min(), lat.min()
    high, wide = max((lat.max() - south) / rows, SLACK), max((lon.max() - west) / columns, SLACK)
    index = lambda c, low, step, last: np.clip(np.floor((c - low) / step), -1, last).astype(np.int64)
    bins = index(lat, south, high, rows - 1).clip(0) * columns + index(lon, west, wide, columns - 1).clip(0) if known else np.zeros(len(lat), np.int64)
    order = np.argsort(bins, kind="stable")
    lon, lat = lon[order], lat[order]
    start = np.searchsorted(bins[order], np.arange(rows * columns + 1))
    x, y, dx, dy = np.ascontiguousarray(sides.T)
    owner = np.repeat(np.arange(len(n)), np.diff(at))
    low, top = np.minimum(y, y + dy) - SLACK, np.maximum(y, y + dy) + SLACK
    if known:
        r0, r1 = index(low, south, high, rows).clip(0), index(top, south, high, rows - 1)
    else:
        r0 = r1 = np.zeros(len(x), np.int64)
    span = np.maximum(r1 - r0 + 1, 0)
    loads = np.add.reduceat(np.append(span, 0), at[:-1]) * (np.diff(at) > 0)
    for begin, end in _steps(loads, STEP):
        here = slice(at[begin], at[end])
        side = np.repeat(np.arange(at[begin], at[end]), span[here])
        row = _rows_of(r0[here], span[here])
        if known:  # from where to where a side lies in its row
            step = np.where(dy[side] == 0, 1.0, dy[side])
            level = south + row * high
            p, q = (np.clip((c - y[side]) / step, 0.0, 1.0) for c in (level - SLACK, level + high + SLACK))
            p, q = np.where(dy[side] == 0, 0.0, p), np.where(dy[side] == 0, 1.0, q)
            p, q = x[side] + dx[side] * p, x[side] + dx[side] * q
            a, b = index(np.minimum(p, q) - SLACK, west, wide, columns), index(np.maximum(p, q) + SLACK, west, wide, columns)
            east = np.flatnonzero(b >= 0)  # a ray to the east crosses no other
            side, row, a, b = side[east], row[east], a[east].clip(0), b[east]
        else:
            level, a, b = np.zeros(len(side)), np.zeros(len(side), np.int64), np.zeros(len(side), np.int64)
        if not len(side):
            continue
        line = owner[side] * rows + row
        order = np.argsort(line * (columns + 1) + a, kind="stable")
        side, row, a, b, line = side[order], row[order], a[order], b[order], line[order]
        # intervals of columns that sides cut, those that touch each other as one; column ``columns`` is what lies east of the grid
        reach = np.maximum.accumulate(line * (columns + 2) + b) - line * (columns + 2)
        fresh = np.diff(line, prepend=-1) != 0
        new = fresh | (a > np.append(0, reach[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(side)) - 1
        head = np.flatnonzero(fresh)
        until = np.repeat(np.append(head[1:], len(side)), np.diff(np.append(head, len(side))))  # where the sides of the row end
        left, right, ring, at_row = a[first], reach[last], owner[side[first]], row[first] * columns
        if known:
            middle = south + (row + 0.5) * high
            crosses = np.append(0, np.cumsum((y[side] > middle) != (y[side] + dy[side] > middle)))
            odd = (crosses[until[first]] - crosses[first]) % 2 == 1
            before = np.where(fresh[first], 0, np.append(0, right[:-1] + 1))
            np.add.at(n, ring[odd], (start[at_row + left] - start[at_row + np.minimum(before, columns)])[odd])
        some = np.flatnonzero(left < columns)
        from_point, to_point = start[(at_row + left)[some]], start[(at_row + np.minimum(right, columns - 1) + 1)[some]]
        sides_of, from_side, ring = (until[first] - first)[some], first[some], ring[some]
        # no more points at once than a step takes with the sides of the row
        most = np.maximum(1, STEP // sides_of)
        parts = -(-(to_point - from_point) // most)
        of = np.repeat(np.arange(len(parts)), parts)
        begin_point = from_point[of] + _rows_of(np.zeros(len(parts), np.int64), parts) * most[of]
        points = np.minimum(to_point[of] - begin_point, most[of])
        for i, j in _steps(points * sides_of[of], STEP):
            part = of[i:j]
            point = _rows_of(begin_point[i:j], points[i:j])
            each = np.repeat(sides_of[part], points[i:j])
            which = side[_rows_of(np.repeat(from_side[part], points[i:j]), each)]
            u, v = np.repeat(lon[point], each), np.repeat(lat[point], each)
            y1, up = y[which], dy[which]
            hit = ((y1 > v) != (y1 + up > v)) & (u < x[which] + dx[which] * ((v - y1) / np.where(up != 0, up, 1.0)))
            held = np.logical_xor.reduceat(hit, np.cumsum(each) - each)
            np.add.at(n, np.repeat(ring[part], points[i:j])[held], 1)
    return n


def _counted(rings: pa.Table, points: pa.Table) -> pa.Table:
    """(area, n) of the rings of a block that hold some of its points."""
    packed = rings["sides"].combine_chunks()
    at = packed.offsets.to_numpy() if hasattr(packed, "offsets") else np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    sides = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float64).reshape(-1, 4) if len(packed) and at[-1] > at[0] else np.zeros((0, 4))
    lon, lat = points["lon"].to_numpy(), points["lat"].to_numpy()
    n = _inside((at.astype(np.int64) - at[0]) // 32, sides, lon, lat)
    return pa.table([rings["area"].combine_chunks().filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["area", "n"])


def _packed_sides(batches):
    """(area, tx, ty, whole, sides) of (area, tx, ty, sides) with sides as structs."""
    for batch in batches:
        lists = batch.column("sides")
        at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        sides = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "dx", "dy")])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("area", "tx", "ty")), pa.array([False] * len(lists)), _packed(sides, at)], names=["area", "tx", "ty", "whole", "sides"])


def point_counts(points: DataFrame, areas: DataFrame, z: int) -> DataFrame:
    """(area, n): how many of the ``points`` (lon, lat) each area (area, ring) holds, for those that hold any: ``located``, counted, without a row for each pair. Areas have
    different names.

    Rings meet points in cells, tiles of a zoom at which a cell holds many points: cells inside a ring take the count of their points; points and rings of a cell that
    rings cut meet in blocks, each in a kernel.
    """
    world = lambda zoom: {"tx": geo.tile_of(geo.world_x(F.col("lon"), F.lit(zoom)), F.lit(zoom)), "ty": geo.tile_of(geo.world_y(F.col("lat"), F.lit(zoom)), F.lit(zoom))}
    # points that are no numbers lie nowhere: no side is crossed by a ray from them
    places = points.select("lon", "lat").where("abs(lon) < double('infinity') AND abs(lat) < double('infinity')")
    full = places.select(*[c.alias(n) for n, c in world(z).items()]).groupBy("tx", "ty").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 0  # one number
    z = max(0, z + next((k for k in range(-z, DEEPER) if full <= TILE_POINTS * 4.0**k), DEEPER))
    placed = stored(places.withColumns({**world(z), "number": F.monotonically_increasing_id()}), "points")  # numbers are drawn once
    schema = f"area {dict(areas.dtypes)['area']}, tx int, ty int, whole boolean, sides binary"
    cells, others = _ring_by_ring(areas, z, CUT_RING, _cut, schema)
    held = stored(cells, "cells")
    tile_sums = stored(placed.groupBy("tx", "ty").agg(F.count("*").alias("points")), "tile-points")
    inside = held.where("whole").select("area", "tx", "ty").join(tile_sums, ["tx", "ty"]).select("area", F.col("points").alias("n"))

    if others is not None:
        followed = stored(ranges(others, z), "ranges")
        least = followed.where("whole").agg(F.min("z")).first()[0]
        up = F.explode(F.sequence(F.lit(0), F.lit(z - (z if least is None else least)))).alias("up")
        sums = tile_sums.select("tx", "ty", "points", up).groupBy((F.lit(z) - F.col("up")).alias("z"), F.expr("shiftright(tx, up)").alias("tx"), F.expr("shiftright(ty, up)").alias("ty")).agg(F.sum("points").alias("n"))
        inside = inside.union(followed.where("whole").select("area", "z", "tx", "ty").join(sums, ["z", "tx", "ty"]).select("area", "n"))
        frame = geo.tile_bounds(F.col("tx"), F.col("ty"), F.lit(z))
        near = lambda s: (F.least(s["y"], s["y"] + s["dy"]) <= F.col("north") + SLACK) & (F.greatest(s["y"], s["y"] + s["dy"]) >= F.col("south") - SLACK) & (F.greatest(s["x"], s["x"] + s["dx"]) >= F.col("west") - SLACK)
        found = followed.where("NOT whole").select("area", "tx", "ty").join(others.select("area", geo.sides_of("ring").alias("sides")), "area").withColumns(frame)
        held = held.union(stored(found.select("area", "tx", "ty", F.filter("sides", near).alias("sides")).mapInArrow(_packed_sides, schema), "other-cells"))

    cut = held.where("NOT whole").drop("whole")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int").alias(f"{n}_parts")
    dealt = cut.groupBy("tx", "ty").agg(F.count("*").alias("rings")).join(tile_sums, ["tx", "ty"]).select("tx", "ty", parts("points", BLOCK_POINTS), parts("rings", BLOCK_RINGS))
    dealt = stored(dealt, "dealt")
    some = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    one = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    rings = cut.join(dealt, ["tx", "ty"]).select("area", "tx", "ty", "sides", one("rings_parts", "area").alias("j"), some("i", "points_parts"))
    tested = placed.join(dealt, ["tx", "ty"]).select("lon", "lat", "tx", "ty", one("points_parts", "number").alias("i"), some("j", "rings_parts"))
    block = ["tx", "ty", "i", "j"]
    crossed = rings.groupBy(*block).cogroup(tested.groupBy(*block)).applyInArrow(_counted, f"area {dict(areas.dtypes)['area']}, n long")
    return inside.union(crossed).groupBy("area").agg(F.sum("n").alias("n"))
