"""Web Mercator and plane geometry as Column expressions. Longitudes and latitudes are degrees, areas square metres."""

from __future__ import annotations

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
MAX_LATITUDE = 85.05112877980659
EARTH_RADIUS = 6378137.0
CIRCUMFERENCE = 2 * math.pi * EARTH_RADIUS
METRES_PER_DEGREE = 111320.0
TILE = 256


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def world_size(z) -> Column:
    return TILE * F.pow(F.lit(2.0), z)


def world_x(lon, z) -> Column:
    return (lon + 180) / 360 * world_size(z)


def world_y(lat, z) -> Column:
    return (1 - F.asinh(F.tan(F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE)))) / math.pi) / 2 * world_size(z)


def lon_of(x, z) -> Column:
    return x / world_size(z) * 360 - 180


def lat_of(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / world_size(z)))))


def tile_of(world, z) -> Column:
    """Tile number along one axis, inside the world."""
    return F.least(F.greatest(F.floor(world / TILE), F.lit(0)), (F.pow(F.lit(2.0), z) - 1).cast("long")).cast("int")


def metres_per_pixel(lat, z) -> Column:
    return F.cos(F.radians(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))) * CIRCUMFERENCE / world_size(z)


def tile_bounds(x, y, z) -> dict[str, Column]:
    return {"west": lon_of(x * TILE, z), "south": lat_of((y + 1) * TILE, z), "east": lon_of((x + 1) * TILE, z), "north": lat_of(y * TILE, z)}


def expanded(west, south, east, north, metres) -> dict[str, Column]:
    """A box grown by metres on each side; the cosine of its middle latitude counts as 0.05 at least."""
    up = metres / METRES_PER_DEGREE
    side = metres / (METRES_PER_DEGREE * F.greatest(F.lit(0.05), F.cos(F.radians((south + north) / 2))))
    return {"west": west - side, "south": south - up, "east": east + side, "north": north + up}


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """The sides of a literal ring, the closing one first."""
    return [(*ring[i - 1], *ring[i]) for i in range(len(ring))]


def in_ring(lon, lat, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open sides; level sides are never crossed."""
    hits = F.lit(0)
    for x1, y1, x2, y2 in edges(ring):
        if y1 != y2:
            crosses = ((F.lit(y2) > lat) != (F.lit(y1) > lat)) & (lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2)
            hits = hits + crosses.cast("int")
    return hits % 2 == 1


def turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a, b, c, d) -> Column:
    """Whether segments ab and cd touch or cross; each point is a pair of columns or numbers."""
    a, b, c, d = (tuple(F.lit(float(v)) if isinstance(v, (int, float)) else v for v in p) for p in (a, b, c, d))
    t = [turn(*a, *b, *c), turn(*a, *b, *d), turn(*c, *d, *a), turn(*c, *d, *b)]
    within = lambda p, q, r: r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    touching = [(t[0] == 0) & within(a, b, c), (t[1] == 0) & within(a, b, d), (t[2] == 0) & within(c, d, a), (t[3] == 0) & within(c, d, b)]
    return ((t[0] != t[1]) & (t[2] != t[3])) | touching[0] | touching[1] | touching[2] | touching[3]


def side_meets(side: Column, box: dict[str, Column]) -> Column:
    """Whether a side, a struct of its start (x, y) and its way (dx, dy), has a point in a box: clipped to the box, it is not empty."""

    def span(start, step, low, high) -> tuple[Column, Column]:
        """From which part of a side to which it lies between two parallels; from 1 to 0 if nowhere."""
        p, q = (low - start) / step, (high - start) / step
        level, within = step == 0, start.between(low, high)
        return F.when(level, F.when(within, 0.0).otherwise(1.0)).otherwise(F.least(p, q)), F.when(level, F.when(within, 1.0).otherwise(0.0)).otherwise(F.greatest(p, q))

    across, up = span(side["x"], side["dx"], box["west"], box["east"]), span(side["y"], side["dy"], box["south"], box["north"])
    return F.greatest(F.lit(0.0), across[0], up[0]) <= F.least(F.lit(1.0), across[1], up[1])


def box_meets_ring(box: dict[str, Column], ring: list[tuple[float, float]]) -> Column:
    """Whether a box touches the area of a ring: some side, clipped to the box, is not empty, or the box lies inside as a whole, so that one corner tells."""
    ends = [dict(zip(("x", "y", "dx", "dy"), map(float, (x1, y1, x2 - x1, y2 - y1)), strict=True)) for x1, y1, x2, y2 in edges(ring)]
    sides = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in end.items()]) for end in ends])
    return F.exists(sides, lambda side: side_meets(side, box)) | in_ring(box["west"], box["south"], ring)


def sides_of(ring: str) -> Column:
    """The sides of an array column of (lon, lat), open or closed, as structs of start and way; a side without length is left out."""
    other = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, other, lambda p, q: F.struct(p["lon"].alias("x"), p["lat"].alias("y"), (q["lon"] - p["lon"]).alias("dx"), (q["lat"] - p["lat"]).alias("dy")))
    return F.filter(sides, lambda s: (s["dx"] != 0) | (s["dy"] != 0))


def crosses_level(side: Column, lat) -> Column:
    """Whether a side has its ends on different sides of a parallel, the upper end being outside."""
    return (side["y"] > lat) != (side["y"] + side["dy"] > lat)


def lon_at(side: Column, lat) -> Column:
    """Where a side that crosses a parallel does so."""
    return side["x"] + side["dx"] * ((lat - side["y"]) / F.when(side["dy"] != 0, side["dy"]))


def in_sides(lon, lat, sides) -> Column:
    """Even-odd rule for the sides of a ring in an array column."""
    return F.size(F.filter(sides, lambda s: crosses_level(s, lat) & (lon < lon_at(s, lat)))) % 2 == 1


def ring_area(ring: str) -> Column:
    """Area on the sphere of an array column of (lon, lat) structs, open or closed; 0 with fewer than three points."""
    other = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, other, lambda p, q: F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) * EARTH_RADIUS * EARTH_RADIUS / 2)
