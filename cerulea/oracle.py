"""SQL for DuckDB that checks the queries, built from named steps."""

from __future__ import annotations

from cerulea.functions.geo import CIRCUMFERENCE, MAX_LATITUDE
from cerulea.functions.text import GOOGLE
from cerulea.operators.detect import Limits
from cerulea.queries import AREA_WAYS, AREA_ZOOM, ESTIMATE_ZOOMS, PLAN_ZOOM, RING, ZOOMS
from cerulea.sources.area import PLACES
from cerulea.sources.scene import COLOURS, LAKE, TILE_X, TILE_Y


def _size(z) -> str:
    return f"(256 * pow(2.0, {z}))"


def _wx(lon, z) -> str:
    return f"(({lon} + 180) / 360 * {_size(z)})"


def _wy(lat, z) -> str:
    return f"((1 - asinh(tan(radians(greatest(-{MAX_LATITUDE}, least({MAX_LATITUDE}, {lat}))))) / pi()) / 2 * {_size(z)})"


def _lon(x, z) -> str:
    return f"({x} / {_size(z)} * 360 - 180)"


def _lat(y, z) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * {y} / {_size(z)}))))"


def _tile(w, z) -> str:
    return f"least(greatest(floor({w} / 256)::BIGINT, 0), {2**z - 1})::INT"


def _mpp(lat, z) -> str:
    return f"(cos(radians({lat})) * {CIRCUMFERENCE} / {_size(z)})"


POINTS = "points AS (SELECT event_id, -179.0 + 358.0 * ((event_id * 104729) % 100003) / 100003 AS lon, -85.0 + 170.0 * ((event_id * 7919) % 100003) / 100003 AS lat FROM events)"
NEAR = "near AS (SELECT event_id, -8.03 + 0.05 * ((event_id * 7919) % 1009)::DOUBLE / 1009 AS lon, 37.07 + 0.04 * ((event_id * 104729) % 1013)::DOUBLE / 1013 AS lat FROM events)"
POINTS = POINTS.replace("% 100003)", "% 100003)::DOUBLE")
TILES = f"tiles AS (SELECT event_id, {_tile(_wx('lon', 19), 19)} AS tx, {_tile(_wy('lat', 19), 19)} AS ty FROM points)"


def _channel(c: int) -> str:
    return "CASE s_suppkey % 5 " + " ".join(f"WHEN {k} THEN {x[c]}" for k, x in enumerate(COLOURS)) + " END"


PIXELS = f"""rects AS (SELECT s_suppkey AS k, (s_suppkey % 16) * 128 + (s_suppkey * 37) % 120 AS gx, (s_suppkey // 16) * 128 + (s_suppkey * 53) % 120 AS gy,
  8 + (s_suppkey * 11) % 40 AS w, 6 + (s_suppkey * 7) % 24 AS h, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM supplier),
xs AS (SELECT *, unnest(range(gx, gx + w)) AS x FROM rects),
ys AS (SELECT *, unnest(range(gy, gy + h)) AS y FROM xs),
won AS (SELECT x, y, arg_max((r, g, b), k) AS c FROM ys GROUP BY 1, 2),
pixels AS (SELECT ({TILE_X} + x // 256)::INT AS tx, ({TILE_Y} + y // 256)::INT AS ty, (x % 256)::INT AS px, (y % 256)::INT AS py, c[1]::INT AS r, c[2]::INT AS g, c[3]::INT AS b FROM won)"""


def _hsv(table: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN q < 0 THEN q + 360 ELSE q END AS h, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s FROM (
  SELECT *, 60 * CASE WHEN d = 0 THEN 0 WHEN v = r / 255.0::DOUBLE THEN fmod((g - b) / 255.0::DOUBLE / d, 6) WHEN v = g / 255.0::DOUBLE THEN (b - r) / 255.0::DOUBLE / d + 2 ELSE (r - g) / 255.0::DOUBLE / d + 4 END AS q
  FROM (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS v, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS d FROM {table})))"""


GATE = "h BETWEEN 148 AND 215 AND v >= 0.24 AND (s >= 0.34 OR (s >= 0.2 AND v >= 0.5)) AND b - r >= 10 AND g - r >= -8 AND b - g BETWEEN -12 AND 70"
MASK = f"{PIXELS}, {_hsv('pixels', 'coloured')}, mask AS (SELECT tx, ty, px, py FROM coloured WHERE {GATE})"


def _reach(source: str, name: str) -> str:
    return f"{name} AS (SELECT tx, ty, px + dx AS px, py + dy AS py FROM {source}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) WHERE px + dx BETWEEN 0 AND 255 AND py + dy BETWEEN 0 AND 255)"


def _dilated(source: str, name: str) -> str:
    return f"{_reach(source, name + '_r')}, {name} AS (SELECT DISTINCT tx, ty, px, py FROM {name}_r)"


def _eroded(source: str, name: str) -> str:
    out = "(px IN (0, 255))::INT + (py IN (0, 255))::INT"
    return f"{_reach(source, name + '_r')}, {name} AS (SELECT tx, ty, px, py FROM {name}_r GROUP BY ALL HAVING count(*) + {out} = 5)"


CLEAN = f"{MASK}, {_eroded('mask', 'e1')}, {_dilated('e1', 'd1')}, {_dilated('d1', 'd2')}, {_eroded('d2', 'cleaned')}"
LABELS = f"""{CLEAN},
islands AS (SELECT *, px - row_number() OVER (PARTITION BY tx, ty, py ORDER BY px) AS island FROM cleaned),
runs AS (SELECT tx, ty, py, min(px) AS x0, max(px) AS x1, py * 256 + min(px) AS id FROM islands GROUP BY tx, ty, py, island),
touch AS (SELECT a.tx, a.ty, a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.tx = b.tx AND a.ty = b.ty AND abs(a.py - b.py) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
walk(tx, ty, id, root) AS (SELECT tx, ty, id, id FROM runs UNION SELECT w.tx, w.ty, t.b, w.root FROM walk w JOIN touch t ON t.tx = w.tx AND t.ty = w.ty AND t.a = w.id),
roots AS (SELECT tx, ty, id, min(root) AS root FROM walk GROUP BY 1, 2, 3),
labels AS (SELECT r.tx, r.ty, unnest(range(x0, x1 + 1))::INT AS px, r.py, dense_rank() OVER (PARTITION BY r.tx, r.ty ORDER BY root)::INT AS label FROM runs r JOIN roots o ON o.tx = r.tx AND o.ty = r.ty AND o.id = r.id)"""
FILLED = f"""{LABELS}, painted AS (SELECT l.*, coalesce(r, 120) AS r, coalesce(g, 118) AS g, coalesce(b, 115) AS b FROM labels l LEFT JOIN pixels p USING (tx, ty, px, py)), {_hsv('painted', 'filled')}"""
STATS = f"""{FILLED}, stats AS (SELECT tx, ty, label, count(*) AS pixels, min(px) AS min_px, max(px) AS max_px, sum(px)::BIGINT AS sum_px, min(py) AS min_py, max(py) AS max_py, sum(py)::BIGINT AS sum_py,
  round(avg(h::FLOAT::DOUBLE), 6) AS hue, round(avg(s::FLOAT::DOUBLE), 6) AS saturation, round(avg(v::FLOAT::DOUBLE), 6) AS value,
  round(avg((h::FLOAT >= 168 AND h::FLOAT <= 205 AND s::FLOAT::DOUBLE >= 0.34)::INT), 6) AS strict FROM filled GROUP BY 1, 2, 3)"""


TEXTURE = f"""{STATS}, own AS (SELECT tx, ty, px, py, label, v::FLOAT::DOUBLE AS v FROM filled),
  steps AS (SELECT a.tx, a.ty, a.label, abs(r.v - a.v) + abs(d.v - a.v) AS step FROM own a
    JOIN own r ON r.tx = a.tx AND r.ty = a.ty AND r.label = a.label AND r.px = a.px + 1 AND r.py = a.py
    JOIN own d ON d.tx = a.tx AND d.ty = a.ty AND d.label = a.label AND d.px = a.px AND d.py = a.py + 1
    JOIN own l ON l.tx = a.tx AND l.ty = a.ty AND l.label = a.label AND l.px = a.px - 1 AND l.py = a.py
    JOIN own u ON u.tx = a.tx AND u.ty = a.ty AND u.label = a.label AND u.px = a.px AND u.py = a.py - 1
    WHERE a.px BETWEEN 1 AND 254 AND a.py BETWEEN 1 AND 254),
  roughness AS (SELECT tx, ty, label, count(*) AS samples, sum(step) AS total FROM steps GROUP BY 1, 2, 3),
  texture AS (SELECT tx, ty, label, coalesce(samples, 0) AS samples, CASE WHEN samples >= greatest(6.0, pixels * 0.12) THEN round(total / samples, 6) ELSE 0 END::DOUBLE AS texture
    FROM stats LEFT JOIN roughness USING (tx, ty, label))"""

_L = Limits()
FRAGMENTS = f"""{TEXTURE},
  placed AS (SELECT *, max_px - min_px + 1 AS width, max_py - min_py + 1 AS height, min_py = 0 AS n, min_px = 0 AS w, max_py = 255 AS s, max_px = 255 AS e,
    {_lon("(tx * 256 + sum_px / pixels + 0.5)", 19)} AS lon, {_lat("(ty * 256 + sum_py / pixels + 0.5)", 19)} AS lat, {_lon("(tx * 256 + min_px)", 19)} AS west,
    {_lon("(tx * 256 + max_px + 1)", 19)} AS east, {_lat("(ty * 256 + min_py)", 19)} AS north, {_lat("(ty * 256 + max_py + 1)", 19)} AS south
    FROM stats JOIN texture USING (tx, ty, label) WHERE pixels >= {_L.min_pixels}),
  sized AS (SELECT *, round(pixels / (width * height), 6) AS fill, {_mpp("lat", 19)} AS mpp, n OR w OR s OR e AS edge FROM placed),
  measured AS (SELECT *, pixels * mpp * mpp AS area, '19/' || tx || '/' || ty || ':' || min_px || ',' || min_py AS frag FROM sized),
  frags AS (SELECT * FROM measured WHERE texture <= {_L.max_texture} AND CASE WHEN edge THEN area <= {4 * _L.max_area}
    ELSE greatest(width, height) / least(width, height) <= {_L.max_aspect} AND fill >= {_L.min_fill} AND area BETWEEN {_L.min_area} AND {_L.max_area} END)"""
_SIDE = "(111320 * greatest(0.05, cos(radians((south + north) / 2))))"
PAIRS = f"""{FRAGMENTS},
  grown AS (SELECT frag, tx, ty, west - grow / {_SIDE} AS west, east + grow / {_SIDE} AS east, south - grow / 111320 AS south, north + grow / 111320 AS north
    FROM (SELECT *, {_L.adjacency_px} * mpp AS grow FROM frags WHERE edge)),
  pairs AS (SELECT DISTINCT least(p.frag, q.frag) AS a, greatest(p.frag, q.frag) AS b FROM grown p JOIN frags q
    ON q.edge AND p.frag <> q.frag AND abs(p.tx - q.tx) <= 1 AND abs(p.ty - q.ty) <= 1 AND p.west <= q.east AND q.west <= p.east AND p.south <= q.north AND q.south <= p.north)"""
_UNIT = "least(1.0, greatest(0.0, {}))"
_SURE = f"""0.30 * strict + 0.18 * exp(-(hue - 189) * (hue - 189) / 1352.0::DOUBLE) + 0.14 * {_UNIT.format("(saturation - 0.15) / 0.45")} + 0.15 * {_UNIT.format("(0.1 - texture) / 0.08")}
  + 0.12 * {_UNIT.format("(fill - 0.28) / 0.45")} + 0.11 * CASE WHEN size < 10 THEN size / 10 WHEN size <= 150 THEN 1.0 ELSE greatest(0.25, 1 - (size - 150) / 2500) END"""
MERGED = f"""{PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach(frag, other) AS (SELECT frag, frag FROM frags UNION SELECT r.frag, l.b FROM reach r JOIN links l ON l.a = r.other),
  named AS (SELECT frag, min(other) AS cluster FROM reach GROUP BY 1),
  rims AS (SELECT frag, unnest([[tx, ty - 1, n::INT], [tx, ty + 1, s::INT], [tx - 1, ty, w::INT], [tx + 1, ty, e::INT]]) AS t FROM frags),
  cut AS (SELECT DISTINCT frag FROM rims WHERE t[3] = 1 AND (t[1], t[2]) NOT IN (SELECT (tx, ty) FROM pixels)),
  summed AS (SELECT cluster, sum(pixels)::BIGINT AS pixels, sum(area) AS area, count(*) AS parts, count(DISTINCT (tx, ty)) AS tiles,
    {", ".join(f"round(sum({c} * pixels) / sum(pixels), {d}) AS {c}" for c, d in [*((c, 6) for c in ("hue", "saturation", "value", "strict", "fill", "texture")), ("lon", 8), ("lat", 8)])},
    bool_or(frag IN (SELECT frag FROM cut)) AS truncated FROM frags JOIN named USING (frag) GROUP BY 1),
  summed2 AS (SELECT *, round(area, 6) AS size FROM summed),
  judged AS (SELECT *, ({_SURE}) * CASE WHEN truncated THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN texture > 0.1 AND fill < 0.5 THEN 0.78::DOUBLE ELSE 1 END AS sure FROM summed2),
  merged AS (SELECT * EXCLUDE (area, size, sure), floor({_UNIT.format("sure")} * 1000 + 0.5)::DOUBLE / 1000 AS confidence, CASE WHEN area <= {_L.hot_tub} THEN 'hot_tub' ELSE 'pool' END AS kind,
    area > {_L.max_area} AS open_water, area BETWEEN {_L.min_merged} AND {_L.max_area} AS shown, size AS area FROM judged),
  ranked AS (SELECT row_number() OVER (ORDER BY area DESC, confidence DESC, cluster)::INT AS rank, cluster, kind, area, confidence, truncated, lon, lat, pixels FROM merged WHERE shown)"""


# the scene with the lake, and the tiles that were scanned there
_WATER = ", ".join(map(str, COLOURS[0]))
LAKE_PIXELS = PIXELS.replace("FROM supplier),", f"FROM supplier UNION ALL SELECT -1, {LAKE[0]}, {LAKE[1]}, {LAKE[2]}, {LAKE[2]}, {_WATER}),").replace("y // 256", "floor(y / 256.0)::INT").replace("(y % 256)", "((y % 256 + 256) % 256)")
SCANNED = f"""scanned AS (SELECT ({TILE_X} + c)::INT AS tx, ({TILE_Y} + unnest(range({LAKE[1]} // 256 - ({LAKE[1]} % 256 <> 0)::INT, (SELECT max(gy + h - 1) FROM rects) // 256 + 1)))::INT AS ty
  FROM (SELECT unnest([0, 1, 2, 3, 5, 6, 7, 8]) AS c))"""
LAKE_MERGED = MERGED.replace(PIXELS, f"{LAKE_PIXELS}, {SCANNED}").replace("SELECT (tx, ty) FROM pixels)", "SELECT (tx, ty) FROM scanned)")
LAKE_BOXES = f"{LAKE_MERGED}, boxes AS (SELECT cluster, round(min(west), 9) AS west, round(min(south), 9) AS south, round(max(east), 9) AS east, round(max(north), 9) AS north FROM frags JOIN named USING (frag) GROUP BY 1)"
_SEEN = f"confidence >= {_L.shown}"


def _recursive(body: str, steps: str) -> str:
    return f"WITH RECURSIVE {steps} {body}"


def _edges() -> list:
    return [(*RING[i - 1], *RING[i]) for i in range(len(RING))]


def _inside(lon: str, lat: str) -> str:
    terms = [f"(({y2} > {lat}) <> ({y1} > {lat}) AND {lon} < ({x1} - {x2}) * ({lat} - {y2}) / ({y1} - {y2}) + {x2})::INT" for x1, y1, x2, y2 in (tuple(f"({v}::DOUBLE)" for v in e) for e in _edges())]
    return f"(({' + '.join(terms)}) % 2 = 1)"


def _turn(a: str, b: str, c: str) -> str:
    """Which way the path over three points turns; points are column suffixes."""
    return f"sign((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"


def _within(p: str, q: str, r: str) -> str:
    return f"x{r} BETWEEN least(x{p}, x{q}) AND greatest(x{p}, x{q}) AND y{r} BETWEEN least(y{p}, y{q}) AND greatest(y{p}, y{q})"


def _span(start: str, way: str, low: str, high: str) -> tuple[str, str]:
    """From which part of a side to which it lies between two parallels."""
    p, q = f"(({low}) - {start}) / {way}", f"(({high}) - {start}) / {way}"
    within = f"{start} BETWEEN {low} AND {high}"
    return f"CASE WHEN {way} = 0 THEN CASE WHEN {within} THEN 0 ELSE 1 END ELSE least({p}, {q}) END", f"CASE WHEN {way} = 0 THEN CASE WHEN {within} THEN 1 ELSE 0 END ELSE greatest({p}, {q}) END"


def _clipped(west: str, south: str, east: str, north: str) -> str:
    """Whether the side (x, y, dx, dy) has a point in a box."""
    across, up = _span("x", "dx", west, east), _span("y", "dy", south, north)
    return f"greatest(0.0::DOUBLE, {across[0]}, {up[0]}) <= least(1.0::DOUBLE, {across[1]}, {up[1]})"


def _crossing(lon: str, lat: str) -> str:
    """Whether a ray to the east from a point crosses the side (x, y, dx, dy)."""
    return f"(y > {lat}) <> (y + dy > {lat}) AND {lon} < x + dx * (({lat} - y) / nullif(dy, 0))"


def _cover(z: int = PLAN_ZOOM) -> str:
    """A tile counts if some side, clipped to it, is not empty, or if one of its corners, and so all of it, is inside."""
    lon, lat = [p[0] for p in RING], [p[1] for p in RING]
    span = lambda w, a, b: f"unnest(range({_tile(w(f'({a}::DOUBLE)', z), z)}, {_tile(w(f'({b}::DOUBLE)', z), z)} + 1))::INT"
    ring = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2 - x1}::DOUBLE, {y2 - y1}::DOUBLE)" for x1, y1, x2, y2 in _edges())
    return f"""cand AS (SELECT tx, ty FROM (SELECT {span(_wx, min(lon), max(lon))} AS tx) CROSS JOIN (SELECT {span(_wy, max(lat), min(lat))} AS ty)),
  bounds AS (SELECT tx, ty, {_lon("(tx * 256)", z)} AS w, {_lat("((ty + 1) * 256)", z)} AS s, {_lon("((tx + 1) * 256)", z)} AS e, {_lat("(ty * 256)", z)} AS n FROM cand),
  ring(x, y, dx, dy) AS (VALUES {ring}),
  cover AS (SELECT tx, ty FROM bounds CROSS JOIN ring GROUP BY tx, ty HAVING bool_or({_clipped("w", "s", "e", "n")}) OR count(*) FILTER ({_crossing("w", "s")}) % 2 = 1)"""


def _corner(i: int, c: int) -> str:
    size, centre = "CASE WHEN c_custkey % 97 = 0 THEN 0.01::DOUBLE ELSE 0.0005::DOUBLE END", ("(-8.5 + 0.9 * ((c_custkey * 7919) % 1009)::DOUBLE / 1009)", "(36.9 + 0.4 * ((c_custkey * 104729) % 1013)::DOUBLE / 1013)")[c]
    return f"({centre} + {AREA_WAYS[i][c]} * ((c_custkey * {i + 3}) % 5 + 1) * {size})"


CORNERS = "corners AS (SELECT c_custkey AS area, unnest([" + ", ".join(f"{{'i': {i}, 'x': {_corner(i, 0)}, 'y': {_corner(i, 1)}}}" for i in range(len(AREA_WAYS))) + "], recursive := true) FROM customer)"
SIDES = f"{CORNERS}, sides AS (SELECT p.area, p.i, p.x, p.y, q.x - p.x AS dx, q.y - p.y AS dy FROM corners p JOIN corners q ON q.area = p.area AND q.i = (p.i + 1) % {len(AREA_WAYS)} WHERE q.x <> p.x OR q.y <> p.y)"


def _areas(z: int, at_most: int = 0) -> str:
    """cover (area, tx, ty) of the rings, and boxed (area, tiles of its box); those of larger boxes than ``at_most``, if given, are not covered."""
    at = lambda w, f, c: f"{_tile(w(f'{f}({c})', z), z)}"
    few = f" WHERE boxed <= {at_most}" if at_most else ""
    return f"""{SIDES}, frames AS (SELECT area, {at(_wx, "min", "x")} AS x0, {at(_wx, "max", "x")} AS x1, {at(_wy, "max", "y")} AS y0, {at(_wy, "min", "y")} AS y1 FROM corners GROUP BY 1),
  boxed AS (SELECT *, (x1 - x0 + 1)::BIGINT * (y1 - y0 + 1) AS boxed FROM frames),
  cand AS (SELECT area, tx, unnest(range(y0, y1 + 1))::INT AS ty FROM (SELECT *, unnest(range(x0, x1 + 1))::INT AS tx FROM boxed{few})),
  bounds AS (SELECT area, tx, ty, {_lon("(tx * 256)", z)} AS w, {_lat("((ty + 1) * 256)", z)} AS s, {_lon("((tx + 1) * 256)", z)} AS e, {_lat("(ty * 256)", z)} AS n FROM cand),
  cover AS (SELECT area, tx, ty FROM bounds JOIN sides USING (area) GROUP BY ALL HAVING bool_or({_clipped("w", "s", "e", "n")}) OR count(*) FILTER ({_crossing("w", "s")}) % 2 = 1)"""


def _hilbert(z: int) -> str:
    """A recursive walk down the bits of the tile numbers, from the highest, in the frame of each quarter of the curve."""
    return f"""curve(area, tx, ty, x, y, d, k) AS (SELECT area, tx, ty, tx::BIGINT, ty::BIGINT, 0::BIGINT, {z - 1} FROM cover UNION ALL
    SELECT area, tx, ty, CASE WHEN b = 1 THEN u WHEN a = 1 THEN s - 1 - v ELSE v END, CASE WHEN b = 1 THEN v WHEN a = 1 THEN s - 1 - u ELSE u END, d * 4 + CASE WHEN a = 1 THEN 3 - b ELSE b END, k - 1
    FROM (SELECT *, x // s AS a, y // s AS b, x % s AS u, y % s AS v FROM (SELECT *, 1::BIGINT << k AS s FROM curve WHERE k >= 0))),
  hilbert AS (SELECT area, tx, ty, row_number() OVER (PARTITION BY area ORDER BY d) - 1 AS hilbert FROM curve WHERE k = -1)"""


def _bare(name: str, dx: int, dy: int) -> str:
    near = f"m.tx = l.tx AND m.ty = l.ty AND m.label = l.label AND m.px = l.px + {dx} AND m.py = l.py + {dy}"
    return f"(count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels m WHERE {near})))::BIGINT AS \"{name}\""


def _micro(x: str) -> str:
    return f"regexp_replace((floor({x} * 1000000 + 0.5)::BIGINT::DECIMAL(18, 0) * 0.000001::DECIMAL(7, 6))::VARCHAR, '\\.?0+$', '')"


_LINK = f"""corners AS (SELECT event_id, {_micro("lon")} AS x, {_micro("lat")} AS y, {_micro("(lon + 0.01::DOUBLE)")} AS x2, {_micro("(lat + 0.01::DOUBLE)")} AS y2, event_id % 13 + 10 AS zoom FROM near),
  coded AS (SELECT *, to_base64(encode('[' || zoom || ',[[' || x || ',' || y || '],[' || x2 || ',' || y || '],[' || x || ',' || y2 || ']]]')) AS code FROM corners)"""


def _map(body: str, *steps: str) -> str:
    return f"WITH {', '.join(steps)} {body}"


def _estimate(z: int) -> str:
    return f"SELECT {z} AS zoom, CASE WHEN (SELECT count(*) FROM cand) > 50000 THEN (SELECT count(*) FROM cand) ELSE (SELECT count(*) FROM cover) END AS tiles, (SELECT count(*) FROM cand) > 50000 AS approximate"


def _rectangle(lon: str, lat: str) -> str:
    half = f"(450 / (111320.0::DOUBLE * cos(radians({lat}))))"
    up = "(350 / 111320.0::DOUBLE)"
    area = f"abs(radians(2 * {half}) * ((2 + 2 * sin(radians({lat} - {up}))) - (2 + 2 * sin(radians({lat} + {up}))))) * 6378137.0 * 6378137.0 / 2"
    return f"round({lon} - {half}, 9) AS lon0, round({lat} - {up}, 9) AS lat0, round({lon} + {half}, 9) AS lon2, round({lat} + {up}, 9) AS lat2, round({area}, 1) AS area"


_DEMO = ", ".join(f"('{n}', {lat}::DOUBLE, {lon}::DOUBLE)" for n, lat, lon in PLACES)


def _diff(rounds: int = 10) -> str:
    """Mutual nearest pairs, round after round; at sf0.01 none is left after the last."""
    place = "-8.03 + 0.01 * ((event_id * 7919) % 1009)::DOUBLE / 1009", "37.07 + 0.04 * ((event_id * 104729) % 1013)::DOUBLE / 1013"
    across = "(y.lon - x.lon) * 111320.0::DOUBLE * cos(radians((x.lat + y.lat) / 2))"
    steps = [
        f"old AS (SELECT event_id AS a, {place[0]} AS lon, {place[1]} AS lat FROM events WHERE event_id % 5 <> 0)",
        f"new AS (SELECT event_id + 1000000 AS b, {place[0]} + ((event_id * 31) % 13 - 6) * 0.000004::DOUBLE AS lon, {place[1]} + ((event_id * 17) % 11 - 5) * 0.000004::DOUBLE AS lat FROM events WHERE event_id % 7 <> 0)",
        f"p0 AS MATERIALIZED (SELECT a, b, m FROM (SELECT a, b, round(sqrt(({across}) * ({across}) + pow((y.lat - x.lat) * 111320, 2)), 6) AS m FROM old x JOIN new y ON y.lat BETWEEN x.lat - 0.00005 AND x.lat + 0.00005 AND abs(x.lon - y.lon) < 0.0001) WHERE m < 5)",
    ]
    for k in range(rounds):
        steps += [
            f"m{k} AS MATERIALIZED (SELECT a, b, m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m, b) AS na, row_number() OVER (PARTITION BY b ORDER BY m, a) AS nb FROM p{k}) WHERE na = 1 AND nb = 1)",
            f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} WHERE a NOT IN (SELECT a FROM m{k}) AND b NOT IN (SELECT b FROM m{k}))",
        ]
    return ", ".join(steps) + ", met AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(rounds)) + ")"


def oracle_sql() -> dict[str, str]:
    out = {
        "scan_detections": _recursive("SELECT cluster, pixels, area, parts, tiles, confidence, kind, truncated, open_water, shown, west, south, east, north FROM merged JOIN boxes USING (cluster)", LAKE_BOXES),
        "scan_ranking": _recursive("SELECT rank, cluster, area, confidence FROM ranked", LAKE_MERGED),
        "scan_totals": _recursive(
            f"""SELECT count(*) FILTER ({_SEEN} AND shown) AS n, round(coalesce(sum(area) FILTER ({_SEEN} AND shown), 0), 3) AS area, count(*) FILTER ({_SEEN} AND shown AND kind <> 'hot_tub') AS n_pools,
  round(coalesce(sum(area) FILTER ({_SEEN} AND shown AND kind <> 'hot_tub'), 0), 3) AS area_pools, count(*) FILTER (open_water) AS suppressed FROM merged""",
            LAKE_MERGED,
        ),
        "scan_stats": _map(
            f"SELECT count(*) AS tiles, count(*) FILTER ((tx, ty) IN (SELECT (tx, ty) FROM mask)) AS wet, count(*) FILTER ((tx, ty) NOT IN (SELECT (tx, ty) FROM mask)) AS empty, round(sum(pow(256 * {_mpp(_lat('((ty + 0.5) * 256)', 19), 19)}, 2)), 1) AS swept_m2 FROM scanned",
            MASK.replace(PIXELS, f"{LAKE_PIXELS}, {SCANNED}"),
        ),
        "plan_estimates": " UNION ALL ".join(f"(WITH {_cover(z)} {_estimate(z)})" for z in ESTIMATE_ZOOMS),
        "areas_cover": _map("SELECT * FROM cover", _areas(AREA_ZOOM)),
        "areas_estimate": _map("SELECT area, count(*) AS tiles, false AS approximate FROM cover GROUP BY 1 UNION ALL SELECT area, boxed, true FROM boxed WHERE boxed > 50000", _areas(AREA_ZOOM + 2, 50_000)),
        "areas_orders": _recursive(
            """SELECT area, tx, ty, row_number() OVER (PARTITION BY area ORDER BY ty, CASE WHEN (ty - y0) % 2 = 0 THEN tx ELSE -tx END) - 1 AS serpentine,
  row_number() OVER (PARTITION BY area ORDER BY r, side, CASE side WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN -dx ELSE -dy END) - 1 AS spiral, hilbert FROM sided JOIN hilbert USING (area, tx, ty)""",
            f"{_areas(AREA_ZOOM)}, {_hilbert(AREA_ZOOM)}, mids AS (SELECT area, min(ty) AS y0, floor((min(tx) + max(tx)) / 2 + 0.5)::INT AS mx, floor((min(ty) + max(ty)) / 2 + 0.5)::INT AS my FROM cover GROUP BY 1), "
            "moved AS (SELECT *, tx - mx AS dx, ty - my AS dy, greatest(abs(tx - mx), abs(ty - my)) AS r FROM cover JOIN mids USING (area)), "
            "sided AS (SELECT *, CASE WHEN dy = -r THEN 0 WHEN dx = r THEN 1 WHEN dy = r THEN 2 ELSE 3 END AS side FROM moved)",
        ),
        "areas_points": _map(
            f"SELECT area, count(*) AS n FROM (SELECT area, event_id FROM frames JOIN sides USING (area) JOIN pts ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY ALL HAVING count(*) FILTER ({_crossing('lon', 'lat')}) % 2 = 1) GROUP BY 1",
            f"{SIDES}, frames AS (SELECT area, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM corners GROUP BY 1)",
            "pts AS (SELECT event_id, -8.5 + 0.9 * ((event_id * 15485863) % 100003)::DOUBLE / 100003 AS lon, 36.9 + 0.4 * ((event_id * 32452843) % 100019)::DOUBLE / 100019 AS lat FROM events)",
        ),
        "scan_diff": f"WITH {_diff()} SELECT CASE WHEN b IS NULL THEN 'removed' ELSE 'unchanged' END AS op, a AS before, b AS after, round(m, 3) AS metres FROM old LEFT JOIN met USING (a) UNION ALL SELECT 'added', NULL, b, NULL FROM new WHERE b NOT IN (SELECT b FROM met)",
        "dated_imagery": """WITH o AS (SELECT o_orderkey AS id, o_custkey % 50 AS tx, o_custkey % 3 AS ty, floor(epoch(o_orderdate))::BIGINT AS taken FROM orders),
  r AS (SELECT tx, ty, taken, max(id) AS release FROM o WHERE id % 10 = 0 GROUP BY 1, 2, 3)
SELECT s.id, s.tx, s.ty, s.taken, r.release, r.taken AS released_at FROM (SELECT * FROM o WHERE id % 10 <> 0) s ASOF LEFT JOIN r ON s.tx = r.tx AND s.ty = r.ty AND s.taken >= r.taken""",
        "ring_bbox": _map("SELECT area, round(min(x), 9) AS west, round(min(y), 9) AS south, round(max(x), 9) AS east, round(max(y), 9) AS north FROM corners GROUP BY 1", CORNERS),
        "bbox_intersects_ring": _map(
            f"SELECT area, bool_or({_clipped('w', 's', 'e', 'n')}) OR count(*) FILTER ({_crossing('w', 's')}) % 2 = 1 AS meets FROM boxes JOIN sides USING (area) GROUP BY 1",
            SIDES,
            "boxes AS (SELECT area, x + (area % 7 - 3)::DOUBLE * 0.0007 AS w, y - (area % 7 - 3)::DOUBLE * 0.0007 AS s, x + (area % 7 - 3)::DOUBLE * 0.0007 + (area % 3 + 1)::DOUBLE * 0.0004 AS e, y - (area % 7 - 3)::DOUBLE * 0.0007 + (area % 3 + 1)::DOUBLE * 0.0004 AS n FROM corners WHERE i = 0)",
        ),
        "plan_grid": _map(
            f"SELECT event_id, ({_tile(_wx('lon', 14), 14)} + dx)::INT AS tx, ({_tile(_wy('lat', 14), 14)} + dy)::INT AS ty FROM points, (SELECT unnest(range(-2, 2)) AS dx) a, (SELECT unnest(range(-2, 2)) AS dy) b", POINTS
        ),
        "area_rectangles": _map(f"SELECT event_id::VARCHAR AS name, {_rectangle('lon', 'lat')} FROM near UNION ALL SELECT name, {_rectangle('lon', 'lat')} FROM (VALUES {_DEMO}) d(name, lat, lon)", NEAR),
        "fmt_labels": _map(
            """SELECT event_id, printf('%.5f, %.5f', lat, lon) AS place, format('{:,}', event_id * 7919) AS count,
  printf('≈ %.1f × %.1f m', 2 * sqrt((event_id % 400 + 3)::DOUBLE / 2), sqrt((event_id % 400 + 3)::DOUBLE / 2)) AS dims, round(event_id % 10 / 10, 6) AS share,
  CASE WHEN event_id % 10 > 3 THEN round((event_id % 97)::DOUBLE / (event_id % 10) * (10 - event_id % 10), 6) END AS left FROM points""".replace(" AS left ", ' AS "left" '),
            POINTS,
        ),
        "cache_keys": _map("SELECT event_id, '19-' || tx || '-' || ty || '-' || substr(sha256('https://tiles.example/19/' || ty || '/' || tx), 1, 24) || '.bin' AS file FROM tiles", POINTS, TILES),
        "color_confidence": f"""WITH m AS (SELECT event_id, (event_id % 11)::DOUBLE / 11 AS strict, (event_id % 67)::DOUBLE / 67 * 100 + 130 AS hue, (event_id % 13)::DOUBLE / 13 AS saturation, (event_id % 17)::DOUBLE / 17 * 0.2::DOUBLE AS texture,
  (event_id % 19)::DOUBLE / 19 AS fill, (event_id % 101)::DOUBLE / 101 * 900 + 1 AS size, event_id % 2 = 0 AS truncated FROM events),
j AS (SELECT event_id, ({_SURE}) * CASE WHEN truncated THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN texture > 0.1 AND fill < 0.5 THEN 0.78::DOUBLE ELSE 1 END AS sure FROM m)
SELECT event_id, floor({_UNIT.format("sure")} * 1000 + 0.5)::DOUBLE / 1000 AS confidence FROM j""",

        "geo_world_px": _map(f"SELECT event_id, round({_wx('lon', 19)}, 3) AS wx, round({_wy('lat', 19)}, 3) AS wy FROM points", POINTS),
        "geo_tile_of": _map("SELECT * FROM tiles", POINTS, TILES),
        "geo_tile_bbox": _map(f"SELECT event_id, round({_lon('(tx * 256)', 19)}, 9) AS west, round({_lat('((ty + 1) * 256)', 19)}, 9) AS south, round({_lon('((tx + 1) * 256)', 19)}, 9) AS east, round({_lat('(ty * 256)', 19)}, 9) AS north FROM tiles", POINTS, TILES),
        "geo_mpp": _map("SELECT event_id, " + ", ".join(f"round({_mpp('lat', z)}, 6) AS mpp{z}" for z in ZOOMS) + " FROM points", POINTS),
        "geo_px_to_lonlat": _map(f"SELECT event_id, round({_lon('(tx * 256 + event_id % 257)', 19)}, 9) AS lon, round({_lat('(ty * 256 + event_id % 129)', 19)}, 9) AS lat FROM tiles", POINTS, TILES),
        "geo_tile_histogram": _map(f"SELECT {_tile(_wx('lon', 3), 3)} AS tx, {_tile(_wy('lat', 3), 3)} AS ty, count(*) AS n FROM points GROUP BY 1, 2", POINTS),
        "point_in_ring": _map(f"SELECT event_id, {_inside('lon', 'lat')} AS inside FROM near", NEAR),
        "bbox_expand": _map("SELECT event_id, round(lon - 111.32 / (111320 * greatest(0.05, cos(radians(lat)))), 9) AS west, round(lat - 0.001, 9) AS south, round(lon + 111.32 / (111320 * greatest(0.05, cos(radians(lat)))), 9) AS east, round(lat + 0.001, 9) AS north FROM points", POINTS),
        "ring_area": _map("SELECT event_id, round(abs(radians(0.001) * ((2 + 2 * sin(radians(lat))) - (2 + 2 * sin(radians(lat + 0.001))))) * 6378137.0 * 6378137.0 / 2, 3) AS area, round(lon, 9) AS west, round(lat + 0.001, 9) AS north FROM near", NEAR),
        "scene_pixels": _map("SELECT * FROM pixels", PIXELS),
        "px_hsv": _map("SELECT r, g, b, count(*) AS n, round(any_value(h), 6) AS h, round(any_value(s), 6) AS s, round(any_value(v), 6) AS v FROM coloured GROUP BY 1, 2, 3", PIXELS, _hsv("pixels", "coloured")),
        "px_water_mask": _map("SELECT * FROM mask", MASK),
        "px_strict_ratio": _map(f"SELECT tx, ty, count(*) AS n, sum((h::FLOAT >= 168 AND h::FLOAT <= 205 AND s::FLOAT::DOUBLE >= 0.34)::INT)::BIGINT AS strict FROM coloured WHERE {GATE} GROUP BY 1, 2", PIXELS, _hsv("pixels", "coloured")),
        "mask_erode": _map("SELECT * FROM x", MASK, _eroded("mask", "x")),
        "mask_dilate": _map("SELECT * FROM x", MASK, _dilated("mask", "x")),
        "mask_clean": _map("SELECT * FROM cleaned", CLEAN),
        "components": "WITH RECURSIVE " + LABELS + " SELECT * FROM labels",
        "component_stats": "WITH RECURSIVE " + STATS + " SELECT * FROM stats",
        "event_log_latest": "WITH r AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'remove' WHEN event_id % 3 = 0 THEN 'update' ELSE 'add' END AS op, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT id, seq, op, value FROM r WHERE n = 1 AND op <> 'remove'",
        "coverage_stats": _map(f"SELECT count(*) AS tiles, round(sum(pow(256 * {_mpp(_lat('((ty + 0.5) * 256)', 19), 19)}, 2)), 1) AS swept_m2 FROM (SELECT DISTINCT tx, ty FROM pixels)", PIXELS),
        "kept_tiles": _map(
            "SELECT 19 AS z, tx, ty, 65536::BIGINT AS pixels, (sum(r) + (65536 - count(*)) * 120)::BIGINT AS red, (sum(g) + (65536 - count(*)) * 118)::BIGINT AS green, (sum(b) + (65536 - count(*)) * 115)::BIGINT AS blue FROM pixels WHERE tx % 3 <> 0 GROUP BY tx, ty",
            PIXELS,
        ),
        "fmt_links": _map("SELECT event_id, 'https://tiles.example/19/' || ty || '/' || tx AS url, CASE WHEN event_id >= 3600 THEN (event_id // 3600) || ':' ELSE '' END || lpad(((event_id // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS duration FROM tiles", POINTS, TILES),
        "plan_cover": _map("SELECT * FROM cover", _cover()),
        "plan_estimate": _map("SELECT count(*) AS tiles FROM cover", _cover()),
        "plan_serpentine": _map("SELECT tx, ty, row_number() OVER (ORDER BY ty, CASE WHEN (ty - (SELECT min(ty) FROM cand)) % 2 = 0 THEN tx ELSE -tx END) - 1 AS idx FROM cover", _cover()),
        "plan_spiral": _map(
            "SELECT tx, ty, row_number() OVER (ORDER BY r, side, CASE side WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN -dx ELSE -dy END) - 1 AS idx FROM sided",
            _cover(),
            "mid AS (SELECT floor((min(tx) + max(tx)) / 2 + 0.5)::INT AS mx, floor((min(ty) + max(ty)) / 2 + 0.5)::INT AS my FROM cand)",
            "moved AS (SELECT tx, ty, tx - mx AS dx, ty - my AS dy, greatest(abs(tx - mx), abs(ty - my)) AS r FROM cover CROSS JOIN mid)",
            "sided AS (SELECT *, CASE WHEN dy = -r THEN 0 WHEN dx = r THEN 1 WHEN dy = r THEN 2 ELSE 3 END AS side FROM moved)",
        ),
        "boundary_sides": _recursive("SELECT tx, ty, label, " + ", ".join(_bare(*x) for x in (("top", 0, -1), ("right", 1, 0), ("bottom", 0, 1), ("left", -1, 0))) + " FROM labels l GROUP BY tx, ty, label", LABELS),
        "truncation": _recursive("SELECT frag FROM cut", MERGED),
        "aoi_bbox": "SELECT event_id, (event_id % 170)::DOUBLE AS west, (event_id % 80)::DOUBLE AS south, (event_id % 170 + 2)::DOUBLE AS east, (event_id % 80 + 1)::DOUBLE AS north FROM events WHERE event_id % 11 <> 0",
        "aoi_permalink": _map("SELECT event_id, '#aoi=' || rtrim(translate(code, '+/', '-_'), '=') AS link, CASE WHEN zoom <= 20 THEN zoom END::BIGINT AS zoom, CASE WHEN zoom <= 20 THEN x::DOUBLE END AS lon, CASE WHEN zoom <= 20 THEN y::DOUBLE END AS lat FROM coded", NEAR, _LINK),
        "segments_intersect": _map(
            f"SELECT event_id, (t1 <> t2 AND t3 <> t4) OR (t1 = 0 AND {_within('a', 'b', 'c')}) OR (t2 = 0 AND {_within('a', 'b', 'd')}) OR (t3 = 0 AND {_within('c', 'd', 'a')}) OR (t4 = 0 AND {_within('c', 'd', 'b')}) AS meet FROM turned",
            "segs AS (SELECT event_id, event_id % 11 % 7 AS xa, event_id % 13 % 7 AS ya, event_id % 17 % 7 AS xb, event_id % 19 % 7 AS yb, 1 AS xc, 1 AS yc, 5 AS xd, 5 AS yd FROM events)",
            f"turned AS (SELECT *, {_turn('a', 'b', 'c')} AS t1, {_turn('a', 'b', 'd')} AS t2, {_turn('c', 'd', 'a')} AS t3, {_turn('c', 'd', 'b')} AS t4 FROM segs)",
        ),
        "fmt_area": "WITH s AS (SELECT event_id, (event_id * 7919 % 4000037)::DOUBLE / 4 + 0.03::DOUBLE AS a FROM events) SELECT event_id, CASE WHEN a >= 1e6 THEN printf('%.2f km²', a / 1e6) WHEN a >= 1e4 THEN printf('%.2f ha', a / 1e4) WHEN a >= 100 THEN printf('%.0f m²', a) ELSE printf('%.1f m²', a) END AS label FROM s",
        "fmt_map_links": _map("SELECT event_id, printf('https://www.bing.com/maps?cp=%.6f~%.6f&lvl=19&style=a', lat, lon) AS bing, printf('https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=19/%.6f/%.6f', lat, lon, lat, lon) AS osm FROM points", POINTS),
        "component_texture": _recursive("SELECT * FROM texture", TEXTURE),
        "thumb_boxes": _recursive("SELECT frag, greatest(0, min_px - 6)::BIGINT AS x0, greatest(0, min_py - 6)::BIGINT AS y0, least(120, least(256, max_px + 7) - greatest(0, min_px - 6))::BIGINT AS width, least(120, least(256, max_py + 7) - greatest(0, min_py - 6))::BIGINT AS height FROM frags", FRAGMENTS),
        "fragments": _recursive("SELECT frag, pixels, round(area, 4) AS area, round(lon, 8) AS lon, round(lat, 8) AS lat, fill, texture, strict, n, e, s, w FROM frags", FRAGMENTS),
        "merge_pairs": _recursive("SELECT * FROM pairs", PAIRS),
        "merged_detections": _recursive("SELECT * FROM merged", MERGED),
        "open_water": _recursive("SELECT count(*) FILTER (open_water) AS suppressed, count(*) FILTER (shown) AS shown FROM merged", MERGED),
        "rank_all": _recursive("SELECT * FROM ranked", MERGED),
        "rank_visible": _recursive(f"SELECT row_number() OVER (ORDER BY area DESC, confidence DESC, cluster)::INT AS rank, cluster, area, confidence FROM merged WHERE shown AND confidence >= {_L.shown}", MERGED),
        "top_k": _recursive("SELECT * FROM ranked WHERE rank <= 25", MERGED),
        "csv_rows": _recursive(f"""SELECT rank, printf('%d,%s,%s,%.6f,%.6f,%.1f,%.3f,%s,"{GOOGLE.replace('%', '%%')}%.6f%%2C%.6f"', rank, cluster, kind, lat, lon, area, confidence, truncated::VARCHAR, lat, lon) AS line FROM ranked""", MERGED),
    }
    return out
