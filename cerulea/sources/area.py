"""Areas to scan, from text: boxes, GeoJSON, permalinks and places. Column expressions; what cannot be read is null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits of a permalink.
ZOOMS, VERTICES, MAX_LON, MAX_LAT = (10, 20), (3, 200), 180, 85.06
_PREFIX = "#aoi="


def _corner(lon, lat) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def ring_of_bbox(text) -> Column:
    """"south,west,north,east" as the ring SW, SE, NE, NW; null unless it is four finite numbers."""
    parts = F.split(text, ",")
    s, w, n, e = (F.trim(F.get(parts, k)).try_cast("double") for k in range(4))
    finite = [F.coalesce(F.abs(v) < math.inf, F.lit(False)) for v in (s, w, n, e)]
    return F.when((F.size(parts) == 4) & finite[0] & finite[1] & finite[2] & finite[3], F.array(_corner(w, s), _corner(e, s), _corner(e, n), _corner(w, n)))


def _ring(points) -> Column:
    return F.transform(points, lambda p: _corner(F.get(p, 0), F.get(p, 1)))


def ring_of_geojson(json) -> Column:
    """The outer ring of a Polygon or of the first part of a MultiPolygon: bare, in a Feature, or in the first Feature of a FeatureCollection. Holes are left out."""
    kind = F.get_json_object(json, "$.type")
    shape = F.when(kind == "Feature", F.get_json_object(json, "$.geometry")).when(kind == "FeatureCollection", F.get_json_object(json, "$.features[0].geometry")).otherwise(json)
    what, points = F.get_json_object(shape, "$.type"), F.get_json_object(shape, "$.coordinates")
    one, many = F.from_json(points, "array<array<array<double>>>"), F.from_json(points, "array<array<array<array<double>>>>")
    return F.when(what == "Polygon", _ring(F.get(one, 0))).when(what == "MultiPolygon", _ring(F.get(F.get(many, 0), 0)))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring) of GeoJSON files, one area a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", ring_of_geojson(F.col("value")).alias("ring"))


def six_places(x) -> Column:
    """A coordinate with six decimals at most, halves up, without trailing zeros."""
    micro = F.floor(x * 1e6 + 0.5).cast("decimal(18,0)")
    return F.regexp_replace((micro * F.lit("0.000001").cast("decimal(7,6)")).cast("string"), r"\.?0+$", "")


def permalink(ring, zoom) -> Column:
    """``#aoi=`` and the URL-safe base64, unpadded and in one line, of [zoom, [[lon, lat], ...]]."""
    points = F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), six_places(p["lon"]), F.lit(","), six_places(p["lat"]), F.lit("]"))), ",")
    plain = F.base64(F.concat(F.lit("["), zoom.cast("string"), F.lit(",["), points, F.lit("]]")).cast("binary"))
    return F.concat(F.lit(_PREFIX), F.rtrim(F.translate(plain, "+/\r\n", "-_"), F.lit("=")))


def ring_of_permalink(link) -> Column:
    """(zoom, ring) of a permalink; null outside zoom 10 to 20, 3 to 200 vertices and the map."""
    code = F.translate(F.regexp_extract(link, _PREFIX + "([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    parts = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "array<string>")
    zoom, points = F.get(parts, 0).try_cast("double"), F.from_json(F.get(parts, 1), "array<array<double>>")
    good = F.forall(points, lambda p: F.coalesce((F.size(p) == 2) & (F.abs(F.get(p, 0)) <= MAX_LON) & (F.abs(F.get(p, 1)) <= MAX_LAT), F.lit(False)))
    return F.when((F.length(code) > 0) & zoom.between(*ZOOMS) & F.size(points).between(*VERTICES) & good, F.struct(zoom.alias("zoom"), _ring(points).alias("ring")))


def _degrees(written, most: float) -> Column:
    """A plain decimal number, without sign +, exponent or bare point, of at most so many degrees."""
    plain = (F.translate(written, "0123456789", "").isin("", "-", ".", "-.")) & (F.instr(written, "-") <= 1) & ~F.ltrim(written, F.lit("-")).startswith(".") & ~written.endswith(".")
    value = F.when(plain, written.try_cast("double"))
    return F.when(F.abs(value) <= most, value)


def place_of(text) -> Column:
    """(lon, lat) of a latitude and a longitude with a comma or blanks between them, as typed in a search; null for anything else and beyond 85 and 180 degrees."""
    parts = F.filter(F.split(F.translate(F.trim(text), ",\t\n\r", "    "), " "), lambda p: p != "")
    lat, lon = _degrees(F.get(parts, 0), 85), _degrees(F.get(parts, 1), 180)
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), _corner(lon, lat))


def valid_template(text) -> Column:
    """The trimmed address of a tile server, if it is https and names zoom, column and row."""
    t = F.trim(text)
    return F.when(t.rlike("(?i)^https://") & t.contains("{z}") & t.contains("{x}") & t.contains("{y}"), t)


def rectangle(lon, lat, width, height) -> Column:
    """A ring of so many metres around a point, SW, SE, NE, NW."""
    up = height / 2 / 111320.0
    side = width / 2 / (111320.0 * F.cos(F.radians(lat)))
    return F.array(_corner(lon - side, lat - up), _corner(lon + side, lat - up), _corner(lon + side, lat + up), _corner(lon - side, lat + up))


# Places for a first scan, (name, lat, lon), each the middle of a rectangle of 900 x 700 metres.
PLACES = (("Vilamoura · PT", 37.0745, -8.1155), ("Scottsdale · US", 33.594, -111.926), ("Marbella · ES", 36.4899, -4.9587), ("Palm Springs · US", 33.8303, -116.5453))


def demo_areas(spark: SparkSession) -> DataFrame:
    """(name, ring) of the places for a first scan."""
    rows = spark.createDataFrame(list(PLACES), "name string, lat double, lon double")
    return rows.select("name", rectangle(F.col("lon"), F.col("lat"), F.lit(900), F.lit(700)).alias("ring"))
