"""The library's queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.functions import geo, text
from cerulea.functions.color import confidence, hsv, is_strict
from cerulea.operators import calibrate, dated, detect, diff, outline, raster
from cerulea.plans import areas, cover
from cerulea.sinks import exports, mosaic
from cerulea.sinks.shared import shared_folder, stored
from cerulea.sinks.tiles import keep_tiles
from cerulea.sources import area, images, scene
from cerulea.streaming.feed import latest

ZOOMS = (3, 14, 19)
RING = [(-8.020, 37.080), (-7.990, 37.083), (-7.995, 37.105), (-8.015, 37.100)]
PLAN_ZOOM = 16


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def geo_world_px(spark, sf_dir):
    p, z = scene.points(spark, sf_dir), F.lit(19)
    return p.select("event_id", F.round(geo.world_x(F.col("lon"), z), 3).alias("wx"), F.round(geo.world_y(F.col("lat"), z), 3).alias("wy"))


def geo_tile_of(spark, sf_dir):
    p, z = scene.points(spark, sf_dir), F.lit(19)
    return p.select("event_id", geo.tile_of(geo.world_x(F.col("lon"), z), z).alias("tx"), geo.tile_of(geo.world_y(F.col("lat"), z), z).alias("ty"))


def geo_tile_bbox(spark, sf_dir):
    t, z = geo_tile_of(spark, sf_dir), F.lit(19)
    return t.select("event_id", *[F.round(c, 9).alias(n) for n, c in geo.tile_bounds(F.col("tx"), F.col("ty"), z).items()])


def geo_mpp(spark, sf_dir):
    return scene.points(spark, sf_dir).select("event_id", *[F.round(geo.metres_per_pixel(F.col("lat"), F.lit(z)), 6).alias(f"mpp{z}") for z in ZOOMS])


def geo_px_to_lonlat(spark, sf_dir):
    t, z = geo_tile_of(spark, sf_dir), F.lit(19)
    px, py = F.col("event_id") % 257, F.col("event_id") % 129
    return t.select("event_id", F.round(geo.lon_of(F.col("tx") * 256 + px, z), 9).alias("lon"), F.round(geo.lat_of(F.col("ty") * 256 + py, z), 9).alias("lat"))


def geo_tile_histogram(spark, sf_dir):
    p, z = scene.points(spark, sf_dir), F.lit(3)
    return p.groupBy(geo.tile_of(geo.world_x(F.col("lon"), z), z).alias("tx"), geo.tile_of(geo.world_y(F.col("lat"), z), z).alias("ty")).agg(F.count("*").alias("n"))


def _near(spark, sf_dir):
    """Points in a box around the ring."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", (-8.03 + F.lit(0.05) * ((e * 7919) % 1009) / 1009).alias("lon"), (37.07 + F.lit(0.04) * ((e * 104729) % 1013) / 1013).alias("lat"))


def point_in_ring(spark, sf_dir):
    return _near(spark, sf_dir).select("event_id", geo.in_ring(F.col("lon"), F.col("lat"), RING).alias("inside"))


def bbox_expand(spark, sf_dir):
    p = scene.points(spark, sf_dir)
    grown = geo.expanded(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"), F.lit(111.32))
    return p.select("event_id", *[F.round(c, 9).alias(n) for n, c in grown.items()])


def ring_area(spark, sf_dir):
    p = _near(spark, sf_dir)
    step = 0.001
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    rings = p.select("event_id", F.array(corner(0, 0), corner(step, 0), corner(step, step), corner(0, step)).alias("ring"))
    return rings.select("event_id", F.round(geo.ring_area("ring"), 3).alias("area"), F.round(F.array_min(F.transform("ring", lambda q: q["lon"])), 9).alias("west"), F.round(F.array_max(F.transform("ring", lambda q: q["lat"])), 9).alias("north"))


def plan_cover(spark, sf_dir):
    return cover.cover(spark, RING, PLAN_ZOOM)


def plan_serpentine(spark, sf_dir):
    return cover.serpentine(cover.cover(spark, RING, PLAN_ZOOM), cover.box_of(RING, PLAN_ZOOM)[2]).select("tx", "ty", F.col("idx").cast("long").alias("idx"))


def plan_spiral(spark, sf_dir):
    box = cover.box_of(RING, PLAN_ZOOM)
    middle = [int((box[k] + box[k + 1]) / 2 + 0.5) for k in (0, 2)]
    return cover.spiral(cover.cover(spark, RING, PLAN_ZOOM), *middle).select("tx", "ty", F.col("idx").cast("long").alias("idx"))


def plan_estimate(spark, sf_dir):
    return cover.cover(spark, RING, PLAN_ZOOM).agg(F.count("*").alias("tiles"))


def scene_pixels(spark, sf_dir):
    return scene.supplier_pixels(spark, sf_dir)


def px_hsv(spark, sf_dir):
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    return scene.supplier_pixels(spark, sf_dir).groupBy("r", "g", "b").agg(F.count("*").alias("n")).select("r", "g", "b", "n", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"))


def px_water_mask(spark, sf_dir):
    return raster.water_mask(scene.supplier_pixels(spark, sf_dir))


def px_strict_ratio(spark, sf_dir):
    rows = raster.with_hsv(scene.supplier_pixels(spark, sf_dir)).where(raster.is_water(F.col("r"), F.col("g"), F.col("b"), F.lit(255), F.col("h"), F.col("s"), F.col("v")))
    return rows.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum(is_strict(F.col("h").cast("float"), F.col("s").cast("float")).cast("long")).alias("strict"))


def _per_tile(op, spark, sf_dir):
    return op(px_water_mask(spark, sf_dir)).select(*raster.PIXEL)


def _labels(spark, sf_dir):
    return raster.components(raster.clean(px_water_mask(spark, sf_dir)))


def components(spark, sf_dir):
    return _labels(spark, sf_dir)


def component_stats(spark, sf_dir):
    return raster.component_stats(_labels(spark, sf_dir), scene.supplier_pixels(spark, sf_dir))


def component_texture(spark, sf_dir):
    return raster.component_texture(_labels(spark, sf_dir), scene.supplier_pixels(spark, sf_dir))


def _fragments(spark, sf_dir):
    return detect.fragments(raster.tile_components(scene.supplier_pixels(spark, sf_dir)))


def fragments(spark, sf_dir):
    return _fragments(spark, sf_dir).select("frag", "pixels", F.round("area", 4).alias("area"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "fill", "texture", "strict", "n", "e", "s", "w")


def thumb_boxes(spark, sf_dir):
    return detect.crop_boxes(_fragments(spark, sf_dir)).select("frag", "x0", "y0", "width", "height")


def thumb_images(spark, sf_dir):
    """The picture of each fragment: its size in bytes and its digest."""
    images = exports.thumbnails(_fragments(spark, sf_dir), scene.supplier_pixels(spark, sf_dir))
    return images.select("frag", F.length("png").cast("long").alias("bytes"), F.sha2("png", 256).alias("sha256"))


def mosaic_images(spark, sf_dir):
    """The annotated picture of each block of 4 x 4 tiles: its size in bytes and its digest."""
    images = mosaic.mosaics(scene.supplier_pixels(spark, sf_dir), _fragments(spark, sf_dir))
    return images.select("bx", "by", F.length("png").cast("long").alias("bytes"), F.sha2("png", 256).alias("sha256"))


TEMPLATE = "https://tiles.example/{z}/{y}/{x}"


def kept_tiles(spark, sf_dir):
    """The scene's tiles written as image files under their cache names and read back, but for each third column: pixels and sums of their colours."""
    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    drawn = exports.tile_images(scene.supplier_pixels(spark, sf_dir)).withColumn("z", F.lit(scene.ZOOM))
    keep_tiles(drawn, folder, TEMPLATE)
    sums = [F.sum(c).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))]
    return images.kept_pixels(spark, folder, TEMPLATE, "tx % 3 <> 0").groupBy("z", "tx", "ty").agg(F.count("*").alias("pixels"), *sums)


def merge_pairs(spark, sf_dir):
    return detect.merge_pairs(_fragments(spark, sf_dir))


def _looked_at(spark, sf_dir):
    """Fragments of the scene, stored, and its tiles: all that anything was painted on were looked at, with water or without."""
    pixels = scene.supplier_pixels(spark, sf_dir)
    frags = stored(detect.fragments(raster.tile_components(pixels)), "fragments")
    return frags, scene.supplier_tiles(spark, sf_dir)


def _merged(spark, sf_dir):
    frags, scanned = _looked_at(spark, sf_dir)
    return detect.merged(frags, detect.clusters(frags, detect.merge_pairs(frags)), scanned)


_BOX = ("west", "south", "east", "north")


def merged_detections(spark, sf_dir):
    return _merged(spark, sf_dir).drop("main", *_BOX)


def open_water(spark, sf_dir):
    return _merged(spark, sf_dir).agg(F.count(F.when(F.col("open_water"), 1)).alias("suppressed"), F.count(F.when(F.col("shown"), 1)).alias("shown"))


def rank_all(spark, sf_dir):
    return detect.ranked(_merged(spark, sf_dir).where("shown")).select("rank", "cluster", "kind", "area", "confidence", "truncated", "lon", "lat", "pixels")


def rank_visible(spark, sf_dir):
    return detect.ranked(_merged(spark, sf_dir).where(F.col("shown") & (F.col("confidence") >= detect.Limits().shown))).select("rank", "cluster", "area", "confidence")


def top_k(spark, sf_dir):
    return detect.top(_merged(spark, sf_dir).where("shown"), 25).select("rank", "cluster", "kind", "area", "confidence", "truncated", "lon", "lat", "pixels")


def csv_rows(spark, sf_dir):
    line = text.csv_line(*[F.col(c) for c in ("rank", "cluster", "kind", "lat", "lon", "area", "confidence", "truncated")])
    return rank_all(spark, sf_dir).select("rank", line.alias("line"))


def boundary_sides(spark, sf_dir):
    return outline.boundary_sides(_labels(spark, sf_dir))


def outline_rings(spark, sf_dir):
    """Outer rings before and after simplifying, with the plane area of each."""
    labels = _labels(spark, sf_dir)
    sides = [outline.outlines(labels, e).select(*raster.TILE_KEY, "label", F.size("ring").alias(f"{n}_corners"), F.round(outline.shoelace("ring"), 3).alias(f"{n}_area"), F.to_json("ring").alias(f"{n}_ring")) for n, e in (("full", 0), ("simple", outline.EPSILON))]
    return sides[0].join(sides[1].hint("merge"), [*raster.TILE_KEY, "label"])


def truncation(spark, sf_dir):
    return detect.truncated(*_looked_at(spark, sf_dir))


def geojson_rows(spark, sf_dir):
    """A feature for each ranked detection, with the simplified ring of each of its fragments."""
    frags, scanned = _looked_at(spark, sf_dir)
    named = stored(detect.clusters(frags, detect.merge_pairs(frags)), "named")
    found = detect.ranked(detect.merged(frags, named, scanned).where("shown"))
    return exports.features(found, outline.rings_of(raster.tile_labels(scene.supplier_pixels(spark, sf_dir)), frags, named))


def _scanned(spark, sf_dir):
    """Detections of the scene with the lake, where tiles without water were scanned too and some with water were not."""
    return detect.detections(*scene.scanned_scene(spark, sf_dir))


def scan_detections(spark, sf_dir):
    return _scanned(spark, sf_dir).select("cluster", "pixels", "area", "parts", "tiles", "confidence", "kind", "truncated", "open_water", "shown", *[F.round(c, 9).alias(c) for c in _BOX])


def scan_ranking(spark, sf_dir):
    return detect.ranked(_scanned(spark, sf_dir).where("shown")).select("rank", "cluster", "area", "confidence")


def scan_totals(spark, sf_dir):
    """How many are visible, with and without hot tubs, their area, and how many bodies of open water were left out."""
    found = stored(_scanned(spark, sf_dir), "found")
    many, few = detect.totals(detect.visible(found)), detect.totals(detect.visible(found, hot_tubs=False)).toDF("n_pools", "area_pools")
    return many.crossJoin(few).crossJoin(found.agg(F.count(F.when(F.col("open_water"), 1)).alias("suppressed")))  # three single rows


def scan_stats(spark, sf_dir):
    """Tiles scanned, with and without water, and the area swept."""
    pixels, scanned = scene.scanned_scene(spark, sf_dir)
    wet = raster.water_mask(pixels).select("tx", "ty").distinct().withColumn("wet", F.lit(1))
    z = F.lit(scene.ZOOM)
    side = 256 * geo.metres_per_pixel(geo.lat_of((F.col("ty") + 0.5) * 256, z), z)
    return scanned.join(wet, ["tx", "ty"], "left").agg(F.count("*").alias("tiles"), F.count("wet").alias("wet"), F.count(F.when(F.col("wet").isNull(), 1)).alias("empty"), F.round(F.sum(side * side), 1).alias("swept_m2"))


ESTIMATE_ZOOMS = (14, 17, 22)


def plan_estimates(spark, sf_dir):
    """The estimate at three zooms; at the last the box is too large to count."""
    rows = [cover.estimate(spark, RING, z).select(F.lit(z).alias("zoom"), "tiles", "approximate") for z in ESTIMATE_ZOOMS]
    return rows[0].union(rows[1]).union(rows[2])


def plan_grid(spark, sf_dir):
    """4 x 4 tiles around each point."""
    return cover.grid(scene.points(spark, sf_dir), 4, 14).select("event_id", "tx", "ty")


def area_rectangles(spark, sf_dir):
    """A rectangle of 900 x 700 metres around each point near the ring, and the places for a first scan."""
    ring = area.rectangle(F.col("lon"), F.col("lat"), F.lit(900), F.lit(700))
    rows = _near(spark, sf_dir).select(F.col("event_id").cast("string").alias("name"), ring.alias("ring")).union(area.demo_areas(spark))
    return rows.select("name", *[F.round(F.get("ring", F.lit(k))[c], 9).alias(f"{c}{k}") for k in (0, 2) for c in ("lon", "lat")], F.round(geo.ring_area("ring"), 1).alias("area"))


AREA_ZOOM = 16
#: Eight ways around a centre, for rings that never cross themselves.
AREA_WAYS = ((4, 0), (3, 3), (0, 4), (-3, 3), (-4, 0), (-3, -3), (0, -4), (3, -3))


def _areas(spark, sf_dir):
    """(area, ring): a star of eight corners for each customer, each 97th one twenty times as wide."""
    k = F.col("c_custkey")
    lon, lat = -8.5 + F.lit(0.9) * ((k * 7919) % 1009) / 1009, 36.9 + F.lit(0.4) * ((k * 104729) % 1013) / 1013
    size = F.when(k % 97 == 0, 0.01).otherwise(0.0005)
    corners = [F.struct((lon + dx * ((k * (i + 3)) % 5 + 1) * size).alias("lon"), (lat + dy * ((k * (i + 3)) % 5 + 1) * size).alias("lat")) for i, (dx, dy) in enumerate(AREA_WAYS)]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("area"), F.array(*corners).alias("ring"))


def areas_cover(spark, sf_dir):
    """The tiles of each customer's ring, by quadtree descent."""
    return areas.cover(_areas(spark, sf_dir), AREA_ZOOM).select("area", "tx", "ty")


def areas_estimate(spark, sf_dir):
    """Tiles of each ring at a zoom where the boxes of the wide ones are too large to count."""
    return areas.estimates(_areas(spark, sf_dir), AREA_ZOOM + 2)


def areas_orders(spark, sf_dir):
    """Three orders of visit of each area's tiles."""
    return areas.orders(_areas(spark, sf_dir), AREA_ZOOM)


def areas_points(spark, sf_dir):
    """How many points lie in each area that has any."""
    e = F.col("event_id")
    points = _events(spark, sf_dir).select((-8.5 + F.lit(0.9) * ((e * 15485863) % 100003) / 100003).alias("lon"), (36.9 + F.lit(0.4) * ((e * 32452843) % 100019) / 100019).alias("lat"))
    return areas.point_counts(points, _areas(spark, sf_dir), AREA_ZOOM)


def ring_bbox(spark, sf_dir):
    r = _areas(spark, sf_dir)
    return r.select("area", *[F.round(f(c), 9).alias(n) for n, f, c in (("west", F.array_min, "ring.lon"), ("south", F.array_min, "ring.lat"), ("east", F.array_max, "ring.lon"), ("north", F.array_max, "ring.lat"))])


def bbox_intersects_ring(spark, sf_dir):
    """Whether a box beside the first corner of each ring touches it."""
    first = F.get("ring", F.lit(0))
    shift, wide = (F.col("area") % 7 - 3).cast("double") * 0.0007, (F.col("area") % 3 + 1).cast("double") * 0.0004
    box = {"west": first["lon"] + shift, "south": first["lat"] - shift, "east": first["lon"] + shift + wide, "north": first["lat"] - shift + wide}
    rows = _areas(spark, sf_dir).select("area", geo.sides_of("ring").alias("sides"), *[c.alias(n) for n, c in box.items()])
    held = {n: F.col(n) for n in box}
    return rows.select("area", (F.exists("sides", lambda s: geo.side_meets(s, held)) | geo.in_sides(F.col("west"), F.col("south"), F.col("sides"))).alias("meets"))


def scan_diff(spark, sf_dir):
    """Two scans of a dense place, of which each lacks some detections and the second has moved all by up to a few metres."""
    e = F.col("event_id")
    lon, lat = -8.03 + F.lit(0.01) * ((e * 7919) % 1009) / 1009, 37.07 + F.lit(0.04) * ((e * 104729) % 1013) / 1013
    before = _events(spark, sf_dir).where(e % 5 != 0).select(e.alias("cluster"), lon.alias("lon"), lat.alias("lat"))
    after = _events(spark, sf_dir).where(e % 7 != 0).select((e + 1_000_000).alias("cluster"), (lon + ((e * 31) % 13 - 6) * 0.000004).alias("lon"), (lat + ((e * 17) % 11 - 5) * 0.000004).alias("lat"))
    return diff.scan_diff(before, after).select("op", "before", "after", F.round("metres", 3).alias("metres"))


def dated_imagery(spark, sf_dir):
    """Each tenth order is a release of its customer's tile, the others are scans: the release that each scan saw."""
    at = F.unix_timestamp("o_orderdate")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("tx"), (F.col("o_custkey") % 3).alias("ty"), at.alias("taken"))
    releases = rows.where("id % 10 = 0").withColumnRenamed("id", "release")
    return dated.as_of(rows.where("id % 10 <> 0"), releases, ["tx", "ty"], "taken").select("id", "tx", "ty", "taken", "release", "released_at")


#: What the confidence is made of.
MEASURES = ["strict", "hue", "saturation", "texture", "fill", "size"]


def judged(spark, sf_dir):
    """Made-up measures of detections, and whether somebody found them to be right."""
    n = F.col("event_id")
    part = lambda m: (n % m).cast("double") / m
    rows = _events(spark, sf_dir).select("event_id", part(11).alias("strict"), part(67).alias("hue"), part(13).alias("saturation"), part(17).alias("texture"), part(19).alias("fill"), part(101).alias("size"))
    chance = 0.15 + 0.4 * F.col("strict") + 0.2 * F.col("fill") - 0.15 * F.col("texture") + 0.1 * F.col("saturation")
    return rows.withColumn("label", ((n * 7919) % 1000 / 1000 < chance).cast("int"))


def calibration(spark, sf_dir):
    """The weights of the confidence that the judgements ask for, and how often each level of the calibrated confidence was right."""
    rows = judged(spark, sf_dir)
    sure = calibrate.calibrated(rows, MEASURES, calibrate.fitted(rows, MEASURES))
    return sure.groupBy(F.floor(F.col("calibrated") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("right"), F.round(F.avg("calibrated"), 3).alias("calibrated"))


def fmt_labels(spark, sf_dir):
    p, n = scene.points(spark, sf_dir), F.col("event_id")
    steps = text.progress(n % 10, F.lit(10), (n % 97).cast("double"))
    return p.select("event_id", text.place_label(F.col("lat"), F.col("lon")).alias("place"), text.count_label(n * 7919).alias("count"), text.dims_label((n % 400).cast("double") + 3).alias("dims"), F.round(steps["share"], 6).alias("share"), F.round(steps["left"], 6).alias("left"))


def cache_keys(spark, sf_dir):
    url = text.tile_url(TEMPLATE, F.lit(19), F.col("tx"), F.col("ty"))
    return geo_tile_of(spark, sf_dir).select("event_id", text.cache_key(F.lit(19), F.col("tx"), F.col("ty"), url).alias("file"))


def color_confidence(spark, sf_dir):
    """The confidence of made-up measures that reach each branch."""
    n = F.col("event_id")
    part = lambda m: (n % m).cast("double") / m
    sure = confidence(part(11), part(67) * 100 + 130, part(13), part(17) * 0.2, part(19), part(101) * 900 + 1, n % 2 == 0)
    return _events(spark, sf_dir).select("event_id", sure.alias("confidence"))


def aoi_bbox(spark, sf_dir):
    e = F.col("event_id")
    written = F.concat_ws(",", (e % 80).cast("string"), F.concat(F.lit(" "), (e % 170).cast("string")), F.when(e % 11 == 0, "x").otherwise((e % 80 + 1).cast("string")), (e % 170 + 2).cast("string"))
    ring = area.ring_of_bbox(written)
    return _events(spark, sf_dir).select("event_id", ring.alias("ring")).where(F.col("ring").isNotNull()).select("event_id", F.array_min("ring.lon").alias("west"), F.array_min("ring.lat").alias("south"), F.array_max("ring.lon").alias("east"), F.array_max("ring.lat").alias("north"))


def aoi_permalink(spark, sf_dir):
    """A triangle beside each point as a link, and its first corner read back; zooms 21 and 22 are refused."""
    lon, lat = F.col("lon"), F.col("lat")
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(corner(lon, lat), corner(lon + 0.01, lat), corner(lon, lat + 0.01))
    links = _near(spark, sf_dir).select("event_id", area.permalink(ring, F.col("event_id") % 13 + 10).alias("link"))
    back = links.select("event_id", "link", area.ring_of_permalink(F.col("link")).alias("read"))
    return back.select("event_id", "link", F.col("read.zoom").cast("long").alias("zoom"), F.get("read.ring", F.lit(0))["lon"].alias("lon"), F.get("read.ring", F.lit(0))["lat"].alias("lat"))


def segments_intersect(spark, sf_dir):
    """Segments on a small lattice against one diagonal, so that touching and lying along it occur."""
    e = F.col("event_id")
    ends = [(e % n % 7).cast("double") for n in (11, 13, 17, 19)]
    return _events(spark, sf_dir).select("event_id", geo.segments_meet((ends[0], ends[1]), (ends[2], ends[3]), (1, 1), (5, 5)).alias("meet"))


def fmt_area(spark, sf_dir):
    size = (F.col("event_id") * 7919 % 4000037).cast("double") / 4 + 0.03
    return _events(spark, sf_dir).select("event_id", text.area_label(size).alias("label"))


def fmt_map_links(spark, sf_dir):
    return scene.points(spark, sf_dir).select("event_id", text.bing_link(F.col("lat"), F.col("lon")).alias("bing"), text.osm_link(F.col("lat"), F.col("lon")).alias("osm"))


def event_log_latest(spark, sf_dir):
    op = F.when(F.col("event_id") % 7 == 0, "remove").when(F.col("event_id") % 3 == 0, "update").otherwise("add")
    log = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "value")
    return latest(log).select("id", "seq", "op", F.round("value", 6).alias("value"))


def coverage_stats(spark, sf_dir):
    tiles = scene.supplier_pixels(spark, sf_dir).select("tx", "ty").distinct()
    z = F.lit(scene.ZOOM)
    side = 256 * geo.metres_per_pixel(geo.lat_of((F.col("ty") + 0.5) * 256, z), z)
    return tiles.agg(F.count("*").alias("tiles"), F.round(F.sum(side * side), 1).alias("swept_m2"))


def fmt_links(spark, sf_dir):
    url = text.tile_url(TEMPLATE, F.lit(19), F.col("tx"), F.col("ty"))
    return geo_tile_of(spark, sf_dir).select("event_id", url.alias("url"), text.duration_label(F.col("event_id")).alias("duration"))


QUERIES = {f.__name__: f for f in (geo_world_px, geo_tile_of, geo_tile_bbox, geo_mpp, geo_px_to_lonlat, geo_tile_histogram, point_in_ring, bbox_expand, ring_area, plan_cover, plan_serpentine, plan_spiral, plan_estimate, scene_pixels, px_hsv, px_water_mask, px_strict_ratio, components, component_stats, component_texture, fragments, merge_pairs, merged_detections, open_water, rank_all, rank_visible, top_k, csv_rows, event_log_latest, coverage_stats, fmt_links, boundary_sides, outline_rings, truncation, geojson_rows, aoi_bbox, aoi_permalink, segments_intersect, fmt_area, fmt_map_links, scan_detections, scan_ranking, scan_totals, scan_stats, plan_estimates, plan_grid, area_rectangles, fmt_labels, cache_keys, color_confidence, thumb_boxes, thumb_images, areas_cover, areas_estimate, areas_orders, areas_points, ring_bbox, bbox_intersects_ring, scan_diff, dated_imagery, calibration, mosaic_images, kept_tiles)}
QUERIES |= {f"mask_{op.__name__}": partial(_per_tile, op) for op in (raster.erode, raster.dilate, raster.clean)}
