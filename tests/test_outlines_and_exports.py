"""Outlines, areas from text, image tiles, exports and the archive on tiny tables."""

import base64
import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from cerulea.operators import detect, outline, raster
from cerulea.sinks import archive, exports, mosaic
from cerulea.sources import area, scene
from cerulea.sources.images import failed_images, image_pixels


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def labelled(rows):
    at = [(x, y, int(c)) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."]
    return tuple(np.array(v) for v in zip(*at, strict=True))


def area_of(ring):
    x, y = ring[:, 0], ring[:, 1]
    return (x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def test_rings_of_small_shapes():
    for rows, corners, size in ((["1"], 4, 1), (["11", "11"], 4, 4), (["1.", "1.", "11"], 6, 4), (["111", "1.1", "111"], 4, 9), (["1.", ".1"], 8, 2), (["112", "222"], 4, 2)):
        ring = outline.outer_rings(*labelled(rows))[1]
        assert len(ring) == corners and area_of(ring) == size, rows


def test_outer_rings_hold_their_shape_and_its_holes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        held = rng.random((9, 9)) < 0.6
        seen, stack = np.zeros((11, 11), bool), [(0, 0)]
        wide = np.pad(held, 1)
        while stack:  # the outside, over sides only: shapes are joined over corners
            y, x = stack.pop()
            if 0 <= y < 11 and 0 <= x < 11 and not seen[y, x] and not wide[y, x]:
                seen[y, x] = True
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        y, x = np.nonzero(held)
        label = np.zeros((9, 9), int)
        n = 0
        for a, b in zip(y, x, strict=True):
            if not label[a, b]:
                n, stack = n + 1, [(a, b)]
                while stack:
                    p, q = stack.pop()
                    if 0 <= p < 9 and 0 <= q < 9 and held[p, q] and not label[p, q]:
                        label[p, q] = n
                        stack += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        rings = outline.outer_rings(x, y, label[y, x])
        for k, ring in rings.items():
            own = np.pad(label == k, 1)
            out, stack = np.zeros((11, 11), bool), [(0, 0)]
            while stack:
                p, q = stack.pop()
                if 0 <= p < 11 and 0 <= q < 11 and not out[p, q] and not own[p, q]:
                    out[p, q] = True
                    stack += [(p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)]
            assert area_of(ring) == (~out).sum()


def test_simplifying():
    square = np.array([(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (5, 10), (0, 10), (0, 5)])
    assert len(outline.simplified(square, 0.5)) == 4 and len(outline.simplified(square, 0)) == 8
    assert len(outline.simplified(square[::2], 99)) == 4


def test_boundary_sides_and_rings_in_tiles(spark):
    x, y, label = labelled(["11.2", "11.2"])
    rows = spark.createDataFrame([(3, 4, int(a), int(b), int(c)) for a, b, c in zip(x, y, label, strict=True)], "tx int, ty int, px int, py int, label int")
    assert {tuple(r) for r in outline.boundary_sides(rows).collect()} == {(3, 4, 1, 2, 2, 2, 2), (3, 4, 2, 1, 2, 1, 2)}
    assert {(r.label, r.a) for r in outline.outlines(rows).select("label", outline.shoelace("ring").alias("a")).collect()} == {(1, 4.0), (2, 2.0)}
    assert outline.outlines(rows.limit(0)).count() == 0 and outline.boundary_sides(rows.limit(0)).count() == 0


def test_areas_from_text(spark):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]], [[9, 9]]]
    shapes = [{"type": "Polygon", "coordinates": square}, {"type": "MultiPolygon", "coordinates": [square, square]}]
    shapes += [{"type": "Feature", "geometry": shapes[0]}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": shapes[1]}, {}]}]
    for s in shapes:
        assert [tuple(p) for p in one(spark, area.ring_of_geojson(F.lit(json.dumps(s))))[0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    for bad in ('{"type": "Point", "coordinates": [1, 2]}', "no json", None):
        assert one(spark, area.ring_of_geojson(F.lit(bad).cast("string")))[0] is None
    assert [tuple(p) for p in one(spark, area.ring_of_bbox(F.lit("1, 2,3,4")))[0]] == [(2, 1), (4, 1), (4, 3), (2, 3)]
    for bad in ("1,2,3", "1,2,3,x", "1,2,3,NaN", "", "1,2,3,4,5"):
        assert one(spark, area.ring_of_bbox(F.lit(bad)))[0] is None
    assert tuple(one(spark, area.place_of(F.lit(" 37.1, -8.02 ")))[0]) == (-8.02, 37.1) and one(spark, area.place_of(F.lit("91, 3")))[0] is None and one(spark, area.place_of(F.lit("Faro")))[0] is None
    found = one(spark, *[area.valid_template(F.lit(t)) for t in (" HTTPS://a/{z}/{x}/{y} ", "http://a/{z}/{x}/{y}", "https://a/{z}/{x}")])
    assert tuple(found) == ("HTTPS://a/{z}/{x}/{y}", None, None)


def test_permalinks(spark):
    def link(zoom, points):
        return "#aoi=" + base64.urlsafe_b64encode(json.dumps([zoom, points], separators=(",", ":")).encode()).decode().rstrip("=")

    points = [[-8.017201, 37.0894], [-8, 37.1], [0.000001, -0.5]]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])
    made, read = one(spark, area.permalink(ring, F.lit(17)), area.ring_of_permalink(F.lit(link(17, points))))
    assert json.loads(base64.urlsafe_b64decode(made[5:] + "==")) == [17, points] and read.zoom == 17 and [list(p) for p in read.ring] == points
    bad = [link(9, points), link(17, points[:2]), link(17, points * 70), link(17, [[181, 0], *points]), link(17, [[0, 85.07], *points]), link(17, [[1], *points]), "#aoi=%%", "#aoi=AAAA", "", link(17, "x")]
    assert all(one(spark, area.ring_of_permalink(F.lit(b)))[0] is None for b in bad)


def test_images_round_trip(spark, tmp_path):
    pixels = spark.createDataFrame([(5, 6, 10, 20, 1, 2, 3), (5, 6, 255, 255, 45, 170, 190)], "tx int, ty int, px int, py int, r int, g int, b int")
    tile = exports.tile_images(pixels).first()
    folder = tmp_path / "z=19/x=5/y=6"
    folder.mkdir(parents=True)
    (folder / "tile.png").write_bytes(tile.png)
    (folder / "broken.png").write_bytes(b"no image")
    rows = image_pixels(spark, str(tmp_path))
    assert rows.count() == raster.SIDE**2
    drawn = {tuple(r) for r in rows.where("not (r = 120 and g = 118 and b = 115)").collect()}
    assert drawn == {(19, 5, 6, 10, 20, 1, 2, 3, 255), (19, 5, 6, 255, 255, 45, 170, 190, 255)}


def ranked(spark):
    rows = [(k + 1, f"c{k}", "pool", 100.0 - k, 0.9, k == 1, -8.0 + k, 37.0) for k in range(30)]
    return spark.createDataFrame(rows, "rank int, cluster string, kind string, area double, confidence double, truncated boolean, lon double, lat double")


def test_geojson_and_csv_files(spark, tmp_path):
    parts = spark.createDataFrame([("c0", "b", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("c0", "a", [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)])], "cluster string, frag string, ring array<struct<lon: double, lat: double>>")
    exports.write_geojson(exports.features(ranked(spark), parts), str(tmp_path / "g"), zoom=19)
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))))
    assert whole["zoom"] == 19 and [f["properties"]["rank"] for f in whole["features"]] == list(range(1, 31))
    first = whole["features"][0]
    assert first["geometry"]["coordinates"] == [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[0, 0], [1, 0], [1, 1], [0, 0]]]]
    assert first["properties"] == {"id": "c0", "rank": 1, "kind": "pool", "area_m2": 100, "confidence": 0.9, "lat": 37, "lon": -8, "truncated": False}
    exports.write_geojson(exports.features(ranked(spark).limit(0), parts), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*"))))["features"] == []
    exports.write_csv(ranked(spark), str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).splitlines()
    assert lines[0].startswith("rank,id") and len(lines) == 31 and lines[30].startswith("30,c29,pool,37.000000,21.000000,71.0,")


def test_thumbnails_and_map_features(spark, tmp_path):
    frags = spark.createDataFrame([("a", 5, 6, 10, 20, 12, 21), ("b", 5, 6, 0, 0, 255, 255), ("c", 5, 6, 250, 3, 255, 4), ("d", 9, 9, 1, 1, 2, 2)], "frag string, tx int, ty int, min_px int, min_py int, max_px int, max_py int")
    boxes = {r.frag: (r.x0, r.y0, r.width, r.height) for r in detect.crop_boxes(frags).collect()}
    assert boxes == {"a": (4, 14, 15, 14), "b": (0, 0, 120, 120), "c": (244, 0, 12, 11), "d": (0, 0, 9, 9)}
    pixels = spark.createDataFrame([(5, 6, 10, 20, 1, 2, 3), (7, 7, 0, 0, 1, 2, 3)], "tx int, ty int, px int, py int, r int, g int, b int")
    thumbs = exports.thumbnails(frags, pixels)
    shown = {r.frag: r.png for r in thumbs.collect()}
    assert {k: tuple(int.from_bytes(v[n : n + 4], "big") for n in (16, 20)) for k, v in shown.items()} == {k: v[2:] for k, v in boxes.items()}
    image = np.full((14, 15, 3), raster.BACKGROUND, np.uint8)
    image[6, 6] = 1, 2, 3
    assert shown["a"] == exports.png(image)
    found = spark.createDataFrame([("a",), ("z",)], "main string")
    assert {r.main: r.png is None for r in exports.with_thumbnails(found, thumbs).collect()} == {"a": False, "z": True}
    assert exports.thumbnails(frags.limit(0), pixels).count() == 0
    tiles = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "tx int, ty int")
    exports.write_geojson(exports.tile_features(tiles, 1), str(tmp_path / "t"))
    grid = json.loads("".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))))["features"]
    assert [f["properties"] for f in grid] == [{"tx": 0, "ty": 0}, {"tx": 1, "ty": 0}]
    assert np.allclose(grid[0]["geometry"]["coordinates"], [[(-180, 85.0511288), (0, 85.0511288), (0, 0), (-180, 0), (-180, 85.0511288)]], atol=1e-6)
    assert [json.loads(r.line)["geometry"]["coordinates"] for r in exports.markers(ranked(spark), 2).orderBy("rank").collect()] == [[-8, 37], [-7, 37]]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1))])
    row = spark.range(1).select(exports.area_feature(ring), exports.area_feature(F.lit(None).cast("array<struct<lon:double,lat:double>>"))).first()
    assert json.loads(row[0])["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]] and row[1] is None


def test_archive(spark, tmp_path):
    folder = str(tmp_path)
    for at, scan in enumerate(("a", "b", "a", "c")):
        archive.save(ranked(spark).limit(at), folder, scan, at, f"scan {scan}", 19)
    archive.remove(spark, folder, "c", 9)
    assert [(r.id, r.seq, r.pools) for r in archive.listed(spark, folder).collect()] == [("a", 2, 2), ("b", 1, 1)]
    assert archive.load(spark, folder, "a").count() == 2 and archive.load(spark, folder, "c") is None and archive.listed(spark, folder, 1).count() == 1


def test_scans_and_zooms_keep_their_outlines_and_images(spark):
    """Two scans and two zooms with a pool each in the tile of one number."""
    rows = [(scan, z, 250400, 201560, x + dx, 40 + dy, 45, 170, 190) for scan, z, x in (("a", 19, 20), ("b", 19, 90), ("a", 18, 160)) for dx in range(20) for dy in range(12)]
    pixels = spark.createDataFrame(rows, "scan string, z int, tx int, ty int, px int, py int, r int, g int, b int")
    labels = raster.tile_labels(pixels)
    rings = {(r.scan, r.z): (r.tx, r.ty, r.label, min(p.x for p in r.ring)) for r in outline.outlines(labels, 0).collect()}
    assert rings == {("a", 19): (250400, 201560, 1, 20.0), ("b", 19): (250400, 201560, 1, 90.0), ("a", 18): (250400, 201560, 1, 160.0)}
    sides = {(r.scan, r.z): r.top for r in outline.boundary_sides(labels).collect()}
    assert len(sides) == 3 and set(sides.values()) == {20}
    assert exports.tile_images(pixels).select("scan", "z", "png").distinct().count() == 3
    frags = detect.fragments(raster.tile_components(pixels))
    named = frags.select("frag", F.col("frag").alias("cluster"))
    found = detect.ranked(detect.merged(frags, named, pixels.select("scan", "z", "tx", "ty").distinct()))
    parts = {r.cluster: r.ring for r in outline.rings_of(labels, frags, named).collect()}
    near = {r.cluster: (r.lon, r.lat) for r in found.collect()}
    assert len(parts) == 3 and all(min(p.lon for p in ring) < near[c][0] < max(p.lon for p in ring) and min(p.lat for p in ring) < near[c][1] < max(p.lat for p in ring) for c, ring in parts.items())
    lines = [json.loads(r.line) for r in exports.features(found, outline.rings_of(labels, frags, named), link=True).collect()]
    assert len(lines) == 3 and all(x["properties"]["google_maps"].startswith("https://www.google.com/maps/search/?api=1&query=") and len(x["geometry"]["coordinates"]) == 1 for x in lines)


def pixels_of(image):
    """Height x width x 3 bytes of a PNG without filters."""
    at, body, size = 8, b"", None
    while at < len(image):
        n, name = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        size = struct.unpack(">II", data[:8]) if name == b"IHDR" else size
        body += data if name == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 3 * size[0])[:, 1:].reshape(size[1], size[0], 3)


def test_mosaics_pixel_by_pixel(spark):
    """Every pixel of a block against the rule: colour or background, tint of the mask, frame of a fragment's box, lines between tiles."""
    x, y = 250400, 201560  # the first tile of its block of 4 x 4
    pools = [(x, y, 30, 30, 20, 12), (x + 1, y, 250, 60, 6, 10), (x, y + 1, 0, 0, 3, 3)]
    rows = [(tx, ty, px + i, py + j, 45, 170, 190) for tx, ty, px, py, w, h in pools for i in range(w) for j in range(h)] + [(x + 1, y + 1, 100, 100, 45, 170, 190), (x + 1, y + 1, 9, 9, 80, 140, 60)]
    pixels = spark.createDataFrame(rows, "tx int, ty int, px int, py int, r int, g int, b int")
    frags = detect.fragments(raster.tile_components(pixels))
    found = mosaic.mosaics(pixels, frags, 4).collect()
    assert [(r.bx, r.by) for r in found] == [(x // 4, y // 4)]
    got, want = pixels_of(bytes(found[0].png)).astype(int), np.empty((1024, 1024, 3), int)
    want[:] = raster.BACKGROUND
    raw = {(r.tx, r.ty, r.px, r.py) for r in raster.water_mask(pixels).collect()}
    cleaned = {tuple(r) for r in raster.clean(raster.water_mask(pixels)).select("tx", "ty", "px", "py").collect()}
    spot = lambda tx, ty, px, py: ((ty - y) * 256 + py, (tx - x) * 256 + px)
    for tx, ty, px, py, *rgb in rows:
        want[spot(tx, ty, px, py)] = rgb
    for place in raw | cleaned:
        (colour, share) = ((255, 0, 255), 0.35) if place in cleaned else ((255, 160, 0), 0.3)
        want[spot(*place)] = [round(a * (1 - share) + c * share) for a, c in zip(want[spot(*place)].tolist(), colour)]
    for r in frags.collect():
        colour = (0, 255, 60) if r.strict > 0.5 else (255, 220, 0) if r.strict > 0.25 else (255, 60, 60)
        x0, x1, y0, y1 = max(0, r.min_px - 1), min(255, r.max_px + 1), max(0, r.min_py - 1), min(255, r.max_py + 1)
        for px in range(x0, x1 + 1):
            for py in range(y0, y1 + 1):
                if px in (x0, x1) or py in (y0, y1):
                    want[spot(r.tx, r.ty, px, py)] = colour
    for k in (256, 512, 768):
        want[k], want[:, k] = 90, 90
    assert (got == want).all() and frags.count() >= 2 and raw - cleaned
    assert mosaic.mosaics(pixels, frags.limit(0), 4).count() == 1 and mosaic.mosaics(pixels.limit(0), frags, 4).count() == 0


def test_mosaics_send_finished_tiles_to_their_block(spark, monkeypatch):
    """Pixels, which no task could hold for many blocks, are never dealt by block."""
    monkeypatch.setattr(scene, "TASK_PIXELS", 1 << 12)
    pixels = scene.supplier_pixels(spark, "/root/testdata/sf0.001")
    plan = mosaic.mosaics(pixels, detect.fragments(raster.tile_components(pixels)))._jdf.queryExecution().executedPlan().toString()
    below = re.findall(r"hashpartitioning\(bx#[^\n]*\n([^\n]*)", plan)
    assert len(below) == 1 and "image#" in below[0] and "px#" not in below[0]


def test_larger_images_are_cut_and_others_fail(spark, tmp_path):
    image = np.zeros((512, 512, 3), np.uint8)
    image[:] = raster.BACKGROUND
    image[250:262, 100:140] = (45, 170, 190)  # a pool over the border of two of the four tiles
    for name, data in (("z=18/x=5/y=7", exports.png(image)), ("z=18/x=6/y=7", exports.png(image[:300, :300])), ("z=18/x=7/y=7", b"no image"), ("z=18/x=8/y=7", exports.png(image[:256, :256]))):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "tile.png").write_bytes(data)
    pixels = image_pixels(spark, str(tmp_path)).cache()
    assert {tuple(r) for r in pixels.select("z", "tx", "ty").distinct().collect()} == {(19, 10, 14), (19, 11, 14), (19, 10, 15), (19, 11, 15), (18, 8, 7)}
    wet = {(r.tx, r.ty, r.px, r.py) for r in raster.water_mask(pixels.where("z = 19")).collect()}
    assert wet == {(10, 14 + (y >= 256), x, y % 256) for y in range(250, 262) for x in range(100, 140)}
    assert {tuple(r) for r in failed_images(spark, str(tmp_path)).collect()} == {(18, 6, 7), (18, 7, 7)} and raster.tile_components(pixels).count() == 3
