"""Merging of fragments, the kernel of a tile against its relational form, and the live ranking."""

import cerulea
from cerulea.operators import detect, raster
from cerulea.plans import cover
from cerulea.sources import area, scene
from cerulea.streaming.feed import changes, keep_ranking, open_feed
from pyspark.sql import functions as F

A, B, C, ROW = 250400, 250401, 250402, 201560
RECT = "tx int, ty int, x int, y int, w int, h int"


def merged(spark, rects, scanned, limits=detect.Limits()):
    frags = scene.analytic_fragments(spark.createDataFrame(rects, RECT)).checkpoint()
    seen = spark.createDataFrame([(x, ROW) for x in scanned], "tx int, ty int")
    pairs = detect.merge_pairs(frags, limits)
    named = detect.clusters(frags, pairs)
    return [r.asDict() for r in detect.merged(frags, named, seen, limits).orderBy("cluster").collect()], detect.parts_of(frags, named)


def test_two_halves_over_a_border_are_one_pool(spark):
    rects = [(A, ROW, 236, 100, 20, 16), (B, ROW, 0, 100, 20, 16)]
    (one,), parts = merged(spark, rects, [A, B])
    assert one["pixels"] == 640 and one["tiles"] == 2 and one["parts"] == 2 and not one["truncated"] and one["shown"]
    halves = scene.analytic_fragments(spark.createDataFrame(rects, RECT)).collect()
    assert abs(one["area"] - sum(r.area for r in halves)) < 1e-5 and (one["west"], one["east"]) == (min(r.west for r in halves), max(r.east for r in halves))
    assert {r.tile for r in parts.collect()} == {f"19/{A}/{ROW}", f"19/{B}/{ROW}"}


def test_truncation_ends_where_the_next_tile_was_scanned_even_if_dry(spark):
    half = [(A, ROW, 236, 100, 20, 16)]
    (cut,), _ = merged(spark, half, [A])
    (whole,), _ = merged(spark, half, [A, B])
    assert cut["truncated"] and not whole["truncated"] and cut["confidence"] < whole["confidence"]


def test_fragments_far_apart_on_a_border_stay_two(spark):
    rows, _ = merged(spark, [(A, ROW, 236, 20, 20, 16), (B, ROW, 0, 200, 20, 16)], [A, B, C])
    assert len(rows) == 2


def test_small_parts_are_shown_only_together(spark):
    limits = detect.Limits(min_merged=8)
    small = [(A, ROW, 251, 100, 5, 16), (B, ROW, 0, 100, 5, 16)]
    alone, _ = merged(spark, small[:1], [A], limits)
    both, _ = merged(spark, small, [A, B], limits)
    assert [r["shown"] for r in alone] == [False] and [r["shown"] for r in both] == [True]


def test_water_beyond_the_ceiling_is_open_water(spark):
    (big,), _ = merged(spark, [(A, ROW, 156, 0, 100, 256)], [A], detect.Limits(max_area=100))
    assert big["open_water"] and not big["shown"]
    before, _ = merged(spark, [(A, ROW, 236, 100, 20, 16)], [A], detect.Limits(max_area=60))
    after, _ = merged(spark, [(A, ROW, 236, 100, 20, 16), (B, ROW, 0, 60, 256, 140)], [A, B], detect.Limits(max_area=60))
    table = lambda rows: spark.createDataFrame([(r["cluster"], r["area"], r["confidence"]) for r in rows if r["shown"]], "cluster string, area double, confidence double")
    assert [r["shown"] for r in before] == [True] and [r["open_water"] for r in after] == [True]
    assert [(r.op, r.area) for r in changes(table(before), table(after)).collect()] == [("remove", None)] and changes(table(before), table(before)).count() == 0
    assert [r.op for r in changes(table(after), table(before)).collect()] == ["add"]


def test_ranking_in_ranges_equals_one_sort(spark):
    rows = [(f"c{k:03}", float(k * 7 % 31), float(k % 5)) for k in range(200)]
    found = spark.createDataFrame(rows, "cluster string, area double, confidence double").repartition(7)
    want = [c for c, a, s in sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))]
    got = detect.ranked(found).collect()
    assert [r.cluster for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 201))
    assert [r.cluster for r in sorted(detect.top(found, 25).collect(), key=lambda r: r["rank"])] == want[:25] and detect.ranked(found.limit(0)).count() == 0


def test_kernel_equals_the_relational_steps_for_scans_zooms_and_alpha(spark):
    plain = scene.supplier_pixels(spark, "/root/testdata/sf0.01").withColumns({"a": F.when(F.col("px") % 64 == 0, 100).otherwise(255), "z": F.lit(19), "scan": F.lit("one")})
    pixels = plain.unionByName(plain.withColumns({"z": F.lit(18), "a": F.lit(255)})).unionByName(plain.withColumns({"scan": F.lit("two"), "a": F.lit(100)})).checkpoint()
    labels = raster.components(raster.clean(raster.water_mask(pixels))).checkpoint()
    key = ["scan", "z", "tx", "ty", "label"]
    want = raster.component_stats(labels, pixels).join(raster.component_texture(labels, pixels), key)
    got = raster.tile_components(pixels).select(*want.columns)
    row = lambda df: sorted(map(tuple, df.collect()))
    assert row(got) == row(want) and got.count() > 50 and got.where("scan = 'two'").count() == 0
    assert row(raster.tile_labels(pixels).select(*labels.columns)) == row(labels)
    seen = pixels.select("scan", "z", "tx", "ty").distinct()
    found = cerulea.detections(pixels, seen).checkpoint()
    assert {r.scan for r in found.collect()} == {"one"} and {r.z for r in found.collect()} == {18, 19} and all(r.cluster.startswith(f"one/{r.z}/") for r in found.collect())
    own = cerulea.detections(pixels.where("z = 18"), seen.where("z = 18"))
    assert sorted((r.cluster, r.area) for r in own.collect()) == sorted((r.cluster, r.area) for r in found.where("z = 18").collect())


def test_another_detector_may_take_its_place(spark):
    pixels = scene.supplier_pixels(spark, "/root/testdata/sf0.001")
    seen = pixels.select("tx", "ty").distinct()
    none = cerulea.detections(pixels, seen, detector=lambda p: raster.tile_components(p).where("strict > 2"))
    assert none.count() == 0 and cerulea.detections(pixels, seen).count() > 0


def test_the_lake_is_left_out_and_dry_neighbours_count(spark):
    found = detect.detections(*scene.scanned_scene(spark, "/root/testdata/sf0.01")).collect()
    lake = [r for r in found if r.open_water]
    assert len(lake) == 1 and lake[0].tiles > 6 and not lake[0].shown and any(r.truncated for r in found) and any(not r.truncated and r.tiles > 1 for r in found)


def test_live_ranking_follows_the_feed(spark, tmp_path):
    schema = "cluster string, seq long, op string, area double, confidence double"
    for k, rows in enumerate(([("a", 1, "add", 10.0, 0.9), ("b", 2, "add", 20.0, 0.9)], [("a", 3, "update", 30.0, 0.9), ("c", 4, "add", 5.0, 0.9)], [("b", 5, "remove", None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keep_ranking(open_feed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1), str(tmp_path / "state"), str(tmp_path / "ranking"), str(tmp_path / "check")).awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "ranking").iterdir() if p.name.startswith("v="))
    rows = spark.read.parquet(str(tmp_path / f"ranking/v={last}")).orderBy("rank").collect()
    assert [(r["rank"], r.cluster, r.area) for r in rows] == [(1, "a", 30.0), (2, "c", 5.0)] and len(list((tmp_path / "ranking").glob("v=*"))) == 2


def test_estimates_and_grids(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    wide, small = cover.estimate(spark, ring, 14).first(), cover.estimate(spark, ring, 8).first()
    assert wide.approximate and wide.tiles > 50_000 and not small.approximate and small.tiles == cover.cover(spark, ring, 8).count()
    inside = [(0.01, 0.01), (0.02, 0.01), (0.02, 0.02)]  # a ring within one tile, and a tile within a ring
    assert cover.cover(spark, inside, 10).count() == 1 and cover.cover(spark, ring, 12).count() > 10_000
    point = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    assert sorted((r.tx, r.ty) for r in cover.grid(point, 2, 3).collect()) == [(3, 3), (3, 4), (4, 3), (4, 4)]


def test_places_as_typed(spark):
    cases = {"37.08, -8.01": (-8.01, 37.08), " 37.08 -8.01 ": (-8.01, 37.08), "-1,2": (2.0, -1.0), "86, 1": None, "1, 181": None, "1e1, 2": None, "1., 2": None, ".5, 2": None, "+1, 2": None, "1": None, "1, 2, 3": None, "a, b": None, "1-2, 3": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", area.place_of(F.col("t")).alias("p")).collect()
    assert {r.t: r.p and tuple(r.p) for r in rows} == cases
    assert area.demo_areas(spark).where(F.size("ring") == 4).count() == 4


def test_a_scene_is_painted_in_parts_of_whole_tiles(spark, monkeypatch):
    """The latest key wins, also left of and above the origin, and no task paints much more than its share."""
    monkeypatch.setattr(scene, "TASK_PIXELS", 1 << 13, raising=False)
    odd = [(-1, -300, -900, 600, 300, 1, 2, 3), (10**6, -260, -700, 9, 9, 4, 5, 6)]
    rects = scene.rectangles(spark.range(200).select(F.col("id").alias("k"))).unionByName(spark.createDataFrame(odd, "k long, gx long, gy long, w long, h long, r int, g int, b int"))
    want = {}
    for r in sorted(rects.collect(), key=lambda r: r.k):
        want |= {(x, y): (r.r, r.g, r.b) for x in range(r.gx, r.gx + r.w) for y in range(r.gy, r.gy + r.h)}
    rows = scene.pixels(rects).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and {((r.tx - scene.TILE_X) * 256 + r.px, (r.ty - scene.TILE_Y) * 256 + r.py): (r.r, r.g, r.b) for r in rows} == want
    parts, tiles = {}, {}
    for r in rows:
        parts[r.part] = parts.get(r.part, 0) + 1
        tiles.setdefault((r.tx, r.ty), set()).add(r.part)
    assert len(parts) > 12 and max(parts.values()) < len(rows) / 3 and all(len(p) == 1 for p in tiles.values())


def test_pixels_are_not_broadcast(spark):
    pixels = scene.supplier_pixels(spark, "/root/testdata/sf0.001")
    labels = raster.components(raster.clean(raster.water_mask(pixels)))
    for measured in (raster.component_stats, raster.component_texture):
        plan = measured(labels, pixels)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
