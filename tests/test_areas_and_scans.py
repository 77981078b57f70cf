"""Areas as tables, orders of visit, differences of scans, dated imagery and calibration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cerulea import queries
from cerulea.functions import geo
from cerulea.operators import calibrate, dated, detect, diff, raster
from cerulea.plans import areas, cover, resume
from cerulea.sources import scene

RING = "area int, ring array<struct<lon: double, lat: double>>"


def rings(spark, *corners):
    return spark.createDataFrame([(k, c) for k, c in enumerate(corners)], RING)


TRIANGLE = [(-8.020, 37.080), (-7.990, 37.083), (-7.995, 37.105)]
NOTCHED = [(-8.03, 37.07), (-7.98, 37.07), (-7.98, 37.11), (-8.0, 37.075), (-8.03, 37.11)]
CROSSED = [(-8.03, 37.07), (-7.98, 37.11), (-7.98, 37.07), (-8.03, 37.11)]
OVER_THE_MERIDIAN = [(-0.02, -0.01), (0.03, -0.015), (0.02, 0.02), (-0.01, 0.03)]
DOT = [(10.0, 10.0), (10.0000001, 10.0), (10.0, 10.0000001)]


def test_cover_of_tables_equals_cover_of_one_ring(spark):
    all_rings = [TRIANGLE, NOTCHED, CROSSED, OVER_THE_MERIDIAN, DOT, [*TRIANGLE, TRIANGLE[0]]]
    got = areas.cover(rings(spark, *all_rings), 15).collect()
    assert len({(r.area, r.tx, r.ty) for r in got}) == len(got)
    for k, ring in enumerate(all_rings):
        assert {(r.tx, r.ty) for r in got if r.area == k} == {tuple(r) for r in cover.cover(spark, ring, 15).collect()}, k
    assert {(r.tx, r.ty) for r in got if r.area == 0} == {(r.tx, r.ty) for r in got if r.area == 5}


def test_ranges_follow_the_length_of_a_ring(spark):
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    found = areas.ranges(rings(spark, box), 13).cache()
    whole = found.where("whole").agg(F.count("*"), F.sum(F.expr("shiftleft(1L, 2 * (13 - z))"))).first()
    assert found.where("NOT whole").agg(F.min("z")).first()[0] == 13 and whole[1] > 40_000 and found.count() < 6_000
    n = areas.estimates(rings(spark, box), 13, exact=10**6).first()
    boxed = areas.estimates(rings(spark, box), 13).first()
    assert n.tiles == cover.cover(spark, box, 13).count() and not n.approximate and boxed.approximate and boxed.tiles >= n.tiles


def test_areas_without_a_ring(spark):
    table = rings(spark, None, [], TRIANGLE[:2], TRIANGLE, [(1.0, 89.0), (2.0, 89.0), (1.5, 88.0)])
    assert {r.area for r in areas.cover(table, 12).collect()} <= {3, 4} and areas.cover(table.limit(0), 12).count() == 0 and areas.estimates(table, 12).where("area = 3").count() == 1


def test_orders_visit_each_tile_once_and_hilbert_steps_are_short(spark):
    covered = areas.cover(rings(spark, NOTCHED, TRIANGLE), 17).cache()
    want = [tuple(r) for r in cover.serpentine(covered.where("area = 1").select("tx", "ty"), covered.where("area = 1").agg(F.min("ty")).first()[0]).orderBy("idx").select("tx", "ty").collect()]
    step = {}
    for name, placed in (("serpentine", areas.serpentine(covered)), ("spiral", areas.spiral(covered)), ("hilbert", areas.hilbert(covered, 17))):
        for k in (0, 1):
            rows = placed.where(f"area = {k}").orderBy("idx").collect()
            assert [r.idx for r in rows] == list(range(len(rows)))
        if name == "serpentine":
            assert [(r.tx, r.ty) for r in rows] == want
        rows = placed.where("area = 0").orderBy("idx").collect()
        # how far apart in the order tiles are that touch on the map
        at = {(r.tx, r.ty): r.idx for r in rows}
        step[name] = np.mean([math.log2(1 + abs(i - at[x, y + 1])) for (x, y), i in at.items() if (x, y + 1) in at])
    assert step["hilbert"] < step["serpentine"]


LARGE = [(-9.0, 36.0), (-7.0, 36.2), (-7.0, 38.0), (-9.0, 38.0)]


@pytest.mark.parametrize("most", [0, 40, 2000, 1 << 20])
def test_orders_of_rings_in_a_kernel_equal_those_by_bands(spark, monkeypatch, most):
    shapes = [TRIANGLE, NOTCHED, CROSSED, OVER_THE_MERIDIAN, DOT, None, [], TRIANGLE[:2], [(1.0, 1.0)] * 3, LARGE, [(1.0, 89.0), (2.0, 89.0), (1.5, 88.0)], [(0.0, 0.0), (None, 1.0), (1.0, 1.0)]]
    table = rings(spark, *shapes).repartition(3)
    covered = areas.cover(table, 12).cache()
    want = {(r.area, r.tx, r.ty): [] for r in covered.collect()}
    for placed in (areas.serpentine(covered), areas.spiral(covered), areas.hilbert(covered, 12)):
        for r in placed.collect():
            want[r.area, r.tx, r.ty].append(r.idx)
    placed = []
    held = areas._placed
    monkeypatch.setattr(areas, "_placed", lambda *a: [placed.append(1), held(*a)][1])
    monkeypatch.setattr(areas, "WHOLE_RING", most)
    monkeypatch.setattr(areas, "RING_STEP", 100)
    got = areas.orders(table, 12).collect()
    assert {(r.area, r.tx, r.ty): [r.serpentine, r.spiral, r.hilbert] for r in got} == want and len(got) == len(want) > 500


def test_orders_of_small_rings_deal_out_no_tiles(spark, monkeypatch):
    monkeypatch.setattr(areas, "_placed", None)  # windows over all tiles
    monkeypatch.setattr(areas, "ranges", None)
    assert areas.orders(rings(spark, TRIANGLE, NOTCHED), 16).groupBy("area").count().count() == 2 and areas.orders(rings(spark, TRIANGLE).limit(0), 16).count() == 0


def test_hilbert_is_a_path_over_the_square(spark):
    cells = spark.range(4096).select((F.col("id") % 64).cast("int").alias("x"), (F.col("id") / 64).cast("int").alias("y"))
    walk = [(r.x, r.y) for r in cells.withColumn("d", areas.hilbert_index(F.col("x"), F.col("y"), 6)).orderBy("d").collect()]
    assert len(set(walk)) == 4096 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_points_are_located_by_tiles(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-8.04, -7.97), rng.uniform(37.06, 37.12)) for k in range(400)]
    table = spark.createDataFrame(points, "id int, lon double, lat double")
    shapes = [TRIANGLE, NOTCHED, CROSSED]
    got = {(r.id, r.area) for r in areas.located(table, rings(spark, *shapes), 16).collect()}
    want = set()
    for k, ring in enumerate(shapes):
        want |= {(r.id, k) for r in table.where(geo.in_ring(F.col("lon"), F.col("lat"), ring)).collect()}
    assert got == want and len(got) > 100


@pytest.mark.parametrize("most", [4096, 7])
def test_points_of_areas_are_counted_without_their_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(areas, "BLOCK_POINTS", most)
    monkeypatch.setattr(areas, "BLOCK_RINGS", max(1, most // 7))
    monkeypatch.setattr(areas, "TILE_POINTS", most)
    rng = random.Random(4)
    points = [(rng.choice([-8.01, rng.uniform(-8.04, -7.97)]), rng.choice([37.09, rng.uniform(37.06, 37.12)])) for _ in range(400)] + [(None, 37.09)]
    table = spark.createDataFrame(points, "lon double, lat double")
    shapes = rings(spark, TRIANGLE, NOTCHED, CROSSED, DOT, None, [(-9.0, 36.0), (-7.0, 36.0), (-7.0, 38.0), (-9.0, 38.0)])
    want = {r.area: r["count"] for r in areas.located(table, shapes, 13).groupBy("area").count().collect()}
    found = areas.point_counts(table, shapes, 13)
    assert {r.area: r.n for r in found.collect()} == want and len(want) == 4 and want[5] == 400
    assert areas.point_counts(table.limit(0), shapes, 13).count() == 0 and areas.point_counts(table, shapes.limit(0), 13).count() == 0


@pytest.mark.parametrize("step", [1, 60, 1 << 18])
def test_a_block_counts_as_the_rule_says(monkeypatch, step):
    """Rings that cross themselves, level and upright sides, corners at points, equal points and points far outside, also beyond the grid's reach."""
    monkeypatch.setattr(areas, "STEP", step)
    rng = np.random.default_rng(6)
    for case in range(24):
        scale, most = (2.0**-7, 1.0, 2.0**30)[case % 3], 40 if step < 1 << 18 else 700
        exact = lambda c: np.round(c * 2.0 ** (bits := rng.integers(2, 14))) / 2.0**bits * scale  # noqa: E731  so that sides end where the next begins
        shapes = [exact(rng.uniform(-0.2, 1.2, (n, 2))) for n in rng.integers(3, 9, 30)]
        shapes += [np.array([(0, 0), (1, 0), (1, 1), (0, 1)]) * scale, np.array([(0.5, -9), (0.5, 9), (9, 9), (9, -9)]) * scale]
        lon, lat = exact(rng.uniform(0, 1, (2, rng.integers(0, most))))
        ends = [(*p, *(q - p)) for s in shapes for p, q in zip(s, np.roll(s, -1, axis=0))]
        at, sides = np.cumsum([0, *map(len, shapes)]), np.array(ends)
        x, y, dx, dy = (sides[:, k, None] for k in range(4))
        hit = ((y > lat) != (y + dy > lat)) & (lon < x + dx * ((lat - y) / np.where(dy != 0, dy, 1)))
        want = [int((hit[i:j].sum(0) % 2).sum()) for i, j in zip(at, at[1:])]
        assert areas._inside(at, sides, lon, lat).tolist() == want, case


def test_dense_points_meet_few_pieces_of_rings(spark, monkeypatch):
    """Pieces of rings do not grow with the points: a cell is small only where a larger one would hold very many of them."""
    held, pieces = areas.stored, []
    monkeypatch.setattr(areas, "stored", lambda df, name: [out := held(df, name), pieces.append(out.count() if name in ("ranges", "cells") else 0)][0])
    table = spark.range(60000).select((-8.03 + F.col("id") * 31 % 60000 / 60000 * 0.05).alias("lon"), (37.07 + F.col("id") * 7919 % 60000 / 60000 * 0.04).alias("lat"))
    shapes = rings(spark, *[TRIANGLE, NOTCHED, CROSSED] * 5)
    got = {r.area: r.n for r in areas.point_counts(table, shapes, 16).collect()}
    want = [table.where(geo.in_ring(F.col("lon"), F.col("lat"), r)).count() for r in (TRIANGLE, NOTCHED, CROSSED)]
    assert got == {k: want[k % 3] for k in range(15)} and sum(pieces) <= 15 * 9


@pytest.mark.parametrize("most", [0, 300])
def test_rings_of_all_kinds_meet_their_points(spark, monkeypatch, most):
    monkeypatch.setattr(areas, "CUT_RING", most)
    monkeypatch.setattr(areas, "TILE_POINTS", 20)
    rng = random.Random(9)
    points = [(rng.uniform(-8.04, -7.97), rng.uniform(37.06, 37.12)) for _ in range(500)] + [(0.01, 0.0), (float("nan"), 37.09), (-8.0, float("inf")), (float("-inf"), 37.09), (None, None)]
    table = spark.createDataFrame(points, "lon double, lat double").coalesce(1)
    shapes = rings(spark, TRIANGLE, NOTCHED, CROSSED, OVER_THE_MERIDIAN, DOT, None, LARGE, [(1.0, 1.0)] * 3, [(-1e7, -80.0), (1e7, -80.0), (0.0, 80.0)])
    want = {r.area: r["count"] for r in areas.located(table.limit(501), shapes, 13).groupBy("area").count().collect()}
    assert {r.area: r.n for r in areas.point_counts(table, shapes, 13).collect()} == want and len(want) == 6  # no ring reaches infinity


def greedy(before, after, metres):
    """Nearest pairs first."""
    pairs = []
    for a, (x, y) in before.items():
        for b, (u, v) in after.items():
            d = round(math.hypot((u - x) * 111320 * math.cos(math.radians((y + v) / 2)), (v - y) * 111320), 6)
            if d < metres:
                pairs.append((d, a, b))
    out, used = {}, set()
    for d, a, b in sorted(pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out[a] = b
    return out


@pytest.mark.parametrize("lat", [0.0, 37.0, -60.0, 84.9])
def test_scan_diff_against_nearest_first(spark, lat):
    rng = random.Random(7)
    place = lambda: (rng.uniform(0, 60) / 111320 / math.cos(math.radians(lat)), lat + rng.uniform(0, 60) / 111320)
    before, after = {f"a{k}": place() for k in range(120)}, {f"b{k}": place() for k in range(110)}
    table = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "cluster string, lon double, lat double")
    rows = diff.scan_diff(table(before), table(after)).collect()
    want = greedy(before, after, 5)
    assert {r.before: r.after for r in rows if r.op == "unchanged"} == want and len(want) > 50
    assert {r.before for r in rows if r.op == "removed"} == set(before) - set(want) and {r.after for r in rows if r.op == "added"} == set(after) - set(want.values()) and len(rows) == 230 - len(want)


def test_dense_scans_are_matched_without_all_their_pairs(spark, monkeypatch):
    """Copies at one place, equal distances and names in no order of place, over the corner of four blocks: nearest first, and what is stored grows with the rows."""
    step, rows, counts = 0.9 / 111320, 60 / 111320, []
    place = lambda k, copies: (rows + ((k // copies * 5) % 14 - 7) * step, rows + ((k // copies * 3) % 16 - 8) * step)
    name = lambda k: f"{k * 7919 % 1009:04d}"
    before = {name(k): place(k, 9) for k in range(1000)}
    after = {name(k): (x + k % 3 * step / 2, y + k % 2 * step / 2) for k in range(900) for x, y in [place(k + 4, 4)]}
    held = diff.stored
    monkeypatch.setattr(diff, "stored", lambda df, name: [out := held(df, name), counts.append(out.count())][0])
    table = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "cluster string, lon double, lat double")
    found = diff.scan_diff(table(before), table(after)).collect()
    want = greedy(before, after, 5)
    assert {r.before: r.after for r in found if r.op == "unchanged"} == want and len(want) > 850 and len(found) == 1900 - len(want)
    assert sum(counts) < 4 * 1900  # there are 273,362 pairs


def test_a_block_holds_few_pairs_and_matches_the_same(spark, monkeypatch):
    rng = random.Random(3)
    place = lambda: (rng.choice([0.00012, 0.0002, rng.uniform(0, 0.0007)]), rng.choice([0.0001, rng.uniform(0, 0.0007)]))
    points = spark.createDataFrame([(k, None, *place()) if k % 2 else (None, k, *place()) for k in range(1500)], "a long, b long, lon double, lat double")
    tile = diff.dealt(points, 5.0, 0.0).sort("row", "column").toArrow()
    rows = lambda tables: sorted(tuple(r.values()) for t in tables for r in t.to_pylist() if r["kind"] < 2)
    want = rows([diff._decided(tile, 5.0)])
    monkeypatch.setattr(diff, "PAIRS", 40)
    monkeypatch.setattr(diff, "ROWS", 30)
    parts = list(diff._blocks(tile.to_batches(max_chunksize=7)))
    assert len(parts) > 1 and sum(len(t) for t in parts) == len(tile) and len({(r["row"], r["column"]) for t in parts for r in t.select(["row", "column"]).to_pylist()}) == sum(len({(r["row"], r["column"]) for r in t.to_pylist()}) for t in parts)
    assert rows(diff._decided(t, 5.0) for t in parts) == want and len(want) > 300


def test_scan_diff_of_empty_scans_and_missing_places(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "cluster string, lon double, lat double")
    assert sorted(r.op for r in diff.scan_diff(one, one.limit(0)).collect()) == ["removed"] * 2 and sorted(r.op for r in diff.scan_diff(one.limit(0), one).collect()) == ["added"] * 2
    assert sorted(r.op for r in diff.scan_diff(one, one).collect()) == ["added", "removed", "unchanged"]


def test_releases_as_of_each_scan(spark):
    rng = random.Random(5)
    scans = [(k, rng.choice([0, 0, 0, 1, 2, None]), rng.choice([None, *range(0, 900, 7)])) for k in range(300)]
    releases = [(rng.choice([0, 1, None]), rng.choice([None, *range(0, 900, 31)]), f"r{k}") for k in range(60)]
    s, r = spark.createDataFrame(scans, "id int, tile int, at long"), spark.createDataFrame(releases, "tile int, at long, release string")
    for period in (1, 50, 10**6):
        got = {x.id: (x.release, x.released_at) for x in dated.as_of(s, r, ["tile"], period=period).collect()}
        for k, tile, at in scans:
            known = [(t, n) for i, t, n in releases if i == tile and tile is not None and t is not None and at is not None and t <= at]
            assert got[k] == (max(known)[1], max(known)[0]) if known else got[k] == (None, None)
    assert dated.as_of(s, r.limit(0), ["tile"]).where("release IS NULL").count() == 300 and dated.as_of(s.limit(0), r, ["tile"]).count() == 0


def test_calibration_equals_newton_in_numpy(spark):
    rows = queries.judged(spark, "/root/testdata/sf0.01")
    got = calibrate.fitted(rows, queries.MEASURES)
    data = np.array([[1.0, *[float(r[c]) for c in queries.MEASURES]] for r in rows.collect()])
    y = np.array([r.label for r in rows.collect()], float)
    w = np.zeros(data.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-data @ w))
        w = w + np.linalg.solve(data.T @ (data * (p * (1 - p))[:, None]), data.T @ (y - p))
    assert np.abs(got - w).max() < 1e-8 and got[1] > 1 and got[3] > 0 > got[4]
    apart = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)] + [(None, 1), (float("nan"), 0), (3.0, None)], "x double, label int")
    assert np.isfinite(calibrate.fitted(apart, ["x"])).all() and not calibrate.fitted(apart.limit(0), ["x"]).any()
    assert calibrate.calibrated(apart, ["x"], np.array([0.0, 0.0])).where("calibrated = 0.5").count() == 11  # null and NaN stay so


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_killed_scan_ends_as_if_it_had_not_been(spark, tmp_path, at):
    pixels = scene.supplier_pixels(spark, "/root/testdata/sf0.001").cache()
    order = cover.serpentine(pixels.select("tx", "ty").distinct(), scene.TILE_Y)
    folder, calls = f"file://{tmp_path}/scan", []

    def scan(tiles):
        calls.append(1)
        found = detect.fragments(raster.tile_components(pixels.join(tiles.select("tx", "ty"), ["tx", "ty"], "left_semi")))
        if len(calls) == at:  # dies after it has written its fragments, before the batch is marked
            found.write.mode("overwrite").parquet(f"{folder}/fragments/batch={tiles.agg(F.min('idx')).first()[0]}")
            raise Killed
        return found

    with pytest.raises(Killed):
        resume.run(order, folder, scan, 2)
    left = resume.pending(order, folder).count()
    assert left == order.count() - 2 * (at - 1)
    got = resume.run(order, folder, scan, 2)
    want = detect.fragments(raster.tile_components(pixels))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and resume.pending(order, folder).count() == 0
    assert not resume.step(order, folder, scan, 2) and resume.fragments(spark, f"file://{tmp_path}/none") is None
