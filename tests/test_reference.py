"""Scenarios of geodesy, rasters and detection on tiny tables."""

import math
import random
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import functions as F

from cerulea.functions import geo, text
from cerulea.functions.color import confidence, hsv
from cerulea.operators import raster
from cerulea.plans import cover
from cerulea.streaming.feed import keep_state, latest, open_feed

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def mask(spark, rows):
    return spark.createDataFrame([(0, 0, x, y) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"], "tx int, ty int, px int, py int")


def test_round_trip_and_resolution(spark):
    z = F.lit(19)
    for lon, lat in ((-171.3, -33.9), (-8.0172, 37.0894), (55.5, 61.2)):
        a, b = one(spark, geo.lon_of(geo.world_x(F.lit(lon), z), z), geo.lat_of(geo.world_y(F.lit(lat), z), z))
        assert math.isclose(a, lon, abs_tol=1e-9) and math.isclose(b, lat, abs_tol=1e-9)
    assert math.isclose(one(spark, geo.metres_per_pixel(F.lit(0.0), F.lit(0)))[0], geo.CIRCUMFERENCE / 256)


def test_rings(spark):
    inside, outside, cross, apart, overlap = one(
        spark, geo.in_ring(F.lit(0.5), F.lit(0.5), SQUARE), geo.in_ring(F.lit(1.5), F.lit(0.5), SQUARE), geo.segments_meet((0, 0), (1, 1), (0, 1), (1, 0)), geo.segments_meet((0, 0), (1, 0), (0, 1), (1, 1)), geo.segments_meet((0, 0), (2, 0), (1, 0), (3, 0))
    )
    assert inside and not outside and cross and not apart and overlap


def test_hsv_ties_and_grey(spark):
    red, grey, cyan = (one(spark, *hsv(*[F.lit(c) for c in rgb])) for rgb in ((255, 0, 0), (9, 9, 9), (0, 255, 255)))
    assert tuple(red) == (0, 1, 1) and grey[0] == 0 and grey[1] == 0 and cyan[0] == 180


def test_erosion_keeps_the_cut_edge_and_cleaning_drops_specks(spark):
    block = mask(spark, ["###", "###", "###"])
    assert {(r.px, r.py) for r in raster.erode(block).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    speck = mask(spark, [".....", "..#..", "....."])
    assert raster.dilate(speck).count() == 5 and raster.clean(speck).count() == 0


def test_labels_are_eight_connected_in_raster_order(spark):
    rows = raster.components(mask(spark, ["#..##", ".#...", "....#"])).collect()
    assert {(r.px, r.py): r.label for r in rows} == {(0, 0): 1, (1, 1): 1, (3, 0): 2, (4, 0): 2, (4, 2): 3}


def test_confidence_bounds(spark):
    strong = one(spark, confidence(*[F.lit(float(x)) for x in (0.95, 189, 0.7, 0.01, 0.9, 40)], F.lit(False)))[0]
    weak = one(spark, confidence(*[F.lit(float(x)) for x in (0.05, 150, 0.2, 0.13, 0.3, 1500)], F.lit(True)))[0]
    assert strong > 0.85 and weak < 0.35


def test_plan_orders(spark):
    tiles = spark.createDataFrame([(x, y) for x in range(3) for y in range(2)], "tx int, ty int")
    assert [r.tx for r in cover.serpentine(tiles, 0).orderBy("idx").collect()] == [0, 1, 2, 2, 1, 0]
    square = spark.createDataFrame([(x, y) for x in range(3) for y in range(3)], "tx int, ty int")
    first = cover.spiral(square, 1, 1).orderBy("idx").first()
    assert (first.tx, first.ty) == (1, 1)


def test_fixed_rounds_the_binary_value(spark):
    assert tuple(one(spark, *[text.fixed(F.lit(x), d) for x, d in ((8.35, 1), (1.005, 2), (0.25, 1))])) == ("8.3", "1.00", "0.3")


def test_feed_streams_to_the_same_state_as_the_batch(spark, tmp_path):
    rows = [(k % 5, k, ("add", "update", "remove")[k % 3], float(k)) for k in range(40)]
    events = spark.createDataFrame(rows, "id int, seq int, op string, value double")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    query = keep_state(open_feed(spark, str(tmp_path / "in"), events.schema, 1), str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "state").iterdir() if p.name.startswith("v="))
    state = spark.read.parquet(str(tmp_path / f"state/v={last}")).where("op <> 'remove'")
    assert sorted((r.id, r.seq) for r in state.collect()) == sorted((r.id, r.seq) for r in latest(events).collect())


def test_numbers_are_written_exactly_with_halves_away_from_zero(spark):
    rng = random.Random(2)
    values = [0.5, -0.5, 1.5, 2.5, 0.125, -0.125, 8.35, 1.005, 0.25, 1e22, -1e-9, 0.0, 1e15 + 0.5, 123456.5] + [rng.uniform(-1000, 1000) for _ in range(3000)] + [rng.randrange(-4000, 4000) / 16 for _ in range(1000)]
    for digits in (0, 1, 2, 6):
        for v in values:
            assert text.written(v, digits) == f"{Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)):f}", (v, digits)
    rows = spark.createDataFrame([(v,) for v in (0.25, None, float("nan"), 2.5)], "v double").select(text.fixed(F.col("v"), 1).alias("a"), text.fixed(F.col("v"), 0).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("0.3", "0"), (None, None), (None, None), ("2.5", "3")]
