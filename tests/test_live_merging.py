"""Merging batch by batch against merging at once."""

import random

import pytest
from pyspark.sql import functions as F

from cerulea.operators import detect, raster
from cerulea.sinks.shared import stored
from cerulea.sources import scene
from cerulea.streaming import merge
from cerulea.streaming.feed import latest, open_feed

FACTS = ("cluster", "pixels", "parts", "tiles", "truncated", "open_water", "shown", "confidence", "kind", "main")


@pytest.fixture(scope="module")
def sent(spark):
    """Fragments and tiles of the scene with the lake."""
    pixels, scanned = scene.scanned_scene(spark, "/root/testdata/sf0.001")
    return stored(detect.fragments(raster.tile_components(pixels)), "fragments"), scanned.checkpoint()


def rows_of(found):
    return sorted((*[r[c] for c in FACTS], round(r.area, 4), round(r.west, 9)) for r in found.collect())


@pytest.mark.parametrize("parts", [3])
def test_any_split_ends_in_the_same_detections(spark, sent, tmp_path, parts):
    frags, scanned = sent
    frags = frags.join(scanned, ["tx", "ty"], "left_semi")
    told = merge.messages(scanned, frags)
    order = sorted(map(tuple, scanned.collect()))
    random.Random(parts).shuffle(order)
    folder = f"file://{tmp_path}/state"
    for n in range(parts):
        batch = spark.createDataFrame(order[n::parts], scanned.schema)
        merge.fold(told.join(batch, ["tx", "ty"], "left_semi"), n, folder)
        if n == 1:  # run again, as after a failure
            merge.fold(told.join(batch, ["tx", "ty"], "left_semi"), n, folder)
    want = detect.merged(frags, detect.clusters(frags, detect.merge_pairs(frags)), scanned)
    assert rows_of(merge.detections(spark, folder, told.schema)) == rows_of(want) and want.where("open_water").count() == 1 and want.where("tiles > 6").count() == 1
    now = latest(merge.events(spark, folder, told.schema), key="cluster")
    assert {(r.cluster, round(r.area, 4), r.truncated) for r in now.collect()} == {(r.cluster, round(r.area, 4), r.truncated) for r in want.where("shown").collect()}
    totals = merge.progress(spark, folder, told.schema)
    assert totals["done"] == len(order) and totals["failed"] == 0 and totals["wet"] == frags.select("tx", "ty").distinct().count() and totals["swept_m2"] > 0


def test_failed_tiles_leave_neighbours_open_until_they_are_done(spark, tmp_path):
    a, row = 250400, 201560
    frags = scene.analytic_fragments(spark.createDataFrame([(a, row, 236, 100, 20, 16)], "tx int, ty int, x int, y int, w int, h int"))
    place = lambda *x: spark.createDataFrame([(t, row) for t in x], "tx int, ty int")
    told = merge.messages(place(a), frags, place(a + 1))
    folder, source = f"file://{tmp_path}/state", str(tmp_path / "in")
    seen = []
    spark.streams.addListener(log := merge.ProgressLog(seen.append))
    run = lambda: merge.keep_merged(open_feed(spark, source, told.schema, 1), folder, str(tmp_path / "check")).awaitTermination()
    told.coalesce(1).write.mode("append").parquet(source)
    run()
    (cut,) = merge.detections(spark, folder, told.schema).collect()
    assert cut.truncated and merge.progress(spark, folder, told.schema) | {"swept_m2": 0} == {"done": 1, "failed": 1, "wet": 1, "swept_m2": 0}
    # the failed tile is done, dry; the first comes once more and counts once
    merge.messages(place(a, a + 1), frags).coalesce(1).write.mode("append").parquet(source)
    run()
    (whole,) = merge.detections(spark, folder, told.schema).collect()
    assert not whole.truncated and whole.confidence > cut.confidence and merge.progress(spark, folder, told.schema) | {"swept_m2": 0} == {"done": 2, "failed": 0, "wet": 1, "swept_m2": 0}
    log_rows = [(r.op, r.seq) for r in merge.events(spark, folder, told.schema).orderBy("seq").collect()]
    assert [op for op, _ in log_rows] == ["add", "update"]
    spark.streams.removeListener(log)
    assert not [p for p in (tmp_path / "state").iterdir() if "scratch" in p.name] and all(s["rows"] >= 0 for s in seen)


def test_scans_do_not_mix(spark, tmp_path):
    a, row = 250400, 201560
    rects = [("one", a, row, 236, 100, 20, 16), ("two", a + 1, row, 0, 100, 20, 16), ("one", a + 1, row, 0, 100, 20, 16)]
    frags = scene.analytic_fragments(spark.createDataFrame(rects, "scan string, tx int, ty int, x int, y int, w int, h int"))
    told = merge.messages(frags.select("scan", "tx", "ty"), frags)
    folder = f"file://{tmp_path}/state"
    for n, (scan, tile) in enumerate((("two", a + 1), ("one", a), ("one", a + 1))):
        merge.fold(told.where((F.col("scan") == scan) & (F.col("tx") == tile)), n, folder)
    assert {(r.cluster.split("/")[0], r.parts, r.truncated) for r in merge.detections(spark, folder, told.schema).collect()} == {("one", 2, False), ("two", 1, True)}
