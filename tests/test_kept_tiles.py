"""Tiles kept as files under their cache names: which files a read opens, what it gives, and what is left to fetch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cerulea.operators import detect, raster
from cerulea.sinks import exports
from cerulea.sinks.tiles import keep_tiles
from cerulea.sources.images import kept_failures, kept_pixels, not_kept

HERE, THERE = "https://tiles.example/{z}/{y}/{x}", "https://other.example/{z}/{x}/{y}.png"


def picture(shade: int, side: int = 256) -> bytes:
    return exports.png(np.full((side, side, 3), shade, np.uint8))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """12 tiles of two zooms, one also of another provider, one larger, one that holds no image, one without bytes, and a file of another name."""
    path = tmp_path_factory.mktemp("kept")
    rows = [(z, tx, 7, picture(10 * z + tx)) for z in (3, 4) for tx in range(6)] + [(5, 1, 1, picture(9, 512)), (5, 2, 1, b"<html>gone</html>"), (5, 3, 1, b""), (5, 4, 1, None)]
    images = spark.createDataFrame(rows, "z int, tx int, ty int, png binary")
    assert keep_tiles(images.repartition(5), f"file://{path}", HERE) == 14
    assert keep_tiles(spark.createDataFrame([(3, 0, 7, picture(200))], images.schema), str(path), THERE) == 1
    assert keep_tiles(images.where("z = 4"), str(path), HERE) == 6  # twice is once
    (path / "notes-of-some-day.bin").write_bytes(b"x")
    assert len(list(path.glob("[0-9]*.bin"))) == 15 and not [p for p in path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    return str(path)


def files_opened(df) -> int:
    """What the scan of a table that was read says of its own files."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


def shades(df):
    return {tuple(r) for r in df.groupBy("z", "tx", "ty").agg(F.min("r"), F.max("b"), F.count("*")).collect()}


def test_reads_open_the_chosen_files_only(spark, folder):
    assert shades(kept_pixels(spark, folder, HERE, "z = 4 AND tx >= 4")) == {(4, 4, 7, 44, 44, 65536), (4, 5, 7, 45, 45, 65536)}
    assert files_opened(kept_pixels(spark, folder, HERE, "z = 4 AND tx >= 4").where("px = 0")) == 2
    assert files_opened(kept_pixels(spark, folder, HERE, "z = 3").where("px = 0")) == 6 and files_opened(kept_pixels(spark, folder, None, "z = 3").where("px = 0")) == 7
    assert shades(kept_pixels(spark, folder, THERE)) == {(3, 0, 7, 200, 200, 65536)}
    assert shades(kept_pixels(spark, folder, HERE, "z = 5")) == {(6, x, y, 9, 9, 65536) for x in (2, 3) for y in (2, 3)}
    assert kept_pixels(spark, folder, HERE, "z = 22").count() == 0


def test_failed_and_missing_tiles(spark, folder, tmp_path):
    assert {tuple(r) for r in kept_failures(spark, folder, HERE).collect()} == {(5, 2, 1)}
    plan = spark.createDataFrame([(z, tx, 7, z * 10 + tx) for z in (3, 9) for tx in range(2)] + [(5, 2, 1, 52), (5, 3, 1, 53)], "z int, tx int, ty int, idx int")
    assert {r.idx for r in not_kept(plan, folder, HERE).collect()} == {53, 90, 91} and {r.idx for r in not_kept(plan, folder, THERE).collect()} == {31, 52, 53, 90, 91}
    assert not_kept(plan, str(tmp_path), HERE).count() == 6 and kept_pixels(spark, str(tmp_path)).count() == 0


def test_a_stream_takes_tiles_as_they_are_kept(spark, tmp_path):
    path, out = str(tmp_path / "kept"), str(tmp_path / "out")
    pool = np.full((256, 256, 3), 120, np.uint8)
    pool[40:60, 40:80] = 45, 170, 190
    one = lambda tx, body: keep_tiles(spark.createDataFrame([(19, 250400 + tx, 201560, body)], "z int, tx int, ty int, png binary"), path, HERE)
    one(1, exports.png(pool))
    for tx in (2, 3):
        pixels = kept_pixels(spark, path, HERE, "tx <> 250403", live=True)
        pixels.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        one(tx, exports.png(pool))
    found = spark.read.parquet(out)
    assert sorted(found.groupBy("tx").count().collect()) == [(250401, 65536), (250402, 65536)]  # 3 came after the last batch
    pixels = kept_pixels(spark, path, HERE)
    # cleaning takes the four corners of a rectangle
    assert detect.fragments(raster.tile_components(pixels)).select("tx", "pixels").orderBy("tx").collect() == [(250400 + k, 796) for k in (1, 2, 3)]
