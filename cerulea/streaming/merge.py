"""Merging as tiles arrive: clusters that grow batch by batch.

A message is a tile that was looked at, with its fragments, none if it is dry, or a tile that failed. A batch meets only the fragments around its tiles; the clusters
these belong to are summed anew, and what changed goes out as add, update and remove events. The state lies in buckets, of which a batch reads and writes those it
touches: tiles and edge fragments by tile block, names of clusters and their members by hash. A manifest names the bucket versions of each batch and is written last,
so a batch that is run again after a failure starts from the same state and ends in the same one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import ArrayType, StringType, StructType

from cerulea.functions import geo
from cerulea.operators import detect
from cerulea.operators.graph import components
from cerulea.operators.raster import key_of
from cerulea.sinks.shared import file_system, scratch, stored
from cerulea.sources.scene import ZOOM
from cerulea.streaming.feed import changes

BUCKETS, BLOCK = 16, 16
_SIDES = {"n": (0, -1), "s": (0, 1), "w": (-1, 0), "e": (1, 0)}
_FACTS = ("frag", "pixels", "area", "hue", "saturation", "value", "strict", "fill", "texture", "lon", "lat", "west", "south", "east", "north", "mpp", "edge", *_SIDES)


def messages(scanned: DataFrame, frags: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(tile, failed, frags): a row for each tile of ``scanned`` with its fragments, and one for each of ``failed``. A tile's fragments are few: at most its pixels over twelve."""
    key = key_of(scanned)
    held = frags.groupBy(*key).agg(F.collect_list(F.struct(*_FACTS)).alias("frags"))
    empty = F.array().cast(held.schema["frags"].dataType)
    rows = scanned.select(*key).distinct().join(held, key, "left").select(*key, F.lit(False).alias("failed"), F.coalesce("frags", empty).alias("frags"))
    return rows if failed is None else rows.union(failed.select(*key, F.lit(True), empty))


class State:
    """The tables of a merging, at the version before a batch."""

    def __init__(self, spark: SparkSession, folder: str, feed: StructType, n: int | None = None):
        self.spark, self.folder = spark, folder
        self.key = [c for c in ("scan", "z", "tx", "ty") if c in feed.names]
        frag = feed["frags"].dataType.elementType
        tile = [feed[c] for c in self.key]
        self.schemas = {
            "tiles": StructType([*tile]).add("failed", "boolean"),
            "edges": StructType([*tile, *frag]),
            "names": StructType().add("name", "string").add("into", "string"),
            "members": StructType([*tile, *frag]).add("cluster", "string").add("open", ArrayType(StringType())),
        }
        self.before, self.versions, self.totals = self._last(n)

    def _last(self, n: int | None) -> tuple[int | None, dict, dict]:
        system, where = file_system(self.spark, f"{self.folder}/manifest/v=*/_SUCCESS")
        found = [int(f.getPath().getParent().getName().split("=")[1]) for f in system.globStatus(where) or []]
        done = [v for v in found if n is None or v < n]
        if not done:
            return None, {name: {} for name in self.schemas}, {"done": 0, "failed": 0, "wet": 0, "swept_m2": 0.0}
        held = json.loads(self.spark.read.text(f"{self.folder}/manifest/v={max(done)}").first()[0])
        return max(done), held["versions"], held["totals"]

    def block(self, dx: int = 0, dy: int = 0) -> Column:
        """The bucket of the block of a tile or of one beside it."""
        place = [F.floor((F.col(c) + d) / BLOCK) for c, d in (("tx", dx), ("ty", dy))]
        return F.pmod(F.xxhash64(*self.key[:-2], *place), F.lit(BUCKETS)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of these buckets, of all if none are named."""
        held = {int(b): v for b, v in self.versions[name].items()}
        paths = [f"{self.folder}/{name}/v={held[b]}/bucket={b}" for b in (held if buckets is None else buckets) if held.get(b) is not None]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def write(self, name: str, rows: DataFrame, bucket: Column, buckets: list[int], n: int) -> None:
        """The new content of these buckets; one without rows is noted as empty."""
        path = f"{self.folder}/{name}/v={n}"
        rows.select(*self.schemas[name].names, bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        system, where = file_system(self.spark, f"{path}/bucket=*")
        full = {int(f.getPath().getName().split("=")[1]) for f in system.globStatus(where) or []}
        self.versions[name] |= {str(b): n if b in full else None for b in buckets}

    def commit(self, n: int) -> None:
        row = json.dumps({"versions": self.versions, "totals": self.totals})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v={n}")


def _by_name(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _some(rows: DataFrame, *buckets: Column) -> list[int]:
    """Numbers of the buckets that rows touch, at most ``BUCKETS``."""
    return sorted(r[0] for r in rows.select(F.explode(F.array_distinct(F.array(*buckets)))).distinct().collect())


def _facing(rows: DataFrame, key: list[str], sides: Column) -> DataFrame:
    """(columns of rows, side, nx, ny): the neighbouring tile over each of the sides named in an array."""
    step = F.create_map(*[x for s, (dx, dy) in _SIDES.items() for x in (F.lit(s), F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")))])
    each = rows.withColumn("side", F.explode(sides))
    return each.withColumn("_d", step[F.col("side")]).withColumns({"nx": F.col("tx") + F.col("_d.dx"), "ny": F.col("ty") + F.col("_d.dy")}).drop("_d")


def roots_of(state: State, names: DataFrame) -> DataFrame:
    """(name, root): where names lead, over as many steps as it takes; a name that leads nowhere is its own root."""
    found = stored(names.select("name", F.col("name").alias("root")).distinct(), "roots")
    while True:
        links = state.read("names", _some(found.select("root"), _by_name("root")))
        moved = found.join(links.withColumnsRenamed({"name": "root", "into": "_into"}), "root", "left")
        if moved.where("_into IS NOT NULL").isEmpty():
            return found
        found = stored(moved.select("name", F.coalesce("_into", "root").alias("root")), "roots")


def fold(batch: DataFrame, n: int, folder: str, limits: detect.Limits = detect.Limits()) -> None:
    """Takes batch ``n`` into the state and writes its events, (cluster, op, facts, seq), to ``folder``/events/v=n. A tile that was done before is left out, so a message that
    comes twice counts once; one that failed may be done later."""
    spark = batch.sparkSession
    with scratch(spark):
        state = State(spark, folder, batch.schema, n)
        key = state.key
        sent = stored(batch, "batch")
        near = [state.block(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        blocks = _some(sent, *near)
        old_tiles = stored(state.read("tiles", blocks), "old-tiles")
        done = old_tiles.where("NOT failed")
        fresh = stored(sent.where("NOT failed").dropDuplicates(key).join(done, key, "left_anti"), "fresh")
        tiles = fresh.select(*key)
        frags = stored(fresh.select(*key, F.explode("frags").alias("f")).select(*key, "f.*"), "new-fragments")

        # who is met: edge fragments around, those that pair with a new one, and those with a side towards a new tile
        edges = state.read("edges", blocks)
        around = F.array(*[F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        beside = tiles.select(*key[:-2], F.explode(around).alias("t")).select(*key[:-2], "t.tx", "t.ty").distinct()
        edges_near = stored(edges.join(beside, key, "left_semi"), "edges-near")
        pairs = stored(detect.merge_pairs(frags.unionByName(edges_near), limits), "pairs")
        own = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in _SIDES]))
        towards = tiles.withColumnsRenamed({"tx": "nx", "ty": "ny"})
        faced = _facing(edges_near, key, own).join(towards, [*key[:-2], "nx", "ny"], "left_semi").select(F.col("frag").alias("name"))
        both = pairs.select(F.col("a").alias("name")).union(pairs.select("b"))
        met = both.join(frags.select(F.col("frag").alias("name")), "name", "left_anti").union(faced).distinct()
        roots = stored(roots_of(state, met), "met")

        # the members of their clusters, and the roots they will have
        homes = _some(roots, _by_name("root"))
        touched = roots.select(F.col("root").alias("cluster")).distinct()
        held = state.read("members", homes)
        members = stored(held.join(touched, "cluster", "left_semi"), "members")
        named = lambda c: pairs.join(roots.withColumnsRenamed({"name": c, "root": f"root_{c}"}), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).select("a", "b")
        pairs = named("a")
        links = stored(named("b").where("a <> b").distinct(), "links")
        into = stored(components(links).select(F.col("node").alias("cluster"), "root"), "into")
        scanned = done.select(*key).union(tiles).withColumnsRenamed({"tx": "nx", "ty": "ny"}).distinct()
        bare = _facing(frags, key, own).join(scanned, [*key[:-2], "nx", "ny"], "left_anti").groupBy("frag").agg(F.collect_set("side").alias("open"))
        nothing = F.array().cast("array<string>")
        arrived = frags.join(bare, "frag", "left").withColumn("open", F.coalesce("open", nothing)).withColumn("cluster", F.col("frag"))
        closed = _facing(members, key, F.col("open")).join(towards, [*key[:-2], "nx", "ny"], "left_semi").groupBy("frag").agg(F.collect_set("side").alias("closed"))
        stayed = members.join(closed, "frag", "left").withColumn("open", F.array_except("open", F.coalesce("closed", nothing))).drop("closed")
        columns = state.schemas["members"].names
        all_now = stored(stayed.select(*columns).union(arrived.select(*columns)).join(into, "cluster", "left").withColumn("cluster", F.coalesce("root", "cluster")).select(*columns), "now")

        # what changed
        facts = lambda rows: detect.summed(rows.withColumn("cut", F.size("open") > 0), limits).where("shown")
        events = changes(facts(members), facts(all_now)).withColumn("seq", F.lit(n).cast("long"))
        events.write.mode("overwrite").parquet(f"{folder}/events/v={n}")

        # the buckets that were touched
        homes = sorted({*homes, *_some(all_now, _by_name("cluster"))})
        kept = state.read("members", homes).join(touched, "cluster", "left_anti")
        state.write("members", kept.select(*columns).union(all_now), _by_name("cluster"), homes, n)
        led = roots.select("name", F.col("root").alias("cluster")).union(into.select(F.col("cluster").alias("name"), "cluster")).distinct()
        led = led.join(into, "cluster", "left").select("name", F.coalesce("root", "cluster").alias("into")).where("name <> into").distinct()
        led = stored(led, "names")
        if buckets := _some(led, _by_name("name")):
            rest = state.read("names", buckets).join(led, "name", "left_anti")
            state.write("names", rest.union(led), _by_name("name"), buckets, n)
        if buckets := _some(frags.where("edge"), state.block()):
            state.write("edges", state.read("edges", buckets).unionByName(frags.where("edge")), state.block(), buckets, n)
        news = sent.select(*key, "failed").groupBy(*key).agg(F.min("failed").alias("failed"))
        if buckets := _some(news, state.block()):
            every = state.read("tiles", buckets).union(news).groupBy(*key).agg(F.min("failed").alias("failed"))
            state.write("tiles", every, state.block(), buckets, n)
        _count(state, tiles, frags, news, old_tiles)
        state.commit(n)


def _count(state: State, tiles: DataFrame, frags: DataFrame, news: DataFrame, old: DataFrame) -> None:
    """Tiles done, failed and with water, and the area swept, so far."""
    key = state.key
    z = F.col("z") if "z" in key else F.lit(ZOOM)
    side = geo.TILE * geo.metres_per_pixel(geo.lat_of((F.col("ty") + 0.5) * geo.TILE, z), z)
    done, swept = tiles.agg(F.count("*"), F.coalesce(F.sum(side * side), F.lit(0.0))).first()
    failed = news.where("failed").join(old, key, "left_anti").count() - news.where("NOT failed").join(old.where("failed"), key, "left_semi").count()
    more = {"done": done, "failed": failed, "wet": frags.select(*key).distinct().count(), "swept_m2": swept}
    state.totals = {c: state.totals[c] + v for c, v in more.items()}


def keep_merged(feed: DataFrame, folder: str, checkpoint: str, limits: detect.Limits = detect.Limits()):
    """Starts a query that merges the messages of ``feed`` into the state in ``folder``; stopping and starting again resumes."""
    return feed.writeStream.foreachBatch(lambda batch, n: fold(batch, n, folder, limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detections(spark: SparkSession, folder: str, feed: StructType, limits: detect.Limits = detect.Limits()) -> DataFrame:
    """All clusters so far, as ``detect.detections`` gives them."""
    return detect.summed(State(spark, folder, feed).read("members").withColumn("cut", F.size("open") > 0), limits)


def events(spark: SparkSession, folder: str, feed: StructType) -> DataFrame:
    """The events of all batches that were committed."""
    last = State(spark, folder, feed).before
    return spark.read.parquet(f"{folder}/events").where(F.col("seq") <= (-1 if last is None else last)).drop("v")


def progress(spark: SparkSession, folder: str, feed: StructType) -> dict:
    """Tiles done, failed and with water, and square metres swept."""
    return State(spark, folder, feed).totals


class ProgressLog(StreamingQueryListener):
    """Calls ``told`` with a dictionary for each batch of any query: its number, rows and seconds."""

    def __init__(self, told):
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told({"batch": p.batchId, "rows": p.numInputRows, "seconds": (p.batchDuration or 0) / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
