"""The live feed of detections: add, update and remove events folded into the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cerulea.sinks.shared import file_system, remove, scratch


def latest(events: DataFrame, key: str = "id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The last event of each key, unless it removes it. Later events win whatever order they come in; a maximum needs no sort and combines before the shuffle. Of two
    events of one key and ``seq`` the one with the greater columns, in their order, wins."""
    payload = [c for c in events.columns if c not in (key, seq)]
    last = events.groupBy(key).agg(F.max(F.struct(F.col(seq), F.struct(*payload).alias("last"))).alias("_m")).select(key, "_m.last", F.col(f"_m.{seq}").alias(seq))
    return last.select(key, seq, *[F.col(f"last.{c}").alias(c) for c in payload]).where(F.col(op) != "remove")


def open_feed(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Events as they land as Parquet files; ``files_per_trigger`` holds back a flood."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def changes(before: DataFrame, after: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, op, columns of ``after``): what turns one table of detections into the other. Rows that did not change give no event; the facts of a removed one are null."""
    facts = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*facts).alias("old"))
    both = old.join(after.select(key, F.struct(*facts).alias("new")), key, "full")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(key, op.alias("op"), "new.*").where(F.col("op").isNotNull())


def keep_state(feed: DataFrame, state: str, checkpoint: str, key: str = "id", seq: str = "seq", op: str = "op"):
    """Starts a query that keeps the last event of each key, removals included, as one Parquet version a batch in ``state``/v=N; stopping and starting again resumes.

    Every batch writes the whole state, so this is for small ones; ``keep_buckets`` writes only what a batch touches.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*batch.columns)
        if n > 0:
            fresh = fresh.unionByName(spark.read.schema(batch.schema).parquet(f"{state}/v={n - 1}"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
        fresh.withColumn("_r", rank).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{state}/v={n}")

    return feed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_buckets(feed: DataFrame, state: str, checkpoint: str, key: str = "id", seq: str = "seq", buckets: int = 64, after=None):
    """Starts a query that keeps the last event of each key, removals included; stopping and starting again resumes. ``read_state`` reads the folder ``state``.

    Keys are dealt over buckets by hash. A batch reads and writes anew only the buckets it touches, as version v=N of each; the version that a batch replaces goes with
    the next batch that touches the bucket, so a batch that is run again after a failure still finds what it started from. ``after(batch, n)``, if given, is called
    when a batch is folded in, for example to rank the state anew.
    """
    placed = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", placed)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        held = _versions(spark, state)
        old = {b: [v for v in held.get(b, []) if v < n] for b in touched}
        paths = [f"{state}/bucket={b}/v={max(v)}" for b, v in old.items() if v]
        rows = fresh.drop("bucket")
        if paths:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*paths))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
        last = rows.withColumn("_r", rank).where("_r = 1").drop("_r").withColumns({"bucket": placed, "v": F.lit(n)})
        last.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(state)
        for b, versions in old.items():
            for v in sorted(versions)[:-1]:
                remove(spark, f"{state}/bucket={b}/v={v}")
        if after:
            after(batch, n)

    return feed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """The versions that each bucket has; names of folders only, as many as buckets, twice."""
    system, where = file_system(spark, f"{state}/bucket=*/v=*")
    out: dict[int, list[int]] = {}
    for found in system.globStatus(where) or []:
        b, v = (int(part.split("=")[1]) for part in found.getPath().toString().rstrip("/").split("/")[-2:])
        out.setdefault(b, []).append(v)
    return out


def read_state(spark: SparkSession, state: str, schema: StructType, op: str = "op") -> DataFrame:
    """The last event of each key that does not remove it."""
    paths = [f"{state}/bucket={b}/v={max(v)}" for b, v in _versions(spark, state).items()]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where(F.col(op) != "remove")


def keep_ranking(feed: DataFrame, state: str, ranking: str, checkpoint: str):
    """The live ranking: each batch of (cluster, seq, op, area, confidence, ...) is folded into the state, which is then ranked anew into ``ranking``/v=N."""
    from cerulea.operators.detect import ranked

    def rank(batch: DataFrame, n: int) -> None:
        with scratch(batch.sparkSession):
            ranked(read_state(batch.sparkSession, state, batch.schema)).write.mode("overwrite").parquet(f"{ranking}/v={n}")
        if n > 1:
            remove(batch.sparkSession, f"{ranking}/v={n - 2}")

    return keep_buckets(feed, state, checkpoint, key="cluster", after=rank)
