"""Saved scans: immutable records by scan and version, and an index that is a log of saves and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.streaming.feed import latest

LISTED = 30
_INDEX = "id string, seq long, op string, name string, pools long, area_m2 double, zoom int"


def _log(spark: SparkSession, folder: str, row: tuple) -> None:
    spark.createDataFrame([row], _INDEX).coalesce(1).write.mode("append").parquet(f"{folder}/index")


def save(detections: DataFrame, folder: str, scan: str, saved_at: int, name: str, zoom: int) -> None:
    """Saves a scan's detections; a scan saved again gets a new version, the older one is no longer read."""
    spark, record = detections.sparkSession, f"{folder}/records/scan={scan}/saved_at={saved_at}"
    detections.write.mode("overwrite").parquet(record)
    n, area = spark.read.schema(detections.schema).parquet(record).agg(F.count("*"), F.coalesce(F.sum("area"), F.lit(0.0))).first()
    _log(spark, folder, (scan, saved_at, "add", name, n, float(area), zoom))


def remove(spark: SparkSession, folder: str, scan: str, at: int) -> None:
    _log(spark, folder, (scan, at, "remove", None, None, None, None))


def listed(spark: SparkSession, folder: str, most: int = LISTED) -> DataFrame:
    """The scans saved last, newest first."""
    return latest(spark.read.schema(_INDEX).parquet(f"{folder}/index")).drop("op").orderBy(F.desc("seq"), "id").limit(most)


def load(spark: SparkSession, folder: str, scan: str) -> DataFrame | None:
    """The last version of a scan, or None if there is none. Only that version's files are read."""
    last = latest(spark.read.schema(_INDEX).parquet(f"{folder}/index").where(F.col("id") == scan)).first()
    return spark.read.parquet(f"{folder}/records/scan={scan}/saved_at={last.seq}") if last else None
