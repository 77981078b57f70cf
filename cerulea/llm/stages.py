"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all of ``docs`` and keeps the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm import decontam, langid, mixing, neardup, sharding
from cerulea.llm.common import read_table, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: ``und`` goes (null text, no letter), and so does a text whose words agree on no language (score under 0.3).

    The field is learned from these documents' own lang column; the column itself stays as it was. Null ids and repeated rows are judged like others, each by its own
    text; an empty table gives no rows, and where no lang is given nothing can be told, so nothing stays.
    """
    found = langid.identified(docs.select(*COLUMNS), langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; rows with null ids, and rows with one id and other texts, are documents like others. Of
    rows that repeat id and text one stays. Texts without words all stay; an empty table gives no rows."""
    return neardup.without_near_duplicates(docs, *COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null ids, and rows with one id and other texts, are judged each by its own text. Rows that repeat id and text
    stay or go together; null and short texts stay; an empty table gives no rows."""
    docs = docs.select(*COLUMNS)
    gone = decontam.leaks(docs, read_table(spark, sf_dir, "benchmark")).select("own").distinct()
    return docs.withColumn("own", row_key()).join(gone, "own", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot of the mix and their place in it, which the next stage orders by; files go by them too. Every row has a place of its own, repeated
    rows and null ids included; an empty table gives no rows."""
    names = {c: f"_{c}" for c in COLUMNS if c != "doc_id"}  # names that no column of the mix has
    rows = mixing.mixed(docs.select("doc_id", "source", *[F.col(c).alias(n) for c, n in names.items()]), keep=tuple(names.values()))
    rows = rows.select("doc_id", *[F.col(n).alias(c) for c, n in names.items()], "mix_slot", "place")
    return rows.repartitionByRange("mix_slot", "place", "doc_id").sortWithinPartitions("mix_slot", "place", "doc_id")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, its place there, which follows the mix, and its virtual slot."""
    return sharding.shard_in_mix_order(docs, COLUMNS[1:]).select(*COLUMNS, "shard", "slot", "vslot")
