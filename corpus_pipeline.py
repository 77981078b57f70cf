"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cerulea.llm import stages
from cerulea.llm.common import read_table, stored

STAGES = [
    ("language ID", stages.identify_language),
    ("near-duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.assign_shards),
]

#: A conditional random field and the edges of a graph cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; tables of the stages lie in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
