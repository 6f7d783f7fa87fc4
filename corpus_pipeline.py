"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexframe.llm.base import cut_lineage, table
from lexframe.llm.decontaminate import decontaminate_stage
from lexframe.llm.langid import language_stage
from lexframe.llm.mixing import mix_stage
from lexframe.llm.neardup import near_dedup_stage
from lexframe.llm.shards import shard_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("sharding", shard_stage),
]

#: The first two stages can't be said in SQL; the tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a known language, one of each near-duplicate group, free of the benchmark,
    mixed to the target weights, with a column `shard`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
