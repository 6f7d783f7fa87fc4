"""Row numbers over a whole table without one task that sees it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexframe.session import cut_lineage


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        places = pa.array(np.arange(at + 1, at + n + 1)), pa.array(np.full(n, part, np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "_place", "_part"])
        at += n


def number_rows(df: DataFrame, key: str, name: str = "number", partitions: int | None = None) -> DataFrame:
    """1..n in the order of `key`, of any type that has an order, nulls first. Sampled bounds deal the rows to
    ranges; each task numbers its range, and the ranges' counts, one for each partition, give the
    offsets. Rows of one key are spread too, and follow one another in no given order."""
    spark = df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges, key, "_tie").sortWithinPartitions(key, "_tie").drop("_tie")
    schema = StructType([*df.schema.fields, StructField("_place", LongType()), StructField("_part", IntegerType())])
    rows = cut_lineage(rows.mapInArrow(_placed, schema), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    # As many rows as ranges.
    table = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    return rows.join(table, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
