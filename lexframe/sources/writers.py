"""Sinks: partitioned corpus tables, append-only records, index snapshots and refreshes.

An index is published by writing a new snapshot and then naming it; the old one stays
readable until then, and nothing is truncated first.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.operators.corpus import new_regulations
from lexframe.operators.temporal import citable
from lexframe.rules.ontology import CITABLE_LEVELS
from lexframe.session import cut_lineage


def write_corpus(regulations: DataFrame, articles: DataFrame, versions: DataFrame, path: str) -> None:
    """Three tables partitioned by domain; only citable levels get version rows."""
    regulations.write.mode("append").partitionBy("domain_id").parquet(f"{path}/regulations")
    articles.write.mode("append").partitionBy("domain_id").parquet(f"{path}/articles")
    kept = versions.filter(F.col("level_code").isin(*CITABLE_LEVELS))
    kept.write.mode("append").partitionBy("domain_id").parquet(f"{path}/versions")


def merge_corpus(regulations: DataFrame, articles: DataFrame, versions: DataFrame, path: str, name: str, key: str, order: str) -> None:
    """One import, known by its name: only regulations that the corpus does not hold yet, with their articles and
    versions. An import that is run again replaces what it wrote, and a second one of the same rows adds none;
    regulations with neither number nor title are told by all their columns."""
    spark = regulations.sparkSession
    try:
        known = spark.read.option("mergeSchema", "true").parquet(f"{path}/regulations").filter(F.col("import") != name)
    except AnalysisException:
        known = regulations.filter("false")
    row = F.struct(*[F.col(c) for c in regulations.columns]).alias("_row")
    held = known.select(row).distinct()
    new = cut_lineage(new_regulations(regulations, known, order).withColumn("_row", row).join(held, "_row", "left_anti").drop("_row"), "import")
    kept = new.select(key).distinct()
    tables = {"regulations": new, "articles": articles.join(kept, key, "left_semi")}
    tables["versions"] = versions.filter(F.col("level_code").isin(*CITABLE_LEVELS)).join(kept, key, "left_semi")
    for table, rows in tables.items():
        rows.write.mode("overwrite").partitionBy("domain_id").parquet(f"{path}/{table}/import={name}")


def append_records(records: DataFrame, path: str) -> None:
    """Audit, verification, evaluation and gate rows are only ever added."""
    records.write.mode("append").parquet(path)


def write_cleaned(documents: DataFrame, path: str) -> None:
    """Kept documents and rejected ones with the reason, from one plan. Rows carry
    ``reject_reason``; null means kept."""
    documents.withColumn("kept", F.col("reject_reason").isNull()).write.mode("overwrite").partitionBy(
        "kept"
    ).parquet(path)


# ---------------------------------------------------------------- snapshots


def publish_snapshot(table: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new snapshot, then make it the current one. If the write fails, for example
    because the embedder is down, the current snapshot has not been touched."""
    name = f"snapshot-{uuid.uuid4().hex}"
    table.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    row = [(time.time_ns(), name)]
    spark = table.sparkSession
    spark.createDataFrame(row, "published_ns bigint, name string").write.mode("append").parquet(
        f"{path}/_published"
    )
    return name


def current_snapshot(spark: SparkSession, path: str) -> str:
    last = spark.read.parquet(f"{path}/_published").agg(F.max_by("name", "published_ns")).first()[0]
    return f"{path}/{last}"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_snapshot(spark, path))


# ---------------------------------------------------------------- refresh by bucket

#: Files that the rows of one bucket are dealt to, side by side.
BUCKET_FILES = 8


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_version(rows: DataFrame, touched: DataFrame, path: str, key: str, name: str) -> None:
    """One version: the rows of the touched buckets, and then the manifest rows that make it count. A version of the same
    name is replaced, so that a repeated write changes nothing."""
    spark = rows.sparkSession
    known = manifest(spark, path)
    of = known.filter(F.col("version") == name).agg(F.max("sequence")).first()[0] if known is not None else None
    last = (known.agg(F.max("sequence")).first()[0] if known is not None else None) or 0
    sequence = of if of is not None else last + 1
    salt = F.pmod(F.xxhash64(F.col(key), F.lit("file")), F.lit(BUCKET_FILES))
    rows.repartition("bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={name}")
    noted = touched.select("bucket", F.lit(sequence).cast("long").alias("sequence"))
    noted.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={name}")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, sequence, version): which version wrote which buckets; None before the first."""
    try:
        return spark.read.schema("bucket int, sequence long, version string").parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def _current(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, version): the last version of each bucket."""
    return manifest(spark, path).groupBy("bucket").agg(F.max_by("version", "sequence").alias("version"))


def create_index(entries: DataFrame, path: str, key: str, buckets: int) -> None:
    """Index rows in hash buckets of the regulation. A refresh adds a version of the buckets it touches; a manifest
    names the last version of each, also of one that has lost all its rows."""
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _write_version(entries.withColumn("bucket", bucket_of(key, buckets)), every, path, key, "first")


def _stored(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """The rows of the last versions, or of those before the version `before`, if that was written already."""
    known = manifest(spark, path)
    if before is not None:
        limit = known.filter(F.col("version") == before).agg(F.max("sequence")).first()[0]
        known = known if limit is None else known.filter(F.col("sequence") < limit)
    last = known.groupBy("bucket").agg(F.max_by("version", "sequence").alias("version"))
    # A row for each bucket; partitions of other versions are not read.
    return spark.read.parquet(f"{path}/data").join(F.broadcast(last), ["bucket", "version"], "left_semi").drop("version")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path)


def reindex(changed: DataFrame, entries: DataFrame, path: str, key: str, buckets: int, name: str | None = None) -> None:
    """Replace the rows of the changed regulations by their present entries; a regulation
    without entries is taken down. Only the buckets of changed regulations are rewritten, as a version of
    their own. Running it twice, with or without a name, gives the same table."""
    spark = changed.sparkSession
    name = name or f"refresh-{uuid.uuid4().hex}"
    keys = cut_lineage(changed.select(key).distinct().withColumn("bucket", bucket_of(key, buckets)), "changed")
    touched = keys.select("bucket").distinct()
    keep = _stored(spark, path, name).join(F.broadcast(touched), "bucket", "left_semi").join(keys.select(key), key, "left_anti")
    fresh = entries.join(keys.select(key), key, "left_semi").withColumn("bucket", bucket_of(key, buckets))
    _write_version(keep.unionByName(fresh.select(*keep.columns)), touched, path, key, name)


def stale_versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that no bucket needs any more. Whoever owns the folder may delete them."""
    needed = _current(spark, path).select("version").distinct()
    return [r["version"] for r in manifest(spark, path).select("version").distinct().join(needed, "version", "left_anti").collect()]


def update_payload(payload: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Payload with changed columns replaced. Vectors live in a table of their own, so they
    are neither read nor computed again."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    rows = payload.join(renamed, key, "left")
    values = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return rows.withColumns(values).select(*payload.columns)


def purge(index: DataFrame, status: str = "effect_status") -> DataFrame:
    """Rows that may stay in the index."""
    return index.filter(citable(F.col(status)))
