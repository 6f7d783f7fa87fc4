"""Validity intervals, version chains and point-in-time joins.

Validity is left-closed and right-open: ``[valid_from, valid_to)``; a null end is open.

Ordered work per article is done inside (article, time bucket) partitions, and a small
per-bucket summary carries the state across buckets. An article that owns a large part
of all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.common import as_col, epoch_seconds
from lexframe.rules.ontology import CITABLE_STATUSES


# ---------------------------------------------------------------- predicates


def in_force(start: Column, end: Column, moment: Column) -> Column:
    """Right-open validity; a null start is never in force."""
    return F.coalesce((start <= moment) & (end.isNull() | (end > moment)), F.lit(False))


def in_period(start: Column, end: Column, moment: Column) -> Column:
    """Closed on both ends (used for discount periods)."""
    return F.coalesce(moment.between(start, end), F.lit(False))


def status_as_of(start: Column, end: Column, moment: Column) -> Column:
    return F.when(in_force(start, end, moment), F.lit("effective")).otherwise(
        F.lit("out_of_range")
    )


def effect_status_at(
    start: Column, end: Column, moment: Column, repealed: Column, draft: Column
) -> Column:
    """Draft beats repealed beats the interval; an expired interval counts as repealed."""
    return (
        F.when(F.coalesce(draft, F.lit(False)), F.lit("draft"))
        .when(F.coalesce(repealed, F.lit(False)), F.lit("repealed"))
        .when(start.isNull() | moment.isNull() | (moment < start), F.lit("not_yet_effective"))
        .when(in_force(start, end, moment), F.lit("effective"))
        .otherwise(F.lit("repealed"))
    )


def citable(status: Column) -> Column:
    return F.coalesce(status.isin(*CITABLE_STATUSES), F.lit(False))


def citable_at(status: Column, start: Column, end: Column, moment: Column) -> Column:
    return citable(status) & in_force(start, end, moment)


# ---------------------------------------------------------------- bucketed order


def time_bucket(moment: Column, days: float) -> Column:
    """Number of the time bucket; a part of a day (1 / 24) gives finer buckets, for an
    article whose rows of one day are too many for one task."""
    return F.floor(epoch_seconds(moment) / F.lit(int(days * 86400))).cast("long")


def _by_bucket(rows: DataFrame, key: str, moment: str, days: float) -> DataFrame:
    return rows.withColumn("_bucket", time_bucket(F.col(moment), days)).repartition(key, "_bucket")


def _previous_buckets(keys: list[str]) -> Window:
    return (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def superseded_same_day(
    amendments: DataFrame, key: str, start: str, seq: str
) -> DataFrame:
    """Amendments that a later one of the same start replaced, for the report."""
    last = amendments.groupBy(key, start).agg(F.max(seq).alias("_last_seq"))
    return (
        amendments.join(last, [key, start])
        .filter(F.col(seq) < F.col("_last_seq"))
        .drop("_last_seq")
    )


def version_chain(
    amendments: DataFrame, key: str, start: str, seq: str, bucket_days: float = 7
) -> DataFrame:
    """Number the versions of each article and close each one where the next begins. Of
    several amendments with one start the last one (by ``seq``) survives."""
    # One exchange by (article, bucket) serves the same-start grouping, the summary, the
    # join and the window; both readers of it share the shuffled files.
    placed = _by_bucket(amendments, key, start, bucket_days)
    rest = [c for c in amendments.columns if c not in (key, start)]
    rows = (
        placed.groupBy(key, "_bucket", start)
        .agg(
            F.max_by(F.struct(*rest), F.col(seq)).alias("_last"),
            (F.count(F.lit(1)) - 1).alias("superseded_rows"),
        )
        .select(key, "_bucket", start, "_last.*", "superseded_rows")
    )
    summary = rows.groupBy(key, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.min(start).alias("_first")
    )
    over_buckets = Window.partitionBy(key).orderBy("_bucket")
    carried = summary.select(
        key,
        "_bucket",
        F.coalesce(F.sum("_n").over(_previous_buckets([key])), F.lit(0)).alias("_before"),
        F.lead("_first").over(over_buckets).alias("_next_first"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(start)
    return (
        rows.join(carried, [key, "_bucket"])
        .withColumn("version", F.col("_before") + F.row_number().over(inside))
        .withColumn("valid_to", F.coalesce(F.lead(start).over(inside), F.col("_next_first")))
        .withColumnRenamed(start, "valid_from")
        .drop("_bucket", "_before", "_next_first")
    )


def close_repealed(chain: DataFrame, repeals: DataFrame, key: str) -> DataFrame:
    """Apply repeals ``(key, repeal_date, basis)``: the open version of a repealed article
    keeps its start, ends at the repeal date and becomes ``repealed``."""
    first = repeals.groupBy(key).agg(F.min(F.struct("repeal_date", "basis")).alias("_repeal"))
    hit = F.col("valid_to").isNull() & (F.col("_repeal.repeal_date") >= F.col("valid_from"))
    hit = F.coalesce(hit, F.lit(False))
    return (
        chain.join(first, key, "left")
        .withColumn("repeal_basis", F.when(hit, F.col("_repeal.basis")))
        .withColumn(
            "effect_status",
            F.when(hit, F.lit("repealed")).otherwise(F.col("effect_status")),
        )
        .withColumn(
            "valid_to",
            F.when(hit, F.col("_repeal.repeal_date")).otherwise(F.col("valid_to")),
        )
        .drop("_repeal")
    )


def overlap_violations(
    versions: DataFrame,
    key: str,
    start: str = "valid_from",
    end: str = "valid_to",
    tie: str = "version_id",
    bucket_days: float = 7,
) -> DataFrame:
    """Versions that begin before an earlier version of the same article has ended.

    One pass: the running maximum of earlier ends decides, so the cost is linear and no
    pair of versions is built. An open end (null) is later than every start.
    """
    rows = _by_bucket(versions, key, start, bucket_days)
    open_end = F.col(end).isNull()
    summary = rows.groupBy(key, "_bucket").agg(
        F.max(end).alias("_max_end"), F.max(open_end).alias("_any_open")
    )
    earlier = _previous_buckets([key])
    carried = summary.select(
        key,
        "_bucket",
        F.max("_max_end").over(earlier).alias("_carry_end"),
        F.coalesce(F.max("_any_open").over(earlier), F.lit(False)).alias("_carry_open"),
    )
    inside = (
        Window.partitionBy(key, "_bucket")
        .orderBy(start, tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    latest_end = F.greatest(F.max(end).over(inside), F.col("_carry_end"))
    still_open = F.coalesce(F.max(open_end).over(inside), F.lit(False)) | F.col("_carry_open")
    return (
        rows.join(carried, [key, "_bucket"])
        .withColumn("_latest_end", latest_end)
        .withColumn("_still_open", still_open)
        .filter(F.col("_still_open") | (F.col("_latest_end") > F.col(start)))
        .drop("_bucket", "_carry_end", "_carry_open", "_latest_end", "_still_open")
    )


# ---------------------------------------------------------------- as-of joins


def asof_last_known(
    versions: DataFrame,
    probes: DataFrame,
    key: str,
    moment: str,
    version_columns: list[str],
    start: str = "valid_from",
    end: str = "valid_to",
    bucket_days: float = 7,
) -> DataFrame:
    """For each probe the version in force at its moment, by carrying the last known
    version forward. Linear in versions + probes; probes without one keep nulls, and so do
    those without a key or a moment.

    Versions of one article must not overlap (see ``overlap_violations``).
    """
    attrs = [start, end, *version_columns]
    probe_columns = [c for c in probes.columns if c not in (key, moment)]
    given = F.col(key).isNotNull() & F.col(moment).isNotNull()
    without = [F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in attrs]
    unplaced = probes.filter(~given).select(key, moment, *probe_columns, *without)
    v = versions.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        key,
        F.col(start).alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct(*attrs).alias("_v"),
    )
    p = probes.filter(given).select(
        key,
        F.col(moment).alias("_at"),
        F.lit(1).alias("_kind"),
        F.struct(*probe_columns, F.lit(1).alias("_one")).alias("_p"),
    )
    rows = _by_bucket(v.unionByName(p, allowMissingColumns=True), key, "_at", bucket_days)
    summary = rows.groupBy(key, "_bucket").agg(
        F.max_by("_v", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last_v")
    )
    carried = summary.select(
        key,
        "_bucket",
        F.last("_last_v", ignorenulls=True).over(_previous_buckets([key])).alias("_carry"),
    )
    inside = (
        Window.partitionBy(key, "_bucket")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = (
        rows.join(carried, [key, "_bucket"])
        .withColumn(
            "_known",
            F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")),
        )
        .filter(F.col("_kind") == 1)
    )
    live = in_force(F.col(f"_known.{start}"), F.col(f"_known.{end}"), F.col("_at"))
    placed = known.select(
        key,
        F.col("_at").cast(probes.schema[moment].dataType).alias(moment),
        *[F.col(f"_p.{c}").alias(c) for c in probe_columns],
        *[F.when(live, F.col(f"_known.{c}")).alias(c) for c in attrs],
    )
    return placed.unionByName(unplaced)


def asof_range_join(
    versions: DataFrame,
    probes: DataFrame,
    key: str,
    moment: str,
    version_columns: list[str],
    start: str = "valid_from",
    end: str = "valid_to",
    bucket_days: float = 7,
) -> DataFrame:
    """The same question as an equi-join on (article, time bucket) plus the interval test.

    A version is listed in each bucket it covers up to the last probe, so probes meet
    only versions of their own bucket. Overlapping versions give one row each.
    """
    horizon = probes.agg(F.max(moment).alias("_h")).scalar()
    attrs = [start, end, *version_columns]
    last = F.least(F.coalesce(F.col(end), horizon), horizon)
    listed = (
        versions.select(key, *attrs)
        .filter(F.col(start) <= horizon)
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    time_bucket(F.col(start), bucket_days), time_bucket(last, bucket_days)
                )
            ),
        )
    )
    asked = probes.withColumn("_bucket", time_bucket(F.col(moment), bucket_days))
    return asked.join(
        listed,
        (asked[key] == listed[key])
        & (asked["_bucket"] == listed["_bucket"])
        & (listed[start] <= asked[moment])
        & (listed[end].isNull() | (listed[end] > asked[moment])),
        "left",
    ).select(
        *[asked[c] for c in probes.columns],
        *[listed[c] for c in attrs],
    )


def latest_version(versions: DataFrame, key: str, order: str = "version") -> DataFrame:
    rest = [c for c in versions.columns if c != key]
    return (
        versions.groupBy(key)
        .agg(F.max_by(F.struct(*rest), as_col(order)).alias("_last"))
        .select(key, "_last.*")
    )


def version_history(versions: DataFrame, key: str) -> DataFrame:
    """All versions of each article, oldest first, with the length of each in days."""
    return versions.withColumn(
        "days_in_force", F.datediff(F.to_date("valid_to"), F.to_date("valid_from"))
    )
