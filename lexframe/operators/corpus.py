"""Ingest and upkeep of a corpus: duplicates, idempotent import, reports, audits, review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import null_if_empty, text_of
from lexframe.operators.numbering import number_rows
from lexframe.operators.retrieval import official_status
from lexframe.operators.temporal import citable
from lexframe.session import cut_lineage

# Fields that a repair compares.
REPAIRABLE = (
    "title", "document_number", "issuer", "hierarchy_level", "publish_date", "effective_date", "expiry_date",
)
SAMPLE_TITLES = 8


# ---------------------------------------------------------------- duplicates


def longest_per_title(documents: DataFrame, key: str, title: str = "title", content: str = "content") -> DataFrame:
    """One document per normalised title: the longest content, the smallest key on ties."""
    rows = documents.withColumn("title_key", T.normalize_title(F.col(title), "clean"))
    rest = [c for c in documents.columns]
    best = F.struct(F.length(content).alias("n"), (-F.col(key)).alias("k"))
    return (
        rows.groupBy("title_key")
        .agg(F.max_by(F.struct(*rest), best).alias("_b"), F.count(F.lit(1)).alias("copies"))
        .select("title_key", "copies", "_b.*")
    )


def best_files(files: DataFrame, key: str, title: str = "title", number: str = "document_number", size: str = "size") -> DataFrame:
    """One file per title: with a document number first, then the larger; renumbered 1..n."""
    rows = files.withColumn("title_key", T.normalize_title(F.col(title), "collect"))
    best = F.struct((text_of(number) != "").alias("a"), F.col(size).alias("b"), (-F.col(key)).alias("c"))
    kept = (
        rows.groupBy("title_key")
        .agg(F.max_by(F.struct(*files.columns), best).alias("_b"))
        .select("title_key", "_b.*")
    )
    return number_rows(kept, key, "file_no")


# ---------------------------------------------------------------- import


def _keyed(df: DataFrame, title: Column) -> DataFrame:
    """Adds the two keys of a regulation, (domain, level, number) and (domain, level, title); a key without a name is
    null and equals none. Missing domains and levels are alike."""
    key = lambda name: F.when(name.isNotNull(), F.struct("domain_id", "hierarchy_level", name.alias("name")))
    return df.withColumns({"_n": key(null_if_empty(text_of("document_number"))), "_t": key(null_if_empty(title))})


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    for key in ("_n", "_t"):
        rows = rows.join(taken.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return rows


def new_regulations(batch: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Rows of the batch that an import in the given order adds. A row is there already if one of the library, or one
    that the batch added before it, has its number, or its title; a row that was left out stands in nobody's
    way. Rows with neither are always added.

    Of the rows still open, one that comes first under both its keys is added, and all others under these keys are
    left out; this is repeated until no row is open.
    """
    # Several rows of one place in the order keep the one they were read in.
    numbered = _keyed(batch.select("*", F.struct(order, F.monotonically_increasing_id().alias("_id")).alias("_at")), F.trim(text_of("title")))
    rows = cut_lineage(numbered, "batch")
    added = rows.filter(F.col("_n").isNull() & F.col("_t").isNull())
    open_rows = _without(rows.filter(F.col("_n").isNotNull() | F.col("_t").isNotNull()), _keyed(known, text_of("title")))
    open_rows = cut_lineage(open_rows, "open")
    while not open_rows.isEmpty():
        judged = open_rows
        for key, first in (("_n", "_first_n"), ("_t", "_first_t")):
            firsts = open_rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias(first))
            judged = judged.join(firsts, key, "left")
        leads = lambda key, first: F.col(key).isNull() | (F.col("_at") == F.col(first))
        taken = cut_lineage(judged.filter(leads("_n", "_first_n") & leads("_t", "_first_t")).select(*rows.columns), "taken")
        added = added.unionByName(taken)
        open_rows = cut_lineage(_without(open_rows, taken), "open")
    return added.select(*batch.columns)


def import_report(rows: DataFrame) -> DataFrame:
    """Counts of one import: rows carry status (imported, skipped, failed), requires_review
    and articles. Failures stay a table of their own (``import_failures``)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if((F.col("status") == "imported") & F.col("requires_review")).alias("for_review"),
        F.coalesce(F.sum(F.when(F.col("status") == "imported", F.col("articles"))), F.lit(0)).alias("articles"),
    )


def import_failures(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "failed")


# ---------------------------------------------------------------- audits


def repair_diff(stored: DataFrame, parsed: DataFrame, key: str, fields: Sequence[str] = REPAIRABLE, sets: Sequence[str] = ("tax_types",)) -> DataFrame:
    """One row per field that differs: (key, field, old, new). Sets compare without order."""
    a, b = stored.alias("a"), parsed.alias("b")
    changes = []
    for name in (*fields, *sets):
        if name not in stored.columns or name not in parsed.columns:
            continue
        old, new = F.col(f"a.{name}"), F.col(f"b.{name}")
        if name in sets:
            old, new = F.array_join(F.array_sort(old), ","), F.array_join(F.array_sort(new), ",")
        changes.append(
            F.when(
                ~old.eqNullSafe(new),
                F.struct(F.lit(name).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new")),
            )
        )
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    return joined.select(
        F.col(f"a.{key}").alias(key), F.explode(F.array_compact(F.array(*changes))).alias("_c")
    ).select(key, "_c.*")


def status_audit(regulations: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """Adds the official status by normalised title: ``outcome`` is changed, same, or
    unknown. official: title, aging text, abolish_date text."""
    table = (
        official.filter(F.trim(text_of("aging")) != "")
        .withColumn("_k", T.normalize_title(F.col("title"), "audit"))
        .groupBy("_k")
        .agg(F.max_by(F.struct("aging", "abolish_date"), "official_no").alias("_o"))
    )
    rows = regulations.withColumn("_k", T.normalize_title(F.col("title"), "audit")).join(table, "_k", "left")
    target = official_status(F.col("_o.aging"))
    return rows.withColumns(
        {
            "target_status": target,
            "abolish_date": T.clean_date(F.col("_o.abolish_date")),
            "outcome": F.when(F.col("_o").isNull(), F.lit("unknown"))
            .when(target.isNotNull() & ~target.eqNullSafe(F.col("effect_status")), F.lit("changed"))
            .otherwise(F.lit("same")),
        }
    ).drop("_k", "_o")


def status_report(audited: DataFrame, key: str, samples: int = SAMPLE_TITLES) -> DataFrame:
    """Changed regulations per target status with a few titles, most first."""
    changed = audited.filter(F.col("outcome") == "changed")
    first = Window.partitionBy("target_status").orderBy(key)
    few = (
        changed.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= samples)
        .groupBy("target_status")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda s: s["title"]).alias("titles"))
    )
    counts = changed.groupBy("target_status").agg(F.count(F.lit(1)).alias("regulations"))
    return counts.join(few, "target_status").orderBy(F.col("regulations").desc(), "target_status")


def regulation_windows(versions: DataFrame, as_of: Column, regulation: str = "regulation_id") -> DataFrame:
    """Execution window of each regulation from its version texts, and what to do with it.

    The window is read per version and reduced by aggregate, so the text of a regulation
    is never gathered. Only citable regulations with an open version count.
    """
    w = T.execution_window(F.col("content"))
    rows = versions.filter(citable(F.col("effect_status"))).withColumn("_w", w)
    best = F.struct(
        F.col("_w.end").alias("end"),
        F.col("_w.start").isNotNull().alias("has_start"),
        (-F.col("order_index")).alias("order"),
    )
    per = rows.groupBy(regulation).agg(
        F.max_by("_w", F.when(F.col("_w.end").isNotNull(), best)).alias("_best"),
        F.min("valid_from").alias("recorded_from"),
        F.every(F.col("valid_to").isNotNull()).alias("all_closed"),
    )
    start, end = F.col("_best.start"), F.col("_best.end")
    past = start.isNull() & (end < F.col("recorded_from"))
    expired = (end < as_of) | F.coalesce(past, F.lit(False))
    return per.filter(~F.col("all_closed") & end.isNotNull()).select(
        regulation,
        start.alias("window_start"),
        end.alias("window_end"),
        F.when(expired, F.lit("expired")).otherwise(F.lit("running")).alias("state"),
        F.when(start.isNull() & expired, F.lit("repeal")).otherwise(F.lit("set_interval")).alias("action"),
    )


# ---------------------------------------------------------------- review

# Review actions.
ACTIONS: Mapping[str, str] = {"approve": "published", "reject": "rejected"}


def review(regulations: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(regulations after the batch, audit rows). decisions: key, action, actor, note; one
    row per regulation, unknown actions are left out."""
    valid = decisions.filter(F.col("action").isin(*ACTIONS)).groupBy(key).agg(
        F.min(F.struct("action", "actor", "note")).alias("_d")
    )
    rows = regulations.join(valid, key, "left")
    target = F.when(F.col("_d.action") == "approve", F.lit("published")).when(
        F.col("_d.action") == "reject", F.lit("rejected")
    )
    audit = rows.filter(F.col("_d").isNotNull()).select(
        key,
        F.lit("knowledge.review_decision").alias("action"),
        F.col("_d.actor").alias("actor"),
        F.col("review_state").alias("from_state"),
        target.alias("to_state"),
        text_of("_d.note").alias("note"),
    )
    after = rows.withColumn("review_state", F.coalesce(target, "review_state")).drop("_d")
    return after, audit
