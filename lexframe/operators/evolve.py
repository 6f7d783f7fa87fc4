"""Monitoring: new documents, gaps, health, change digest, audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import lookup, present, text_of

# Health weights, limits, importance of events.
HEALTH_WEIGHTS = {
    "not_citable": 60.0,
    "expired": 30.0,
    "not_yet_effective": 5.0,
    "no_source": 15.0,
    "stale": 10.0,
    "no_articles": 10.0,
}
REVIEW_BELOW = 70.0
STALE_DAYS = 365
IMPORTANCE = {"repealed": 1, "amended": 2, "new_regulation": 3, "interpretation": 4}
OTHER_IMPORTANCE = 9
SAMPLES = 5


def new_documents(listing: DataFrame, known: DataFrame, url: str = "url", known_url: str = "source_url") -> DataFrame:
    """Listed documents whose normalised URL is not known; the first listing of a URL wins
    (smallest ``listed_no``)."""
    rows = listing.filter((F.trim(text_of("title")) != "") & (F.trim(text_of(url)) != "")).withColumn(
        "_url", T.normalize_url(F.col(url))
    )
    rest = [c for c in listing.columns if c != url]
    first = rows.groupBy("_url").agg(F.min_by(F.struct(*rest), "listed_no").alias("_f"))
    seen = known.filter(F.col(known_url).isNotNull()).select(T.normalize_url(F.col(known_url)).alias("_url"))
    return first.join(seen, "_url", "left_anti").select(F.col("_url").alias(url), "_f.*")


def new_titles(listing: DataFrame, known: DataFrame, title: str = "title") -> DataFrame:
    """Listed documents whose normalised title is not collected yet."""
    key = T.normalize_title(F.col(title), "collect")
    seen = known.select(key.alias("_k"))
    return listing.withColumn("_k", key).join(seen, "_k", "left_anti").drop("_k")


# ---------------------------------------------------------------- gaps


def gap_clusters(
    records: DataFrame, since: Column | None = None, samples: int = SAMPLES, add_topic=T.add_gap_topic
) -> DataFrame:
    """Failed answers per (topic, reason): count and the newest distinct samples.

    records: record_id, question, outcome, passed, created_at. All failures count, or those at or
    after ``since``. The samples are ranked
    before they are collected, so a hot topic never gathers its rows in one place.
    """
    failed = records.filter(~F.col("passed"))
    if since is not None:
        failed = failed.filter(F.col("created_at") >= since)
    # Equal questions are counted before their topic is read, so the word rules run once
    # per distinct question and a hot question is one row before the shuffle by topic.
    asked = failed.groupBy(
        "question",
        F.when(F.col("outcome") == "degraded", F.lit("degraded")).otherwise(F.lit("low_confidence")).alias("reason"),
    ).agg(
        F.count(F.lit(1)).alias("_times"), F.max("created_at").alias("_at"), F.min("record_id").alias("_id")
    )
    rows = add_topic(asked)
    counts = rows.groupBy("topic", "reason").agg(
        F.min("tax_type").alias("tax_type"), F.sum("_times").alias("occurrences")
    )
    newest = Window.partitionBy("topic", "reason").orderBy(F.col("_at").desc(), "_id")
    few = (
        rows.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= samples)
        .groupBy("topic", "reason")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "question"))), lambda s: s["question"]).alias("samples"))
    )
    return counts.join(few, ["topic", "reason"], "left")


def upsert_gaps(known: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """Merge by (topic, reason): ``record`` adds occurrences, ``persist`` replaces them.
    A union and one aggregate; samples of the known row come first."""
    tagged = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    if mode == "record":
        occurrences = F.sum("occurrences")
    elif mode == "persist":
        occurrences = F.max_by("occurrences", "_new")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_new", "samples"))), lambda s: s["samples"])
    samples = F.slice(F.array_distinct(F.flatten(lists)), 1, SAMPLES)
    return tagged.groupBy("topic", "reason").agg(
        F.max_by("tax_type", "_new").alias("tax_type"), occurrences.alias("occurrences"), samples.alias("samples")
    )


def gaps_by_type(gaps: DataFrame, regulations: DataFrame, names: str = "tax_types") -> DataFrame:
    """Occurrences and topics per tax type next to the published regulations of that type."""
    totals = gaps.groupBy("tax_type").agg(
        F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("topics")
    )
    supply = (
        regulations.filter(F.col("review_state") == "published")
        .select(F.explode(F.array_distinct(F.col(names))).alias("tax_type"))
        .groupBy("tax_type")
        .agg(F.count(F.lit(1)).alias("published_regulations"))
    )
    return totals.join(supply, "tax_type", "left").withColumns(
        {
            "tax_type": F.coalesce("tax_type", F.lit("未标注")),
            "published_regulations": F.coalesce("published_regulations", F.lit(0)),
        }
    )


def feedback_gaps(log: DataFrame, add_topic=T.add_gap_topic) -> DataFrame:
    """Answers marked as not helpful become gaps with reason ``user_feedback``."""
    bad = log.filter(~F.col("helpful")).groupBy("question").agg(F.count(F.lit(1)).alias("_times"))
    return add_topic(bad).groupBy("topic", F.lit("user_feedback").alias("reason")).agg(
        F.min("tax_type").alias("tax_type"), F.sum("_times").alias("occurrences")
    )


# ---------------------------------------------------------------- health, digest, audit


def health(regulations: DataFrame, articles: DataFrame, now: Column, key: str = "regulation_id") -> DataFrame:
    """Score from 100 down with the signals that cost points."""
    has = articles.select(key).distinct().withColumn("_has", F.lit(True))
    rows = regulations.join(has, key, "left")
    status = F.col("effect_status")
    signals = {
        "not_citable": status.isin("repealed", "superseded", "draft"),
        "not_yet_effective": status == "not_yet_effective",
        "expired": F.col("expiry_date") <= now,
        "no_source": F.trim(text_of("source_url")) == "",
        "no_articles": F.col("_has").isNull(),
        "stale": F.datediff(now, F.col("updated_at")) > STALE_DAYS,
    }
    score = F.lit(100.0)
    for name, holds in signals.items():
        score = score - F.when(F.coalesce(holds, F.lit(False)), HEALTH_WEIGHTS[name]).otherwise(0.0)
    return rows.withColumns(
        {
            "score": F.greatest(score, F.lit(0.0)),
            "signals": present([F.when(F.coalesce(h, F.lit(False)), F.lit(n)) for n, h in signals.items()]),
        }
    ).drop("_has")


def review_queue(scored: DataFrame, below: float = REVIEW_BELOW) -> DataFrame:
    return scored.filter(F.col("score") < below).orderBy("score")


def change_digest(events: DataFrame, since: Column | None = None, limit: int = 50) -> DataFrame:
    """The newest changes, then by importance: repealed, amended, new, interpretation."""
    rows = events if since is None else events.filter(F.col("created_at") >= since)
    newest = rows.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)
    return newest.withColumn(
        "importance", lookup(F.col("event_type"), IMPORTANCE, OTHER_IMPORTANCE)
    ).orderBy("importance", F.col("created_at").desc(), F.col("event_id").desc())


def audit_page(log: DataFrame, limit: int, actor=None, action=None, target=None) -> DataFrame:
    for name, value in (("actor", actor), ("action", action), ("target", target)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    return log.orderBy(F.col("occurred_at").desc(), F.col("log_id").desc()).limit(limit)


def discovery_events(found: DataFrame, impact: DataFrame, key: str = "url") -> DataFrame:
    """Event rows of new documents with the regulations they touch."""
    touched = impact.groupBy(key).agg(
        F.count(F.lit(1)).alias("impacted"), F.min("relation").alias("relation")
    )
    return found.join(touched, key, "left").select(
        key,
        "title",
        F.lit("new_regulation").alias("event_type"),
        F.lit("discovered").alias("status"),
        F.coalesce("impacted", F.lit(0)).alias("impacted"),
    )
