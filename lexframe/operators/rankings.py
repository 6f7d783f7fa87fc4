"""Small orders and sets of the answer and review desks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.rules import retrieval as R
from lexframe.rules.facts import BENEFIT_QUESTIONS

# Entries of an answer's list, open gaps and reviews on a page.
SHOWN, GAPS, REVIEWS = 5, 50, 200


def route_ranks(routes: DataFrame, q: str = "question_id", d: str = "doc_id", weights: Mapping[str, float] = R.ROUTE_WEIGHTS) -> DataFrame:
    """(question, document, ranks): the rank that each route with a weight gave a fused document, by route. Of a document
    listed twice by a route the later rank counts."""
    live = [name for name, w in weights.items() if w > 0]
    per = routes.filter(F.col(d).isNotNull() & F.col("route").isin(*live)).groupBy(q, d, "route").agg(F.max("rank").alias("rank"))
    pairs = F.array_sort(F.collect_list(F.struct("route", "rank")))
    return per.groupBy(q, d).agg(F.map_from_entries(pairs).alias("ranks"))


def open_gaps(gaps: DataFrame, limit: int = GAPS) -> DataFrame:
    """The open gaps that were met most, a page of them; equal ones by topic and reason."""
    return gaps.filter(F.col("status") == "open").orderBy(F.col("occurrences").desc(), "topic", "reason").limit(limit)


def units_in_order(units: DataFrame, regulation: str, order: str) -> DataFrame:
    """Adds `unit_rank`: the units of a regulation by usability, the best first, equal ones as they stand."""
    best = Window.partitionBy(regulation).orderBy(F.col("usability").desc(), order)
    return units.withColumn("unit_rank", F.row_number().over(best))


def asks_benefits(question: Column) -> Column:
    hit = F.lit(False)
    for word in BENEFIT_QUESTIONS:
        hit = hit | question.contains(word)
    return F.coalesce(hit, F.lit(False))


def shown_provisions(applicable: DataFrame, q: str, question: str, place: str, substance: str, shown: int = SHOWN) -> DataFrame:
    """The provisions that an answer lists, with `shown_rank`. Asked for benefits, those with most substance come first;
    else, and among equals, they keep their place."""
    weight = F.when(asks_benefits(F.col(question)), -F.col(substance)).otherwise(F.lit(0))
    listed = Window.partitionBy(q).orderBy(weight, place)
    return applicable.withColumn("shown_rank", F.row_number().over(listed)).filter(F.col("shown_rank") <= shown)


def notes_in_order(notes: Column) -> Column:
    """Notes without blank ones and without repeats, in the order of their first."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.array_distinct(notes), trimmed), lambda x: x != "")


def pending_regulations(regulations: DataFrame, key: str, domain: str | None = None, limit: int = REVIEWS, offset: int = 0) -> DataFrame:
    """A page of what waits for review, by title, so that alike ones are read together."""
    rows = regulations.filter(F.col("review_state") == "pending_review")
    rows = rows.filter(F.col("domain_id") == domain) if domain else rows
    return rows.orderBy("title", key).offset(offset).limit(limit)


def enqueue_plans(plans: DataFrame, question: Column, created_at: Column) -> DataFrame:
    """Review rows of candidate plans: (technique_code, risk_level, question, delivered_to_user, status, created_at)."""
    return plans.select(
        F.col("code").alias("technique_code"),
        "risk_level",
        F.substring(question, 1, 2000).alias("question"),
        F.lit(False).alias("delivered_to_user"),
        F.lit("pending").alias("status"),
        created_at.alias("created_at"),
    )


def pending_plans(reviews: DataFrame, limit: int = 100) -> DataFrame:
    """The plans that wait longest, a page of them."""
    return reviews.filter(F.col("status") == "pending").orderBy("created_at", "technique_code").limit(limit)
