"""Filters, search routes, fusion, boosts and rerank over tables of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.common import epoch_seconds, lookup, null_if_empty, text_of
from lexframe.operators.temporal import citable, in_force
from lexframe.rules import retrieval as R
from lexframe.rules.ontology import (
    CITABLE_LEVELS,
    EFFECT_STATUSES,
    HIERARCHY_LEVELS,
    NAME_IDENTIFIED_LEVELS,
    OFFICIAL_STATUS,
)

# ---------------------------------------------------------------- hard filters


def array_match(values: Column, wanted: Sequence[str], mode: str = "any") -> Column:
    """Relational match (any of the wanted values) or vector-store match (all of them)."""
    listed = F.array(*[F.lit(w) for w in wanted])
    if mode == "any":
        return F.coalesce(F.arrays_overlap(values, listed), F.lit(False))
    if mode == "all":
        return F.size(F.array_except(listed, F.coalesce(values, F.array().cast("array<string>")))) == 0
    raise ValueError(f"unknown mode {mode!r}")


def hard_filter(
    *,
    status: str = "effect_status",
    review: str = "review_state",
    domain: str | None = None,
    levels: str | None = None,
    tax_types: Sequence[str] = (),
    tax_mode: str = "any",
    tax_column: str = "tax_types",
    applies_to: Sequence[str] = (),
    hierarchy: Sequence[str] = (),
    region: Sequence[str] = (),
    document_number: str | None = None,
    as_of: Column | None = None,
    start: str = "valid_from",
    end: str = "valid_to",
) -> Column:
    """All conditions that must hold before anything is ranked, as one predicate."""
    keep = citable(F.col(status)) & F.coalesce(F.col(review) == "published", F.lit(False))
    if domain:
        keep = keep & (F.col("domain_id") == domain)
    if levels:
        keep = keep & F.col(levels).isin(*CITABLE_LEVELS)
    if tax_types:
        keep = keep & array_match(F.col(tax_column), tax_types, tax_mode)
    if applies_to:
        keep = keep & array_match(F.col("applies_to"), applies_to, "any")
    if hierarchy:
        keep = keep & F.col("hierarchy_level").isin(*hierarchy)
    if region:
        keep = keep & F.col("region_scope").isin(*region)
    if document_number:
        keep = keep & (F.col("document_number") == document_number)
    if as_of is not None:
        keep = keep & in_force(F.col(start), F.col(end), as_of)
    return keep


def article_match(article_no: Column, full_no: Column, wanted: str) -> Column:
    return (article_no == wanted) | full_no.contains(wanted)


def keyword_match(keyword: str, *columns: Column, ignore_case: bool = False) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | (
            F.lower(text_of(c)).contains(keyword.lower())
            if ignore_case
            else text_of(c).contains(keyword)
        )
    return hit


def status_rank(status: Column) -> Column:
    """Effective first, then partially repealed, then the rest in ontology order."""
    order = ["effective", "partially_repealed"]
    order += [s for s in EFFECT_STATUSES if s not in order]
    return lookup(status, {s: i for i, s in enumerate(order)}, len(order))


def hierarchy_rank(level: Column) -> Column:
    return lookup(level, {s: i for i, s in enumerate(HIERARCHY_LEVELS)}, len(HIERARCHY_LEVELS))


def structured_order() -> list[Column]:
    return [
        status_rank(F.col("effect_status")),
        hierarchy_rank(F.col("hierarchy_level")),
        F.col("publish_date").desc_nulls_last(),
    ]


def official_status(text: Column) -> Column:
    """Official validity wording to effect status; unknown wording stays null."""
    return lookup(F.trim(text), OFFICIAL_STATUS)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page and the total row count on every row of it."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", total)


# ---------------------------------------------------------------- citations, index rows


def citation_columns(df: DataFrame) -> DataFrame:
    number = null_if_empty(text_of("document_number"))
    title = null_if_empty(text_of("regulation_title"))
    full_no = null_if_empty(text_of("full_no"))
    identifier = F.coalesce(
        number,
        F.when(F.col("hierarchy_level").isin(*NAME_IDENTIFIED_LEVELS), title),
        F.lit(""),
    )
    return df.withColumns(
        {
            "identifier": identifier,
            "traceable": full_no.isNotNull() & (identifier != ""),
            "label": F.concat_ws(" ", F.coalesce(number, title, F.lit("未标注文号")), full_no),
        }
    )


def stable_point_id(version_id: Column) -> Column:
    digest = F.md5(version_id.cast("string"))
    return F.concat_ws(
        "-",
        *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))],
    )


def index_entries(
    articles: DataFrame,
    version_id: str = "version_id",
    title: str = "regulation_title",
    content: str = "content",
) -> DataFrame:
    """Rows that belong in the vector index: citable, published, with text."""
    body = F.trim(text_of(content))
    return (
        articles.filter(hard_filter())
        .filter(F.length(body) > 0)
        .withColumns(
            {
                "point_id": stable_point_id(F.col(version_id)),
                "dense_text": F.concat(text_of(title), F.lit("\n"), body),
                "content_hash": F.sha2(F.col(content), 256),
                "valid_from_ts": epoch_seconds(F.col("valid_from")),
                "valid_to_ts": epoch_seconds(F.col("valid_to")),
            }
        )
    )


def recheck(hits: DataFrame, regulations: DataFrame, key: str) -> DataFrame:
    """Drop hits whose row is no longer published and citable in the authoritative table."""
    live = regulations.filter(
        citable(F.col("effect_status")) & (F.col("review_state") == "published")
    )
    return hits.join(live.select(key), key, "left_semi")


def index_drift(expected: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Counts of ids on each side. One aggregate over the union, no outer join."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("i")).unionByName(
        indexed.select(key, F.lit(0).alias("e"), F.lit(1).alias("i"))
    )
    per_id = sides.groupBy(key).agg(F.max("e").alias("e"), F.max("i").alias("i"))
    return per_id.agg(
        F.count_if((F.col("e") == 1) & (F.col("i") == 1)).alias("in_both"),
        F.count_if((F.col("e") == 1) & (F.col("i") == 0)).alias("missing_in_index"),
        F.count_if((F.col("e") == 0) & (F.col("i") == 1)).alias("stale_in_index"),
    )


# ---------------------------------------------------------------- routes and fusion


def route(hits: DataFrame, name: str, q: str, d: str, order: Sequence[Column], depth: int):
    """Rank one route's hits per question from 1 and keep its depth."""
    w = Window.partitionBy(q).orderBy(*order)
    return (
        hits.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= depth)
        .select(q, d, F.lit(name).alias("route"), "rank")
    )


def fuse(
    routes: DataFrame,
    q: str = "question_id",
    d: str = "doc_id",
    weights: Mapping[str, float] = R.ROUTE_WEIGHTS,
    k: int = R.RRF_K,
) -> DataFrame:
    """Weighted reciprocal rank fusion, normalised by the best score of the question."""
    live = {name: w for name, w in weights.items() if w > 0}
    part = routes.filter(F.col(d).isNotNull() & F.col("route").isin(*live)).withColumn(
        "_part", lookup(F.col("route"), live) / (F.lit(k) + F.col("rank"))
    )
    fused = part.groupBy(q, d).agg(
        F.round(F.sum("_part"), 9).alias("rrf"),
        F.array_sort(F.collect_set("route")).alias("routes"),
        F.min("rank").alias("best_rank"),
    )
    top = F.max("rrf").over(Window.partitionBy(q))
    return fused.withColumn("score", F.when(top > 0, F.round(F.col("rrf") / top, 9)).otherwise(0.0))


def route_stats(routes: DataFrame, q: str = "question_id") -> DataFrame:
    return (
        routes.groupBy(q)
        .pivot("route", list(R.ROUTE_WEIGHTS))
        .agg(F.count(F.lit(1)))
        .na.fill(0, list(R.ROUTE_WEIGHTS))
    )


def boost(
    hits: DataFrame,
    as_of: Column,
    query_number: str = "query_document_number",
    boosts: Mapping[str, float] = R.BOOSTS,
) -> DataFrame:
    """Exact number, recent amendment, local penalty; never below zero."""
    age = F.datediff(as_of.cast("date"), F.col("valid_from").cast("date"))
    terms = {
        "exact_document_number": F.col("document_number") == F.col(query_number),
        "recent_amendment": age.between(0, R.RECENT_DAYS),
        "local_normative_penalty": F.col("hierarchy_level") == "local_normative",
    }
    total = F.col("score")
    detail = []
    for name, holds in terms.items():
        hit = F.coalesce(holds, F.lit(False))
        total = total + F.when(hit, F.lit(boosts.get(name, 0.0))).otherwise(0.0)
        detail.append(F.when(hit, F.lit(name)))
    return hits.withColumns(
        {
            "boosted": F.greatest(F.round(total, 9), F.lit(0.0)),
            "boost_detail": F.array_compact(F.array(*detail)),
        }
    )


def retrieval_intent(text: Column, words: Mapping[str, Sequence[str]] = R.INTENT_WORDS) -> Column:
    """Intent of the best placed word; earlier intents win ties, none is ``unknown``."""
    scored = []
    for intent, listed in words.items():
        weight = None
        for at, word in enumerate(listed):
            weight = (F.when if weight is None else weight.when)(
                text.contains(word), F.lit(len(listed) - at)
            )
        scored.append((intent, weight.otherwise(F.lit(0))))
    best = F.greatest(*[w for _, w in scored])
    out = F.when(F.coalesce(best, F.lit(0)) <= 0, F.lit("unknown"))
    for intent, weight in scored:
        out = out.when(weight == best, F.lit(intent))
    return out


def rerank_score(
    hits: DataFrame,
    intent: str = "intent",
    content: str = "content",
    hints: Mapping[str, Sequence[str]] = R.INTENT_HINTS,
    weights: Mapping[str, float] = R.RERANK_WEIGHTS,
) -> DataFrame:
    """Explainable score from rank, intent words, hierarchy, routes, level and status."""
    relevance = F.when(
        F.col("best_rank").isNotNull(),
        F.lit(1.0) / (F.lit(1.0) + F.lit(R.RANK_DECAY) * (F.col("best_rank") - 1)),
    ).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    matched = F.lit(0)
    for name, listed in hints.items():
        found = F.lit(0)
        for word in listed:
            found = found + text_of(content).contains(word).cast("int")
        matched = F.when(F.col(intent) == name, found).otherwise(matched)
    routes = F.size("routes")
    parts = {
        "relevance": relevance,
        "intent": F.least(matched / F.lit(2.0), F.lit(1.0)),
        "multi_route": F.when(
            routes >= 2, F.least(routes / F.lit(3.0), F.lit(1.0))
        ).otherwise(0.0),
        "hierarchy": lookup(F.col("hierarchy_level"), R.HIERARCHY_PRIOR, R.DEFAULT_PRIOR),
        "level": lookup(F.col("level_code"), R.LEVEL_VALUE, R.DEFAULT_LEVEL),
        "effect": lookup(F.col("effect_status"), R.EFFECT_VALUE, 0.0),
    }
    weighted = {n: F.lit(weights[n]) * c for n, c in parts.items()}
    total = sum(weighted.values(), F.lit(0.0))
    reasons = F.map_filter(
        F.create_map(*[x for n, c in weighted.items() for x in (F.lit(n), F.round(c, 4))]),
        lambda _, v: v != 0,
    )
    return hits.withColumns({"rerank": F.round(total, 4), "reasons": reasons})


def rerank(
    hits: DataFrame,
    q: str = "question_id",
    d: str = "doc_id",
    top_n: int = R.ANSWER_DEPTH,
    scorer=rerank_score,
    **options,
) -> DataFrame:
    """Order per question by the scorer (replaceable), boosted score and id; keep top N."""
    w = Window.partitionBy(q).orderBy(
        F.col("rerank").desc(), F.col("boosted").desc(), F.col(d)
    )
    return (
        scorer(hits, **options)
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= top_n)
    )
