"""Domain routing of questions by rule packs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.common import contains_any, text_of
from lexframe.rules import text as R


def pack_score(text: Column, pack: Mapping) -> Column:
    """An excluded word ends it; a keyword counts 1, a strong word 2."""
    score = F.lit(0)
    for weight, words in ((1, pack["keywords"]), (2, pack["include"])):
        for word in words:
            score = score + text.contains(word).cast("int") * weight
    return F.when(contains_any(text, pack["exclude"]), F.lit(0)).otherwise(score).cast("double")


def route_questions(
    df: DataFrame,
    text: str,
    packs: Sequence[Mapping] = R.DOMAIN_ROUTING,
    subscribed: Sequence[str] | None = None,
) -> DataFrame:
    """Adds domain_id, confidence, needs_clarification. Only active packs count, and only
    the subscribed ones if a list is given; an empty list matches nothing."""
    live = [
        p
        for p in packs
        if p["status"] == "active" and (subscribed is None or p["domain_id"] in subscribed)
    ]
    if not live:
        return df.withColumns(
            {
                "domain_id": F.lit(None).cast("string"),
                "confidence": F.lit(0.0),
                "needs_clarification": F.lit(False),
            }
        )
    body = text_of(text)
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-pack_score(body, p)).alias("neg"),
                    F.lit(i).alias("at"),
                    F.lit(p["domain_id"]).alias("id"),
                )
                for i, p in enumerate(live)
            ]
        )
    )
    out = df.withColumn("_ranked", ranked)
    best = -F.get("_ranked", F.lit(0))["neg"]
    second = -F.get("_ranked", F.lit(1))["neg"] if len(live) > 1 else F.lit(0.0)
    margin = F.lit(True) if len(live) == 1 else (best - second) >= R.ROUTE_MARGIN
    sure = (best >= R.ROUTE_CONFIDENT) & margin
    alone = second < R.ROUTE_AMBIGUOUS
    chosen = (best > 0) & (sure | alone)
    return out.withColumns(
        {
            "domain_id": F.when(chosen, F.get("_ranked", F.lit(0))["id"]),
            "confidence": F.when(best <= 0, F.lit(0.0)).otherwise(
                F.least(F.lit(1.0), F.round(best / R.ROUTE_FULL, 4))
            ),
            "needs_clarification": (best > 0) & ~chosen,
        }
    ).drop("_ranked")
