"""Relation edges and impact of new documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import contains_any, extract, text_of
from lexframe.operators.matching import match_titles
from lexframe.rules import text as R


def _number_tokens(sentence: Column, pattern: str) -> Column:
    return F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))


def _edge(kind: str, target: Column, sentence: Column, rank: int) -> Column:
    return F.struct(
        F.lit(kind).alias("relation_type"),
        target.alias("target_ref"),
        sentence.alias("evidence"),
        F.lit(R.RELATION_CONFIDENCE[kind]).alias("confidence"),
        F.lit(rank).alias("_rank"),
    )


def relation_edges(
    df: DataFrame,
    key: str,
    text: str = "text",
    own_number: str | None = None,
    repeal_word: str = R.REPEAL_WORD,
    number_token: str = R.NUMBER_TOKEN,
    based_on: str = R.BASED_ON,
    references: str = R.REFERENCES,
    supersedes: str = R.SUPERSEDES,
    law_title: str = R.LAW_TITLE,
) -> DataFrame:
    """Edges (relation_type, target_ref, evidence, confidence), the first evidence of each
    (type, target). Plain text gives none; a document is not related to itself."""
    columns = [key] + ([own_number] if own_number else [])
    sentences = df.select(
        *columns, F.posexplode(T.sentences_of(F.col(text))).alias("_at", "_s")
    )
    s = F.col("_s")
    repeals = F.when(
        s.contains(repeal_word),
        F.transform(
            _number_tokens(s, number_token),
            lambda n: _edge("repeals", T.normalize_brackets(T.without_space(n)), s, 0),
        ),
    )
    basis, target = extract(s, based_on, 1), extract(s, references, 1)
    amended = F.when(
        s.rlike(supersedes),
        F.transform(
            F.concat(
                F.regexp_extract_all(s, F.lit(law_title), F.lit(1)), _number_tokens(s, number_token)
            ),
            lambda n: _edge("amends", n, s, 3),
        ),
    )
    found = [
        repeals,
        F.when(basis.isNotNull(), F.array(_edge("based_on", basis, s, 1))),
        F.when(target.isNotNull(), F.array(_edge("references", target, s, 2))),
        amended,
    ]
    edges = sentences.select(
        *columns,
        "_at",
        F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("_e"),
    )
    if own_number:
        own = T.without_space(text_of(own_number))
        edges = edges.filter((own == "") | (T.without_space(F.col("_e.target_ref")) != own))
    return (
        edges.groupBy(key, "_e.relation_type", "_e.target_ref")
        .agg(F.min_by(F.struct("_e.evidence", "_e.confidence"), "_at").alias("_first"))
        .select(key, "relation_type", "target_ref", "_first.evidence", "_first.confidence")
    )


def repeal_targets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    edges = relation_edges(df, key, text)
    return edges.filter(F.col("relation_type") == "repeals").select(
        key, F.col("target_ref").alias("document_number"), "evidence"
    )


def named_titles(text: Column, patterns) -> Column:
    """array<struct(title, evidence)>; a title once, with its first evidence in pattern
    order."""
    hits = [
        F.zip_with(
            F.regexp_extract_all(text_of(text), F.lit(p), F.lit(1)),
            F.regexp_extract_all(text_of(text), F.lit(p), F.lit(0)),
            lambda t, e: F.struct(T.strip(t).alias("title"), T.strip(e).alias("evidence")),
        )
        for p in patterns
    ]
    return F.filter(F.concat(*hits), lambda h: F.length(h["title"]) > 0)


def document_kind(title: Column, text: Column) -> Column:
    def any_of(patterns):
        out = F.lit(False)
        for p in patterns:
            out = out | text_of(text).rlike(p)
        return out

    return (
        F.when(any_of(R.IMPACT_REPEALED), F.lit("repealed"))
        .when(any_of(R.IMPACT_AMENDED), F.lit("amended"))
        .when(contains_any(text_of(title), R.INTERPRETATION_WORDS), F.lit("interpretation"))
        .otherwise(F.lit("new_scenario"))
    )


def impact_edges(
    documents: DataFrame,
    regulations: DataFrame,
    key: str,
    title: str,
    text: str,
    regulation_key: str,
    regulation_title: str,
    repealed=R.IMPACT_REPEALED,
    amended=R.IMPACT_AMENDED,
) -> DataFrame:
    """Regulations that a document repeals or amends by title: the equal title first, then
    one that contains it or is contained in it; ``unknown`` titles are reported."""
    hits = documents.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("repealed").alias("relation"), named_titles(F.col(text), repealed).alias("hits")),
                F.struct(F.lit("amended").alias("relation"), named_titles(F.col(text), amended).alias("hits")),
            )
        ).alias("_r"),
    ).select(key, "_r.relation", F.posexplode("_r.hits").alias("_at", "_h"))
    named = (
        hits.groupBy(key, "relation", F.col("_h.title").alias("named_title"))
        .agg(F.min_by("_h.evidence", "_at").alias("evidence"))
        .withColumn("_name", T.normalize_title(F.col("named_title"), "impact"))
    )
    titles = regulations.select(
        F.col(regulation_key).alias("regulation_id"),
        T.normalize_title(F.col(regulation_title), "impact").alias("_title"),
    )
    return match_titles(named, titles, key, "_name", "regulation_id", "_title").drop(
        "_name", "_title"
    )
