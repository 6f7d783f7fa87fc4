"""Hybrid search for a table of questions over an index of vectors, postings and payload."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions import vectors as V
from lexframe.operators import retrieval as R
from lexframe.operators.temporal import in_force
from lexframe.rules import retrieval as RR
from lexframe.rules import text as TR

ROUTES = ("dense", "sparse", "structured")


def tag_mask(values: Column, names: Sequence[str]) -> Column:
    """Names of an array as bits, so that a task can test 'all of them' on whole blocks."""
    if len(names) > 62:
        raise ValueError("at most 62 names fit a mask")
    out = F.lit(0).cast("long")
    for i, name in enumerate(names):
        out = out + F.when(F.array_contains(values, name), F.lit(1 << i)).otherwise(F.lit(0))
    return F.coalesce(out, F.lit(0).cast("long"))


def index_tables(
    corpus: DataFrame, embed: Callable | None = None, dim: int = RR.DENSE_DIM, key: str = "doc_id"
) -> dict[str, DataFrame]:
    """Vectors and postings of the rows that may be retrieved; the hard filter comes first."""
    live = corpus.filter(R.hard_filter())
    text = live.withColumn("_t", F.concat_ws("\n", "title", "content"))
    return {
        "payload": live,
        "vectors": V.dense_vectors(text, key, "_t", embed, dim),
        "postings": V.term_weights(text, key, "_t"),
    }


def read_questions(
    questions: DataFrame, names: Sequence[str] = TR.TAX_TYPES, terms: Sequence[tuple] = TR.GLOSSARY
) -> DataFrame:
    """Adds number, tax mask, expanded text and the route switches to (question_id, text)."""
    text = F.col("text")
    rows = questions.withColumns(
        {
            "query_document_number": T.number_in_question(text),
            "expanded": T.expand_terms(text, terms),
            "sparse_only": T.forces_sparse(text),
            "tag_mask": tag_mask(T.names_with_aliases(text, names, terms), names),
        }
    )
    return rows.withColumn("is_expanded", F.col("expanded") != text)


def _gates(rows: DataFrame, payload: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Tag and validity columns of the payload on index rows."""
    gate = payload.select(
        key,
        tag_mask(F.col("tax_types"), names).alias("tag_mask"),
        R.epoch_seconds(F.col("valid_from")).alias("valid_from_ts"),
        R.epoch_seconds(F.col("valid_to")).alias("valid_to_ts"),
    )
    return rows.join(gate, key)


def hybrid_search(
    questions: DataFrame,
    index: Mapping[str, DataFrame],
    embed: Callable | None = None,
    dim: int = RR.DENSE_DIM,
    names: Sequence[str] = TR.TAX_TYPES,
    terms: Sequence[tuple] = TR.GLOSSARY,
    intents: Mapping = RR.INTENT_WORDS,
    hints: Mapping = RR.INTENT_HINTS,
    authoritative: DataFrame | None = None,
    weights: Mapping[str, float] = RR.ROUTE_WEIGHTS,
    available: Sequence[str] = ROUTES,
    top_n: int = RR.ANSWER_DEPTH,
    key: str = "doc_id",
) -> DataFrame:
    """Top citations of every question.

    questions: question_id, text, as_of (date); index: see ``index_tables``. A route that
    is not available gives no rows and is named in ``degraded``; the others still answer.
    """
    asked = read_questions(questions, names, terms).withColumn("asked_ts", R.epoch_seconds(F.col("as_of")))
    payload = index["payload"]
    q = "question_id"
    routes: list[DataFrame] = []
    stores: list[DataFrame] = []
    # One pass over the postings serves both text forms: even ids ask with the question
    # itself, odd ids with its expansion.
    if "sparse" in available:
        forms = asked.select(
            (F.col(q) * 2).alias("ask_id"), F.col("text").alias("_t"), "tag_mask", "asked_ts"
        ).unionByName(
            asked.filter("is_expanded").select(
                (F.col(q) * 2 + 1).alias("ask_id"), F.col("expanded").alias("_t"), "tag_mask", "asked_ts"
            )
        )
        asks = V.term_weights(forms, "ask_id", "_t").join(forms.drop("_t"), "ask_id")
        postings = _gates(index["postings"], payload, names, key)
        hits = V.sparse_topk(postings, asks, RR.ROUTE_DEPTH, d_key=key, q_key="ask_id")
        hits = hits.select(F.floor(F.col("ask_id") / 2).alias(q), F.col("ask_id") % 2 == 1, key, "rank").toDF(
            q, "_expanded", key, "rank"
        )
        routes.append(
            hits.filter("_expanded").select(q, key, F.lit("glossary_expansion").alias("route"), "rank")
        )
        stores.append(
            hits.filter(~F.col("_expanded")).select(q, key, F.lit("sparse").alias("route"), "rank")
        )
    if "dense" in available:
        wanted = asked.filter(~F.col("sparse_only"))
        vectors = V.dense_vectors(wanted, q, "text", embed, dim).join(wanted.select(q, "tag_mask", "asked_ts"), q)
        corpus = _gates(index["vectors"], payload, names, key)
        near = V.dense_topk(corpus, vectors, RR.ROUTE_DEPTH, d_key=key, q_key=q)
        stores.append(near.select(q, key, F.lit("dense").alias("route"), "rank"))
    if stores:
        both = stores[0]
        for other in stores[1:]:
            both = both.unionByName(other)
        equal = R.fuse(both, q, key, {"sparse": 1.0, "dense": 1.0})
        routes.append(R.route(equal, "semantic", q, key, [F.col("rrf").desc(), F.col(key)], RR.ROUTE_DEPTH))
    if "structured" in available:
        # Naming a document lifts neither of the gates that the other routes have.
        tags = F.col("tag_mask").bitwiseAND(tag_mask(F.col("tax_types"), names)) == F.col("tag_mask")
        by_number = (
            asked.filter(F.col("query_document_number").isNotNull())
            .join(payload, F.col("query_document_number") == F.col("document_number"))
            .filter(tags & in_force(F.col("valid_from"), F.col("valid_to"), F.col("as_of")))
        )
        ranked = R.route(
            by_number, "structured", q, key, [*R.structured_order(), F.col(key)], RR.STRUCTURED_DEPTH
        )
        routes.append(ranked)
    hits = routes[0]
    for other in routes[1:]:
        hits = hits.unionByName(other)
    if authoritative is not None:
        hits = R.recheck(hits, authoritative, key)
    fused = R.fuse(hits, q, key, weights).join(payload, key)
    full = fused.join(
        asked.select(q, "query_document_number", "as_of", R.retrieval_intent(F.col("text"), intents).alias("intent")), q
    )
    best = R.rerank(R.boost(full, F.col("as_of")), q, key, top_n, hints=hints)
    missing = [F.lit(n) for n in ROUTES if n not in available]
    degraded = F.array(*missing) if missing else F.array().cast("array<string>")
    return R.citation_columns(best.withColumnRenamed("title", "regulation_title")).withColumn("degraded", degraded)
