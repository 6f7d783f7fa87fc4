"""Exact sparse top-k that leaves out blocks which cannot enter the answer.

Documents of similar total weight share a block, and each block keeps the largest weight of
each of its terms. The sum of a question's weights times these is the most a document of the
block can score. Blocks are scored in rounds, the most promising first; after each round the
k-th score found is a question's bar, and a block below its bar is never scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.vectors import CORPUS_GATES, QUESTION_GATES, _final, _schema, _with_gates, sparse_scorer
from lexframe.session import cut_lineage

#: Levels of total weight at most; a level of more documents is dealt over several blocks.
MAX_LEVELS = 256
BLOCK_ROWS, CHUNK_ROWS = 2_000, 64
#: Blocks of a question in the first round; each further round takes four times as many.
FIRST, GROWTH = 2, 4
#: Scores are rounded to six places, so that a bound may lie below a score by so much.
SLACK = 2e-6


def blocked(postings: DataFrame, d_key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Postings with the block of their document. Levels are cut at quantiles of the documents' total
    weights; an estimate moves a block's borders, never a result."""
    totals = cut_lineage(postings.groupBy(d_key).agg(F.sum("weight").alias("_total")), "totals")
    n = totals.count()
    levels = max(1, min(MAX_LEVELS, n // block_rows))
    parts = max(1, -(-n // (levels * block_rows)))
    cuts = totals.agg(F.percentile_approx("_total", [i / levels for i in range(1, levels)] or [0.5], 10_000)).first()[0] or []
    level = sum((F.when(F.col("_total") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)) if levels > 1 else F.lit(0)
    block = (level * parts + F.pmod(F.xxhash64(d_key), F.lit(parts))).cast("int")
    return postings.join(totals.select(d_key, block.alias("block")), d_key)


def block_maxima(postings: DataFrame, term: str = "term") -> DataFrame:
    """(block, term, top, postings)."""
    return postings.groupBy("block", term).agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("postings"))


def block_bounds(maxima: DataFrame, asked: DataFrame, q_key: str, term: str = "term") -> DataFrame:
    """(question, block, bound, postings, place): the most a document of a block can score, the best block first.
    Only blocks that share a term with the question."""
    both = asked.select(q_key, term, F.col("weight").alias("_w")).join(maxima, term)
    sums = both.groupBy(q_key, "block").agg(F.sum(F.col("_w") * F.col("top")).alias("bound"), F.sum("postings").alias("postings"))
    order = Window.partitionBy(q_key).orderBy(F.col("bound").desc(), "block")
    return sums.withColumn("place", F.row_number().over(order))


def _score_blocks(corpus: DataFrame, asked: DataFrame, visits: DataFrame, k: int, d_key: str, q_key: str, term: str) -> DataFrame:
    """Top k of each question in each block it visits. A block that many questions visit meets them in chunks."""
    counts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).cast("long").alias("_chunks"))
    chunk: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))
    left = corpus.join(counts, "block").withColumn("_chunk", chunk).drop("_chunks")
    right = visits.select(q_key, "block").join(counts, "block").withColumn("_chunk", F.pmod(F.xxhash64(q_key), F.col("_chunks"))).drop("_chunks")
    right = right.join(asked, q_key)
    keys = ["block", "_chunk"]
    run = sparse_scorer(k, d_key, q_key, term)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _schema(corpus, asked, d_key, q_key))


def pruned_topk(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    d_key: str = "doc_id",
    q_key: str = "question_id",
    term: str = "term",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(top k as ``sparse_topk`` gives it, work). work has, for each question, the postings of its terms and those in
    blocks that were scored."""
    asked = cut_lineage(_with_gates(questions, QUESTION_GATES, q_key, term, "weight"), "asked")
    wanted = _with_gates(corpus, CORPUS_GATES, d_key, term, "weight").join(asked.select(term).distinct(), term, "left_semi")
    wanted = cut_lineage(blocked(wanted, d_key, block_rows), "blocked")
    bounds = cut_lineage(block_bounds(block_maxima(wanted, term), asked, q_key, term), "bounds")
    last = bounds.agg(F.max("place")).first()[0] or 0
    found, scored, first, size = None, [], 0, FIRST
    while first < last:
        due = bounds.filter((F.col("place") > first) & (F.col("place") <= first + size))
        if found is not None:
            bars = found.filter(F.col("rank") == k).select(q_key, F.col("score").alias("_bar"))
            due = due.join(bars, q_key, "left").filter(F.col("_bar").isNull() | (F.col("bound") + SLACK >= F.col("_bar"))).drop("_bar")
        due = cut_lineage(due, "due")
        # Bounds fall with the place: without a block in this round none is due later.
        if due.isEmpty():
            break
        scored.append(due)
        more = _score_blocks(wanted, asked, due, k, d_key, q_key, term)
        found = more if found is None else found.drop("rank").unionByName(more)
        found = cut_lineage(_final(found, q_key, d_key, k), "found")
        first, size = first + size, size * GROWTH
    done = bounds.limit(0) if not scored else scored[0]
    for part in scored[1:]:
        done = done.unionByName(part)
    done = done.groupBy(q_key).agg(F.sum("postings").alias("scored"))
    work = bounds.groupBy(q_key).agg(F.sum("postings").alias("postings")).join(done, q_key, "left").fillna(0, "scored")
    if found is None:
        found = wanted.select(F.lit(None).cast(dict(asked.dtypes)[q_key]).alias(q_key), d_key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return found, work
