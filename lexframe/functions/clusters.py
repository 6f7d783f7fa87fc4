"""A clustered vector index: k-means cells, probed by a question, with exact scores inside.

Cells are fitted on a bounded sample; every row is assigned to its nearest one. A search
sends each question to its nearest cells only. As the widest angle of a cell is known, a
second round can go on with the cells that may still hold something better than the worst
of the k found, which makes the answer exact without scoring every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.functions.vectors import CORPUS_GATES, QUESTION_GATES, _final, _schema, _with_gates, dense_scorer, dense_topk
from lexframe.session import cut_lineage

#: Rows the cells are fitted on, for each cell, and cells at most (8 MB of centres at 256 dimensions).
FIT_PER_CELL, MAX_CELLS = 64, 4096
#: Rows and questions that meet in one task.
BLOCK_ROWS, CHUNK_ROWS = 20_000, 1_024
#: Questions that the number of probes is measured with, and the share of true neighbours asked for.
TRIALS, RECALL = 64, 0.95


@dataclass
class Clusters:
    """Unit centres, the cosine of the widest angle of each cell, its rows, and the assigned table."""

    centres: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    rows: DataFrame
    d_key: str
    vector: str


def _unit(column: pa.Array) -> np.ndarray:
    m = np.stack(column.to_numpy(zero_copy_only=False)).astype("float64")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fit_centres(corpus: DataFrame, d_key: str, vector: str, cells: int) -> np.ndarray:
    """Unit centres of at most `cells` clusters of a sample, drawn by a hash of the id."""
    drawn = corpus.filter(F.exists(vector, lambda x: x != 0)).orderBy(F.xxhash64(d_key), d_key).limit(cells * FIT_PER_CELL)
    sample = drawn.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), seed=11, distanceMeasure="cosine", maxIter=8).fit(cut_lineage(sample, "sample"))
    centres = np.stack(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def build(corpus: DataFrame, d_key: str = "doc_id", vector: str = "vector", cells: int | None = None) -> Clusters:
    """Assigns every row to its nearest cell. By default there are about as many cells as rows in one."""
    n = corpus.count()
    cells = min(MAX_CELLS, cells or max(2, int(np.sqrt(n))))
    centres = fit_centres(corpus, d_key, vector, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines = _unit(batch.column(vector)) @ centres.T if len(batch) else np.empty((0, len(centres)))
            best = cosines.argmax(1) if len(batch) else np.empty(0, int)
            found = pa.array(best, pa.int32()), pa.array(cosines[np.arange(len(best)), best], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "cell", "cosine"])

    gated = _with_gates(corpus, CORPUS_GATES, d_key, vector)
    fields = ", ".join(f"`{name}` {kind}" for name, kind in gated.dtypes)
    rows = cut_lineage(gated.mapInArrow(assign, f"{fields}, cell int, cosine double"), "cells")
    reach, sizes = np.ones(len(centres)), np.zeros(len(centres), int)
    for r in rows.groupBy("cell").agg(F.min("cosine").alias("reach"), F.count(F.lit(1)).alias("n")).collect():
        reach[r["cell"]], sizes[r["cell"]] = r["reach"], r["n"]
    return Clusters(centres, np.clip(reach, -1, 1), sizes, rows, d_key, vector)


def _best_possible(cosines: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The largest cosine that a row of each cell can have with a question."""
    return np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - np.arccos(reach)[None, :])) + 1e-9


def _probe(index: Clusters, questions: DataFrame, q_key: str, first: int, last: int | None) -> DataFrame:
    """Questions with each cell they visit: those from place `first` to `last` in the order of nearness. Without `last`,
    all that may reach the question's bar."""
    centres, reach, sizes, vector = index.centres, index.reach, index.sizes, index.vector

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                cosines = _unit(batch.column(vector)) @ centres.T
                cosines[:, sizes == 0] = -2
                order = np.argsort(-cosines, axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                go = (place >= first) & (cosines > -2)
                if last is not None:
                    go &= place < last
                else:
                    bar = batch.column("bar").to_numpy(zero_copy_only=False)
                    go &= _best_possible(cosines, reach) >= bar[:, None]
                who, cell = np.nonzero(go)
                taken = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in questions.dtypes)
    return questions.mapInArrow(visit, f"{fields}, cell int")


def _score(index: Clusters, visits: DataFrame, q_key: str, k: int) -> DataFrame:
    """The best rows of each visited cell. Large cells are cut into blocks, and many questions of one cell into chunks,
    by exact counts; each block and chunk meet in one task."""
    visits = cut_lineage(visits, "visits")
    asked = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    held = index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    parts = lambda c, rows: F.ceil(F.col(c) / F.lit(rows)).cast("long")
    # A row for each cell, `MAX_CELLS` at most.
    grid = F.broadcast(asked.join(held, "cell").select("cell", parts("held", BLOCK_ROWS).alias("_blocks"), parts("asked", CHUNK_ROWS).alias("_chunks")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    left = index.rows.drop("cosine").join(grid, "cell").withColumn("_block", own(index.d_key, "_blocks")).withColumn("_chunk", every("_chunks"))
    right = visits.drop("bar").join(grid, "cell").withColumn("_chunk", own(q_key, "_chunks")).withColumn("_block", every("_blocks"))
    keys = ["cell", "_block", "_chunk"]
    schema = _schema(index.rows, visits, index.d_key, q_key)
    run = dense_scorer(k, index.d_key, q_key, index.vector)
    return left.drop("_blocks", "_chunks").groupBy(*keys).cogroup(right.drop("_blocks", "_chunks").groupBy(*keys)).applyInArrow(run, schema)


def topk(index: Clusters, questions: DataFrame, k: int, q_key: str = "question_id", probes: int = 8, exact: bool = False) -> DataFrame:
    """(question, row, score, rank) of the k nearest found in the `probes` nearest cells. With `exact`, the cells that
    can hold a better row are visited too, and the result is that of `dense_topk`."""
    asked = _with_gates(questions, QUESTION_GATES, q_key, index.vector)
    found = _final(_score(index, _probe(index, asked, q_key, 0, probes), q_key, k), q_key, index.d_key, k)
    if not exact:
        return found
    found = cut_lineage(found, "near")
    bars = found.filter(F.col("rank") == k).select(q_key, F.col("score").alias("bar"))
    rest = asked.join(bars, q_key, "left").fillna(-2.0, "bar")
    more = _score(index, _probe(index, rest, q_key, probes, None), q_key, k)
    return _final(found.drop("rank").unionByName(more), q_key, index.d_key, k)


def tuned_probes(index: Clusters, corpus: DataFrame, questions: DataFrame, k: int, q_key: str = "question_id", recall: float = RECALL) -> int:
    """The fewest probes that find `recall` of the true neighbours of `TRIALS` questions, drawn by a hash."""
    trials = cut_lineage(questions.orderBy(F.xxhash64(q_key), q_key).limit(TRIALS), "trials")
    true = dense_topk(corpus, trials, k, index.d_key, q_key, index.vector).select(q_key, index.d_key)
    cells = true.join(index.rows.select(index.d_key, "cell"), index.d_key).join(trials.select(q_key, index.vector), q_key)
    rows = cells.select("cell", index.vector).toArrow()
    if not rows.num_rows:
        return 1
    cosines = _unit(rows[index.vector].combine_chunks()) @ index.centres.T
    cosines[:, index.sizes == 0] = -2
    place = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1, kind="stable")
    places = np.sort(place[np.arange(len(place)), rows["cell"].to_numpy()])
    return int(places[int(np.ceil(recall * len(places))) - 1]) + 1
