"""Pruned sparse search next to the full grid."""

from __future__ import annotations

import numpy as np
import pytest

from lexframe.functions import impact as I
from lexframe.functions import vectors as V


@pytest.fixture(scope="module")
def postings(spark):
    draw = np.random.default_rng(4)
    docs = []
    for d in range(1_500):
        size = 200 if d % 100 == 0 else 12
        for t, n in zip(*np.unique(draw.zipf(1.4, size) % 300, return_counts=True), strict=True):
            docs.append((d, f"t{t}", float(np.sqrt(n)), float(d % 4), None if d % 3 else 9.0))
    asked = []
    for q in range(25):
        for t, n in zip(*np.unique(draw.zipf(1.4, 9) % 300, return_counts=True), strict=True):
            asked.append((q, f"t{t}", float(np.sqrt(n)), float(q % 12)))
    corpus = spark.createDataFrame(docs, "doc_id long, term string, weight double, valid_from_ts double, valid_to_ts double")
    return corpus.cache(), spark.createDataFrame(asked, "question_id long, term string, weight double, asked_ts double").cache()


def rows(df):
    return sorted((r.question_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_pruned_search_equals_the_grid_and_scores_less(postings):
    corpus, asked = (t.select(t.columns[0], "term", "weight") for t in postings)
    found, work = I.pruned_topk(corpus, asked, 5, block_rows=40)
    assert rows(found) == rows(V.sparse_topk(corpus, asked, 5))
    total, scored = work.selectExpr("sum(postings)", "sum(scored)").first()
    assert scored < 0.6 * total


def test_gates_hold_under_pruning(postings):
    corpus, asked = postings
    found, _ = I.pruned_topk(corpus, asked, 7, block_rows=30)
    assert rows(found) == rows(V.sparse_topk(corpus, asked, 7))


def test_levels_with_many_documents_are_dealt_over_blocks(postings, monkeypatch):
    corpus, asked = (t.select(t.columns[0], "term", "weight") for t in postings)
    monkeypatch.setattr(I, "MAX_LEVELS", 3)
    monkeypatch.setattr(I, "CHUNK_ROWS", 4)
    found, _ = I.pruned_topk(corpus, asked, 5, block_rows=40)
    assert rows(found) == rows(V.sparse_topk(corpus, asked, 5))


def test_nothing_shared(postings):
    corpus, asked = (t.select(t.columns[0], "term", "weight") for t in postings)
    found, work = I.pruned_topk(corpus.filter("term = 'none'"), asked, 5)
    assert found.count() == 0 and work.count() == 0
