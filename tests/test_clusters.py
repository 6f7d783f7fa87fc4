"""The clustered vector index next to the exact grid."""

from __future__ import annotations

import numpy as np
import pytest

from lexframe.functions import clusters as C
from lexframe.functions import vectors as V


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((30, 16))
    x = centres[draw.integers(0, 30, 3_000)] + 0.35 * draw.standard_normal((3_000, 16))
    x[7] = 0
    corpus = spark.createDataFrame([(i, v.tolist(), float(i % 3), None if i % 2 else 50.0) for i, v in enumerate(x)], "doc_id long, vector array<double>, valid_from_ts double, valid_to_ts double")
    asked = spark.createDataFrame([(i, (x[i] + 0.1).tolist(), 1.0 + i % 60) for i in range(0, 3_000, 50)], "question_id long, vector array<double>, asked_ts double")
    return corpus.cache(), asked.cache()


def rows(df):
    return sorted((r.question_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_exact_search_equals_the_grid(tables):
    corpus, asked = tables
    plain = corpus.select("doc_id", "vector"), asked.select("question_id", "vector")
    index = C.build(plain[0], cells=40)
    want = rows(V.dense_topk(*plain, 10))
    assert rows(C.topk(index, plain[1], 10, probes=1, exact=True)) == want
    assert sum(index.sizes) == 3_000 and len(want) == 600


def test_gates_hold_in_the_index(tables):
    corpus, asked = tables
    index = C.build(corpus, cells=40)
    assert rows(C.topk(index, asked, 5, probes=2, exact=True)) == rows(V.dense_topk(corpus, asked, 5))


def test_few_probes_find_most(tables):
    corpus, asked = (t.select(t.columns[0], "vector") for t in tables)
    index = C.build(corpus, cells=40)
    probes = C.tuned_probes(index, corpus, asked, 10)
    assert probes < 20
    near = {(q, d) for q, _, d, _ in rows(C.topk(index, asked, 10, probes=probes))}
    true = {(q, d) for q, _, d, _ in rows(V.dense_topk(corpus, asked, 10))}
    assert len(near & true) / len(true) >= 0.9


def test_blocks_and_chunks_change_nothing(tables, monkeypatch):
    corpus, asked = (t.select(t.columns[0], "vector") for t in tables)
    monkeypatch.setattr(C, "BLOCK_ROWS", 20)
    monkeypatch.setattr(C, "CHUNK_ROWS", 3)
    assert rows(C.topk(C.build(corpus, cells=40), asked, 10, exact=True)) == rows(V.dense_topk(corpus, asked, 10))


def test_far_cells_are_not_visited(tables):
    corpus, asked = (t.select(t.columns[0], "vector") for t in tables)
    index = C.build(corpus, cells=40)
    found = C.topk(index, asked, 10, probes=2)
    bars = found.filter("rank = 10").selectExpr("question_id", "score AS bar")
    more = C._probe(index, asked.join(bars, "question_id"), "question_id", 2, None).count()
    assert more < 0.6 * 38 * asked.count()
