"""The multiprobe search next to brute force."""

from __future__ import annotations

import numpy as np

from lexframe.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, id long, v string, bucket int"


def table(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema)


def run(spark, rows, schema=VECTORS, **options):
    out = {}
    for q, rank, i, score in neighbours.neighbours(table(spark, rows, schema), **options).collect():
        out.setdefault(q, {})[rank] = (i, score)
    return {q: [own[r] for r in range(1, len(own) + 1)] for q, own in out.items()}


def brute(rows, top=20, every=20):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for i, v in rows:
            for j, w in rows:
                if j == q and i != q and len(v) == len(w):
                    best[i] = max(best.get(i, -np.inf), float((v * w).sum()))
        if best:
            out[q] = sorted(((i, s) for i, s in best.items()), key=lambda x: (-x[1], x[0]))[:top]
    return out


def f32(x):
    return [float(a) for a in np.asarray(x, np.float32)]


def test_recall_and_scores_in_clusters(spark):
    draw = np.random.default_rng(0)
    centres = draw.standard_normal((40, 24))
    x = centres[draw.integers(0, 40, 9_000)] + 0.4 * draw.standard_normal((9_000, 24))
    x *= draw.uniform(0.5, 2, (9_000, 1))
    rows = [(i, f32(v)) for i, v in enumerate(x)]
    found = run(spark, rows)
    whole = np.array([v for _, v in rows])
    hits = []
    for q, own in found.items():
        scores = whole @ whole[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(len(scores)), -scores))[:20]
        assert len(own) == 20 and all(abs(s - scores[i]) < 1e-9 for i, s in own)
        assert own == sorted(own, key=lambda r: (-r[1], r[0])) and q not in dict(own)
        hits.append(len({i for i, _ in own} & set(want.tolist())) / 20)
    assert len(found) == 450 and np.mean(hits) >= 0.9


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, f32(draw.standard_normal(4))) for i in range(1, 30)]
    rows += [(0, [1.0, 2.0, 0.0, 0.0]), (20, None), (40, []), (60, [0.0] * 4), (80, [1.0, None, 0.0, 0.0])]
    rows += [(100, [float("nan")] * 4), (120, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(140, [1.0, 2.0]), (141, [3.0, 1.0]), (160, [5.0]), (3, rows[2][1]), (3, f32(draw.standard_normal(4)))]
    assert run(spark, rows) == brute(rows)


def test_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 1.0]) for i in range(900)] + [(1_000 + i, [0.5, 0.25]) for i in range(5)] + [(7, [1.0, 1.0])] * 50
    found = run(spark, rows)
    assert [i for i, _ in found[0]] == list(range(1, 21))
    assert [i for i, _ in found[20]] == list(range(20))
    assert [i for i, _ in found[1_000]] == list(range(20))


def test_doubles_and_empty(spark):
    schema = VECTORS.replace("float", "double")
    rows = [(i, [i / 7, 1.0 - i / 3]) for i in range(1, 45)]
    assert run(spark, rows, schema) == brute(rows)
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {}


def test_probe_sets_come_in_order():
    sets = neighbours.probe_sets(6, 60)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == 60
    assert all(not (s[j] and s[11 - j]) for s in sets for j in range(6))


def test_steps_prefer_near_borders():
    index = neighbours.Index(3, 1.0)
    index.k = 2
    steps = index.steps(np.array([[0.1, 0.45]]), 4)[0].tolist()
    assert steps == [[0, 0], [-1, 0], [0, -1], [-1, -1]]
