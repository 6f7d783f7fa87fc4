"""The filter audit next to a walk through every order."""

from __future__ import annotations

from itertools import permutations

import pytest

from lexframe.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, n long, failing int"
LONG = " ".join(f"w{i}" for i in range(60))


def walk(docs, labels):
    def fails(i, text):
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        out = {"A"} if len(words) < 50 else set()
        out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        earlier = [j for j, t, _ in docs if j is not None and (t or "") == text and i is not None and j < i]
        return out | ({"E"} if earlier else set())

    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (0, 0))
        marks[i] = (max(good, int(quality == 1)), max(bad, int(toxic == 1)))
    parts = {}
    for i, text, source in docs:
        good = marks.get(i, (0, 0)) if i is not None else (0, 0)
        parts.setdefault(source or "", []).append((fails(i, text or ""), *good))
    rows, total = {}, {}
    for part, own in parts.items():
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                left = [r for r in own if not r[0] & set(order[: step - 1])]
                out = [r for r in left if x in r[0]]
                total[part, x] = total.get((part, x), 0) + len(out)
                rows[part, "".join(order), step] = [
                    len(left) - len(out), len(out), sum(x in r[0] for r in own) - len(out),
                    sum(r[0] == {x} for r in own), sum(r[1] for r in out), sum(r[2] for r in out),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def run(spark, docs, labels):
    table = spark.createDataFrame([(i, t, s, "x", 5, 9) for i, t, s in docs], DOCS)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, n string")
    found = filter_audit.audit(table, marks).collect()
    assert len({(r[0], r[1], r[2]) for r in found}) == len(found)
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in found}


def test_orders_against_a_walk(spark):
    docs = [
        (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (3, LONG, None), (None, LONG, "a"), (None, LONG, "a"),
        (4, None, ""), (5, "", "a"), (6, "Ärger über alles", "b"), (7, LONG + " #", "b"), (8, LONG.upper(), "b"),
        (9, "a b " * 40_000 + "END", "b"), (10, "A|B\n" * 30, "a"), (11, "A|B\n" * 30, "b"), (7, LONG + " #", "b"), (-4, LONG + " x", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, None), (3, 0, 1), (7, None, 1), (7, 1, 0), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    assert run(spark, docs, labels) == walk(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    one = run(spark, [(1, LONG, "s")], [])
    assert len(one) == 600 and set(one.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_lattice_counts_every_order():
    edges = filter_audit.lattice(4)
    for i in range(4):
        assert sum(weight for _, f, weight in edges if f == i) == 24
    assert {w for s, _, w in edges if s == 0} == {6}


def test_letters_must_fit(spark):
    docs = spark.createDataFrame([], DOCS)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, letters="ABC")
