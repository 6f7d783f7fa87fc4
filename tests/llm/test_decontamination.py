"""Benchmark decontamination next to plain Python, with the hashes sent and with the join."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from lexframe.llm import decontaminate

DOCS = "doc_id long, text string, len int, h string, pos string, places int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(FOLD) for w in WORD.findall(text or "")]


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            for k in range(len(own) - n + 1):
                if n and tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        ids = ",".join(sorted(found))
        out.append((str(i), len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(3)
    pool = [f"w{i}" for i in range(60)] + ["Über", "ÉTÉ", "日本語", "É"]
    items = [(k, " ".join(draw.choices(pool, k=draw.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(20, items[3][1]), (None, " ".join(draw.choices(pool, k=12))), (21, None), (22, ""), (23, "...")]
    docs = []
    for i in range(120):
        parts = draw.choices(pool, k=draw.randrange(0, 60))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(parts) + 1)
            parts[at:at] = (draw.choice(items)[1] or "").upper().replace(" ", draw.choice([" ", ", ", "\n-"])).split(" ")
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (5, docs[5][1]), (None, items[4][1]), (202, "x " * 20_000 + items[5][1])]
    frame = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(k, t, 7) for k, t in items], "item_id long, text string, hash int")
    return docs, items, frame.cache(), bench.cache()


@pytest.mark.parametrize("sent", [50_000, 0])
def test_hits_against_plain_python(tables, sent):
    docs, items, frame, bench = tables
    rows = decontaminate.contamination(frame, bench, sent=sent).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == brute(docs, items)


@pytest.mark.parametrize("sent", [50_000, 0])
def test_clean_and_cut(tables, sent):
    docs, items, frame, bench = tables
    truth = {(i, h) for i, _, h, *_ in brute(docs, items)}
    kept = decontaminate.clean(frame, bench, sent=sent)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, *_, bad in brute(docs, items) if not bad)
    cut = decontaminate.cut_spans(frame, bench, sent=sent).collect()
    assert len(cut) == len(docs)
    for r in cut:
        left = len(words(r.text))
        assert (str(r.doc_id), len(words(next(t for i, t in docs if i == r.doc_id))) - left) in truth


def test_empty_tables(spark, tables):
    docs, _, frame, bench = tables
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    rows = decontaminate.contamination(frame, bench.filter("item_id = 23")).collect()
    assert len(rows) == len(docs) and not any(r.contaminated for r in rows)
