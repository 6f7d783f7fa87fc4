"""Quality counts and the rows of the whole pipeline next to plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lexframe.llm import quality, shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    bits = ["a", "die", "ähm", "#", "*x", "\n", "\n\n", "\t", " ", " ", "\U0001F600", "the cat sat on the mat and slept", "\r\n", "B%"]
    rows = [(i, " ".join(draw.choices(bits, k=draw.randrange(0, 120)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, "only\n\nonly\nonly"), (303, "w " * 40_000), (304, "x" * 100_000), (7, rows[7][1]), (None, "one two three")]
    return rows


def test_counts_against_plain_python(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).withColumnRenamed("n_chars", "n_words")
    found = quality.quality(docs, None).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((str(i), *counts(t)) for i, t in texts)
    assert all(r.kept != r.base_failed for r in found)
    assert quality.quality(docs.limit(0), None).count() == 0


def test_constrained_features_move_the_score_one_way(spark):
    draw = random.Random(4)
    clean = [" ".join(draw.choice("the of and house tree river walks quickly green".split()) + str(draw.randrange(40)) for _ in range(60)) for _ in range(300)]
    rows = [(i, t if i % 2 else t + " $$$ ### !!!" * 9, "en", "s", 1) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (0, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.quality(docs, model).collect()}
    assert sum(kept[i] == bool(i % 2) for i in kept) > 0.95 * len(kept)
    at = list(quality.FEATURES).index("symbol_share")
    import numpy as np

    base = np.array([quality.statistics(clean[1].encode())[1]] * 50)
    base[:, at] = np.linspace(0, 1, 50)
    assert (np.diff(model.score(base)) <= 1e-12).all()


def near(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def mixed(rows):
    """How often each row is taken, by the law of the queue."""
    size = {r: len(SPACE.findall(r[1])) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r] for r in rows if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, rest = {}, list(sources), 1.5 * sum(total.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        open_, rest = [s for s in open_ if s not in over], rest - sum(2 * total[s] for s in over)
        if not open_:
            break
    target |= share if open_ else {}
    queue = []
    for rank, s in enumerate(sources):
        own = sorted((hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest(), r) for r in rows if r[2] == s)
        end = 0
        for turn in range(2):
            for place, r in own:
                if end < target[s]:
                    queue.append(((end + size[r]) / target[s], rank, turn, place, r))
                end += size[r]
    taken, used = Counter(), 0
    for *_, r in sorted(queue):
        used += size[r]
        if used > sum(target.values()) + 0.5:
            break
        taken[r] += 1
    return taken


def shard_of(key, tree):
    def draw(name, weight):
        bits = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 16**13) / weight, name

    node, at = "", list(tree)
    for step in (lambda s: f"/{s.region}", lambda s: f"/{s.region}/{s.rack}", lambda s: f"/{s.region}/{s.rack}/{s.number}"):
        weights = Counter()
        for s in at:
            weights[step(s)] += s.weight
        node = min(draw(n, w) for n, w in weights.items())[1]
        at = [s for s in at if step(s) == node]
    return int(node.split("/")[-1])


def test_pipeline_rows_against_plain_python(spark, tmp_path):
    draw = random.Random(12)
    pool = [f"w{i}" for i in range(3_000)]
    secret = " ".join(draw.choices(pool, k=14))
    texts = [" ".join(draw.choices(pool, k=draw.randrange(20, 90))) for _ in range(120)]
    texts += [texts[0] + " more", texts[1].upper(), texts[2].replace("w1", "w2", 1), "12 34", None, "", f"{texts[5][:80]} {secret.upper()}, end"]
    texts += [" ".join(["x1"] + texts[9].split()[1:]), texts[9]]
    sources = ["b", "a", None, "c"]
    rows = [(i, t, sources[i % 7 % 4], 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in rows], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t, s) for i, t, s, _ in rows if t and any(map(str.isalpha, t))]
    sets = {}
    for i, t, _ in left:
        w = SPACE.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near(sets[a], sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    left = [r for r in left if group[r[0]] == r[0]]
    left = [r for r in left if secret not in re.sub(r"[^0-9a-z]+", " ", r[1].lower())]
    taken = mixed(left)
    want = Counter({(r[0], r[1], r[2], shard_of(r[0], shards.default_tree(16))): n for r, n in taken.items() if n})

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert Counter((r.doc_id, r.text, r.source, r.shard) for r in out.collect()) == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
