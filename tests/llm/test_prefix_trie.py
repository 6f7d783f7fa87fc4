"""The prefix trie next to a plain walk, and its queue next to a sorted list."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lexframe.llm import prefix_trie
from lexframe.llm.prefix_trie import SpillingQueue

TURNS = "conv_id long, turn int, role string, text string, depth long, top string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 0 - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seq = own.get(base, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    out = {}
    for p in nodes:
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        ends = sorted(c for c, end in nodes[p] if end)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[p] = (min(c for c, _ in nodes[p]), len(p), parent, len(nodes[p]), children, len(leaves), saved, digest)
    return sorted(out.values(), key=repr)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)
    found = prefix_trie.prefix_trie(table.repartition(5), **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed, n, long=()):
    draw = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 200, 205, 1000003]:
        for turn in range(long[c] if c in long else draw.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["hi", "hello there", "ä", "x" * 50])))
    return rows


def test_trie_against_a_walk(spark):
    rows = conversations(1, 40)
    rows += [(300, None, None, None), (300, 0, "user", ""), (None, 0, "user", "lost"), (301, 1, "user", None)]
    rows += [(7, 2, "user", "same turn"), (7, 2, "user", "same turn"), (-5, 1, "a", "b"), (-100, 0, "a", "b"), (-100, 1, "c", "d")]
    assert run(spark, rows) == brute(rows)


def test_shards_bands_and_spills_give_the_same(spark):
    rows = conversations(2, 30, {3: 40, 100: 33})
    want = brute(rows)
    assert run(spark, rows, levels=4, members=3, held=4) == want
    assert run(spark, rows, levels=64, members=10_000, held=3) == want


def test_long_conversation_and_long_text(spark):
    rows = [(2, i, "user", f"t{i % 3}") for i in range(9_000)] + [(3, 0, "user", "y" * 300_000), (104, 0, "u", "z")]
    found = run(spark, rows)
    assert len(found) == len({r[:2] for r in found})
    h = [zlib.crc32(str(c).encode()) % 6 for c in (2, 3, 104)]
    lengths = [max(0, n - k) for n, k in zip((9_000, 1, 1), h, strict=True)]
    root = next(r for r in found if r[1] == 0)
    assert root[3] == 3 and max(r[1] for r in found) == max(lengths)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_queue_spills_and_keeps_order():
    draw = random.Random(5)
    entries = [(draw.randrange(50), i) for i in range(3_000)]
    queue = SpillingQueue(held=20, fan=3)
    for e in entries:
        queue.push(e)
    found = [list(queue.pop((k,))) for k in range(50)]
    assert [sorted(f) for f in found] == [sorted(e for e in entries if e[0] == k) for k in range(50)]
    assert not queue.heap and not queue.runs


def test_turns_are_numbered_across_partitions(spark):
    rows = [(1, i, "u", str(i)) for i in range(500)] + [(2, 1, "u", "a")] * 300
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = prefix_trie.numbered_turns(table).groupBy("conv").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r[0]: r[1] for r in places} == {1: list(range(1, 501)), 2: list(range(1, 301))}
