"""Removal of long repeated byte strings by a distributed merge sort of sparse suffixes.

A string of `WIDTH` bytes that starts at s has one anchor: in its windows of `GRAM` bytes, the first
whose hash is least. The anchor depends on the string alone, so equal strings have it at the same
place, and only suffixes that start at anchors need an order. Each anchor owns a run of starts; the
bytes of these strings are its block.

1. Blocks are counted by hash. A block found twice is repeated whole. A block found once may still share
   strings with other blocks of its anchor's gram; only those blocks, one of each kind, go on.
2. Tasks sort the suffixes of these blocks (gram, then the bytes from the anchor) into runs and
   front-code them: the length shared with the one before, and the rest. Runs are exchanged by a hash
   of the gram into buckets of about `BUCKET` suffixes.
3. A bucket's runs are merged by a loser tree that knows for each waiting suffix how long a prefix it
   shares with the last one put out, and compares from there on only.
4. In the merged order a string that starts o bytes before its anchor is repeated if a neighbour shares
   WIDTH - o bytes after the anchor and o bytes before it.

A gram with more than `HOT` kinds of blocks would be too large for a bucket; its strings are
counted one by one by their hashes instead, in a shuffle with partial sums, with the same result.

Defined cases: a null text is empty; a text shorter than `WIDTH` has no repeats; repeated rows are two
occurrences; overlapping repeats within one document count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table, whole
from lexframe.llm.words import byte_values, mixed, powers, prefix_hashes, room

WIDTH, GRAM = 400, 32
BUCKET, RUN, HOT = 16_384, 32_768, 4_096
#: Kinds of blocks of one gram up to which pairs are compared one by one.
FEW = 8

_ANCHORS = "id long, key long, gram long, block long, pos long, before int, after int"


def _back(n: int) -> np.ndarray:
    return powers(room(n))[1]


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed((c[ends] - c[starts]) * _back(room(len(data)))[starts])


def anchors(text: bytes, width: int = WIDTH, gram: int = GRAM):
    """(place, first start, last start, gram hash, block hash) of each anchor, as arrays."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    c = prefix_hashes(data, byte_values(False))
    at = np.arange(len(data) - gram + 1)
    grams = string_hashes(data, at, at + gram, c)
    window = width - gram + 1
    packed = (grams >> np.uint64(30) << np.uint64(30)) | at.astype(np.uint64)
    # Least of each window: the end of one stretch and the beginning of the next.
    padded = np.full(-(-len(packed) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    stretches = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(stretches, 1).ravel()
    behind = np.minimum.accumulate(stretches[:, ::-1], 1)[:, ::-1].ravel()
    n = len(data) - width + 1
    own = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & np.uint64((1 << 30) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    last = np.append(first[1:], n) - 1
    place = own[first]
    shape = ((place - first) * 1024 + (last - first)).astype(np.uint64)
    return place, first, last, grams[place], mixed(string_hashes(data, first, last + width, c) + shape)


def _anchor_rows(width: int):
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                place, first, last, gram, block = anchors(text.as_py() or b"", width)
                if len(place):
                    n = len(place)
                    ids = [pa.repeat(batch.column(c)[i], n) for c in ("id", "key")]
                    rest = [gram.view(np.int64), block.view(np.int64), place, (place - first).astype(np.int32), (place - last).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x) for x in rest]], ["id", "key", "gram", "block", "pos", "before", "after"])

    return run


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        upto = min(n, known + step)
        if a[known:upto] != b[known:upto]:
            while a[known] == b[known]:
                known += 1
            return known
        known, step = upto, step * 4
    return n


class LoserTree:
    """Merges sorted front-coded runs. `runs` give (shared, rest, payload); iterating gives (shared with the
    one before, string, payload) in order. No byte known to be shared is compared again."""

    def __init__(self, runs):
        self.runs = [iter(run) for run in runs]
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.text: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        self.payload: list = [None] * self.size
        for i in range(len(self.runs)):
            self._next(i)
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for at in range(self.size - 1, 0, -1):
            winners[at], self.losers[at] = self._play(winners[2 * at], winners[2 * at + 1])
        self.first = winners[1]

    def _next(self, i: int) -> None:
        found = next(self.runs[i], None)
        if found is None:
            self.text[i] = None
            return
        self.known[i], rest, self.payload[i] = found
        self.text[i] = (self.text[i] or b"")[: self.known[i]] + rest

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.text[i], self.text[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.known[i] != self.known[j]:
            return (i, j) if self.known[i] > self.known[j] else (j, i)
        both = shared(a, b, self.known[i])
        if both == len(a) or (both < len(b) and a[both] < b[both]):
            self.known[j] = both
            return i, j
        self.known[i] = both
        return j, i

    def __iter__(self):
        while (best := self.first) < len(self.runs) and self.text[best] is not None:
            yield self.known[best], self.text[best], self.payload[best]
            self._next(best)
            at = (self.size + best) // 2
            while at:
                best, self.losers[at] = self._play(best, self.losers[at])
                at //= 2
            self.first = best


def front_coded(rows: list[tuple[bytes, tuple]]):
    """(shared, rest, payload) of strings, sorted here."""
    before = b""
    for text, payload in sorted(rows):
        both = shared(before, text)
        yield both, text[both:], payload
        before = text


def _gram_bytes(gram: int) -> bytes:
    return (gram + (1 << 63)).to_bytes(8, "big")


_RUNS = "bucket long, run long, seq int, shared int, rest binary, block long, before int, after int, ahead binary"


def _sorted_runs(width: int, buckets: int):
    def flush(held, number):
        name = (TaskContext.get().partitionId() << 24) + number
        parts: dict[int, list] = {}
        for bucket, text, payload in held:
            parts.setdefault(bucket, []).append((text, payload))
        for bucket, rows in parts.items():
            coded = list(front_coded(rows))
            out = [(bucket, name, seq, both, rest, *payload) for seq, (both, rest, payload) in enumerate(coded)]
            yield pa.RecordBatch.from_pylist([dict(zip(_RUN_NAMES, row, strict=True)) for row in out], _RUN_SCHEMA)

    def run(batches):
        held, number = [], 0
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for w in batch.column("wanted")[i].as_py():
                    pos, before, after = w["pos"], w["before"], w["after"]
                    own = _gram_bytes(w["gram"]) + text[pos : pos - after + width]
                    held.append((w["gram"] % buckets, own, (w["block"], before, after, text[pos - before : pos])))
                if len(held) >= RUN:
                    yield from flush(held, number)
                    held, number = [], number + 1
        yield from flush(held, number)

    return run


_RUN_NAMES = ["bucket", "run", "seq", "shared", "rest", "block", "before", "after", "ahead"]
_RUN_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("run", pa.int64()), ("seq", pa.int32()), ("shared", pa.int32()), ("rest", pa.binary()), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("ahead", pa.binary())]
)


def repeated_starts(members: list[tuple[int, tuple]], width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(block, low, high): distances before the anchor at which a repeated string starts. `members` are the blocks
    of one gram in order, each with the bytes shared after the anchor with the one before."""
    if len(members) <= FEW:
        return _by_pairs(members, width)
    after = np.array([both for both, _ in members])
    blocks = [p for _, p in members]
    low, high = np.array([p[2] for p in blocks]), np.array([p[1] for p in blocks])
    # A hash of the bytes before the anchor, grown by one byte for each distance.
    grown = np.zeros(len(blocks), np.uint64)
    ahead = np.zeros((len(blocks), int(high.max()) + 1), np.uint8)
    for i, p in enumerate(blocks):
        ahead[i, : p[1]] = np.frombuffer(p[3], np.uint8)[::-1]
    values = byte_values(False)
    hit = np.zeros((len(blocks), ahead.shape[1]), bool)
    for o in range(ahead.shape[1]):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) > 1:
            interval = np.cumsum(after < width - o)[own].astype(np.uint64)
            _, at, n = np.unique(mixed(grown[own] + mixed(interval + np.uint64(1))), return_inverse=True, return_counts=True)
            hit[own[n[at] > 1], o] = True
        grown = mixed(grown * np.uint64(3) + values[ahead[:, o]])
    out = []
    for i, p in enumerate(blocks):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[i].astype(np.int8), [0]])))
        out += [(p[0], int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _by_pairs(members, width):
    out = []
    for i in range(len(members)):
        both = width
        for j in range(i + 1, len(members)):
            both = min(both, members[j][0])
            a, b = members[i][1], members[j][1]
            low = max(a[2], b[2], width - both)
            high = min(a[1], b[1], shared(a[3][::-1], b[3][::-1]))
            if low <= high:
                out += [(a[0], low, high), (b[0], low, high)]
    return out


def _merged(width: int):
    def members(order):
        """The blocks of each gram in order; of a repeated row the block comes twice and is taken once."""
        for _, group in groupby(order, key=lambda x: x[1][:8]):
            seen, out, least = set(), [], 1 << 30
            for both, _, payload in group:
                least = min(least, max(0, both - 8))
                if payload[0] not in seen:
                    seen.add(payload[0])
                    out.append((least, payload))
                    least = 1 << 30
            yield out

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, bucket in groupby(rows, key=lambda r: r["bucket"]):
            runs = [[(r["shared"], r["rest"], (r["block"], r["before"], r["after"], r["ahead"])) for r in own] for _, own in groupby(bucket, key=lambda r: r["run"])]
            found = [x for group in members(LoserTree(runs)) if len(group) > 1 for x in repeated_starts(group, width)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["block", "low", "high"])

    return run


def _single_strings(width: int):
    """(block, o, string): the hash of each string of the wanted blocks."""

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_py(), np.uint8)
                c = prefix_hashes(data, byte_values(False))
                for w in batch.column("wanted")[i].as_py():
                    o = np.arange(w["after"], w["before"] + 1)
                    starts = w["pos"] - o
                    found = string_hashes(data, starts, starts + width, c).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), w["block"])), pa.array(o), pa.array(found)], ["block", "o", "string"])

    return run


def _with_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, wanted): the documents with a list of their anchors among `wanted`; of repeated rows one comes."""
    fields = F.struct("gram", "block", "pos", "before", "after")
    lists = wanted.groupBy("id", "key").agg(F.collect_list(fields).alias("wanted"))
    return texts.dropDuplicates(["id", "key"]).join(lists.hint("merge"), ["id", "key"]).select("text", "wanted")


def repeated_spans(texts: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(id, key, low, high): places at which repeated strings start. `texts` has id, key and text as bytes."""
    found = cut_lineage(texts.mapInArrow(_anchor_rows(width), _ANCHORS), "anchors")
    row = F.struct("id", "key", "pos", "before", "after")
    kinds = found.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("row"))
    kinds = cut_lineage(kinds, "kinds")
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    open_kinds = cut_lineage(kinds.join(grams, "gram").select("gram", "block", "kinds", "row.*"), "open")
    few, many = open_kinds.where(F.col("kinds") <= hot), open_kinds.where(F.col("kinds") > hot)
    buckets = int(few.count() // BUCKET + 1)
    runs = _with_wanted(texts, few).mapInArrow(_sorted_runs(width, buckets), _RUNS)
    runs = runs.repartition(max(buckets, 2), "bucket").sortWithinPartitions("bucket", "run", "seq")
    starts = runs.mapInArrow(_merged(width), "block long, low long, high long")
    strings = _with_wanted(texts, many).mapInArrow(_single_strings(width), "block long, o long, string long")
    strings = strings.distinct()  # repeated rows give a block twice
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    starts = starts.unionByName(strings.join(twice, "string").select("block", F.col("o").alias("low"), F.col("o").alias("high")))
    starts = cut_lineage(starts.distinct(), "starts")
    parts = found.join(starts, "block").select("id", "key", (F.col("pos") - F.col("high")).alias("low"), (F.col("pos") - F.col("low")).alias("high"))
    full = kinds.where("n > 1").select("block")
    full = found.join(full, "block").select("id", "key", (F.col("pos") - F.col("before")).alias("low"), (F.col("pos") - F.col("after")).alias("high"))
    return parts.unionByName(full)


def _cut(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or b""
                spans = batch.column("spans")[i].as_py() or []
                steps = np.zeros(len(text) + 1, np.int64)
                for s in spans:
                    steps[s["low"]] += 1
                    steps[s["high"] + width] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                runs = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), runs, kept))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`, the remaining bytes, of every document."""
    if not GRAM <= width <= 1000:
        raise ValueError(f"width must be from {GRAM} to 1000")
    data = whole("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("id"), F.xxhash64(data).alias("key"), data.alias("text"))
    spans = repeated_spans(texts.select("id", "key", "text"), width, hot)
    spans = spans.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = texts.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left of it without repeated 400-byte strings: its hash, its bytes counted and as
    text, where a character cut in two is replaced by U+FFFD."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"), text.alias("text")
    )
