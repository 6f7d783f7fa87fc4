"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are taken in tasks. A document that breaks a base rule (too few words,
too much repetition) fails; the others are judged by boosted trees fitted to labelled documents.
Trees have a fixed depth and are kept as flat node arrays: node i has children 2i+1 and 2i+2, so
that a batch of rows goes down all trees level by level in numpy. Constrained features move the
score one way only: a split that would break this is not made, and leaves below a split stay on
their side of its middle value.

The model is fitted on the driver to statistics, not texts, of at most `FIT_ROWS` labelled
documents, chosen by a hash of their id. Everything else covers all rows.

Defined cases: a null text has no words and fails; without labels of both kinds nothing is
learned and the base rules decide; a null id is never learned from; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import register, table
from lexframe.llm.words import window_hashes, word_bounds, word_hashes

#: Labelled documents to fit to, at most; and the score from which a document is kept.
FIT_ROWS, KEEP = 20_000, 0.5
MIN_WORDS, REPEAT_WIDTH, REPEAT_SHARE = 20, 8, 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees with their constraint: -1, the score falls with it; 1, rises; 0, free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "bare_word_share": 0, "mark_share": -1, "stop_share": 0, "distinct_share": 0,
    "words_per_line": 0,
}
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER, _DIGIT = np.isin(np.arange(256), range(65, 91)), np.isin(np.arange(256), range(48, 58))
_MARKS = np.isin(np.arange(256), list(b"!?;:@^~=_+[]{}\\/\"`"))
_STOPS = np.isin(np.arange(256), list(b".,"))
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    data = np.frombuffer(text or b"", np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=in_words[1:])
    lengths = in_words[ends] - in_words[starts]
    chars, counts = int(lengths.sum()), np.bincount(data, minlength=256)
    symbols = int(counts[_SYMBOLS].sum())
    lines = [x for x in (text or b"").split(b"\n") if _HAS_WORD.search(x)]
    dup_lines = len(lines) - len(set(lines))
    words = word_hashes(text, False)
    windows = window_hashes(words, REPEAT_WIDTH)
    repeated = 0
    if len(windows) > 1:
        order = np.sort(windows)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.flatnonzero(np.isin(windows, twice))
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WIDTH, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    features = [
        float(np.log1p(n)), chars / n, symbols / chars, dup_lines / len(lines), repeated / n, counts[_UPPER].sum() / chars,
        counts[_DIGIT].sum() / chars, float((lengths == 1).mean()), counts[_MARKS].sum() / chars, counts[_STOPS].sum() / chars,
        len(np.unique(words)) / n, n / len(lines),
    ]
    return [n, chars, symbols, dup_lines, repeated], [float(x) for x in features]


@dataclass
class Trees:
    """Flat trees: [tree, node] arrays of feature, threshold and leaf value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out += self.value[tree, node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 label: Newton steps on histograms of at most `bins` bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                at, middle = _best_split(binned[rows], gradient[rows], weight[rows], edges, signs, low[k], high[k], ridge)
                for child in (2 * k + 1, 2 * k + 2):
                    low[child], high[child] = low[k], high[k]
                if at:
                    f, b = at
                    feature[tree, k], threshold[tree, k] = f, edges[f][b]
                    if signs[f]:
                        upper, lower = (2 * k + 2, 2 * k + 1) if signs[f] > 0 else (2 * k + 1, 2 * k + 2)
                        low[upper], high[lower] = max(low[upper], middle), min(high[lower], middle)
                node[rows] = 2 * k + 1 + (binned[rows, feature[tree, k]] > np.searchsorted(edges[feature[tree, k]], threshold[tree, k]))
        for leaf in range(leaves):
            rows = node == leaf + inner
            step = -gradient[rows].sum() / (weight[rows].sum() + ridge)
            value[tree, leaf] = rate * float(np.clip(step, low[leaf + inner], high[leaf + inner]))
        margin += value[tree, node - inner]
    return Trees(feature, threshold, value, start, depth)


def _best_split(binned, gradient, weight, edges, signs, low, high, ridge):
    """((feature, bin), middle of the two sides' values) of the split that gains most."""
    best, at, middle = 1e-6, None, 0.0
    if len(binned) < 2:
        return at, middle
    g, w = gradient.sum(), weight.sum()
    for f, e in enumerate(edges):
        if not len(e):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], gradient, len(e) + 1))[:-1]
        wl = np.cumsum(np.bincount(binned[:, f], weight, len(e) + 1))[:-1]
        left, right = -gl / (wl + ridge), -(g - gl) / (w - wl + ridge)
        left, right = np.clip(left, low, high), np.clip(right, low, high)
        gain = gl**2 / (wl + ridge) + (g - gl) ** 2 / (w - wl + ridge) - g**2 / (w + ridge)
        fine = (wl > 1e-3) & (w - wl > 1e-3)
        if signs[f]:
            fine &= (right - left) * signs[f] >= 0
        gain = np.where(fine, gain, 0)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, at, middle = gain[b], (f, b), float(left[b] + right[b]) / 2
    return at, middle


_STATS_TYPE = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            found = [statistics(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(BASE))]
            features = pa.array([f[1] for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns, features], ["doc_id", *BASE, "features"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, _STATS_TYPE)


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Trees | None:
    """Trees fitted to at most `limit` labelled documents; None without labels of both kinds."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = with_statistics(docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.max("features").alias("features"), F.max("n_words").alias("n_words"))
    found = rows.join(chosen, "doc_id").where(f"n_words >= {MIN_WORDS}").orderBy("doc_id").collect()
    y = np.array([float(r["quality"]) for r in found])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["features"] for r in found]), y, list(FEATURES.values()))


def quality(docs: DataFrame, model: Trees | None, keep: float = KEEP) -> DataFrame:
    """Every document with its counts, base_failed, kept and score."""
    rows = with_statistics(docs)

    def judge(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(len(batch), len(FEATURES))
            score = model.score(x) if model else np.ones(len(x))
            yield batch.drop_columns(["features"]).append_column("score", pa.array(score, pa.float64()))

    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return rows.mapInArrow(judge, kinds).select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= keep)).alias("kept"), "score"
    )


@register("op2_quality_rules")
def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics and the verdict."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
