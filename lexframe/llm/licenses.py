"""Licence scans by a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines with words, up to a line without one. It is read in windows of `WINDOW`
words, a new one every `STRIDE`, so that each run of words as long as the longest template lies whole in
one of them, wherever lines are wrapped. The features of a window are its distinct words and word
pairs, small-cased and without punctuation, hashed to `BINS` places (sparse n-grams). A softmax
regression gives each window a share for every licence family and for `none`. It is trained here on
windows made by rule from the templates (each template between other words) and, as `none`, on
windows of at most `FIT_ROWS` paragraphs of the corpus that hold none of the templates' telling words,
one of each of at most `DRAWN` times as many documents, drawn by a hash of the id. Half of these are kept from the training to
calibrate: the bar of `unknown` is the share of all families that the windows of only `FALSE_SHARE` of them
exceed. A window above the bar is a prediction. It is confirmed by the templates that stand in it word for
word: families that differ by one word (attribution, attribution and no derivatives) are told apart by
nothing less. The longest such template decides, and another family only where it shares no word with it. A
prediction that no template confirms is `unknown`, never a freer family. A paragraph has each
family once, and `unknown` if such a window shares no word with a confirmed one.

Defined cases: a null text has no paragraphs; without training paragraphs of the corpus the bar
is `BAR`; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import register, table, whole
from lexframe.llm.words import mixed, word_bounds, word_hashes

BINS, FIT_ROWS, FALSE_SHARE, BAR = 8192, 4_000, 0.0005, 0.5
PIECES, STEPS, RATE, RIDGE = 40, 200, 2.0, 1e-4
WINDOW, STRIDE = 24, 8
#: Documents drawn for each paragraph of the fit.
DRAWN = 2
#: Windows scored at a time: 15 MB of weights at most.
BATCH = 4096
NONE, UNKNOWN = "none", "unknown"
#: Words that keep a paragraph from being an example of `none`.
TELLING = r"(?i)licen[cs]e|copyright|warrant|redistribut|public domain|rights reserved"

#: Short notices of the families, of at most WINDOW - STRIDE + 1 words, and their SPDX names.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the license"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "isc": ("licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and distribute this software for any purpose"),
    "gpl": (
        "licensed under the gnu general public license",
        "licensed under the gpl",
        "under the terms of the gnu general public license",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        "licensed under the lgpl",
        "under the terms of the gnu lesser general public license",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "agpl": (
        "licensed under the gnu affero general public license",
        "licensed under the agpl",
        "under the terms of the gnu affero general public license",
        "under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    "bsd": ("licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted"),
    "mpl-2.0": ("subject to the terms of the mozilla public license", "licensed under the mozilla public license"),
    "epl": ("under the terms of the eclipse public license", "licensed under the eclipse public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4.0", "licensed under a creative commons attribution noderivatives 4.0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-nc-sa": ("licensed under cc by nc sa 4.0", "licensed under a creative commons attribution noncommercial sharealike 4.0 international license"),
    "cc-by-nc-nd": ("licensed under cc by nc nd 4.0", "licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"),
    "cc0": ("released under cc0 1.0", "dedicated to the public domain"),
    "proprietary": ("all rights reserved",),
}
SPDX = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "isc": "ISC", "gpl": "GPL-2.0 GPL-3.0", "lgpl": "LGPL-2.1 LGPL-3.0", "agpl": "AGPL-3.0", "bsd": "BSD-2-Clause BSD-3-Clause",
    "mpl-2.0": "MPL-2.0", "epl": "EPL-1.0 EPL-2.0", "unlicense": "Unlicense", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc": "CC-BY-NC-4.0",
    "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0", "cc0": "CC0-1.0",
}


def notices(family: str) -> list[str]:
    return [*TEMPLATES[family], *[f"SPDX-License-Identifier: {name}" for name in SPDX.get(family, "").split()]]


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != ".")
_CLEAN = bytes(32 if c in _PUNCTUATION or c in b"\t\r" else c for c in range(256))


def paragraph_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the text, and the line it is in."""
    data = text.encode("utf-8", "replace").translate(_CLEAN).replace(b". ", b"  ").replace(b".\n", b" \n")
    if data.endswith(b"."):
        data = data[:-1] + b" "
    starts, _ = word_bounds(np.frombuffer(data, np.uint8))
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return word_hashes(data, True), np.searchsorted(breaks, starts)


def windows(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, end) of the windows of words in these lines."""
    if not len(lines):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, lines[1:] - lines[:-1] > 1))
    size = np.diff(np.append(first, len(lines)))
    count = 1 + -(-np.maximum(size - WINDOW, 0) // STRIDE)
    paragraph = np.repeat(np.arange(len(first)), count)
    turn = np.arange(len(paragraph)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(turn * STRIDE + WINDOW, size[paragraph])
    return paragraph, first[paragraph] + np.maximum(end - WINDOW, 0), first[paragraph] + end


def features(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place): the distinct places of each window's words and word pairs, by window."""
    size = ends - starts
    own = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size - starts, size)
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])
    inside = at + 1 < ends[own]
    found = np.concatenate([own, own[inside]]) * BINS + (np.concatenate([words[at], pairs[at[inside]]]) % np.uint64(BINS)).astype(np.int64)
    found = np.unique(found)
    return found // BINS, found % BINS


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray
    bar: float
    #: (family, words) of each template, the longest first.
    templates: list[tuple[int, np.ndarray]]

    def shares(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The share of each family in each window; `none` is the last."""
        out = np.empty((len(starts), self.weights.shape[1]), np.float32)
        for k in range(0, len(starts), BATCH):
            own, places = features(words, starts[k : k + BATCH], ends[k : k + BATCH])
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(first, len(own)))
            total = np.add.reduceat(self.weights[places], first, 0) / np.sqrt(counts)[:, None] + self.weights[BINS]
            total = np.exp(total - total.max(1, keepdims=True))
            out[k : k + BATCH] = total / total.sum(1, keepdims=True)
        return out

    def confirmed(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(family, start, end) of the templates that stand among the words, none sharing a word with a longer one."""
        out: list[tuple[int, int, int]] = []
        for family, template in self.templates:
            n = len(template)
            for at in np.flatnonzero(words[: max(0, len(words) - n + 1)] == template[0]):
                if (words[at : at + n] == template).all() and all(at + n <= s or e <= at for _, s, e in out):
                    out.append((family, int(at), int(at) + n))
        return out

    def found(self, words: np.ndarray, lines: np.ndarray) -> tuple[int, list[dict]]:
        """The number of paragraphs, and line, family and score of what is predicted in them."""
        paragraph, starts, ends = windows(lines)
        if not len(words):
            return 0, []
        shares = 1 - self.shares(words, starts, ends)[:, -1]
        known, rest, upto = {}, [], {}
        for at in np.flatnonzero(shares > self.bar):
            score = float(shares[at])
            sure = self.confirmed(words[starts[at] : ends[at]])
            if not sure:
                rest.append((score, int(at)))
                continue
            upto.setdefault(int(paragraph[at]), []).append((starts[at], ends[at]))
            for family, start, _ in sure:
                key = int(paragraph[at]), self.families[family]
                if key not in known or known[key][1] < score:
                    known[key] = int(lines[starts[at] + start]), score
        for score, at in sorted(rest, reverse=True):
            key = int(paragraph[at]), UNKNOWN
            if key not in known and not any(s < ends[at] and starts[at] < e for s, e in upto.get(key[0], ())):
                known[key] = int(lines[(starts[at] + ends[at]) // 2]), score
        return int(paragraph[-1]) + 1, [{"line": line, "family": f, "score": score} for (_, f), (line, score) in sorted(known.items(), key=lambda x: (x[1][0], x[0]))]


def _pairs(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(3) + words[1:])


def fit(plain: list[str]) -> Model:
    """A model from the templates and paragraphs of the corpus that are none."""
    draw = np.random.default_rng(11)
    families = list(TEMPLATES)
    kept, judged = plain[::2], plain[1::2]
    around = [w for text in kept for w in text.split()] or ["the", "of", "and", "in"]
    texts, labels = list(kept), [len(families)] * len(kept)
    for number, family in enumerate(families):
        for template in notices(family):
            room = max(0, WINDOW - len(template.split()))
            for _ in range(PIECES):
                cut, size = sorted(draw.integers(0, room + 1, 2))
                before, after = (" ".join(around[i] for i in draw.integers(0, len(around), n)) for n in (cut, size - cut))
                texts.append(f"{before} {template} {after}")
                labels.append(number)
    rows = []
    for text in texts:
        words = paragraph_words(text.replace("\n", " "))[0]
        start = int(draw.integers(0, max(0, len(words) - WINDOW) + 1))
        rows.append(features(words, np.array([start]), np.array([min(start + WINDOW, len(words))])))
    y = np.zeros((len(texts), len(families) + 1), np.float32)
    y[np.arange(len(texts)), labels] = 1
    row = np.repeat(np.arange(len(rows)), [len(p) for _, p in rows])
    place = np.concatenate([p for _, p in rows])
    value = 1 / np.sqrt(np.bincount(row, minlength=len(rows)).clip(1))[row]
    x = np.zeros((len(rows), BINS + 1), np.float32)
    x[row, place] = value
    x[:, BINS] = 1
    weights, share = np.zeros((BINS + 1, y.shape[1]), np.float32), 1 / y.sum(0).clip(1)
    cost = (y @ share)[:, None] / y.shape[1]
    for _ in range(STEPS):
        p = np.exp(x @ weights)
        p /= p.sum(1, keepdims=True)
        weights -= RATE * 8 * (x.T @ ((p - y) * cost) + RIDGE * weights)
    templates = [(number, paragraph_words(t)[0]) for number, f in enumerate(families) for t in notices(f)]
    model = Model(families, weights, BAR, sorted(templates, key=lambda t: -len(t[1])))
    top = []
    for text in judged:
        words, _ = paragraph_words(text.replace("\n", " "))
        if len(words):
            top.append(float(1 - model.shares(words, *windows(np.zeros(len(words), np.int64))[1:])[:, -1].min()))
    if top:
        model.bar = float(np.clip(np.quantile(top, 1 - FALSE_SHARE), 0.2, 0.9))
    return model


def fit_licenses(docs: DataFrame, limit: int = FIT_ROWS) -> Model:
    parts = F.filter(F.split(whole("text"), r"\n[^\S\n]*\n"), lambda x: F.regexp_like(x, F.lit(r"\w")) & ~F.regexp_like(x, F.lit(TELLING)))
    # Of a long paragraph, a piece of 2,000 characters from anywhere in it.
    start = F.pmod(F.xxhash64("hash"), F.greatest(F.char_length("part") - 1999, F.lit(1))).cast("int") + 1
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    # Each task hands in ids only; texts are read for the documents that are drawn, one row of each id.
    drawn = docs.select("doc_id", "hash").distinct().orderBy("hash", "doc_id").limit(DRAWN * limit).select("doc_id")
    docs = docs.join(drawn, "doc_id", "left_semi").groupBy("doc_id", "hash").agg(F.min("text").alias("text"))
    rows = docs.select("doc_id", "hash", parts.alias("parts"))
    rows = rows.select("doc_id", "hash", F.get("parts", F.pmod("hash", F.greatest(F.size("parts"), F.lit(1))).cast("int")).alias("part")).where("part IS NOT NULL")
    rows = rows.select("doc_id", "hash", F.substring("part", start, F.lit(2000)).alias("part"))
    rows = rows.orderBy("hash", "doc_id", "part").limit(limit)
    return fit([r["part"] for r in rows.collect()])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licence, n_unknown, families (sorted, comma-joined) and found: the line number, family
    and score of each paragraph's families, the line being where the notice starts."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                out.append(model.found(*paragraph_words(text or "")))
            kind = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in out], pa.int64()), pa.array([f for _, f in out], kind)], ["doc_id", "n_paragraphs", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<line:long,family:string,score:double>>")
    known = F.filter("found", lambda x: x["family"] != UNKNOWN)
    names = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"])))
    return rows.select(
        "doc_id", "n_paragraphs", F.size(known).cast("long").alias("n_licence"), (F.size("found") - F.size(known)).cast("long").alias("n_unknown"),
        F.concat_ws(",", names).alias("families"), "found",
    )


@register("op5_license_scan")
def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with its licence families."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit_licenses(docs))
    spots = F.transform("found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"]))
    return found.select("doc_id", "n_paragraphs", "n_licence", "n_unknown", "families", F.concat_ws(",", spots).alias("paragraphs"))
