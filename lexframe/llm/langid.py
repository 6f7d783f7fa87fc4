"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

Blended-spectrum presence kernel: a piece of text is the set of its character n-grams of one to four
characters, small-cased, with white space as one blank and digits as one sign, hashed to `BINS`
places. The kernel of two pieces is the number of places both have over the geometric mean of their
own numbers. A text is cut into equal pieces of at most `PIECE` characters, as the places of a
longer one would fill up; the kernel of two texts is the mean over all pairs of their pieces, so that
every character counts and the score of a long text is the mean of its pieces' scores. Some labelled texts are landmarks; a text's kernel values to them, whitened by
the landmarks' own kernel matrix, are its features. One ridge regression for each language is
fitted on these. All steps of a prediction are folded into one matrix, so that a batch of texts
is scored by two matrix products.

The fit takes at most `FIT_ROWS` labelled texts, drawn from the languages in turn by a hash of the id. Their
mean presences (8 KB each before packing) meet in one task, which sends the model (4 MB) to the driver;
`LANDMARKS` of them are landmarks, dealt to the languages in turn. Documents with crc32(id) mod 4 = 2 are held out.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled
text every document is `und`; repeated rows are judged alike; a null id is not held out and takes no part
in the fit; an empty table gives no rows; other columns are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.base import register, table

BINS, LENGTHS, PIECE = 4096, 4, 4096
FIT_ROWS, LANDMARKS, RIDGE = 4_000, 256, 1e-2
UNKNOWN = "und"
#: Parts of a language that are drawn from side by side.
PARTS = 64
#: Texts scored at a time: 16 MB of presence values at most.
BATCH = 1024

_FACTORS = np.random.default_rng(104_729).integers(1, 1 << 62, LENGTHS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def presence(text: str) -> np.ndarray:
    """The mean over the text's pieces of which places their n-grams have, each piece at length one."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes <= 32, 32, np.where((codes >= 48) & (codes <= 57), 48, codes)).astype(np.uint64)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    pieces = -(-len(codes) // PIECE)
    # An n-gram belongs to the piece it starts in.
    rows = np.arange(len(codes)) * pieces // len(codes) * BINS
    found = np.zeros(pieces * BINS, bool)
    value = np.zeros(len(codes), np.uint64)
    for n in range(min(LENGTHS, len(codes))):
        value = value[: len(codes) - n] + (codes[n:] + np.uint64(n + 1)) * _FACTORS[n]
        mixed = (value ^ (value >> np.uint64(31))) * _FACTORS[0]
        found[rows[: len(mixed)] + (mixed >> _SHIFT).astype(np.int64)] = True
    found = found.reshape(pieces, BINS)
    total = np.zeros(BINS, np.float32)
    for piece in found:
        total += piece * np.float32(1 / np.sqrt(np.count_nonzero(piece)))
    return total / pieces


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Presence of the landmarks (transposed) and the weights of their kernel values."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    start: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) @ self.weights + self.start


def fit(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One ridge regression for each language on whitened kernel values."""
    languages = sorted(set(y))
    labels = np.array(y)
    turns = np.zeros(len(y), np.int64)
    for language in languages:
        own = labels == language
        turns[own] = np.arange(own.sum())
    marks = np.argsort(turns, kind="stable")[:landmarks]
    points = x[marks].T
    values, vectors = np.linalg.eigh((points.T @ points).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = (x @ points) @ whiten
    mean = features.mean(0)
    target = (labels[:, None] == np.array(languages)).astype(float)
    share = target.mean(0)
    centred = features - mean
    inner = centred.T @ centred + ridge * len(y) * np.eye(centred.shape[1]) / centred.shape[1]
    solved = np.linalg.solve(inner, centred.T @ (target - share))
    return Model(languages, points, (whiten @ solved).astype(np.float32), (share - mean @ solved).astype(np.float32))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _packed(batches):
    for batch in batches:
        rows = [(lang, text) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if has_letter(text)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([zlib.compress(presence(r[1]).astype(np.float16).tobytes(), 1) for r in rows], pa.binary())],
            ["lang", "packed"],
        )


def _fitted(batches):
    """The model of all rows of the task, in order, as one pickled row."""
    found = sorted((lang, packed) for batch in batches for lang, packed in zip(batch.column("lang").to_pylist(), batch.column("packed").to_pylist(), strict=True))
    if found:
        x = np.empty((len(found), BINS), np.float32)
        for row, (_, packed) in zip(x, found, strict=True):
            row[:] = np.frombuffer(zlib.decompress(packed), np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, [lang for lang, _ in found]))], pa.binary())], ["model"])


def fit_languages(docs: DataFrame, limit: int = FIT_ROWS) -> Model | None:
    """A model of at most `limit` labelled texts that are not held out; None without any. The texts are
    drawn from the languages in turn, and of repeated rows one; one task fits them."""
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.md5(F.col("text").cast("binary")).alias("key"))
    keys, order = ["doc_id", "lang", "key"], [F.xxhash64("doc_id"), "doc_id", "key"]
    # A language may have most rows: it is drawn from in parts.
    parts = known.select(*keys, F.pmod(F.xxhash64("key", "doc_id"), F.lit(PARTS)).alias("part"))
    turn = F.dense_rank().over(Window.partitionBy("lang", "part").orderBy(*order))
    drawn = parts.withColumn("turn", turn).where(F.col("turn") <= limit // PARTS + 1).distinct()
    chosen = drawn.orderBy("turn", "part", "lang").limit(limit)
    texts = known.join(chosen.select(*keys), keys, "left_semi").dropDuplicates(keys)
    found = texts.select("lang", "text").mapInArrow(_packed, "lang string, packed binary").repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def with_language(rows: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to rows with a text, which is dropped."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def judge(batches):
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                texts = batch.column("text").to_pylist()
                known = [i for i, text in enumerate(texts) if model and has_letter(text)]
                languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    found = model.score(np.stack([presence(texts[i]) for i in known]))
                    for i, best, value in zip(known, found.argmax(1), np.clip(found.max(1), 0, 1), strict=True):
                        languages[i], scores[i] = model.languages[best], float(value)
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(languages), pa.array(scores, pa.float64())], [f.name for f in kept] + ["lang_pred", "score"])

    return rows.mapInArrow(judge, kinds)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with a language; those that are `und` go."""
    model = fit_languages(docs)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    judged = with_language(docs.select(row, "text"), model)
    return judged.where(F.col("lang_pred") != UNKNOWN).select("__row.*")


@register("op1_language_id")
def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_language(rows, fit_languages(docs))
