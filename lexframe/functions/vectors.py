"""Tokens, sparse and dense vectors, and the exact block scorer."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.rules.retrieval import DENSE_DIM, SPARSE_SPACE, TOKEN_PATTERN


#: Matrices of questions that a task scores one after the other against its block.
CHUNKS_AT_ONCE = 16
#: Texts that are embedded at a time, and the memory for the token vectors of the stand-in.
EMBED_ROWS = 256
KNOWN_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, weight) with weight = sqrt(tf). Counts combine before the shuffle."""
    return (
        df.select(key, F.explode(tokens(F.col(text))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .withColumn("weight", F.sqrt(F.col("tf").cast("double")))
    )


def sparse_vectors(df: DataFrame, key: str, text: str, space: int = SPARSE_SPACE) -> DataFrame:
    """Hashed sparse vectors as postings (key, index, weight); colliding terms add up."""
    return (
        df.select(key, F.explode(tokens(F.col(text))).alias("term"))
        .select(key, F.pmod(F.xxhash64("term"), F.lit(space)).alias("index"))
        .groupBy(key, "index")
        .agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))
    )


def _token_vector(token: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(token.encode("utf-8")).digest()[:8], "big")
    vector = np.random.default_rng(seed).standard_normal(dim)
    return vector / np.linalg.norm(vector)


def hash_embedder(dim: int = DENSE_DIM) -> Callable[[pd.Series], list[np.ndarray]]:
    """Deterministic stand-in for a model: the normalised sum of seeded token vectors. The vectors of
    tokens are kept from call to call, up to KNOWN_BYTES."""
    known: dict[str, np.ndarray] = {}
    most = max(1, KNOWN_BYTES // (8 * dim))

    def embed(term_counts: pd.Series) -> list[np.ndarray]:
        out = []
        for counts in term_counts:
            total = np.zeros(dim)
            for term, n in (dict(counts) if len(counts) else {"<empty>": 1}).items():
                if term not in known:
                    if len(known) >= most:
                        known.clear()
                    known[term] = _token_vector(term, dim)
                total += n * known[term]
            norm = np.linalg.norm(total)
            out.append((total / norm if norm else total).astype("float32"))
        return out

    return embed


def dense_vectors(
    df: DataFrame, key: str, text: str, embed: Callable | None = None, dim: int = DENSE_DIM
) -> DataFrame:
    """(key, vector) through an embedder that maps a batch of term counts to vectors."""
    run = embed or hash_embedder(dim)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the tokens of a few texts at a time become Python objects.
        for part in parts:
            for at in range(0, part.num_rows, EMBED_ROWS):
                few = part.slice(at, EMBED_ROWS)
                counts = pd.Series([Counter(t or ()) for t in few.column(1).to_pylist()], dtype=object)
                vectors = pa.array([np.asarray(v, dtype="float32") for v in run(counts)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([few.column(0), vectors], names=[key, "vector"])

    schema = f"{key} {dict(df.dtypes)[key]}, vector array<float>"
    return df.select(key, tokens(F.col(text)).alias("_tokens")).mapInArrow(batches, schema)


def model_vectors(
    df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[np.ndarray]]
) -> DataFrame:
    """The embedder plug. Texts of similar length share a batch, as padding to the longest
    text of a batch is what a model pays for: range partitions by length, sorted inside."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):
                chunk = part.iloc[at : at + 64]
                yield pd.DataFrame({key: chunk[key], "vector": model(list(chunk[text]))})

    schema = f"{key} {dict(df.dtypes)[key]}, vector array<float>"
    by_length = df.select(key, text).repartitionByRange(F.length(text), F.xxhash64(key))
    return by_length.sortWithinPartitions(F.length(text)).mapInPandas(batches, schema)


# ---------------------------------------------------------------- exact top-k


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties by id; scores are rounded first."""
    if len(scores) > k:
        kth = np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(-scores <= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _emit(q_ids, d_ids, scores, k, names, types) -> pa.Table:
    out_q, out_d, out_s = [], [], []
    for row, q in enumerate(q_ids):
        line = scores[row]
        hit = np.flatnonzero(line > -np.inf)
        at = hit[_best(line[hit], d_ids[hit], k)]
        out_q.append(np.repeat(q, len(at)))
        out_d.append(d_ids[at])
        out_s.append(line[at])
    cols = [np.concatenate(c) if c else [] for c in (out_q, out_d, out_s)]
    return pa.table([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)


def _grid(corpus, questions, d_key, q_key, block_rows, chunk_rows):
    """Key corpus rows by (block, chunk) and question rows by (block, chunk), so that each
    pair of a corpus block and a question chunk meets in exactly one bounded task. The
    sizes of the grid come from estimated key counts, inside the plan: an estimate only
    moves the block size, never a result, and needs no shuffle of the keys."""

    def sides(df, key, rows):
        return F.greatest(
            F.lit(1),
            F.ceil(df.agg(F.approx_count_distinct(key)).scalar() / F.lit(rows)),
        ).cast("long")

    blocks = sides(corpus, d_key, block_rows)
    chunks = sides(questions, q_key, chunk_rows)
    c = corpus.withColumn("_block", F.pmod(F.xxhash64(d_key), blocks)).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    )
    q = questions.withColumn("_chunk", F.pmod(F.xxhash64(q_key), chunks)).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    return c.groupBy("_block", "_chunk"), q.groupBy("_block", "_chunk")


def _final(found: DataFrame, q_key: str, d_key: str, k: int) -> DataFrame:
    order = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _allowed(q: pd.DataFrame, d: pd.DataFrame) -> np.ndarray:
    """Per-question hard filter inside a block: all tags asked for are present, and the
    question's moment lies in the row's validity."""
    ok = np.ones((len(q), len(d)), dtype=bool)
    if "tag_mask" in q and "tag_mask" in d:
        need = q["tag_mask"].to_numpy()[:, None]
        ok &= (need & d["tag_mask"].to_numpy()[None, :]) == need
    if "asked_ts" in q and "valid_from_ts" in d:
        at = q["asked_ts"].to_numpy()[:, None]
        end = d["valid_to_ts"].fillna(np.inf).to_numpy()[None, :]
        ok &= (d["valid_from_ts"].to_numpy()[None, :] <= at) & (at < end)
    return ok


QUESTION_GATES = ("tag_mask", "asked_ts")
CORPUS_GATES = ("tag_mask", "valid_from_ts", "valid_to_ts")


def _with_gates(df: DataFrame, gates: tuple[str, ...], *columns: str) -> DataFrame:
    return df.select(*columns, *[g for g in gates if g in df.columns])


def _schema(corpus, questions, d_key, q_key):
    q_type, d_type = dict(questions.dtypes)[q_key], dict(corpus.dtypes)[d_key]
    if d_type not in ("int", "bigint"):
        raise TypeError("corpus ids must be integers; hash other ids first")
    return f"{q_key} {q_type}, {d_key} {d_type}, score double"


def dense_scorer(k: int, d_key: str, q_key: str, vector: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores one block of the corpus against one chunk of questions."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [right.schema.field(q_key).type, left.schema.field(d_key).type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=[q_key, d_key, "score"])

        def matrix(t):
            m = np.stack(t[vector].to_numpy(zero_copy_only=False)).astype("float64")
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(norm == 0, 1, norm)

        gate = _allowed(
            right.drop_columns([vector]).to_pandas(), left.drop_columns([vector]).to_pandas()
        )
        s = np.where(gate, np.round(matrix(right) @ matrix(left).T, 9), -np.inf)
        return _emit(
            right[q_key].to_numpy(), left[d_key].to_numpy(), s, k, [q_key, d_key, "score"], types
        )

    return score


def dense_topk(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    d_key: str = "doc_id",
    q_key: str = "question_id",
    vector: str = "vector",
    block_rows: int = 20_000,
    chunk_rows: int = 256,
) -> DataFrame:
    """Exact cosine top-k per question. Each task multiplies one corpus block with one
    question chunk and emits at most k rows per question."""

    schema = _schema(corpus, questions, d_key, q_key)
    score = dense_scorer(k, d_key, q_key, vector)
    c, q = _grid(
        _with_gates(corpus, CORPUS_GATES, d_key, vector),
        _with_gates(questions, QUESTION_GATES, q_key, vector),
        d_key, q_key, block_rows, chunk_rows,
    )
    return _final(c.cogroup(q).applyInArrow(score, schema), q_key, d_key, k)


def sparse_scorer(
    k: int, d_key: str, q_key: str, term: str, at_once: int = 64
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores the postings of one block against those of one chunk of questions, `at_once` questions in a matrix."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [right.schema.field(q_key).type, left.schema.field(d_key).type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=[q_key, d_key, "score"])
        q, d = right.to_pandas(), left.to_pandas()
        number, ids = pd.factorize(q[q_key])
        few = [q[(number >= at) & (number < at + at_once)] for at in range(0, len(ids), at_once)]
        return pa.concat_tables([matrix(part, d, types) for part in few])

    def matrix(q: pd.DataFrame, d: pd.DataFrame, types: list[pa.DataType]) -> pa.Table:
        vocabulary = pd.Index(q[term].unique())
        d_codes = vocabulary.get_indexer(d[term])
        d = d[d_codes >= 0]
        d_rows, d_ids = pd.factorize(d[d_key], sort=True)
        q_rows, q_ids = pd.factorize(q[q_key])
        dm = np.zeros((len(d_ids), len(vocabulary)))
        dm[d_rows, d_codes[d_codes >= 0]] = d["weight"]
        qm = np.zeros((len(q_ids), len(vocabulary)))
        qm[q_rows, vocabulary.get_indexer(q[term])] = q["weight"]
        gate = _allowed(
            q.drop_duplicates(q_key).set_index(q_key).loc[q_ids],
            d.drop_duplicates(d_key).set_index(d_key).loc[d_ids],
        )
        s = np.round(qm @ dm.T, 6)
        s[(s <= 0) | ~gate] = -np.inf
        return _emit(
            np.asarray(q_ids), np.asarray(d_ids), s, k, [q_key, d_key, "score"], types
        )

    return score


def sparse_topk(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    d_key: str = "doc_id",
    q_key: str = "question_id",
    term: str = "term",
    block_rows: int = 2_000,
    chunk_rows: int = 64,
) -> DataFrame:
    """Exact dot-product top-k over postings ``(key, term, weight)``.

    A join on the term would emit a row for each (question, document) pair that shares a
    frequent term; here a task builds the small (document x question-term) matrix of its
    block and emits at most k rows per question.
    """

    schema = _schema(corpus, questions, d_key, q_key)
    score = sparse_scorer(k, d_key, q_key, term, chunk_rows)
    asked = _with_gates(questions, QUESTION_GATES, q_key, term, "weight")
    wanted = _with_gates(corpus, CORPUS_GATES, d_key, term, "weight").join(
        asked.select(term).distinct(), term, "left_semi"
    )
    # A block is sent once for every chunk of the grid, so that a chunk takes as many questions as a task can read.
    c, q = _grid(wanted, asked, d_key, q_key, block_rows, chunk_rows * CHUNKS_AT_ONCE)
    return _final(c.cogroup(q).applyInArrow(score, schema), q_key, d_key, k)
