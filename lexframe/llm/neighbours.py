"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Every vector gets one more component, which brings all to the length of the longest (queries get 0),
so that the largest product is the least distance. In each of `TABLES` tables a vector falls into the bucket
of `k` functions floor((a.x + b) / w) with normal a. A query looks into its own bucket and into
those next to it, in the order of estimated success: the sum of the squared distances to the borders that
lead there is least first. The distinct candidates of all its buckets are ranked by exact products. Own
buckets come in a first round; the score of the last of the best found there is a bar that
candidates of the other buckets must reach to be sent on at all.

The index is fitted to a bounded sample: `FIT` rows give w and the shares of large buckets, and up to
`TRIALS` queries, held against every row, give the number of functions and of probes that find `RECALL`
of their true neighbours at the least estimated work. Every row is then indexed. A bucket that the sample
shows to be larger than `BLOCK` rows is dealt over blocks, each of which its queries visit. A
query whose probes find too few candidates is held against all rows in blocks.

Scores are summed anew from the original components in double precision for everything that could be among the
best of a bucket, so equal vectors have equal scores.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and rows without
vec_id take no part; vectors are compared with those of their own number of components only; rows of a query's
own id are not its candidates; repeated rows count once, and of several vectors of one id the nearest; a
query id with several vectors has the nearest of all of them; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table
from lexframe.llm.words import mixed

TOP, EVERY = 20, 20
TABLES, BUCKET, BLOCK = 2, 2_048, 16_384
#: Rows and queries that the index is fitted to, and the share of true neighbours it is fitted to find.
FIT, TRIALS, RECALL = 16_384, 128, 0.97
#: Probes of a table at most; functions at most; width in standard deviations of a projection.
PROBES, FUNCTIONS, WIDTH = 48, 16, 1.5
#: What a probe costs besides its rows, in rows.
PROBE_ROWS = 500
_SEED = 41

_CELL = ["bucket", "block", "dim"]
_ROWS = "bucket long, block long, dim int, kind int, id long, v binary, bar double"


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v): the rows that take part."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", _finite) & F.exists("v", lambda x: x != 0))


def _by_size(batch):
    """(rows, matrix) for each number of components in a batch."""
    column = batch.column("v")
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def probe_sets(k: int, n: int) -> np.ndarray:
    """The first n sets of borders in the order of their expected distance. Borders 0..2k-1 are taken as sorted; j and
    2k-1-j are the two borders of one function, so that no set holds both."""
    if k <= 4:
        sets = [{i if s < 0 else 2 * k - 1 - i for i, s in enumerate(signs) if s} for signs in product((-1, 0, 1), repeat=k)]
    else:
        j = np.arange(1, k + 1)
        near = j * (j + 1) / (4 * (k + 1) * (k + 2))
        far = 1 - j / (k + 1) + near
        cost = np.concatenate([near, far[::-1]])
        sets, waiting = [set()], [(cost[0], (0,))]
        while waiting and len(sets) < n:
            _, found = heapq.heappop(waiting)
            if all(2 * k - 1 - i not in found for i in found):
                sets.append(set(found))
            last = found[-1]
            if last + 1 < 2 * k:
                for more in ((*found[:-1], last + 1), (*found, last + 1)):
                    heapq.heappush(waiting, (float(cost[list(more)].sum()), more))
    out = np.zeros((len(sets), 2 * k))
    for row, own in zip(out, sets, strict=True):
        row[list(own)] = 1
    return out


@dataclass
class Index:
    """The functions of all tables, for vectors of up to `dims` components."""

    dims: int
    longest: float
    width: float = 1.0
    k: int = 1
    probes: int = 1
    buckets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __post_init__(self):
        draw = np.random.default_rng(_SEED)
        self.normal = draw.standard_normal((TABLES, FUNCTIONS, self.dims + 1))
        self.shift = draw.random((TABLES, FUNCTIONS))

    def places(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        """Where each vector lies on the scale of each function, in widths."""
        x = x.astype(np.float64)
        a = self.normal[table, : self.k]
        at = x @ a[:, : x.shape[1]].T
        if not query:
            rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
            at += rest[:, None] * a[:, -1]
        return np.clip(at / self.width + self.shift[table, : self.k], -1e15, 1e15)

    def bucket(self, cells: np.ndarray, table: int, dim: int) -> np.ndarray:
        h = np.full(cells.shape[:-1], table * 1_000_003 + dim, np.uint64)
        for i in range(self.k):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def steps(self, places: np.ndarray, n: int) -> np.ndarray:
        """The first n cells to visit from each place, as differences to the own cell."""
        k = self.k
        low = places - np.floor(places)
        borders = np.concatenate([low, 1 - low], 1) ** 2
        order = np.argsort(borders, 1, kind="stable")
        # The far border of a function lies opposite of its near one.
        order[:, k:] = ((order[:, :k] + k) % (2 * k))[:, ::-1]
        sets = probe_sets(k, 4 * n)
        costs = np.take_along_axis(borders, order, 1) @ sets.T
        best = np.argsort(costs, 1, kind="stable")[:, :n]
        sign = np.zeros((len(places), 2 * k, k))
        np.put_along_axis(sign, (order % k)[:, :, None], np.where(order < k, -1, 1)[:, :, None], 2)
        return np.rint(sets[best] @ sign).astype(np.int64)

    def n_blocks(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.ones(buckets.shape, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        return np.where(self.buckets[at] == buckets, self.blocks[at], 1)


def _smallest_of_equal(ids: np.ndarray, x: np.ndarray, top: int) -> np.ndarray:
    """Rows of a batch but for repeated ones and for those with more than `top` smaller ids of one vector."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))
    order, g = order[new], g[new]
    at = np.arange(len(g))
    rank = at - np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), at, 0))
    return np.sort(order[rank <= top])


def _rows(buckets, blocks, dim, kind, ids, raw, bars):
    n = len(ids)
    columns = [pa.array(buckets), pa.array(blocks), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(ids), raw, pa.array(bars, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, [*_CELL, "kind", "id", "v", "bar"])


def _vectors_in_cells(index: Index, top: int):
    """Each vector in its bucket of each table (kind 0)."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"), np.int64)
            for at, x in _by_size(batch) if len(ids) else ():
                keep = _smallest_of_equal(ids[at], x, top)
                own, x = ids[at][keep], x[keep]
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                for t in range(TABLES):
                    found = index.bucket(np.floor(index.places(x, t, False)), t, x.shape[1])
                    block = (mixed(own.astype(np.uint64)) % index.n_blocks(found).astype(np.uint64)).astype(np.int64)
                    yield _rows(found, block, x.shape[1], 0, own, raw, np.zeros(len(own)))

    return run


def _queries_in_cells(index: Index, first: int, last: int):
    """Each query in every block of the buckets that its probes from `first` to `last` visit (kind 1)."""

    def run(batches):
        for batch in batches:
            ids, bars = np.asarray(batch.column("id"), np.int64), np.asarray(batch.column("bar"), np.float64)
            for at, x in _by_size(batch) if len(ids) else ():
                for start in range(0, len(at), 256):
                    q, some = at[start : start + 256], x[start : start + 256]
                    raw = [r.tobytes() for r in some]
                    for t in range(TABLES):
                        places = index.places(some, t, True)
                        cells = np.floor(places).astype(np.int64)[:, None, :] + index.steps(places, last)[:, first:]
                        found = index.bucket(cells, t, x.shape[1])
                        blocks = index.n_blocks(found).ravel()
                        who = np.repeat(np.repeat(np.arange(len(q)), found.shape[1]), blocks)
                        number = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        buckets = np.repeat(found.ravel(), blocks)
                        for part in range(0, len(who), 16_384):
                            piece = slice(part, part + 16_384)
                            w = who[piece]
                            yield _rows(buckets[piece], number[piece], x.shape[1], 1, ids[q[w]], pa.array([raw[i] for i in w], pa.binary()), bars[q[w]])

    return run


def best_of(qids, q, bars, ids, x, top):
    """For each query the positions and exact scores of its best rows that reach its bar, ties to smaller ids. `ids` are
    sorted."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    rough = q @ x.T
    # The query's own rows, wherever they are.
    lo, hi = np.searchsorted(ids, qids), np.searchsorted(ids, qids, "right")
    for i in np.flatnonzero(hi > lo):
        rough[i, lo[i] : hi[i]] = -np.inf
    n = min(top, len(ids))
    bar = np.maximum(np.partition(rough, len(ids) - n, 1)[:, len(ids) - n], bars)
    slack = 1e-12 * np.abs(q).sum(1) * np.abs(x).max(initial=0)
    for i in range(len(q)):
        at = np.flatnonzero((rough[i] >= bar[i] - slack[i]) & (rough[i] > -np.inf))
        exact = (x[at] * q[i]).sum(1)
        order = np.lexsort((ids[at], -exact))[:n]
        yield at[order], exact[order]


def _cell_best(dtype, top: int):
    """(query, id, score) of the best rows of each cell; a cell's vectors come before its queries."""

    def matrix(rows):
        return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)

    def results(qids, queries, bars, ids, vectors):
        out = list(best_of(np.array(qids), matrix(queries), np.array(bars), ids, vectors, top))
        n = [len(at) for at, _ in out]
        found = np.concatenate([ids[at] for at, _ in out])
        score = np.concatenate([s for _, s in out])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    def run(batches):
        cell, ids, vectors, ready, asked = None, [], [], None, {}

        def answer():
            if asked and len(ready[0]):
                keys = list(asked)
                yield results([k[0] for k in keys], [k[1] for k in keys], list(asked.values()), *ready)
            asked.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*_CELL, "kind", "id", "v", "bar"]]
            for bucket, block, dim, kind, i, v, bar in zip(*columns, strict=True):
                if (bucket, block, dim) != cell:
                    yield from answer()
                    cell, ids, vectors, ready = (bucket, block, dim), [], [], None
                if kind == 0:
                    if not ids or ids[-1] != i or vectors[-1] != v:
                        ids.append(i)
                        vectors.append(v)
                else:
                    if ready is None:
                        ready = np.array(ids, np.int64), matrix(vectors) if ids else None
                    asked[i, v] = bar
                    if len(asked) >= 512:
                        yield from answer()
        yield from answer()

    return run


def _best_in_cells(cells: DataFrame, dtype, top: int) -> DataFrame:
    cells = cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "kind", "id", "v")
    return cells.mapInArrow(_cell_best(dtype, top), "query_id long, vec_id long, score double")


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best `top` of each query, ranked; a row that several tables gave counts once."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _scan(qids: np.ndarray, queries: list[np.ndarray], top: int):
    """The best rows for a few queries among all rows of a task."""

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            ids = np.asarray(batch.column("id"), np.int64)
            for at, x in _by_size(batch) if len(ids) else ():
                mine = [i for i, q in enumerate(queries) if len(q) == x.shape[1]]
                if not mine:
                    continue
                order = np.argsort(ids[at], kind="stable")
                sorted_ids, x = ids[at][order], x[order]
                found = best_of(qids[mine], np.stack([queries[i] for i in mine]), -np.inf, sorted_ids, x, top)
                for i, (best, score) in zip(mine, found, strict=True):
                    old = held.get(i, (np.empty(0, np.int64), np.empty(0), np.empty((0, x.shape[1]), x.dtype)))
                    all_ids, all_scores = np.append(old[0], sorted_ids[best]), np.append(old[1], score)
                    all_x = np.concatenate([old[2], x[best]])
                    _, distinct = np.unique(all_ids, return_index=True)
                    keep = distinct[np.lexsort((all_ids[distinct], -all_scores[distinct]))][:top]
                    held[i] = all_ids[keep], all_scores[keep], all_x[keep]
        out = [(int(i), int(v), float(s), x.astype(np.float64).tolist()) for i, own in held.items() for v, s, x in zip(*own, strict=True)]
        names, types = ["trial", "vec_id", "score", "v"], (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return run


def true_neighbours(rows: DataFrame, qids: np.ndarray, queries: list[np.ndarray], top: int = TOP) -> DataFrame:
    """(trial, vec_id, score, v): the true neighbours of a few queries, held against every row."""
    found = rows.mapInArrow(_scan(qids, queries, top), "trial long, vec_id long, score double, v array<double>")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def fit(rows: DataFrame, every: int = EVERY, top: int = TOP) -> Index | None:
    """An index for (id, v), or None without any query."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dims, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    draw = F.xxhash64("id")
    trials = rows.where(F.col("id") % every == 0).orderBy(draw, "id", F.xxhash64("v")).limit(TRIALS).collect()
    if not trials:
        return None
    sample = rows.orderBy(draw, "id", F.xxhash64("v")).limit(FIT).toArrow().combine_chunks()
    sample = [x for batch in sample.to_batches() for _, x in _by_size(batch)]
    qids, queries = np.array([t["id"] for t in trials]), [np.array(t["v"], np.float64) for t in trials]
    truth: list[list] = [[] for _ in trials]
    for r in true_neighbours(rows, qids, queries, top).collect():
        truth[r["trial"]].append(np.array(r["v"], np.float64))
    index = Index(dims, min(float(np.sqrt(longest)), 1e150))
    index.k = FUNCTIONS
    spread = np.concatenate([index.places(x, 0, False) for x in sample]).std(0).mean()
    index.width = WIDTH * max(float(spread), 1e-300)
    best = None
    n_sample = sum(len(x) for x in sample)
    for k in range(1, max(2, min(FUNCTIONS, int(np.ceil(np.log2(max(n / BUCKET, 2)) / 1.4)) + 1)) + 1):
        index.k = k
        mass: dict[int, int] = {}
        for t in range(TABLES):
            for x in sample:
                for b, c in zip(*np.unique(index.bucket(np.floor(index.places(x, t, False)), t, x.shape[1]), return_counts=True), strict=True):
                    mass[int(b)] = mass.get(int(b), 0) + int(c)
        rows_at, hits = np.zeros(PROBES), np.full(sum(map(len, truth)), PROBES)
        done = 0
        for q, found in zip(queries, truth, strict=True):
            for t in range(TABLES):
                places = index.places(q[None], t, True)
                cells = np.floor(places).astype(np.int64) + index.steps(places, PROBES)[0]
                visited = [int(b) for b in index.bucket(cells, t, len(q))]
                own = np.array([mass.get(b, 0) for b in visited] + [0] * (PROBES - len(visited)), float)
                rows_at += own / len(queries) * n / n_sample
                rank = {b: i for i, b in reversed(list(enumerate(visited)))}
                if found:
                    there = index.bucket(np.floor(index.places(np.stack(found), t, False)), t, len(q))
                    ranks = np.array([rank.get(int(b), PROBES) for b in there])
                    hits[done : done + len(found)] = np.minimum(hits[done : done + len(found)], ranks)
            done += len(found)
        recall = np.cumsum(np.bincount(hits, minlength=PROBES + 1)[:PROBES]) / max(len(hits), 1)
        enough = np.flatnonzero(recall >= RECALL) if len(hits) else np.zeros(1, int)
        if len(enough):
            probes = int(enough[0]) + 1
            work = rows_at[:probes].sum() + PROBE_ROWS * TABLES * probes
            if best is None or work < best[0]:
                best = work, k, probes, mass
    # One function and its neighbour cells are the coarsest index.
    _, index.k, index.probes, mass = best or (0, 1, 3, mass if index.k == 1 else {})
    large = {b: -(-c * n // (n_sample * BLOCK)) for b, c in mass.items() if c * n > n_sample * BLOCK}
    index.buckets = np.array(sorted(large), np.int64)
    index.blocks = np.array([large[b] for b in sorted(large)], np.int64)
    return index


def neighbours(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row whose id is divisible by `every`."""
    rows = usable(vectors)
    index = fit(rows, every, top)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dtype = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    asked = rows.where(F.col("id") % every == 0)
    cells = rows.mapInArrow(_vectors_in_cells(index, top), _ROWS)
    no_bar = asked.withColumn("bar", F.lit(float("-inf")))
    own = cells.unionByName(no_bar.mapInArrow(_queries_in_cells(index, 0, 1), _ROWS))
    found = cut_lineage(_merged(_best_in_cells(own, dtype, top), top), "own")
    if index.probes > 1:
        bars = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
        barred = asked.join(bars.hint("merge"), "id", "left").fillna(float("-inf"), "bar")
        others = cells.unionByName(barred.mapInArrow(_queries_in_cells(index, 1, index.probes), _ROWS))
        both = found.drop("rank").unionByName(_best_in_cells(others, dtype, top))
        found = cut_lineage(_merged(both, top), "found")
    # Queries with too few candidates meet all rows in blocks.
    filled = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"))
    short = cut_lineage(asked.join(filled.hint("merge"), "id", "left_anti"), "short")
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    blocks = max(1, rows.count() // BLOCK)
    raw = lambda df, kind, block: df.select(
        F.lit(0).cast("long").alias("bucket"), block.alias("block"), F.size("v").alias("dim"), F.lit(kind).alias("kind"), "id", "v", F.lit(float("-inf")).alias("bar")
    )
    cells = raw(rows, 0, F.pmod(F.xxhash64("id"), F.lit(blocks))).unionByName(raw(short, 1, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1)))))
    cells = cells.mapInArrow(_as_bytes, _ROWS)
    more = _merged(_best_in_cells(cells, dtype, top), top)
    late = short.select(F.col("id").alias("query_id")).distinct()
    found = found.join(late.hint("merge"), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")


def _as_bytes(batches):
    for batch in batches:
        column, at = batch.column("v"), batch.schema.get_field_index("v")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(column.value_lengths()))
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        raw = pa.array([flat[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
        yield batch.set_column(at, "v", raw)


@register("op12_neighbours")
def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all vectors."""
    return neighbours(table(spark, sf_dir, "embeddings"))
