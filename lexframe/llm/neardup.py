"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents of one set form one node of the join.
Each node has a signature of minwise shingles. In each of `TREES` independent trees a node
walks down paths: at every step the path's hash selects one signature place, or two of them in a
quarter of the cases (1 / threshold on average), and the path goes on with the minwise shingle there.
Nodes on one path share its shingles. Paths with few nodes are compared exhaustively by signature;
paths with many are branched once more, and what is still large at `DEPTH` is taken as it is.
Every comparison gives candidate links as a spanning forest, never all pairs. A pair at the
threshold meets in a tree with probability of about 0.84 for each level, so that twelve trees miss
it with less than 1e-9 at the first level and about 2e-4 at the last.

Candidate components are confirmed on full sets: each whole text of a component is sent once, and
exact Jaccard links become a forest again. A component above `BLOCK_BYTES` is cut into blocks whose
pairs are separate tasks; no task holds more than two blocks. Links between nodes already joined
need no test, as only the components are asked for.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle; repeated rows and equal sets are one group; a null id
is the smallest of none (its component is the least other id, or null); an empty table gives
no rows; other columns are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table, whole
from lexframe.llm.graph import components
from lexframe.llm.words import mixed, shingle_set

#: Words of a shingle in the query and in the pipeline; hundredths of similarity that link.
WIDTH, STAGE_WIDTH, SIMILARITY = 4, 5, 80
TREES, DEPTH, LEAF, PLACES = 12, 4, 512, 128
#: Signature share that a pair needs to be tested on; five standard deviations below the threshold.
LIKELY = 0.62
BLOCK_BYTES = 32 << 20

_RNG = np.random.default_rng(7_919)
_FACTORS = _RNG.integers(1, 1 << 62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise shingles under `PLACES` orders, as 32-bit values."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048]
        part = part ^ (part >> np.uint64(29))
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(1), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sizes, nodes, sigs = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py() or b"", width)
                sizes.append(len(found))
                digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(digest, "little", signed=True) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "key", "n_shingles", "node", "sig"],
            )

    return run


def _paths(first: bool):
    """Rows (path, node) of the next level, from (path, node, sig); the first level has no path."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            nodes = np.asarray(batch.column("node"), np.int64)
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(nodes), PLACES)
            rows = np.arange(len(nodes))
            if first:
                starts = [(mixed(np.full(len(nodes), tree + 1, np.uint64)), rows) for tree in range(TREES)]
            else:
                starts = [(np.asarray(batch.column("path"), np.int64).view(np.uint64), rows)]
            paths, owners = [], []
            for path, own in starts:
                two = mixed(path + _STEP) % np.uint64(4) == 0
                at = (mixed(path ^ _STEP) % np.uint64(PLACES)).astype(np.int64)
                # The second place differs from the first, so that a node never walks one path twice.
                other = (at + 1 + (mixed(path * _STEP + np.uint64(1)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
                for place, take in ((at, np.ones(len(path), bool)), (other, two)):
                    token = sigs[own[take], place[take]].astype(np.uint64)
                    paths.append(mixed(path[take] + mixed(token * np.uint64(PLACES) + place[take].astype(np.uint64))))
                    owners.append(nodes[own[take]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view(np.int64)), pa.array(np.concatenate(owners))], ["path", "node"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _near(sigs: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Rows after i that may be similar to i by size and signature."""
    rest = np.arange(i + 1, len(sizes))
    a, b = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    rest = rest[100 * a >= SIMILARITY * b]
    return rest[(sigs[rest] == sigs[i]).sum(1) >= LIKELY * PLACES]


def _runs(batches, keys: list[str]):
    """Lists of rows with equal keys; rows come sorted by them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, run in groupby(rows, key=lambda row: [row[k] for k in keys]):
        yield run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _shared_paths(batches):
    """(path, node, least, large): the nodes on paths that have several. A path is large from `LEAF` + 1 nodes on, of
    which no more are held; `least` is its first node. Rows come sorted by path and node."""
    held, path, least, n = [], None, 0, 0
    for batch in batches:
        paths, nodes = np.asarray(batch.column("path"), np.int64), np.asarray(batch.column("node"), np.int64)
        out: list[tuple] = []
        for p, node in zip(paths.tolist(), nodes.tolist(), strict=True):
            if p != path:
                if 1 < n <= LEAF:
                    out += [(path, x, least, False) for x in held]
                held, path, least, n = [], p, node, 0
            n += 1
            if n <= LEAF:
                held.append(node)
            else:
                out += [(p, x, least, True) for x in (*held, node)]
                held = []
        yield _path_rows(out)
    yield _path_rows([(path, x, least, False) for x in held] if 1 < n <= LEAF else [])


def _path_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "node", "least", "large"])


def _leaf_links(batches):
    """Candidate links inside each leaf, which has at most `LEAF` rows."""
    found = []
    for run in _runs(batches, ["path"]):
        run = list(run)
        nodes, sizes = [r["node"] for r in run], np.array([r["n_shingles"] for r in run])
        sigs = np.frombuffer(b"".join(r["short"] for r in run), np.uint8).reshape(len(run), PLACES)
        forest = _Forest(len(run))
        for i in range(len(run) - 1):
            found += [(nodes[i], nodes[j]) for j in _near(sigs, sizes, i) if forest.join(i, int(j))]
        if len(found) > 10_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _exact_links(width: int):
    def run(batches):
        for group in _runs(batches, ["root", "lo", "hi"]):
            nodes, blocks, sets, last = [], [], [], None
            for row in group:  # sorted by node; a repeated row is passed over
                if row["node"] != last:
                    last = row["node"]
                    nodes.append(last)
                    blocks.append(row["block"])
                    sets.append(shingle_set(row["text"], width))
            if len(nodes) < 2:
                continue
            sigs, sizes, blocks = np.stack([signature(s) for s in sets]), np.array([len(s) for s in sets]), np.array(blocks)
            across, forest, found = len(set(blocks.tolist())) > 1, _Forest(len(nodes)), []
            for i in range(len(nodes) - 1):
                for j in _near(sigs, sizes, i):
                    if (across and blocks[i] == blocks[j]) or forest.root(i) == forest.root(int(j)):
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                        forest.join(i, int(j))
                        found.append((nodes[i], nodes[j]))
            yield _edges(found)

    return run


def _key():
    return F.xxhash64("text")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that the trees propose, as forests. `nodes` has node, n_shingles and sig."""
    level, found = nodes.select("node", "sig").mapInArrow(_paths(True), "path long, node long"), []
    for depth in range(1, DEPTH + 1):
        rows = level.repartition("path").sortWithinPartitions("path", "node")
        rows = cut_lineage(rows.mapInArrow(_shared_paths, "path long, node long, least long, large boolean"), "shared")
        found.append(rows)
        large = rows.where("large")
        if depth == DEPTH or large.isEmpty():
            break
        level = large.select("path", "node").join(nodes.select("node", "sig"), "node").mapInArrow(_paths(False), "path long, node long")
    rows = found[0].where("NOT large")
    for more in found[1:]:
        rows = rows.unionByName(more.where("NOT large"))
    short = nodes.select("node", "n_shingles", F.concat(*[F.substring("sig", 4 * i + 1, 1) for i in range(PLACES)]).alias("short"))
    # Both sides grow with the corpus; neither is ever broadcast.
    leaves = rows.select("path", "node").join(short.hint("merge"), "node").repartition("path").sortWithinPartitions("path", "node")
    links = leaves.mapInArrow(_leaf_links, "a long, b long")
    if len(found) == DEPTH:
        links = links.unionByName(found[-1].where("large").select(F.col("node").alias("a"), F.col("least").alias("b")))
    return links


def confirmed_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(a, b): exact links inside the components of the candidate links, as forests."""
    roots = components(links)
    roots = roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    chosen = nodes.join(roots, "node").select("node", "root", "rep.id", "rep.key", "n_shingles")
    weight = chosen.groupBy("root").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + PLACES * 4) / BLOCK_BYTES).alias("blocks"))
    chosen = cut_lineage(chosen.join(weight, "root").drop("n_shingles"), "chosen")
    texts = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), _key().alias("key"), F.col("text").cast("binary").alias("text"))
    # Of repeated rows one is read. Both sides grow with the corpus; neither is ever broadcast.
    texts = texts.dropDuplicates(["id", "key"])
    rows = texts.join(chosen.hint("merge"), ["id", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "text")
    rows = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")
    return rows.mapInArrow(_exact_links(width), "a long, b long")


def _grouped(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sets as (doc_id, key, n_shingles, node), where an empty set has no node, and the nodes as (node, group,
    rep, least): the first document of each node and its least id."""
    rows = docs.select(F.col("doc_id").cast("long"), _key().alias("key"), F.col("text").cast("binary").alias("text"))
    rows = cut_lineage(rows.mapInArrow(_sets(width), "doc_id long, key long, n_shingles long, node long, sig binary"), "sets")
    rep = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "key")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min(rep).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min("doc_id").alias("least")
    )
    nodes = cut_lineage(nodes, "nodes")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    links = components(confirmed_links(docs, nodes, candidate_links(nodes), width))
    group = F.coalesce("b", "node").alias("group")
    return rows.drop("sig"), nodes.join(links, F.col("node") == F.col("a"), "left").select("node", group, "rep", "least")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, node (null: empty set), group, component_id."""
    rows, grouped = _grouped(docs, width)
    grouped = cut_lineage(grouped.drop("rep"), "grouped")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    found = grouped.select("node", "group").join(least, "group")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(found, "node", "left").select("doc_id", "key", "n_shingles", "node", "group", own.alias("component_id"))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, that of the smallest id, by shingles of five words. Of repeated rows
    one stays; documents without words stay all."""
    _, grouped = _grouped(docs, STAGE_WIDTH)
    chosen = grouped.groupBy("group").agg(F.min("rep").alias("rep")).select(F.col("rep.id").alias("__id"), F.col("rep.key").alias("__key"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    has_word = F.regexp_like(whole("text"), F.lit(r"[^\x20\x09-\x0D]"))
    rows = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("__id"), _key().alias("__key"), has_word.alias("__words"))
    kept = rows.where("__words").join(chosen.hint("merge"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return kept.select("__row.*").unionByName(rows.where("NOT __words").select("__row.*"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inner_n FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inner_n >= 80 * (x.n + y.n - inner_n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


@register("op10_near_dedup", OP10_SQL)
def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and the smallest id among its near copies."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
