"""The prefix trie of rebuilt conversations, with subtree totals by time-forward processing.

1. Turns are ranged by (conversation, turn), so that a conversation of any length spreads over tasks;
   each task numbers its stretch and the few conversations that cross a border get an offset.
2. A node is known by its depth and the xor of 128-bit hashes of its turns with their places. Prefixes
   are running xors inside stretches of one conversation, and the stretches' own xors on top.
3. Nodes fall into shards. The depths are cut into bands, at most `BANDS`; in the first band a sample of
   conversations names the nodes with a large share of all members (`top`). A shard unit is a subtree
   of a band below its first level or below the top; the top is a unit of its own.
4. Within a shard the nodes are sorted externally by reverse level order. Each node takes the messages
   addressed to it from a priority queue, which spills sorted runs, adds its own part and sends its
   totals to its parent's place in time. Shard roots send theirs out; these are summed by parent and
   join the next round: deeper bands before upper ones, units before the top.

Defined cases: rows without conv_id belong to no conversation and are left out; a null role or text is
empty; turns go by number, null first, rows of one number by role and then by a hash of the text, and
repeated rows all count; a conversation may be rebuilt to no turns and is then a member of the root alone;
`c - c % 100` of a negative id goes towards zero; an empty table gives no rows, not even the root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table, whole

#: Levels of a band at least, and bands at most.
LEVELS, BANDS = 64, 16
#: Conversations in the sample that names the top, and how many of them make a node a top one. At most
#: SAMPLE * LEVELS / MEMBERS nodes are sent to all tasks, 32,768 (under 1 MB).
SAMPLE, MEMBERS = 4_096, 8
#: Turns of a conversation that are joined in one task; messages held in memory; ids in one piece.
STRETCH, HELD, PIECE = 4_096, 200_000, 4_096
#: The rebuilding rule: conversations share the head of the one whose number ends in 00.
BLOCK, HEADS = 100, 6

NODE = ["depth", "ka", "kb"]


def _numbered(batches):
    last, count = None, 0
    for batch in batches:
        conv = np.asarray(batch.column("conv"), np.int64)
        if not len(conv):
            continue
        at = np.arange(len(conv))
        starts = np.append(True, conv[1:] != conv[:-1])
        place = at - np.maximum.accumulate(np.where(starts, at, 0)) + 1
        if last == conv[0]:
            place[: np.argmax(np.append(starts[1:], True)) + 1] += count
        last, count = conv[-1], place[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, a, b, size): every turn with its place in its conversation, hashes of role and text, and the
    text's code points."""
    role, text = whole("role"), whole("text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.char_length(text).alias("size"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "a", "b", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", F.spark_partition_id().alias("part"), "a", "b", "size")
    rows = cut_lineage(rows.mapInArrow(_numbered, "conv long, part int, a long, b long, size int, place long"), "turns")
    stretch = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("conv", "part").agg(F.max("place").alias("n")).withColumn("ahead", F.sum("n").over(stretch))
    # At most one conversation goes on into each partition of the range.
    ahead = F.broadcast(ahead.where("ahead IS NOT NULL").select("conv", "part", "ahead"))
    place = F.col("place") + F.coalesce("ahead", F.lit(0))
    return rows.join(ahead, ["conv", "part"], "left").select("conv", place.alias("place"), "a", "b", "size")


def shared_heads(turns: DataFrame) -> DataFrame:
    """(conv, base, n, own_from, head, length): how each conversation is rebuilt. It takes `head` turns of `base`, then
    its own turns after `own_from`."""
    convs = turns.groupBy("conv").agg(F.max("place").alias("n"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    convs = convs.withColumn("own_from", F.crc32(F.col("conv").cast("string")) % HEADS)
    bases = convs.where("conv = base").select("base", F.col("n").alias("base_n"))
    head = F.least("own_from", F.coalesce("base_n", F.lit(0)))
    length = F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("own_from"))
    return convs.join(bases.hint("merge"), "base", "left").withColumn("head", head).drop("base_n").withColumn("length", length)


def prefixes(turns: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """(conv, length, depth, band, ka, kb, za, zb, size): the node of every turn of the rebuilt conversations but the
    root; xor with (za, zb) gives the parent."""
    long = convs.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STRETCH}"))))
    own = turns.withColumn("stretch", F.expr(f"(place - 1) div {STRETCH}"))
    own = own.join(long.drop("n", "base").hint("merge"), ["conv", "stretch"]).where("place > own_from")
    own = own.select("conv", "length", (F.col("place") - F.col("own_from") + F.col("head")).alias("depth"), "a", "b", "size")
    heads = turns.where(f"place < {HEADS} AND conv % {BLOCK} = 0").withColumnRenamed("conv", "base")
    heads = heads.join(convs.select("conv", "base", "length", "head").hint("merge"), "base").where("place <= head")
    rows = own.unionByName(heads.select("conv", "length", F.col("place").alias("depth"), "a", "b", "size"))
    rows = rows.select(
        "conv", "length", "depth", F.expr(f"depth div {levels}").alias("band"), "size",
        F.xxhash64("a", "b", "depth").alias("za"), F.xxhash64("b", "depth", "a").alias("zb"),
    )
    path = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("ka", F.bit_xor("za").over(path)).withColumn("kb", F.bit_xor("zb").over(path))
    bands = rows.where(F.col("length") >= levels).groupBy("conv", "band").agg(F.bit_xor("za").alias("xa"), F.bit_xor("zb").alias("xb"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("conv", "band", F.bit_xor("xa").over(before).alias("xa"), F.bit_xor("xb").over(before).alias("xb"))
    found = found.join(bands.where("xa IS NOT NULL").hint("merge"), ["conv", "band"], "left")
    whole_key = lambda k, x: F.col(k).bitwiseXOR(F.coalesce(x, F.lit(0).cast("long"))).alias(k)
    return found.select("conv", "length", "depth", "band", "size", "za", "zb", whole_key("ka", "xa"), whole_key("kb", "xb"))


def with_units(paths: DataFrame, top: DataFrame) -> DataFrame:
    """Adds the shard unit of each node, (ua, ub), and whether it is a root of its unit. The top has the unit (0, 0)."""
    rows = paths.join(F.broadcast(top.withColumn("top", F.lit(True))), NODE, "left").withColumn("top", F.col("top").isNotNull())
    path = Window.partitionBy("conv", "band").orderBy("depth")
    begins = ~F.col("top") & F.coalesce(F.lag("top").over(path), F.lit(True))
    rows = rows.withColumn("root", begins)
    unit = lambda k: F.coalesce(F.last(F.when(F.col("root"), F.col(k)), ignorenulls=True).over(path), F.lit(0).cast("long"))
    return rows.withColumn("ua", unit("ka")).withColumn("ub", unit("kb"))


class SpillingQueue:
    """A priority queue of tuples that keeps at most `held` in memory; the rest waits in sorted runs on disk,
    which live as long as the task."""

    def __init__(self, held: int = HELD, fan: int = 32):
        self.held, self.fan = held, fan
        self.heap: list = []
        self.runs: list = []  # heap of (first entry, number, rest)
        self.count = 0

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self._add(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > self.fan:
                runs, self.runs = self.runs, []
                self._add(heapq.merge(*[self._all(first, rest) for first, _, rest in runs]))

    @staticmethod
    def _all(first, rest):
        yield first
        yield from rest

    def _add(self, entries: Iterator) -> None:
        rest = self._stored(entries)
        first = next(rest, None)
        if first is not None:
            self.count += 1
            heapq.heappush(self.runs, (first, self.count, rest))

    @staticmethod
    def _stored(entries: Iterator) -> Iterator:
        file = tempfile.TemporaryFile()
        block: list = []
        for entry in entries:
            block.append(entry)
            if len(block) == 1_000:
                pickle.dump(block, file)
                block = []
        pickle.dump(block, file)
        file.seek(0)

        def read():
            with file:
                while block := pickle.load(file):
                    yield from block
                    if len(block) < 1_000:
                        return

        return read()

    def pop(self, key: tuple) -> Iterator[tuple]:
        """The entries that begin with `key`, which must be the least ones."""
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:n] == key:
            first, number, rest = self.runs[0]
            following = next(rest, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, rest))
            yield first


_SENT = ["in_children", "in_leaves", "in_saved"]
_TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _time_forward(held: int):
    """Adds subtree totals to nodes that come in reverse level order."""

    def run(batches):
        queue = SpillingQueue(held)
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in [*NODE, "pa", "pb", "root", "n_convs", "size", *_SENT]}
            out = []
            for depth, ka, kb, pa_, pb, root, n, size, children, leaves, saved in zip(*column.values(), strict=True):
                for message in queue.pop((-depth, ka, kb)):
                    children += 1
                    leaves += message[3]
                    saved += message[4]
                leaves = leaves if children else 1
                saved += (n - 1) * size
                if not root:
                    queue.push((1 - depth, pa_, pb, leaves, saved))
                out.append((children, leaves, saved))
            keep = [i for i, c in enumerate(batch.schema.names) if c not in _SENT]
            totals = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *totals], [*[batch.schema.names[i] for i in keep], *_TOTALS])

    return run


def subtree_totals(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Adds n_children, n_leaves and saved_tokens to `nodes`, which has band, top, root, the keys of node, parent
    and unit, n_convs and size. Rounds are (band, top), at most `BANDS` + 1 of them."""
    rounds = sorted((r["band"], r["top"]) for r in nodes.select("band", "top").distinct().collect())
    # The deepest band first; in the first band the units below the top before the top.
    rounds = sorted(rounds, key=lambda r: (-r[0], r[1]))
    done: DataFrame | None = None
    for band, top in rounds:
        part = nodes.where((F.col("band") == band) & (F.col("top") == top))
        if done is None:
            part = part.select("*", *[F.lit(0).cast("long").alias(c) for c in _SENT])
        else:
            sent = done.where("root").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
                F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved")
            )
            part = part.join(sent.hint("merge"), NODE, "left").fillna(0, _SENT)
        fields = [f for f in part.schema.fields if f.name not in _SENT]
        schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], *[f"{c} long" for c in _TOTALS]])
        part = part.repartition("ua", "ub").sortWithinPartitions(F.desc("depth"), "ka", "kb")
        part = cut_lineage(part.mapInArrow(_time_forward(held), schema), "totals")
        done = part if done is None else done.unionByName(part)
    return nodes.select("*", *[F.lit(0).cast("long").alias(c) for c in _TOTALS]) if done is None else done


def _digests(batches):
    """One SHA-256 for each node over its pieces, which come in order."""
    key, digest, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["depth"], row["ka"], row["kb"])
            if own != key:
                out += [(*key, digest.hexdigest())] if key else []
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["ids"].encode())
        if len(out) > 10_000:
            yield _digest_rows(out)
            out = []
    yield _digest_rows(out + ([(*key, digest.hexdigest())] if key else []))


def _digest_rows(rows):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*NODE, "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """The digest of the ids that end at a node, in pieces of id ranges that hold at most `PIECE` ids."""
    ends = paths.where("depth = length").groupBy(*NODE, F.expr(f"floor(conv / {PIECE}D)").alias("piece"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.agg(ids.alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return pieces.mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, levels: int = LEVELS, members: int = MEMBERS, held: int = HELD) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(conversations)
    convs = cut_lineage(shared_heads(turns), "convs")
    deepest = convs.agg(F.max("length")).first()[0] or 0
    levels = max(levels, -(-(deepest + 1) // BANDS))
    sample = convs.orderBy(F.xxhash64("conv"), "conv").limit(SAMPLE)
    some = prefixes(turns, cut_lineage(sample, "sample"), levels).where(F.col("depth") < LEVELS)
    top = some.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= members).select(*NODE)
    paths = with_units(prefixes(turns, convs, levels), cut_lineage(top, "top"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "band", "za", "zb", "ka", "kb", "ua", "ub")]
    roots = convs.select("conv", "length", *zero, F.lit(0).alias("size"), F.lit(True).alias("top"), F.lit(False).alias("root"))
    paths = cut_lineage(paths.unionByName(roots), "paths")
    # What is taken as the least or largest is the same in all rows of a node.
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").cast("long").alias("size"), F.min("band").alias("band"),
        F.max("top").alias("top"), F.max("root").alias("root"), F.min("ua").alias("ua"), F.min("ub").alias("ub"), F.min("za").alias("za"), F.min("zb").alias("zb"),
    )
    nodes = nodes.join(end_digests(paths).hint("merge"), NODE, "left")
    parent = [F.col("ka").bitwiseXOR(F.col("za")).alias("pa"), F.col("kb").bitwiseXOR(F.col("zb")).alias("pb")]
    nodes = cut_lineage(nodes.select("*", *parent).drop("za", "zb"), "nodes")
    # A parent may have a third of all nodes: adaptive execution splits its children in this join.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(nodes.join(above.hint("merge"), ["depth", "pa", "pb"], "left"), "linked")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return subtree_totals(nodes, held).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS, F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


SQL = """
WITH polynomial AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
), ids AS (
    SELECT conv_id, list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
    FROM ids, polynomial
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
           {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
    FROM conversations
), pieces AS (
    SELECT c.conv_id, 0 AS own, i, t FROM convs c JOIN turns ON turns.conv_id = c.base AND i <= h
    UNION ALL
    SELECT conv_id, 1 AS own, i, t FROM convs JOIN turns USING (conv_id) WHERE i > h
), rebuilt AS (
    SELECT conv_id, coalesce(list(t ORDER BY own, i) FILTER (t IS NOT NULL), []) AS s
    FROM convs LEFT JOIN pieces USING (conv_id) GROUP BY conv_id
), nodes AS (
    SELECT d AS depth, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
    FROM rebuilt, unnest(range(0, len(s) + 1)) r(d) GROUP BY ALL
), valued AS (
    SELECT n.*, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].text) END AS saved,
           (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children
    FROM nodes n
), above AS (
    SELECT d AS depth, p[1:d] AS p, saved, n_children FROM valued, unnest(range(0, depth + 1)) r(d)
), totals AS (
    SELECT depth, p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL
)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, v.ends_sha256
FROM valued v JOIN totals t ON t.depth = v.depth AND t.p = v.p
LEFT JOIN nodes q ON q.depth = v.depth - 1 AND v.depth > 0 AND q.p = v.p[1:v.depth - 1]
"""


@register("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared heads."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
