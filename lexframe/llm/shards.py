"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. Each shard has a weight; a rack weighs what its shards weigh,
a region what its racks weigh. A row descends: among the regions it makes one weighted draw for each, an
exponential variable of the region's weight taken from a hash of its key and the region's name, and the
smallest wins; then it draws among the racks of that region, and then among the shards of that rack. A draw
depends on the key, on one node's name and on its weight. When the weight of a shard changes, only its rack and
its region change theirs: rows move between regions only into or out of that region, inside it only into
or out of that rack, and inside the rack only into or out of that shard; other regions and racks keep what stays with
them in place.

A tree grows by a region of its own for each new shard, so that no other weight changes and the new shard
takes rows only into itself.

Law: `key`. The key and the tree decide; text, order and neighbours don't.

Defined cases: a null key is a key like any other, the empty one; a null text has size 1 and checksum 0;
repeated rows go to one shard and get slots of their own; an empty table gives no rows; columns
of the input named as those made here are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.base import fresh_path, register, table, whole

#: Hex digits of a hash that name the parts of a shard, which are numbered side by side; rows that one step of
#: numbering makes of equal ones.
PART_DIGITS, PIECE = 3, 1 << 16
#: Hex digits of a hash that make a draw.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def default_tree(count: int, racks: int = 4, regions: int = 2) -> tuple[Shard, ...]:
    """`count` equal shards, dealt to racks in turn."""
    return tuple(Shard(f"region{i % racks % regions}", f"rack{i % racks}", i) for i in range(count))


def grown(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a rack and a region of its own."""
    number = max((s.number for s in tree), default=-1) + 1
    return (*tree, Shard(f"region of {number}", f"rack of {number}", number, weight))


def _children(tree: tuple[Shard, ...]) -> list[dict[str, dict[str, float]]]:
    """For each level the nodes' children with their weights; nodes are named by their path."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        region, rack = f"/{s.region}", f"/{s.region}/{s.rack}"
        for level, node, child in ((0, "", region), (1, region, rack), (2, rack, f"{rack}/{s.number}")):
            own = levels[level].setdefault(node, {})
            own[child] = own.get(child, 0.0) + s.weight
    return levels


def _winner(key: Column, children: Column) -> Column:
    """The name of the child with the smallest draw, equal ones by name."""

    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit("|"), child["name"]).cast("binary"))
        bits = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(16**DRAW_DIGITS))) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def with_shard(df: DataFrame, key: str, tree: tuple[Shard, ...], out: str = "shard") -> DataFrame:
    """Adds the shard's number. A row makes draws for the children of three nodes only."""
    live = tuple(s for s in tree if s.weight > 0)
    if not live:
        raise ValueError("the tree has no shard of positive weight")
    if len({s.number for s in live}) < len(live):
        raise ValueError("two shards have one number")
    kept = [c for c in df.columns if c != out]
    rows = df.select(*kept, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.lit("").alias("__node"))
    for nodes in _children(live):
        # The tree is part of the plan: a map from each node of the level to its children.
        pairs = []
        for node, own in nodes.items():
            pairs += [F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in own.items()])]
        rows = rows.withColumn("__node", _winner(F.col("__key"), F.element_at(F.create_map(*pairs), F.col("__node"))))
    return rows.select(*kept, F.substring_index("__node", "/", -1).cast("int").alias(out))


def with_slot(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap; `df` is told by `shard`, `order` and columns that depend on
    these. A shard is numbered in parts: counts of the parts give each its offset, so that no task sees a whole shard.
    Equal rows are counted before, and made rows again in pieces."""
    kept = [c for c in df.columns if c != out]
    rows = df.groupBy(*kept).agg(F.count(F.lit(1)).alias("__n"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    rows = rows.withColumn("__part", F.substring(F.md5(name.cast("binary")), 1, PART_DIGITS))
    counts = rows.groupBy(F.col(shard).alias("__shard"), "__part").agg(F.sum("__n").alias("__sum"))
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(shard, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__ahead", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    rows = rows.join(offsets, (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__p")))
    first = F.col("__before") + F.col("__ahead")
    rows = rows.select(*kept, first.alias("__first"), "__n", F.explode(F.expr(f"sequence(0L, __n - 1, {PIECE}L)")).alias("__at"))
    piece = F.explode(F.expr(f"sequence(__at, least(__at + {PIECE - 1}, __n - 1))")).alias("__i")
    return rows.select(*kept, "__first", piece).select(*kept, (F.col("__first") + F.col("__i")).cast("long").alias(out))


def place(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard. Only
    these narrow columns are shuffled."""
    rows = docs.select(
        "doc_id",
        (F.octet_length(whole("text")) + 1).cast("long").alias("size"),
        F.crc32(whole("text").cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = default_tree(shards)
    rows = with_shard(with_shard(rows, "doc_id", tree), "doc_id", grown(tree), "grown_shard")
    rows = with_slot(rows, "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 16, files: int = 8) -> str:
    """Writes the documents by shard, each shard in up to `files` files made side by side."""
    path = path or fresh_path(docs.sparkSession, "shards")
    placed = with_shard(docs, "doc_id", default_tree(shards))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    placed.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(path)
    return path


def shard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard."""
    return with_shard(docs, "doc_id", default_tree(16))


_TREE_SQL = """
leaves AS (SELECT i AS number, '/region' || (i % 4 % 2) AS region, '/region' || (i % 4 % 2) || '/rack' || (i % 4) AS rack,
    '/region' || (i % 4 % 2) || '/rack' || (i % 4) || '/' || i AS leaf, false AS new FROM range(16) t(i)
  UNION ALL SELECT 16, '/region of 16', '/region of 16/rack of 16', '/region of 16/rack of 16/16', true),
keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),
trees AS (SELECT false AS more UNION ALL SELECT true),
nodes AS (SELECT more, '' AS up, region AS node, count(*) AS w FROM trees, leaves WHERE more OR NOT new GROUP BY ALL
  UNION ALL SELECT more, region, rack, count(*) FROM trees, leaves WHERE more OR NOT new GROUP BY ALL
  UNION ALL SELECT more, rack, leaf, count(*) FROM trees, leaves WHERE more OR NOT new GROUP BY ALL),
draws AS (SELECT k, more, up, node, row_number() OVER (PARTITION BY k, more, up ORDER BY
    -ln((('0x' || substr(md5(k || '|' || node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / w, node) AS place FROM keys, nodes),
won AS (SELECT * FROM draws WHERE place = 1),
found AS (SELECT a.k, a.more, split_part(c.node, '/', 4)::INT AS shard FROM won a JOIN won b ON b.k = a.k AND b.more = a.more AND b.up = a.node
  JOIN won c ON c.k = a.k AND c.more = a.more AND c.up = b.node WHERE a.up = '')"""

#: CRC-32 of the UTF-8 bytes, step by step.
_CRC_SQL = """
polynomial AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
bytes AS (SELECT t, list_prepend(4294967295, list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(hex(t), 2 * i - 1, 2))::BIGINT)) AS b FROM texts),
sums AS (SELECT t, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, polynomial)"""

OP7_SQL = f"""
WITH {_TREE_SQL}, {_CRC_SQL},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, crc::BIGINT AS text_crc32
  FROM documents JOIN sums ON t = coalesce(text, ''))
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, f.shard, g.shard AS grown_shard,
  row_number() OVER (PARTITION BY f.shard ORDER BY substr(md5(k || ':' || text_crc32 || ':' || size), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM d JOIN found f USING (k) JOIN found g USING (k) WHERE NOT f.more AND g.more
"""


@register("op7_sharding", OP7_SQL)
def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard among 16, its slot there, and its shard among 17."""
    return place(table(spark, sf_dir, "documents"))
