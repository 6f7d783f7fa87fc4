"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled order, fixed by a hash of id and text, and may be taken
twice, in two rounds. A copy's virtual finish time is the words of its source up to and with it,
divided by the source's target. All copies that start before their source's target are put in
one global order of finish times and taken until the total budget is used. Copies that finish
within their target always fit; of those that straddle it, the first in the order do.

Repeated rows share a place in the order and are counted there. Those of a place that finish within the
target stand in the global order as one entry, a straddling one as its own, so that as many of them are
taken as fit; which ones is the same.

Running sums are never taken in one task: a source is cut into parts by its shuffle hash, the
global order into ranges of finish times; sums of parts give the offsets.

What is taken of a source is a prefix of its order. One cut for each source therefore decides
for whole documents, and no text is shuffled.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
repeated rows follow one another in the order; an empty table gives no rows; a
source without words has target 0; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.base import WORD, cut_lineage, register, table, whole

WEIGHTS = (3, 1, 2)
#: Words to take for each word there is, as a fraction, and rounds over a source at most.
SHARE, ROUNDS = (3, 2), 2
#: Ranges of finish times below the budget; parts in which equal rows are numbered.
RANGES, PARTS = 4096, 64


def size_of() -> Column:
    return F.regexp_count(whole("text"), F.lit(WORD)).cast("long")


def place_of() -> Column:
    """The place in the shuffled order. Equal only for repeated rows."""
    return F.md5(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(whole("text").cast("binary"))).cast("binary")
    )


def source_targets(narrow: DataFrame, weights=WEIGHTS, share=SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, weight, source_size, target, rank): shares by weight, with what lies above
    `rounds` times a source's size given to the others by weight. A row for each source."""
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    sums = sums.select("source", "source_size", rank.alias("rank")).withColumn("weight", weight.cast("long"))
    full = F.col("source_size") * rounds
    order = Window.orderBy(full.cast("double") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    steps = sums.select(
        "*",
        (F.sum("source_size").over(everything) * share[0] / F.lit(share[1])).alias("budget"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("used"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
        F.row_number().over(order).alias("step"),
    )
    # The first step whose source would not be filled sets the level of all later ones.
    level = (F.col("budget") - F.col("used")) / F.col("open")
    stays = full.cast("double") / F.col("weight") > level
    first = F.min(F.when(stays, F.col("step"))).over(everything)
    found = F.struct(
        F.max(F.when(F.col("step") == first, F.col("budget") - F.col("used"))).over(everything).alias("rest"),
        F.max(F.when(F.col("step") == first, F.col("open"))).over(everything).alias("open"),
    )
    steps = steps.withColumns({"first": first, "level": found})
    target = F.when(
        F.col("first").isNull() | (F.col("step") < F.col("first")), full.cast("double")
    ).otherwise(F.col("level.rest") * F.col("weight") / F.col("level.open"))
    return steps.select("source", "weight", "source_size", "rank", target.alias("target"))


def _offsets(rows: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """For each part, the sum of the parts before it within `by`."""
    sums = rows.groupBy(*by, part).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))


def source_cuts(narrow: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target, last): what is taken of each source last, as (round, place, rows, of): so many
    of the equal rows there are."""
    named = targets.select(F.col("source").alias("__s"), "rank", "source_size", "target").where("target > 0")
    rows = narrow.groupBy("source", "place", "size").agg(F.count(F.lit(1)).alias("of"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("source", "__s")
    rows = rows.withColumn("part", F.substring("place", 1, 3)).withColumn("sum", F.col("size") * F.col("of"))
    own = Window.partitionBy("rank", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("sum").over(own), F.lit(0)))
    rows = rows.join(_offsets(rows, ["rank"], "part", "sum"), ["rank", "part"])
    copies = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    copies = copies.withColumn("start", F.col("__before") + F.col("inner") + F.col("round") * F.col("source_size"))
    # So many of the equal rows finish within the target; the next one may straddle it.
    room = F.floor((F.col("target") - F.col("start")) / F.greatest("size", F.lit(1)))
    copies = copies.where(F.col("start") < F.col("target")).withColumn("within", F.least("of", room))
    end = lambda n: (F.col("start") + F.col("size") * n) / F.col("target")
    entry = lambda n, before: F.struct(n.alias("rows"), ((n - before) * F.col("size")).alias("words"), end(n).alias("finish"))
    entries = F.array(entry(F.col("within"), F.lit(0)), entry(F.least(F.col("within") + 1, "of"), F.col("within")))
    copies = copies.select("rank", "place", "round", "of", F.inline(F.filter(entries, lambda x: (x["words"] > 0) | (F.col("size") == 0))))
    copies = copies.withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(RANGES)))
    everywhere = Window.partitionBy("range").orderBy("finish", "rank", "round", "place", "rows")
    copies = copies.withColumn("__all", F.lit(0)).withColumn("upto", F.sum("words").over(everywhere))
    copies = copies.join(_offsets(copies, ["__all"], "range", "words"), ["__all", "range"])
    budget = targets.agg(F.sum("target")).scalar()
    taken = copies.where(F.col("__before") + F.col("upto") <= budget + 0.5)
    lasts = taken.groupBy("rank").agg(F.max(F.struct("round", "place", "rows", "of")).alias("last"))
    return targets.join(lasts, "rank", "left").select("source", "source_size", "target", "last")


def with_taken(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds how often (`times`) each document is taken. `docs` has source and place. At a source's last place, of which
    not all rows may be taken, equal rows are numbered in parts."""
    cuts = cuts.withColumnRenamed("source", "__cut_source")
    rows = docs.join(cuts, F.col("source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source")
    here = F.coalesce(F.col("place") == F.col("last.place"), F.lit(False))
    split = here & (F.col("last.rows") < F.col("last.of"))
    full = F.coalesce(F.col("last.round"), F.lit(0))
    clear = rows.where(~split).withColumn("times", full + F.coalesce((F.col("place") <= F.col("last.place")).cast("int"), F.lit(0)))
    tied = cut_lineage(rows.where(split).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "tied")
    ahead = _offsets(tied.withColumn("__one", F.lit(1)), ["place"], "__part", "__one")
    number = F.row_number().over(Window.partitionBy("place", "__part").orderBy(F.lit(0))) + F.col("__before")
    tied = tied.join(ahead, ["place", "__part"]).withColumn("__number", number)
    tied = tied.withColumn("times", full + (F.col("__number") <= F.col("last.rows")).cast("int"))
    return clear.unionByName(tied.drop("__part", "__before", "__number")).drop("last")


def _narrow(docs: DataFrame) -> DataFrame:
    return cut_lineage(docs.select("doc_id", "source", size_of().alias("size"), place_of().alias("place")), "mixing")


def _cuts(narrow: DataFrame) -> DataFrame:
    targets = cut_lineage(source_targets(narrow), "targets")
    return cut_lineage(source_cuts(narrow, targets), "cuts")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    narrow = _narrow(docs)
    return with_taken(narrow, _cuts(narrow)).select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "source"
    )


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    cuts = _cuts(_narrow(docs))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), "source", place_of().alias("place"))
    rows = with_taken(rows, cuts).where("times > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("__row.*")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 AS budget,
    row_number() OVER w AS step, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open,
    coalesce(sum(2 * source_size) OVER b, 0) AS used
  FROM s2 WINDOW w AS (ORDER BY 2.0 * source_size / weight, rank),
    b AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, min(CASE WHEN CAST(2 * source_size AS DOUBLE) / weight > (budget - used) / open THEN step END) OVER () AS first FROM s3),
lv AS (SELECT budget - used AS rest, open FROM s4 WHERE step = first),
t AS (SELECT s4.source, source_size, rank, CASE WHEN first IS NULL OR step < first THEN CAST(2 * source_size AS DOUBLE)
    ELSE lv.rest * weight / lv.open END AS target FROM s4 LEFT JOIN lv ON true),
r AS (SELECT d.*, t.source_size, t.target, t.rank, sum(size) OVER (PARTITION BY rank ORDER BY place) AS upto,
    sum(size) OVER (PARTITION BY rank, place) AS tied FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rank, size, place, round, (upto + round * source_size) / target AS finish
  FROM r, (VALUES (0), (1)) AS x(round) WHERE target > 0 AND upto + round * source_size - tied < target),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, round, place) AS total FROM c),
l AS (SELECT rank, max(round) AS round, max(CAST(round AS VARCHAR) || place) AS last FROM g
  WHERE total <= (SELECT sum(target) FROM t) + 0.5 GROUP BY rank)
SELECT r.doc_id, r.size, r.source_size, r.target, r.source,
  CAST(r.size * CASE WHEN l.rank IS NULL THEN 0 ELSE l.round + CAST(r.place <= substr(l.last, 2) AS INTEGER) END AS BIGINT) AS taken
FROM r LEFT JOIN l ON r.rank = l.rank
"""


@register("op8_mixing", OP8_SQL)
def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    return mix(table(spark, sf_dir, "documents"))
