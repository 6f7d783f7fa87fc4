"""Audit of how corpus filters interact, by counting paths through the lattice of their subsets.

A state is the set of filters applied so far, an edge applies one more. Documents are counted once by
the set of filters they fail; what an edge removes from a part of the corpus follows from these few
counts. Forward counting gives the number of orders that reach a state, backward counting the number
that lead on from it; their product weights the edge. An order is a path: its steps are read from
the edges it walks, and a filter's Shapley sum is that of its edges' removals by weight.

Documents never meet in groups: the copies of a text share only its hash and least id, in a join on both.

Defined cases: a null text is empty, a null source is the part ''; equal texts are told by SHA-256;
a document without id is never a later copy and makes none, and has no labels; of rows with one id and
text each counts, none as a copy of the other; of several labels of one id any 1 counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm.base import WORD, cut_lineage, register, table, whole

LETTERS = "ABCDE"


def text_filters(text: Column) -> list[Column]:
    """What fails a text: few words, few distinct words, many capitals, marks of markup or code."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.char_length(text),
        F.regexp_like(text, F.lit(r"[#$%&*|]")),
    ]


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, weight) of each edge; the weight counts the orders that walk it."""
    full = (1 << n) - 1
    reach, leave = {0: 1}, {full: 1}
    for state in range(1, full + 1):
        reach[state] = sum(reach[state ^ (1 << i)] for i in range(n) if state >> i & 1)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | 1 << i] for i in range(n) if not state >> i & 1)
    return [(s, i, reach[s] * leave[s | 1 << i]) for s in range(full) for i in range(n) if not s >> i & 1]


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, state, filter): the edges that each order of the filters walks."""
    rows = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(letters[k] for k in order), step, state, i))
            state |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def failing_sets(docs: DataFrame, labels: DataFrame, filters: list[Column]) -> DataFrame:
    """(part, failing, n, good, toxic): documents by the set of filters they fail, the last of which is
    to be a later copy of a text."""
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("part"),
        F.col("doc_id").cast("long").alias("id"),
        whole("text").alias("text"),
    ).select("part", "id", F.unhex(F.sha2("text", 256)).alias("hash"), bits.alias("failing"))
    rows = cut_lineage(rows.groupBy("part", "id", "hash", "failing").agg(F.count(F.lit(1)).alias("n")), "failing")
    first = rows.groupBy("hash").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Both grow with the corpus and are never broadcast. Each id and hash is one row of `first`; rows without
    # id, which may be many, stay out of the joins.
    named = rows.where("id IS NOT NULL").join(first.hint("merge"), ["id", "hash"], "left").join(marks.hint("merge"), "id", "left")
    rows = named.unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    failing = F.col("failing") + F.when(copy, F.lit(1 << len(filters))).otherwise(F.lit(0))
    of = lambda mark: F.sum(F.col("n") * F.coalesce(mark, F.lit(0))).alias(mark)
    return rows.groupBy("part", failing.alias("failing")).agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def edge_counts(sets: DataFrame, n: int) -> DataFrame:
    """What each edge of the lattice does in each part, with its weight."""
    edges = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(e, ("state", "filter", "weight"), strict=True)]) for e in lattice(n)])
    rows = sets.select("*", F.explode(edges).alias("edge")).select("part", "failing", "n", "good", "toxic", "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("failing").bitwiseAND(bit) > 0, F.col("failing").bitwiseAND(F.col("state")) > 0
    count = lambda when, name, of="n": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0))).alias(name)
    return rows.groupBy("part", "state", "filter", "weight").agg(
        count(~gone & ~fails, "kept"),
        count(~gone & fails, "removed"),
        count(gone & fails, "redundant"),
        count(F.col("failing") == bit, "unique_fails"),
        count(~gone & fails, "good_lost", "good"),
        count(~gone & fails, "toxic_lost", "toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: list[Column] | None = None, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step. `filters` are conditions on the column `text`; the
    last letter stands for being a later copy."""
    filters = text_filters(F.col("text")) if filters is None else filters
    if len(letters) != len(filters) + 1 or len(letters) > 7:
        raise ValueError("one letter for each filter and one for copies, seven at most")
    sets = failing_sets(docs, labels, filters)
    edges = cut_lineage(edge_counts(sets, len(letters)), "edges")
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    edges = edges.join(shapley.hint("merge"), ["part", "filter"]).drop("weight")
    # The orders are n! * n rows, whatever the corpus holds.
    steps = F.broadcast(orders(docs.sparkSession, letters))
    return edges.join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), seen AS (
    SELECT doc_id, part, t, w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs
), flags AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS f
    FROM seen
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), marked AS (
    SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM flags LEFT JOIN marks USING (doc_id)
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), paths AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
    SELECT filter_order, step::INT AS step, filter_order[step] AS x, filter_order[1:step - 1] AS before
    FROM paths, range(1, 6) r(step)
), judged AS (
    SELECT part, filter_order, step, x, f = x AS alone, good, toxic, contains(f, x) AS fails,
           length(translate(f, before, '')) < length(f) AS gone
    FROM marked, steps
), counted AS (
    SELECT part, filter_order, step, x,
           count(*) FILTER (NOT gone AND NOT fails) AS kept,
           count(*) FILTER (NOT gone AND fails) AS removed,
           count(*) FILTER (gone AND fails) AS redundant,
           count(*) FILTER (alone) AS unique_fails,
           (sum(good) FILTER (NOT gone AND fails)) AS good_lost,
           (sum(toxic) FILTER (NOT gone AND fails)) AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""


@register("op11_filter_audit", SQL)
def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, in every order."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
