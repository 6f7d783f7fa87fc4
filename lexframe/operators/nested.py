"""Article trees as nested rows: children and versions folded into their parents, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.operators.structure import article_tree
from lexframe.session import cut_lineage


def nested_tree(
    nodes: DataFrame,
    versions: DataFrame,
    key: str,
    parent: str,
    order: str,
    fields: Sequence[str] = (),
    version_order: str = "version",
) -> DataFrame:
    """(key, nodes, levels, tree) for each root: `tree` is JSON of the root's id and `fields`, its `versions` in their
    order, and its `children` in theirs, to any depth. A node whose parent is missing is a root; one in or below a
    cycle belongs to no tree. Of several rows of one id the first by order counts.

    The deepest level is folded into the next one, and so on up, so that a round moves each subtree once.
    """
    first = nodes.groupBy(key).agg(F.min_by(F.struct(*[c for c in nodes.columns if c != key]), F.struct(order, F.xxhash64(*nodes.columns))).alias("_r"))
    first = cut_lineage(first.select(key, "_r.*"), "nodes")
    listed = [c for c in versions.columns if c != key]
    told = versions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(version_order).alias("_o"), F.to_json(F.struct(*listed)).alias("_j")))).alias("_v"))
    told = told.select(key, F.transform("_v", lambda v: v["_j"]).alias("_versions"))
    placed = article_tree(first, key, parent).filter(F.col("depth").isNotNull()).select(key, "depth")
    rows = first.join(placed, key).join(told, key, "left").withColumn("_versions", F.coalesce("_versions", F.array().cast("array<string>")))
    rows = cut_lineage(rows, "levels")
    deepest = rows.agg(F.max("depth")).first()[0]
    below: DataFrame | None = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        own = rows.filter(F.col("depth") == level)
        if below is None:
            none = F.array().cast(f"array<struct<o:{dict(rows.dtypes)[order]},k:{dict(rows.dtypes)[key]},j:string>>")
            own = own.withColumns({"_c": none, "_n": F.lit(0).cast("long"), "_l": F.lit(0)})
        else:
            child = F.struct(F.col("_o").alias("o"), F.col("_k").alias("k"), F.col("_j").alias("j"))
            per = below.groupBy(F.col("_up").alias(key)).agg(F.array_sort(F.collect_list(child)).alias("_c"), F.sum("nodes").alias("_n"), F.max("levels").alias("_l"))
            own = own.join(per, key, "left").fillna(0, ["_n", "_l"])
        about = F.regexp_replace(F.to_json(F.struct(key, *fields)), r"\}$", "")
        joined = lambda parts: F.concat(F.lit("["), F.concat_ws(",", parts), F.lit("]"))
        kids = F.transform(F.coalesce("_c", F.array()), lambda c: c["j"])
        tree = F.concat(about, F.lit(',"versions":'), joined(F.col("_versions")), F.lit(',"children":'), joined(kids), F.lit("}"))
        below = own.select(
            F.col(key).alias("_k"), F.col(parent).alias("_up"), F.col(order).alias("_o"), tree.alias("_j"),
            (F.col("_n") + 1).alias("nodes"), (F.col("_l") + 1).alias("levels"), F.lit(level == 0).alias("_root"),
        )
        # Roots of upper levels join the round of their own level.
        below = cut_lineage(below, f"level-{level}")
    if below is None:
        return rows.select(key, F.lit(0).cast("long").alias("nodes"), F.lit(0).alias("levels"), F.lit("").alias("tree"))
    return below.select(F.col("_k").alias(key), "nodes", "levels", F.col("_j").alias("tree"))
