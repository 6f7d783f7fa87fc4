"""Corpus tables bucketed alike, so that articles, versions and regulations join without a shuffle."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.session import fresh_path


@dataclass(frozen=True)
class BucketedCorpus:
    """Names of three catalog tables, all bucketed and sorted by the regulation."""

    regulations: str
    articles: str
    versions: str

    def joined(self, spark: SparkSession) -> DataFrame:
        """One row for each version of an article, with its article and regulation. Equal buckets meet in one task; no
        table is exchanged. Columns of one name keep the version's, then the article's."""
        # Buckets of the regulation hold all rows of any of its articles; this tells Spark to take them for a join by both.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        keys = ["regulation_id", "article_no"]
        versions, articles, regulations = (spark.table(t) for t in (self.versions, self.articles, self.regulations))
        articles = articles.drop(*[c for c in articles.columns if c in versions.columns and c not in keys])
        # Both sides grow with the corpus; the hint keeps the join to the buckets.
        rows = versions.join(articles.hint("merge"), keys)
        regulations = regulations.drop(*[c for c in regulations.columns if c in rows.columns and c != "regulation_id"])
        return rows.join(regulations.hint("merge"), "regulation_id")


def write_bucketed(regulations: DataFrame, articles: DataFrame, versions: DataFrame, buckets: int = 64) -> BucketedCorpus:
    """Writes the three tables into `buckets` buckets of the regulation each, one file for each bucket. Articles and
    versions are known by (regulation_id, article_no)."""
    spark = regulations.sparkSession
    names, mark = [], uuid.uuid4().hex
    for kind, rows in (("regulations", regulations), ("articles", articles), ("versions", versions)):
        name = f"lex_{kind}_{mark}"
        order = ["regulation_id"] if kind == "regulations" else ["regulation_id", "article_no"]
        dealt = rows.repartition(buckets, F.col("regulation_id"))
        dealt.write.bucketBy(buckets, "regulation_id").sortBy(*order).option("path", fresh_path(spark, name)).saveAsTable(name)
        names.append(name)
    return BucketedCorpus(*names)
