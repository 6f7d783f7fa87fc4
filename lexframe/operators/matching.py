"""Containment joins without cross joins.

If a needle is part of a text, each gram of the needle is a gram of the text. So one gram
per needle, the one that is rarest among the texts, is joined on equality and the few
candidates are checked with ``contains``. The answer is exact: every needle has a gram,
whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(items: Column, n: int) -> Column:
    """Arrays of n neighbours, by zipping the array with its own tails: linear in size."""
    tails = [items] + [F.slice(items, i + 1, F.greatest(F.size(items), F.lit(1))) for i in range(1, n)]
    return F.slice(F.arrays_zip(*tails), 1, F.greatest(F.size(items) - F.lit(n - 1), F.lit(0)))


def word_grams(text: Column, n: int = 3, interior: bool = False) -> Column:
    """Hashes of n consecutive words. ``interior`` drops the first and last word, which may
    be cut when the text is a passage of a longer one."""
    words = F.split(text, r"\s+")
    if interior:
        words = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.array_distinct(F.transform(_runs(words, n), lambda run: F.xxhash64(run)))


def char_grams(text: Column, n: int) -> Column:
    """Distinct substrings of length n."""
    runs = _runs(F.split(text, ""), n)
    return F.array_distinct(
        F.transform(runs, lambda run: F.concat(*[run[str(i)] for i in range(n)]))
    )


def _rarest(needle_grams: DataFrame, text_grams: DataFrame, n_key: str) -> DataFrame:
    """One gram per needle: the one with the fewest texts. A gram that no text has rules
    the needle out, which the inner join does."""
    counts = text_grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rated = needle_grams.join(counts, "_gram", "left")
    return (
        rated.groupBy(n_key)
        .agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "_gram")).alias("_b"))
        .filter(F.col("_b._texts") > 0)
        .select(n_key, F.col("_b._gram").alias("_gram"))
    )


def _pairs(texts, needles, text_grams, needle_grams, t_key, t_text, n_key, n_text, salt):
    """Join on (gram, salt): a gram that a large part of all texts has is spread over
    ``salt`` tasks. The texts travel as keys and meet their content in the last join."""
    text_grams = text_grams.join(
        needle_grams.select("_gram").distinct(), "_gram", "left_semi"
    )
    anchors = _rarest(needle_grams, text_grams, n_key)
    asked = (
        needles.select(n_key, n_text)
        .join(anchors, n_key)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    )
    offered = text_grams.withColumn(
        "_salt", F.pmod(F.xxhash64(t_key), F.lit(salt)).cast("int")
    )
    candidates = offered.join(asked, ["_gram", "_salt"]).select(t_key, n_key, n_text)
    return candidates.join(texts.select(t_key, t_text), t_key).filter(
        F.col(t_text).contains(F.col(n_text))
    )


def passages_in_texts(
    texts: DataFrame,
    needles: DataFrame,
    t_key: str,
    t_text: str,
    n_key: str,
    n_text: str,
    n: int = 3,
    salt: int = 8,
) -> DataFrame:
    """(text key, needle key) for every text that contains the needle. Word grams for
    needles of at least n + 2 words; shorter needles go by character grams."""
    words = F.size(F.split(F.col(n_text), r"\s+"))
    long_needles = needles.filter(words >= n + 2)
    short_needles = needles.filter((words < n + 2) & (F.length(n_text) > 0))
    text_grams = texts.select(t_key, F.explode(word_grams(F.col(t_text), n)).alias("_gram"))
    needle_grams = long_needles.select(
        n_key, F.explode(word_grams(F.col(n_text), n, interior=True)).alias("_gram")
    )
    by_words = _pairs(
        texts, long_needles, text_grams, needle_grams, t_key, t_text, n_key, n_text, salt
    )
    by_chars = titles_in_texts(texts, short_needles, t_key, t_text, n_key, n_text, salt=salt)
    return by_words.select(t_key, n_key).unionByName(by_chars.select(t_key, n_key))


def titles_in_texts(
    texts: DataFrame,
    needles: DataFrame,
    t_key: str,
    t_text: str,
    n_key: str,
    n_text: str,
    n: int = 6,
    salt: int = 8,
) -> DataFrame:
    """The same over character grams, for short strings and scripts without spaces.

    A needle shorter than n is its own gram; the texts list grams of that length only if
    such a needle exists.
    """
    short = F.length(n_text) < n
    lengths = needles.filter(short & (F.length(n_text) > 0)).select(
        F.length(n_text).alias("_len")
    ).distinct()
    long_grams = texts.select(t_key, F.explode(char_grams(F.col(t_text), n)).alias("_gram"))
    by_length = F.array(
        *[F.struct(F.lit(i).alias("n"), char_grams(F.col(t_text), i).alias("g")) for i in range(1, n)]
    )
    short_grams = (
        texts.select(t_key, F.explode(by_length).alias("_by"))
        .join(lengths, F.col("_by.n") == F.col("_len"), "left_semi")
        .select(t_key, F.explode("_by.g").alias("_gram"))
    )
    needle_grams = needles.filter(F.length(n_text) > 0).select(
        n_key,
        F.explode(
            F.when(short, F.array(F.col(n_text))).otherwise(char_grams(F.col(n_text), n))
        ).alias("_gram"),
    )
    return _pairs(
        texts,
        needles,
        long_grams.unionByName(short_grams),
        needle_grams,
        t_key,
        t_text,
        n_key,
        n_text,
        salt,
    ).select(t_key, n_key)


def match_titles(
    named: DataFrame,
    titles: DataFrame,
    n_key: str,
    n_title: str,
    t_key: str,
    t_title: str,
) -> DataFrame:
    """Named title -> one known title: an equal title first, else one that contains the
    name or is contained in it; ties go to the smallest id. Both sides are normalised."""
    known = titles.filter(F.length(t_title) > 0).groupBy(t_title).agg(F.min(t_key).alias(t_key))
    asked = named.select(n_key, n_title).filter(F.length(n_title) > 0)
    distinct_names = asked.select(n_title).distinct()
    exact = distinct_names.join(known, distinct_names[n_title] == known[t_title]).select(
        n_title, t_key, F.lit("exact").alias("match_kind")
    )
    rest = distinct_names.join(known, distinct_names[n_title] == known[t_title], "left_anti")
    inside = titles_in_texts(
        known, rest.withColumn("_needle", F.col(n_title)), t_key, t_title, n_title, "_needle"
    )
    around = titles_in_texts(
        rest.withColumn("_whole", F.col(n_title)), known, n_title, "_whole", t_key, t_title
    )
    partial = (
        inside.select(n_title, t_key)
        .unionByName(around.select(n_title, t_key))
        .groupBy(n_title)
        .agg(F.min(t_key).alias(t_key))
        .withColumn("match_kind", F.lit("contained"))
    )
    found = exact.unionByName(partial)
    return named.join(found, n_title, "left").withColumn(
        "match_kind", F.coalesce("match_kind", F.lit("unknown"))
    )
