"""Intervals, chains, overlaps and point-in-time joins, on hand-written rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexframe.operators import temporal as T

D = dt.date


def test_interval_is_right_open_and_status_order(spark):
    rows = [
        (D(2024, 1, 1), D(2024, 6, 1), D(2024, 1, 1), False, False, "effective", "effective"),
        (D(2024, 1, 1), D(2024, 6, 1), D(2024, 6, 1), False, False, "out_of_range", "repealed"),
        (D(2024, 1, 1), None, D(2030, 1, 1), False, False, "effective", "effective"),
        (D(2024, 1, 1), None, D(2023, 1, 1), False, False, "out_of_range", "not_yet_effective"),
        (None, None, D(2023, 1, 1), False, False, "out_of_range", "not_yet_effective"),
        (D(2024, 1, 1), None, D(2024, 2, 1), True, False, "effective", "repealed"),
        (D(2024, 1, 1), None, D(2024, 2, 1), True, True, "effective", "draft"),
    ]
    df = spark.createDataFrame(rows, "a date, b date, t date, r boolean, d boolean, s string, e string")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    out = df.select("s", "e", T.status_as_of(a, b, t).alias("x"), T.effect_status_at(a, b, t, F.col("r"), F.col("d")).alias("y"))
    for row in out.collect():
        assert (row.x, row.y) == (row.s, row.e)


def test_unknown_status_is_not_citable(spark):
    df = spark.createDataFrame([("effective",), ("partially_repealed",), ("repealed",), (None,), ("odd",)], "s string")
    assert [r[0] for r in df.select(T.citable(F.col("s"))).collect()] == [True, True, False, False, False]


def test_discount_period_is_closed(spark):
    df = spark.createDataFrame([(D(2023, 1, 1),), (D(2027, 12, 31),), (D(2028, 1, 1),)], "t date")
    start, end = (F.lit(x).cast("date") for x in ("2023-01-01", "2027-12-31"))
    assert [r[0] for r in df.select(T.in_period(start, end, F.col("t"))).collect()] == [True, True, False]


def _chain(spark, days):
    rows = [(1, D(2024, 1, 1) + dt.timedelta(d), i, "effective") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "a int, d date, seq int, effect_status string")
    return T.version_chain(df, "a", "d", "seq", bucket_days=7)


def test_chain_closes_the_previous_version(spark):
    rows = _chain(spark, [0, 10, 40]).orderBy("version").collect()
    assert [r.version for r in rows] == [1, 2, 3]
    assert [r.valid_to for r in rows] == [rows[1].valid_from, rows[2].valid_from, None]


def test_same_day_amendment_keeps_the_last_row(spark):
    rows = _chain(spark, [0, 0, 5]).orderBy("version").collect()
    assert [(r.seq, r.superseded_rows) for r in rows] == [(1, 1), (2, 0)]


def test_repeal_closes_the_open_version(spark):
    chain = _chain(spark, [0, 10])
    repeals = spark.createDataFrame([(1, D(2024, 3, 1), "notice")], "a int, repeal_date date, basis string")
    rows = T.close_repealed(chain, repeals, "a").orderBy("version").collect()
    assert [(r.effect_status, r.valid_to) for r in rows] == [("effective", D(2024, 1, 11)), ("repealed", D(2024, 3, 1))]


def test_overlaps_equal_the_pairwise_check_and_chains_have_none(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        start = rng.randrange(0, 300)
        end = None if rng.random() < 0.02 else start + rng.randrange(1, 12)
        rows.append((i, rng.randrange(6), start, end))
    as_day = lambda x: None if x is None else D(2024, 1, 1) + dt.timedelta(x)
    data = [(i, a, as_day(s), as_day(e)) for i, a, s, e in rows]
    df = spark.createDataFrame(data, "version_id int, a int, valid_from date, valid_to date")
    got = {r.version_id for r in T.overlap_violations(df, "a").collect()}
    want = set()
    for i, a, s, e in rows:
        for j, b, u, v in rows:
            earlier = (u, j) < (s, i)
            if a == b and earlier and (v is None or v > s):
                want.add(i)
    assert got == want
    chain = _chain(spark, sorted(rng.sample(range(500), 60)))
    ids = chain.withColumn("version_id", F.col("version"))
    assert T.overlap_violations(ids, "a").count() == 0


def test_both_asof_forms_agree_with_brute_force(spark):
    rng = random.Random(3)
    amendments = [(rng.randrange(3), D(2024, 1, 1) + dt.timedelta(rng.randrange(200)), i) for i in range(150)]
    probes = [(i, rng.randrange(4), D(2023, 12, 20) + dt.timedelta(rng.randrange(260))) for i in range(300)]
    adf = spark.createDataFrame(amendments, "a int, d date, seq int")
    pdf = spark.createDataFrame(probes, "p int, a int, t date")
    chain = T.version_chain(adf, "a", "d", "seq")
    want = {}
    for p, a, t in probes:
        known = [(d, s) for k, d, s in amendments if k == a and d <= t]
        want[p] = max(known)[1] if known else None
    unplaced = [(300, None, D(2024, 5, 1)), (301, 1, None), (302, None, None)]
    pdf = pdf.unionByName(spark.createDataFrame(unplaced, "p int, a int, t date"))
    want |= {p: None for p, _, _ in unplaced}
    for form in (T.asof_last_known, T.asof_range_join):
        got = {r.p: r.seq for r in form(chain, pdf, "a", "t", ["seq"]).collect()}
        assert got == want, form.__name__


def test_hot_article_is_spread_over_buckets(spark):
    df = spark.range(20_000).select(
        F.lit(1).alias("a"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").alias("seq")
    )
    chain = T.version_chain(df, "a", "d", "seq", bucket_days=30)
    assert chain.agg(F.max("version"), F.count_if(F.col("valid_to").isNull())).first() == (20_000, 1)
