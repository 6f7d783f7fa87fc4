"""Registered queries of the temporal family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.operators import temporal as T
from lexframe.plans.base import Family
from lexframe.plans.bindings import (
    EVENT_STATUS_SQL,
    daily_amendments,
    event_amendments,
    table,
)

family = Family()
query = family.query


# ---- each order amends its customer's terms; each order line asks on its ship date

TERMS_SQL = """
  SELECT o_custkey, o_orderdate AS valid_from, version_order, priority, status,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to
  FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS version_order,
          arg_max(o_orderpriority, o_orderkey) AS priority,
          arg_max(CASE o_orderstatus WHEN 'F' THEN 'effective' WHEN 'O' THEN 'partially_repealed'
                  ELSE 'superseded' END, o_orderkey) AS status
        FROM orders GROUP BY o_custkey, o_orderdate) s
"""

LINE_SQL = f"""
WITH terms AS ({TERMS_SQL}),
probes AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey, l.l_shipdate
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.o_custkey, p.l_shipdate, t.valid_from, t.valid_to,
  t.version_order, t.priority, t.status,
  coalesce(t.status IN ('effective', 'partially_repealed'), false) AS is_citable
FROM probes p LEFT JOIN terms t ON t.o_custkey = p.o_custkey AND t.valid_from <= p.l_shipdate
  AND (t.valid_to IS NULL OR t.valid_to > p.l_shipdate)
"""


def _terms(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderdate",
        F.col("o_orderkey").alias("version_order"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "effective")
        .when(F.col("o_orderstatus") == "O", "partially_repealed")
        .otherwise("superseded")
        .alias("status"),
    )
    return T.version_chain(orders, "o_custkey", "o_orderdate", "version_order", 365)


def _line_probes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def _line_answer(df):
    return df.withColumn("is_citable", T.citable(F.col("status")))


@query(LINE_SQL)
def asof_version_join(spark, sf_dir):
    """For each order line, the customer terms in force on its ship date."""
    return _line_answer(
        T.asof_last_known(
            _terms(spark, sf_dir),
            _line_probes(spark, sf_dir),
            "o_custkey",
            "l_shipdate",
            ["version_order", "priority", "status"],
            bucket_days=365,
        )
    )


@query(LINE_SQL)
def asof_version_join_range(spark, sf_dir):
    """The same answer through the bucketed interval join."""
    return _line_answer(
        T.asof_range_join(
            _terms(spark, sf_dir),
            _line_probes(spark, sf_dir),
            "o_custkey",
            "l_shipdate",
            ["version_order", "priority", "status"],
            bucket_days=365,
        )
    )


# ---- events as amendments

CHAIN_SQL = f"""
WITH amendments AS (SELECT user_id AS article_id, CAST(ts AS DATE) AS valid_from, event_id AS seq,
    {EVENT_STATUS_SQL} AS effect_status, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events),
kept AS (SELECT article_id, valid_from, max(seq) AS seq, arg_max(effect_status, seq) AS effect_status,
    arg_max(value_cents, seq) AS value_cents, count(*) - 1 AS superseded_rows
  FROM amendments GROUP BY article_id, valid_from)
SELECT article_id, valid_from, seq, effect_status, value_cents, superseded_rows,
  row_number() OVER w AS version, lead(valid_from) OVER w AS valid_to
FROM kept WINDOW w AS (PARTITION BY article_id ORDER BY valid_from)
"""


def _daily_chain(spark, sf_dir):
    return T.version_chain(daily_amendments(spark, sf_dir), "article_id", "starts_at", "seq")


@query(CHAIN_SQL)
def version_chain(spark, sf_dir):
    return _daily_chain(spark, sf_dir)


@query("""
SELECT e.user_id AS article_id, CAST(e.ts AS DATE) AS starts_at, e.event_id AS seq
FROM events e WHERE EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id
  AND CAST(n.ts AS DATE) = CAST(e.ts AS DATE) AND n.event_id > e.event_id)
""")
def superseded_same_day(spark, sf_dir):
    rows = daily_amendments(spark, sf_dir).select("article_id", "starts_at", "seq")
    return T.superseded_same_day(rows, "article_id", "starts_at", "seq")


@query(f"""
WITH chain AS ({CHAIN_SQL}),
repeals AS (SELECT user_id AS article_id, min(CAST(ts AS DATE) + 10) AS repeal_date
  FROM events WHERE event_type = 'error' AND value > 50 GROUP BY user_id),
closed AS (SELECT c.article_id, c.version, c.valid_from,
  CASE WHEN c.valid_to IS NULL AND r.repeal_date >= c.valid_from THEN r.repeal_date ELSE c.valid_to END AS valid_to,
  CASE WHEN c.valid_to IS NULL AND r.repeal_date >= c.valid_from THEN 'repealed' ELSE c.effect_status END AS effect_status,
  CASE WHEN c.valid_to IS NULL AND r.repeal_date >= c.valid_from THEN 'error' END AS repeal_basis
  FROM chain c LEFT JOIN repeals r ON r.article_id = c.article_id)
SELECT article_id, version, valid_from, valid_to, effect_status, repeal_basis,
  CASE WHEN effect_status = 'repealed' THEN 'repealed' WHEN DATE '2024-01-20' < valid_from THEN 'not_yet_effective'
       WHEN valid_to IS NULL OR valid_to > DATE '2024-01-20' THEN 'effective' ELSE 'repealed' END AS status_now,
  valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to > DATE '2024-01-20')
    AND effect_status IN ('effective', 'partially_repealed') AS citable_now
FROM closed
""")
def repeal_close(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    repeals = events.filter((F.col("event_type") == "error") & (F.col("value") > 50)).select(
        F.col("user_id").alias("article_id"),
        F.date_add(F.to_date("ts"), 10).alias("repeal_date"),
        F.col("event_type").alias("basis"),
    )
    day = F.lit("2024-01-20").cast("date")
    start, end = F.col("valid_from"), F.col("valid_to")
    closed = T.close_repealed(_daily_chain(spark, sf_dir), repeals, "article_id")
    return closed.select(
        "article_id",
        "version",
        "valid_from",
        "valid_to",
        "effect_status",
        "repeal_basis",
        T.effect_status_at(
            start, end, day, F.col("effect_status") == "repealed", F.lit(False)
        ).alias("status_now"),
        T.citable_at(F.col("effect_status"), start, end, day).alias("citable_now"),
    )


@query("""
WITH v AS (SELECT event_id AS version_id, user_id AS article_id, ts AS valid_from,
  CASE WHEN event_type = 'signup' THEN NULL ELSE ts + to_hours(CAST(floor(value) AS INTEGER)) END AS valid_to FROM events)
SELECT b.article_id, b.version_id, b.valid_from, b.valid_to FROM v b WHERE EXISTS (
  SELECT 1 FROM v a WHERE a.article_id = b.article_id
    AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.version_id < b.version_id))
    AND (a.valid_to IS NULL OR a.valid_to > b.valid_from))
""")
def overlap_violations(spark, sf_dir):
    """Events as intervals of `value` hours; open for sign-ups."""
    versions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("article_id"),
        F.col("event_id").alias("version_id"),
        F.col("ts").alias("valid_from"),
        F.when(
            F.col("event_type") != "signup",
            F.col("ts") + F.make_dt_interval(hours=F.floor("value").cast("int")),
        ).alias("valid_to"),
    )
    return T.overlap_violations(versions, "article_id")


@query("""
SELECT user_id AS article_id, max(event_id) AS seq, max(ts) AS valid_from, count(*) AS versions
FROM events GROUP BY user_id
""")
def version_latest(spark, sf_dir):
    chain = T.version_chain(event_amendments(spark, sf_dir), "article_id", "starts_at", "seq")
    last = T.latest_version(chain, "article_id")
    return last.select("article_id", "seq", "valid_from", F.col("version").alias("versions"))


@query(f"""
SELECT article_id, version, valid_from, valid_to, effect_status,
  date_diff('day', valid_from, valid_to) AS days_in_force FROM ({CHAIN_SQL}) c
""")
def version_history(spark, sf_dir):
    history = T.version_history(_daily_chain(spark, sf_dir), "article_id")
    return history.select(
        "article_id",
        "version",
        "valid_from",
        "valid_to",
        "effect_status",
        F.col("days_in_force").cast("long").alias("days_in_force"),
    )
