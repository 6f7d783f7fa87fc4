"""Registered queries of the money family. The oracles work in whole cents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions.common import lookup
from lexframe.operators import tax as X
from lexframe.plans.base import Family
from lexframe.plans.bindings import table

family = Family()
query = family.query

# How the driver tables stand for taxpayers, business, scope and place.
TAXPAYER = {
    "MACHINERY": "一般纳税人",
    "BUILDING": "一般纳税人",
    "AUTOMOBILE": "小规模纳税人",
    "HOUSEHOLD": "小规模纳税人",
}
BUSINESS = {
    "ECONOMY": "销售货物",
    "SMALL": "出口货物",
    "MEDIUM": "提供现代服务",
    "PROMO": "交通运输服务",
    "STANDARD": "咨询",
}
SCOPE = {"1-URGENT": "month", "2-HIGH": "quarter", "3-MEDIUM": "year"}
PLACE = {0: "市区", 1: "县城、镇", 2: "其他"}


def transactions(spark, sf_dir):
    """One transaction per order line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_returnflag",
            M.from_cents(cents).alias("sales_amount"),
            (F.col("l_linestatus") == "O").alias("amount_includes_tax"),
            lookup(F.col("c_mktsegment"), TAXPAYER).alias("taxpayer_type"),
            lookup(F.col("p_type"), BUSINESS).alias("business_type"),
            M.from_cents(
                F.when(
                    F.col("l_tax") > 0,
                    F.floor(cents * F.round(F.col("l_tax") * 100).cast("bigint") / 100),
                ).cast("bigint")
            ).alias("input_vat"),
            lookup(F.col("o_orderpriority"), SCOPE).alias("period_scope"),
            F.add_months(F.to_date("l_shipdate"), 324).alias("as_of"),
            lookup(F.col("c_nationkey") % 4, PLACE).alias("location"),
        )
    )


TX_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c, l_linestatus = 'O' AS gross,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'general' WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')
    THEN 'simplified' END AS method,
  CASE p_type WHEN 'ECONOMY' THEN 1300 WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 600 WHEN 'PROMO' THEN 900
    WHEN 'STANDARD' THEN 600 END AS bp,
  CASE WHEN l_tax > 0 THEN (CAST(round(l_extendedprice * 100) AS HUGEINT) * CAST(round(l_tax * 100) AS HUGEINT)) // 100 END AS input,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'month' WHEN '2-HIGH' THEN 'quarter' WHEN '3-MEDIUM' THEN 'year' END AS scope,
  CAST(l_shipdate + INTERVAL 27 YEAR AS DATE) AS as_of, c_nationkey % 4 AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
"""


def net_sql(cents: str, bp: str) -> str:
    return f"((2 * {cents} * 10000 + (10000 + {bp})) // (2 * (10000 + {bp})))"


def pct_sql(cents: str, bp: str) -> str:
    return f"(({cents} * {bp} * 2 + 10000) // 20000)"


GENERAL_SQL = f"""
net AS (SELECT *, CASE WHEN gross THEN {net_sql('c', 'bp')} ELSE c END AS net FROM tx WHERE method = 'general'),
due AS (SELECT *, {pct_sql('net', 'bp')} AS output FROM net),
general AS (SELECT *, CASE WHEN bp IS NOT NULL THEN greatest(output - coalesce(input, 0), 0) END AS payable FROM due)"""

SIMPLE_SQL = f"""
base AS (SELECT *, as_of BETWEEN DATE '2023-01-01' AND DATE '2027-12-31' AS open,
  CASE WHEN gross THEN {net_sql('c', '300')} ELSE c END AS n3, CASE WHEN gross THEN {net_sql('c', '100')} ELSE c END AS n1
  FROM tx WHERE method = 'simplified'),
judged AS (SELECT *, CASE WHEN NOT open THEN 'taxable' WHEN scope = 'year' THEN 'year_scope'
  WHEN scope = 'month' THEN CASE WHEN n3 <= 10000000 AND n1 <= 10000000 THEN 'exempt' WHEN n3 > 10000000 AND n1 > 10000000 THEN 'taxable' ELSE 'basis_conflict' END
  WHEN scope = 'quarter' THEN CASE WHEN n3 <= 30000000 AND n1 <= 30000000 THEN 'exempt' WHEN n3 > 30000000 AND n1 > 30000000 THEN 'taxable' ELSE 'basis_conflict' END
  WHEN n3 <= 10000000 AND n1 <= 10000000 THEN 'exempt' WHEN n3 > 30000000 AND n1 > 30000000 THEN 'taxable'
  WHEN (n3 <= 10000000) <> (n3 <= 30000000) THEN 'scope_conflict' ELSE 'basis_conflict' END AS verdict FROM base),
simple AS (SELECT *, CASE verdict WHEN 'exempt' THEN 0 WHEN 'taxable' THEN
   CASE WHEN open THEN {pct_sql('n1', '100')} ELSE {pct_sql('n3', '300')} END END AS payable FROM judged)"""


def _vat(spark, sf_dir):
    return X.vat(transactions(spark, sf_dir))


@query(f"""
WITH tx AS ({TX_SQL}), {GENERAL_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN bp IS NOT NULL THEN net END AS BIGINT) AS net_cents,
  CAST(CASE WHEN bp IS NOT NULL THEN output END AS BIGINT) AS output_cents, CAST(payable AS BIGINT) AS payable_cents,
  concat_ws(',', CASE WHEN bp IS NULL THEN 'rate_unknown' END, CASE WHEN bp IS NOT NULL AND input IS NULL THEN 'input_missing' END,
    CASE WHEN output - coalesce(input, 0) < 0 THEN 'carry_forward' END) AS notes
FROM general
""")
def vat_general(spark, sf_dir):
    rows = _vat(spark, sf_dir).filter(F.col("method") == "general")
    known = F.col("computable")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(known, M.cents(F.col("net_sales"))).alias("net_cents"),
        F.when(known, M.cents(F.col("computed_output_vat"))).alias("output_cents"),
        M.cents(F.col("payable")).alias("payable_cents"),
        F.array_join("notes", ",").alias("notes"),
    )


@query(f"""
WITH tx AS ({TX_SQL}), {SIMPLE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(payable AS BIGINT) AS payable_cents,
  CASE WHEN verdict IN ('year_scope', 'scope_conflict', 'basis_conflict') THEN verdict ELSE '' END AS notes,
  CASE WHEN verdict = 'exempt' THEN 'small_scale_vat_exemption' WHEN verdict = 'taxable' AND open THEN 'small_scale_levy_rate_reduction' END AS discount
FROM simple
""")
def vat_simplified(spark, sf_dir):
    rows = _vat(spark, sf_dir).filter(F.col("method") == "simplified")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        M.cents(F.col("payable")).alias("payable_cents"),
        F.array_join("notes", ",").alias("notes"),
        "discount",
    )


@query(f"""
WITH tx AS ({TX_SQL}), {GENERAL_SQL}, {SIMPLE_SQL},
paid AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, method, as_of, place, payable FROM general
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, method, as_of, place, payable FROM simple
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, method, as_of, place, NULL FROM tx WHERE method IS NULL),
b AS (SELECT *, coalesce(payable, 0) AS base, method = 'simplified' AND as_of BETWEEN DATE '2023-01-01' AND DATE '2027-12-31' AS half,
  CASE place WHEN 0 THEN 700 WHEN 1 THEN 500 ELSE 100 END AS bp FROM paid),
f AS (SELECT *, {pct_sql('base', 'bp')} AS u, {pct_sql('base', '300')} AS e, {pct_sql('base', '200')} AS l FROM b),
h AS (SELECT *, CASE WHEN half THEN (u + 1) // 2 + (e + 1) // 2 + (l + 1) // 2 ELSE u + e + l END AS total FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(base AS BIGINT) AS base_cents, CAST(total AS BIGINT) AS surcharge_cents,
  CAST(CASE WHEN payable IS NOT NULL THEN payable + total END AS BIGINT) AS total_cents FROM h
""")
def surcharges(spark, sf_dir):
    rows = _vat(spark, sf_dir).withColumn("vat_payable", F.col("payable"))
    done = X.tax_response(X.surcharges(rows))
    return done.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        M.cents(F.col("surcharge_base")).alias("base_cents"),
        M.cents(F.col("surcharge_total")).alias("surcharge_cents"),
        M.cents(F.col("total_payable")).alias("total_cents"),
    )


@query("""
WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS HUGEINT) * 1000 AS i, c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') AS small FROM customer)
SELECT c_custkey, CAST(CASE WHEN i <= 0 THEN 0 WHEN small THEN (((i * 2500 * 2 + 10000) // 20000) * 2000 * 2 + 10000) // 20000
  ELSE (i * 2500 * 2 + 10000) // 20000 END AS BIGINT) AS payable_cents,
  CASE WHEN i > 0 AND small THEN 'small_low_profit' END AS discount FROM c
""")
def cit(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        M.from_cents(F.round(F.col("c_acctbal") * 100).cast("bigint") * 1000).alias(
            "taxable_income"
        ),
        F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE").alias("small_low_profit"),
    )
    return X.income_tax(rows).select(
        "c_custkey",
        M.cents(F.col("cit_payable")).alias("payable_cents"),
        F.col("cit_discount").alias("discount"),
    )


# Words of part names stand in for business words.
PART_RATES = (
    {"rate": "0.13", "name": "a", "citation": "x", "keywords": ("ring", "red ring", "widget")},
    {"rate": "0.09", "name": "b", "citation": "x", "keywords": ("red widget", "bolt", "red")},
    {"rate": "0.06", "name": "c", "citation": "x", "keywords": ("small", "blue widget")},
)


@query("""
WITH h AS (SELECT p_partkey, p_name,
  CASE WHEN contains(p_name, 'ring') THEN 4 WHEN contains(p_name, 'red ring') THEN 8 WHEN contains(p_name, 'widget') THEN 6 END AS a,
  CASE WHEN contains(p_name, 'red widget') THEN 10 WHEN contains(p_name, 'bolt') THEN 4 WHEN contains(p_name, 'red') THEN 3 END AS b,
  CASE WHEN contains(p_name, 'small') THEN 5 WHEN contains(p_name, 'blue widget') THEN 11 END AS c FROM part)
SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL
  WHEN coalesce(a, 0) >= coalesce(b, 0) AND coalesce(a, 0) >= coalesce(c, 0) THEN 1300
  WHEN coalesce(b, 0) >= coalesce(c, 0) THEN 900 ELSE 600 END::BIGINT AS rate_bp FROM h
""")
def rate_match(spark, sf_dir):
    match = X.matched_rate(F.col("p_name"), PART_RATES)
    return table(spark, sf_dir, "part").select(
        "p_partkey", (match["rate"] * 10000).cast("bigint").alias("rate_bp")
    )


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate + INTERVAL 27 YEAR AS DATE) AS d, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d BETWEEN DATE '2023-01-01' AND DATE '2027-12-31' AND l_returnflag <> 'R' THEN
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'small_scale_vat_exemption,small_scale_levy_rate_reduction'
       WHEN l_linestatus = 'F' THEN 'small_business_half_surcharges' ELSE '' END ELSE '' END AS discounts FROM t
""")
def discounts_open(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_linestatus") == "O", "vat").otherwise("education_surcharge")
    taxpayer = F.when(F.col("l_returnflag") == "A", "小规模纳税人").when(
        F.col("l_returnflag") == "N", "个体工商户"
    )
    rows = X.applicable_discounts(
        lines, tax, F.add_months(F.to_date("l_shipdate"), 324), taxpayer
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.array_join("discounts", ",").alias("discounts"),
    )
