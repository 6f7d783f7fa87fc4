"""Golden money tables: input and expected amount."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.operators import tax as X
from lexframe.rules import tax as R

SCHEMA = (
    "taxpayer_type string, sales_amount decimal(18,2), amount_includes_tax boolean, business_type string, "
    "input_vat decimal(18,2), period_scope string, as_of date"
)
AS_OF = dt.date(2024, 6, 30)
G, S = "一般纳税人", "小规模纳税人"

VAT = [
    (G, "1000000", False, "销售货物", "30000", None, "100000.00", ""),
    (G, "1130000", True, "销售货物", "30000", None, "100000.00", ""),
    (G, "100000", False, "销售货物", "20000", None, "0.00", "carry_forward"),
    (G, "113.13", True, "销售货物", "0", None, "13.02", ""),
    (G, "1234.56", False, "销售货物", "0", None, "160.49", ""),
    (G, "500000", False, "出口货物", "0", None, "0.00", ""),
    (S, "1000000", False, None, None, "month", "10000.00", ""),
    (S, "1030000", True, None, None, "month", "10198.02", ""),
    (S, "100000", False, None, None, "month", "0.00", ""),
    (S, "250000", True, None, None, "quarter", "0.00", ""),
    (S, "250000", True, None, None, "month", "2475.25", ""),
    (S, "102000", True, None, None, "month", None, "basis_conflict"),
    (S, "200000", False, None, None, None, None, "scope_conflict"),
    (S, "200000", False, None, None, "year", None, "year_scope"),
    (None, "1000", False, "销售货物", None, None, None, "method_unknown"),
    (G, "1000", False, "说不清", None, None, None, "rate_unknown"),
]


def test_vat_golden_table(spark):
    rows = [(a, Decimal(b), c, d, Decimal(e) if e else None, f, AS_OF) for a, b, c, d, e, f, _, _ in VAT]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    for row in X.vat(df).orderBy("i").collect():
        payable, note = VAT[row.i][6:]
        assert row.payable == (None if payable is None else Decimal(payable)), VAT[row.i]
        assert row.computable == (payable is not None)
        assert not note or note in row.notes, VAT[row.i]
        assert (len(row.steps) > 0) == row.computable


def test_rounding_happens_at_each_step(spark):
    df = spark.createDataFrame([(G, Decimal("113.13"), True, "销售货物", Decimal(0), None, AS_OF)], SCHEMA)
    row = X.vat(df).first()
    assert (row.net_sales, row.payable) == (Decimal("100.12"), Decimal("13.02"))


def test_net_of_equals_exact_division(spark):
    amounts = [Decimal(n) / 100 for n in (1, 49, 50, 10301, 99999999, 123456789012, -10301)]
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(18,2)")
    for rate in ("0.13", "0.03", "0.01", "0.09", "0"):
        got = [r[0] for r in df.select(M.net_of(F.col("a"), M.rate(rate))).collect()]
        want = [(a / (1 + Decimal(rate))).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP") for a in amounts]
        assert got == want, rate


@pytest.mark.parametrize(
    "vat, place, taxpayer, total",
    [
        ("100000", "市区", None, "12000.00"),
        ("100000", "县城、镇", None, "10000.00"),
        ("100000", "别处", None, "6000.00"),
        ("100000", None, None, "6000.00"),
        ("100000", "市区", S, "6000.00"),
        ("0", "市区", None, "0.00"),
    ],
)
def test_surcharges(spark, vat, place, taxpayer, total):
    df = spark.createDataFrame(
        [(Decimal(vat), place, taxpayer, AS_OF)], "vat_payable decimal(18,2), location string, taxpayer_type string, as_of date"
    )
    row = X.surcharges(df).first()
    assert row.surcharge_total == Decimal(total)
    assert sum((i["result"] for i in row.surcharge_items), Decimal(0)) == row.surcharge_total


def test_income_tax(spark):
    df = spark.createDataFrame(
        [(Decimal("1000000"), False), (Decimal("1000000"), True), (Decimal("-5"), True), (None, False)],
        "taxable_income decimal(18,2), small_low_profit boolean",
    )
    rows = X.income_tax(df).collect()
    assert [r.cit_payable for r in rows] == [Decimal("250000.00"), Decimal("50000.00"), Decimal("0.00"), None]


def test_rates_and_text(one):
    assert one(M.rate_of, "13%", "0.13", "13") == [Decimal("0.130000")] * 3
    assert one(lambda t: M.percent_text(M.rate_of(t)), "13%", "0.015") == ["13%", "1.5%"]
    assert one(lambda t: M.money_text(M.to_decimal(t)), "1,234.5", "1000000") == ["1,234.50", "1,000,000.00"]
    assert one(lambda t: M.wan_text(M.to_decimal(t)), "100000", "1234") == ["10万元", "1,234.00元"]


def test_longest_word_wins(one):
    rate = lambda t: X.matched_rate(t)["rate"]
    assert one(rate, "出口货物", "销售货物", "说不清") == [Decimal("0"), Decimal("0.13"), None]


@pytest.mark.parametrize(
    "rates, discounts",
    [
        ([{"rate": "13", "citation": "x"}], R.DISCOUNTS),
        ([{"rate": "-0.1", "citation": "x"}], R.DISCOUNTS),
        ([{"rate": "0.13", "citation": ""}], R.DISCOUNTS),
        (R.VAT_RATES, [{"code": "a", "citation": "", "period": ("a", "b")}]),
        (R.VAT_RATES, [{"code": "a", "citation": "x", "period": ("a",)}]),
    ],
)
def test_bad_rules_are_rejected(rates, discounts):
    with pytest.raises(R.RuleError):
        R.validate(rates, R.SURCHARGES, discounts)
