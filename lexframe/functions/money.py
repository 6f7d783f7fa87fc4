"""Exact money: decimals, HALF_UP to the cent at each step."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(9,6)"


def to_decimal(value: Column, kind: str = "decimal(38,10)") -> Column:
    """Text to decimal; thousands separators are dropped, anything else is null."""
    return F.translate(F.trim(value.cast("string")), ",，", "").try_cast(kind)


def yuan(value: Column) -> Column:
    return F.round(value.cast("decimal(38,10)"), 2).cast(MONEY)


def cents(value: Column) -> Column:
    return (value * 100).cast("bigint")


def from_cents(value: Column) -> Column:
    return (value.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def rate_of(value: Column) -> Column:
    """A rate given by a user: ``13%``, ``0.13`` or ``13``."""
    text = F.trim(value.cast("string"))
    number = to_decimal(F.regexp_replace(text, "%$", ""))
    return F.when(text.endswith("%") | (number > 1), number / 100).otherwise(number).cast(RATE)


def rate(value: str) -> Column:
    return F.lit(Decimal(value)).cast(RATE)


def times(amount: Column, factor: Column) -> Column:
    """amount x rate, rounded to the cent. The product is exact before the rounding."""
    return F.round(amount.cast(MONEY) * factor.cast(RATE), 2).cast(MONEY)


def net_of(amount: Column, factor: Column) -> Column:
    """amount / (1 + rate), rounded once. A decimal quotient is already rounded by its own
    scale, so the half-up rule is applied to whole numbers."""
    n = F.abs(cents(amount)).cast("decimal(20,0)")
    d = (F.lit(1_000_000) + (factor.cast(RATE) * 1_000_000).cast("bigint")).cast("decimal(10,0)")
    top = n * F.lit(Decimal(2_000_000)) + d
    whole = F.floor((top - F.pmod(top, d * 2)) / (d * 2)).cast("decimal(18,0)")
    value = (whole * F.lit(Decimal("0.01"))).cast(MONEY)
    return F.when(amount < 0, (-value).cast(MONEY)).otherwise(value)


def percent_text(value: Column) -> Column:
    """0.13 -> 13%, without trailing zeros."""
    text = (value.cast(RATE) * 100).cast("decimal(11,6)").cast("string")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""), F.lit("%"))


def money_text(value: Column) -> Column:
    return F.format_number(yuan(value), 2)


def wan_text(value: Column) -> Column:
    """Whole ten-thousands in words, else the plain amount."""
    whole = (value > 0) & (F.pmod(value, F.lit(Decimal(10000))) == 0)
    return F.when(
        whole, F.concat((value / 10000).cast("bigint").cast("string"), F.lit("万元"))
    ).otherwise(F.concat(money_text(value), F.lit("元")))
