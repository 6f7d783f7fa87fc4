"""Facts of a question as columns; every fact keeps the text it was read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions.common import contains_any, first_rule, lookup, present, text_of
from lexframe.functions.text import detect_names, first_pattern, strip
from lexframe.rules import facts as R


def amount_by(text: Column, pattern: str) -> Column:
    """number x unit to the cent, by groups one and two of the pattern."""
    number = F.regexp_extract(text, pattern, 1).try_cast("decimal(18,4)")
    unit = F.coalesce(lookup(F.regexp_extract(text, pattern, 2), R.UNITS), F.lit(1))
    return F.when(text.rlike(pattern), M.yuan(number * unit.cast("decimal(12,0)")))


def _rule(text: Column, rules) -> Column:
    """struct(value, label, matched) of the first rule (value, label, patterns) that matches, null for none. A rule
    without a value gives the matched text."""
    out = None
    for value, label, patterns in rules:
        found = first_pattern(text, patterns)
        hit = F.struct(
            (strip(found) if value is None else F.lit(value)).alias("value"),
            F.lit(label).alias("label"),
            found.alias("matched"),
        )
        out = (F.when if out is None else out.when)(found.isNotNull(), hit)
    return out


def extract_facts(df: DataFrame, text: str = "text") -> DataFrame:
    body = text_of(text)
    # Every rule table is searched once; its columns and the evidence read what it found.
    rows = df.withColumns(
        {
            "_taxpayer": _rule(body, [(t["value"], "", t["patterns"]) for t in R.TAXPAYERS]),
            "_period": _rule(body, R.PERIODS),
            "_region": _rule(body, [(v, "", p) for v, p in R.REGIONS]),
            "_business": _rule(body, [(v, "", p) for v, p in R.BUSINESS]),
        }
    ).withColumns({"taxpayer_type": F.col("_taxpayer.value"), "_taxpayer_text": F.col("_taxpayer.matched")})
    confirm = lookup(F.col("taxpayer_type"), {t["value"]: t["confirm"] for t in R.TAXPAYERS}, True)
    stated = F.lit(False)
    for t in R.TAXPAYERS:
        stated = stated | (
            (F.col("taxpayer_type") == t["value"]) & contains_any(F.col("_taxpayer_text"), t["stated"])
        )
    amount = amount_by(body, R.AMOUNT)
    scale = F.map_filter(
        F.create_map(
            *[
                x
                for name, patterns in R.SCALE
                for x in (F.lit(name), F.coalesce(*[amount_by(body, p) for p in patterns]))
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = rows.withColumns(
        {
            "taxpayer_confirmed": F.col("taxpayer_type").isNotNull() & ~confirm,
            "taxpayer_stated": F.coalesce(stated, F.lit(False)),
            "amount": amount,
            "input_vat": amount_by(body, R.INPUT_VAT),
            "period": F.col("_period.value"),
            "period_scope": F.col("_period.label"),
            "region": F.col("_region.value"),
            "business_type": F.col("_business.value"),
            "scale": scale,
            "tax_types": detect_names(body),
        }
    ).withColumns(
        {
            "amount_includes_tax": F.when(
                F.col("amount").isNotNull(),
                F.when(contains_any(body, R.NET_WORDS), F.lit(False)).when(
                    contains_any(body, R.GROSS_WORDS), F.lit(True)
                ),
            ),
            "amount_period": F.when(
                F.col("amount").isNotNull(),
                first_rule([(n, contains_any(body, w)) for n, w in R.AMOUNT_PERIODS]),
            ),
        }
    )

    def seen(field: str, value: Column, text: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(field).alias("field"),
                value.cast("string").alias("value"),
                text.alias("matched"),
            ),
        )

    evidence = present(
        [
            seen("taxpayer_type", F.col("taxpayer_type"), F.col("_taxpayer_text")),
            seen("amount", F.col("amount"), F.regexp_extract(body, R.AMOUNT, 0)),
            seen("input_vat", F.col("input_vat"), F.regexp_extract(body, R.INPUT_VAT, 0)),
            seen("period", F.col("period"), F.col("_period.matched")),
            seen("region", F.col("region"), F.col("_region.matched")),
            seen("business_type", F.col("business_type"), F.col("_business.matched")),
        ]
    )
    return _open_points(rows.withColumn("evidence", evidence).drop("_taxpayer", "_taxpayer_text", "_period", "_region", "_business"))


def _open_points(rows: DataFrame) -> DataFrame:
    """The missing list, the question about the subject, and at most two questions."""
    unknown = F.col("taxpayer_type").isNull()
    unsure = ~unknown & ~F.col("taxpayer_confirmed")
    no_amount = F.col("amount").isNull()
    no_basis = ~no_amount & F.col("amount_includes_tax").isNull()
    no_period, no_business = F.col("period").isNull(), F.col("business_type").isNull()
    missing = [
        F.when(unknown, F.lit("taxpayer")),
        F.when(unsure, F.lit("taxpayer_confirm")),
        F.when(no_period, F.lit("period")),
        F.when(no_business, F.lit("business")),
        F.when(no_amount, F.lit("amount")),
        F.when(no_basis, F.lit("amount_basis")),
    ]
    before, after = R.FOLLOW_UPS["subject_confirm"].split("{}")
    subject = F.when(unknown, F.lit(R.FOLLOW_UPS["subject"])).when(
        unsure, F.concat(F.lit(before), F.col("taxpayer_type"), F.lit(after))
    )
    asks = [
        subject,
        F.when(no_basis, F.lit(R.FOLLOW_UPS["amount_basis"])).when(
            no_amount, F.lit(R.FOLLOW_UPS["amount"])
        ),
        F.when(no_period, F.lit(R.FOLLOW_UPS["period"])),
        F.when(no_business, F.lit(R.FOLLOW_UPS["business"])),
    ]
    return rows.withColumns(
        {
            "missing": present(missing),
            "subject_question": subject,
            "questions": F.slice(present(asks), 1, R.MAX_QUESTIONS),
        }
    )


def limit_in(text: Column, patterns) -> Column:
    """struct(limit, matched) of the first pattern present; null for none."""
    out = None
    for p in patterns:
        number = F.regexp_extract(text, p, 1).try_cast("decimal(18,4)")
        unit = F.coalesce(lookup(F.regexp_extract(text, p, 2), R.UNITS), F.lit(1))
        found = F.struct(
            (number * unit.cast("decimal(12,0)")).cast("decimal(24,4)").alias("limit"),
            F.regexp_extract(text, p, 0).alias("matched"),
        )
        out = (F.when if out is None else out.when)(text.rlike(p), found)
    return out


SENTENCE_MARKS = "。；\n"


def sentence_with(text: Column, needle: Column) -> Column:
    """The sentence that holds the needle, cut to 120 characters; the head of the text when none does.

    The text is cut at the first needle and from there to the next marks: no needle without a mark in it
    reaches over two sentences."""
    before = F.call_function("substring_index", text, needle, F.lit(1))
    after = F.substring(text, F.length(before) + 1, F.length(text))
    for mark in SENTENCE_MARKS:
        before, after = F.substring_index(before, mark, -1), F.substring_index(after, mark, 1)
    within = text.contains(needle) & ~needle.rlike(f"[{SENTENCE_MARKS}]")
    return F.substring(strip(F.when(within, F.concat(before, after)).otherwise(text)), 1, 120)
