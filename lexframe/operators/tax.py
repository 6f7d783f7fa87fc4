"""Tax computation over tables of transactions.

Inputs are columns of one table; the result columns are added to it. Rules are literals,
so nothing is joined and the work is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions.common import present, text_of
from lexframe.operators.temporal import in_period
from lexframe.rules import tax as R

ZERO = "0.00"


def zero() -> Column:
    return F.lit(0).cast(M.MONEY)


def note(code: str, holds: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.lit(code))


def step(title: str, formula: str, result: Column, citation: Column | str) -> Column:
    cited = F.lit(citation) if isinstance(citation, str) else citation
    return F.struct(
        F.lit(title).alias("title"),
        F.lit(formula).alias("formula"),
        result.cast(M.MONEY).alias("result"),
        cited.alias("citation"),
    )


# ---------------------------------------------------------------- rules as columns


def matched_rate(business: Column, rates: Sequence[Mapping] = R.VAT_RATES) -> Column:
    """struct(rate, name, citation) of the longest matching word; null for none.

    Of each rate only its first matching word counts, and rate order decides ties.
    """
    text = F.trim(text_of(business))
    rated = []
    for at, entry in enumerate(rates):
        size = None
        for word in entry["keywords"]:
            size = (F.when if size is None else size.when)(text.contains(word), F.lit(len(word)))
        rated.append(
            F.when(
                size.isNotNull(),
                F.struct(
                    size.alias("size"),
                    F.lit(-at).alias("order"),
                    M.rate(entry["rate"]).alias("rate"),
                    F.lit(entry["name"]).alias("name"),
                    F.lit(entry["citation"]).alias("citation"),
                ),
            )
        )
    return F.array_max(F.array(*rated))


def method_of(taxpayer: Column) -> Column:
    return F.when(taxpayer.contains("小规模"), F.lit("simplified")).when(
        taxpayer.contains("一般纳税人"), F.lit("general")
    )


def discount_applies(item: Mapping, tax: str, as_of: Column, taxpayer: Column) -> Column:
    """In its closed period, for its tax; a condition on the taxpayer needs a known one."""
    if tax not in item["taxes"]:
        return F.lit(False)
    start, end = (F.lit(d).cast("date") for d in item["period"])
    holds = in_period(start, end, as_of)
    if item.get("taxpayers"):
        holds = holds & F.coalesce(taxpayer.isin(*item["taxpayers"]), F.lit(False))
    return holds


def applicable_discounts(
    df: DataFrame,
    tax: Column,
    as_of: Column,
    taxpayer: Column,
    discounts: Sequence[Mapping] = R.DISCOUNTS,
) -> DataFrame:
    """Adds the codes of the discounts open to each row, in rule order."""
    codes = []
    for item in discounts:
        start, end = (F.lit(d).cast("date") for d in item["period"])
        holds = tax.isin(*item["taxes"]) & in_period(start, end, as_of)
        if item.get("taxpayers"):
            holds = holds & taxpayer.isin(*item["taxpayers"])
        codes.append(note(item["code"], holds))
    return df.withColumn("discounts", present(codes))


def _discount(code: str) -> Mapping:
    return next(d for d in R.DISCOUNTS if d["code"] == code)


# ---------------------------------------------------------------- value added tax


def vat(df: DataFrame) -> DataFrame:
    """Adds method, rate, net_sales, payable, computable, discount, notes and steps.

    Reads taxpayer_type, method?, sales_amount, amount_includes_tax, business_type, rate?,
    output_vat?, input_vat?, period_scope, as_of; absent columns count as null.
    """
    optional = {
        "method": "string",
        "rate": "string",
        "output_vat": M.MONEY,
        "input_vat": M.MONEY,
        "period_scope": "string",
        "business_type": "string",
    }
    for name, kind in optional.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    taxpayer, as_of = F.col("taxpayer_type"), F.col("as_of")
    sales = M.yuan(F.col("sales_amount"))
    gross = F.coalesce(F.col("amount_includes_tax"), F.lit(False))
    method = F.coalesce(F.col("method"), method_of(taxpayer))
    rows = df.withColumns(
        {
            "_method": method,
            "_given": M.rate_of(F.col("rate")),
            "_match": matched_rate(F.col("business_type")),
            "_exempt": discount_applies(
                _discount("small_scale_vat_exemption"), "vat", as_of, taxpayer
            ),
            "_reduced": discount_applies(
                _discount("small_scale_levy_rate_reduction"), "vat", as_of, taxpayer
            ),
        }
    )
    general = F.col("_method") == "general"
    levy = F.coalesce(
        F.col("_given"),
        F.when(
            F.col("_reduced"), M.rate(_discount("small_scale_levy_rate_reduction")["to_rate"])
        ).otherwise(M.rate(R.VAT_LEVY_RATE)),
    )
    rows = rows.withColumn(
        "_rate",
        F.when(general, F.coalesce(F.col("_given"), F.col("_match.rate"))).when(
            F.col("_method") == "simplified", levy
        ),
    )
    rows = rows.withColumn(
        "_net", F.when(gross, M.net_of(sales, F.col("_rate"))).otherwise(sales)
    )
    rows = _exemption_verdict(rows, sales, gross)
    output = F.coalesce(M.yuan(F.col("output_vat")), M.times(F.col("_net"), F.col("_rate")))
    rows = rows.withColumns(
        {
            "_output": F.when(general, output),
            "_input": F.coalesce(M.yuan(F.col("input_vat")), zero()),
        }
    )
    due = (F.col("_output") - F.col("_input")).cast(M.MONEY)
    levied = M.times(F.col("_net"), F.col("_rate"))
    verdict = F.col("_verdict")
    payable = F.when(general & due.isNotNull(), F.greatest(due, zero())).when(
        F.col("_method") == "simplified",
        F.when(verdict == "exempt", F.when(sales.isNotNull(), zero())).when(
            verdict == "taxable", levied
        ),
    )
    general_open = general & F.col("output_vat").isNull()
    simplified = F.col("_method") == "simplified"
    notes = present(
        [
            note("method_unknown", F.col("_method").isNull()),
            note("sales_missing", sales.isNull() & (general_open | simplified)),
            note("rate_unknown", general_open & sales.isNotNull() & F.col("_rate").isNull()),
            note("input_missing", F.col("_output").isNotNull() & F.col("input_vat").isNull()),
            note("carry_forward", due < 0),
            note("year_scope", simplified & (verdict == "year_scope")),
            note("scope_conflict", simplified & (verdict == "scope_conflict")),
            note("basis_conflict", simplified & (verdict == "basis_conflict")),
        ]
    )
    rows = rows.withColumn("_payable", payable)
    steps = _vat_steps(general, gross, verdict)
    drop = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumns(
        {
            "method": F.col("_method"),
            "applied_rate": F.when(F.col("_payable").isNotNull(), F.col("_rate")),
            "net_sales": F.col("_net"),
            "computed_output_vat": F.col("_output"),
            "payable": F.col("_payable"),
            "computable": F.col("_payable").isNotNull(),
            "discount": F.when(
                simplified & (verdict == "exempt"), F.lit("small_scale_vat_exemption")
            ).when(
                simplified & (verdict == "taxable") & F.col("_reduced") & F.col("_given").isNull(),
                F.lit("small_scale_levy_rate_reduction"),
            ),
            "notes": notes,
            "steps": F.when(F.col("_payable").isNotNull(), steps).otherwise(
                F.slice(steps, 1, 0)
            ),
        }
    ).drop(*drop)


def _exemption_verdict(rows: DataFrame, sales: Column, gross: Column) -> DataFrame:
    """exempt / taxable if every reading agrees, else the reason why there is no number.

    Readings: the stated scope, or month and quarter if none is stated, each with the
    statutory and, where it is open, the reduced conversion of a gross amount.
    """
    item = _discount("small_scale_vat_exemption")
    reduced = M.rate(_discount("small_scale_levy_rate_reduction")["to_rate"])
    nets = {
        "statutory": F.when(gross, M.net_of(sales, M.rate(R.VAT_LEVY_RATE))).otherwise(sales),
        "reduced": F.when(gross, M.net_of(sales, reduced)).otherwise(sales),
    }
    limits = {s: F.lit(item[f"{s}_limit"]).cast(M.MONEY) for s in ("month", "quarter")}
    scope = F.col("period_scope")

    def below(basis: str, period: str) -> Column:
        asked = ~F.coalesce(scope.isin("month", "quarter"), F.lit(False)) | (scope == period)
        if basis == "reduced":
            asked = asked & F.col("_reduced")
        return F.when(asked, nets[basis] <= limits[period])

    readings = F.array_distinct(
        present([below(b, p) for b in nets for p in limits])
    )
    stated = F.coalesce(scope.isin("month", "quarter"), F.lit(False))
    scopes_differ = ~stated & (below("statutory", "month") != below("statutory", "quarter"))
    return rows.withColumn(
        "_verdict",
        F.when(sales.isNull(), F.lit(None).cast("string"))
        .when(~F.col("_exempt"), F.lit("taxable"))
        .when(scope == "year", F.lit("year_scope"))
        .when(
            F.size(readings) == 1,
            F.when(F.get(readings, F.lit(0)), F.lit("exempt")).otherwise(F.lit("taxable")),
        )
        .when(scopes_differ, F.lit("scope_conflict"))
        .otherwise(F.lit("basis_conflict")),
    )


def _vat_steps(general: Column, gross: Column, verdict: Column) -> Column:
    net = F.when(
        gross & F.col("_net").isNotNull() & (~general | F.col("output_vat").isNull()),
        step("net_sales", "gross / (1 + rate)", F.col("_net"), R.VAT_NET_CITATION),
    )
    output = F.when(
        general & F.col("output_vat").isNull(),
        step("output_tax", "net_sales * rate", F.col("_output"), F.col("_match.citation")),
    )
    exempt = F.when(
        ~general & (verdict == "exempt"),
        step(
            "适用免征增值税优惠",
            "未超过免征标准",
            zero(),
            _discount("small_scale_vat_exemption")["citation"],
        ),
    )
    final = F.when(
        general,
        step("payable", "output_tax - input_tax", F.col("_payable"), R.VAT_GENERAL_CITATION),
    ).when(
        verdict != "exempt",
        step("payable", "net_sales * levy_rate", F.col("_payable"), R.VAT_GENERAL_CITATION),
    )
    return present([net, output, exempt, final])


# ---------------------------------------------------------------- surcharges


def surcharge_rate(item: Mapping, location: Column) -> Column:
    """The first tier whose name holds the location; the lowest tier if none does."""
    tiers = item["rates"]
    if len(tiers) == 1:
        return M.rate(tiers[0][0])
    out = None
    for value, name in tiers:
        hit = (F.length(location) > 0) & F.lit(name).contains(location)
        out = (F.when if out is None else out.when)(hit, M.rate(value))
    return out.otherwise(M.rate(tiers[-1][0]))


def surcharges(df: DataFrame) -> DataFrame:
    """Adds surcharge_base, surcharge_items and surcharge_total (the sum of the rounded
    items). Reads vat_payable, consumption_tax?, location, taxpayer_type, as_of."""
    if "consumption_tax" not in df.columns:
        df = df.withColumn("consumption_tax", zero())
    taxpayer, as_of, location = F.col("taxpayer_type"), F.col("as_of"), F.col("location")
    base = M.yuan(
        F.coalesce(F.col("vat_payable"), zero()) + F.coalesce(F.col("consumption_tax"), zero())
    )
    rows = df.withColumn("surcharge_base", base)
    half = _discount("small_business_half_surcharges")
    items, total, known = [], zero(), F.lit(False)
    for item in R.SURCHARGES:
        full = M.times(F.col("surcharge_base"), surcharge_rate(item, location))
        amount = F.when(
            discount_applies(half, item["code"], as_of, taxpayer),
            M.times(full, M.rate(half["factor"])),
        ).otherwise(full)
        items.append(
            F.struct(
                F.lit(item["code"]).alias("code"),
                F.lit(item["name"]).alias("title"),
                amount.alias("result"),
                F.lit(item["citation"]).alias("citation"),
            )
        )
        total = total + amount
        if len(item["rates"]) > 1:
            for _, name in item["rates"]:
                known = known | ((F.length(location) > 0) & F.lit(name).contains(location))
    taxed = F.col("surcharge_base") > 0
    return rows.withColumns(
        {
            "surcharge_items": F.when(taxed, F.array(*items)).otherwise(F.slice(F.array(*items), 1, 0)),
            "surcharge_total": F.when(taxed, total.cast(M.MONEY)).otherwise(zero()),
            "surcharge_notes": present(
                [
                    note("no_base", ~taxed),
                    note("location_unknown", taxed & ~F.coalesce(known, F.lit(False))),
                ]
            ),
        }
    )


# ---------------------------------------------------------------- corporate income tax


def income_tax(df: DataFrame, income: str = "taxable_income", small: str = "small_low_profit") -> DataFrame:
    """Adds cit_payable and cit_notes; the small-profit variant rounds the counted part
    and the tax separately."""
    value = M.yuan(F.col(income))
    is_small = F.coalesce(F.col(small), F.lit(False))
    counted = M.times(value, M.rate(R.CIT_SMALL["include_ratio"]))
    tax = F.when(is_small, M.times(counted, M.rate(R.CIT_SMALL["rate"]))).otherwise(
        M.times(value, M.rate(R.CIT_RATE))
    )
    return df.withColumns(
        {
            "cit_payable": F.when(value > 0, tax).when(value <= 0, zero()),
            "cit_discount": F.when(is_small & (value > 0), F.lit(R.CIT_SMALL["code"])),
            "cit_notes": present(
                [note("income_missing", value.isNull()), note("no_income", value <= 0)]
            ),
        }
    )


def tax_response(df: DataFrame) -> DataFrame:
    """VAT and surcharges together: a total only where the VAT is computable."""
    return df.withColumn(
        "total_payable",
        F.when(F.col("computable"), (F.col("payable") + F.col("surcharge_total")).cast(M.MONEY)),
    )
