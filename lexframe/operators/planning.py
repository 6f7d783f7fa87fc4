"""Planning over tables of company profiles: matching, measuring, legality, dispatch and
the review desk. Techniques are literals in the plan, so a profile meets each technique
without a join."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions import text as T
from lexframe.functions.common import lookup, present, text_of
from lexframe.operators import tax as X
from lexframe.operators.qa import all_of
from lexframe.rules import planning as R
from lexframe.rules import text as TR

# ---------------------------------------------------------------- profiles


def validate_profile(df: DataFrame) -> DataFrame:
    """Adds problems and missing. A field that is not part of the profile is an error."""
    problems = []
    for name, allowed in R.ENUMS.items():
        if name in df.columns:
            problems.append(F.when(~F.col(name).isin(*allowed), F.lit(f"{name}: value")))
    for name in R.NON_NEGATIVE:
        if name in df.columns:
            problems.append(F.when(F.col(name) < 0, F.lit(f"{name}: negative")))
    missing = []
    for name in R.REQUIRED:
        if name not in df.columns:
            missing.append(F.lit(name))
        elif name == "flexible":
            missing.append(F.when(F.coalesce(F.size(name), F.lit(0)) <= 0, F.lit(name)))
        elif name == "business_authentic":
            missing.append(F.when(~F.coalesce(F.col(name), F.lit(False)), F.lit(name)))
        else:
            missing.append(F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name)))
    return df.withColumns({"problems": present(problems), "missing": present(missing)})


# ---------------------------------------------------------------- conditions


def _number(compare: Callable[[Column, Column], Column]):
    def build(actual: Column, expected: object) -> Column:
        return compare(
            actual.cast("string").try_cast("decimal(38,6)"), F.lit(str(expected)).try_cast("decimal(38,6)")
        )

    return build


def _listed(expected: object) -> list:
    return list(expected) if isinstance(expected, (list, tuple)) else [expected]


# Condition operators by name; a caller may pass more.
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "in": lambda a, e: a.isin(*_listed(e)),
    "<=": _number(lambda a, b: a <= b),
    ">=": _number(lambda a, b: a >= b),
    "<": _number(lambda a, b: a < b),
    ">": _number(lambda a, b: a > b),
    "=": lambda a, e: a == F.lit(e),
    "==": lambda a, e: a == F.lit(e),
    "!=": lambda a, e: a != F.lit(e),
    "<>": lambda a, e: a != F.lit(e),
}


def _truthy(df: DataFrame, field: str) -> Column:
    kind = dict(df.dtypes).get(field, "string")
    value = F.col(field)
    if kind.startswith(("map", "array")):
        return F.size(value) > 0
    if kind == "boolean":
        return value
    return value.cast("string") != "" if kind == "string" else value != 0


def check(df: DataFrame, condition: tuple, operators: Mapping = OPERATORS) -> Column:
    """true / false / null. Missing input and unknown operators give null."""
    field, op, expected = condition
    op = op.lower()
    head, _, tail = field.partition(".")
    if head not in df.columns:
        return F.lit(None).cast("boolean")
    actual = F.col(head)[tail] if tail else F.col(head)
    if op in ("exists", "truthy"):
        holds = actual.cast("boolean") if tail else _truthy(df, head)
        holds = holds == F.lit(bool(expected)) if op == "exists" else holds
        return F.when(actual.isNotNull(), holds)
    if op not in operators:
        return F.lit(None).cast("boolean")
    return F.when(actual.isNotNull(), operators[op](actual, expected))


def match_techniques(
    profiles: DataFrame, techniques: Sequence[Mapping] = R.TECHNIQUES, operators: Mapping = OPERATORS
) -> DataFrame:
    """One row per (profile, technique) with ``matched`` (null = not enough information),
    the violated and the missing conditions."""
    entries = []
    for t in techniques:
        checks = [(f"{c[0]} {c[1]}", check(profiles, c, operators)) for c in t["conditions"]]
        values = (
            F.array(*[c for _, c in checks]) if checks else F.array().cast("array<boolean>")
        )
        entries.append(
            F.struct(
                F.lit(t["code"]).alias("code"),
                F.lit(t["category"]).alias("category"),
                F.lit(t["risk_level"]).alias("risk_level"),
                F.lit(t["cost"]).alias("cost"),
                F.lit(t.get("measure")).cast("string").alias("measure"),
                F.array(*[F.lit(c) for c in t["citations"]]).alias("citations"),
                all_of(values, empty=F.lit(True)).alias("matched"),
                present([F.when(~c, F.lit(n)) for n, c in checks] or [F.lit(None).cast("string")]).alias("violated"),
                present([F.when(c.isNull(), F.lit(n)) for n, c in checks] or [F.lit(None).cast("string")]).alias("missing"),
            )
        )
    return profiles.withColumn("_t", F.explode(F.array(*entries))).select(
        *[c for c in profiles.columns if c not in ("missing", "problems")], "_t.*"
    )


# ---------------------------------------------------------------- measuring


def profile_taxes(profiles: DataFrame) -> DataFrame:
    """Adds the tax figures that the measures need, once per profile.

    Reads taxpayer_type, annual_revenue, main_income_source, taxable_income, region, as_of.
    """
    rows = X.vat(
        profiles.withColumns(
            {
                "sales_amount": F.col("annual_revenue").cast(M.MONEY),
                "amount_includes_tax": F.lit(False),
                "business_type": F.col("main_income_source"),
            }
        )
    ).withColumns({"vat_payable": F.col("payable"), "location": F.col("region"), "_taxpayer": F.col("taxpayer_type")})
    full = X.surcharges(rows.withColumn("taxpayer_type", F.lit(None).cast("string")))
    full = full.withColumn("surcharge_full", F.col("surcharge_total"))
    half = X.surcharges(full.withColumn("taxpayer_type", F.lit("小规模纳税人")))
    half = half.withColumn("surcharge_half", F.col("surcharge_total"))
    normal = X.income_tax(half.withColumn("_small", F.lit(False)), "taxable_income", "_small")
    normal = normal.withColumn("cit_normal", F.col("cit_payable"))
    small = X.income_tax(normal.withColumn("_small", F.lit(True)), "taxable_income", "_small")
    return small.select(
        *[F.col(c) for c in profiles.columns if c != "taxpayer_type"],
        F.col("_taxpayer").alias("taxpayer_type"),
        "vat_payable",
        "surcharge_full",
        "surcharge_half",
        "cit_normal",
        F.col("cit_payable").alias("cit_small"),
    )


def measure(plans: DataFrame) -> DataFrame:
    """Adds computable, before, after, saving and the reason when there is no figure.
    Every figure comes from the tax operators."""
    kind = F.col("measure")
    zero = F.lit(0).cast(M.MONEY)
    vat = F.coalesce("vat_payable", zero)
    before = (
        F.when(kind == "exempt", F.when(F.col("annual_revenue").isNotNull(), vat))
        .when(kind == "halve", F.when(vat > 0, F.col("surcharge_full")))
        .when(kind == "small_low_profit", F.col("cit_normal"))
    )
    after = (
        F.when(kind == "exempt", zero)
        .when(kind == "halve", F.col("surcharge_half"))
        .when(kind == "small_low_profit", F.col("cit_small"))
    )
    reason = (
        F.when(kind.isNull(), F.lit("no_measure"))
        .when(kind.isin("rd_super_deduction", "equipment_one_off"), F.lit("amount_missing"))
        .when((kind == "small_low_profit") & F.col("taxable_income").isNull(), F.lit("income_missing"))
        .when(kind.isin("exempt", "halve") & F.col("annual_revenue").isNull(), F.lit("sales_missing"))
        .when((kind == "halve") & (vat <= 0), F.lit("no_vat"))
        .when(~kind.isin("exempt", "halve", "small_low_profit"), F.lit("unknown_measure"))
    )
    done = reason.isNull()
    return plans.withColumns(
        {
            "computable": done,
            "before": F.when(done, before.cast(M.MONEY)),
            "after": F.when(done, after.cast(M.MONEY)),
            "saving": F.when(done, (before - after).cast(M.MONEY)),
            "measure_note": reason,
        }
    )


def candidate_plans(profiles: DataFrame, techniques: Sequence[Mapping] = R.TECHNIQUES) -> DataFrame:
    """Plans that apply or may apply; ruled-out techniques are left out."""
    rows = match_techniques(profile_taxes(profiles), techniques)
    keep = F.col("matched").isNull() | F.col("matched")
    return measure(rows.filter(keep)).withColumn(
        "path", F.coalesce(lookup(F.col("category"), R.PATHS), F.lit("B"))
    )


def plan_order() -> list[Column]:
    return [(~F.col("computable")).cast("int"), lookup(F.col("cost"), R.COSTS, 9), F.col("code")]


def comparison(plans: DataFrame) -> DataFrame:
    """Adds the advice; ``comparison_order`` sorts by saving, unknown last."""
    advice = (
        F.when(F.size("missing") > 0, F.lit("fill_gaps_first"))
        .when((F.col("risk_level") == "green") & (F.col("cost") == "低"), F.lit("do_first"))
        .when(F.col("risk_level") == "green", F.lit("mind_the_cost"))
        .when(F.col("risk_level") == "yellow", F.lit("ask_authority"))
        .otherwise(F.lit("review_only"))
    )
    return plans.withColumn("advice", advice)


def comparison_order() -> list[Column]:
    return [F.col("saving").desc_nulls_last(), F.col("code")]


def combination_notes(plans: DataFrame, key: str) -> DataFrame:
    """Notes from the set of categories of a profile's plans (at most seven)."""
    seen = plans.groupBy(key).agg(F.collect_set("category").alias("_c"))
    has = lambda name: F.array_contains("_c", name)
    return seen.select(
        key,
        present(
            [
                F.when(has("政策适用型") & has("时点安排型"), F.lit("policy_with_timing")),
                F.when(has("主体架构型"), F.lit("structure_last")),
                F.when(has("区域型"), F.lit("region_with_structure")),
                F.lit("authority_decides"),
            ]
        ).alias("notes"),
    )


# ---------------------------------------------------------------- legality and dispatch


def legality(plans: DataFrame, text: str, rules: Sequence = TR.RED_LINES) -> DataFrame:
    """Four checks and the risk grade: red for a red line, no basis or no substance;
    yellow for open anti-avoidance questions or an aggressive preference; else green.

    Reads citations, business_purpose, business_benefit, evidence_available,
    business_authentic, risk_preference and the text of request and plan.
    """
    hits = T.red_lines(F.col(text), rules)
    rows = plans.withColumn("red_line_hits", hits)
    basis = F.coalesce(F.size("citations"), F.lit(0)) > 0
    red_line = F.size("red_line_hits") == 0
    anti = (
        (text_of("business_purpose") != "")
        & (text_of("business_benefit") != "")
        & (F.coalesce(F.size("evidence_available"), F.lit(0)) > 0)
    )
    substance = F.coalesce(F.col("business_authentic"), F.lit(False))
    grade = (
        F.when(~red_line | ~basis | ~substance, F.lit("red"))
        .when(~anti | F.coalesce(F.col("risk_preference") == "进取", F.lit(False)), F.lit("yellow"))
        .otherwise(F.lit("green"))
    )
    return rows.withColumns(
        {
            "basis_ok": basis,
            "red_line_ok": red_line,
            "anti_avoidance_ok": anti,
            "substance_ok": substance,
            "grade": grade,
            "legal": basis & red_line & anti & substance,
        }
    )


def dispatch(plans: DataFrame, level: str = "risk_level") -> DataFrame:
    """Channels per plan. A red plan never reaches the user, whatever the table says."""
    action = F.coalesce(lookup(F.col(level), R.RISK_ACTIONS), F.lit("review_only"))
    to_user = (action != "review_only") & (F.col(level) != "red")
    return plans.withColumns(
        {
            "to_user": to_user,
            "to_review": ~to_user | (action == "output_with_prompt"),
            "spot_check": to_user & (action == "output"),
            "withheld": ~to_user,
            "prompt": F.when(to_user & (action == "output_with_prompt"), F.lit(R.PROMPT)),
        }
    )


# ---------------------------------------------------------------- review desk

# Actions and the status they lead to.
REVIEW_STATUS = {"approve": "approved", "approve_with_changes": "approved_with_changes", "reject": "rejected"}


def decide(reviews: DataFrame, decisions: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(reviews after the batch, refused decisions with the reason).

    decisions: key, action, reviewer, note, decided_at. Only pending reviews can be
    decided, once; a rejection needs a note.
    """
    first = decisions.groupBy(key).agg(F.min_by(F.struct("action", "reviewer", "note", "decided_at"), "decided_at").alias("_d"))
    asked = decisions.join(reviews.select(key, F.col("status").alias("_was")), key, "left")
    refused = asked.withColumn(
        "refusal",
        F.when(~F.col("action").isin(*REVIEW_STATUS), F.lit("unknown_action"))
        .when(F.col("_was").isNull(), F.lit("no_such_review"))
        .when(F.col("_was") != "pending", F.lit("already_decided"))
        .when((F.col("action") == "reject") & (F.trim(text_of("note")) == ""), F.lit("note_missing")),
    ).filter(F.col("refusal").isNotNull()).drop("_was")
    rows = reviews.join(first, key, "left")
    valid = (
        F.col("_d").isNotNull()
        & (F.col("status") == "pending")
        & F.col("_d.action").isin(*REVIEW_STATUS)
        & ~((F.col("_d.action") == "reject") & (F.trim(text_of("_d.note")) == ""))
    )
    valid = F.coalesce(valid, F.lit(False))
    done = rows.withColumns(
        {
            "status": F.when(valid, lookup(F.col("_d.action"), REVIEW_STATUS)).otherwise(F.col("status")),
            "reviewer": F.when(valid, F.col("_d.reviewer")),
            "note": F.when(valid, F.col("_d.note")),
            "decided_at": F.when(valid, F.col("_d.decided_at")).otherwise(F.col("decided_at")),
        }
    ).drop("_d")
    return done, refused


def hours_between(start: Column, end: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", start, end)
    return seconds / F.lit(3600.0)


def workload(reviews: DataFrame, sla_hours: float = R.SLA_HOURS) -> DataFrame:
    hours = hours_between(F.col("created_at"), F.col("decided_at"))
    decided = F.col("decided_at").isNotNull()
    return reviews.agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(decided).alias("decided"),
        F.round(F.avg(hours), 2).alias("avg_hours"),
        F.round(F.count_if(hours <= sla_hours) / F.nullif(F.count_if(decided), F.lit(0)), 3).alias("on_time_rate"),
    )


def overdue(reviews: DataFrame, now: Column, sla_hours: float = R.SLA_HOURS) -> DataFrame:
    """Pending longer than the limit: marked as downgraded, never released silently."""
    late = (F.col("status") == "pending") & (hours_between(F.col("created_at"), now) > sla_hours)
    return reviews.filter(late).withColumn("mark", F.lit("downgraded"))


def feedback(reviews: DataFrame) -> DataFrame:
    """Rejected and changed plans with the suggested use, newest decision first."""
    return (
        reviews.filter(F.col("status").isin("rejected", "approved_with_changes"))
        .withColumn(
            "suggested_use",
            F.when(F.col("status") == "rejected", F.lit("negative_case")).otherwise(F.lit("calibration")),
        )
        .orderBy(F.col("decided_at").desc())
    )
