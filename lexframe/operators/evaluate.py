"""Evaluation cases, retrieval metrics and release gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import contains_any, first_rule, lookup
from lexframe.operators.numbering import number_rows

# Thresholds, veto, canary ladder, class shares.
THRESHOLDS = {"pass_rate": 0.85, "recall_at_5": 0.80}
VETO = ("trap_leaks",)
CANARY_STEPS = (0.05, 0.20, 0.50, 1.00)
SHARES = {"standard": 0.55, "repealed_trap": 0.15, "insufficient": 0.20}

# Question templates with the words that call for them (fixed values), in order.
TEMPLATES = (
    ("{tax}由谁缴纳", ("纳税人", "纳税义务人")),
    ("{tax}按多高的比率计算", ("税率", "征收率")),
    ("计算{tax}时以什么金额为基数", ("计税依据", "应纳税额")),
    ("{subject}可以少缴{tax}吗", ("免征", "减免", "优惠")),
    ("什么时候产生{tax}义务", ("纳税义务发生时间",)),
    ("{tax}在何时何处办理申报", ("申报", "缴纳")),
    ("{tax}归谁征管", ("征收管理", "税务机关")),
)
SUBJECTS = ("小规模纳税人", "一般纳税人", "小型微利企业", "个体工商户")
INSUFFICIENT = ("这笔业务涉及{tax}吗", "本月{tax}该算多少", "我能不能少缴{tax}")
TRAP_QUESTION = "请说明{tax}目前的规定"


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def select_cases(cases: DataFrame, include_draft: bool = True, types: Sequence[str] = ()) -> DataFrame:
    out = cases if include_draft else cases.filter(F.col("review_state") == "approved")
    return out.filter(F.col("case_type").isin(*types)) if types else out


def round_robin(df: DataFrame, key: str, values: Sequence[str], name: str) -> DataFrame:
    """Assign values in turn, in the order of an integer key."""
    at = F.pmod(F.col("_at") - 1, F.lit(len(values)))
    listed = F.array(*[F.lit(v) for v in values])
    return (
        number_rows(df, key, "_at")
        .withColumn(name, F.element_at(listed, (at + 1).cast("int")))
        .drop("_at")
    )


def standard_cases(articles: DataFrame, tax: str = "tax_type", templates=TEMPLATES) -> DataFrame:
    """One candidate per article that a template fits; articles carry ``subject``."""
    content = F.col("content")
    fits = [(i, contains_any(content, words)) for i, (_, words) in enumerate(templates)]
    rows = articles.withColumn("template_no", first_rule(fits)).filter(
        F.col("template_no").isNotNull() & F.col(tax).isNotNull()
    )
    question = hints = None
    for i, (template, words) in enumerate(templates):
        hit = F.col("template_no") == i
        text = _fill(template, tax=F.col(tax), subject=F.col("subject"))
        found = F.slice(
            F.array_compact(F.array(*[F.when(content.contains(w), F.lit(w)) for w in words])), 1, 3
        )
        question = (F.when if question is None else question.when)(hit, text)
        hints = (F.when if hints is None else hints.when)(hit, found)
    return rows.withColumns(
        {
            "case_type": F.lit("standard"),
            "question": question,
            "expected_points": hints,
            "expected_citations": F.array("label"),
            "expected_behavior": F.lit("answer"),
        }
    )


def trap_cases(regulations: DataFrame, tax: str = "tax_type", default_tax: str = "增值税") -> DataFrame:
    repealed = regulations.filter(F.col("effect_status").isin("repealed", "superseded"))
    return repealed.withColumns(
        {
            "case_type": F.lit("repealed_trap"),
            "question": _fill(TRAP_QUESTION, tax=F.coalesce(F.col(tax), F.lit(default_tax))),
            "forbidden_citations": F.array("label"),
            "expected_behavior": F.lit("answer"),
        }
    ).filter(F.col("label") != "")


def case_set(standard: DataFrame, trap: DataFrame, insufficient: DataFrame, order: str, target: int) -> DataFrame:
    """Shares per class, topped up with standard cases to the target."""
    columns = ["case_type", "question", order]
    take = {n: int(target * share) for n, share in SHARES.items()}
    ranked = standard.select(*columns).orderBy(order)
    fixed = (
        trap.select(*columns).orderBy(order).limit(take["repealed_trap"])
        .unionByName(insufficient.select(*columns).orderBy(order).limit(take["insufficient"]))
    )
    top_up = max(target - sum(take.values()), 0)
    return ranked.limit(take["standard"] + top_up).unionByName(fixed)


def import_cases(known: DataFrame, new: DataFrame) -> DataFrame:
    """Cases not known yet by (question, type), each once."""
    return new.dropDuplicates(["question", "case_type"]).join(
        known.select("question", "case_type"), ["question", "case_type"], "left_anti"
    )


def label_matches(expected: Column, label: Column) -> Column:
    """Containment after white space is removed; an empty expectation matches nothing."""
    left = T.without_space(expected)
    return (F.length(left) > 0) & T.without_space(label).contains(left)


def is_leak(identity: Column, forbidden: Column) -> Column:
    """By identity, never by substring: a valid decision may name the repealed text."""
    mine = T.without_space(F.coalesce(identity, F.lit("")))
    return (mine != "") & F.exists(forbidden, lambda f: T.without_space(f) == mine)


def evaluate_cases(cases: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """Judge all cases at once.

    cases: case_id, case_type, expected_citations, forbidden_citations, expected_points,
    template (of the answer); hits: case_id, rank, label, identity, content. Cases with
    nothing expected are ``undetermined`` and stay out of the rates.
    """
    found = hits.filter(F.col("rank") <= top).join(
        cases.select("case_id", "expected_citations", "forbidden_citations", "expected_points"), "case_id"
    )
    topic = F.exists("expected_points", lambda p: F.col("content").contains(p))
    exact = F.exists("expected_citations", lambda e: label_matches(e, F.col("label")))
    leak = is_leak(F.col("identity"), F.col("forbidden_citations"))
    per = found.groupBy("case_id").agg(
        F.min(F.when(topic, F.col("rank"))).alias("topic_rank"),
        F.min(F.when(exact, F.col("rank"))).alias("exact_rank"),
        F.count_if(leak).alias("leaks"),
    )
    rows = cases.join(per, "case_id", "left")
    kind = F.col("case_type")
    has_points, has_expected = F.size("expected_points") > 0, F.size("expected_citations") > 0
    hit_rank = F.when(has_points, F.when(F.col("topic_rank").isNotNull(), F.coalesce("exact_rank", "topic_rank"))).otherwise(
        F.col("exact_rank")
    )
    status = (
        F.when(kind == "repealed_trap", F.when(F.coalesce("leaks", F.lit(0)) > 0, "failed").otherwise("passed"))
        .when(kind == "insufficient", F.when(F.col("template") == "clarification", "passed").otherwise("failed"))
        .when(~has_points & ~has_expected, "undetermined")
        .otherwise(F.when(hit_rank.isNotNull(), "passed").otherwise("failed"))
    )
    judged = (kind == "standard") & (has_points | has_expected)
    return rows.withColumns(
        {
            "status": status,
            "recall": F.when(judged, hit_rank.isNotNull().cast("int")),
            "rr": F.when(judged, F.coalesce(F.lit(1.0) / hit_rank, F.lit(0.0))),
        }
    )


def metrics(results: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    judged = F.col("status") != "undetermined"
    return results.agg(
        F.count_if(judged).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.round(F.count_if(F.col("status") == "passed") / F.nullif(F.count_if(judged), F.lit(0)), 4).alias("pass_rate"),
        F.round(F.avg("recall"), 4).alias("recall_at_5"),
        F.round(F.avg("rr"), 4).alias("mrr_at_5"),
        F.count_if(failed & (F.col("case_type") == "repealed_trap")).alias("trap_leaks"),
        F.count_if(failed & (F.col("case_type") == "insufficient")).alias("hard_answers"),
        F.count_if(~judged).alias("undetermined"),
    )


def gate(run: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, veto: Sequence[str] = VETO) -> DataFrame:
    """Veto items are never averaged: one leak blocks. A null metric is skipped."""
    vetoes = F.array_compact(F.array(*[F.when(F.col(v) > 0, F.lit(v)) for v in veto]))
    reasons = F.array_compact(F.array(*[F.when(F.col(m) < t, F.lit(m)) for m, t in thresholds.items()]))
    return run.withColumns({"veto_items": vetoes, "reasons": reasons}).withColumn(
        "decision",
        F.when((F.size("veto_items") > 0) | (F.size("reasons") > 0), F.lit("blocked")).otherwise(F.lit("released")),
    )


def canary(ratio: Column, steps: Sequence[float] = CANARY_STEPS) -> Column:
    """Snap up to the next step of the ladder."""
    out = None
    for s in steps:
        out = (F.when if out is None else out.when)(ratio <= s, F.lit(s))
    return out.otherwise(F.lit(steps[-1]))


def rollback(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Mark decisions as rolled back; the row stays and gains the reason."""
    rows = decisions.join(requests.select("decision_id", F.col("reason").alias("_why")), "decision_id", "left")
    hit = F.col("_why").isNotNull()
    return rows.withColumns(
        {
            "rolled_back": hit,
            "decision": F.when(hit, F.lit("rolled_back")).otherwise(F.col("decision")),
            "reasons": F.when(hit, F.array_append("reasons", F.col("_why"))).otherwise(F.col("reasons")),
        }
    ).drop("_why")


def latest(rows: DataFrame, moment: str, by: str | None = None) -> DataFrame:
    packed = F.max_by(F.struct("*"), F.col(moment)).alias("_r")
    out = rows.groupBy(by).agg(packed) if by else rows.agg(packed)
    return out.select("_r.*")


def failed_first(results: DataFrame) -> list[Column]:
    """Order of the failure list: traps, then insufficient cases, then the rest."""
    return [lookup(F.col("case_type"), {"repealed_trap": 0, "insufficient": 1}, 9), F.col("case_id")]
