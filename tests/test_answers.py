"""Facts, applicability, verification, evaluation, planning, monitoring."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexframe.functions.facts import extract_facts
from lexframe.operators import evaluate as E
from lexframe.operators import evolve as Ev
from lexframe.operators import planning as P
from lexframe.operators import qa as Q
from lexframe.operators import verify as V
from lexframe.rules import planning as PR

D = dt.date
T = dt.datetime


def _facts(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id int, text string")
    return extract_facts(df).orderBy("question_id")


def test_facts(spark):
    rows = _facts(
        spark,
        "我们是一般纳税人，2026年8月销售货物不含税100万元，进项税额3万元，在市区",
        "我开了家小店，月销售额103万",
        "一般纳税人，员工50人，资产总额3000万元",
        "卖了 12 件",
        "",
    ).collect()
    a, b, c, d, e = rows
    assert (a.taxpayer_type, a.taxpayer_confirmed, a.amount, a.amount_includes_tax) == ("一般纳税人", True, Decimal("1000000.00"), False)
    assert (a.input_vat, a.period, a.period_scope, a.region, a.business_type) == (Decimal("30000.00"), "2026年8月", "month", "市区", "销售货物")
    assert a.missing == [] and a.questions == []
    assert (b.taxpayer_type, b.taxpayer_confirmed, b.taxpayer_stated, b.amount, b.amount_period) == ("个体工商户", False, False, Decimal("1030000.00"), "月")
    assert len(b.questions) == 2 and "taxpayer_confirm" in b.missing
    assert c.scale == {"从业人数": Decimal("50.00"), "资产总额": Decimal("30000000.00")}
    assert d.amount is None and d.business_type == "销售货物"
    assert e.taxpayer_type is None and len(e.questions) == 2
    assert {x["field"] for x in a.evidence} >= {"taxpayer_type", "amount", "period"}


def test_applicability_is_three_valued(spark):
    facts = _facts(spark, "小规模纳税人，销售货物，销售额8万元，增值税", "请问", "一般纳税人")
    clauses = spark.createDataFrame(
        [("小规模纳税人月销售额不超过10万元免征", ["增值税"]), ("由国务院规定", []), ("个体工商户适用", []), ("出口货物退税", []), ("从业人数不超过300人", [])],
        "content string, policy_tax_types array<string>",
    )
    pairs = facts.join(clauses, F.lit(True))
    got = {(r.question_id, r.content[:4]): r.verdict for r in Q.judge(pairs).collect()}
    assert got[(0, "小规模纳")] == "applicable"
    assert got[(1, "小规模纳")] == "need_confirm"
    assert got[(2, "小规模纳")] == "not_applicable"
    assert {got[(i, "由国务院")] for i in range(3)} == {"need_confirm"}
    assert got[(0, "个体工商")] == "need_confirm"
    assert got[(0, "出口货物")] == "not_applicable"
    assert got[(0, "从业人数")] == "need_confirm"


def test_answer_statuses(spark):
    facts = _facts(spark, "增值税怎么算", "税务局检查什么内容", "小规模纳税人的发票政策").withColumn("judgement", F.lit("结论"))
    lists = spark.createDataFrame(
        [(0, ["a"], [], []), (2, ["a"], ["b"], [])], "question_id int, applicable array<string>, need_confirm array<string>, not_applicable array<string>"
    )
    rows = {r.question_id: r for r in Q.assemble(facts, lists).collect()}
    assert [rows[i].status for i in range(3)] == ["clarify", "refuse", "answer"]
    assert rows[1].refusal_reason == "no_candidates"
    for r in rows.values():
        keys = [s["key"] for s in r.sections]
        assert keys[0] == "judgement" and keys[-1] == "disclaimer"


def test_citation_checks(spark):
    regs = spark.createDataFrame([(1, "财税1号", "甲办法"), (2, None, "乙法")], "regulation_id int, document_number string, regulation_title string")
    arts = spark.createDataFrame(
        [(1, "第一章 总则 第一条", "小规模纳税人适用简易计税"), (2, "第二条", "内容")], "regulation_id int, full_no string, content string"
    )
    rows = [
        (1, "财税1号", "", "第一条", None), (2, "财税9号", "甲办法", "第一条", None), (3, "财税1号", "", "第九条", None),
        (4, "", "乙法", "第二条", "完全不同的一段文字"), (5, "财税1号", "", "第一章 总则 第一条", "小规模纳税人适用简易计税方法"),
    ]
    cits = spark.createDataFrame(rows, "answer_id int, document_number string, regulation_title string, full_no string, content string")
    got = {(r.answer_id, r.code) for r in V.citation_issues(cits, regs, arts).collect()}
    assert got == {(2, "citation_document_not_found"), (3, "citation_article_not_found"), (4, "citation_content_mismatch")}


def test_temporal_checks(spark):
    rows = [
        ("repealed", None, None, "", "citation_not_citable"), ("not_yet_effective", None, None, "", "citation_not_yet_effective"),
        ("not_yet_effective", None, None, "本法将于明年施行", None), ("odd", None, None, "", "citation_unknown_effect_status"),
        ("effective", D(2025, 1, 1), None, "", "citation_before_effective"), ("effective", D(2020, 1, 1), D(2024, 6, 30), "", "citation_after_expiry"),
        ("effective", D(2020, 1, 1), None, "", None),
    ]
    df = spark.createDataFrame(rows, "s string, a date, b date, x string, want string")
    now = F.lit("2024-06-30").cast("date")
    got = df.select("want", V.temporal_code(F.col("s"), F.col("a"), F.col("b"), now, F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_repair_fixes_drops_and_degrades(spark):
    regs = spark.createDataFrame([(1, "财税1号", "甲")], "regulation_id int, document_number string, regulation_title string")
    arts = spark.createDataFrame([(1, "第一条", "x")], "regulation_id int, full_no string, content string")
    answers = spark.createDataFrame([(1, "好"), (2, "好"), (3, "保证可以"), (4, "好")], "answer_id int, text string").withColumn("disclaimer", F.lit("税务机关"))
    cits = spark.createDataFrame(
        [(1, 1, "财税1号", "", "第一条"), (2, 1, "财税9号", "", "第一条"), (2, 2, "财税1号", "", "第一条")],
        "answer_id int, citation_no int, document_number string, regulation_title string, full_no string",
    ).withColumn("content", F.lit(None).cast("string"))
    figures = spark.createDataFrame([(4, "vat", "应纳税额", "10.00")], "answer_id int, block string, title string, result string")
    truth = spark.createDataFrame([(4, "vat", "应纳税额", Decimal("12.00"))], "answer_id int, block string, title string, result decimal(18,2)")

    def verify(a, c, f):
        return V.all_issues(V.citation_issues(c, regs, arts), V.compliance_issues(a), V.calculation_issues(f, truth))

    def rebuild(a, c, f):
        return a.withColumn("text", F.concat(F.lit("新"), "text"))

    out = V.repair(answers, cits, figures, verify, rebuild)
    got = {r.answer_id: (r.outcome, r.retries) for r in out["outcome"].collect()}
    assert got == {1: ("passed", 0), 2: ("passed", 1), 3: ("degraded", 0), 4: ("fixed", 1)}
    assert {(r.answer_id, r.citation_no) for r in out["citations"].collect()} == {(1, 1), (2, 2)}
    assert out["figures"].first().result == "12.00"
    assert {r.answer_id: r.text for r in out["answers"].collect()} == {1: "好", 2: "新好", 3: "保证可以", 4: "好"}
    lost = out["degraded"].first()
    assert lost.answer_id == 3 and lost.basis == [] and len(lost.reasons) == 1
    plain = V.repair(answers, cits, figures, verify)
    assert {r.answer_id: r.outcome for r in plain["outcome"].collect()} == {1: "passed", 2: "degraded", 3: "degraded", 4: "fixed"}
    assert {r.answer_id: r.basis for r in plain["degraded"].collect()} == {2: ["财税9号", "财税1号"], 3: []}


def test_evaluation_and_gate(spark):
    schema = "case_id int, case_type string, expected_citations array<string>, forbidden_citations array<string>, expected_points array<string>, template string"
    cases = spark.createDataFrame(
        [(1, "standard", ["甲法 第一条"], [], [], "answer"), (2, "standard", [], [], ["税率"], "answer"), (3, "standard", [], [], [], "answer"),
         (4, "repealed_trap", [], ["旧法"], [], "answer"), (5, "repealed_trap", [], ["旧法"], [], "answer"), (6, "insufficient", [], [], [], "clarification"),
         (7, "standard", ["丙"], [], [], "answer")],
        schema,
    )
    hits = spark.createDataFrame(
        [(1, 1, "乙法", "乙法", "x"), (1, 2, "甲法 第一章 第一条", "甲法", "x"), (1, 3, "甲法第一条", "甲法", "x"), (2, 1, "甲", "甲", "适用税率"),
         (4, 1, "废止旧法的决定", "废止旧法的决定", "x"), (5, 2, "旧 法", "旧 法", "x"), (7, 6, "丙", "丙", "x")],
        "case_id int, rank int, label string, identity string, content string",
    )
    results = E.evaluate_cases(cases, hits)
    got = {r.case_id: (r.status, r.rr) for r in results.collect()}
    assert got == {1: ("passed", 1 / 3), 2: ("passed", 1.0), 3: ("undetermined", None), 4: ("passed", None), 5: ("failed", None),
                   6: ("passed", None), 7: ("failed", 0.0)}
    run = E.gate(E.metrics(results)).first()
    assert (run.total, run.trap_leaks, run.decision, run.veto_items) == (6, 1, "blocked", ["trap_leaks"])
    clean = E.gate(E.metrics(results.filter("case_id in (1, 2, 4, 6)"))).first()
    assert clean.decision == "released"
    short = E.gate(E.metrics(results.filter("case_id in (1, 7)"))).first()
    assert short.decision == "blocked" and short.veto_items == [] and "pass_rate" in short.reasons
    failed = results.filter("status = 'failed'").orderBy(*E.failed_first(results)).collect()
    assert [r.case_id for r in failed] == [5, 7]


def test_canary_and_rollback(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.3,), (2.0,)], "r double")
    assert [r[0] for r in df.select(E.canary(F.col("r"))).collect()] == [0.05, 0.05, 0.5, 1.0]
    rows = spark.createDataFrame([(1, "released", ["a"]), (2, "released", [])], "decision_id int, decision string, reasons array<string>")
    back = E.rollback(rows, spark.createDataFrame([(1, "bad")], "decision_id int, reason string")).orderBy("decision_id").collect()
    assert [(r.decision, r.reasons) for r in back] == [("rolled_back", ["a", "bad"]), ("released", [])]


def test_condition_operators(spark):
    df = spark.createDataFrame([("小规模纳税人", 100, {"x": True}, None)], "a string, n int, flexible map<string,boolean>, m int")
    cases = [
        (("a", "=", "小规模纳税人"), True), (("a", "in", ("x",)), False), (("n", "<=", 100), True), (("n", ">", 100), False),
        (("m", ">=", 1), None), (("gone", "=", 1), None), (("a", "like", "x"), None), (("flexible", "truthy", "x"), True),
        (("flexible.x", "truthy", True), True), (("flexible.y", "truthy", True), None), (("a", "!=", "y"), True), (("m", "exists", True), None),
        (("a", ">", 3), None),
    ]
    row = df.select(*[P.check(df, c).alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]
    extra = {**P.OPERATORS, "starts": lambda a, e: a.startswith(e)}
    assert df.select(P.check(df, ("a", "starts", "小"), extra)).first()[0] is True


def test_technique_rules_are_checked():
    with pytest.raises(PR.TechniqueError):
        PR.validate([{"code": "x"}])
    with pytest.raises(PR.TechniqueError):
        PR.validate([{**PR.TECHNIQUES[0], "risk_level": "blue"}])


def test_red_plans_never_reach_the_user(spark):
    df = spark.createDataFrame([("red",), ("yellow",), ("green",), ("odd",)], "risk_level string")
    rows = {r.risk_level: r for r in P.dispatch(df).collect()}
    assert not rows["red"].to_user and rows["red"].withheld and rows["red"].to_review
    assert rows["yellow"].to_user and rows["yellow"].to_review and rows["yellow"].prompt
    assert rows["green"].to_user and rows["green"].spot_check and not rows["green"].to_review
    assert not rows["odd"].to_user


def test_review_desk(spark):
    t = lambda h: T(2024, 1, 1) + dt.timedelta(hours=h)
    reviews = spark.createDataFrame(
        [(1, "pending", t(0), None), (2, "pending", t(0), None), (3, "approved", t(0), t(10)), (4, "rejected", t(0), t(30))],
        "id int, status string, created_at timestamp_ntz, decided_at timestamp_ntz",
    )
    batch = spark.createDataFrame(
        [(1, "reject", "r", "", t(1)), (2, "approve", "r", "", t(1)), (3, "approve", "r", "", t(1)), (9, "approve", "r", "", t(1))],
        "id int, action string, reviewer string, note string, decided_at timestamp_ntz",
    )
    done, refused = P.decide(reviews, batch)
    assert {r.id: r.status for r in done.collect()} == {1: "pending", 2: "approved", 3: "approved", 4: "rejected"}
    assert {r.id: r.refusal for r in refused.collect()} == {1: "note_missing", 3: "already_decided", 9: "no_such_review"}
    w = P.workload(reviews).first()
    assert (w.pending, w.decided, w.avg_hours, w.on_time_rate) == (2, 2, 20.0, 0.5)
    assert {r.id for r in P.overdue(reviews, F.lit(t(25)).cast("timestamp_ntz")).collect()} == {1, 2}


def test_health_and_digest(spark):
    regs = spark.createDataFrame(
        [(1, "effective", None, "u", D(2024, 1, 1)), (2, "repealed", D(2020, 1, 1), "", D(2020, 1, 1)), (3, "not_yet_effective", None, "u", D(2024, 1, 1))],
        "regulation_id int, effect_status string, expiry_date date, source_url string, updated_at date",
    )
    arts = spark.createDataFrame([(1,), (1,), (3,)], "regulation_id int")
    scored = Ev.health(regs, arts, F.lit("2024-06-30").cast("date"))
    assert {r.regulation_id: r.score for r in scored.collect()} == {1: 100.0, 2: 0.0, 3: 95.0}
    assert [r.regulation_id for r in Ev.review_queue(scored).collect()] == [2]


def test_gap_upsert_modes(spark):
    schema = "topic string, reason string, tax_type string, occurrences long, samples array<string>"
    known = spark.createDataFrame([("a", "r", None, 3, ["x"])], schema)
    new = spark.createDataFrame([("a", "r", "t", 2, ["x", "y"]), ("b", "r", None, 1, ["z"])], schema)
    rec = {r.topic: (r.occurrences, r.samples) for r in Ev.upsert_gaps(known, new, "record").collect()}
    per = {r.topic: r.occurrences for r in Ev.upsert_gaps(known, new, "persist").collect()}
    assert rec == {"a": (5, ["x", "y"]), "b": (1, ["z"])} and per == {"a": 2, "b": 1}
