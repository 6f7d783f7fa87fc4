"""Registered queries of planning and the review desk."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions.common import lookup
from lexframe.operators import planning as P
from lexframe.plans.base import Family
from lexframe.plans.bindings import table
from lexframe.plans.tax import pct_sql

family = Family()
query = family.query

# One profile per customer; the balance drives the figures.
PROFILE_SQL = """
p AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN '一般纳税人' WHEN 'BUILDING' THEN '小规模纳税人' WHEN 'AUTOMOBILE' THEN '小规模纳税人' END AS taxpayer,
  CASE c_nationkey % 4 WHEN 0 THEN '有限公司' WHEN 1 THEN '个体工商户' WHEN 2 THEN '合伙企业' END AS entity,
  CAST(round(c_acctbal * 100) AS HUGEINT) * 200 AS revenue, CASE WHEN c_custkey % 3 > 0 THEN CAST(round(c_acctbal * 100) AS HUGEINT) * 500 END AS income,
  c_custkey % 500 AS employees, CASE WHEN c_custkey % 7 = 0 THEN '制造业' END AS industry,
  CASE c_nationkey % 5 WHEN 0 THEN '自贸区' WHEN 1 THEN '市区' END AS region, c_custkey % 6 AS flex,
  CASE c_custkey % 5 WHEN 0 THEN '进取' WHEN 1 THEN '稳健' END AS risk, c_custkey % 11 > 0 AS authentic, c_custkey % 4 > 0 AS purpose FROM customer),
m AS (SELECT *, CASE WHEN taxpayer = '小规模纳税人' THEN true WHEN taxpayer IS NULL THEN NULL ELSE false END AS small,
  revenue <= 120000000 AS below, CASE WHEN entity IS NULL THEN NULL ELSE entity <> '个体工商户' END AS corp, income <= 300000000 AS inc3, employees <= 300 AS emp,
  CASE WHEN industry IS NULL THEN NULL ELSE true END AS ind, income > 0 AS pos, CASE WHEN flex = 0 THEN NULL ELSE flex > 1 END AS can, CASE WHEN region IS NULL THEN NULL ELSE region = '自贸区' END AS zone FROM p),
t AS (SELECT id, 'vat_small_scale_threshold' AS code, small AND below AS matched FROM m
  UNION ALL SELECT id, 'cit_small_low_profit', corp AND inc3 AND emp AND NULL::BOOLEAN FROM m
  UNION ALL SELECT id, 'rd_super_deduction', ind AND pos FROM m
  UNION ALL SELECT id, 'surcharge_half_small_business', small FROM m
  UNION ALL SELECT id, 'entity_form_selection', can FROM m UNION ALL SELECT id, 'revenue_timing', can FROM m
  UNION ALL SELECT id, 'equipment_one_off_deduction', ind FROM m UNION ALL SELECT id, 'regional_preference', zone FROM m)"""


def profiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    key = F.col("c_custkey")
    flex = key % 6
    return c.select(
        key.alias("id"),
        lookup(F.col("c_mktsegment"), {"MACHINERY": "一般纳税人", "BUILDING": "小规模纳税人", "AUTOMOBILE": "小规模纳税人"}).alias("taxpayer_type"),
        lookup(F.col("c_nationkey") % 4, {0: "有限公司", 1: "个体工商户", 2: "合伙企业"}).alias("entity_type"),
        M.from_cents(cents * 200).alias("annual_revenue"),
        F.when(key % 3 > 0, M.from_cents(cents * 500)).alias("taxable_income"),
        (key % 500).cast("int").alias("employees"),
        F.when(key % 7 == 0, "制造业").alias("industry"),
        lookup(F.col("c_nationkey") % 5, {0: "自贸区", 1: "市区"}).alias("region"),
        F.when(flex == 1, F.create_map().cast("map<string,boolean>"))
        .when(flex > 1, F.create_map(F.lit("can_change_timing"), F.lit(True)))
        .alias("flexible"),
        lookup(key % 5, {0: "进取", 1: "稳健"}).alias("risk_preference"),
        (key % 11 > 0).alias("business_authentic"),
        F.when(key % 4 > 0, "扩大产能").alias("business_purpose"),
        F.lit("成本下降").alias("business_benefit"),
        F.array(F.lit("合同")).alias("evidence_available"),
        F.lit("销售货物").alias("main_income_source"),
        F.lit("2024-06-30").cast("date").alias("as_of"),
    )


@query(f"WITH {PROFILE_SQL} SELECT id, code, matched FROM t")
def technique_match(spark, sf_dir):
    return P.match_techniques(profiles(spark, sf_dir)).select("id", "code", "matched")


@query("""
SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_nationkey % 4 = 3 THEN 'entity_type' END,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'taxpayer_type' END, 'goal', CASE WHEN c_custkey % 5 > 1 THEN 'risk_preference' END,
  CASE WHEN c_custkey % 6 <= 1 THEN 'flexible' END, CASE WHEN c_custkey % 11 = 0 THEN 'business_authentic' END) AS missing,
  CASE WHEN c_custkey % 3 > 0 AND c_acctbal < 0 THEN 'taxable_income: negative' ELSE '' END AS problems FROM customer
""")
def profile_check(spark, sf_dir):
    rows = P.validate_profile(profiles(spark, sf_dir))
    return rows.select(
        "id", F.array_join("missing", ",").alias("missing"), F.array_join("problems", ",").alias("problems")
    )


PLAN_SQL = f"""
WITH {PROFILE_SQL},
vat AS (SELECT *, CASE WHEN taxpayer = '一般纳税人' THEN greatest({pct_sql('greatest(revenue, 0)', '1300')}, 0)
  WHEN taxpayer = '小规模纳税人' THEN CASE WHEN revenue <= 10000000 THEN 0 WHEN revenue > 30000000 THEN {pct_sql('greatest(revenue, 0)', '100')} END END AS vat FROM m),
s AS (SELECT *, CASE WHEN vat > 0 THEN {pct_sql('vat', "(CASE WHEN region = '市区' THEN 700 ELSE 100 END)")} END AS u,
  CASE WHEN vat > 0 THEN {pct_sql('vat', '300')} END AS e, CASE WHEN vat > 0 THEN {pct_sql('vat', '200')} END AS l,
  CASE WHEN income > 0 THEN {pct_sql('income', '2500')} WHEN income <= 0 THEN 0 END AS cit,
  CASE WHEN income > 0 THEN {pct_sql(pct_sql('income', '2500'), '2000')} WHEN income <= 0 THEN 0 END AS cit2 FROM vat),
saving AS (SELECT t.id, t.code, t.matched, CASE code WHEN 'vat_small_scale_threshold' THEN coalesce(vat, 0)
  WHEN 'surcharge_half_small_business' THEN u + e + l - (u + 1) // 2 - (e + 1) // 2 - (l + 1) // 2
  WHEN 'cit_small_low_profit' THEN cit - cit2 END AS saving FROM t JOIN s ON s.id = t.id WHERE matched IS NULL OR matched)
"""


@query(f"""{PLAN_SQL}
SELECT id, code, CAST(saving AS BIGINT) AS saving_cents, saving IS NOT NULL AS computable,
  CASE WHEN code IN ('entity_form_selection', 'equipment_one_off_deduction', 'regional_preference') THEN 'B' WHEN code = 'revenue_timing' THEN 'C' ELSE 'A' END AS path,
  CASE WHEN matched IS NULL THEN 'fill_gaps_first' WHEN code = 'rd_super_deduction' THEN 'mind_the_cost' WHEN code IN ('entity_form_selection', 'revenue_timing') THEN 'ask_authority'
    WHEN code = 'regional_preference' THEN 'review_only' ELSE 'do_first' END AS advice FROM saving""")
def plan_compare(spark, sf_dir):
    """Candidate plans of every profile with saving and advice."""
    plans = P.comparison(P.candidate_plans(profiles(spark, sf_dir)))
    return plans.select(
        "id", "code", (F.col("saving") * 100).cast("bigint").alias("saving_cents"), "computable", "path", "advice"
    )


@query(f"""WITH {PROFILE_SQL}
SELECT id, concat_ws(',', CASE WHEN bool_or(code IN ('vat_small_scale_threshold', 'cit_small_low_profit', 'rd_super_deduction', 'surcharge_half_small_business'))
    AND bool_or(code = 'revenue_timing') THEN 'policy_with_timing' END, CASE WHEN bool_or(code = 'entity_form_selection') THEN 'structure_last' END,
  CASE WHEN bool_or(code = 'regional_preference') THEN 'region_with_structure' END, 'authority_decides') AS notes
FROM t WHERE matched IS NULL OR matched GROUP BY id""")
def plan_combinations(spark, sf_dir):
    rows = P.match_techniques(profiles(spark, sf_dir)).filter(F.col("matched").isNull() | F.col("matched"))
    return P.combination_notes(rows, "id").select("id", F.array_join("notes", ",").alias("notes"))


@query(f"""WITH {PROFILE_SQL}
SELECT id, code, code <> 'regional_preference' AS to_user, code IN ('regional_preference', 'entity_form_selection', 'revenue_timing') AS to_review,
  code NOT IN ('regional_preference', 'entity_form_selection', 'revenue_timing') AS spot_check, code IN ('entity_form_selection', 'revenue_timing') AS prompted
FROM t WHERE matched IS NULL OR matched""")
def plan_dispatch(spark, sf_dir):
    rows = P.match_techniques(profiles(spark, sf_dir)).filter(F.col("matched").isNull() | F.col("matched"))
    out = P.dispatch(rows)
    return out.select("id", "code", "to_user", "to_review", "spot_check", F.col("prompt").isNotNull().alias("prompted"))


@query(f"""WITH {PROFILE_SQL}
SELECT id, CASE WHEN id % 13 = 0 OR NOT authentic THEN 'red' WHEN NOT purpose OR coalesce(risk = '进取', false) THEN 'yellow' ELSE 'green' END AS grade,
  id % 13 <> 0 AS red_line_ok, purpose AS anti_avoidance_ok, authentic AS substance_ok FROM p""")
def plan_legality(spark, sf_dir):
    rows = profiles(spark, sf_dir).withColumns(
        {
            "citations": F.array(F.lit("中华人民共和国企业所得税法 第四条")),
            "request": F.when(F.col("id") % 13 == 0, "想买票冲成本").otherwise("想用足优惠"),
        }
    )
    return P.legality(rows, "request").select("id", "grade", "red_line_ok", "anti_avoidance_ok", "substance_ok")


# ---- review desk: orders as reviews, the last ship date as the decision


def reviews(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("decided_at"))
    rows = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("decided_at")).alias("decided_at"),
        lookup(F.col("o_orderstatus"), {"P": "pending", "O": "approved_with_changes", "F": "rejected"}).alias("status"),
    )


REVIEW_SQL = """
r AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN (SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o_orderkey) END AS decided_at,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'approved_with_changes' ELSE 'rejected' END AS status FROM orders)"""


@query(f"""WITH {REVIEW_SQL}
SELECT count(*) FILTER (status = 'pending') AS pending, count(decided_at) AS decided, round(avg(date_diff('hour', created_at, decided_at)), 2) AS avg_hours,
  round(count(*) FILTER (date_diff('hour', created_at, decided_at) <= 2400) / count(decided_at), 3) AS on_time_rate FROM r""")
def review_workload(spark, sf_dir):
    return P.workload(reviews(spark, sf_dir), sla_hours=2400)


@query(f"""WITH {REVIEW_SQL}
SELECT id, 'downgraded' AS mark FROM r WHERE status = 'pending' AND date_diff('hour', created_at, TIMESTAMP '2000-01-01') > 24""")
def overdue(spark, sf_dir):
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    return P.overdue(reviews(spark, sf_dir), now).select("id", "mark")


@query(f"""WITH {REVIEW_SQL},
d AS (SELECT id, CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'postpone' ELSE 'approve_with_changes' END AS action, id % 8 = 1 AS noted FROM r)
SELECT r.id, CASE WHEN r.status <> 'pending' THEN r.status WHEN action = 'approve' THEN 'approved' WHEN action = 'approve_with_changes' THEN 'approved_with_changes'
    WHEN action = 'reject' AND noted THEN 'rejected' ELSE 'pending' END AS status,
  CASE WHEN action = 'postpone' THEN 'unknown_action' WHEN r.status <> 'pending' THEN 'already_decided' WHEN action = 'reject' AND NOT noted THEN 'note_missing' END AS refusal
FROM r JOIN d ON d.id = r.id""")
def plan_review_batch(spark, sf_dir):
    """A decision for every review; refused ones are reported with the reason."""
    rows = reviews(spark, sf_dir)
    decisions = rows.select(
        "id",
        lookup(F.col("id") % 4, {0: "approve", 1: "reject", 2: "postpone", 3: "approve_with_changes"}).alias("action"),
        F.lit("r1").alias("reviewer"),
        F.when(F.col("id") % 8 == 1, "不符合").otherwise("").alias("note"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("decided_at"),
    )
    done, refused = P.decide(rows, decisions)
    return done.select("id", "status").join(refused.select("id", "refusal"), "id", "left")


@query(f"""WITH {REVIEW_SQL}
SELECT id, CASE status WHEN 'rejected' THEN 'negative_case' ELSE 'calibration' END AS suggested_use FROM r WHERE status IN ('rejected', 'approved_with_changes')""")
def review_feedback(spark, sf_dir):
    return P.feedback(reviews(spark, sf_dir)).select("id", "suggested_use")
