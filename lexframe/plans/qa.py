"""Registered queries of the question family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import lookup
from lexframe.functions.facts import extract_facts
from lexframe.operators import qa as Q
from lexframe.plans.base import Family
from lexframe.plans.bindings import (
    NOTICE_SQL,
    QUESTION_SQL,
    notice_blocks,
    notices,
    question_facts,
    questions,
    table,
)
from lexframe.session import cut_lineage

family = Family()
query = family.query

FACT_SQL = f"""
SELECT question_id, CASE segment WHEN 'MACHINERY' THEN '一般纳税人' WHEN 'BUILDING' THEN '个体工商户' WHEN 'AUTOMOBILE' THEN '小规模纳税人'
    WHEN 'HOUSEHOLD' THEN '小型微利企业' ELSE CASE WHEN cust % 4 = 2 THEN '企业' END END AS taxpayer_type,
  segment IN ('MACHINERY', 'AUTOMOBILE') AS taxpayer_confirmed,
  segment IN ('MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD') AS taxpayer_stated,
  CASE WHEN priority = '1-URGENT' THEN hundreds * 1000000 WHEN priority <> '5-LOW' THEN hundreds * 100 END AS amount_cents,
  CASE WHEN priority <> '5-LOW' THEN CASE status WHEN 'F' THEN false WHEN 'O' THEN true END END AS amount_includes_tax,
  y || '年' || m || '月' AS period, 'month' AS period_scope, CASE WHEN nation % 5 = 4 THEN '市区' END AS region,
  CASE nation % 5 WHEN 0 THEN '销售货物' WHEN 1 THEN '现代服务' WHEN 2 THEN '不动产租赁服务' WHEN 3 THEN '交通运输服务' END AS business_type,
  CASE cust % 4 WHEN 0 THEN '增值税' WHEN 2 THEN '企业所得税' ELSE '' END AS tax_types, status, cust, k, priority
FROM ({QUESTION_SQL}) q
"""


@query(f"""
SELECT question_id, taxpayer_type, taxpayer_confirmed, taxpayer_stated, amount_cents, amount_includes_tax, period, period_scope,
  region, business_type, tax_types FROM ({FACT_SQL}) f
""")
def fact_extract(spark, sf_dir):
    facts = extract_facts(questions(spark, sf_dir))
    return facts.select(
        "question_id",
        "taxpayer_type",
        "taxpayer_confirmed",
        "taxpayer_stated",
        (F.col("amount") * 100).cast("bigint").alias("amount_cents"),
        "amount_includes_tax",
        "period",
        "period_scope",
        "region",
        "business_type",
        F.array_join("tax_types", ",").alias("tax_types"),
    )


@query(f"""
SELECT question_id, concat_ws(',', CASE WHEN taxpayer_type IS NULL THEN 'taxpayer' WHEN NOT taxpayer_confirmed THEN 'taxpayer_confirm' END,
  CASE WHEN business_type IS NULL THEN 'business' END, CASE WHEN amount_cents IS NULL THEN 'amount'
    WHEN amount_includes_tax IS NULL THEN 'amount_basis' END) AS missing,
  least(2, CASE WHEN taxpayer_type IS NULL OR NOT taxpayer_confirmed THEN 1 ELSE 0 END + CASE WHEN business_type IS NULL THEN 1 ELSE 0 END
   + CASE WHEN amount_cents IS NULL OR amount_includes_tax IS NULL THEN 1 ELSE 0 END)::INTEGER AS questions
FROM ({FACT_SQL}) f
""")
def missing_questions(spark, sf_dir):
    facts = question_facts(spark, sf_dir)
    return facts.select(
        "question_id",
        F.array_join("missing", ",").alias("missing"),
        F.size("questions").alias("questions"),
    )


# Sentences that the candidate clauses add to the notice of the same order.
EXTRA = {"F": "小规模纳税人适用。", "O": "个体工商户销售货物适用。"}


def _judged(spark, sf_dir):
    facts = question_facts(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.coalesce(lookup(F.col("o_orderstatus"), EXTRA), F.lit("")).alias("extra"),
    )
    clauses = (
        notices(spark, sf_dir)
        .join(orders, "doc_id")
        .select(
            F.col("doc_id").alias("question_id"),
            F.concat_ws("\n", "text", "extra").alias("content"),
            F.array(F.lit("增值税")).alias("policy_tax_types"),
            F.lit(1).alias("rank"),
            F.concat(F.lit("notice-"), "doc_id").alias("citation"),
        )
    )
    return Q.judge(facts.join(clauses, "question_id"))


VERDICT_SQL = f"""
checks AS (SELECT f.*, n.amount AS lim,
  CASE WHEN f.status = 'F' THEN CASE WHEN taxpayer_type IN ('小规模纳税人') THEN 1 WHEN taxpayer_type = '一般纳税人' THEN 0 ELSE 2 END
       WHEN f.status = 'O' THEN CASE WHEN taxpayer_type = '个体工商户' THEN 1 WHEN taxpayer_type IN ('小型微利企业', '企业') THEN 0 ELSE 2 END ELSE 1 END AS subject,
  CASE WHEN f.status = 'O' THEN CASE WHEN business_type IS NULL THEN 2 WHEN business_type = '销售货物' THEN 1 ELSE 0 END ELSE 1 END AS business,
  CASE WHEN amount_cents IS NULL THEN 2 WHEN amount_cents <= CAST(n.amount AS BIGINT) * 100 THEN 1 ELSE 0 END AS money,
  CASE tax_types WHEN '企业所得税' THEN 0 ELSE 1 END AS tax
  FROM ({FACT_SQL}) f JOIN ({NOTICE_SQL}) n ON n.doc_id = f.question_id),
verdicts AS (SELECT *, CASE WHEN 0 IN (subject, business, money, tax) THEN 'not_applicable'
  WHEN 2 IN (subject, business, money, tax) THEN 'need_confirm' ELSE 'applicable' END AS verdict FROM checks)"""


@query(f"WITH {VERDICT_SQL} SELECT question_id, verdict FROM verdicts")
def applicability(spark, sf_dir):
    return _judged(spark, sf_dir).select("question_id", "verdict")


@query(f"""
WITH {VERDICT_SQL},
i AS (SELECT *, CASE cust % 4 WHEN 0 THEN 'calculation' WHEN 1 THEN 'policy_query' WHEN 2 THEN 'how_to' ELSE 'inspection' END AS intent,
  (taxpayer_type IS NULL OR NOT taxpayer_confirmed OR business_type IS NULL OR amount_cents IS NULL OR amount_includes_tax IS NULL) AS open,
  taxpayer_type IS NULL OR taxpayer_type = '企业' AS impersonal FROM verdicts)
SELECT question_id, intent, CASE WHEN open AND (intent IN ('calculation', 'how_to') OR NOT impersonal OR (taxpayer_type IS NULL AND intent = 'policy_query'))
    THEN 'clarify' WHEN verdict = 'not_applicable' THEN 'refuse' ELSE 'answer' END AS status FROM i
""")
def answer_table(spark, sf_dir):
    """Clarify, refuse or answer for every question, with its sections."""
    # Written once: the lists and the point would each join and judge the texts again.
    judged = _judged(spark, sf_dir).select(
        "question_id", "citation", "rank", "verdict", T.best_sentence(F.col("content")).alias("sentence")
    )
    judged = cut_lineage(judged, "judged")
    lists = Q.three_lists(judged)
    asked = question_facts(spark, sf_dir)
    point = judged.groupBy("question_id").agg(F.min_by("sentence", "rank").alias("judgement"))
    answers = Q.assemble(asked.join(point, "question_id", "left"), lists)
    return answers.select("question_id", "intent", "status")


@query(f"""
WITH cited AS (SELECT l_orderkey AS q, l_suppkey AS r, l_partkey AS a, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2, 3),
articles AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS a, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 30),
regs AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY min(rank), r) AS reg_no FROM cited GROUP BY q, r),
pairs AS (SELECT g.q, g.r, x.a, g.reg_no, row_number() OVER (PARTITION BY g.q, g.r ORDER BY x.a) AS n FROM regs g
  JOIN articles x ON x.r = g.r WHERE g.reg_no <= 3 AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.q = g.q AND c.r = g.r AND c.a = x.a))
SELECT * FROM (SELECT q AS question_id, r AS regulation_id, a AS article_id,
  row_number() OVER (PARTITION BY q ORDER BY reg_no, a) AS position FROM pairs WHERE n <= 3) s WHERE position <= 5
""")
def sibling_expansion(spark, sf_dir):
    """Orders as questions, suppliers as regulations, their parts as articles."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    cited = lines.groupBy(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_suppkey").alias("regulation_id"),
        F.col("l_partkey").alias("article_id"),
    ).agg(F.min("l_linenumber").alias("rank"))
    articles = (
        lines.select("l_suppkey", "l_partkey")
        .distinct()
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_suppkey").alias("regulation_id"),
            F.col("l_partkey").alias("article_id"),
            F.col("l_partkey").alias("order_index"),
            F.col("p_name").alias("content"),
            "p_size",
        )
    )
    return Q.sibling_clauses(cited, articles, substantive=F.col("p_size") >= 30)


@query(f"""
SELECT doc_id AS regulation_id, '第一章 总则 第二条' AS full_no, '适用于客户' || cust || '的增值税业务，详见附件' || m || '。 销售额不超过' || amount
  || '元的，减按' || rate || '%征收； 按月申报； 按季申报。' AS content FROM ({NOTICE_SQL}) n
UNION ALL
SELECT doc_id, '第一章 总则 第二条 （一）', '销售额不超过' || amount || '元的，减按' || rate || '%征收； 按月申报； 按季申报。' FROM ({NOTICE_SQL}) n
""")
def short_clause_children(spark, sf_dir):
    blocks = notice_blocks(spark, sf_dir).filter(
        F.col("level_code").isin("article", "paragraph", "item")
    )
    return Q.with_children(
        blocks.withColumnRenamed("doc_id", "regulation_id"), min_chars=60
    )
