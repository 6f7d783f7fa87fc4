"""Registered queries of the verification and evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import money as M
from lexframe.functions import text as T
from lexframe.functions import vectors as V
from lexframe.functions.common import lookup
from lexframe.operators import evaluate as E
from lexframe.operators import tax as X
from lexframe.operators import verify as Vf
from lexframe.operators.matching import passages_in_texts
from lexframe.plans.base import Family
from lexframe.plans.bindings import (
    NOTICE_SQL,
    REGULATION_SQL,
    notice_blocks,
    notice_headers,
    notices,
    regulations,
    table,
)
from lexframe.plans.retrieval import DOT_SQL
from lexframe.plans.text import NUMBER_SQL
from lexframe.session import cut_lineage

family = Family()
query = family.query

FULL_NO = {1: "第一条", 2: "第一章 总则 第二条", 3: "第二条（一）", 4: "第三条", 5: "第四条", 6: "第九条", 7: "第五条"}
OFF_TOPIC = "毫不相干的一段文字。"


def _library(spark, sf_dir):
    """The notices as regulations and articles."""
    regs = notice_headers(spark, sf_dir).select(
        F.col("doc_id").alias("regulation_id"), "document_number", F.col("title").alias("regulation_title")
    )
    blocks = notice_blocks(spark, sf_dir)
    return regs, blocks.select(F.col("doc_id").alias("regulation_id"), "full_no", "content")


def _citations(spark, sf_dir):
    """Each order line cites its order's notice; returned lines cite a wrong number."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.year("o_orderdate")
    wrong = F.when(F.col("l_returnflag") == "R", "X").otherwise("")
    number = F.when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("财税〔"), year, F.lit("〕"), F.col("l_orderkey"), F.lit("号"), wrong)
    ).when(
        F.col("o_orderstatus") == "F",
        F.concat(F.lit("财政部 税务总局公告"), year, F.lit("年第"), F.col("l_orderkey"), F.lit("号"), wrong),
    )
    title = F.concat(F.lit("关于"), F.col("o_orderpriority"), F.lit("订单管理办法"), wrong)
    real = F.concat(
        F.lit("适用于客户"), F.col("o_custkey"), F.lit("的增值税业务，详见附件"), F.month("o_orderdate"), F.lit("。")
    )
    return rows.select(
        F.col("l_orderkey").alias("answer_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("citation_no"),
        number.alias("document_number"),
        title.alias("regulation_title"),
        F.coalesce(lookup(F.col("l_linenumber"), FULL_NO), F.lit("")).alias("full_no"),
        F.when(
            F.col("l_linenumber") == 2, F.when(F.col("l_quantity") > 25, real).otherwise(F.lit(OFF_TOPIC))
        ).alias("content"),
    )


CITED_SQL = f"""
cited AS (SELECT l.*, coalesce({NUMBER_SQL}, '关于' || priority || '订单管理办法') || CASE WHEN l_returnflag = 'R' THEN 'X' ELSE '' END AS label,
  CASE l_linenumber WHEN 1 THEN '第一条' WHEN 2 THEN '第一章 总则 第二条' WHEN 3 THEN '第二条（一）' WHEN 4 THEN '第三条' WHEN 5 THEN '第四条'
    WHEN 6 THEN '第九条' WHEN 7 THEN '第五条' ELSE '' END AS full_no
  FROM lineitem l JOIN ({NOTICE_SQL}) n ON n.doc_id = l.l_orderkey),
citation_issue AS (
  SELECT l_orderkey AS answer_id, 'citation_document_not_found' AS code, label AS target FROM cited WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, 'citation_article_not_found', label || ' ' || full_no FROM cited WHERE l_returnflag <> 'R' AND l_linenumber IN (6, 7)
  UNION ALL SELECT DISTINCT l_orderkey, 'citation_content_mismatch', label || ' ' || full_no FROM cited
    WHERE l_returnflag <> 'R' AND l_linenumber = 2 AND l_quantity <= 25)"""


@query(f"WITH {CITED_SQL} SELECT answer_id, code, target FROM citation_issue")
def citation_verify(spark, sf_dir):
    regs, articles = _library(spark, sf_dir)
    issues = Vf.citation_issues(_citations(spark, sf_dir), regs, articles)
    return issues.select("answer_id", "code", "target")


def _answers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("answer_id"),
        F.when(F.col("o_custkey") % 2 == 0, "本办法将于明年施行。").otherwise("按规定办理。").alias("text"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 1500).cast("int")).alias("as_of"),
        F.when(F.col("o_custkey") % 50 == 0, F.lit("保证可以通过")).otherwise("照章办理").alias("wording"),
        F.lit("以主管税务机关认定为准").alias("disclaimer"),
    )


def _dated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = lookup(
        F.col("o_orderpriority"), {"1-URGENT": "repealed", "2-HIGH": "not_yet_effective", "3-MEDIUM": "unknown"}, "effective"
    )
    return orders.select(
        F.col("o_orderkey").alias("answer_id"),
        F.col("o_orderkey").cast("string").alias("document_number"),
        F.lit("").alias("regulation_title"),
        F.when(F.col("o_orderstatus") == "P", status).otherwise("effective").alias("effect_status"),
        F.date_add(F.to_date("o_orderdate"), 100).alias("valid_from"),
        F.date_add(F.to_date("o_orderdate"), 1100).alias("valid_to"),
    )


TEMPORAL_SQL = """
temporal_issue AS (SELECT * FROM (SELECT o_orderkey AS answer_id, CASE
  WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'citation_not_citable'
  WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN CASE WHEN o_custkey % 2 = 1 THEN 'citation_not_yet_effective' END
  WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'citation_unknown_effect_status'
  WHEN o_custkey % 1500 < 100 THEN 'citation_before_effective' WHEN o_custkey % 1500 >= 1100 THEN 'citation_after_expiry' END AS code,
  CAST(o_orderkey AS VARCHAR) AS target FROM orders) t WHERE code IS NOT NULL)"""


@query(f"WITH {TEMPORAL_SQL} SELECT answer_id, code, target FROM temporal_issue")
def temporal_verify(spark, sf_dir):
    issues = Vf.temporal_issues(_dated(spark, sf_dir), _answers(spark, sf_dir))
    return issues.select("answer_id", "code", "target")


def _figures(spark, sf_dir):
    """Income tax of each customer as stated and as recomputed."""
    rows = X.income_tax(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("answer_id"),
            M.from_cents(F.round(F.col("c_acctbal") * 100).cast("bigint") * 100).alias("taxable_income"),
            F.lit(False).alias("small_low_profit"),
            "c_nationkey",
        )
    ).withColumns({"block": F.lit("cit"), "title": F.lit("应纳税额")})
    expected = rows.select("answer_id", "block", "title", F.col("cit_payable").alias("result"))
    n = F.col("c_nationkey") % 5
    stated = rows.select(
        "answer_id",
        "block",
        "title",
        F.when(n == 0, (F.col("cit_payable") + F.lit(1)).cast(M.MONEY).cast("string"))
        .when(n == 1, F.lit("n/a"))
        .otherwise(F.col("cit_payable").cast("string"))
        .alias("result"),
    )
    return stated, expected


@query("""
WITH c AS (SELECT c_custkey, c_nationkey % 5 AS n, CAST(round(c_acctbal * 100) AS HUGEINT) * 100 AS i FROM customer),
p AS (SELECT *, CASE WHEN i <= 0 THEN 0 ELSE (i * 2500 * 2 + 10000) // 20000 END AS cents FROM c)
SELECT c_custkey AS answer_id, CASE n WHEN 0 THEN 'calculation_mismatch' ELSE 'calculation_value_missing' END AS code,
  CASE n WHEN 0 THEN 'fixable' ELSE 'blocking' END AS severity,
  CASE n WHEN 0 THEN CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS fix
FROM p WHERE n IN (0, 1)
""")
def recompute_compare(spark, sf_dir):
    stated, expected = _figures(spark, sf_dir)
    return Vf.calculation_issues(stated, expected).select("answer_id", "code", "severity", "fix")


@query(f"""
WITH {CITED_SQL}, {TEMPORAL_SQL},
u AS (SELECT answer_id, code FROM citation_issue UNION ALL SELECT answer_id, code FROM temporal_issue),
s AS (SELECT answer_id, string_agg(DISTINCT code, ',' ORDER BY code) AS issue_codes, count(*) AS blocking FROM u GROUP BY answer_id)
SELECT o_orderkey AS answer_id, coalesce(issue_codes, '') AS issue_codes, coalesce(blocking, 0) AS blocking, blocking IS NULL AS passed
FROM orders LEFT JOIN s ON s.answer_id = o_orderkey
""")
def issue_summary(spark, sf_dir):
    regs, articles = _library(spark, sf_dir)
    answers = _answers(spark, sf_dir)
    issues = Vf.all_issues(
        Vf.citation_issues(_citations(spark, sf_dir), regs, articles),
        Vf.temporal_issues(_dated(spark, sf_dir), answers),
    )
    rows = Vf.summarise(answers, issues)
    return rows.select("answer_id", F.array_join("issue_codes", ",").alias("issue_codes"), "blocking", "passed")


@query(f"""
WITH {TEMPORAL_SQL}, c AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey % 50 = 0)
SELECT 'temporal' AS verifier, count(*) AS blocked_answers, round(count(*) / (SELECT count(*) FROM orders), 4) AS interception_rate FROM temporal_issue
UNION ALL SELECT 'compliance', count(*), round(count(*) / (SELECT count(*) FROM orders), 4) FROM c
""")
def interception_rates(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    issues = Vf.all_issues(
        Vf.temporal_issues(_dated(spark, sf_dir), answers),
        Vf.compliance_issues(answers, "wording", "disclaimer"),
    )
    return Vf.interception(answers, issues)


STATED_SQL = """
stated AS (SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 7 = 0 THEN 'off' WHEN o_orderkey % 31 = 0 THEN 'none' END AS fault FROM orders)"""


def _stated(spark, sf_dir):
    """A figure of each order as an answer states it, wrong in some and no number in some, and as recomputed."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("answer_id"), F.lit("vat").alias("block"), F.lit("应纳税额").alias("title"), F.col("o_totalprice").cast(M.MONEY).alias("result")
    )
    key = F.col("answer_id")
    text = F.when(key % 7 == 0, (F.col("result") + F.lit(1)).cast(M.MONEY).cast("string")).when(key % 31 == 0, "n/a")
    return rows.withColumn("result", F.coalesce(text, F.col("result").cast("string"))), rows


def _repaired(spark, sf_dir):
    regs, articles = _library(spark, sf_dir)
    answers = _answers(spark, sf_dir).withColumn("cited", F.lit(-1).cast("long"))
    stated, expected = _stated(spark, sf_dir)
    # What no pass changes is worked out once for all passes.
    large = cut_lineage(Vf.large_regulations(articles), "large")
    numbers = cut_lineage(Vf.article_numbers(articles, large), "numbers")
    citations = Vf.resolve_citations(_citations(spark, sf_dir), regs)

    known = {}

    def verify(a, c, f):
        # The first pass has all citations that later ones have.
        if not known:
            known["texts"] = cut_lineage(Vf.quoted_articles(c, articles), "quoted")
        cited = Vf.citation_issues(c, regs, articles, large, numbers, known["texts"])
        return Vf.all_issues(cited, Vf.compliance_issues(a, "wording", "disclaimer"), Vf.calculation_issues(f, expected))

    def rebuild(a, c, f):
        """An answer that lost a citation names those left, and is made without over-reaching words for every third customer."""
        left = c.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_left"))
        soft = F.when(F.col("answer_id") % 3 == 0, F.lit("照章办理")).otherwise(F.col("wording"))
        rows = a.join(left, "answer_id", "left").withColumns({"cited": F.coalesce("_left", F.lit(0)), "wording": soft})
        return rows.drop("_left")

    return Vf.repair(answers, citations, stated, verify, rebuild), answers


# An answer blocked by a citation is rebuilt once without it; what still blocks afterwards degrades it.
REPAIR_SQL = f"""
{CITED_SQL}, {STATED_SQL},
a AS (SELECT o_orderkey AS answer_id, o_custkey % 50 = 0 AS over, b.answer_id IS NOT NULL AS bad, fault
  FROM orders JOIN stated s ON s.answer_id = o_orderkey LEFT JOIN (SELECT DISTINCT answer_id FROM citation_issue) b ON b.answer_id = o_orderkey),
s AS (SELECT *, over AND (NOT bad OR answer_id % 3 <> 0) OR coalesce(fault = 'none', false) AS lost FROM a)"""


@query(f"""
WITH {REPAIR_SQL}
SELECT answer_id, CASE WHEN lost THEN 'degraded' WHEN fault = 'off' THEN 'fixed' ELSE 'passed' END AS outcome,
  CASE WHEN bad THEN 1 ELSE 0 END + CASE WHEN NOT lost AND fault = 'off' THEN 1 ELSE 0 END AS retries FROM s
""")
def answer_repair(spark, sf_dir):
    """Verify, fix figures, drop bad citations and rebuild, verify again; what still blocks is degraded."""
    out, _ = _repaired(spark, sf_dir)
    return out["outcome"].select("answer_id", "outcome", "retries")


@query(f"""
WITH {REPAIR_SQL}
SELECT answer_id, list_sort(list_distinct(CASE WHEN over AND (NOT bad OR answer_id % 3 <> 0) THEN ['compliance'] ELSE [] END
  || CASE WHEN fault = 'none' THEN ['calculation'] ELSE [] END)) AS verifiers FROM s WHERE lost
""")
def answer_degraded(spark, sf_dir):
    """Degraded answers with the kinds of reasons they name."""
    out, _ = _repaired(spark, sf_dir)
    kind = lambda r: F.when(r["code"].startswith("calculation"), "calculation").otherwise("compliance")
    return out["degraded"].select("answer_id", F.array_sort(F.array_distinct(F.transform("reasons", kind))).alias("verifiers"))


@query(f"""
WITH {REPAIR_SQL}
SELECT answer_id, CASE WHEN fault = 'off' AND NOT lost THEN true ELSE false END AS mended FROM s WHERE fault = 'off'
""")
def answer_figures(spark, sf_dir):
    """Figures that were stated wrong: mended in the answers that could be kept."""
    out, _ = _repaired(spark, sf_dir)
    wrong, truth = _stated(spark, sf_dir)
    wrong = wrong.filter(F.col("answer_id") % 7 == 0).select("answer_id")
    now = out["figures"].join(truth.select("answer_id", F.col("result").cast("string").alias("_true")), "answer_id")
    return now.join(wrong, "answer_id", "left_semi").select("answer_id", (F.col("result") == F.col("_true")).alias("mended"))


@query(r"""
WITH p AS (SELECT u.conv_id, u.turn, regexp_replace(u.text, '\s+', '', 'g') AS a, regexp_replace(v.text, '\s+', '', 'g') AS b
  FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS x,
  list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS y FROM p)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END, 6)::DOUBLE AS overlap FROM g
""")
def trigram_overlap(spark, sf_dir):
    """Each turn against the next turn of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(T.trigram_containment(F.col("text"), F.col("next_text")), 6).alias("overlap")
    )


# ---- evaluation: benchmark items as cases, sparse search as the system under test

CASE_SQL = f"""
inside AS (SELECT b.item_id, r.doc_id, r.effect_status FROM benchmark b JOIN ({REGULATION_SQL}) r ON contains(r.content, b.text)),
cases AS (SELECT b.item_id, b.text, CASE WHEN count(i.doc_id) = 0 THEN 'insufficient'
   WHEN count(i.doc_id) FILTER (i.effect_status = 'repealed') > 0 THEN 'repealed_trap' ELSE 'standard' END AS case_type
  FROM benchmark b LEFT JOIN inside i ON i.item_id = b.item_id GROUP BY b.item_id, b.text),
top AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM dots),
joined AS (SELECT c.item_id, c.case_type, c.text, min(t.rank) FILTER (i.doc_id IS NOT NULL) AS exact_rank,
   count(*) FILTER (i.effect_status = 'repealed') AS leaks
  FROM cases c LEFT JOIN top t ON t.question_id = c.item_id AND t.rank <= 5
  LEFT JOIN inside i ON i.item_id = c.item_id AND i.doc_id = t.doc_id GROUP BY c.item_id, c.case_type, c.text),
results AS (SELECT item_id AS case_id, case_type, CASE case_type WHEN 'repealed_trap' THEN CASE WHEN leaks > 0 THEN 'failed' ELSE 'passed' END
   WHEN 'insufficient' THEN CASE WHEN length(text) < 200 THEN 'passed' ELSE 'failed' END
   ELSE CASE WHEN exact_rank IS NOT NULL THEN 'passed' ELSE 'failed' END END AS status,
  CASE WHEN case_type = 'standard' THEN CASE WHEN exact_rank IS NOT NULL THEN 1 ELSE 0 END END AS recall,
  CASE WHEN case_type = 'standard' THEN coalesce(1.0 / exact_rank, 0.0) END AS rr FROM joined),
run AS (SELECT count(*) AS total, count(*) FILTER (status = 'passed') AS passed,
  round(count(*) FILTER (status = 'passed') / count(*), 4) AS pass_rate, round(avg(recall), 4) AS recall_at_5, round(avg(rr), 4) AS mrr_at_5,
  count(*) FILTER (status = 'failed' AND case_type = 'repealed_trap') AS trap_leaks,
  count(*) FILTER (status = 'failed' AND case_type = 'insufficient') AS hard_answers FROM results)"""


def _results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    status = regulations(spark, sf_dir).select("doc_id", "effect_status")
    inside = passages_in_texts(
        docs, items.select("item_id", F.col("text").alias("passage")), "doc_id", "text", "item_id", "passage"
    ).join(status, "doc_id")
    label = F.concat(F.lit("doc-"), F.col("doc_id"))
    # Expectations of one case are the few documents that hold its passage.
    per = inside.groupBy("item_id").agg(
        F.collect_set(label).alias("expected_citations"),
        F.collect_set(F.when(F.col("effect_status") == "repealed", label)).alias("forbidden_citations"),
    )
    none = F.array().cast("array<string>")
    cases = items.join(per, "item_id", "left").select(
        F.col("item_id").alias("case_id"),
        F.when(F.col("expected_citations").isNull(), "insufficient")
        .when(F.size("forbidden_citations") > 0, "repealed_trap")
        .otherwise("standard")
        .alias("case_type"),
        F.coalesce("expected_citations", none).alias("expected_citations"),
        F.coalesce("forbidden_citations", none).alias("forbidden_citations"),
        none.alias("expected_points"),
        F.when(F.length("text") < 200, "clarification").otherwise("answer").alias("template"),
    )
    postings = V.term_weights(docs, "doc_id", "text")
    asked = V.term_weights(items.withColumnRenamed("item_id", "case_id"), "case_id", "text")
    hits = V.sparse_topk(postings, asked, 5, q_key="case_id").select(
        "case_id", "rank", label.alias("label"), label.alias("identity"), F.lit("").alias("content")
    )
    return E.evaluate_cases(cases, hits)


@query(f"WITH {DOT_SQL}, {CASE_SQL} SELECT case_id, case_type, status, recall, round(rr, 6)::DOUBLE AS rr FROM results")
def eval_cases(spark, sf_dir):
    return _results(spark, sf_dir).select("case_id", "case_type", "status", "recall", F.round("rr", 6).alias("rr"))


@query(f"""WITH {DOT_SQL}, {CASE_SQL} SELECT total, passed, pass_rate::DOUBLE AS pass_rate, recall_at_5::DOUBLE AS recall_at_5,
  mrr_at_5::DOUBLE AS mrr_at_5, trap_leaks, hard_answers, 0::BIGINT AS undetermined FROM run""")
def eval_metrics(spark, sf_dir):
    return E.metrics(_results(spark, sf_dir))


@query(f"""WITH {DOT_SQL}, {CASE_SQL} SELECT CASE WHEN trap_leaks > 0 OR pass_rate < 0.85 OR recall_at_5 < 0.8 THEN 'blocked' ELSE 'released' END AS decision,
  CASE WHEN trap_leaks > 0 THEN 'trap_leaks' ELSE '' END AS veto_items,
  concat_ws(',', CASE WHEN pass_rate < 0.85 THEN 'pass_rate' END, CASE WHEN recall_at_5 < 0.8 THEN 'recall_at_5' END) AS reasons FROM run""")
def gate_decision(spark, sf_dir):
    run = E.gate(E.metrics(_results(spark, sf_dir)))
    return run.select(
        "decision", F.array_join("veto_items", ",").alias("veto_items"), F.array_join("reasons", ",").alias("reasons")
    )


@query("""
SELECT o_orderkey, CASE WHEN (o_custkey % 120) / 100.0 <= 0.05 THEN 0.05 WHEN (o_custkey % 120) / 100.0 <= 0.2 THEN 0.2
  WHEN (o_custkey % 120) / 100.0 <= 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS stage FROM orders
""")
def canary(spark, sf_dir):
    ratio = (F.col("o_custkey") % 120) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", E.canary(ratio).alias("stage"))


CASE_TEMPLATES = (("{subject}的{tax}怎么申报", ("按月申报",)), ("{tax}能按季申报吗", ("按季申报",)))


@query(f"""
WITH numbered AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS s FROM orders)
SELECT o_orderkey AS doc_id, 'standard' AS case_type, CASE s WHEN 0 THEN '小规模纳税人' WHEN 1 THEN '一般纳税人' WHEN 2 THEN '小型微利企业' ELSE '个体工商户' END
  || '的增值税怎么申报' AS question FROM numbered
UNION ALL SELECT o_orderkey, 'standard', '增值税能按季申报吗' FROM numbered
UNION ALL SELECT doc_id, 'repealed_trap', '请说明增值税目前的规定' FROM ({REGULATION_SQL}) r WHERE effect_status = 'repealed'
""")
def eval_cases_gen(spark, sf_dir):
    """Candidate cases from the clauses of the notices and the repealed documents."""
    blocks = notice_blocks(spark, sf_dir)
    subjects = E.round_robin(
        notices(spark, sf_dir).select("doc_id"), "doc_id", E.SUBJECTS, "subject"
    )
    articles = (
        blocks.filter(F.col("level_code") == "item")
        .join(subjects, "doc_id")
        .withColumns({"tax_type": F.lit("增值税"), "label": F.col("full_no")})
    )
    standard = E.standard_cases(articles, templates=CASE_TEMPLATES)
    trap = E.trap_cases(
        regulations(spark, sf_dir).withColumns(
            {"tax_type": F.lit(None).cast("string"), "label": F.concat(F.lit("doc-"), "doc_id")}
        )
    )
    return standard.select("doc_id", "case_type", "question").unionByName(
        trap.select("doc_id", "case_type", "question")
    )
