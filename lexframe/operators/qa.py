"""Applicability, supporting clauses and assembled answers for tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import contains_any, lookup, present, text_of
from lexframe.functions.facts import limit_in, sentence_with
from lexframe.rules import facts as R

# ---------------------------------------------------------------- three values


def all_of(checks: Column, empty: Column | None = None) -> Column:
    """AND over an array of nullable booleans: any false, else any unknown, else true."""
    out = F.when(F.exists(checks, lambda c: c.eqNullSafe(F.lit(False))), F.lit(False)).when(
        F.exists(checks, lambda c: c.isNull()), F.lit(None).cast("boolean")
    )
    if empty is not None:
        out = F.when(F.size(checks) == 0, empty).otherwise(out.otherwise(F.lit(True)))
        return out
    return out.otherwise(F.lit(True))


def verdict_name(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit("need_confirm"))
        .when(value, F.lit("applicable"))
        .otherwise(F.lit("not_applicable"))
    )


# ---------------------------------------------------------------- applicability


def _condition(name: str, holds: Column, reason: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        holds.cast("boolean").alias("passed"),
        reason.alias("reason"),
        evidence.alias("evidence"),
    )


def _mentioned(content: Column, words) -> Column:
    return present([F.when(content.contains(w), F.lit(w)) for w in words])


def judge(pairs: DataFrame, content: str = "content", policy_types: str = "policy_tax_types") -> DataFrame:
    """Adds conditions, verdict and reason to (question facts, candidate clause) rows.

    Checks the subject within its own dimension, the business, money and count limits and
    the tax type. No condition at all needs confirmation; unknown never counts as either.
    """
    # What several checks read is a column first, so that each text is stripped and searched once.
    body = F.col("_body")
    rows = pairs.withColumn("_body", T.strip(text_of(content))).withColumns(
        {
            "_subjects": _mentioned(body, R.SUBJECTS),
            "_business": _mentioned(body, R.BUSINESS_WORDS),
            "_limit": limit_in(body, R.LIMITS),
            **{f"_count{i}": limit_in(body, p) for i, (_, p) in enumerate(R.COUNT_LIMITS)},
        }
    )
    mine = lookup(F.col("taxpayer_type"), R.SUBJECT_DIMENSIONS)
    same = F.filter("_subjects", lambda w: lookup(w, R.SUBJECT_DIMENSIONS).eqNullSafe(mine))
    subject = F.when(
        F.col("taxpayer_type").isNotNull() & (F.size(same) > 0),
        F.exists(same, lambda w: F.col("taxpayer_type").contains(w)),
    )
    business = F.when(
        F.col("business_type").isNotNull(),
        F.exists("_business", lambda w: F.col("business_type").contains(w)),
    )
    rows = rows.withColumn("_sentence", F.when(F.col("_limit").isNotNull(), sentence_with(body, F.col("_limit.matched"))))
    sentence = F.col("_sentence")
    by_name = F.coalesce(
        *[F.when(sentence.contains(n), F.col("scale")[n]) for n, _ in R.SCALE]
    )
    value = F.coalesce(
        by_name,
        F.when(contains_any(sentence, R.REVENUE_WORDS), F.col("amount")).otherwise(
            F.coalesce(*[F.col("scale")[n] for n, _ in R.SCALE], F.col("amount"))
        ),
    )
    overlap = F.arrays_overlap(F.col(policy_types), F.col("tax_types"))
    conditions, checks = [], {}

    def check(name: str, asked: Column, holds: Column, reason: Column, evidence: Column) -> None:
        at = f"_check{len(checks)}"
        checks[at] = F.when(asked, F.struct(holds.cast("boolean").alias("passed")))
        conditions.append(F.when(F.col(at).isNotNull(), _condition(name, F.col(at)["passed"], reason, evidence)))

    check(
        "subject", F.size("_subjects") > 0, subject,
        F.array_join("_subjects", "、"), sentence_with(body, F.get("_subjects", F.lit(0))),
    )
    check(
        "business", F.size("_business") > 0, business,
        F.array_join("_business", "、"), sentence_with(body, F.get("_business", F.lit(0))),
    )
    check("amount", F.col("_limit").isNotNull(), value <= F.col("_limit.limit"), F.col("_limit.matched"), sentence)
    for i, (name, _) in enumerate(R.COUNT_LIMITS):
        found = F.col(f"_count{i}")
        check(
            name, found.isNotNull(), F.col("scale")[name] <= found["limit"],
            found["matched"], sentence_with(body, found["matched"]),
        )
    check(
        "tax_type", (F.size(policy_types) > 0) & (F.size("tax_types") > 0), overlap,
        F.array_join(policy_types, "、"), F.lit(""),
    )
    rows = rows.withColumns(checks)
    # Who asks for the verdict alone pays for no evidence: the verdict reads the bare checks.
    passed = F.transform(present([F.col(c) for c in checks]), lambda c: c["passed"])
    rows = rows.withColumn("_passed", passed).withColumn("_all", all_of(F.col("_passed"), empty=F.lit(None).cast("boolean")))
    rows = rows.withColumns({"conditions": present(conditions), "verdict": verdict_name(F.col("_all"))})
    wanted = F.when(F.col("verdict") == "not_applicable", F.lit(False)).when(
        F.col("verdict") == "applicable", F.lit(True)
    )
    named = F.filter("conditions", lambda c: c["passed"].eqNullSafe(wanted))
    return rows.withColumn(
        "reason", F.array_join(F.transform(named, lambda c: F.concat_ws(":", c["name"], c["reason"])), "；")
    ).drop(*[c for c in rows.columns if c.startswith("_")])


def three_lists(verdicts: DataFrame, q: str = "question_id", order: str = "rank") -> DataFrame:
    """Citations per verdict, each once per question, in rank order. A question has the
    few candidates of its answer depth, so its lists stay short."""
    first = verdicts.groupBy(q, "citation").agg(
        F.min_by("verdict", order).alias("verdict"), F.min(order).alias("_at")
    )

    def listed(name: str) -> Column:
        kept = F.sort_array(
            F.collect_list(F.when(F.col("verdict") == name, F.struct("_at", "citation")))
        )
        return F.transform(kept, lambda x: x["citation"]).alias(name)

    return first.groupBy(q).agg(
        *[listed(n) for n in ("applicable", "need_confirm", "not_applicable")]
    )


# ---------------------------------------------------------------- supporting clauses


def sibling_clauses(
    cited: DataFrame,
    articles: DataFrame,
    q: str = "question_id",
    regulation: str = "regulation_id",
    article: str = "article_id",
    subject: str | None = None,
    top_regulations: int = 3,
    per_regulation: int = 3,
    total: int = 5,
    substantive: Column | None = None,
) -> DataFrame:
    """Substantive clauses of the best cited regulations that are not cited themselves.

    cited: (question, regulation, article, rank[, subject]); articles: (regulation, article,
    order_index, content). Before the questions are joined, each (regulation, subject) is
    cut to as many clauses as any question could need: the wanted number plus the largest
    number of its clauses that one question cites.
    """
    asked = cited.select(
        q, regulation, article, "rank",
        (F.col(subject) if subject else F.lit(None).cast("string")).alias("_subject"),
    )
    best = asked.groupBy(q, regulation).agg(
        F.min("rank").alias("_rank"), F.count(F.lit(1)).alias("_cites"), F.min("_subject").alias("_subject")
    )
    by_rank = Window.partitionBy(q).orderBy("_rank", regulation)
    top = best.withColumn("_reg_no", F.row_number().over(by_rank)).filter(
        F.col("_reg_no") <= top_regulations
    )
    most = best.agg(F.max("_cites")).scalar()
    keep = substantive if substantive is not None else T.substance(F.col("content")) >= 5
    subjects = top.select(regulation, "_subject").distinct()
    in_order = Window.partitionBy(regulation, "_subject").orderBy("order_index", article)
    offered = (
        articles.filter(keep)
        .join(subjects, regulation)
        .filter(F.col("_subject").isNull() | F.col("content").contains(F.col("_subject")))
        .withColumn("_pos", F.row_number().over(in_order))
        .filter(F.col("_pos") <= F.lit(per_regulation) + most)
    )
    t, o = top.alias("t"), offered.alias("o")
    pairs = t.join(
        o,
        (F.col(f"t.{regulation}") == F.col(f"o.{regulation}"))
        & F.col("t._subject").eqNullSafe(F.col("o._subject")),
    ).select(
        f"t.{q}", f"t.{regulation}", f"o.{article}", "t._reg_no", "o.order_index"
    )
    fresh = pairs.join(cited.select(q, regulation, article), [q, regulation, article], "left_anti")
    inside = Window.partitionBy(q, regulation).orderBy("order_index", article)
    overall = Window.partitionBy(q).orderBy("_reg_no", "order_index", article)
    return (
        fresh.withColumn("_n", F.row_number().over(inside))
        .filter(F.col("_n") <= per_regulation)
        .withColumn("position", F.row_number().over(overall))
        .filter(F.col("position") <= total)
        .select(q, regulation, article, "position")
    )


def with_children(
    articles: DataFrame,
    regulation: str = "regulation_id",
    min_chars: int = 15,
    children: int = 3,
) -> DataFrame:
    """Append the first children to very short clauses. A child's number starts with its
    parent's, so each child lists its own prefixes and joins on equality."""
    words = F.split("full_no", " ")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " ")
    )
    below = articles.filter((F.size(words) > 1) & (F.length(T.strip(F.col("content"))) > 0)).select(
        F.col(regulation).alias("_reg"),
        F.explode(prefixes).alias("_parent"),
        F.col("order_index").alias("_at"),
        T.strip(F.col("content")).alias("_child"),
    )
    short = articles.filter(F.length(T.strip(F.col("content"))) < min_chars)
    first = Window.partitionBy("_reg", "_parent").orderBy("_at")
    few = (
        below.join(
            short.select(F.col(regulation).alias("_reg"), F.col("full_no").alias("_parent")),
            ["_reg", "_parent"],
            "left_semi",
        )
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= children)
        .groupBy("_reg", "_parent")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "_child"))).alias("_few"))
    )
    return short.join(
        few, (F.col(regulation) == F.col("_reg")) & (F.col("full_no") == F.col("_parent"))
    ).select(
        regulation,
        "full_no",
        F.concat_ws(
            " ", T.strip(F.col("content")), F.array_join(F.transform("_few", lambda c: c["_child"]), " ")
        ).alias("content"),
    )


# ---------------------------------------------------------------- answers


def needs_clarification(intent: Column, text: Column) -> Column:
    """Ask first: always for calculation and how-to, for a question in the first person,
    and where the answer depends on an unknown subject."""
    return (F.size("questions") > 0) & (
        intent.isin("calculation", "how_to")
        | contains_any(text, R.FIRST_PERSON)
        | (F.col("taxpayer_type").isNull() & contains_any(text, R.SUBJECT_QUESTIONS))
    )


def _section(spec, content: Column) -> Column:
    key, title, required, renderer = spec
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(title).alias("title"),
        F.lit(required).alias("required"),
        F.lit(renderer).alias("renderer"),
        content.cast("string").alias("content"),
    )


def assemble(questions: DataFrame, lists: DataFrame, q: str = "question_id", text: str = "text") -> DataFrame:
    """One answer per question: clarify, refuse or answer, with its sections.

    questions: facts of ``extract_facts`` with optional judgement, calculation and risks;
    lists: ``three_lists``. A missing required section makes the answer a refusal.
    """
    rows = questions.join(lists, q, "left")
    for name in ("judgement", "calculation", "risks"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    intent = T.question_intent(F.col(text))
    usable = F.size(F.concat(F.coalesce("applicable", F.array().cast("array<string>")),
                             F.coalesce("need_confirm", F.array().cast("array<string>"))))
    rows = rows.withColumns(
        {"intent": intent, "_cited": F.coalesce(usable, F.lit(0)), "_has_lists": F.col("applicable").isNotNull()}
    )
    basis = F.concat_ws("；", "applicable", "need_confirm", "not_applicable")
    rows = rows.withColumn(
        "status",
        F.when(needs_clarification(F.col("intent"), F.col(text)), F.lit("clarify"))
        .when(~F.col("_has_lists") | (F.col("_cited") == 0), F.lit("refuse"))
        .when(text_of("judgement") == "", F.lit("refuse"))
        .otherwise(F.lit("answer")),
    )
    ask = F.when(
        (F.col("intent") == "policy_query") & F.col("subject_question").isNotNull(), F.col("subject_question")
    ).otherwise(F.array_join("questions", "；"))
    reason = (
        F.when(~F.col("_has_lists"), F.lit("no_candidates"))
        .when(F.col("_cited") == 0, F.lit("none_applicable"))
        .otherwise(F.lit("section_missing"))
    )
    answer = F.array(
        *[
            _section(
                spec,
                F.lit(R.ANSWER_DISCLAIMER)
                if spec[0] == "disclaimer"
                else basis if spec[0] == "basis" else F.col(spec[0]),
            )
            for spec in R.ANSWER_SECTIONS
        ]
    )
    clarify = F.array(
        *[
            _section(
                spec,
                F.lit(R.CLARIFY_DISCLAIMER)
                if spec[0] == "disclaimer"
                else F.when(F.col("status") == "clarify", basis)
                if spec[0] == "basis"
                else F.when(F.col("status") == "clarify", ask).otherwise(reason),
            )
            for spec in R.CLARIFY_SECTIONS
        ]
    )
    sections = F.filter(
        F.when(F.col("status") == "answer", answer).otherwise(clarify),
        lambda s: F.coalesce(s["content"], F.lit("")) != "",
    )
    return rows.withColumns(
        {
            "sections": sections,
            "template": F.when(F.col("status") == "answer", F.lit("answer")).otherwise(F.lit("clarification")),
            "refusal_reason": F.when(F.col("status") == "refuse", reason),
        }
    ).drop("_cited", "_has_lists")
