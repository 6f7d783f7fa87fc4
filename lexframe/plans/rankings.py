"""Registered queries of orders and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.operators import rankings as K
from lexframe.operators import retrieval as R
from lexframe.plans.base import Family
from lexframe.plans.bindings import REGULATION_SQL, questions, regulations, table

family = Family()
query = family.query


@query("""
WITH a AS (SELECT lang AS question_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS semantic,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS structured FROM documents)
SELECT question_id, doc_id, CASE WHEN semantic <= 30 THEN semantic END AS semantic, CASE WHEN structured <= 10 THEN structured END AS structured
FROM a WHERE semantic <= 30 OR structured <= 10
""")
def fusion_ranks(spark, sf_dir):
    """Two routes for each language: the longest documents and the first ones, with the ranks each gave."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "question_id")
    long = R.route(docs, "semantic", "question_id", "doc_id", [F.col("n_chars").desc(), F.col("doc_id")], 30)
    early = R.route(docs, "structured", "question_id", "doc_id", [F.col("doc_id")], 10)
    rows = K.route_ranks(long.unionByName(early))
    return rows.select("question_id", "doc_id", F.col("ranks")["semantic"].alias("semantic"), F.col("ranks")["structured"].alias("structured"))


@query("""
SELECT event_type || '/' || user_id % 40 AS topic, 'low_confidence' AS reason, count(*) AS occurrences FROM events WHERE user_id % 3 > 0
GROUP BY 1 ORDER BY occurrences DESC, topic LIMIT 50
""")
def open_gap_ranking(spark, sf_dir):
    """Gaps of events, those of every third user resolved; the open ones that were met most."""
    events = table(spark, sf_dir, "events")
    topic = F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string"))
    status = F.when(F.col("user_id") % 3 > 0, "open").otherwise("resolved")
    gaps = events.groupBy(topic.alias("topic"), F.lit("low_confidence").alias("reason"), status.alias("status")).agg(F.count(F.lit(1)).alias("occurrences"))
    return K.open_gaps(gaps).select("topic", "reason", "occurrences")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 7 DESC, doc_id) AS unit_rank FROM documents""")
def units_by_usability(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("usability", F.col("n_chars") % 7)
    return K.units_in_order(docs, "source", "doc_id").select("doc_id", "unit_rank")


@query("""
WITH l AS (SELECT o_orderkey AS question_id, o_custkey % 4 = 1 AS benefits, l_linenumber AS place, CAST(l_quantity AS INTEGER) % 5 AS substance
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT question_id, place, shown_rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN benefits THEN -substance ELSE 0 END, place) AS shown_rank FROM l) x
WHERE shown_rank <= 5
""")
def provisions_shown(spark, sf_dir):
    """Order lines as provisions of the order's question: the weightiest first where it asks for benefits."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("place"), (F.col("l_quantity").cast("int") % 5).alias("substance")
    )
    rows = lines.join(questions(spark, sf_dir), "question_id")
    return K.shown_provisions(rows, "question_id", "text", "place", "substance").select("question_id", "place", "shown_rank")


@query("""
SELECT conv_id, list_aggregate(list_filter(list_transform(list_distinct_in_order, lambda x: trim(x, ' ')), lambda x: x <> ''), 'string_agg', '|') AS notes FROM (
  SELECT conv_id, list(note ORDER BY first) AS list_distinct_in_order FROM (
    SELECT conv_id, note, min(place) AS first FROM (
      SELECT conv_id, 2 * turn AS place, CASE WHEN turn % 3 = 2 THEN ' ' ELSE role END AS note FROM conversations
      UNION ALL SELECT conv_id, 2 * turn + 1, ' ' || role || ' ' FROM conversations WHERE turn % 2 = 0) n GROUP BY conv_id, note) d GROUP BY conv_id) l
""")
def notes_in_order(spark, sf_dir):
    """Roles of a conversation as notes, some blank, some with white space around them."""
    turns = table(spark, sf_dir, "conversations")
    note = F.when(F.col("turn") % 3 == 2, F.lit(" ")).otherwise(F.col("role"))
    again = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "role", F.lit(" ")))
    pairs = F.array_compact(F.array(note, again))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", pairs.alias("notes")))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["notes"]))
    return lists.select("conv_id", F.array_join(K.notes_in_order(flat), "|").alias("notes"))


@query(f"""
SELECT doc_id, title FROM ({REGULATION_SQL}) r WHERE review_state = 'pending_review' AND lang = 'en' ORDER BY title, doc_id LIMIT 200 OFFSET 10
""")
def pending_reviews(spark, sf_dir):
    rows = regulations(spark, sf_dir).withColumn("domain_id", F.col("lang"))
    return K.pending_regulations(rows, "doc_id", "en", offset=10).select("doc_id", "title")


@query("""
SELECT 'T' || event_id AS technique_code, event_type AS question, ts AS created_at FROM events WHERE event_type IN ('error', 'view')
ORDER BY ts, technique_code LIMIT 100
""")
def pending_plan_queue(spark, sf_dir):
    """Events as candidate plans put into the review queue: the oldest hundred."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    plans = events.withColumns({"code": F.concat(F.lit("T"), "event_id"), "risk_level": F.lit("yellow")})
    queue = K.enqueue_plans(plans, F.col("event_type"), F.col("ts"))
    return K.pending_plans(queue).select("technique_code", "question", "created_at")
