"""Registered queries of corpus upkeep and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions.common import lookup
from lexframe.operators import corpus as C
from lexframe.operators import evolve as E
from lexframe.operators import nested as N
from lexframe.operators import structure as S
from lexframe.plans.base import Family
from lexframe.plans.bindings import NOTICE_SQL, REGULATION_SQL, notices, regulations, table
from lexframe.session import fresh_path
from lexframe.sources import writers as Wr

family = Family()
query = family.query

TITLE_RE = r"[\\s\\(\\)（）—\\-－_、，,]+".replace("\\\\", "\\")
COLLECT_RE = r"[\s\(\)（）—\-－_、，,《》]+"
AUDIT_RE = r"[\s（）()《》〔〕\[\]—\-－_、，,。.]+"

# ---- duplicates and import


@query(rf"""
WITH k AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '{TITLE_RE}', '', 'g') AS t, length(text) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY t) AS copies FROM k)
SELECT doc_id, copies FROM r WHERE rn = 1
""")
def dedup_titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content")
    )
    return C.longest_per_title(docs, "doc_id").select("doc_id", "copies")


@query(rf"""
WITH k AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '{COLLECT_RE}', '', 'g') AS t, n_chars AS n, n_chars % 5 > 0 AS numbered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY numbered DESC, n DESC, doc_id) AS rn FROM k)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS file_no FROM r WHERE rn = 1
""")
def dedup_files(spark, sf_dir):
    files = regulations(spark, sf_dir).select(
        "doc_id", "title", "document_number", F.col("n_chars").alias("size")
    )
    return C.best_files(files, "doc_id").select("doc_id", "file_no")


# Each document with its number and title, and for some of them twins: the number under another title, the title without
# a number, neither, and the other title alone, which is new where the twin that bears it was left out.
TWINS_SQL = f"""
r AS (SELECT doc_id, lang AS domain_id, hierarchy_level, document_number, title, review_state FROM ({REGULATION_SQL}) x),
twins AS (SELECT doc_id, 0 AS twin, domain_id, hierarchy_level, document_number, title FROM r
  UNION ALL SELECT doc_id, 1, domain_id, hierarchy_level, document_number, 'copy of ' || title FROM r WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 2, domain_id, hierarchy_level, NULL, ' ' || title FROM r WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 3, domain_id, hierarchy_level, NULL, '' FROM r WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 4, domain_id, hierarchy_level, NULL, 'copy of ' || title FROM r WHERE doc_id % 6 = 0),
keyed AS (SELECT *, (twin * 3 % 5) * 1000000000000 + doc_id AS place,
  CASE WHEN document_number <> '' THEN domain_id || '|' || hierarchy_level || '|' || document_number END AS n,
  CASE WHEN trim(title, ' ') <> '' THEN domain_id || '|' || hierarchy_level || '|' || trim(title, ' ') END AS t FROM twins),
listed AS (SELECT *, row_number() OVER (ORDER BY place) AS i FROM keyed),
library AS (SELECT coalesce(list(domain_id || '|' || hierarchy_level || '|' || document_number) FILTER (document_number <> ''), []) AS ns,
  coalesce(list(domain_id || '|' || hierarchy_level || '|' || title) FILTER (title <> ''), []) AS ts FROM r WHERE review_state = 'rejected'),
steps AS (SELECT CAST(0 AS BIGINT) AS i, ns, ts, false AS added FROM library
  UNION ALL
  SELECT i, CASE WHEN added AND n IS NOT NULL THEN list_append(ns, n) ELSE ns END, CASE WHEN added AND t IS NOT NULL THEN list_append(ts, t) ELSE ts END, added FROM (
    SELECT l.i, n, t, ns, ts, NOT coalesce(list_contains(ns, n), false) AND NOT coalesce(list_contains(ts, t), false) AS added
    FROM steps s JOIN listed l ON l.i = s.i + 1) x)"""


EMPTY_LIBRARY_SQL = TWINS_SQL.replace("FROM r WHERE review_state = 'rejected')", "FROM r WHERE false)")


def _twins(spark, sf_dir):
    rows = regulations(spark, sf_dir).withColumn("domain_id", F.col("lang"))
    number, title, none = F.col("document_number"), F.col("title"), F.lit(None).cast("string")
    pair = lambda twin, n, t, when: F.when(when, F.struct(F.lit(twin).alias("twin"), n.alias("document_number"), t.alias("title")))
    doc, copy = F.col("doc_id"), F.concat(F.lit("copy of "), title)
    variants = F.array_compact(F.array(
        pair(0, number, title, F.lit(True)), pair(1, number, copy, doc % 3 == 0), pair(2, none, F.concat(F.lit(" "), title), doc % 4 == 0),
        pair(3, none, F.lit(""), doc % 5 == 0), pair(4, none, copy, doc % 6 == 0),
    ))
    batch = rows.select("doc_id", "domain_id", "hierarchy_level", F.inline(variants))
    place = (F.col("twin") * 3 % 5).cast("long") * 1_000_000_000_000 + F.col("doc_id")
    return batch.withColumn("place", place), rows.filter(F.col("review_state") == "rejected")


@query(f"WITH RECURSIVE {TWINS_SQL} SELECT doc_id, twin FROM steps JOIN listed USING (i) WHERE added")
def import_twins(spark, sf_dir):
    """All documents with their twins, against a library that holds the rejected ones: what an import in order adds."""
    batch, known = _twins(spark, sf_dir)
    return C.new_regulations(batch, known, "place").select("doc_id", "twin")


@query(f"WITH RECURSIVE {EMPTY_LIBRARY_SQL} SELECT doc_id, twin FROM steps JOIN listed USING (i) WHERE added")
def import_twice(spark, sf_dir):
    """The same batch into an empty corpus, run again under its name, and imported once more under another."""
    batch = _twins(spark, sf_dir)[0].withColumn("level_code", F.lit("article"))
    path = fresh_path(spark, "corpus")
    for name in ("first", "first", "second"):
        rows = batch.select("place", "doc_id", "twin", "domain_id", "hierarchy_level", "document_number", "title")
        parts = batch.select("place", "domain_id", "level_code")
        Wr.merge_corpus(rows, parts, parts, path, name, "place", "place")
    articles = spark.read.parquet(f"{path}/articles").select("place")
    return spark.read.parquet(f"{path}/regulations").join(articles, "place").select("doc_id", "twin")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761) % 2147483647 * 4294967296 + doc_id) AS number FROM documents
""")
def number_hashed_ids(spark, sf_dir):
    """Documents numbered by ids that fill 63 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    wide = (F.col("doc_id") * 2654435761) % 2147483647 * 4294967296 + F.col("doc_id")
    return C.number_rows(docs.withColumn("wide", wide), "wide").select("doc_id", "number")


BATCH_SQL = f"""
r AS (SELECT doc_id, lang AS domain_id, title, hierarchy_level, document_number, review_state, lang || '|' || hierarchy_level || '|' || nullif(document_number, '') AS n,
  lang || '|' || hierarchy_level || '|' || nullif(trim(title, ' '), '') AS t, row_number() OVER (ORDER BY doc_id) AS i FROM ({REGULATION_SQL}) x),
all_rows AS (SELECT * FROM r),
library AS (SELECT coalesce(list(n) FILTER (n IS NOT NULL), []) AS ns, coalesce(list(lang || '|' || hierarchy_level || '|' || title) FILTER (title <> ''), []) AS ts
  FROM (SELECT *, domain_id AS lang FROM r) y WHERE review_state = 'rejected'),
steps AS (SELECT CAST(0 AS BIGINT) AS i, ns, ts, false AS added FROM library
  UNION ALL
  SELECT i, CASE WHEN added AND n IS NOT NULL THEN list_append(ns, n) ELSE ns END, CASE WHEN added AND t IS NOT NULL THEN list_append(ts, t) ELSE ts END, added FROM (
    SELECT l.i, n, t, ns, ts, NOT coalesce(list_contains(ns, n), false) AND NOT coalesce(list_contains(ts, t), false) AS added
    FROM steps s JOIN r l ON l.i = s.i + 1) x),
fresh AS (SELECT doc_id FROM steps JOIN r USING (i) WHERE added)"""


def _import(spark, sf_dir):
    rows = regulations(spark, sf_dir).withColumn("domain_id", F.col("lang"))
    known = rows.filter(F.col("review_state") == "rejected")
    batch = rows.select("doc_id", "domain_id", "title", "hierarchy_level", "document_number")
    return batch, C.new_regulations(batch, known, "doc_id")


@query(f"WITH RECURSIVE {BATCH_SQL} SELECT doc_id FROM fresh")
def import_new(spark, sf_dir):
    """All documents as a batch against a library that holds the rejected ones."""
    return _import(spark, sf_dir)[1].select("doc_id")


@query(f"""
WITH RECURSIVE {BATCH_SQL}, s AS (SELECT a.*, CASE WHEN title = '' THEN 'failed' WHEN f.doc_id IS NOT NULL THEN 'imported' ELSE 'skipped' END AS status
  FROM all_rows a LEFT JOIN fresh f ON f.doc_id = a.doc_id)
SELECT count(*) AS total, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'imported' AND document_number IS NULL) AS for_review,
  count(*) FILTER (status = 'imported') AS articles FROM s
""")
def import_report(spark, sf_dir):
    batch, fresh = _import(spark, sf_dir)
    rows = batch.join(fresh.select("doc_id", F.lit(True).alias("_new")), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("title") == "", "failed").when(F.col("_new"), "imported").otherwise("skipped").alias("status"),
        F.col("document_number").isNull().alias("requires_review"),
        F.lit(1).alias("articles"),
    )
    return C.import_report(rows)


# ---- audits


@query(f"""
WITH p AS (SELECT doc_id, status, priority, o_date, '关于' || priority || '订单管理办法' AS title FROM ({NOTICE_SQL}) n)
SELECT doc_id, 'effective_date' AS field, CAST(o_date + 1 AS VARCHAR) AS old, CAST(o_date AS VARCHAR) AS new FROM p WHERE status = 'O'
UNION ALL SELECT doc_id, 'title', '旧' || title, title FROM p WHERE priority = '2-HIGH'
UNION ALL SELECT doc_id, 'issuer', 'unknown', NULL FROM p WHERE status = 'P'
""")
def repair_diff(spark, sf_dir):
    """Headers parsed again against a stored table with three kinds of errors."""
    parsed = S.parse_header(notices(spark, sf_dir)).select("doc_id", "title", "issuer", "effective_date", "hierarchy_level")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority")
    stored = parsed.join(orders, "doc_id").select(
        "doc_id",
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("旧"), "title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("issuer")).alias("issuer"),
        F.when(F.col("o_orderstatus") == "O", F.date_add("effective_date", 1)).otherwise(F.col("effective_date")).alias("effective_date"),
        "hierarchy_level",
    )
    return C.repair_diff(stored, parsed, "doc_id")


def _audited(spark, sf_dir):
    rows = regulations(spark, sf_dir)
    official = table(spark, sf_dir, "labels").join(rows.select("doc_id", "title"), "doc_id").select(
        F.concat(F.lit("《"), "title", F.lit("》")).alias("title"),
        F.when(F.col("toxic") == 1, "全文废止").when(F.col("quality") == 1, "部分失效").otherwise("未知").alias("aging"),
        F.when(F.col("toxic") == 1, "2021-05-04").otherwise("null").alias("abolish_date"),
        F.col("doc_id").alias("official_no"),
    )
    return C.status_audit(rows, official, "doc_id")


AUDIT_SQL = rf"""
rows_ AS (SELECT doc_id, title, effect_status, regexp_replace(title, '{AUDIT_RE}', '', 'g') AS k FROM ({REGULATION_SQL}) r),
off AS (SELECT k, arg_max(CASE WHEN toxic = 1 THEN 'repealed' WHEN quality = 1 THEN 'partially_repealed' END, l.doc_id) AS target,
  arg_max(toxic, l.doc_id) AS toxic, max(l.doc_id) AS last_id, arg_max(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 1 ELSE 0 END, l.doc_id) AS known
  FROM labels l JOIN rows_ r ON r.doc_id = l.doc_id GROUP BY k),
audited AS (SELECT r.doc_id, r.title, r.effect_status, CASE WHEN known = 1 THEN target END AS target_status, CASE WHEN off.toxic = 1 THEN DATE '2021-05-04' END AS abolish_date,
  CASE WHEN last_id IS NULL THEN 'unknown' WHEN known = 1 AND target <> effect_status THEN 'changed' ELSE 'same' END AS outcome
  FROM rows_ r LEFT JOIN off ON off.k = r.k)"""


@query(f"WITH {AUDIT_SQL} SELECT doc_id, target_status, abolish_date, outcome FROM audited")
def status_audit(spark, sf_dir):
    return _audited(spark, sf_dir).select("doc_id", "target_status", "abolish_date", "outcome")


@query(f"""WITH {AUDIT_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY target_status ORDER BY doc_id) AS n FROM audited WHERE outcome = 'changed')
SELECT target_status, count(*) AS regulations, md5(string_agg(title, '|' ORDER BY n) FILTER (n <= 8)) AS titles_md5 FROM c GROUP BY target_status""")
def status_report(spark, sf_dir):
    rows = C.status_report(_audited(spark, sf_dir), "doc_id")
    return rows.select("target_status", "regulations", F.md5(F.array_join("titles", "|")).alias("titles_md5"))


@query(f"""
SELECT c AS regulation_id, make_date(max(yi) , 1, 1) AS window_start, make_date(max(yi) + 2, 12, 31) AS window_end,
  CASE WHEN make_date(max(yi) + 2, 12, 31) < DATE '2002-06-30' THEN 'expired' ELSE 'running' END AS state, 'set_interval' AS action
FROM (SELECT cust AS c, yi, status FROM ({NOTICE_SQL}) n) t WHERE status <> 'P' GROUP BY c HAVING NOT bool_and(status = 'F')
""")
def regulation_windows(spark, sf_dir):
    """Notices as versions of the regulation of their customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    versions = notices(spark, sf_dir).join(orders, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("regulation_id"),
        F.col("doc_id").alias("order_index"),
        F.col("text").alias("content"),
        F.to_date("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("valid_to"),
        F.when(F.col("o_orderstatus") == "P", "repealed").otherwise("effective").alias("effect_status"),
    )
    return C.regulation_windows(versions, F.lit("2002-06-30").cast("date"))


@query(f"""
WITH r AS (SELECT doc_id, review_state, lang FROM ({REGULATION_SQL}) x),
d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS action FROM r WHERE review_state = 'pending_review')
SELECT r.doc_id, CASE action WHEN 'approve' THEN 'published' WHEN 'reject' THEN 'rejected' ELSE review_state END AS review_state,
  action IS NOT NULL AS audited, CASE WHEN action IS NOT NULL THEN review_state END AS from_state FROM r LEFT JOIN d ON d.doc_id = r.doc_id
""")
def review_decisions(spark, sf_dir):
    rows = regulations(spark, sf_dir)
    decisions = rows.filter(F.col("review_state") == "pending_review").select(
        "doc_id",
        lookup(F.col("doc_id") % 3, {0: "approve", 1: "reject", 2: "later"}).alias("action"),
        F.lit("expert").alias("actor"),
        F.lit(None).cast("string").alias("note"),
    )
    after, audit = C.review(rows, decisions, "doc_id")
    return after.select("doc_id", "review_state").join(
        audit.select("doc_id", F.lit(True).alias("_a"), "from_state"), "doc_id", "left"
    ).select("doc_id", "review_state", F.coalesce("_a", F.lit(False)).alias("audited"), "from_state")


# ---- new documents


@query(r"""
WITH l AS (SELECT page_id, replace(url, 'http://ththre', 'https://ththre') AS u FROM pages),
known AS (SELECT replace(url, 'http://ththre', 'https://ththre') AS u FROM pages WHERE contains(url, '?'))
SELECT u AS url, min(page_id) AS listed_no FROM l WHERE u NOT IN (SELECT u FROM known) GROUP BY u
""")
def anti_new_docs(spark, sf_dir):
    """Listed pages against a library that knows the URLs with a query part."""
    pages = table(spark, sf_dir, "pages")
    swap = F.replace(F.col("url"), F.lit("http://ththre"), F.lit("https://ththre"))
    listing = pages.select(swap.alias("url"), F.col("page_id").alias("listed_no"), F.lit("page").alias("title"))
    known = pages.filter(F.col("url").contains("?")).select(swap.alias("source_url"))
    return E.new_documents(listing, known).select("url", "listed_no")


@query(rf"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '/([a-z]+)/', 1) AS lang FROM pages),
k AS (SELECT regexp_replace(title, '{COLLECT_RE}', '', 'g') AS k FROM t WHERE lang <> 'en')
SELECT page_id FROM t WHERE regexp_replace(title, '{COLLECT_RE}', '', 'g') NOT IN (SELECT k FROM k)
""")
def anti_new_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "/([a-z]+)/", 1).alias("lang"),
    )
    return E.new_titles(pages, pages.filter(F.col("lang") != "en")).select("page_id")


# ---- gaps: events as verification records, words of the type as the question

WORDS = {"signup": "小规模怎么申报", "view": "进项能不能抵扣", "click": "土地增值税清算", "purchase": "优惠怎么享受", "error": "其他"}
TOPIC_SQL = """CASE event_type WHEN 'signup' THEN '增值税·申报' WHEN 'view' THEN '增值税·抵扣' WHEN 'click' THEN '土地增值税·清算'
  WHEN 'purchase' THEN '未标注税种·优惠' ELSE '未分类问题' END"""
TAX_SQL = "CASE event_type WHEN 'signup' THEN '增值税' WHEN 'view' THEN '增值税' WHEN 'click' THEN '土地增值税' END"


def _records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"),
        F.concat(lookup(F.col("event_type"), WORDS), F.lit("？"), F.col("user_id")).alias("question"),
        F.when(F.col("value") > 20, "degraded").otherwise("passed").alias("outcome"),
        (F.col("value") <= 10).alias("passed"),
        F.col("ts").alias("created_at"),
    )


def _clusters(spark, sf_dir):
    return E.gap_clusters(_records(spark, sf_dir))


GAP_SQL = f"""
f AS (SELECT {TOPIC_SQL} AS topic, {TAX_SQL} AS tax_type, CASE WHEN value > 20 THEN 'degraded' ELSE 'low_confidence' END AS reason, event_id, ts,
  CASE event_type WHEN 'signup' THEN '小规模怎么申报' WHEN 'view' THEN '进项能不能抵扣' WHEN 'click' THEN '土地增值税清算' WHEN 'purchase' THEN '优惠怎么享受' ELSE '其他' END || '？' || user_id AS q
  FROM events WHERE value > 10),
q AS (SELECT topic, reason, q, row_number() OVER (PARTITION BY topic, reason ORDER BY max(ts) DESC, min(event_id)) AS n FROM f GROUP BY topic, reason, q),
gaps AS (SELECT f.topic, f.reason, min(tax_type) AS tax_type, count(*) AS occurrences FROM f GROUP BY f.topic, f.reason)"""


@query(f"""WITH {GAP_SQL} SELECT g.topic, g.reason, g.tax_type, g.occurrences, s.samples FROM gaps g
JOIN (SELECT topic, reason, string_agg(q, '|' ORDER BY n) AS samples FROM q WHERE n <= 5 GROUP BY topic, reason) s ON s.topic = g.topic AND s.reason = g.reason""")
def gap_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).withColumn("samples", F.array_join("samples", "|"))


@query(f"""WITH {GAP_SQL},
l AS (SELECT event_type, ts, event_id, value FROM events WHERE value > 10 AND ts >= TIMESTAMP '2024-01-10')
SELECT {TOPIC_SQL} AS topic, CASE WHEN value > 20 THEN 'degraded' ELSE 'low_confidence' END AS reason, count(*) AS occurrences FROM l GROUP BY 1, 2""")
def gap_clusters_latest(spark, sf_dir):
    """The report over the failures from a day on."""
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return E.gap_clusters(_records(spark, sf_dir), since).select("topic", "reason", "occurrences")


@query(f"""WITH {GAP_SQL},
supply AS (SELECT CASE WHEN n_chars % 2 = 0 THEN '增值税' ELSE '土地增值税' END AS t, count(*) AS c FROM ({REGULATION_SQL}) r WHERE review_state = 'published' GROUP BY 1)
SELECT coalesce(tax_type, '未标注') AS tax_type, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS topics, coalesce(min(c), 0) AS published_regulations
FROM gaps LEFT JOIN supply ON t = tax_type GROUP BY tax_type""")
def gap_by_type(spark, sf_dir):
    regs = regulations(spark, sf_dir).withColumn(
        "tax_types", F.array(F.when(F.col("n_chars") % 2 == 0, "增值税").otherwise("土地增值税"))
    )
    return E.gaps_by_type(_clusters(spark, sf_dir), regs)


@query(f"""WITH {GAP_SQL}
SELECT topic, reason, tax_type, CAST(occurrences * 2 AS BIGINT) AS recorded, occurrences AS persisted FROM gaps""")
def gap_upsert(spark, sf_dir):
    """The clusters merged into themselves: record adds, persist replaces."""
    gaps = _clusters(spark, sf_dir).select("topic", "reason", "tax_type", "occurrences", "samples")
    record = E.upsert_gaps(gaps, gaps, "record").select("topic", "reason", "tax_type", F.col("occurrences").alias("recorded"))
    persist = E.upsert_gaps(gaps, gaps, "persist").select("topic", "reason", F.col("occurrences").alias("persisted"))
    return record.join(persist, ["topic", "reason"])


@query(f"""SELECT {TOPIC_SQL} AS topic, 'user_feedback' AS reason, count(*) AS occurrences FROM events WHERE value <= 3 GROUP BY 1""")
def feedback_gaps(spark, sf_dir):
    log = _records(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), (F.col("value") > 3).alias("helpful")), "record_id"
    )
    return E.feedback_gaps(log).select("topic", "reason", "occurrences")


# ---- health, digest, audit log, tree


@query(f"""
WITH r AS (SELECT doc_id, effect_status, publish_date, n_chars, document_number FROM ({REGULATION_SQL}) x),
s AS (SELECT *, effect_status = 'repealed' AS a, publish_date + 1000 <= DATE '2024-06-30' AS b, document_number IS NULL AS c,
  doc_id NOT IN (SELECT doc_id FROM labels) AS d, DATE '2024-06-30' - publish_date > 365 AS e FROM r)
SELECT doc_id, greatest(100.0 - 60 * a::INT - 30 * b::INT - 15 * c::INT - 10 * d::INT - 10 * e::INT, 0.0)::DOUBLE AS score,
  concat_ws(',', CASE WHEN a THEN 'not_citable' END, CASE WHEN b THEN 'expired' END, CASE WHEN c THEN 'no_source' END,
    CASE WHEN d THEN 'no_articles' END, CASE WHEN e THEN 'stale' END) AS signals FROM s
""")
def health_score(spark, sf_dir):
    regs = regulations(spark, sf_dir).select(
        F.col("doc_id").alias("regulation_id"),
        "effect_status",
        F.date_add("publish_date", 1000).alias("expiry_date"),
        F.col("document_number").alias("source_url"),
        F.col("publish_date").alias("updated_at"),
    )
    articles = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("regulation_id"))
    scored = E.health(regs, articles, F.lit("2024-06-30").cast("date"))
    return scored.select(F.col("regulation_id").alias("doc_id"), "score", F.array_join("signals", ",").alias("signals"))


DIGEST = {"signup": "new_regulation", "view": "interpretation", "click": "amended", "error": "repealed", "purchase": "other"}


@query("""
WITH n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 9 END AS importance FROM n
""")
def change_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", lookup(F.col("event_type"), DIGEST).alias("event_type"), F.col("ts").alias("created_at")
    )
    digest = E.change_digest(rows, F.lit("2024-01-10").cast("timestamp_ntz"))
    return digest.select("event_id", "importance")


@query("""SELECT event_id AS log_id, user_id AS actor, ts AS occurred_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def audit_page(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at")
    )
    return E.audit_page(log, 100, action="error").select("log_id", "actor", "occurred_at")


@query("""
SELECT 'r' || r_regionkey AS id, 0 AS depth, 'r' || r_regionkey AS root FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 2, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'c' || c_custkey, CASE WHEN n_nationkey IS NULL THEN 0 ELSE 2 END, coalesce('r' || n_regionkey, 'c' || c_custkey) FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def article_tree(spark, sf_dir):
    """Regions, nations, suppliers and customers as one tree."""

    def node(name, prefix, key, parent):
        up = F.concat(F.lit(parent[0]), F.col(parent[1])) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), up.alias("parent"))

    nodes = (
        node("region", "r", "r_regionkey", None)
        .unionByName(node("nation", "n", "n_nationkey", ("r", "n_regionkey")))
        .unionByName(node("supplier", "s", "s_suppkey", ("n", "s_nationkey")))
        .unionByName(node("customer", "c", "c_custkey", ("n", "c_nationkey")))
    )
    return S.article_tree(nodes, "id", "parent").select("id", "depth", "root")


@query("""
WITH RECURSIVE base AS (SELECT doc_id, CASE WHEN doc_id = 0 THEN NULL WHEN (doc_id // 4) % 17 = 5 THEN doc_id // 4 + 1000000000 ELSE doc_id // 4 END AS parent,
  CAST(n_chars % 10 AS BIGINT) AS place FROM documents),
t AS (SELECT doc_id AS root, doc_id, 0 AS d, [place, doc_id] AS path FROM base WHERE parent IS NULL OR parent NOT IN (SELECT doc_id FROM base)
  UNION ALL SELECT t.root, b.doc_id, d + 1, path || [b.place, b.doc_id] FROM t JOIN base b ON b.parent = t.doc_id),
v AS (SELECT doc_id, 2 * count(*) AS n FROM labels GROUP BY doc_id)
SELECT root AS doc_id, count(*) AS nodes, max(d) + 1 AS levels, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY path)) AS preorder,
  CAST(sum(coalesce(v.n, 0)) AS BIGINT) AS versions FROM t LEFT JOIN v USING (doc_id) GROUP BY root
""")
def article_nested(spark, sf_dir):
    """Documents as a tree of four children each, with repeated rows and missing parents, and the labels as versions."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    up = F.expr("doc_id div 4")
    parent = F.when(key > 0, F.when(up % 17 == 5, up + 1_000_000_000).otherwise(up))
    nodes = docs.select("doc_id", parent.alias("parent"), (F.col("n_chars") % 10).cast("long").alias("place"))
    again = nodes.filter(key % 9 == 0).withColumn("place", F.col("place") + 100)
    versions = table(spark, sf_dir, "labels").select("doc_id", F.inline(F.expr("array(struct(1 AS version, quality AS mark), struct(2 AS version, toxic AS mark))")))
    rows = N.nested_tree(nodes.unionByName(again), versions, "doc_id", "parent", "place")
    listed = F.regexp_extract_all("tree", F.lit(r'"doc_id":(\d+)'), F.lit(1))
    return rows.select(
        "doc_id", "nodes", "levels", F.md5(F.array_join(listed, ",")).alias("preorder"), F.regexp_count("tree", F.lit('"version":')).cast("long").alias("versions")
    )
