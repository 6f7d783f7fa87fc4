"""Registered queries of streams and sinks; each equals its batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import lookup
from lexframe.operators import retrieval as R
from lexframe.plans.base import Family
from lexframe.plans.bindings import REGULATION_SQL, regulations, table
from lexframe.plans.evolve import TOPIC_SQL, WORDS
from lexframe.plans.retrieval import LIVE
from lexframe.session import fresh_path
from lexframe.sources import inbox_source as Ib
from lexframe.sources import readers as Rd
from lexframe.sources import writers as Wr
from lexframe.streaming import deadlines as D
from lexframe.streaming import jobs as J

family = Family()
query = family.query

BUCKETS = 8


def _events(spark, sf_dir):
    return J.stream_table(spark, sf_dir, "events.parquet")


#: Batches that a log is replayed in, each with rows up to 50 minutes late.
BATCHES = 4


def _growing(spark, sf_dir):
    """The events as they would have landed, a file for each batch, and their folder."""
    path = fresh_path(spark, "landing")
    return J.land_in_order(table(spark, sf_dir, "events"), "ts", path, BATCHES), path


@query("""
SELECT DISTINCT 'https://example.org/' || event_type || '/' || user_id AS url FROM events
WHERE 'https://example.org/' || event_type || '/' || user_id NOT IN (SELECT 'https://example.org/view/' || c_custkey FROM customer)
""")
def stream_dedup(spark, sf_dir):
    """Event pages as a listing stream over several batches; a page listed again, hours or days later, comes once."""
    rows = _growing(spark, sf_dir)[0].select(
        F.concat(F.lit("https://example.org/"), "event_type", F.lit("/"), "user_id").alias("url"), "ts"
    )
    known = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://example.org/view/"), "c_custkey").alias("url")
    )
    return J.run(rows, "dedup", step=J.first_listed(known, "url", "ts")).select("url")


LIFE_SQL = """
life AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS opened_at, min(ts) FILTER (event_type = 'purchase') AS closed_at FROM events GROUP BY user_id)"""


@query(f"""WITH {LIFE_SQL} SELECT user_id, CASE WHEN closed_at IS NOT NULL THEN CASE WHEN date_diff('second', opened_at, closed_at) <= 86400 THEN 'in_time' ELSE 'late' END
  ELSE CASE WHEN date_diff('second', opened_at, TIMESTAMP '2024-02-01') > 86400 THEN 'overdue' ELSE 'open' END END AS state FROM life WHERE opened_at IS NOT NULL""")
def stream_sla(spark, sf_dir):
    """Sign-up to purchase within 24 hours per user."""
    kind = F.col("event_type")
    rows = J.lifecycle(_events(spark, sf_dir), "user_id", "ts", kind == "signup", kind == "purchase")
    done = J.newest(J.run(rows, "sla", "update"), ["user_id"])
    return J.sla(done, 24, F.lit("2024-02-01").cast("timestamp_ntz")).select("user_id", "state")


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) - to_minutes(10 * k) AS window_start, event_type FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) s)
SELECT window_start, count(*) AS answers, count(*) FILTER (event_type = 'error') AS blocked,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS rate FROM w GROUP BY window_start
""")
def stream_rate(spark, sf_dir):
    rows = J.interception_rate(_events(spark, sf_dir), "ts", F.col("event_type") == "error")
    done = J.newest(J.run(rows, "rate", "update"), ["window_start"])
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""SELECT {TOPIC_SQL} AS topic, CASE WHEN value > 20 THEN 'degraded' ELSE 'low_confidence' END AS reason, count(*) AS occurrences
FROM events WHERE value > 10 GROUP BY 1, 2""")
def stream_gaps(spark, sf_dir):
    failed = _events(spark, sf_dir).filter(F.col("value") > 10)
    rows = failed.withColumn("question", lookup(F.col("event_type"), WORDS))
    rows = T.add_gap_topic(rows)
    reason = F.when(F.col("value") > 20, "degraded").otherwise("low_confidence")
    return J.newest(J.run(J.gap_counts(rows, F.col("topic"), reason), "gaps", "update"), ["topic", "reason"])


@query("""
WITH life AS (SELECT event_id, ts, event_type FROM events)
SELECT event_id, 'downgraded' AS mark FROM life WHERE event_type IN ('signup', 'view') AND date_diff('second', ts, TIMESTAMP '2024-01-20') > 86400
""")
def stream_overdue(spark, sf_dir):
    """Reviews opened by events; sign-ups and views never get a decision. The mark comes from a timer, without a
    further event."""
    kind = F.col("event_type")
    stream = _growing(spark, sf_dir)[0]
    marks = D.marks(stream, "event_id", "ts", F.lit(True), kind.isin("click", "purchase", "error"), 24)
    done = J.run(marks, "overdue", settings=D.STORE_CHOICE).filter(F.col("state") == "overdue")
    due = F.col("opened_at") + F.expr("INTERVAL 24 HOURS")
    return done.filter(due < F.lit("2024-01-20").cast("timestamp")).select("event_id", F.lit("downgraded").alias("mark"))


@query("""
WITH RECURSIVE ev AS (SELECT user_id, ts, event_type = 'signup' AS o FROM events WHERE event_type IN ('signup', 'purchase')),
raw AS (
  SELECT user_id, min(ts) AS opened_at FROM ev WHERE o GROUP BY user_id
  UNION ALL
  SELECT user_id, min(ts) AS opened_at FROM (
    SELECT r.user_id, ev.ts, r.opened_at,
      (SELECT min(c.ts) FROM ev c WHERE c.user_id = r.user_id AND NOT c.o AND c.ts >= r.opened_at AND c.ts <= r.opened_at + INTERVAL 24 HOURS) AS closed_at
    FROM raw r JOIN ev ON ev.user_id = r.user_id AND ev.o) s
  WHERE ts > coalesce(closed_at, opened_at + INTERVAL 24 HOURS) GROUP BY user_id
)
SELECT user_id, opened_at, CASE WHEN EXISTS (SELECT 1 FROM ev c WHERE c.user_id = r.user_id AND NOT c.o AND c.ts >= r.opened_at
  AND c.ts <= r.opened_at + INTERVAL 24 HOURS) THEN 'in_time' ELSE 'overdue' END AS state FROM raw r
""")
def stream_deadlines(spark, sf_dir):
    """Every sign-up of a user without one open, and whether a purchase followed within 24 hours. The job is stopped
    after the last event and goes on from its marks with a row of the clock, which lets the last timers run."""
    base = fresh_path(spark, "deadlines")
    stream, path = _growing(spark, sf_dir)
    opens, closes = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    J.run(D.marks(stream, "user_id", "ts", opens, closes, 24), "deadlines", folder=base, settings=D.STORE_CHOICE)
    clock = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 26 HOURS")).alias("ts"))
    tick = clock.select("ts", F.lit(-1).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"))
    tick.write.mode("append").parquet(path)
    done = J.run(D.marks(stream, "user_id", "ts", opens, closes, 24), "deadlines", folder=base, settings=D.STORE_CHOICE)
    return done.select("user_id", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"), "state")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started_at, count(*) AS asks FROM s GROUP BY user_id, n
""")
def stream_sessions(spark, sf_dir):
    """Closed sessions from the stream, over several batches, and the open ones from the log after them."""
    closed = J.run(J.sessions(_growing(spark, sf_dir)[0], "user_id", "ts"), "sessions").drop("batch_id")
    rows = closed.unionByName(J.open_sessions(closed, table(spark, sf_dir, "events"), "user_id", "ts"))
    return rows.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "asks")


# ---- index refresh and sinks


def _entries(rows):
    dated = rows.withColumns({"valid_from": F.col("publish_date"), "valid_to": F.lit(None).cast("date")})
    return R.index_entries(dated, version_id="doc_id", title="title").select(
        "doc_id", "point_id", "effect_status", "content_hash"
    )


REFRESH_SQL = f"""
SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS digest FROM ({REGULATION_SQL}) r WHERE {LIVE} AND length(trim(content, ' ')) > 0"""


@query(REFRESH_SQL)
def stream_index(spark, sf_dir):
    """An index built before the reviews catches up with the label stream: it starts from
    every document as published and effective."""
    path = fresh_path(spark, "index")
    rows = regulations(spark, sf_dir)
    before = rows.withColumns({"review_state": F.lit("published"), "effect_status": F.lit("effective")})
    reviewed = table(spark, sf_dir, "labels").select("doc_id")
    unreviewed = rows.join(reviewed, "doc_id", "left_anti").select("doc_id")
    Wr.create_index(_entries(before), path, "doc_id", BUCKETS)
    decisions = J.stream_table(spark, sf_dir, "labels.parquet").select("doc_id")
    J.refresh_index(decisions, _entries(rows), path, "doc_id", BUCKETS)
    # Documents without a decision are taken down by one batch refresh.
    Wr.reindex(unreviewed, _entries(rows), path, "doc_id", BUCKETS)
    return Wr.open_index(spark, path).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("digest"))


@query(f"""
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'repealed' ELSE 'effective' END AS effect_status, lang AS domain_id
FROM ({REGULATION_SQL}) r WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1)
""")
def sink_roundtrip(spark, sf_dir):
    """Corpus written by domain, read back, published as a snapshot, payload updated, and
    one class of documents rejected on the way."""
    path = fresh_path(spark, "sink")
    rows = regulations(spark, sf_dir).select("doc_id", "title", F.col("lang").alias("domain_id"), "content")
    labels = table(spark, sf_dir, "labels")
    bad = labels.filter((F.col("quality") == 0) & (F.col("toxic") == 1)).select("doc_id", F.lit("rejected").alias("reject_reason"))
    Wr.write_cleaned(rows.join(bad, "doc_id", "left"), f"{path}/clean")
    kept = spark.read.parquet(f"{path}/clean").filter(F.col("reject_reason").isNull()).withColumn("level_code", F.lit("article"))
    Wr.write_corpus(kept.select("doc_id", "domain_id", "title"), kept.select("doc_id", "domain_id"),
                    kept.select("doc_id", "domain_id", "level_code", "content"), f"{path}/corpus")
    versions = spark.read.parquet(f"{path}/corpus/versions").withColumn("effect_status", F.lit("effective"))
    Wr.publish_snapshot(versions, f"{path}/index", ("domain_id",))
    toxic = labels.filter(F.col("toxic") == 1).select("doc_id", F.lit("repealed").alias("effect_status"))
    return Wr.update_payload(Wr.read_index(spark, f"{path}/index"), toxic, "doc_id").select(
        "doc_id", "effect_status", "domain_id"
    )


@query("""SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS text_md5 FROM documents""")
def inbox_source(spark, sf_dir):
    """Documents as files of an inbox, read by the data source as a stream that is stopped and goes on. The second
    half of the names arrives while it is down."""
    named = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    folder, base = fresh_path(spark, "inbox"), fresh_path(spark, "inbox-stream")
    Ib.register(spark)
    for late in (False, True):
        part = named.filter((F.col("name") >= "5") == late)
        part.foreachPartition(lambda rows: Ib.put_files(folder, ((r["name"], r["text"]) for r in rows)))
        stream = spark.readStream.format("lex_inbox").load(folder)
        done = J.run(stream, "inbox", folder=base)
    return done.select("name", "size", F.md5("content").alias("text_md5"))


@query("""SELECT doc_id, md5(text) AS text_md5, source AS collection FROM documents""")
def inbox_roundtrip(spark, sf_dir):
    """Documents landed as bundle lines, read back through the bundle reader."""
    path = fresh_path(spark, "bundle")
    docs = table(spark, sf_dir, "documents")
    entry = F.struct("doc_id", F.lit("CN").alias("jurisdiction"), F.col("text").alias("content"), F.col("source").alias("collection"))
    docs.select(F.array(entry).alias("documents")).write.json(path)
    lines = spark.read.json(path)
    rows = lines.select(F.explode("documents").alias("d")).select("d.*").filter(F.col("jurisdiction") == "CN")
    return rows.select("doc_id", F.md5("content").alias("text_md5"), "collection")


@query("""
WITH m AS (SELECT page_id, url, regexp_extract(url, '/([a-z]+)/', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, lang, nullif(trim(title), '') AS title FROM m
""")
def listing_meta(spark, sf_dir):
    """Nested listing metadata flattened: the first value of a key wins, blanks go."""
    pages = table(spark, sf_dir, "pages")

    def pair(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    lang = F.regexp_extract("url", "/([a-z]+)/", 1)
    groups = F.array(
        F.struct(F.array(pair("lang", F.lit("null")), pair("lang", lang), pair("title", title)).alias("resultList")),
        F.struct(F.array(pair("lang", F.lit("xx")), pair("empty", F.lit(" "))).alias("resultList")),
    )
    rows = pages.select("page_id", Rd.flatten_meta(groups).alias("m"))
    return rows.select("page_id", F.col("m")["lang"].alias("lang"), F.col("m")["title"].alias("title"))
