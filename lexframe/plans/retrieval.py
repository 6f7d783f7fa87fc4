"""Registered queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import clusters as C
from lexframe.functions import impact as I
from lexframe.functions import vectors as V
from lexframe.functions import text as T
from lexframe.operators import retrieval as R
from lexframe.operators import search as S
from lexframe.operators.matching import passages_in_texts
from lexframe.plans.base import Family
from lexframe.plans.bindings import REGULATION_SQL, regulations, table
from lexframe.session import cut_lineage
from lexframe.sources import bucketed as B

family = Family()
query = family.query

LIVE = "review_state = 'published' AND effect_status IN ('effective', 'partially_repealed')"
STATUS_RANK_SQL = """CASE effect_status WHEN 'effective' THEN 0 WHEN 'partially_repealed' THEN 1 ELSE 2 END"""
LEVEL_RANK_SQL = """CASE hierarchy_level WHEN 'law' THEN 0 WHEN 'administrative_regulation' THEN 1
  WHEN 'departmental_rule' THEN 2 WHEN 'normative_document' THEN 3 WHEN 'local_normative' THEN 4 ELSE 5 END"""
SEARCH_LIMIT = 50


# ---- filters, pages, counts


@query(f"""
SELECT doc_id, title, hierarchy_level, effect_status, publish_date FROM ({REGULATION_SQL}) r
WHERE {LIVE} AND publish_date <= DATE '2024-06-30'
  AND hierarchy_level IN ('law', 'administrative_regulation', 'departmental_rule', 'normative_document')
  AND (contains(content, 'tion') OR contains(title, 'tion')) AND lang IN ('en', 'fr')
ORDER BY {STATUS_RANK_SQL}, {LEVEL_RANK_SQL}, publish_date DESC, doc_id LIMIT {SEARCH_LIMIT}
""")
def structured_search(spark, sf_dir):
    rows = regulations(spark, sf_dir)
    keep = R.hard_filter(
        hierarchy=("law", "administrative_regulation", "departmental_rule", "normative_document"),
        as_of=F.lit("2024-06-30").cast("date"),
        start="publish_date",
        end="_open",
    )
    return (
        rows.withColumn("_open", F.lit(None).cast("date"))
        .filter(keep & F.col("lang").isin("en", "fr"))
        .filter(R.keyword_match("tion", F.col("content"), F.col("title")))
        .orderBy(*R.structured_order(), "doc_id")
        .limit(SEARCH_LIMIT)
        .select("doc_id", "title", "hierarchy_level", "effect_status", "publish_date")
    )


@query(f"""
WITH hits AS (SELECT doc_id, title, publish_date FROM ({REGULATION_SQL}) r
  WHERE contains(lower(title), 'the') OR contains(lower(content), 'the'))
SELECT doc_id, title, publish_date, (SELECT count(*) FROM hits) AS total_rows FROM hits
ORDER BY publish_date DESC, doc_id LIMIT 20 OFFSET 40
""")
def list_page(spark, sf_dir):
    rows = regulations(spark, sf_dir)
    hits = rows.filter(
        R.keyword_match("THE", F.col("title"), F.col("content"), ignore_case=True)
    ).select("doc_id", "title", "publish_date")
    return R.page(hits, [F.col("publish_date").desc(), F.col("doc_id")], 20, 40)


@query(f"""
SELECT effect_status, review_state, count(*) AS regulations, sum(count(*)) OVER ()::BIGINT AS total
FROM ({REGULATION_SQL}) r GROUP BY effect_status, review_state
""")
def status_counts(spark, sf_dir):
    rows = regulations(spark, sf_dir).groupBy("effect_status", "review_state").agg(
        F.count(F.lit(1)).alias("regulations")
    )
    return rows.withColumn("total", rows.agg(F.sum("regulations")).scalar())


@query(f"""
SELECT (SELECT count(*) FROM ({REGULATION_SQL}) r) AS regulations,
  (SELECT count(*) FROM ({REGULATION_SQL}) r WHERE {LIVE}) AS citable_published,
  (SELECT max(publish_date) FROM ({REGULATION_SQL}) r WHERE {LIVE}) AS knowledge_as_of,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_reviews,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS open_gaps,
  (SELECT arg_max(event_id, ts) FROM events) AS latest_run
""")
def overview(spark, sf_dir):
    rows = regulations(spark, sf_dir)
    live = R.hard_filter()
    events = table(spark, sf_dir, "events")
    orders = table(spark, sf_dir, "orders")
    facts = rows.agg(
        F.count(F.lit(1)).alias("regulations"),
        F.count_if(live).alias("citable_published"),
        F.max(F.when(live, F.col("publish_date"))).alias("knowledge_as_of"),
    )
    return facts.select(
        "*",
        orders.agg(F.count_if(F.col("o_orderstatus") == "P")).scalar().alias("pending_reviews"),
        events.agg(F.count_if(F.col("event_type") == "error")).scalar().alias("open_gaps"),
        events.agg(F.max_by("event_id", "ts")).scalar().alias("latest_run"),
    )


# ---- citations and index rows


@query(f"""
SELECT doc_id, coalesce(document_number, CASE WHEN hierarchy_level IN ('law', 'administrative_regulation')
    THEN nullif(title, '') END, '') AS identifier,
  coalesce(document_number, CASE WHEN hierarchy_level IN ('law', 'administrative_regulation')
    THEN nullif(title, '') END, '') <> '' AS traceable,
  coalesce(document_number, nullif(title, ''), '未标注文号') || ' ' || hierarchy_level || '-' || lang AS label,
  effect_status = 'repealed' AS repealed
FROM ({REGULATION_SQL}) r
""")
def citation_projection(spark, sf_dir):
    rows = regulations(spark, sf_dir).withColumns(
        {
            "regulation_title": F.col("title"),
            "full_no": F.concat_ws("-", "hierarchy_level", "lang"),
        }
    )
    return R.citation_columns(rows).select(
        "doc_id",
        "identifier",
        "traceable",
        "label",
        (F.col("effect_status") == "repealed").alias("repealed"),
    )


@query(f"""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
    || '-' || substr(h, 21, 12) AS point_id, sha256(content) AS content_hash,
  CAST(length(title) + 1 + length(trim(content, ' ')) AS BIGINT) AS dense_chars,
  CAST(epoch(publish_date) AS BIGINT) AS valid_from_ts
FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM ({REGULATION_SQL}) x) r
WHERE {LIVE} AND length(trim(content, ' ')) > 0
""")
def index_entries(spark, sf_dir):
    rows = regulations(spark, sf_dir).withColumns(
        {"valid_from": F.col("publish_date"), "valid_to": F.lit(None).cast("date")}
    )
    entries = R.index_entries(rows, version_id="doc_id", title="title")
    return entries.select(
        "doc_id",
        "point_id",
        "content_hash",
        F.length("dense_text").cast("long").alias("dense_chars"),
        "valid_from_ts",
    )


# Lines of a document as its articles, each with a version that starts so many days after the document.
LINES_SQL = f"""
lines AS (SELECT *, row_number() OVER () AS _r FROM (SELECT r.*, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS article_no FROM ({REGULATION_SQL}) r) x),
joined AS (SELECT doc_id AS regulation_id, article_no, title, hierarchy_level, review_state, effect_status, publish_date + CAST(article_no AS INTEGER) AS valid_from, line AS content FROM lines)"""


def _bucketed(spark, sf_dir):
    """The corpus of documents, lines and versions, bucketed alike; written once per session and input."""
    mark = (spark.sparkContext.applicationId, sf_dir)
    if mark not in _BUCKETED:
        rows = regulations(spark, sf_dir).withColumnRenamed("doc_id", "regulation_id")
        lines = rows.select("regulation_id", "publish_date", F.posexplode(F.split("content", "\n")).alias("at", "content"))
        lines = lines.withColumn("article_no", (F.col("at") + 1).cast("long"))
        articles = lines.select("regulation_id", "article_no", F.concat(F.lit("line "), "article_no").alias("full_no"), F.lit("article").alias("level_code"))
        start = F.date_add("publish_date", F.col("article_no").cast("int"))
        versions = lines.select("regulation_id", "article_no", "content", start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        _BUCKETED[mark] = B.write_bucketed(rows.drop("content"), articles, versions, 16)
    return _BUCKETED[mark]


_BUCKETED: dict = {}


@query(f"""
WITH {LINES_SQL} SELECT regulation_id, article_no, hierarchy_level, valid_from, md5(content) AS content_md5 FROM joined
WHERE {LIVE} AND valid_from <= DATE '2024-06-30' AND contains(content, 'tion')
""")
def structured_articles(spark, sf_dir):
    """Articles in force with a word, from versions, articles and regulations joined in their buckets."""
    rows = _bucketed(spark, sf_dir).joined(spark)
    keep = R.hard_filter(as_of=F.lit("2024-06-30").cast("date")) & R.keyword_match("tion", F.col("content"))
    return rows.filter(keep).select("regulation_id", "article_no", "hierarchy_level", "valid_from", F.md5("content").alias("content_md5"))


@query(f"""
WITH {LINES_SQL} SELECT regulation_id, article_no, md5(title || chr(10) || trim(content, ' ')) AS dense_md5, CAST(epoch(valid_from) AS BIGINT) AS valid_from_ts
FROM joined WHERE {LIVE} AND length(trim(content, ' ')) > 0
""")
def index_entries_joined(spark, sf_dir):
    """Index rows of all article versions, read from the same join."""
    rows = _bucketed(spark, sf_dir).joined(spark).withColumn("version_id", F.concat_ws("-", "regulation_id", "article_no"))
    entries = R.index_entries(rows, title="title")
    return entries.select("regulation_id", "article_no", F.md5("dense_text").alias("dense_md5"), "valid_from_ts")


@query(f"""
WITH {LINES_SQL} SELECT regulation_id, article_no, md5(content) AS content_md5 FROM joined WHERE 'line ' || article_no = 'line 12' AND {LIVE}
""")
def article_number_search(spark, sf_dir):
    """One article number in all regulations in force."""
    rows = _bucketed(spark, sf_dir).joined(spark).filter(R.hard_filter())
    hit = rows.filter(R.article_match(F.col("full_no"), F.col("full_no"), "line 12"))
    return hit.filter(F.col("full_no") == "line 12").select("regulation_id", "article_no", F.md5("content").alias("content_md5"))


@query(f"""
SELECT doc_id, source FROM documents WHERE contains(text, 'tion') AND doc_id IN (
  SELECT doc_id FROM ({REGULATION_SQL}) r WHERE {LIVE})
""")
def semi_recheck(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").filter(F.col("text").contains("tion"))
    return R.recheck(
        hits.select("doc_id", "source"), regulations(spark, sf_dir), "doc_id"
    )


@query(f"""
WITH e AS (SELECT doc_id FROM ({REGULATION_SQL}) r WHERE {LIVE}),
i AS (SELECT doc_id FROM labels WHERE toxic = 0 OR quality = 1)
SELECT (SELECT count(*) FROM e WHERE doc_id IN (SELECT doc_id FROM i)) AS in_both,
  (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM i)) AS missing_in_index,
  (SELECT count(*) FROM i WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS stale_in_index
""")
def index_drift(spark, sf_dir):
    expected = regulations(spark, sf_dir).filter(R.hard_filter()).select("doc_id")
    indexed = table(spark, sf_dir, "labels").filter((F.col("toxic") == 0) | (F.col("quality") == 1))
    return R.index_drift(expected, indexed, "doc_id")


# ---- vectors

TOKEN_SQL = r"regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:[.\-][0-9]+)*')"
POSTINGS_SQL = f"""
dw AS (SELECT doc_id, term, count(*) AS tf, sqrt(count(*)) AS w FROM (
  SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents) t GROUP BY doc_id, term),
qw AS (SELECT item_id AS question_id, term, sqrt(count(*)) AS w FROM (
  SELECT item_id, unnest({TOKEN_SQL}) AS term FROM benchmark) t GROUP BY item_id, term)"""
DOT_SQL = f"""
{POSTINGS_SQL},
dots AS (SELECT question_id, doc_id, round(sum(q.w * d.w), 6) AS score, count(*) AS shared
  FROM qw q JOIN dw d ON d.term = q.term GROUP BY question_id, doc_id)"""


@query(f"WITH {POSTINGS_SQL} SELECT doc_id, term, tf, round(w, 6) AS weight FROM dw")
def sparse_vectors(spark, sf_dir):
    rows = V.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumn("weight", F.round("weight", 6))


@query(f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents) t
GROUP BY doc_id
""")
def hashed_sparse_vectors(spark, sf_dir):
    """The squared length of a hashed vector is the token count, whatever collides."""
    rows = V.sparse_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(
        F.round(F.sum(F.col("weight") * F.col("weight"))).cast("long").alias("tokens")
    )


DENSE_SQL = """
WITH parts AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT label AS question_id, list(m ORDER BY i) AS c FROM (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY label, i) s GROUP BY label),
scored AS (SELECT question_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS s
  FROM embeddings, centre)
SELECT question_id, vec_id, rank FROM (SELECT question_id, vec_id, row_number() OVER (
  PARTITION BY question_id ORDER BY s DESC, vec_id) AS rank FROM scored) r WHERE rank <= 10
"""


def _vectors(spark, sf_dir):
    """All vectors, and the centroid of each label as a question."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias(
            "vector"
        )
    )
    corpus = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return corpus, centres.withColumnRenamed("label", "question_id")


@query(DENSE_SQL)
def dense_topk(spark, sf_dir):
    """The ten vectors nearest to the centroid of each label, over all vectors."""
    corpus, centres = _vectors(spark, sf_dir)
    return V.dense_topk(corpus, centres, 10, d_key="vec_id").select("question_id", "vec_id", "rank")


@query(DENSE_SQL)
def dense_index_topk(spark, sf_dir):
    """The same by the clustered index, which goes on until no other cell can hold a better vector."""
    corpus, centres = _vectors(spark, sf_dir)
    index = C.build(corpus, "vec_id")
    return C.topk(index, centres, 10, exact=True).select("question_id", "vec_id", "rank")


@query("SELECT vec_id AS question_id, 10 AS found, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def dense_index_recall(spark, sf_dir):
    """Vectors as questions in the probed cells alone: how many rows each finds, and whether all together find
    nine in ten of the true neighbours."""
    corpus, _ = _vectors(spark, sf_dir)
    asked = corpus.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "question_id")
    index = C.build(corpus, "vec_id")
    probes = C.tuned_probes(index, corpus, asked, 10)
    near = C.topk(index, asked, 10, probes=probes).select("question_id", "vec_id")
    true = V.dense_topk(corpus, asked, 10, d_key="vec_id").select("question_id", "vec_id", F.lit(1).alias("hit"))
    per = near.join(true, ["question_id", "vec_id"], "left").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("found"), F.count("hit").alias("hits")
    )
    per = cut_lineage(per, "recall")
    share = per.agg(F.sum("hits") / F.sum("found")).scalar()
    return per.select("question_id", F.col("found").cast("int").alias("found"), (share >= 0.9).alias("enough"))


def _postings(spark, sf_dir):
    docs = V.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "question_id")
    return docs, V.term_weights(items, "question_id", "text")


SPARSE_SQL = f"""
WITH {DOT_SQL} SELECT question_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM dots) r WHERE rank <= 10
"""


@query(SPARSE_SQL)
def sparse_topk(spark, sf_dir):
    docs, items = _postings(spark, sf_dir)
    return V.sparse_topk(docs, items, 10)


@query(SPARSE_SQL)
def sparse_pruned_topk(spark, sf_dir):
    """The same, without scoring blocks that cannot enter the answer."""
    docs, items = _postings(spark, sf_dir)
    return I.pruned_topk(docs, items, 10, block_rows=50)[0]


@query(f"""
WITH {POSTINGS_SQL} SELECT question_id, count(*) AS postings, true AS pruned
FROM qw q JOIN dw d ON d.term = q.term GROUP BY question_id
""")
def sparse_pruning(spark, sf_dir):
    """The postings that each question shares with the corpus, and whether pruning left some unscored."""
    docs, items = _postings(spark, sf_dir)
    work = cut_lineage(I.pruned_topk(docs, items, 10, block_rows=50)[1], "work")
    pruned = work.agg(F.sum("scored") < F.sum("postings")).scalar()
    return work.select("question_id", "postings", pruned.alias("pruned"))


# ---- fusion and rerank: three routes for every benchmark question

ROUTES_SQL = f"""
{DOT_SQL},
semantic AS (SELECT question_id, doc_id, 'semantic' AS route, row_number() OVER (
  PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM dots),
-- set overlap: every shared term counts once
glossary AS (SELECT question_id, doc_id, 'glossary_expansion' AS route, row_number() OVER (
  PARTITION BY question_id ORDER BY shared DESC, doc_id) AS rank FROM dots),
structured AS (SELECT item_id AS question_id, doc_id, 'structured' AS route, row_number() OVER (
  PARTITION BY item_id ORDER BY doc_id) AS rank
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
routes AS (SELECT * FROM semantic WHERE rank <= 30 UNION ALL SELECT * FROM glossary WHERE rank <= 30
  UNION ALL SELECT * FROM structured WHERE rank <= 10),
rrf AS (SELECT question_id, doc_id, round(sum(CASE route WHEN 'structured' THEN 1.0 WHEN 'semantic' THEN 0.8
    ELSE 0.5 END::DOUBLE / (60 + rank)), 9) AS rrf,
  string_agg(route, ',' ORDER BY route) AS route_list, count(*) AS n_routes, min(rank) AS best_rank
  FROM routes GROUP BY question_id, doc_id),
fused AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY question_id), 9) AS score FROM rrf)"""


def _routes(spark, sf_dir):
    docs, items = _postings(spark, sf_dir)
    semantic = V.sparse_topk(docs, items, 30).withColumn("route", F.lit("semantic"))
    flat = V.sparse_topk(
        docs.withColumn("weight", F.lit(1.0)), items.withColumn("weight", F.lit(1.0)), 30
    ).withColumn("route", F.lit("glossary_expansion"))
    inside = passages_in_texts(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("question_id"), F.col("text").alias("passage")
        ),
        "doc_id",
        "text",
        "question_id",
        "passage",
    )
    structured = R.route(
        inside, "structured", "question_id", "doc_id", ["doc_id"], R.R.STRUCTURED_DEPTH
    )
    columns = ["question_id", "doc_id", "route", "rank"]
    return (
        semantic.select(*columns).unionByName(flat.select(*columns)).unionByName(structured)
    )


@query(f"""
WITH {ROUTES_SQL} SELECT question_id, doc_id, rrf, score, route_list, best_rank FROM fused
""")
def rrf_fusion(spark, sf_dir):
    fused = R.fuse(_routes(spark, sf_dir))
    return fused.select(
        "question_id",
        "doc_id",
        "rrf",
        "score",
        F.array_join("routes", ",").alias("route_list"),
        "best_rank",
    )


@query(f"""
WITH {ROUTES_SQL} SELECT question_id, count(*) FILTER (route = 'structured') AS structured,
  count(*) FILTER (route = 'semantic') AS semantic,
  count(*) FILTER (route = 'glossary_expansion') AS glossary_expansion FROM routes GROUP BY question_id
""")
def route_stats(spark, sf_dir):
    return R.route_stats(_routes(spark, sf_dir))


# Words of the synthetic texts stand in for the intents.
DRIVER_INTENTS = {"scope": ("hein", "ones"), "calculation": ("thin", "tion", "ment")}
DRIVER_HINTS = {"scope": ("tion", "heed", "anan"), "calculation": ("erst", "ingth")}


@query(f"""
WITH {ROUTES_SQL},
asked AS (SELECT b.item_id AS question_id, CASE
    WHEN contains(b.text, 'thin') THEN 'calculation'
    WHEN contains(b.text, 'hein') OR contains(b.text, 'tion') THEN CASE WHEN contains(b.text, 'hein') THEN 'scope' ELSE 'calculation' END
    WHEN contains(b.text, 'ones') THEN 'scope' WHEN contains(b.text, 'ment') THEN 'calculation'
    ELSE 'unknown' END AS intent,
  (SELECT arg_min(r.document_number, r.doc_id) FROM ({REGULATION_SQL}) r WHERE contains(r.content, b.text)) AS number
  FROM benchmark b),
hits AS (SELECT f.*, r.content, r.hierarchy_level, r.effect_status, r.document_number, r.publish_date, a.intent, a.number,
  CASE WHEN r.n_chars > 2000 THEN 'article' WHEN r.n_chars > 800 THEN 'paragraph' ELSE 'item' END AS level_code
  FROM fused f JOIN ({REGULATION_SQL}) r ON r.doc_id = f.doc_id JOIN asked a ON a.question_id = f.question_id
  WHERE {LIVE}),
boosted AS (SELECT *, greatest(round(score
    + CASE WHEN document_number = number THEN 0.5 ELSE 0.0 END
    + CASE WHEN DATE '2024-06-30' - publish_date BETWEEN 0 AND 365 THEN 0.2 ELSE 0.0 END
    + CASE WHEN hierarchy_level = 'local_normative' THEN -0.2 ELSE 0.0 END, 9), 0.0) AS boosted FROM hits),
scored AS (SELECT *, round(
   0.45::DOUBLE * (1.0::DOUBLE / (1.0 + 0.35::DOUBLE * (best_rank - 1)))
   + 0.20::DOUBLE * CASE intent WHEN 'scope' THEN least((contains(content, 'tion')::INT + contains(content, 'heed')::INT
        + contains(content, 'anan')::INT) / 2.0::DOUBLE, 1.0)
      WHEN 'calculation' THEN least((contains(content, 'erst')::INT + contains(content, 'ingth')::INT) / 2.0::DOUBLE, 1.0)
      ELSE 0.0 END
   + 0.13::DOUBLE * CASE WHEN n_routes >= 2 THEN least(n_routes / 3.0::DOUBLE, 1.0) ELSE 0.0 END
   + 0.12::DOUBLE * CASE hierarchy_level WHEN 'law' THEN 1.0 WHEN 'administrative_regulation' THEN 0.9
        WHEN 'departmental_rule' THEN 0.8 WHEN 'normative_document' THEN 0.75 WHEN 'local_normative' THEN 0.5 END::DOUBLE
   + 0.05::DOUBLE * CASE level_code WHEN 'article' THEN 1.0 WHEN 'paragraph' THEN 0.6 ELSE 0.4 END::DOUBLE
   + 0.05::DOUBLE * CASE effect_status WHEN 'effective' THEN 1.0 ELSE 0.5 END::DOUBLE, 4) AS rerank FROM boosted)
SELECT question_id, doc_id, intent, rerank, boosted, position FROM (SELECT *, row_number() OVER (
  PARTITION BY question_id ORDER BY rerank DESC, boosted DESC, doc_id) AS position FROM scored) s WHERE position <= 10
""")
def rerank_topn(spark, sf_dir):
    """Recheck, boosts and rerank of the fused hits of all benchmark questions."""
    items = table(spark, sf_dir, "benchmark")
    rows = regulations(spark, sf_dir).filter(R.hard_filter())
    numbers = (
        passages_in_texts(
            table(spark, sf_dir, "documents"),
            items.select("item_id", F.col("text").alias("passage")),
            "doc_id",
            "text",
            "item_id",
            "passage",
        )
        .join(regulations(spark, sf_dir).select("doc_id", "document_number"), "doc_id")
        .groupBy(F.col("item_id").alias("question_id"))
        .agg(
            F.min_by(
                "document_number", F.when(F.col("document_number").isNotNull(), F.col("doc_id"))
            ).alias("query_document_number")
        )
    )
    asked = items.select(
        F.col("item_id").alias("question_id"),
        R.retrieval_intent(F.col("text"), DRIVER_INTENTS).alias("intent"),
    ).join(numbers, "question_id", "left")
    n = F.col("n_chars")
    level = F.when(n > 2000, "article").when(n > 800, "paragraph").otherwise("item")
    hits = (
        R.fuse(_routes(spark, sf_dir))
        .join(rows, "doc_id")
        .join(asked, "question_id")
        .withColumns({"valid_from": F.col("publish_date"), "level_code": level})
    )
    boosted = R.boost(hits, F.lit("2024-06-30"))
    return R.rerank(boosted, hints=DRIVER_HINTS).select(
        "question_id", "doc_id", "intent", "rerank", "boosted", "position"
    )


# ---- embeddings and the whole search

SEARCH_DIM = 64
SEARCH_TERMS = (("hein", "thein", ("the",)), ("ones", "tiones", ("tion",)))
SEARCH_NAMES = ("thand", "keit")


@query("SELECT doc_id, 64 AS dim, 1.0::DOUBLE AS norm FROM documents")
def dense_hash_embed(spark, sf_dir):
    """Unit vectors of all documents from the hash embedder."""
    rows = V.dense_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", dim=SEARCH_DIM)
    square = F.aggregate(
        F.col("vector"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    return rows.select(
        "doc_id", F.size("vector").alias("dim"), F.round(F.sqrt(square), 4).alias("norm")
    )


@query()
def hybrid_search(spark, sf_dir):
    """All benchmark questions over all citable documents, three routes to citations."""
    n = F.col("n_chars")
    corpus = regulations(spark, sf_dir).withColumns(
        {
            "valid_from": F.col("publish_date"),
            "valid_to": F.lit(None).cast("date"),
            "tax_types": T.detect_names(F.col("content"), SEARCH_NAMES),
            "level_code": F.when(n > 2000, "article").when(n > 800, "paragraph").otherwise("item"),
            "full_no": F.lit("全文"),
        }
    )
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("long").alias("question_id"), "text", F.lit("2026-06-30").cast("date").alias("as_of")
    )
    found = S.hybrid_search(
        questions,
        S.index_tables(corpus, dim=SEARCH_DIM),
        dim=SEARCH_DIM,
        names=SEARCH_NAMES,
        terms=SEARCH_TERMS,
        intents=DRIVER_INTENTS,
        hints=DRIVER_HINTS,
        authoritative=regulations(spark, sf_dir),
    )
    return found.select("question_id", "doc_id", "position", "rerank", "label", "intent")
