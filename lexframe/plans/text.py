"""Registered queries of the text and ingest family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.operators import relations as Rel
from lexframe.operators import structure as S
from lexframe.plans.base import Family
from lexframe.plans.bindings import NOTICE_SQL, notice_blocks, notice_headers, notices, table

family = Family()
query = family.query

NUMBER_SQL = """CASE status WHEN 'O' THEN '财税〔' || y || '〕' || k || '号'
  WHEN 'F' THEN '财政部 税务总局公告' || y || '年第' || k || '号' END"""


# ---- header of a notice


def _parsed(spark, sf_dir):
    return S.parse_header(notices(spark, sf_dir))


@query(f"""
SELECT doc_id, {NUMBER_SQL} AS document_number,
  CASE status WHEN 'O' THEN '财政部' WHEN 'F' THEN '财政部 税务总局' END AS issuer,
  status = 'O' AS issuer_inferred, '关于' || priority || '订单管理办法' AS title,
  'departmental_rule' AS hierarchy_level
FROM ({NOTICE_SQL}) n
""")
def doc_number_extract(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id", "document_number", "issuer", "issuer_inferred", "title", "hierarchy_level"
    )


@query(f"""
SELECT doc_id, CASE WHEN status <> 'P' THEN make_date(yi, 1, 1) END AS publish_date, o_date AS effective_date,
  CAST(NULL AS DATE) AS expiry_date,
  (CASE WHEN status = 'P' THEN 1 ELSE 0 END + CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END)::INTEGER AS reasons,
  status = 'P' OR priority = '1-URGENT' AS requires_review
FROM ({NOTICE_SQL}) n
""")
def date_extract(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id",
        "publish_date",
        "effective_date",
        "expiry_date",
        F.size("review_reasons").alias("reasons"),
        "requires_review",
    )


@query(f"""
SELECT doc_id, concat_ws('|', CASE WHEN status = 'P' THEN 'no_document_number' END,
  CASE WHEN priority = '1-URGENT' THEN 'no_source_url' END) AS reasons
FROM ({NOTICE_SQL}) n WHERE status = 'P' OR priority = '1-URGENT'
""")
def pending_reasons(spark, sf_dir):
    # Exploded, not filtered: a filter would be moved down to the texts and have them parsed a second time.
    listed = F.when(F.col("requires_review"), F.array(F.array_join("review_reasons", "|")))
    return _parsed(spark, sf_dir).select("doc_id", F.explode(listed).alias("reasons"))


@query(f"""
SELECT doc_id, make_date(yi, 1, 1) AS window_start, make_date(yi + 2, 12, 31) AS window_end FROM ({NOTICE_SQL}) n
""")
def window_extract(spark, sf_dir):
    w = T.execution_window(F.col("text"))
    return notices(spark, sf_dir).select(
        "doc_id", w["start"].alias("window_start"), w["end"].alias("window_end")
    )


# ---- blocks of a notice

BLOCKS_SQL = f"""
SELECT n.doc_id, b.i AS order_index, b.level AS level_code, b.no AS article_no, b.parent AS parent_index, b.full AS full_no,
  replace(replace(replace(replace(replace(replace(replace(replace(replace(b.content, '$cust', CAST(cust AS VARCHAR)),
    '$amount', amount), '$rate', rate), '$month', m), '$day', d), '$year', y), '$until', CAST(yi + 2 AS VARCHAR)),
    '$before', CAST(yi - 1 AS VARCHAR)), '$key', k) AS content
FROM ({NOTICE_SQL}) n CROSS JOIN (VALUES
 (0, 'chapter', '第一章', NULL, '第一章 总则', ''),
 (1, 'article', '第一条', 0, '第一章 总则 第一条', '根据《订单管理暂行条例》制定本办法。'),
 (2, 'article', '第二条', 0, '第一章 总则 第二条', '适用于客户$cust的增值税业务，详见附件$month。'),
 (3, 'paragraph', '（一）', 2, '第一章 总则 第二条 （一）', '销售额不超过$amount元的，减按$rate%征收；'),
 (4, 'item', '1.', 3, '第一章 总则 第二条 （一） 1.', '按月申报；'),
 (5, 'item', '2.', 3, '第一章 总则 第二条 （一） 2.', '按季申报。'),
 (6, 'chapter', '第二章', NULL, '第二章 附则', ''),
 (7, 'article', '第三条', 6, '第二章 附则 第三条', '本办法执行期限为$year年1月1日至$until年12月31日。'),
 (8, 'item', '一、', 6, '第二章 附则 一、', '其他事项'),
 (9, 'article', '第四条', 6, '第二章 附则 第四条',
   '自$year年$month月$day日起施行。《旧版$year订单办法》同时废止。财税〔$before〕$key号同时废止。')
) AS b(i, level, no, parent, "full", content)
"""


def _blocks(spark, sf_dir):
    return S.split_blocks(notice_headers(spark, sf_dir), "doc_id")


@query(BLOCKS_SQL)
def structure_lines(spark, sf_dir):
    return _blocks(spark, sf_dir).select(
        "doc_id", "order_index", "level_code", "article_no", "parent_index", "full_no", "content"
    )


LINES_SQL = r"regexp_split_to_array(text, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]')"


@query(rf"""
WITH l AS (SELECT doc_id, i - 1 AS i, regexp_replace(x, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g') AS s
  FROM (SELECT doc_id, unnest({LINES_SQL}) AS x, generate_subscripts({LINES_SQL}, 1) AS i FROM documents) t),
titles AS (SELECT doc_id, arg_min(s, i) AS title FROM l WHERE i < 6 AND s <> '' GROUP BY doc_id),
bodies AS (SELECT l.doc_id, string_agg(s, chr(10) ORDER BY i) AS body FROM l LEFT JOIN titles t ON t.doc_id = l.doc_id
  WHERE s <> '' AND NOT (i < 3 AND s = coalesce(title, '')) GROUP BY l.doc_id)
SELECT doc_id, '全文' AS full_no, md5(body) AS body_md5, length(body) AS body_chars FROM bodies WHERE length(body) >= 30
""")
def whole_text_articles(spark, sf_dir):
    """Documents without headings become one whole-text article."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "source_url", F.lit(None).cast("string")
    )
    blocks = S.split_blocks(S.parse_header(docs), "doc_id")
    return blocks.filter(F.col("full_no") == "全文").select(
        "doc_id",
        "full_no",
        F.md5("content").alias("body_md5"),
        F.length("content").cast("long").alias("body_chars"),
    )


@query(f"""
WITH u AS (SELECT doc_id, full_no AS source_no, content, CASE WHEN contains(content, '%') OR regexp_matches(content, '[0-9]+元')
    OR regexp_matches(content, '第[一二三四五六七八九十百零〇0-9]+条|适用|可以|不得|应当|减免|减按|免征|征收') THEN 0.3 ELSE 0.0 END AS c
  FROM ({BLOCKS_SQL}) b WHERE level_code <> 'chapter')
SELECT doc_id, source_no, round(0.4 + c + CASE WHEN length(content) BETWEEN 15 AND 200 THEN 0.2 ELSE 0.0 END, 2)::DOUBLE AS usability,
  split_part(replace(content, '；', '。'), '。', 1) AS answer_summary,
  substr(content, 1, 20) || CASE WHEN contains(content, '减按') THEN '…有什么税收优惠？'
    WHEN contains(content, '适用') THEN '…适用范围是什么？' ELSE '…如何处理？' END AS question_hint
FROM u
""")
def usability_units(spark, sf_dir):
    units = S.knowledge_units(notice_blocks(spark, sf_dir), "doc_id")
    return units.select("doc_id", "source_no", "usability", "answer_summary", "question_hint")


# ---- relations and impact


@query(f"""
SELECT doc_id, 'based_on' AS relation_type, '订单管理暂行条例' AS target_ref, 0.9::DOUBLE AS confidence FROM ({NOTICE_SQL}) n
UNION ALL SELECT doc_id, 'references', '附件' || m, 0.8 FROM ({NOTICE_SQL}) n
UNION ALL SELECT doc_id, 'repeals', '财税〔' || CAST(yi - 1 AS VARCHAR) || '〕' || k || '号', 0.95 FROM ({NOTICE_SQL}) n
""")
def relation_edges(spark, sf_dir):
    docs = notices(spark, sf_dir).withColumn(
        "own_number", T.document_number(F.col("text"))
    )
    edges = Rel.relation_edges(docs, "doc_id", own_number="own_number")
    return edges.select("doc_id", "relation_type", "target_ref", "confidence")


@query(f"""
WITH named AS (SELECT doc_id, '旧版' || y || '订单办法' AS named_title FROM ({NOTICE_SQL}) n),
known AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '旧版' || CAST(year(o_orderdate) AS VARCHAR) || '订单办法'
   ELSE '（修订）旧版' || CAST(year(o_orderdate) + 4 AS VARCHAR) || '订单办法' || o_orderpriority END AS title FROM orders),
norm AS (SELECT id, regexp_replace(title, '[\\s（）()、，,]+', '', 'g') AS t FROM known),
exact AS (SELECT t, min(id) AS id FROM norm GROUP BY t),
names AS (SELECT DISTINCT named_title AS nt FROM named),
partial AS (SELECT nt, min(id) AS id FROM names JOIN exact ON contains(t, nt) OR contains(nt, t)
  WHERE nt NOT IN (SELECT t FROM exact) GROUP BY nt)
SELECT doc_id, 'repealed' AS relation, named_title, coalesce(e.id, p.id) AS regulation_id,
  CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'contained' ELSE 'unknown' END AS match_kind
FROM named LEFT JOIN exact e ON e.t = named_title LEFT JOIN partial p ON p.nt = named_title
""")
def impact_edges(spark, sf_dir):
    """Titles that the notices repeal, matched to a title table derived from the orders."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    known = orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("旧版"), year, F.lit("订单办法")),
        )
        .otherwise(
            F.concat(F.lit("（修订）旧版"), year + 4, F.lit("订单办法"), F.col("o_orderpriority"))
        )
        .alias("title"),
    )
    docs = notices(spark, sf_dir).withColumn("title", F.lit(""))
    edges = Rel.impact_edges(docs, known, "doc_id", "title", "text", "id", "title")
    return edges.select("doc_id", "relation", "named_title", "regulation_id", "match_kind")


@query("""
WITH firsts AS (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '[\\s\\(\\)（）—\\-－_、，,]+', '', 'g') AS t FROM documents),
known AS (SELECT t, min(doc_id) AS id FROM firsts WHERE t <> '' GROUP BY t),
names AS (SELECT item_id, regexp_replace(split_part(text, '.', 1), '[\\s\\(\\)（）—\\-－_、，,]+', '', 'g') AS nt FROM benchmark),
partial AS (SELECT nt, min(id) AS id FROM (SELECT DISTINCT nt FROM names WHERE nt <> '') n JOIN known
  ON contains(t, nt) OR contains(nt, t) WHERE nt NOT IN (SELECT t FROM known) GROUP BY nt)
SELECT item_id, coalesce(k.id, p.id) AS doc_id, CASE WHEN k.id IS NOT NULL THEN 'exact'
  WHEN p.id IS NOT NULL THEN 'contained' ELSE 'unknown' END AS match_kind
FROM names LEFT JOIN known k ON k.t = nt LEFT JOIN partial p ON p.nt = names.nt
""")
def title_match_two_stage(spark, sf_dir):
    """First sentence of each benchmark item against the first line of each document."""
    from lexframe.operators.matching import match_titles

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        T.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("_title"),
    )
    names = table(spark, sf_dir, "benchmark").select(
        "item_id", T.normalize_title(F.split_part("text", F.lit("."), F.lit(1))).alias("_name")
    )
    return match_titles(names, docs, "item_id", "_name", "doc_id", "_title").select(
        "item_id", "doc_id", "match_kind"
    )


# ---- names, glossary; words of the synthetic texts stand in for tax types

NAMES = ("tionement", "tion", "thand", "the", "ement", "keit", "ción", "ment")
TERMS = (("hein", "thein", ("the",)), ("ones", "tiones", ("tion",)), ("eau", "ement", ("ement",)))
NAMES_RE = "(tionement|thand|ement|tion|keit|ción|ment|the)"


@query(f"""
WITH hits AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '{NAMES_RE}')) AS f FROM documents)
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(f, lambda n: {{'at': instr(text, n), 'n': n}})),
  lambda p: p.n), ',') AS names FROM hits
""")
def keyword_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.detect_names(F.col("text"), NAMES), ",").alias("names")
    )


@query("""
WITH a AS (SELECT doc_id, text,
  CASE WHEN contains(text, 'hein') AND NOT contains(text, 'thein') THEN 'thein' END AS x,
  CASE WHEN contains(text, 'ones') AND NOT contains(text, 'tiones') THEN 'tiones' END AS y,
  CASE WHEN contains(text, 'eau') AND NOT contains(text, 'ement') THEN 'ement' END AS z FROM documents)
SELECT doc_id, md5(concat_ws(' ', text, x, y, z)) AS expanded_md5, (x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL) AS changed FROM a
""")
def glossary_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", T.expand_terms(F.col("text"), TERMS).alias("expanded")
    )
    return rows.select(
        "doc_id",
        F.md5("expanded").alias("expanded_md5"),
        (F.col("expanded") != F.col("text")).alias("changed"),
    )


@query(f"""
WITH n AS (SELECT unnest(['tionement', 'tion', 'thand', 'the', 'ement', 'keit', 'ción', 'ment']) AS name),
c AS (SELECT doc_id, name, (length(text) - length(replace(text, name, ''))) // length(name) AS k, instr(text, name) AS pos
  FROM documents, n WHERE list_contains(regexp_extract_all(text, '{NAMES_RE}'), name)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, pos, name) AS rn FROM c WHERE k >= 2)
SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY rn), '') AS names FROM documents d
LEFT JOIN r ON r.doc_id = d.doc_id AND rn <= 2 GROUP BY d.doc_id
""")
def body_keyword_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.body_names(F.col("text"), NAMES), ",").alias("names")
    )


@query(f"""
WITH a AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text FROM documents),
b AS (SELECT doc_id, source, text,
  CASE WHEN source = 'src1' THEN ['the', 'tion'] WHEN source = 'src2' THEN ['keit'] END AS official,
  list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(title, '{NAMES_RE}')),
    lambda n: {{'at': instr(title, n), 'n': n}})), lambda p: p.n) AS titled FROM a),
n AS (SELECT unnest(['tionement', 'tion', 'thand', 'the', 'ement', 'keit', 'ción', 'ment']) AS name),
c AS (SELECT doc_id, name, (length(text) - length(replace(text, name, ''))) // length(name) AS k, instr(text, name) AS pos
  FROM documents, n WHERE list_contains(regexp_extract_all(text, '{NAMES_RE}'), name)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, pos, name) AS rn FROM c WHERE k >= 2),
body AS (SELECT doc_id, string_agg(name, ',' ORDER BY rn) AS names FROM r WHERE rn <= 2 GROUP BY doc_id)
SELECT b.doc_id, coalesce(CASE WHEN official IS NOT NULL THEN array_to_string(list_concat(official,
    list_filter(titled, lambda t: NOT list_contains(official, t))), ',')
  WHEN source = 'src3' THEN 'ment' WHEN len(titled) > 0 THEN array_to_string(titled[1:3], ',') ELSE body.names END, '') AS names
FROM b LEFT JOIN body ON body.doc_id = b.doc_id
""")
def name_inference(spark, sf_dir):
    """The priority chain: official category, collection code, title, body."""
    docs = table(spark, sf_dir, "documents")
    category = (
        F.when(F.col("source") == "src1", F.lit("政策-the、tion"))
        .when(F.col("source") == "src2", F.lit("政策-keit"))
        .when(F.col("source") == "src3", F.lit("其他"))
    )
    names = T.infer_names(
        F.lit(None).cast("array<string>"),
        category,
        F.col("source"),
        F.split_part("text", F.lit("\n"), F.lit(1)),
        F.col("text"),
        NAMES,
        {"src3": "ment"},
    )
    return docs.select("doc_id", F.array_join(names, ",").alias("names"))


# ---- cleaning and html

NOISE = dict(
    line_patterns=(r"^(?:The|And|Is)\.$", r"^[A-Z][a-z]+\.$"),
    tag_pattern=r"^\|.{0,20}\|$",
    inline_pattern=r"Released under|This work is licensed|idiot",
)


@query(rf"""
WITH l AS (SELECT doc_id, i, regexp_replace(x, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g') AS s
  FROM (SELECT doc_id, unnest({LINES_SQL}) AS x, generate_subscripts({LINES_SQL}, 1) AS i FROM documents) t),
k AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, 'Released under|This work is licensed|idiot')
    THEN nullif(regexp_replace(regexp_extract(s, '^(.*?)(?:Released under|This work is licensed|idiot)', 1), '[\s\x{{3000}}\x{{a0}}]+$', ''), '')
    ELSE s END AS s FROM l
  WHERE s = '' OR NOT regexp_matches(s, '^\|.{{0,20}}\|$|^(?:The|And|Is)\.$|^[A-Z][a-z]+\.$')),
j AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS t FROM k WHERE s IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'),
    '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g'), '')) AS clean_md5,
  d.n_chars <= 400 AND contains(d.text, 'MIT') AND NOT contains(d.text, 'tion') AS attachment_only,
  regexp_matches(d.text, '\.\.\.\s*$') AS truncated
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id
""")
def noise_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(T.clean_noise(F.col("text"), **NOISE)).alias("clean_md5"),
        T.attachment_only(F.col("text"), "MIT", "tion").alias("attachment_only"),
        T.is_truncated(F.col("text")).alias("truncated"),
    )


HTML_SQL = r"""
replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
 '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)</p\s*>|<br\s*/?>|</div\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&ldquo;', '“'), '&rdquo;', '”'),
 '&mdash;', '—'), '&middot;', '·'), '&hellip;', '…'), '&times;', '×'), '&emsp;', ' '), '&ensp;', ' '), '&amp;', '&')
"""


@query(rf"""
WITH t AS (SELECT page_id, translate({HTML_SQL}, chr(12288) || chr(160), '  ') AS text FROM pages),
l AS (SELECT page_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s FROM (
  SELECT page_id, unnest({LINES_SQL}) AS x, generate_subscripts({LINES_SQL}, 1) AS i FROM t) u)
SELECT page_id, md5(string_agg(s, chr(10) ORDER BY i)) AS text_md5, count(*) AS n_lines FROM l WHERE s <> '' GROUP BY page_id
""")
def html_to_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        "page_id", T.html_to_text(F.col("html")).alias("t")
    )
    return rows.filter(F.col("t") != "").select(
        "page_id",
        F.md5("t").alias("text_md5"),
        F.size(F.split("t", "\n")).cast("long").alias("n_lines"),
    )


def _unescaped(expr: str) -> str:
    return HTML_SQL.strip().replace("html,", f"{expr},", 1)


@query(rf"""
WITH f AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''),
    nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')) AS h,
  nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang FROM pages)
SELECT page_id, nullif(regexp_replace({_unescaped('h')}, '^\s+|\s+$', '', 'g'), '') AS title, lang FROM f
""")
def page_fields(spark, sf_dir):
    fields = T.page_fields(
        F.col("html"),
        {"title": (r"<h1[^>]*>(.*?)</h1>", r"<title>(.*?)</title>"), "lang": (r'lang="([a-z]+)"',)},
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", fields["title"].alias("title"), fields["lang"].alias("lang")
    )


@query(r"""
WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
a AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(trim(href, ' '), '^(?i)https?:') THEN trim(href, ' ')
  WHEN starts_with(trim(href, ' '), '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)', 1) || trim(href, ' ')
  ELSE '?' || trim(href, ' ') END AS link FROM h WHERE NOT starts_with(lower(trim(href, ' ')), 'javascript:'))
SELECT page_id, link FROM a
""")
def page_links(spark, sf_dir):
    links = T.attachment_links(F.col("html"), F.col("url"), r'href="([^"]+)"')
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link"))


# ---- classification of conversation turns

INTENT_WORDS = (("inspection", ("idiot",)), ("planning", ("hein", "keit")), ("calculation", ("tion", "ment")))


@query("""
SELECT conv_id, turn, CASE WHEN contains(text, 'idiot') THEN 'inspection' WHEN contains(text, 'hein') OR contains(text, 'keit')
  THEN 'planning' WHEN contains(text, 'tion') OR contains(text, 'ment') THEN 'calculation' ELSE 'policy_query' END AS intent
FROM conversations WHERE role = 'user'
""")
def intent_classify(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        "conv_id", "turn", T.question_intent(F.col("text"), INTENT_WORDS).alias("intent")
    )


ROUTING = (
    {"domain_id": "english", "status": "active", "keywords": ("the", "and", "tion"), "include": ("thand",), "exclude": ("ñ",)},
    {"domain_id": "french", "status": "active", "keywords": ("eau", "que", "ment"), "include": ("étion",), "exclude": ("ß",)},
    {"domain_id": "german", "status": "active", "keywords": ("der", "und", "keit"), "include": ("schaft",), "exclude": ()},
    {"domain_id": "latin", "status": "planned", "keywords": ("e",), "include": (), "exclude": ()},
)


@query("""
WITH s AS (SELECT conv_id, turn, text,
  CASE WHEN contains(text, 'ñ') THEN 0 ELSE contains(text, 'the')::INT + contains(text, 'and')::INT + contains(text, 'tion')::INT + 2 * contains(text, 'thand')::INT END AS e,
  CASE WHEN contains(text, 'ß') THEN 0 ELSE contains(text, 'eau')::INT + contains(text, 'que')::INT + contains(text, 'ment')::INT + 2 * contains(text, 'étion')::INT END AS f,
  contains(text, 'der')::INT + contains(text, 'und')::INT + contains(text, 'keit')::INT + 2 * contains(text, 'schaft')::INT AS g
  FROM conversations WHERE role = 'user'),
b AS (SELECT *, greatest(e, f, g) AS best, CASE WHEN e >= f AND e >= g THEN 'english' WHEN f >= g THEN 'french' ELSE 'german' END AS top,
  e + f + g - greatest(e, f, g) - least(e, f, g) AS second FROM s)
SELECT conv_id, turn, CASE WHEN best <= 0 THEN NULL WHEN best >= 3 AND best - second >= 2 THEN top WHEN second < 1 THEN top END AS domain_id,
  best > 0 AND NOT (best >= 3 AND best - second >= 2) AND second >= 1 AS needs_clarification,
  CASE WHEN best <= 0 THEN 0.0 ELSE least(1.0, round(best / 6.0, 4)) END::DOUBLE AS confidence FROM b
""")
def route_domain(spark, sf_dir):
    from lexframe.functions.routing import route_questions

    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return route_questions(turns, "text", ROUTING).select(
        "conv_id", "turn", "domain_id", "needs_clarification", "confidence"
    )


SUBSTANCE = dict(
    ratio=r"the\s+[a-z]+ing",
    limit_words=("under", "tion"),
    limit_money=r"[0-9]+|thand",
    strong=r"(?<!t)hein|ones",
    soft=("keit", "ment", "ción"),
)


@query(r"""
SELECT doc_id, CAST(10 * len(regexp_extract_all(text, 'the\s+[a-z]+ing'))
  + CASE WHEN (contains(text, 'under') OR contains(text, 'tion')) AND regexp_matches(text, '[0-9]+|thand') THEN 6 ELSE 0 END
  + 5 * len(regexp_extract_all(replace(text, 'thein', 't#'), 'hein|ones'))
  + contains(text, 'keit')::INT + contains(text, 'ment')::INT + contains(text, 'ción')::INT AS INTEGER) AS score
FROM documents
""")
def substance_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.substance(F.col("text"), **SUBSTANCE).alias("score")
    )


REDLINE_RULES = (
    ("insult", "Insult", (r"idiot", r"clown"), "say it politely"),
    ("license", "License", (r"Released under.{0,20}", r"licensed"), "name the license"),
    ("double", "Doubling", (r"thth[a-z]+",), "split the word"),
)


@query("""
WITH m AS (SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, 'idiot'), ''), nullif(regexp_extract(text, 'clown'), '')) AS a,
  coalesce(nullif(regexp_extract(text, 'Released under.{0,20}'), ''), nullif(regexp_extract(text, 'licensed'), '')) AS b,
  nullif(regexp_extract(text, 'thth[a-z]+'), '') AS c FROM conversations)
SELECT conv_id, turn, 'insult' AS code, a AS matched FROM m WHERE a IS NOT NULL
UNION ALL SELECT conv_id, turn, 'license', b FROM m WHERE b IS NOT NULL
UNION ALL SELECT conv_id, turn, 'double', c FROM m WHERE c IS NOT NULL
""")
def red_line_match(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(T.red_lines(F.col("text"), REDLINE_RULES)).alias("h")
    )
    return hits.select("conv_id", "turn", "h.code", "h.matched")


@query("""
WITH m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 'never_wrong' AS code FROM m WHERE contains(text, 'thin') OR contains(text, 'keit')
UNION ALL SELECT conv_id, turn, 'disclaimer_incomplete' FROM m WHERE NOT (contains(text, 'the') OR contains(text, 'de'))
""")
def compliance_scan(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    codes = F.array_compact(
        F.concat(
            F.transform(T.overreach(text, (("never_wrong", "thin|keit"),)), lambda h: h["code"]),
            F.array(T.disclaimer_issue(text, ("the", "de"))),
        )
    )
    return rows.select("conv_id", "turn", F.explode(codes).alias("code"))
