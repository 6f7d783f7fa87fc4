"""Maps the driver tables onto the library's schemas. Every binding is a projection of
whole tables; nothing is sampled, limited or invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LANDED: dict = {}


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per session and input to the shared folder and read
    back. Texts built from columns would otherwise be rebuilt inside every expression that
    reads them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        path = fresh_path(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the session's partitions. It comes before the text work, while the rows are still narrow."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


# ------------------------------------------------------------ article versions

# Event type -> effect status of the version it opens.
EVENT_STATUS = {
    "signup": "effective",
    "view": "effective",
    "click": "partially_repealed",
    "purchase": "superseded",
    "error": "repealed",
}

EVENT_STATUS_SQL = """CASE event_type WHEN 'signup' THEN 'effective' WHEN 'view' THEN 'effective'
    WHEN 'click' THEN 'partially_repealed' WHEN 'purchase' THEN 'superseded'
    WHEN 'error' THEN 'repealed' END"""


def status_of_event(event_type: str = "event_type"):
    from lexframe.functions.common import lookup

    return lookup(F.col(event_type), EVENT_STATUS)


def event_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event amends the article named by its user at its time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("article_id"),
        F.col("ts").alias("starts_at"),
        F.col("event_id").alias("seq"),
        status_of_event().alias("effect_status"),
        F.round(F.col("value") * 100).cast("long").alias("value_cents"),
    )


def daily_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at day grain, so that same-day amendments occur."""
    return event_amendments(spark, sf_dir).withColumn(
        "starts_at", F.to_date("starts_at")
    )


# ------------------------------------------------------------ regulations

REGULATION_SQL = """
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.source AS issuer, d.lang,
    d.text AS content, d.n_chars,
    CASE WHEN d.n_chars > 5000 THEN 'law' WHEN d.n_chars > 3000 THEN 'administrative_regulation'
         WHEN d.n_chars > 1500 THEN 'departmental_rule' WHEN d.n_chars > 500 THEN 'normative_document'
         ELSE 'local_normative' END AS hierarchy_level,
    CASE WHEN l.quality = 1 THEN 'published' WHEN l.quality = 0 THEN 'rejected'
         ELSE 'pending_review' END AS review_state,
    CASE WHEN l.toxic = 1 THEN 'repealed' WHEN d.n_chars % 7 = 0 THEN 'partially_repealed'
         ELSE 'effective' END AS effect_status,
    CASE WHEN d.n_chars % 5 > 0 THEN d.source || '-' || CAST(d.doc_id AS VARCHAR) END AS document_number,
    DATE '2020-01-01' + CAST(d.n_chars % 2000 AS INTEGER) AS publish_date
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("issuer"),
        "lang",
        F.col("text").alias("content"),
        "n_chars",
        F.when(n > 5000, "law")
        .when(n > 3000, "administrative_regulation")
        .when(n > 1500, "departmental_rule")
        .when(n > 500, "normative_document")
        .otherwise("local_normative")
        .alias("hierarchy_level"),
        F.when(F.col("quality") == 1, "published")
        .when(F.col("quality") == 0, "rejected")
        .otherwise("pending_review")
        .alias("review_state"),
        F.when(F.col("toxic") == 1, "repealed")
        .when(n % 7 == 0, "partially_repealed")
        .otherwise("effective")
        .alias("effect_status"),
        F.when(n % 5 > 0, F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias(
            "document_number"
        ),
        F.date_add(F.lit("2020-01-01").cast("date"), (n % 2000).cast("int")).alias(
            "publish_date"
        ),
    )


# ------------------------------------------------------------ notices: one text per order

# A regulation-like text with the numbers of its order. `O` orders carry a bracket number,
# `F` orders a new-style number, `P` orders none.
NOTICE_LINES = (
    "{number}关于{priority}订单管理办法",
    "第一章 总则",
    "第一条 根据《订单管理暂行条例》制定本办法。",
    "第二条 适用于客户{cust}的增值税业务，详见附件{month}。",
    "（一）销售额不超过{amount}元的，减按{rate}%征收；",
    "1.按月申报；",
    "2.按季申报。",
    "第二章 附则",
    "第三条 本办法执行期限为{year}年1月1日至{until}年12月31日。",
    "一、其他事项",
    "第四条 自{year}年{month}月{day}日起施行。《旧版{year}订单办法》同时废止。财税〔{before}〕{key}号同时废止。",
)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "notices", _notices)


def notice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators.structure import parse_header

    return landed(spark, sf_dir, "headers", lambda s, d: parse_header(notices(s, d)))


def notice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators.structure import split_blocks

    return landed(
        spark, sf_dir, "blocks", lambda s, d: split_blocks(notice_headers(s, d), "doc_id")
    )


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    year = F.year("o_orderdate")
    values = {
        "priority": F.col("o_orderpriority"),
        "cust": F.col("o_custkey"),
        "month": F.month("o_orderdate"),
        "day": F.dayofmonth("o_orderdate"),
        "year": year,
        "until": year + 2,
        "before": year - 1,
        "amount": F.round("o_totalprice").cast("bigint"),
        "rate": F.col("o_orderkey") % 20 + 1,
        "key": F.col("o_orderkey"),
        "number": F.when(
            F.col("o_orderstatus") == "O",
            F.concat(F.lit("财税["), year, F.lit("]"), F.col("o_orderkey"), F.lit("号\n")),
        )
        .when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("财政部 税务总局公告"), year, F.lit("年第"), F.col("o_orderkey"), F.lit("号\n")),
        )
        .otherwise(""),
    }
    template = "\n".join(NOTICE_LINES)
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    parts.append(F.lit(rest))
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(*parts).alias("text"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.lit("https://example.org/n")).alias(
            "source_url"
        ),
    )


NOTICE_SQL = """
  SELECT o_orderkey AS doc_id, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS cust,
    CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m,
    CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(o_orderdate AS DATE) AS o_date,
    CAST(year(o_orderdate) AS INTEGER) AS yi, CAST(o_orderkey AS VARCHAR) AS k,
    CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS amount,
    CAST(o_orderkey % 20 + 1 AS VARCHAR) AS rate FROM orders
"""


# ------------------------------------------------------------ questions: one per order

# Words of the derived questions, picked by columns of the row.
QUESTION_SQL = """
  SELECT o_orderkey AS question_id, c.c_mktsegment AS segment, o_orderpriority AS priority,
    o_orderstatus AS status, o_orderkey AS k, o_custkey AS cust, c_nationkey AS nation,
    CAST(floor(o_totalprice / 100) AS BIGINT) AS hundreds,
    CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m
  FROM orders JOIN customer c ON c.c_custkey = o_custkey
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "questions", _questions)


def question_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.functions.facts import extract_facts

    return landed(spark, sf_dir, "facts", lambda s, d: extract_facts(questions(s, d)))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in words with the facts of the order and its customer."""
    from lexframe.functions.common import lookup

    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    rows = spread(rows.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey"))
    taxpayer = lookup(
        F.col("c_mktsegment"),
        {
            "MACHINERY": "我们是一般纳税人",
            "BUILDING": "我开了一家小店",
            "AUTOMOBILE": "我是小规模纳税人",
            "HOUSEHOLD": "我们是小微企业",
            "FURNITURE": "请问",
        },
    )
    tax_word = lookup(F.col("o_orderstatus"), {"F": "不含税", "O": "含税", "P": ""})
    hundreds = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    amount = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.concat(tax_word, F.lit("销售额"), hundreds, F.lit("万元")),
    ).when(
        F.col("o_orderpriority") != "5-LOW",
        F.concat(tax_word, F.lit("销售额"), hundreds, F.lit("元")),
    )
    period = F.concat(
        F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月")
    )
    business = lookup(
        F.col("c_nationkey") % 5,
        {0: "销售货物", 1: "提供咨询服务", 2: "出租房屋", 3: "做货运", 4: "在市区经营"},
    )
    ask = lookup(
        F.col("o_custkey") % 4,
        {0: "增值税怎么算？", 1: "有什么优惠？", 2: "企业所得税怎么办理申报？", 3: "被查了怎么办？"},
    )
    return rows.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat_ws("，", taxpayer, period, business, amount, ask).alias("text"),
    )
