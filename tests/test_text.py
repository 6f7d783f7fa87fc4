"""Text operators: numbers, dates, windows, names, cleaning, scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.routing import route_questions
from lexframe.rules import text as R

D = dt.date


def test_document_number_styles(one):
    got = one(
        T.document_number,
        "财政部 税务总局公告2023年第12号\n关于优惠的公告",
        "财税[2019]39号\n标题",
        "第 512 号 令\n标题",
        "国家税务总局公告2020\n年第1号",
        "关于某事的通知\n正文",
        "",
    )
    assert got == ["财政部 税务总局公告2023年第12号", "财税〔2019〕39号", "第 512 号 令", "国家税务总局公告2020年第1号", None, None]


def test_issuer_and_publish_date(one):
    assert one(T.issuer_of, "财税〔2019〕39号", "财政部 税务总局公告2023年第12号", "沪税〔2019〕1号") == ["财政部", "财政部 税务总局", None]
    assert one(T.publish_date, "财税〔2019〕39号", "某公告2023年第12号", "第 5 号 令") == [D(2019, 1, 1), D(2023, 1, 1), None]


def test_title_line(one):
    build = lambda t: T.title_line(t, T.document_number(t))
    assert one(build, "财税〔2019〕39号\n关于某事的通知\n第一条 x", "中华人民共和国印花税法\n目　录", "财税〔2019〕39号\n第一条 x") == [
        "关于某事的通知", "中华人民共和国印花税法", "财税〔2019〕39号",
    ]


def test_hierarchy(one):
    build = lambda t: T.hierarchy_by_title(t, F.lit(None).cast("string"))
    assert one(build, "中华人民共和国印花税法", "发票管理条例", "管理办法", "关于某事的公告", "会议纪要") == [
        "law", "administrative_regulation", "departmental_rule", "normative_document", None,
    ]


def test_dates_are_checked(one):
    assert one(T.effective_date, "自2024年1月1日起施行", "自2024年13月1日起施行", "2024年1月1日") == [D(2024, 1, 1), None, None]
    assert one(T.clean_date, "2024-01-02", "null", "2024/01/02", " ") == [D(2024, 1, 2), None, None, None]


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("执行期限为2023年1月1日至2024年12月31日。", D(2023, 1, 1), D(2024, 12, 31)),
        ("本公告执行至2027年12月31日。", None, D(2027, 12, 31)),
        ("执行期限延长至2022年3月31日", None, D(2022, 3, 31)),
        ("有效期至2025年5月1日。2023年1月1日至2024年1月1日", None, D(2025, 5, 1)),
        ("自2020年1月1日起施行。2019年12月1日", None, None),
        ("", None, None),
    ],
)
def test_execution_window(one, text, start, end):
    w = one(T.execution_window, text)
    assert (w["start"], w["end"]) == (start, end)


def test_names_longest_first_and_in_order(one):
    assert one(T.detect_names, "土地增值税怎么交", "先印花税后增值税", "个人所得税", "", None) == [
        ["土地增值税"], ["印花税", "增值税"], ["个人所得税"], [], [],
    ]


def test_no_name_is_prefix_and_suffix_of_two_others():
    # The one-pass alternation equals masking as long as no two names can overlap.
    for a in R.TAX_TYPES:
        for b in R.TAX_TYPES:
            for n in range(1, min(len(a), len(b))):
                if a != b and a not in b and b not in a:
                    assert a[-n:] != b[:n], (a, b)


def test_glossary(one):
    assert one(T.expand_terms, "小规模怎么报税", "进项税额抵扣", "你好") == [
        "小规模怎么报税 小规模纳税人 纳税申报", "进项税额抵扣", "你好",
    ]
    assert one(T.names_with_aliases, "个人所得税怎么算", "进项能抵吗", "社保怎么交") == [["个人所得税"], ["增值税"], ["社会保险费"]]


def test_inference_priority(spark):
    df = spark.createDataFrame(
        [
            (["契税"], "税收政策-印花税", "cn_vat", "关税公告", "x"),
            (None, "税收政策-印花税", "cn_vat", "关税公告", "x"),
            (None, "其他", "cn_vat", "关税公告", "x"),
            (None, None, "cn_tax_admin", "关税公告", "x"),
            (None, None, None, "公告", "契税契税关税"),
        ],
        "e array<string>, c string, k string, t string, b string",
    )
    got = df.select(T.infer_names(*[F.col(c) for c in "ecktb"])).collect()
    assert [r[0] for r in got] == [["契税"], ["印花税", "关税"], ["增值税"], ["关税"], ["契税"]]


def test_noise_cleaning_is_idempotent_and_keeps_short_articles(one):
    raw = "字体：\n【大】\n第一条\n正文内容 分享到：微博\n\n\n\n第二条 其他\n12"
    clean = one(T.clean_noise, raw)
    assert clean == "第一条\n正文内容\n\n第二条 其他"
    assert one(T.clean_noise, clean) == clean


def test_html_to_text(one):
    html = '<style>a</style><script>var t="</p>";</script><p>一&amp;&lt;二</p><div>三&nbsp;四</div><br/>　'
    assert one(T.html_to_text, html) == "一&<二\n三 四"
    assert one(T.html_to_text, one(T.html_to_text, "<p>甲</p>乙")) == "甲\n乙"


def test_links(spark):
    html = 'x href="/a/b.pdf" href="c.docx" href="https://h/d.doc" href="/a/b.pdf" href="e.html"'
    df = spark.createDataFrame([(html, "https://site/x/y.html")], "h string, u string")
    got = df.select(T.attachment_links(F.col("h"), F.col("u"))).first()[0]
    assert got == ["https://site/a/b.pdf", "https://site/x/c.docx", "https://h/d.doc"]


def test_page_fields(spark):
    html = (
        '<h3 class="t">关于<b>某事</b></h3><div class="arctips"> <h5>财税〔2019〕39号</h5></div>'
        '<span class="date">成文日期：2019-01-02</span><span class="xg">全文有效</span>'
        '<div class="arc_cont"><p>自2019年2月1日起施行</p></div></div>'
    )
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(*[c.alias(n) for n, c in T.page_fields(F.col("h")).items()]).first()
    assert (row.title, row.document_number, row.written_date) == ("关于某事", "财税〔2019〕39号", "2019-01-02")
    assert (row.body, row.effective_date, row.official_status) == ("自2019年2月1日起施行", D(2019, 2, 1), "全文有效")


def test_usability(one):
    assert one(T.usability, "", "依照有关规定执行", "短句", "小规模纳税人适用3%的征收率缴纳增值税") == [0.0, 0.1, 0.4, 0.9]


def test_substance_and_best_sentence(one):
    assert one(T.substance, "减按25%计入", "不超过300万元", "免征增值税", "减免征收", "其他") == [10, 6, 5, 1, 0]
    assert one(T.best_sentence, "根据规定。减按25%计入应纳税所得额。其他。") == "减按25%计入应纳税所得额。"


def test_intents(one):
    assert one(T.question_intent, "被查了怎么算", "怎么算", "怎么办理材料", "能不能享受") == [
        "inspection", "calculation", "how_to", "policy_query",
    ]


def test_red_lines_have_an_alternative(one):
    hits = one(lambda t: T.red_lines(t, R.RED_LINES), "想买票冲账，再做两套账")
    assert [h["code"] for h in hits] == ["false_invoice", "conceal_income"]
    assert all(h["alternative"] for h in hits)


def test_compliance(one):
    assert [h["code"] for h in one(T.overreach, "我们保证可以，绝对没问题，包过")] == [
        "promise_result", "absolute_claim", "guarantee_pass",
    ]
    assert one(T.disclaimer_issue, "以主管税务机关认定为准", "仅供参考", None) == [None, "disclaimer_incomplete", "disclaimer_missing"]


def test_gap_topics(spark):
    texts = ["增值税怎么申报", "进项能抵扣吗", "怎么申报", "你好"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
    rows = T.add_gap_topic(df).orderBy("i").collect()
    assert [r.topic for r in rows] == ["增值税·申报", "增值税·抵扣", "未标注税种·申报", "未分类问题"]
    assert [r.tax_type for r in rows] == ["增值税", "增值税", None, None]


def test_citation_text(one):
    got = one(T.parse_citation, "财政部 税务总局公告2023年第12号", "中华人民共和国增值税法 第十四条", "某法")
    assert [tuple(x) for x in got] == [
        ("财政部 税务总局公告2023年第12号", None, None), (None, "中华人民共和国增值税法", "第十四条"), (None, "某法", None),
    ]


def test_trigrams(spark):
    df = spark.createDataFrame([("", "x"), ("一二三四", "一二三五"), ("一 二三", "一二三")], "a string, b string")
    got = df.select(T.trigram_containment(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.5, 1.0]


def test_routing(spark):
    df = spark.createDataFrame([("增值税税率和纳税申报",), ("今天天气",)], "text string")
    rows = route_questions(df, "text").collect()
    assert rows[0].domain_id == "finance_tax" and rows[0].confidence == 1.0
    assert rows[1].domain_id is None and not rows[1].needs_clarification
    assert route_questions(df, "text", subscribed=[]).first().domain_id is None
