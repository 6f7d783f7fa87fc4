"""Structuring, relations, title matching, corpus upkeep."""

from pyspark.sql import functions as F

from lexframe.operators import corpus as C
from lexframe.sources import writers as W
from lexframe.operators import matching as Mt
from lexframe.operators import relations as Rel
from lexframe.operators import structure as S

LAW = """中华人民共和国示例法
（一）前言不算
第一章 总则
第一条 为了示例，制定本法。
补充一段。
第二条
范围如下：
（一）甲；
1.细目一；
（二）乙。
第二节 附加
第三条 适用。
第二章 附则
第四条 自2024年1月1日起施行。
（一）甲；
"""
NOTICE = "关于某事的通知\n一、第一项内容\n（一）小点\n二、第二项内容\n（一）小点"


def _blocks(spark, *texts):
    df = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "id int, text string, source_url string")
    parsed = S.parse_header(df)
    return S.split_blocks(parsed, "id").orderBy("id", "order_index").collect()


def test_levels_parents_and_full_numbers(spark):
    rows = _blocks(spark, LAW)
    got = [(r.level_code, r.article_no, r.parent_index, r.full_no) for r in rows]
    assert got == [
        ("chapter", "第一章", None, "第一章 总则"),
        ("article", "第一条", 0, "第一章 总则 第一条"),
        ("article", "第二条", 0, "第一章 总则 第二条"),
        ("paragraph", "（一）", 2, "第一章 总则 第二条 （一）"),
        ("item", "1.", 3, "第一章 总则 第二条 （一） 1."),
        ("paragraph", "（二）", 2, "第一章 总则 第二条 （二）"),
        ("section", "第二节", None, "第一章 总则 第二节 附加"),
        ("article", "第三条", 6, "第一章 总则 第二节 附加 第三条"),
        ("chapter", "第二章", None, "第二章 附则"),
        ("article", "第四条", 8, "第二章 附则 第四条"),
        ("paragraph", "（一）", 9, "第二章 附则 第四条 （一）"),
    ]
    assert rows[1].content == "为了示例，制定本法。\n补充一段。"
    assert rows[2].content == "范围如下："


def test_notice_without_articles_gets_suffixes(spark):
    rows = _blocks(spark, NOTICE)
    assert [(r.article_no, r.full_no) for r in rows] == [
        ("一、", "一、"), ("（一）", "（一）"), ("二、", "二、"), ("（一）", "（一）（2）"),
    ]


def test_whole_text_fallback_and_too_short(spark):
    body = "这是一份没有条款结构的通知，正文只有一个自然段，但是长度超过三十个字符，应当成为全文。"
    rows = _blocks(spark, "某通知\n" + body, "某通知\n太短")
    assert [(r.id, r.full_no, r.content) for r in rows] == [(0, "全文", body)]


def test_header_marks_missing_fields(spark):
    df = spark.createDataFrame([("会议纪要\n内容", None)], "text string, source_url string")
    row = S.parse_header(df).first()
    assert row.document_number is None and row.hierarchy_level == "normative_document"
    assert len(row.review_reasons) == 4 and row.requires_review


def test_article_tree(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "k string, p string")
    got = {r.k: (r.depth, r.root) for r in S.article_tree(df, "k", "p").collect()}
    assert got == {"a": (0, "a"), "b": (1, "a"), "c": (2, "a"), "d": (0, "d")}


def test_article_tree_deep_and_cyclic(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(11)]
    df = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "y"), (None, "c2")], "k string, p string")
    got = {r.k: (r.depth, r.root) for r in S.article_tree(df, "k", "p").collect()}
    assert got == {f"c{i}": (i, "c0") for i in range(11)} | {k: (None, None) for k in "xyz"} | {None: (3, "c0")}


def test_relations(spark):
    text = "根据《中华人民共和国增值税法》制定本公告。详见附件2。《财税〔2016〕36号》、财税[2016]36号同时废止。本公告取代《旧的管理办法》。"
    df = spark.createDataFrame([(1, text, "财税〔2020〕1号"), (2, "普通文字。", None)], "id int, text string, own string")
    rows = {(r.id, r.relation_type, r.target_ref): r.confidence for r in Rel.relation_edges(df, "id", own_number="own").collect()}
    assert rows == {
        (1, "based_on", "中华人民共和国增值税法"): 0.9,
        (1, "references", "附件2"): 0.8,
        (1, "repeals", "财税〔2016〕36号"): 0.95,
        (1, "amends", "旧的管理办法"): 0.85,
    }


def test_no_self_reference(spark):
    df = spark.createDataFrame([(1, "财税〔2020〕1号文件废止", "财税〔2020〕1号")], "id int, text string, own string")
    assert Rel.repeal_targets(df.drop("own"), "id").count() == 1
    assert Rel.relation_edges(df, "id", own_number="own").count() == 0


def test_document_kinds(spark):
    rows = [("解读某公告", "内容"), ("公告", "《旧的办法》同时废止"), ("公告", "对《某某办法》作如下修改"), ("公告", "新规定")]
    df = spark.createDataFrame(rows, "t string, x string")
    got = [r[0] for r in df.select(Rel.document_kind(F.col("t"), F.col("x"))).collect()]
    assert got == ["interpretation", "repealed", "amended", "new_scenario"]


def test_impact_matches_exact_then_contained(spark):
    docs = spark.createDataFrame([(1, "", "《增值税暂行条例》同时废止。废止《没有的办法名》。修改《发票管理办法》")], "id int, title string, text string")
    regs = spark.createDataFrame(
        [(10, "增值税暂行条例"), (11, "增值税暂行条例实施细则"), (12, "中华人民共和国发票管理办法")], "rid int, name string"
    )
    rows = {r.named_title: (r.relation, r.regulation_id, r.match_kind) for r in
            Rel.impact_edges(docs, regs, "id", "title", "text", "rid", "name").collect()}
    assert rows == {
        "增值税暂行条例": ("repealed", 10, "exact"),
        "没有的办法名": ("repealed", None, "unknown"),
        "发票管理办法": ("amended", 12, "contained"),
    }


def test_containment_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(120)]
    needles = []
    for i in range(60):
        source = texts[rng.randrange(120)][1]
        a = rng.randrange(len(source))
        needles.append((i, source[a : a + rng.randrange(1, 60)]))
    needles.append((99, "not there at all in any text"))
    tdf = spark.createDataFrame(texts, "t int, x string")
    ndf = spark.createDataFrame(needles, "n int, y string")
    want = {(t, n) for t, x in texts for n, y in needles if y and y in x}
    got = {(r.t, r.n) for r in Mt.passages_in_texts(tdf, ndf, "t", "x", "n", "y").collect()}
    assert got == want


def test_duplicates_and_numbering(spark):
    df = spark.createDataFrame(
        [(3, "某 办法", "短", None, 1), (1, "某办法", "更长的内容", None, 9), (2, "另一办法", "x", "财税1号", 1), (7, "另一办法", "yy", None, 50)],
        "id int, title string, content string, document_number string, size int",
    )
    assert {(r.id, r.copies) for r in C.longest_per_title(df, "id").collect()} == {(1, 2), (7, 2)}
    assert {(r.id, r.file_no) for r in C.best_files(df, "id").collect()} == {(1, 1), (2, 2)}


def test_numbering_carries_over_buckets(spark):
    df = spark.range(0, 1000, 3)
    rows = C.number_rows(df, "id", "n", partitions=7).orderBy("id").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def test_numbering_of_large_ids_texts_and_ties(spark):
    big = [(1 << 62) + 3 * i for i in range(200)] + [-(1 << 61) + i for i in range(100)] + [None] * 3
    df = spark.createDataFrame([(i, str(i)) for i in big], "id long, t string").repartition(5)
    rows = C.number_rows(df, "id", "n", partitions=6).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.n)] == [None] * 3 + sorted(i for i in big if i is not None)
    assert sorted(r.n for r in rows) == list(range(1, 304))
    same = spark.range(500).select(F.lit("x").alias("t"), "id").repartition(4)
    spread = C.number_rows(same, "t", "n", partitions=4)
    assert sorted(r.n for r in spread.collect()) == list(range(1, 501))
    assert C.number_rows(df.filter("false"), "id").collect() == []


def test_import_is_idempotent(spark):
    schema = "id int, domain_id string, hierarchy_level string, document_number string, title string"
    batch = spark.createDataFrame(
        [(1, "d", "law", None, "甲法"), (2, "d", "law", None, "甲法"), (3, "d", "n", "财税1号", "乙"), (4, "d", "n", "财税1号", "改名")], schema
    )
    none = batch.filter("false")
    assert {r.id for r in C.new_regulations(batch, none, "id").collect()} == {1, 3}
    assert C.new_regulations(batch, batch, "id").count() == 0


def test_import_goes_by_number_then_title_in_order(spark):
    schema = "id int, domain_id string, hierarchy_level string, document_number string, title string"
    rows = [
        (1, "d", "n", "1号", "甲"), (2, "d", "n", "1号", "乙"), (3, "d", "n", "2号", "乙"), (4, "d", "n", None, " 乙 "),
        (5, "d", "n", None, ""), (6, "d", "n", "", None), (7, "d", "law", "1号", "甲"), (8, None, None, None, "丙"),
        (9, None, None, "9号", "丙"), (10, "d", "n", "3号", "库"), (11, "d", "n", "7号", "丁"), (11, "d", "n", "7号", "丁"),
    ]
    batch = spark.createDataFrame(rows, schema)
    known = spark.createDataFrame([(0, "d", "n", None, "库"), (0, "d", "n", "8号", None)], schema)
    # 2 goes for its number and leaves its title to 3; 4 is a twin of 3 without a number; 5 and 6 have no key.
    added = sorted(r.id for r in C.new_regulations(batch, known, "id").collect())
    assert added == [1, 3, 5, 6, 7, 8, 11]


def test_corpus_merge_adds_nothing_twice(spark, tmp_path):
    schema = "regulation_id int, domain_id string, hierarchy_level string, document_number string, title string"
    regs = spark.createDataFrame([(1, "a", "n", "1号", "甲"), (2, "a", "n", None, "甲"), (3, "b", "n", None, "乙")], schema)
    parts = spark.createDataFrame([(i, "b" if i == 3 else "a", "article", f"x{i}") for i in (1, 2, 3)], "regulation_id int, domain_id string, level_code string, content string")
    for name in ("first", "first", "second"):
        W.merge_corpus(regs, parts, parts, str(tmp_path), name, "regulation_id", "regulation_id")
    for table in ("regulations", "articles", "versions"):
        assert sorted(r.regulation_id for r in spark.read.parquet(f"{tmp_path}/{table}").collect()) == [1, 3]
    more = regs.filter("regulation_id = 3").withColumn("title", F.lit("丙"))
    W.merge_corpus(more, parts, parts, str(tmp_path), "third", "regulation_id", "regulation_id")
    assert spark.read.parquet(f"{tmp_path}/regulations").count() == 3
