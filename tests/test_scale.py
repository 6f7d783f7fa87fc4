"""Work that grew faster than its input: what it does now, on rows of its own."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions import vectors as V
from lexframe.operators import matching as Mt
from lexframe.operators import structure as S
from lexframe.operators import verify as Vf
from lexframe.sources import inbox_source as Ib
from lexframe.streaming import deadlines as D
from lexframe.streaming import jobs as J


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parsed(spark):
    rows = [(1, "财税[2024]7号\n关于某事的办法\n第一条 自2024年2月3日起施行。\n第一条 又。", "u"), (2, "", None), (3, None, "u")]
    return S.parse_header(spark.createDataFrame(rows, "id long, text string, source_url string"))


def test_header_searches_a_text_for_each_date_once(spark):
    header = parsed(spark)
    # The long text is matched whole once; parts of the date are read from the match.
    assert plan_of(header).count("regexp_extract(coalesce(text") == 2
    rows = {r.id: r for r in header.collect()}
    assert rows[1].document_number == "财税〔2024〕7号" and rows[1].title == "关于某事的办法"
    assert str(rows[1].effective_date) == "2024-02-03" and rows[1].expiry_date is None
    assert rows[2].title == "" and rows[3].document_number is None


def test_blocks_are_numbered_with_two_sorts_and_cut_once(spark):
    blocks = S.split_blocks(parsed(spark), "id")
    plan = plan_of(blocks)
    assert plan.count("Sort [") == 2 and plan.count("Exchange") == 1
    found = [(r.id, r.full_no) for r in blocks.orderBy("id", "order_index").collect()]
    assert found == [(1, "第一条"), (1, "第一条（2）")]


def test_unknown_articles_of_short_and_long_regulations_agree(spark):
    articles = spark.createDataFrame([(1, "第一章 总则 第二条"), (1, "第三条"), (2, "第一章 总 则 第二条"), (None, "第九条")], "regulation_id long, full_no string")
    named = [(1, "第二条"), (1, "章总则第"), (1, "第九条"), (2, "总则第二条"), (2, "第三条"), (9, "第二条"), (1, "第九条")]
    rows = spark.createDataFrame(named, "found_regulation long, _article string")
    want = sorted([(1, "第九条"), (1, "第九条"), (2, "第三条"), (9, "第二条")])
    for few in (0, 1, 256):
        found = Vf._without_article(rows, articles, Vf.large_regulations(articles, few)).select("found_regulation", "_article").collect()
        assert sorted(tuple(r) for r in found) == want


def test_many_files_share_partitions(spark, tmp_path):
    folder = str(tmp_path / "in")
    Ib.register(spark)
    Ib.put_files(folder, [(f"{i:04d}.txt", str(i)) for i in range(300)])
    df = spark.read.format("lex_inbox").load(folder)
    assert df.rdd.getNumPartitions() <= Ib.SINGLE_FILES
    assert sorted((r.name, r.content) for r in df.collect()) == [(f"{i:04d}.txt", str(i)) for i in range(300)]
    large = [(f"p{i}", f"n{i}", Ib.PACK_BYTES) for i in range(500)] + [("s", "s", 1)] * 500
    packs = [p.value for p in Ib._packs(large)]
    assert [f for p in packs for f in p] == [f[:2] for f in large]
    assert max(map(len, packs[:500])) == 1 and Ib._packs([]) == []


def test_keys_of_a_bucket_keep_their_own_marks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BUCKETS", 1)
    start = datetime(2024, 3, 1)
    rows = [("a", 0, "open"), ("b", 1, "open"), (None, 2, "open"), ("b", 3, "close"), (None, 4, "close"), ("c", 30, "open"), ("z", 99, "close")]
    schema = "k string, ts timestamp_ntz, kind string"
    df = spark.createDataFrame([(k, start + timedelta(hours=h), kind) for k, h, kind in rows], schema)
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    marks = D.marks(stream, "k", "ts", F.col("kind") == "open", F.col("kind") == "close", 24)
    found = J.run(marks, "marks", folder=str(tmp_path / "job"), settings=D.STORE_CHOICE).collect()
    assert sorted((str(r.k), r.state) for r in found) == [("None", "in_time"), ("a", "overdue"), ("b", "in_time"), ("c", "overdue")]


def test_a_large_log_lands_in_several_files_a_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "SLICE_ROWS", 10)
    rows = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    J.land_in_order(rows, "ts", str(tmp_path / "log"), 4)
    assert len(list((tmp_path / "log").glob("*.parquet"))) > 4
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list(range(400))


def test_short_needles_of_each_length_are_found(spark):
    texts = spark.createDataFrame([(1, "ein kurzer text"), (2, "ab"), (3, None)], "t long, text string")
    needles = spark.createDataFrame([(1, "ab"), (2, "kurz"), (3, "kurzer"), (4, "x"), (5, "")], "n long, needle string")
    found = sorted(tuple(r) for r in Mt.titles_in_texts(texts, needles, "t", "text", "n", "needle").collect())
    assert found == [(1, 2), (1, 3), (1, 4), (2, 1)]


def test_best_sentence_rates_each_sentence_once(spark):
    rows = spark.createDataFrame([("没有。减按5%征收；还有。",), ("",), (None,)], "t string").select(T.best_sentence(F.col("t")).alias("b"))
    assert [r.b for r in rows.collect()] == ["减按5%征收；", "", ""]
    assert plan_of(rows).count("array_max") == 1


def test_embedder_holds_few_texts_and_bounded_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "KNOWN_BYTES", 3 * 8 * 16)
    texts = [f"a{i} b{i} gemeinsam" for i in range(7)]
    one = V.hash_embedder(16)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert V.dense_vectors(rows, "id", "text", dim=16).count() == 7
    counts = [dict.fromkeys(t.split(), 1) for t in texts]
    small = one(counts)
    known = dict(zip(one.__code__.co_freevars, one.__closure__))["known"].cell_contents
    assert len(known) <= 3
    monkeypatch.setattr(V, "KNOWN_BYTES", 64 << 20)
    assert all((a == b).all() for a, b in zip(small, V.hash_embedder(16)(counts)))


def test_questions_beyond_a_matrix_are_scored_against_a_block_sent_once(spark):
    docs = spark.createDataFrame([(d, f"t{t}", 1.0 + d) for d in range(4) for t in range(9)], "doc_id long, term string, weight double")
    asked = spark.createDataFrame([(q, f"t{q}", 1.0) for q in range(9)], "question_id long, term string, weight double")
    found = V.sparse_topk(docs, asked, 2, chunk_rows=2)
    assert sorted((r.question_id, r.doc_id, r["rank"]) for r in found.collect()) == sorted((q, d, 4 - d) for q in range(9) for d in (2, 3))
