"""Bucketed joins, nested trees, the inbox source, deadlines and restarts."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexframe.operators.nested import nested_tree
from lexframe.sources import bucketed as B
from lexframe.sources import inbox_source as Ib
from lexframe.sources import writers as W
from lexframe.streaming import deadlines as D
from lexframe.streaming import jobs as J

START = datetime(2024, 3, 1)


def test_articles_join_in_their_buckets(spark):
    regs = spark.range(300).select(F.col("id").alias("regulation_id"), F.lit("t").alias("title"), F.lit("law").alias("hierarchy_level"))
    arts = regs.select("regulation_id", F.explode(F.expr("sequence(1L, 5L)")).alias("article_no")).withColumn("full_no", F.col("article_no").cast("string"))
    vers = arts.select("regulation_id", "article_no", F.lit("x").alias("content"), F.lit("v").alias("title"))
    joined = B.write_bucketed(regs, arts, vers, 8).joined(spark)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    rows = joined.collect()
    assert len(rows) == 1_500 and {r.title for r in rows} == {"v"} and joined.columns.count("title") == 1


def test_nested_tree_of_six_levels(spark):
    nodes = [(1, None, 0, "r"), (2, 1, 2, "b"), (3, 1, 1, "a"), (4, 2, 0, "c"), (5, 4, 0, "d"), (6, 5, 0, "e"), (7, 6, 0, "f"), (8, 99, 0, "orphan"), (9, 10, 0, "x"), (10, 9, 0, "y")]
    nodes += [(3, 1, 9, "again"), (5, 4, 7, "again")]
    df = spark.createDataFrame(nodes, "id long, up long, place int, no string")
    vers = spark.createDataFrame([(3, 2, "new"), (3, 1, "old"), (7, 1, 'q"}')], "id long, version int, content string")
    found = {r.id: r for r in nested_tree(df, vers, "id", "up", "place", ["no"]).collect()}
    assert {i: (r.nodes, r.levels) for i, r in found.items()} == {1: (7, 6), 8: (1, 1)}
    tree = json.loads(found[1].tree)
    assert [c["no"] for c in tree["children"]] == ["a", "b"]
    assert [v["content"] for v in tree["children"][0]["versions"]] == ["old", "new"]
    deep = tree["children"][1]
    for no in "cdef":
        deep = deep["children"][0]
        assert deep["no"] == no
    assert deep["versions"] == [{"version": 1, "content": 'q"}'}] and deep["children"] == []
    assert nested_tree(df.filter("false"), vers, "id", "up", "place").count() == 0


def test_inbox_source_reads_and_streams(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    Ib.register(spark)
    Ib.put_files(folder, [("b.txt", "zwei"), ("a.txt", "ä"), ("skip.bin", "no")])
    with open(os.path.join(folder, "c.md"), "wb") as file:
        file.write("税务".encode("gb18030"))
    df = spark.read.format("lex_inbox").load(folder)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.name, r.size, r.content) for r in df.collect()) == [("a.txt", 2, "ä"), ("b.txt", 4, "zwei"), ("c.md", 4, "税务")]
    J.run(spark.readStream.format("lex_inbox").load(folder), "inbox", folder=base)
    Ib.put_files(folder, [("d.txt", "vier")])
    done = J.run(spark.readStream.format("lex_inbox").load(folder), "inbox", folder=base)
    assert sorted((r.name, r.batch_id) for r in done.collect()) == [("a.txt", 0), ("b.txt", 0), ("c.md", 0), ("d.txt", 1)]
    assert spark.read.format("lex_inbox").load(str(tmp_path / "none")).count() == 0


def log(spark, rows, schema):
    return spark.createDataFrame([(k, START + timedelta(hours=h), *rest) for k, h, *rest in rows], schema)


def test_overdue_marks_need_no_later_row_of_the_key(spark, tmp_path):
    schema = "k long, ts timestamp_ntz, kind string"
    rows = [(1, 0, "open"), (2, 1, "open"), (2, 20, "close"), (3, 2, "open"), (3, 30, "close"), (4, 3, "close"), (1, 40, "open"), (5, 24, "open"), (9, 90, "close")]
    first = [r for r in rows if r[1] < 10]
    log(spark, first, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))

    def run():
        marks = D.marks(stream, "k", "ts", F.col("kind") == "open", F.col("kind") == "close", 24)
        return J.run(marks, "marks", folder=str(tmp_path / "job"), settings=D.STORE_CHOICE)

    assert run().count() == 0
    log(spark, [r for r in rows if r[1] >= 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    found = sorted((r.k, r.opened_at, r.state) for r in run().collect())
    hour = lambda h: START + timedelta(hours=h)
    assert found == [(1, hour(0), "overdue"), (1, hour(40), "overdue"), (2, hour(1), "in_time"), (3, hour(2), "overdue"), (5, hour(24), "overdue")]


def test_first_listing_comes_once_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("https://x.org/a", START), ("https://x.org/b/", START)], "url string, ts timestamp_ntz")
    known = spark.createDataFrame([("https://x.org/known",)], "url string")
    step = J.first_listed(known, "url", "ts", 4)
    one = step(rows, None)
    assert one.count() == 2
    again = step(rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 DAYS")), one)
    assert again.count() == 0
    more = spark.createDataFrame([("https://x.org/known", START), ("https://x.org/c", START), ("https://x.org/c", START)], "url string, ts timestamp_ntz")
    assert [r.url for r in step(more, one).collect()] == ["https://x.org/c"]


def test_open_sessions_follow_closed_ones(spark):
    events = log(spark, [(1, 0), (1, 0.2), (1, 5), (1, 5.3), (2, 6)], "user_id long, ts timestamp_ntz")
    closed = spark.createDataFrame([(1, START, START + timedelta(hours=0.7), 2)], "user_id long, started_at timestamp, ends_at timestamp, asks long")
    found = sorted((r.user_id, r.asks) for r in J.open_sessions(closed, events, "user_id", "ts").collect())
    assert found == [(1, 2), (2, 1)]


def entries(spark, rows):
    return spark.createDataFrame(rows, "regulation_id long, point_id string")


def test_refresh_writes_only_changed_buckets_and_goes_on_after_a_stop(spark, tmp_path):
    path, log_path = str(tmp_path / "index"), str(tmp_path / "decisions")
    W.create_index(entries(spark, [(i, f"p{i}") for i in range(40)]), path, "regulation_id", 8)
    now = entries(spark, [(i, f"q{i}") for i in range(40) if i != 7])
    spark.createDataFrame([(3,), (7,)], "regulation_id long").coalesce(1).write.parquet(log_path)
    stream = spark.readStream.schema("regulation_id long").parquet(log_path)
    J.refresh_index(stream, now, path, "regulation_id", 8)
    touched = {r.bucket for r in W.manifest(spark, path).filter("version <> 'first'").collect()}
    assert len(touched) <= 2
    state = lambda: {r.regulation_id: r.point_id for r in W.open_index(spark, path).collect()}
    want = {i: f"p{i}" for i in range(40) if i != 7} | {3: "q3"}
    assert state() == want
    # The same batch again changes nothing, and neither does a restart without new decisions.
    W.reindex(spark.createDataFrame([(3,), (7,)], "regulation_id long"), now, path, "regulation_id", 8, "batch-000000000")
    J.refresh_index(stream, now, path, "regulation_id", 8)
    assert state() == want
    spark.createDataFrame([(9,)], "regulation_id long").coalesce(1).write.mode("append").parquet(log_path)
    J.refresh_index(stream, now, path, "regulation_id", 8)
    assert state() == want | {9: "q9"}
    assert sum(r.point_id == f"q{r.regulation_id}" for r in W.open_index(spark, path).collect()) == 2


def test_a_lost_bucket_is_empty(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    W.create_index(entries(spark, [(1, "a")]), path, "regulation_id", 4)
    W.reindex(spark.createDataFrame([(1,)], "regulation_id long"), entries(spark, []), path, "regulation_id", 4, "v2")
    with pytest.raises(StopIteration):
        next(iter(W.open_index(spark, path).collect()))
    assert W.stale_versions(spark, path) == []
