"""Readers, sinks, index refresh and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lexframe.functions.routing import route_questions
from lexframe.operators import planning as P
from lexframe.rules import tax as XR
from lexframe.sources import readers as Rd
from lexframe.sources import writers as W
from lexframe.streaming import jobs as J


def test_inbox_scan_decode_and_sidecar(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("增值税", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes("企业所得税公告".encode("gbk"))
    for name in (".hidden.txt", "_list.txt", "c.pdf"):
        (tmp_path / name).write_text("x")
    (tmp_path / "a.meta.json").write_text(json.dumps({"title": "标题", "source_url": "https://s"}), encoding="utf-8")
    (tmp_path / "sub" / "b.meta.json").write_text("{broken")
    rows = {r.filename: r for r in Rd.collect_inbox(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in rows.items()} == {"a.txt": "增值税", "b.md": "企业所得税公告"}
    assert rows["a.txt"].source_url == "https://s" and rows["a.txt"].title == "标题"
    assert rows["b.md"].title is None and rows["b.md"].source_url.endswith("b.md")


def test_second_collector(spark):
    one = lambda s: s.createDataFrame([("a", "x", "u")], "filename string, text string, source_url string")
    assert Rd.collect_all(spark, [one, one]).count() == 2


def test_bundle_and_listing(spark, tmp_path):
    path = tmp_path / "bundle.json"
    docs = [{"title": "甲", "jurisdiction": "CN"}, {"title": "乙", "jurisdiction": "EU"}]
    path.write_text(json.dumps({"documents": docs}, indent=1), encoding="utf-8")
    assert [r.title for r in Rd.read_bundle(spark, str(path), "CN").collect()] == ["甲"]
    rows = spark.createDataFrame([(2, "《税收》公告"), (1, "税收公告"), (3, "天气")], "listed_no int, title string")
    assert [r.listed_no for r in Rd.listing(rows).collect()] == [1]


def test_flatten_meta_first_value_wins(spark):
    schema = "m array<struct<resultList: array<struct<key: string, value: string>>>>"
    df = spark.createDataFrame([([([("a", "null"), ("a", "1"), ("b", " ")],), (None,), ([("a", "2"), ("c", "x")],)],)], schema)
    assert df.select(Rd.flatten_meta(F.col("m"))).first()[0] == {"a": "1", "c": "x"}


def test_rule_files(spark, tmp_path):
    good = {"rates": [{"rate": "13%", "name": "n", "citation": "c", "keywords": ["k"]}], "surcharges": list(XR.SURCHARGES), "discounts": []}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps({**good, "rates": [{"rate": "13", "citation": "c"}]}))
    assert Rd.load_tax_rules(spark, str(tmp_path / "good.json"))["rates"][0]["rate"] == "13%"
    with pytest.raises(XR.RuleError):
        Rd.load_tax_rules(spark, str(tmp_path / "bad.json"))
    tech = {"code": "t", "category": "递延型", "risk_level": "green", "cost": "低", "citations": ["c"], "conditions": [["n", ">", 1]]}
    (tmp_path / "t1.json").write_text(json.dumps({"techniques": [tech]}))
    (tmp_path / "t2.json").write_text(json.dumps({"techniques": [{**tech, "cost": "高"}]}))
    loaded = Rd.load_techniques(spark, str(tmp_path / "t1.json"), str(tmp_path / "t2.json"))
    assert [t["cost"] for t in loaded] == ["高"]
    df = spark.createDataFrame([(1, 5)], "id int, n int")
    assert P.match_techniques(df, loaded).first().matched is True


def test_packs_and_conflicts(spark, tmp_path):
    pack = {"domain_id": "a", "status": "active", "keywords": ["x", "y"], "include": [], "exclude": []}
    (tmp_path / "a.json").write_text(json.dumps(pack))
    (tmp_path / "b.json").write_text(json.dumps({**pack, "domain_id": "b", "keywords": ["y"]}))
    packs = Rd.load_packs(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert [(r.keyword, r.domains) for r in Rd.keyword_conflicts(spark, packs).collect()] == [("y", ["a", "b"])]
    df = spark.createDataFrame([("x y",)], "text string")
    assert route_questions(df, "text", packs).first().needs_clarification


def _entries(spark, rows):
    return spark.createDataFrame(rows, "regulation_id int, point_id string, effect_status string")


def test_reindex_is_idempotent_and_takes_down(spark, tmp_path):
    path = str(tmp_path / "index")
    W.create_index(_entries(spark, [(1, "a", "effective"), (1, "b", "effective"), (2, "c", "effective"), (3, "d", "effective")]), path, "regulation_id", 4)
    now = _entries(spark, [(1, "a2", "effective"), (3, "d", "effective")])
    changed = spark.createDataFrame([(1,), (2,)], "regulation_id int")
    for _ in range(2):
        W.reindex(changed, now, path, "regulation_id", 4)
        got = {(r.regulation_id, r.point_id) for r in W.open_index(spark, path).collect()}
        assert got == {(1, "a2"), (3, "d")}


def test_snapshot_survives_a_failed_build(spark, tmp_path):
    path = str(tmp_path / "snap")
    W.publish_snapshot(_entries(spark, [(1, "a", "effective")]), path)
    bad = _entries(spark, [(1, "a", "effective")]).select(F.raise_error(F.lit("no embedder")).cast("string").alias("x"))
    with pytest.raises(Exception):
        W.publish_snapshot(bad, path)
    assert W.read_index(spark, path).count() == 1
    W.publish_snapshot(_entries(spark, [(2, "b", "repealed"), (3, "c", "effective")]), path)
    index = W.read_index(spark, path)
    assert {r.regulation_id for r in W.purge(index).collect()} == {3}
    update = spark.createDataFrame([(2, "effective")], "regulation_id int, effect_status string")
    assert W.purge(W.update_payload(index, update, "regulation_id")).count() == 2


def test_records_append(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3)
    W.append_records(rows, path)
    W.append_records(rows, path)
    assert spark.read.parquet(path).count() == 6


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    folder = tmp_path / "in"
    events = spark.range(400).select(
        F.col("id"), (F.col("id") % 7).alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"),
    )
    events.repartition(4, "k").write.parquet(str(folder))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    rows = J.newest(J.run(J.gap_counts(stream, F.col("k").cast("string"), F.lit("r")), "t", "update"), ["topic", "reason"])
    assert {r.topic: r.occurrences for r in rows.collect()} == {str(k): 400 // 7 + (k < 400 % 7) for k in range(7)}
    life = J.lifecycle(stream, "k", "ts", F.col("id") < 14, F.col("id") > 100)
    done = J.sla(J.newest(J.run(life, "l", "update"), ["k"]), 1, F.lit("2024-01-02").cast("timestamp_ntz"))
    assert {r.state for r in done.collect()} == {"late"}
