import json

from logweave.operators.incremental import IncrementalTable, sync_plan
from logweave.operators.nested import flatten_blocks, flatten_lists
from logweave.operators.reject import Kinds, loaded, rejected, split_records
from pyspark.sql import functions as F

KINDS = Kinds(frozenset({"user", "system"}), frozenset({"user"}))


def lines(spark, values):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "line_id long, value string, reason string")


def test_reject(spark):
    values = [
        None, "", " \t\r\n", "{", "[1]", '{"type":"user"}', '{"type":"nope"}', '{"type":5}', '{"type":"user","message":{"content":null}}', '{"type":"user","message":{"content":[1]}}',
        '{"type":"user","message":{"content":[{"type":"t"}]}}', '{"type":"user","message":{}}', '{"type":"system","message":3}', '{"type":"user","message":{"content":"x"}} x', "\ufeff{}",
    ]
    split = split_records(lines(spark, values), KINDS)
    got = {r.line_id: r.reason for r in rejected(split).collect()}
    assert got == {3: "syntax", 4: "syntax", 5: "message", 6: "type", 7: "type", 8: "message", 9: "message", 13: "syntax", 14: "syntax"}
    assert sorted(r.line_id for r in loaded(split).collect()) == [10, 11, 12]
    assert rejected(split_records(lines(spark, []), KINDS)).count() == 0


def test_flatten_blocks(spark):
    deep = {"type": "user", "message": {"content": [{"type": "a", "content": [{"type": "b", "content": "leaf"}, 7, {"no": 1}]}, {"type": "text", "text": "é\n"}]}}
    rows = flatten_blocks(lines(spark, [json.dumps(deep), json.dumps({"type": "user", "message": {"content": ""}}), "{"]), KINDS).collect()
    got = {(r.line_id, r.node_path, r.parent_path, r.block_type) for r in rows}
    assert got == {(0, "0", "", "a"), (0, "1", "", "text"), (0, "0.0", "0", "b"), (0, "0.2", "0", None), (0, "0.0.0", "0.0", "text"), (1, "0", "", "text")}
    assert {r.text for r in rows} >= {"leaf", "é\n", ""}


def test_flatten_lists(spark):
    df = spark.createDataFrame([(1, [(5, "a"), None]), (2, []), (3, None)], "id int, xs array<struct<id:int,v:string>>")
    got = [tuple(r) for r in flatten_lists(df, "id", "xs").orderBy("id", "position").collect()]
    assert got == [(1, 0, 5, "a"), (1, 1, None, None)]


def test_sync_plan(spark):
    s = spark.createDataFrame([("same", 100, "d"), ("old", 50, "d"), ("gone", 10, "d"), ("nullday", None, ""), ("later", None, "2030-01-01")], "sid string, mtime_epoch long, modified string")
    t = "timestamp'2026-01-01 00:00:00'"
    rows = [("p1", "same", 100, False), ("p2", "old", 60_000_000_000_000, False), ("p3", "gone", 10, True), ("p4", "new", 7, False), ("p5", "nullday", 9, False), ("p6", "later", 9, False), ("p7", "notime", None, False)]
    f = spark.createDataFrame(rows, "path string, sid string, mtime_epoch long, gone boolean").withColumn("seen_at", F.expr(t)).withColumn("file_id", F.monotonically_increasing_id())
    got = {r.sid: r.sync_action for r in sync_plan(s, f, 4).collect()}
    assert got == {"old": "update", "gone": "delete", "new": "insert", "nullday": "update"}
    assert sync_plan(s.limit(0), f.limit(0)).count() == 0


def test_incremental_table(spark, tmp_path):
    table = IncrementalTable(spark, str(tmp_path / "t"), ["k"], 4)
    a = spark.createDataFrame([(i, i) for i in range(20)], "k int, v int")
    assert len(table.run(a, lambda d: d)) == 4 and table.read().count() == 20
    assert table.run(a, lambda d: d) == []
    b = a.where("k <> 3").withColumn("v", F.when(F.col("k") == 5, 99).otherwise(F.col("v")))
    assert 1 <= len(table.run(b, lambda d: d)) <= 2
    assert sorted(tuple(r) for r in table.read().select("k", "v").collect()) == sorted(tuple(r) for r in b.collect())
