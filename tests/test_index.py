import json

from logweave import schema as S
from logweave.functions.vectors import decode_vector, encode_vector, sampled, snap_left, snap_right, windows
from logweave.operators import fuzzy, search
from logweave.operators.snippets import contexts, deep_contexts
from logweave.sources.logs import events
from logweave.sources.store import SessionStore


def test_modes_and_variants():
    assert S.SearchMode.of("what") is S.SearchMode.FUZZY and S.SearchMode.EXACT.next() is S.SearchMode.FUZZY
    assert search.deletion_variants("abcd") == [] and search.deletion_variants("abcde")[0] == "bcde"


def test_contexts():
    text = "x" * 200 + " Needle " + "é" * 200
    (one,) = contexts(text, "needle", 3)
    assert one.startswith("…") and one.endswith("…") and "Needle" in one
    assert contexts(text, "", 3) == [] and len(contexts("aa aa aa", "aa", 2)) == 2
    assert deep_contexts("the needle", "neeedle", 3) and not deep_contexts("x", "neeedle", 3)


def test_windows_and_codec():
    assert windows("a" * 1000) == ["a" * 1000] and [len(w) for w in windows("a" * 1001)] == [800, 301]
    assert "".join(windows("é" * 700)).count("é") >= 700
    assert sampled(32) == list(range(32)) and len(set(sampled(100))) == 32
    assert decode_vector(encode_vector([1.5, -2.0]) + b"x") == [1.5, -2.0]
    assert snap_left("é".encode(), 1) == 0 and snap_right("é".encode(), 1) == 2


def test_fuzzy_score():
    w = S.FuzzyScoring()
    contiguous, gapped, none = fuzzy.score_batch(["lanternfish map", "lan-tenfish", "zzz"], "lantefish", w)
    assert contiguous >= 16 * 8 and gapped > 0 and none == -1
    assert fuzzy.positions("a lantefish", "lantefish") == list(range(2, 11))


def test_sync(spark, tmp_path):
    root, p = tmp_path / "logs", tmp_path / "logs" / "proj"
    p.mkdir(parents=True)
    user = {"type": "user", "timestamp": "2026-01-02T03:04:05Z", "cwd": "/w/app/", "message": {"content": "hello\tworld"}}
    (p / "s1.jsonl").write_text(json.dumps(user) + "\r\nbroken\n" + json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}]}}) + "\n")
    (p / "s2.jsonl").write_text(json.dumps({"type": "system"}) + "\n")
    store = SessionStore(spark, str(tmp_path / "index"))
    store.sync(str(root))
    (row,) = store.read().collect()
    assert (row.sid, row.msg_count, row.label, row.project, row.created, row.search_text) == ("s1", 2, "hello world", "app", "2026-01-02", "hello world hi")
    (p / "s1.jsonl").unlink()
    store.sync(str(root))
    assert store.read().count() == 0


def test_lines_are_numbered_over_splits_and_bad_bytes_are_left_out(spark, tmp_path):
    from logweave.sources.logs import find_session, list_sessions, read_lines

    p = tmp_path / "logs" / "proj"
    p.mkdir(parents=True)
    body = [b"line %d" % i for i in range(400)]
    body[7] = b"\xff\xfe"
    body[9] += b"\r"
    (p / "big.jsonl").write_bytes(b"\n".join(body) + b"\n")
    (p / "two.jsonl").write_bytes(b"a\n\xc3(\nb")
    (p / "x.jsonl.bak").write_bytes(b"no\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = read_lines(spark, str(tmp_path / "logs" / "*" / "*.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.line_no: r.value for r in rows if r.sid == "big"} == {i: f"line {i}" for i in range(400) if i != 7}
    assert {r.line_no: r.value for r in rows if r.sid == "two"} == {0: "a", 2: "b"}
    files = list_sessions(spark, str(tmp_path / "logs"))
    assert {r.sid for r in files.collect()} == {"big", "two"}
    assert find_session(files, "two").count() == 1 and find_session(files, "../two").count() == 0 and find_session(files, "none").count() == 0


def test_caps(spark):
    big = json.dumps({"type": "user", "x": "a" * 50_001}, separators=(",", ":"))
    block = {"type": "user", "message": {"content": [{"type": "tool_result", "content": "b" * 4_999}, {"type": "tool_result", "content": "c" * 5_000}, {"type": "text", "text": "t"}]}}
    df = spark.createDataFrame([("s", 0, big), ("s", 1, json.dumps(block)), ("s", 2, "nope"), ("s", 3, None)], "sid string, line_no long, value string")
    rows = {r.line_no: r for r in events(df).collect()}
    assert rows[0].oversized and rows[0].event_type == "user" and set(rows) == {0, 1}
    assert [len(x) for x in rows[1].tool_results] == [1_500] and rows[1].texts == ["t"]
