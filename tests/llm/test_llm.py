import random

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import bpe, crf, knn, packing, secrets
from logweave.llm.conversations import conversations
from logweave.llm.subjects import subjects_of

KINDS = [("user", "user", True), ("assistant", "assistant", True), ("system", None, False)]


def test_secrets():
    text = 'é API_KEY=<your-key> password: "********" DB_PASSWORD=Velvet-quartz56! x token: ${T} postgres://a:pw9x7yQ@h/d'
    data = text.encode()
    found = secrets.find(data)
    assert [data[f.start : f.end] for f in found] == [b"Velvet-quartz56!", b"pw9x7yQ"]
    assert b"Velvet" not in secrets.redact(data, found) and secrets.find(b"") == []


def test_merge_is_by_rank_and_lexicon_agrees():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 301, b"aa": 302}
    assert bpe.merge(b"abc", ranks) == [301] and bpe.merge(b"xbcab", ranks) == [120, 299, 300] and bpe.merge(b"aaa", ranks) == [302, 97]
    words = [b"a", b"abc", b"bc", b"zabc"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, lambda w: bpe.merge(w, ranks)))
    numbers = lexicon.numbers([*words, b"zz", b"", b"ab"])
    assert sorted(numbers[:4]) == [0, 1, 2, 3] and list(numbers[4:]) == [-1, -1, -1]
    assert [list(lexicon.ids_of(i)) for i in numbers[:4]] == [bpe.merge(w, ranks) for w in words]


def test_encoder_that_forgets_still_knows_the_words_at_hand():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300}
    small = bpe.Encoder(ranks, None, most=3)
    for texts in (["one two"], ["three four five six seven", None, ""], ["ab ab", "one"]):
        got = small.encode(texts)
        assert got == bpe.Encoder(ranks, None).encode(texts)
        assert [bytes(b for i in row for b in (b"ab" if i == 300 else bytes([i]))).decode() for row in got] == [t or "" for t in texts]


def test_encode_texts_round_trip(spark):
    """Against a public implementation, with null, empty, blank, long and repeated texts and a clashing column."""
    import tiktoken

    ranks = bpe.load_ranks()
    want = tiktoken.Encoding("plain", pat_str=bpe.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  \n", "Grüße 你好 <|endoftext|> it's 42", "ab " * 3000, "x" * 5000, "x" * 5000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df, lexicon=bpe.build_lexicon(df)).collect()}
    assert [got[i] for i in range(len(texts))] == [want.encode(t, disallowed_special=()) if t else [] for t in texts]
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_packing():
    r = random.Random(1)
    packer, used = packing.Packer(100), {}
    for _ in range(2000):
        n = r.randint(0, 60)
        box = packer.put(n)
        used[box] = used.get(box, 0) + n
    assert max(used.values()) <= 100 and sum(used.values()) > 0.97 * 100 * len(used)
    grid = np.stack(np.meshgrid(np.arange(8), np.arange(8), indexing="ij"), -1).reshape(-1, 2)
    order = np.argsort(packing.hilbert(grid, 3))
    assert np.abs(np.diff(grid[order], axis=0)).sum(1).max() == 1


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    emit, trans, chain = rng.normal(size=(9, 3)), rng.normal(size=(4, 3)), np.array([0, 0, 0, 0, 1, 1, 2, 2, 2])
    got = crf.viterbi(emit, chain, trans)
    from itertools import product

    for c in range(3):
        at = np.flatnonzero(chain == c)
        best = max(product(range(3), repeat=len(at)), key=lambda y: trans[3, y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(emit[i, k] for i, k in zip(at, y)))
        assert tuple(got[at]) == best


def test_conversations(spark):
    rows = [
        ("a", 1, " USER", "hi", "2026-01-01T00:00:00Z"), ("a", 2, "assistant", "yo", "1767225660000"), ("a", 2, "assistant", "yo", "1767225660000"), ("a", 3, "user", " ", "2026-01-01 00:02:00"),
        ("b", 1, "user", "x", "2026-01-01T00:00:00Z"), ("c", 1, "assistant", "x", "2026-01-01T00:00:00Z"), ("d", 1, "user", "x", "yesterday"), ("d", 2, "assistant", "x", "2026-01-01T00:00:00Z"),
        ("e", 1, "user", "x", "2026-01-01T00:00:00Z"), ("e", 2, "assistant", "y", "2026-01-01T00:00:01Z"), ("e", 2, "assistant", "z", "2026-01-01T00:00:01Z"), (None, 1, "user", "x", None), ("f", 1, "system", None, None),
    ]
    schema = "sid string, line_no long, event_type string, message string, event_ts string"
    kinds = spark.createDataFrame(KINDS, "kind string, speaker string, carries_message boolean")
    got = sorted(tuple(r) for r in conversations(spark.createDataFrame(rows, schema), kinds).drop("conv_no").collect())
    assert got == [("a", 1, "user", 1), ("a", 2, "assistant", 2)]
    assert conversations(spark.createDataFrame([], schema), kinds).count() == 0


@pytest.mark.parametrize("cell_size", [1000, 20])
def test_knn_with_copies_and_bad_rows(spark, cell_size):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 150)] + 0.2 * rng.normal(size=(150, 16))).astype(np.float32)
    x[100:110] = x[0]
    rows = [(f"s{i:03d}", [float(v) for v in x[i]]) for i in range(150)] + [("bad1", None), ("bad2", []), ("bad3", [0.0] * 16), ("bad4", [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "sid string, embedding array<float>")
    got = {(r.sid_a, r.sid_b) for r in knn.neighbour_pairs(df, 3, dim=16, settings=knn.Settings(cell_size=cell_size, probes=5)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"s{i:03d}", f"s{j:03d}"))) for i in range(150) for j in sorted(range(150), key=lambda j: (-s[i, j], j))[:3]}
    assert len(got & want) / len(want) > 0.97 and len(got) < 1.05 * len(want)


def test_subjects_on_empty_and_null(spark):
    subjects = spark.createDataFrame([("sport", "Games and athletes")], "subject string, description string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert subjects_of(docs, subjects, labels).count() == 0


def test_pii_tokens():
    t = crf.tokenize(["IlvitaVelmora 12ab é_x", ""])
    assert [t.text(i) for i in range(len(t.start))] == ["Ilvita", "Velmora", "12", "ab", "é", "_", "x"]
    assert pa.array(t.doc).to_pylist() == [0] * 7


def test_knn_group_over_many_cells(spark):
    """One tight group fills far more cells than were ever probed; no neighbour may be lost."""
    rng = np.random.default_rng(4)
    x = (np.ones(16) + 0.4 * rng.normal(size=(1200, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"s{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "sid string, embedding array<float>")
    got = {(r.id, r.other) for r in knn.nearest(df, 3, dim=16, settings=knn.Settings(cell_size=10, probes=3, block=64)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"s{i:04d}", f"s{j:04d}") for i in range(1200) for j in np.argsort(-s[i], kind="stable")[:3]}
    assert len(got & want) > 0.995 * len(want)


@pytest.mark.parametrize(
    "text",
    [
        'variable "db_password" { default = "Velvet-quartz56!" }',
        '{"name": "DB_PASSWORD", "value": "Velvet-quartz56!"}',
        "- value: Velvet-quartz56!\n  name: DB_PASSWORD\n",
        "password:\n  prod: Velvet-quartz56!\nother: x\n",
        "[app.passwords]\nprod = Velvet-quartz56!\n",
        '{"password": {"envs": {"prod": "Velvet-quartz56!"}}}',
    ],
)
def test_secret_below_a_sensitive_parent(text):
    assert [text.encode()[f.start : f.end] for f in secrets.find(text.encode())] == [b"Velvet-quartz56!"]


def test_no_secret_beside_a_sensitive_parent():
    for text in ("password:\n  host: db-primary01\nzone: north-west42\n", "[passwords]\n\nThe build b7Fast42x is out.\n", '{"token": {"type": "Opaque2x"}, "build": "b7Fast42x"}'):
        assert secrets.find(text.encode()) == []


def _grouped(spark, rows: int, size: int = 20, dim: int = 64):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(rows // size, dim)), size, axis=0) + 0.4 * rng.normal(size=(rows, dim))
    x = x[rng.permutation(rows)].astype(np.float32)
    return x, spark.createDataFrame([(f"s{i:05d}", x[i].tolist()) for i in range(rows)], "sid string, embedding array<float>")


def test_knn_is_exact_when_the_sample_misses_groups(spark):
    """Nothing that is fitted on the sample may decide which neighbours are found."""
    x, df = _grouped(spark, 1200)
    near = knn.nearest(df, 5, dim=64, settings=knn.Settings(block=128, sample=20))
    got = {(r.id, r["rank"]): r.other for r in near.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(f"s{i:05d}", j + 1): f"s{o:05d}" for i in range(1200) for j, o in enumerate(np.argsort(-s[i], kind="stable")[:5])}


def test_knn_centroids_share_or_fill_blocks():
    """Near small centroids share a block up to half its rows; only one larger than a block is cut."""
    centroids = np.eye(4)[[0, 1, 0, 1, 2]] + 0.01 * np.arange(5)[:, None]
    start, parts = knn._blocks(np.array([30.0, 30, 20, 20, 250]), centroids, 100)
    assert start.tolist() == [0, 1, 0, 1, 2] and parts.tolist() == [1, 1, 1, 1, 3]
