"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

Frequent words are compiled, with their ids, into a minimal acyclic transducer: a shared-suffix
automaton over bytes whose arcs carry how many words lie before them, so that the sum along a
word's path is its number and leads to its ids.  The automaton is one flat file that goes to the
workers through Spark's file distribution and is memory-mapped there.  The distinct words of a
batch run through it side by side; words it lacks are merged exactly, by rank.

Defined results: null and empty texts have no ids; strings of special tokens are ordinary text;
texts of any length are read whole; repeated rows are answered each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.spark import shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 65_536
CACHE_WORDS = 400_000
# Fixed value: the pattern that splits text before the merges.  White space is that of Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPLIT = regex.compile(PATTERN)
MAGIC = 0x4C574658


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank is joined first, the leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i] if part[i] is not None else n
        if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n:
                both = part[a] + part[b]
                if both in ranks:
                    heapq.heappush(heap, (ranks[both], a, len(both)))
    return [ranks[p] for p in part if p is not None]


# The transducer ---------------------------------------------------------------------------


def compile_lexicon(words: Iterable[bytes], ids_of: Callable[[bytes], list[int]]) -> bytes:
    """The automaton of the words as one block of bytes: header, arcs, finals, ids."""
    words = sorted(set(w for w in words if w))
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[list[tuple[int, int]]] = []

    def freeze(node: dict) -> int:
        key = (node["final"], tuple(node["arcs"]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(list(node["arcs"]))
            finals.append(node["final"])
        return register[key]

    path = [{"final": False, "arcs": []}]
    letters: list[int] = []
    for word in words:
        keep = 0
        while keep < min(len(word), len(letters)) and word[keep] == letters[keep]:
            keep += 1
        while len(letters) > keep:  # the branch left behind gets no more words: share it
            node, letter = path.pop(), letters.pop()
            path[-1]["arcs"].append((letter, freeze(node)))
        for letter in word[keep:]:
            path.append({"final": False, "arcs": []})
            letters.append(letter)
        path[-1]["final"] = True
    while letters:
        node, letter = path.pop(), letters.pop()
        path[-1]["arcs"].append((letter, freeze(node)))
    root = freeze(path[0])
    # Targets are frozen before their sources, so counts can be summed in this order.
    count = np.zeros(len(arcs), dtype=np.int64)
    keys, target, skip = [], [], []
    for s, out in enumerate(arcs):
        seen = int(finals[s])
        for letter, t in out:
            keys.append(s * 256 + letter)
            target.append(t)
            skip.append(seen)
            seen += int(count[t])
        count[s] = seen
    ids = [ids_of(w) for w in words]
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    head = np.array([MAGIC, root, len(arcs), len(keys), len(words), at[-1]], dtype=np.int64)
    blocks = [head, np.array(keys, np.int64), at, np.array(target, np.int32), np.array(skip, np.int32), np.fromiter(chain.from_iterable(ids), np.int32, int(at[-1])), np.array(finals, np.uint8)]
    return b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """A compiled lexicon, mapped from a file or wrapped around bytes."""

    def __init__(self, source: str | bytes):
        data = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        magic, self.root, states, arcs, self.words, n_ids = (int(x) for x in data[:48].view(np.int64))
        if magic != MAGIC:
            raise ValueError("not a lexicon file")
        at = 48

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = data[at : at + size].view(kind)
            at += size
            return out

        self.keys, self.at = take(arcs, np.int64), take(self.words + 1, np.int64)
        self.target, self.skip, self.ids = take(arcs, np.int32), take(arcs, np.int32), take(n_ids, np.int32)
        self.finals = take(states, np.uint8)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words take each step together."""
        n = len(words)
        size = np.fromiter((len(w) for w in words), np.int64, n)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        state[size == 0] = -1
        step = 0
        while len(live) and len(self.keys):
            key = state[live] * 256 + data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            number[live] += self.skip[arc]
            state[live] = self.target[arc]
            step += 1
            live = live[size[live] > step]
        known = (state >= 0) & (self.finals[np.maximum(state, 0)] == 1) & (size > 0) if len(self.keys) else np.zeros(n, bool)
        return np.where(known, number, -1)

    def ids_of(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.at[number] : self.at[number + 1]].tolist())


class Encoder:
    """Ids of texts: words through the lexicon, the rest by exact merges; kept words are bounded."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None, most: int = CACHE_WORDS):
        self.ranks, self.lexicon, self.most = ranks, lexicon, most
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Afterwards ``known`` holds the ids of all these words, whatever it had to forget."""
        words = set(words)
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        numbers = self.lexicon.numbers(raw) if self.lexicon else np.full(len(raw), -1)
        for w, b, i in zip(new, raw, numbers.tolist(), strict=True):
            self.known[w] = self.lexicon.ids_of(i) if i >= 0 else tuple(merge(b, self.ranks))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [SPLIT.findall(t) if t else [] for t in texts]
        self.learn(chain.from_iterable(split))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


# On Spark -----------------------------------------------------------------------------------

_open: dict = {}
_ranks: dict = {}
MOST_OPEN = 3


def encoder_of(name: str | None, vocabulary: str) -> Encoder:
    """An encoder of this worker process; the few used last stay, so that queries may take turns."""
    key = (name, vocabulary)
    encoder = _open.pop(key, None)
    if encoder is None:
        if vocabulary not in _ranks:
            _ranks.clear()
            _ranks[vocabulary] = load_ranks(vocabulary)
        while len(_open) >= MOST_OPEN:
            _open.pop(next(iter(_open)))
        encoder = Encoder(_ranks[vocabulary], Lexicon(SparkFiles.get(name)) if name else None)
    _open[key] = encoder
    return encoder


def frequent_words(texts: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The words of all texts by count, at most ``most`` of them; counts are summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    count.update(SPLIT.findall(text))
            # A word longer than this is not worth an automaton's path.
            pairs = [(w, n) for w, n in count.items() if len(w) <= 40]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])

    words = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)


def publish_lexicon(spark: SparkSession, data: bytes) -> str:
    """Writes the lexicon to the shared folder and hands it to all workers; gives its file name."""
    folder = shared_folder(spark, "lexicon")
    name = os.path.basename(folder) + ".bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def build_lexicon(texts: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> str:
    ranks = load_ranks(vocabulary)
    words = [r.word.encode() for r in frequent_words(texts, text_col, most).select("word").collect()]  # at most `most`
    return publish_lexicon(texts.sparkSession, compile_lexicon(words, lambda w: merge(w, ranks)))


def encode_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row.  ``lexicon`` is a name from :func:`build_lexicon`."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(lexicon, vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[id_col, "ids"])

    return texts.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
