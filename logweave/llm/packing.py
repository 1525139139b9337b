"""Problem 9: texts packed into containers of a fixed number of tokens.

One pass over the texts gives each its size in tokens and a key on a space-filling curve: hashed
word counts are projected to a few dimensions and quantised, and the Hilbert index of the cell is
the key.  Only (id, size, key) is shuffled: a range sort lays texts of like content next to each
other, and each task packs its stretch of the curve, always into the fullest of the open
containers in which the next text fits.

A text of more than ``capacity`` tokens is cut into pieces of that size; its last piece is packed
like a text.  Null and empty texts have size 0 and still get a container.  Equal keys are spread by
a hash of the id, so a group of copies does not end in one task.  Repeated rows are packed each,
an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.bpe import SPLIT, VOCABULARY, encoder_of

CAPACITY = 2048
OPEN = 256  # containers that a task keeps open
HASHED = 256  # hashed word counts
DIMS, BITS = 4, 12
_PROJECTION = np.random.default_rng(3).normal(size=(HASHED, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by Skilling's transform on whole columns."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] ^= np.where(on, p, t)
            x[i] ^= np.where(on, 0, t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Keys of rows of hashed counts; a row of zeros lies at the origin."""
    damped = np.sqrt(counts)
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    flat = (damped / np.maximum(norm, 1e-9)) @ _PROJECTION
    grid = 1 / (1 + np.exp(-1.7 * flat))  # near the normal distribution's share below a value
    return hilbert(np.minimum((grid * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def measure(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col``, ``n_tokens``, ``curve`` of every row, in one pass over the texts."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(None, vocabulary)
        slot: dict[str, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                split = [SPLIT.findall(t) if t else [] for t in part.column(1).to_pylist()]
                encoder.learn([w for words in split for w in words])
                if len(slot) > 400_000:
                    slot.clear()
                counts = np.zeros((len(split), HASHED), dtype=np.float32)
                sizes = np.zeros(len(split), dtype=np.int64)
                for r, words in enumerate(split):
                    at = []
                    n = 0
                    for w in words:
                        n += len(encoder.known[w])
                        h = slot.get(w)
                        if h is None:
                            h = slot[w] = zlib.crc32(w.strip().lower().encode("utf-8", "surrogatepass")) % HASHED
                        at.append(h)
                    sizes[r] = n
                    if at:
                        counts[r] = np.bincount(at, minlength=HASHED)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(curve_keys(counts))], names=[id_col, "n_tokens", "curve"])

    return texts.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, curve bigint")


class Packer:
    """Best fit over a bounded number of open containers."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.open: list[tuple[int, int]] = []  # (space left, number), ascending
        self.next = 0

    def put(self, size: int) -> int:
        if size >= self.capacity:
            self.next += 1
            return self.next - 1
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            left, number = self.open.pop(i)
        else:
            left, number = self.capacity, self.next
            self.next += 1
            if len(self.open) >= self.most_open:
                self.open.pop(0)  # the fullest is closed
        if left > size:
            insort(self.open, (left - size, number))
        return number


def pack(measured: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """``id_col``, ``piece_no``, ``token_start``, ``n_tokens``, ``container_id``: one row per text or piece."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    id_type = measured.schema[id_col].dataType.simpleString()
    keys = ["curve", F.xxhash64(id_col), id_col]
    ordered = measured.select(id_col, "n_tokens", "curve")
    ordered = (ordered.repartitionByRange(partitions, *keys) if partitions else ordered.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ordered = ordered.select(id_col, "n_tokens", F.spark_partition_id().cast("long").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        for batch in batches:
            row, piece, start, size, box = [], [], [], [], []
            tasks = batch.column(2).to_pylist()
            for i, n in enumerate(batch.column(1).to_pylist()):
                at, k = 0, 0
                while True:
                    m = min(capacity, n - at)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(m)
                    box.append((tasks[i] << 40) + packer.put(m))
                    at += m
                    k += 1
                    if at >= n:
                        break
            ids = batch.column(0).take(pa.array(np.array(row, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(box, pa.int64())], names=[id_col, "piece_no", "token_start", "n_tokens", "container_id"])

    return ordered.mapInArrow(run, f"`{id_col}` {id_type}, piece_no int, token_start bigint, n_tokens bigint, container_id bigint")


def pack_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(measure(texts, id_col, text_col, vocabulary), id_col, capacity)
