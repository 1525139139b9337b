"""Vectors: dot product, norms, pooling, chunking of texts, the byte codec and a hashing embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from logweave import schema as S


def dot(a: Column, b: Column) -> Column:
    """Sum of products up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mean_pool(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """``key``, ``embedding``: mean of the vectors of each key, length one.  Sums combine on the map side, so a large group is spread."""
    cells = df.where(F.col(vec_col).isNotNull()).select(key, F.posexplode(vec_col).alias("d", "x"))
    means = cells.groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    return rows.select(key, normalized(F.transform("v", lambda c: c["x"])).alias("embedding"))


def encode_vector(v: list[float]) -> bytes:
    return np.asarray(v, dtype="<f4").tobytes()


def decode_vector(data: bytes) -> list[float]:
    """Trailing bytes that make no number are dropped."""
    return np.frombuffer(data[: len(data) // 4 * 4], dtype="<f4").tolist()


@F.pandas_udf(BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else encode_vector(x))


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else decode_vector(bytes(x)))


def snap_left(data: bytes, i: int) -> int:
    """The nearest character boundary at or before byte ``i``."""
    i = min(i, len(data))
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i -= 1
    return i


def snap_right(data: bytes, i: int) -> int:
    i = min(i, len(data))
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def windows(text: str) -> list[str]:
    """A short text whole, a long one as overlapping windows of bytes that respect characters."""
    data = text.encode()
    if len(data) <= S.CHUNK_FROM:
        return [text]
    out, start = [], 0
    while start < len(data):
        end = snap_right(data, min(start + S.CHUNK_BYTES, len(data)))
        out.append(data[snap_left(data, start) : end].decode())
        if end >= len(data):
            break
        start = max(0, end - S.CHUNK_OVERLAP)
    return out


def sampled(count: int, most: int = S.CHUNKS) -> list[int]:
    """Which windows are used: all, or the first and last quarter of ``most`` and evenly spaced ones between, in that order."""
    if count <= most:
        return list(range(count))
    edge = most // 4
    between = count - 2 * edge
    return [*range(edge), *range(count - edge, count), *(edge + i * between // (most - 2 * edge) for i in range(most - 2 * edge))]


def chunks(texts: DataFrame, id_col: str, text_col: str, only_sampled: bool = True, most: int = S.CHUNKS) -> DataFrame:
    """``id_col``, ``chunk_no``, ``chunk`` of every text; blank chunks are left out."""

    @F.pandas_udf("array<struct<chunk_no:int,chunk:string>>")
    def cut(batch: pd.Series) -> pd.Series:
        out = []
        for text in batch:
            parts = windows(text) if text else []
            at = sampled(len(parts), most) if only_sampled else range(len(parts))
            out.append([{"chunk_no": i, "chunk": parts[i]} for i in sorted(at) if parts[i].strip()])
        return pd.Series(out)

    return texts.select(id_col, F.explode(cut(text_col)).alias("c")).select(id_col, "c.chunk_no", "c.chunk")


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, length one: the offline stand-in for an encoder."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        words = text.lower().split()
        for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = zlib.crc32(f.encode())
            v[h % self.dim] += 1 if h & 0x8000_0000 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


_encoders: dict = {}


def embed_texts(texts: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str], list[float]]] = HashingEmbedder) -> DataFrame:
    """``id_col``, ``embedding``: windows of each text embedded, averaged, brought to length one.

    ``make`` builds the encoder once per worker process; a text without any usable window gets zeros.
    """
    id_type = texts.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoders.setdefault(make, None) or _encoders.update({make: make()}) or _encoders[make]
        for part in parts:
            out = []
            for text in part[text_col]:
                pieces = windows(text or "")
                vectors = [encode(pieces[i]) for i in sampled(len(pieces)) if pieces[i].strip()]
                mean = np.mean(vectors, axis=0) if vectors else np.zeros(len(encode("")))
                n = np.linalg.norm(mean)
                out.append((mean / n if n > 0 else mean).astype(np.float32).tolist())
            yield pd.DataFrame({id_col: part[id_col], "embedding": out})

    return texts.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, embedding array<float>")
