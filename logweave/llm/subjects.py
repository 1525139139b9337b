"""Problem 10: the subject areas of each document.

The document-term matrix (words, word pairs, word ends, whole sentences, all hashed to a fixed
width) is factored into subject mixtures of documents and subject shares of terms.  Hand labels and
the subjects' descriptions anchor one component per subject; then the two factors are updated in
turn, both kept non-negative: term shares from the mixtures of all documents, mixtures from the
sentences that the shares decide.  A term's share of a subject counts only as far as it exceeds a
floor, so words that all subjects use weigh nothing, and labelled documents keep to their labels.

A sentence is given to the subject with the largest sum of shares if that is large and clearly
ahead; a sentence that recurs in documents of all subjects is usual talk and given to none.  A
document has the subjects to which two or more of its sentences are given.

Every update reads all documents; the factors' size is bounded by the hashed width, not by the
corpus.  Defined results: null and empty texts have no subject; a null id is no document; repeated
rows are answered each; labels of unknown subjects are ignored, spelling and repeats of labels do
not matter; without labels the descriptions alone are the anchors; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.spark import cut, small_rows

MAX_SUBJECTS = 62
SMALL_LABELS = 1_000_000
_SPLIT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+|(?<=[。！？])")
_WORD = re.compile(r"[぀-ヿ㐀-鿿々ー]+|[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK_RUN = re.compile(r"[ァ-ヿー]+|[㐀-鿿々]+")


@dataclass(frozen=True)
class Settings:
    width: int = 1 << 18  # hashed terms, and as many hashed sentences
    rounds: int = 2
    floor: float = 0.4  # share of a subject up to which a term says nothing
    smooth: float = 2.0
    balance: float = 0.6  # 0 keeps the subjects' sizes, 1 evens them out
    least_score: float = 0.8
    ahead: float = 1.5
    recurs: float = 0.001  # share of documents from which a sentence counts as recurring
    sentences: int = 2  # sentences a document needs for a subject


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Terms:
    """Hashed terms of sentences; the first of each sentence is the sentence itself."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def of_word(self, w: str) -> tuple[tuple[int, ...], int]:
        """Term ids of a word, and the hash that pairs are made of (0: no pairs)."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 300_000:
                self.words.clear()
            if w[0] >= "぀" and (w[0] <= "ヿ" or "㐀" <= w[0] <= "鿿"):
                parts = set()
                for run in _CJK_RUN.findall(w):
                    parts.add(run)
                    parts.update(run[i : i + 2] for i in range(len(run) - 1))
                got = tuple(_hash(p) % self.width for p in parts), 0
            else:
                parts = [w] if len(w) <= 5 else [w, "^" + w[:5], w[-5:] + "$"]
                got = tuple(_hash(p) % self.width for p in parts), _hash(w) | 1
            self.words[w] = got
        return got

    def of_text(self, text: str) -> tuple[list[int], list[int]]:
        """Terms of all sentences, and how many each sentence has."""
        terms, sizes = [], []
        for sentence in _SPLIT.split(text):
            words = _WORD.findall(sentence.lower()) if sentence else None
            if not words:
                continue
            own, before = set(), 0
            for w in words:
                ids, h = self.of_word(w)
                own.update(ids)
                if before and h:
                    own.add((before * 0x9E3779B1 + h * 0x85EBCA77 >> 7) % self.width)
                before = h
            terms.append(self.width + _hash(" ".join(words)) % self.width)
            terms.extend(own)
            sizes.append(len(own) + 1)
        return terms, sizes


def _plain(name: str | None) -> str:
    return re.sub(r"[\W_]+", "", (name or "").lower())


def _prepared(docs: DataFrame, masks: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """``id_col``, ``mask`` (bits of the labelled subjects), ``terms``, ``sizes``; kept in the shared folder."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Terms(s.width)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                both = [maker.of_text(t) if t else ([], []) for t in part.column(1).to_pylist()]
                lists = []
                for side in (0, 1):
                    at = np.concatenate([[0], np.cumsum([len(b[side]) for b in both])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.fromiter((x for b in both for x in b[side]), np.int32, int(at[-1])))))
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=[id_col, "terms", "sizes"])

    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, terms array<int>, sizes array<int>")
    small = masks.count() <= SMALL_LABELS
    return cut(rows.join(F.broadcast(masks) if small else masks, id_col, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint"))))


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the document of each term, the first term of each sentence, the document of each sentence."""
    terms, sizes = batch.column("terms"), batch.column("sizes")
    flat = np.asarray(terms.flatten())
    per_doc = np.diff(np.asarray(terms.offsets))
    size = np.asarray(sizes.flatten())
    return flat, np.repeat(np.arange(len(per_doc)), per_doc), np.cumsum(size) - size, np.repeat(np.arange(len(per_doc)), np.diff(np.asarray(sizes.offsets)))


def _decide(batch: pa.RecordBatch, shares: np.ndarray, talk: np.ndarray, s: Settings) -> np.ndarray:
    """Sentences given to each subject, by document."""
    k = shares.shape[1]
    out = np.zeros((batch.num_rows, k), dtype=np.float64)
    flat, _, first, doc = _parts(batch)
    if not len(first):
        return out
    score = np.add.reduceat(shares[flat], first, axis=0)
    best = score.argmax(1)
    top = score[np.arange(len(best)), best]
    score[np.arange(len(best)), best] = -1
    fine = (top >= s.least_score) & (top >= s.ahead * np.maximum(score.max(1), 0)) & ~talk[flat[first] - s.width]
    np.add.at(out, (doc[fine], best[fine]), 1)
    return out


def _bits(mask: np.ndarray, k: int) -> np.ndarray:
    return ((mask[:, None] >> np.arange(k)) & 1).astype(np.float64)


def _mixtures(batch: pa.RecordBatch, shares: np.ndarray | None, talk: np.ndarray | None, k: int, s: Settings) -> np.ndarray:
    """Subject mixture of each document; labelled documents keep to their labels."""
    labelled = _bits(np.asarray(batch.column("mask")), k)
    if shares is None:
        mix = labelled
    else:
        mix = _decide(batch, shares, talk, s)
        mix[mix < s.sentences] *= 0.3
        on = labelled.any(1)
        mix[on] = (mix[on] + 0.3) * labelled[on]
        mix[mix.sum(1) < 1] = 0
    return mix / np.maximum(mix.sum(1, keepdims=True), 1e-9)


def _term_sums(rows: DataFrame, shared, k: int, s: Settings) -> DataFrame:
    """Each term's sum of the mixtures of the documents that hold it; added up in the task before the shuffle."""
    columns = ", ".join(f"c{i} double" for i in range(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, talk = shared.value if shared else (None, None)
        sums = np.zeros((2 * s.width, k), dtype=np.float32)
        for batch in batches:
            mix = _mixtures(batch, shares, talk, k, s)
            flat, doc, _, _ = _parts(batch)
            key = np.unique(doc.astype(np.int64) * (2 * s.width) + flat)
            doc, flat = key // (2 * s.width), key % (2 * s.width)
            on = mix.any(1)[doc]
            doc, flat = doc[on], flat[on]
            if len(flat):
                by = np.argsort(flat, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(flat[by]) > 0]))
                sums[flat[by][heads]] += np.add.reduceat(mix[doc[by]], heads, axis=0)
        used = np.flatnonzero(sums.any(1))
        for i in range(0, len(used), 50_000):
            part = used[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(sums[part, j].astype(np.float64)) for j in range(k))], names=["term", *(f"c{j}" for j in range(k))])

    return rows.select("mask", "terms", "sizes").mapInArrow(run, f"term int, {columns}").groupBy("term").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k)))


def _shares(sums: np.ndarray, documents: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sparse shares of the terms, and which hashed sentences are usual talk."""
    k = sums.shape[1]
    size = sums[s.width :].sum(0) + 1e-9
    even = (size / size.sum() * k) ** s.balance
    weight = sums / np.maximum(even, 1e-6)
    share = (weight + s.smooth / k) / (weight.sum(1, keepdims=True) + s.smooth)
    seen = sums[s.width :].sum(1)
    talk = (seen >= max(8.0, s.recurs * documents)) & (share[s.width :].max(1) < 0.5)
    return np.maximum(0, (share - s.floor) / (1 - s.floor)).astype(np.float32), talk


def _fitted(docs: DataFrame, subjects: DataFrame, labels: DataFrame, id_col: str, text_col: str, s: Settings):
    spark = docs.sparkSession
    known = {r.subject: r.description for r in small_rows(subjects.where("subject IS NOT NULL").select("subject", "description"), MAX_SUBJECTS)}
    names = sorted(known)
    k = len(names)
    bit = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (_plain(n), 1 << i)]) if names else F.lit(None)
    spelled = F.regexp_replace(F.lower("subject"), r"(?U)[\W_]+", "")
    masks = labels.select(F.col(id_col), F.element_at(bit, spelled).cast("bigint").alias("b")).where(F.col(id_col).isNotNull() & F.col("b").isNotNull())
    masks = masks.groupBy(id_col).agg(F.bit_or("b").alias("mask"))
    rows = _prepared(docs, masks, id_col, text_col, s)
    documents = rows.count()
    seeds = np.zeros((2 * s.width, k), dtype=np.float64)
    maker = Terms(s.width)
    for i, name in enumerate(names):
        seeds[sorted(set(maker.of_text(f"{name}. {known[name] or ''}")[0])), i] += 1
    shared = None
    for _ in range(s.rounds + 1):
        got = _term_sums(rows, shared, k, s).toArrow()  # at most two times `width` rows
        sums = seeds.copy()
        sums[np.asarray(got["term"])] += np.stack([np.asarray(got[f"c{i}"]) for i in range(k)], 1) if k and got.num_rows else 0
        shared = spark.sparkContext.broadcast(_shares(sums, documents, s))
    return rows, names, shared


def subjects_of(docs: DataFrame, subjects: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``id_col``, ``subject``, ``sentences``: one row per subject of a document."""
    s = settings or Settings()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, subject string, sentences int"
    if subjects.where("subject IS NOT NULL").isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    rows, names, shared = _fitted(docs, subjects, labels, id_col, text_col, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, talk = shared.value
        for batch in batches:
            count = _decide(batch, shares, talk, s)
            doc, subject = np.nonzero(count >= s.sentences)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(doc)), pa.array([names[i] for i in subject], pa.string()), pa.array(count[doc, subject].astype(np.int32))], names=[id_col, "subject", "sentences"]
            )

    return rows.select(id_col, "terms", "sizes").mapInArrow(run, schema)


def composition(found: DataFrame) -> DataFrame:
    """Documents, sentences and share of sentences by subject."""
    by = found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))
    whole = Window.partitionBy()  # as many rows as there are subjects
    return by.select("subject", "documents", "sentences", (F.col("sentences") / F.sum("sentences").over(whole)).alias("share"))
