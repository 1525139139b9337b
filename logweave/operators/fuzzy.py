"""Approximate matching of short texts: ordered characters with affine gaps, scored by alignment.

A native filter keeps the rows that hold the query's characters in order, a necessary condition;
only those reach the Arrow function, which fills the alignment table of all rows of a batch side
by side.  Words of the query are matched on their own and all must match; their scores add up.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from logweave.schema import FuzzyScoring

DELIMITERS = "/,:;|\\"
_NO = -(1 << 20)


def fold(text: str) -> str:
    """Lower case without accents, one character for each."""
    out = []
    for c in text:
        d = unicodedata.normalize("NFKD", c.lower())
        out.append(d[0] if d else c)
    return "".join(out)


def bonuses(text: str, w: FuzzyScoring) -> list[int]:
    """What a match at each place is worth beside the match itself."""
    out, before = [], " "
    for c in text:
        if not c.isalnum():
            b = w.boundary
        elif before.isspace():
            b = w.boundary_white
        elif before in DELIMITERS:
            b = w.boundary_delimiter
        elif not before.isalnum():
            b = w.boundary
        elif (before.islower() and c.isupper()) or (not before.isdigit() and c.isdigit()):
            b = w.camel
        else:
            b = 0
        out.append(b)
        before = c
    return out


def score_batch(texts: list[str], word: str, w: FuzzyScoring) -> np.ndarray:
    """Best alignment score of a folded word in each text; -1 where it does not occur in order."""
    n, width = len(texts), max([1, *map(len, texts)])
    cp = np.zeros((n, width), dtype=np.int32)
    bonus = np.zeros((n, width), dtype=np.int64)
    for i, t in enumerate(texts):
        f = fold(t)
        cp[i, : len(f)] = [ord(c) for c in f]
        bonus[i, : len(f)] = bonuses(t, w)
    above = np.zeros((n, width + 1), dtype=np.int64)  # best with the characters so far, by last place, shifted by one
    above_run = np.zeros((n, width + 1), dtype=np.int64)  # bonus that a run ending there carries on
    for q, c in enumerate(word):
        hit = cp == ord(c)
        best = np.full((n, width + 1), _NO, dtype=np.int64)
        run = np.zeros((n, width + 1), dtype=np.int64)
        gap = np.full(n, _NO, dtype=np.int64)  # best earlier end of the previous character, less the gap so far
        for j in range(width):
            if q == 0:
                value = w.match + bonus[:, j] * w.first_char_factor
                carry = bonus[:, j]
            else:
                on = above[:, j]  # previous character right before
                extra = np.maximum(np.maximum(bonus[:, j], above_run[:, j]), w.consecutive)
                straight = on + w.match + extra
                jumped = gap + w.match + bonus[:, j]
                value = np.maximum(straight, jumped)
                carry = np.where(straight >= jumped, np.maximum(above_run[:, j], bonus[:, j]), bonus[:, j])
                gap = np.maximum(gap - w.gap_extend, on - w.gap_open)
            best[:, j + 1] = np.where(hit[:, j] & (value > 0), value, _NO)
            run[:, j + 1] = np.where(hit[:, j], carry, 0)
        above, above_run = best, run
    score = above[:, 1:].max(1) if word else np.zeros(n, np.int64)
    return np.where(score > 0, score, -1)


def words_of(query: str) -> list[str]:
    return [fold(x) for x in query.split()]


def subsequence_pattern(query: str) -> list[str]:
    """Patterns, all of which must be found in the folded text."""
    return ["(?s)" + ".*".join(re.escape(c) for c in word) for word in words_of(query)]


def folded(c: Column) -> Column:
    """Near the fold of the scorer: lower case, marks of common letters removed."""
    return F.lower(F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def may_match(c: Column, query: str) -> Column:
    """Necessary condition; texts with letters that the native fold does not know pass unseen."""
    all_in = F.lit(True)
    for p in subsequence_pattern(query):
        all_in = all_in & folded(c).rlike(p)
    return all_in | c.rlike(r"[^\x00-\x7f]")


def scorer(query: str, scoring: FuzzyScoring | None = None):
    """Arrow function: score of each text, null below the threshold or without a match."""
    w = scoring or FuzzyScoring()
    words, least = words_of(query), w.least_per_char * len(query)

    @F.pandas_udf("int")
    def score(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        total = np.zeros(len(rows), dtype=np.int64)
        missing = np.zeros(len(rows), dtype=bool)
        for word in words:
            s = score_batch(rows, word, w)
            missing |= s < 0
            total += s
        fine = ~missing & (total >= least)
        return pd.Series([int(x) if ok else None for x, ok in zip(total, fine, strict=True)], dtype="Int32")

    return score


def positions(text: str, query: str, w: FuzzyScoring | None = None) -> list[int]:
    """Places of one best alignment of each word, for highlighting; empty without a match."""
    w = w or FuzzyScoring()
    flat, bonus, out = fold(text), bonuses(text, w), set()
    for word in words_of(query):
        table: list[dict[int, tuple[int, int, int]]] = []  # by last place: score, carried bonus, place before
        for q, c in enumerate(word):
            row: dict[int, tuple[int, int, int]] = {}
            for j, x in enumerate(flat):
                if x != c:
                    continue
                if q == 0:
                    row[j] = (w.match + bonus[j] * w.first_char_factor, bonus[j], -1)
                    continue
                best = None
                for i, (s, carried, _) in table[-1].items():
                    if i >= j:
                        continue
                    if i == j - 1:
                        cand = (s + w.match + max(bonus[j], carried, w.consecutive), max(carried, bonus[j]), i)
                    else:
                        cand = (s - w.gap_open - w.gap_extend * (j - i - 2) + w.match + bonus[j], bonus[j], i)
                    if best is None or cand[0] > best[0]:
                        best = cand
                if best and best[0] > 0:
                    row[j] = best
            table.append(row)
        if not word or not table[-1]:
            return []
        j = max(table[-1], key=lambda k: (table[-1][k][0], -k))
        for row in reversed(table):
            out.add(j)
            j = row[j][2]
    return sorted(out)


@F.pandas_udf(ArrayType(IntegerType()))
def match_positions(texts: pd.Series, queries: pd.Series) -> pd.Series:
    return pd.Series([positions(t or "", q or "") for t, q in zip(texts, queries, strict=True)])
