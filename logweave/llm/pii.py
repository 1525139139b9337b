"""Problem 1: personal information in free text and paths, found and replaced by typed placeholders.

A linear-chain conditional random field over word-shape features marks e-mail addresses, phone
numbers, identity numbers, street addresses and names.  It is trained on the driver from the small
labelled table that :mod:`logweave.llm.pii_table` makes by rule (a fixed number of rows, some
seconds), with the name parts as gazetteer: their beginnings and endings also mark names that the
gazetteer lacks.  Beside the shapes of single words the model sees the shape of a whole number or
code and the announcing words before it.  Tokens are decoded by Viterbi in numpy batches on the
workers.  The model decides what is an item and of which kind; the borders are only moved to
those of whole words and numbers.

Defined results: null and empty texts hold nothing and stay as they are; overlapping items count
once; repeated rows are answered each; a text of any length is read whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.spark import small_rows
from logweave.llm import crf
from logweave.llm.pii_table import CUES, NOT_PERSONAL, THINGS, TITLES, labelled_rows, plain

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
MAX_NAME_PARTS = 100_000
SLICE_CHARS = 1_200_000
# Particles of surnames and the endings of street names.
PARTICLES = frozenset("von van der den de la del di da du le o mc ter zu".split())
STREET_WORDS = frozenset("street terrace st road rd avenue ave lane ln close drive dr way court ct row square sq boulevard blvd rue calle avenida plaza via weg gasse strasse straße allee platz".split())
STREET_TAILS = ("weg", "gasse", "straße", "strasse", "allee", "platz", "ufer", "ring")
COARSE = 34
#: Classes of words that say what comes next (or, for the last, what came before).
PHONE, ID, OTHER, NAME, PLACE, LOGIN, THING = (1 << i for i in range(7))
WIDTH = 1 << 13
_SEEDS = np.random.default_rng(23).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _cue_table() -> dict[str, int]:
    out: dict[str, int] = {}
    groups = (
        (PHONE, [*CUES["phone"], "call", "ring", "dial", "text", "anrufen", "ruf", "llama", "llámame", "appelez", "calls"]),
        (ID, [*CUES["id_number"], "security", "national", "identity", "card", "id", "credit", "social"]),
        (OTHER, [*NOT_PERSONAL, "rev", "lines", "rows", "took", "host"]),
        (NAME, [*CUES["name"], *(t.lower().rstrip(".") for t in TITLES), "by", "with", "from", "signed", "regards", "gruß", "von", "mit", "avec", "con", "met", "told"]),
        (PLACE, [*CUES["address"], "lives", "living", "street", "ship", "parcel", "wohnt", "wohnhaft", "vive", "habite", "moved", "delivered"]),
        (LOGIN, ["git", "ssh", "scp", "clone", "remote", "rsync", "curl", "https", "http", "postgres", "redis", "ftp", "amqp", "npm"]),
        (THING, [*THINGS, *(t + "s" for t in THINGS)]),
    )
    for bit, words in groups:
        for w in words:
            if w:
                out[w] = out.get(w, 0) | bit
    return out


_CUES = _cue_table()


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % WIDTH


def _within(mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether any mark lies in [a, b) of each row."""
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[np.maximum(a, b)] > total[a]


def _group_heads(member: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of the group each token is in; a token outside any group is its own."""
    n = len(member)
    i = np.arange(n)
    starts = np.ones(n, dtype=bool)
    starts[1:] = ~(member[1:] & member[:-1] & joined[1:])
    head = np.maximum.accumulate(np.where(starts, i, 0))
    ends = np.ones(n, dtype=bool)
    ends[:-1] = starts[1:]
    tail = np.minimum.accumulate(np.where(ends, i, n)[::-1])[::-1]
    return head, tail


class Shapes:
    """Features of a word: its shape, ends, and likeness to names by the gazetteer's beginnings and endings."""

    def __init__(self, given: list[str], surnames: list[str]):
        self.given, self.surnames = {plain(x) for x in given}, {plain(x) for x in surnames}
        self.given_parts, self.surname_parts = self._parts(self.given), self._parts(self.surnames)

    @staticmethod
    def _parts(names: set[str], least: int = 3) -> tuple[set[str], set[str]]:
        heads, tails = Counter(), Counter()
        for n in names:
            for i in range(2, len(n) - 1):
                heads[n[:i]] += 1
                tails[n[i:]] += 1
        return {h for h, c in heads.items() if c >= least and len(h) >= 2}, {t for t, c in tails.items() if c >= least and len(t) >= 2}

    @staticmethod
    def _like(word: str, parts: tuple[set[str], set[str]]) -> bool:
        return any(word[:i] in parts[0] and word[i:] in parts[1] for i in range(2, len(word) - 1))

    def is_given(self, word: str) -> bool:
        return word in self.given or self._like(word, self.given_parts)

    def is_surname(self, word: str) -> bool:
        if word in self.surnames or self._like(word, self.surname_parts):
            return True
        m = re.match(r"(?:vander|vonder|dela|van|von|del|de|la|di|da|du|mc|o)(?=[a-z]{4})", word)
        return bool(m) and self.is_surname(word[m.end() :])

    def __call__(self, word: str) -> tuple[list[str], int]:
        c = word[0]
        if c.isdigit():
            n = len(word)
            return [f"d{min(n, 9)}", "zero" if c == "0" else "digit"], 10 + min(n, 8)
        if not (c.isalpha() or len(word) > 1):
            coarse = {"@": 20, ".": 21, "-": 22, "_": 22, "+": 23, "(": 24, ")": 25, ",": 26, "/": 27, "\\": 27, '"': 28, "'": 28, "=": 29, ":": 29, "<": 30, ">": 30}.get(c, 31)
            return ["c=" + c, "sign"], coarse
        low = word.lower()
        flat = plain(word) if not low.isascii() else low
        case = "U" if word.isupper() and len(word) > 1 else "T" if word[0].isupper() else "l"
        names = [case, f"{case}{min(len(word), 8)}", "w=" + low[:16], "e=" + low[-3:], "b=" + low[:3]]
        coarse = {"l": 1, "T": 2, "U": 3}[case]
        cue = _CUES.get(low, 0)
        names += [f"cue{bit}" for bit in (PHONE, ID, OTHER, NAME, PLACE, LOGIN, THING) if cue & bit]
        if len(word) == 1:
            names.append("one" + case)
            return names, 4 if word.isupper() else 5
        if low in PARTICLES:
            names.append("particle")
            return names, 32
        if low in STREET_WORDS or low.endswith(STREET_TAILS):
            names.append("street")
            coarse = 33
        given, surname = self.is_given(flat), self.is_surname(flat)
        if given:
            names += ["given", "given" + case]
            coarse = 6 if case == "l" else 7
        if surname and not (given and flat in self.given):
            names += ["surname", "surname" + case]
            coarse = 8 if case == "l" else 9
        elif len(flat) > 4 and self.is_surname(flat[1:]):
            names += ["fused", "fused" + case]
            coarse = 10 if not given else coarse
        return names, coarse

    def channels(self, t: crf.Tokens, type_id: np.ndarray, types: list[str]) -> list[np.ndarray]:
        """Slots of each token: shapes of the number or code it is in, announcing words, and the like."""
        n = len(type_id)
        if not n:
            return [np.zeros(0, np.int64)] * CHANNELS
        first_char = np.array([w[0] for w in types])
        digit_t = np.array([c.isdigit() for c in first_char])
        alpha_t = np.array([w[0].isalpha() for w in types])
        link_t = np.array([w in "+-./()" for w in types])
        cue_t = np.array([_CUES.get(w.lower(), 0) for w in types], dtype=np.int64)
        street_t = np.array([w.lower() in STREET_WORDS or w.lower().endswith(STREET_TAILS) for w in types])
        kind_t = np.array([0 if w[0].isdigit() else 5 if not w[0].isalpha() else 1 if w.islower() else 3 if len(w) > 1 and w.isupper() else 2 if len(w) > 1 else 4 for w in types], dtype=np.int64)
        digit, alpha, link, cue, street, kind = (x[type_id] for x in (digit_t, alpha_t, link_t, cue_t, street_t, kind_t))
        i = np.arange(n)
        doc_first = np.searchsorted(t.doc, t.doc, side="left")
        doc_last = np.searchsorted(t.doc, t.doc, side="right")
        gap = np.full(n, 99, dtype=np.int64)
        gap[1:] = np.where(t.doc[1:] == t.doc[:-1], t.start[1:] - t.end[:-1], 99)
        same = gap < 99
        # A number: digits and its signs, at most one space apart; a code: letters and digits without a gap.
        num_head, num_tail = _group_heads(digit | link, same & (gap <= 1))
        code_head, code_tail = _group_heads(digit | alpha, gap == 0)
        word_head, word_tail = _group_heads(np.ones(n, bool), gap == 0)
        size = (t.end - t.start) * digit
        total = np.concatenate([[0], np.cumsum(size)])
        has_letter = np.concatenate([[0], np.cumsum(alpha)])
        digits_of = lambda a, b: np.minimum(total[b + 1] - total[a], 24)
        in_number = digit | link
        num_digits = np.where(in_number, digits_of(num_head, num_tail), 0)
        in_code = (digits_of(code_head, code_tail) > 0) & (has_letter[code_tail + 1] > has_letter[code_head])
        # Shapes: digits as one sign, letters as one sign each for capitals and others, everything else itself.
        code_of = np.where(t.cp < 128, t.cp, 128).astype(np.uint64)
        code_of[(t.cp >= 48) & (t.cp <= 57)] = 57
        code_of[(t.cp >= 97) & (t.cp <= 122)] = 97
        code_of[(t.cp >= 65) & (t.cp <= 90)] = 65

        def shape(head: np.ndarray, tail: np.ndarray, on: np.ndarray) -> np.ndarray:
            """Hash of the shape of each token's group, 0 outside."""
            out = np.zeros(n, dtype=np.uint64)
            heads = np.unique(head[on])
            if len(heads):
                a, b = t.start[heads], np.minimum(t.end[tail[heads]], t.start[heads] + 64)
                width = b - a
                at = np.repeat(a - (np.cumsum(width) - width), width) + np.arange(width.sum())
                inside = at - np.repeat(a, width)
                with np.errstate(over="ignore"):
                    h = np.add.reduceat(code_of[at] * _SEEDS[inside & 63], np.cumsum(width) - width) | np.uint64(1)
                full = np.zeros(n, dtype=np.uint64)
                full[heads] = h
                out[on] = full[head[on]]
            return out

        # Leading and trailing signs that belong to the sentence rather than to the number.
        lead = num_head.copy()
        for _ in range(2):
            skip = in_number & link[lead] & ~np.isin(t.cp[t.start[lead]], (43, 40)) & (lead < num_tail)
            lead = np.where(skip, lead + 1, lead)
        trail = num_tail.copy()
        for _ in range(3):
            skip = in_number & link[trail] & (trail > lead)
            trail = np.where(skip, trail - 1, trail)
        lead, trail = np.where(in_number, lead, i), np.where(in_number, trail, i)
        num_shape = np.zeros(n, dtype=np.uint64)
        on = in_number & (num_digits >= 3)
        if on.any():
            # By group: the trimmed shape, kept at the group's first token.
            num_shape = shape(np.where(on, lead, i), np.where(on, trail, i), on)
        start_kind = np.where(t.cp[t.start[lead]] == 43, 1, np.where(t.cp[t.start[lead]] == 40, 2, np.where(t.cp[t.start[lead]] == 48, 3, 4)))
        groups = np.concatenate([[0], np.cumsum(digit)])
        n_groups = np.minimum(groups[trail + 1] - groups[lead], 7)
        code_shape = shape(code_head, code_tail, in_code)
        anchor = np.where(in_number & (num_digits > 0), lead, np.where(in_code, code_head, i))
        ender = np.where(in_number & (num_digits > 0), trail, np.where(in_code, code_tail, i))
        before, near = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for bit in (PHONE, ID, OTHER, NAME, PLACE, LOGIN):
            mark = (cue & bit) > 0
            before |= _within(mark, np.maximum(anchor - 7, doc_first), anchor) * bit
            near |= _within(mark, np.maximum(anchor - 3, doc_first), anchor) * bit
        thing = (cue & THING) > 0
        after = _within(thing, np.minimum(ender + 1, doc_last), np.minimum(ender + 4, doc_last)) * 1
        after += _within(thing, np.maximum(i - 2, doc_first), i) * 2
        after += _within((cue & OTHER) > 0, np.maximum(anchor - 2, doc_first), anchor) * 4
        # E-mail: where the token stands to an @ in its stretch without spaces, and what that stretch is.
        at_sign = t.cp[t.start] == 64
        places = np.concatenate([[0], np.cumsum(at_sign)])
        has_at = places[word_tail + 1] > places[word_head]
        at_before = places[i] > places[word_head]
        slash = np.concatenate([[0], np.cumsum(t.cp[t.start] == 47)])
        url = slash[word_tail + 1] - slash[word_head] >= 2
        at_places = np.flatnonzero(at_sign)
        nxt = np.minimum(np.searchsorted(at_places, i), max(len(at_places) - 1, 0))
        host_sign = np.zeros(n, dtype=np.int64)
        if len(at_places):
            # The domain after each @: whether it has a dot, and the sign that ends it.
            domain = (alpha | digit | np.isin(t.cp[t.start], (46, 45))) & ~at_sign
            _, dom_tail = _group_heads(domain, gap == 0)
            follow = np.minimum(at_places + 1, n - 1)
            tail = np.where((gap[follow] == 0) & domain[follow], dom_tail[follow], at_places)
            dots = np.concatenate([[0], np.cumsum(t.cp[t.start] == 46)])
            has_dot = dots[np.minimum(tail, n - 1) + 1] > dots[at_places]
            end = np.minimum(tail + 1, n - 1)
            sign = np.where((end > tail) & (gap[end] == 0), t.cp[t.start[end]], 0)
            about = 1 + has_dot * 1 + np.where(sign == 58, 2, np.where(sign == 47, 4, np.where(sign == 126, 6, 0)))
            behind = np.maximum(np.searchsorted(at_places, i, side="right") - 1, 0)
            host_sign = np.where(has_at, np.where(at_before, about[behind], about[nxt]), 0)
        mail = np.where(has_at, 1 + at_before * 1 + at_sign * 2 + url * 4, 0) * 16 + host_sign
        # Streets: distance to the street word on each side, and to a house number.
        right = np.full(n, 5)
        left = np.full(n, 5)
        num_left = np.full(n, 5)
        num_right = np.full(n, 5)
        for d in range(4, -1, -1):
            fine = (i + d < doc_last)
            j = np.minimum(i + d, n - 1)
            right = np.where(fine & street[j], d, right)
            num_right = np.where(fine & digit[j], d, num_right)
            fine = (i - d >= doc_first)
            j = np.maximum(i - d, 0)
            left = np.where(fine & street[j], d, left)
            num_left = np.where(fine & digit[j], d, num_left)
        streets = ((right * 6 + left) * 6 + num_left) * 6 + num_right
        # Line ends around the token.
        ends = np.concatenate([[0], np.cumsum(t.cp == 10)])
        newline = np.zeros(n + 1, dtype=bool)
        newline[1:n] = ends[t.start[1:]] > ends[t.end[:-1]]
        newline[0] = newline[n] = True
        newline[:n] |= ~same
        lines = newline[:n] * 1 + newline[1:] * 2
        # The words before and after, signs aside, together with the case of this one.
        words_at = np.where(alpha, i, -1)
        last_word = np.concatenate([[-1], np.maximum.accumulate(words_at)[:-1]])
        last_word = np.where(last_word >= doc_first, last_word, -1)
        second_last = np.where(last_word >= 0, last_word[last_word], -1)
        next_word = np.minimum.accumulate(np.where(alpha, i, n)[::-1])[::-1]
        next_word = np.concatenate([next_word[1:], [n]])
        next_word = np.where((next_word < doc_last) & (next_word - i <= 3), next_word, -1)
        announce = cue & (NAME | PLACE | OTHER)
        said = np.where((last_word >= 0) & (i - last_word <= 4), announce[last_word], 0)
        said_before = np.where((second_last >= 0) & (i - second_last <= 6), announce[second_last], 0)
        case_next = np.where(next_word >= 0, kind[next_word], 7)
        case_last = np.where(last_word >= 0, kind[last_word], 7)
        sign_before = np.zeros(n, dtype=np.int64)
        sign_before[1:] = np.where(same[1:] & ~alpha[:-1], t.cp[t.start[:-1]], 0)
        numbered = np.where(in_number & (num_digits > 2), 1, np.where(in_code, 2, 0))
        h = lambda *parts: _slot(sum((p.astype(np.uint64) + np.uint64(1)) * _SEEDS[j] for j, p in enumerate(parts)))
        return [
            _slot(num_shape),
            h(num_digits, start_kind, n_groups, numbered),
            _slot(code_shape),
            h(before, kind, numbered),
            h(near, num_digits, numbered, kind),
            h(after, kind, numbered),
            h(mail, kind),
            h(streets, kind),
            h(near, num_shape),
            h(before & (ID | PHONE | OTHER), code_shape),
            h(lines, kind),
            h(said, kind, case_next),
            h(said_before, case_last, kind),
            h(sign_before, kind, case_next, lines),
        ]


CHANNELS = 14


def _label_of(rows):
    def run(t: crf.Tokens) -> np.ndarray:
        y = np.zeros(len(t.start), dtype=np.int64)
        first = np.searchsorted(t.doc, np.arange(len(rows) + 1))
        for d, (_, spans) in enumerate(rows):
            for a, b, kind in spans:
                at = np.arange(first[d], first[d + 1])
                pos = t.start[at] - t.base[d]
                hit = at[(pos >= a) & (pos < b)]
                y[hit] = LABELS.index("I-" + kind)
                y[hit[0]] = LABELS.index("B-" + kind)
        return y

    return run


_trained: dict = {}


def train(given: list[str], surnames: list[str]) -> crf.Model:
    """The model for a gazetteer; kept for the process."""
    key = hash((tuple(given), tuple(surnames)))
    if key not in _trained:
        rows = labelled_rows(given, surnames)
        _trained[key] = crf.fit(rows, LABELS, Shapes(given, surnames), COARSE, _label_of(rows), width=WIDTH)
    return _trained[key]


# Borders ------------------------------------------------------------------------------------

_SIGN = {"phone": "+(", "id_number": "", "email": "", "address": "", "name": ""}


def _whole(text: str, a: int, b: int) -> tuple[int, int]:
    """The span grown to whole words and numbers."""
    while a and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def _bare(text: str, a: int, b: int, first: str) -> tuple[int, int]:
    """The span without signs and spaces at its ends."""
    while a < b and not (text[a].isalnum() or text[a] in first):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def check_span(text: str, a: int, b: int, kind: str, shapes: Shapes) -> tuple[int, int] | None:
    """The item's borders; None for what cannot be one at all (an address without a sign of it, a lone name)."""
    if kind == "name":
        a, b = _bare(text, a, b, "")
        if b < len(text) and text[b] == "." and len(re.search(r"[^\W\d_]*$", text[a:b]).group()) == 1:
            b += 1
        words = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text[a:b]))
        # A word and a comma before a full name are no part of it, unless the word is a surname.
        lead = re.match(r"([^\W\d_]+),\s+(?=[^\W\d_]{2,}[\s-]+\S*[^\W\d_]{2})", text[a:b])
        if lead and not shapes.is_surname(plain(lead.group(1))):
            a += lead.end()
        if len(words) >= 2:
            return a, b
        flat = [plain(w) for w in words]
        # One word is a name only as an initial written together with a surname.
        if len(words) == 1 and len(flat[0]) > 4 and flat[0] not in shapes.surnames and flat[0] not in shapes.given:
            if not shapes._like(flat[0], shapes.surname_parts) and shapes.is_surname(flat[0][1:]):
                return a, b
        return None
    a, b = _whole(text, a, b)
    if kind == "email":
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+%-'" and a > 1 and text[a - 2].isalnum()):
            a -= 1
        a, b = _bare(text, a, b, "")
        return (a, b) if re.search(r"(?i)@|%40|\bat\b", text[a:b]) else None
    if kind == "phone":
        if a and text[a - 1] in "+(":
            a -= 1
        elif a > 1 and text[a - 2 : a] in ("+(", "(+"):
            a -= 2
    a, b = _bare(text, a, b, _SIGN[kind])
    if not any(c.isdigit() for c in text[a:b]):
        return None
    if kind == "address" and not re.search(r"[^\W\d_]{2,}", text[a:b]):
        return None
    return (a, b) if a < b else None


def find_items(texts: list[str], model: crf.Model) -> list[list[tuple[int, int, str]]]:
    """Items of each text: (first, end, kind) in characters, in order and apart."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    t = crf.tokenize(texts)
    type_id, types = crf.types_of(t)
    if not len(type_id):
        return out
    best = crf.viterbi(model.emissions(t, type_id, types), t.doc, model.trans)
    shapes = model.extract
    for i, j, kind in crf.spans(best, t.doc, model.labels):
        d = int(t.doc[i])
        a, b = int(t.start[i] - t.base[d]), int(t.end[j - 1] - t.base[d])
        span = check_span(texts[d], a, b, kind, shapes)
        if span and (not out[d] or span[0] >= out[d][-1][1]):
            out[d].append((*span, kind))
    return out


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if part and size + len(text) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(text)
    if part:
        yield part


def gazetteer(name_parts: DataFrame) -> tuple[list[str], list[str]]:
    rows = small_rows(name_parts.where("name_part IS NOT NULL").select("name_part", "part_kind").distinct(), MAX_NAME_PARTS)
    return sorted(r.name_part for r in rows if r.part_kind == "given"), sorted(r.name_part for r in rows if r.part_kind == "surname")


def find_pii(df: DataFrame, name_parts: DataFrame, id_col: str = "sid", fields: tuple[str, ...] = ("search_text", "cwd")) -> DataFrame:
    """One row per item: ``id_col``, ``field_name``, ``pii_kind``, ``start_pos``, ``end_pos`` (characters)."""
    model = train(*gazetteer(name_parts))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, name in enumerate(fields):
                texts = batch.column(1 + f).to_pylist()
                for part in _slices(texts):
                    row, kind, start, end = [], [], [], []
                    for i, items in zip(part, find_items([texts[i] for i in part], model), strict=True):
                        for a, b, k in items:
                            row.append(i)
                            kind.append(k)
                            start.append(a)
                            end.append(b)
                    ids = batch.column(0).take(pa.array(np.array(row, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(row), pa.string()), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[id_col, "field_name", "pii_kind", "start_pos", "end_pos"])

    columns = [id_col, *(F.col(f).cast("string") for f in fields)]
    return df.select(*columns).mapInArrow(run, f"`{id_col}` {id_type}, field_name string, pii_kind string, start_pos bigint, end_pos bigint")


def redact_pii(df: DataFrame, name_parts: DataFrame, id_col: str = "sid", fields: tuple[str, ...] = ("search_text", "cwd")) -> DataFrame:
    """``id_col`` and the fields with every item replaced by ``<KIND>``; everything else stays as it is."""
    model = train(*gazetteer(name_parts))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0)]
            for f in range(len(fields)):
                texts = batch.column(1 + f).to_pylist()
                for part in _slices(texts):
                    for i, items in zip(part, find_items([texts[i] for i in part], model), strict=True):
                        pieces, at = [], 0
                        for a, b, k in items:
                            pieces += [texts[i][at:a], f"<{k.upper()}>"]
                            at = b
                        texts[i] = "".join([*pieces, texts[i][at:]])
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *fields])

    columns = [id_col, *(F.col(f).cast("string") for f in fields)]
    return df.select(*columns).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"`{f}` string" for f in fields))
