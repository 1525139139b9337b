"""Linear-chain conditional random field over word shapes, in numpy.

Texts become tokens by character classes (runs of letters, split at camel case; runs of digits;
single signs), all in arrays.  A token's features depend on its type alone, so they are computed
once per distinct type of a batch and taken for each token and its neighbours; how the coarse
shapes of neighbouring tokens combine is a second set of weights.  What depends on more than one
token (the shape of a whole number, announcing words before it) comes through channels: arrays
that give each token one slot of a fixed width.  Training maximises the
conditional likelihood with AdaGrad; decoding is Viterbi over chains of similar length at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

SPACE, LOWER, UPPER, DIGIT, SIGN = range(5)
REACH = 3  # neighbours on each side whose features count
_HASHES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _char_class(cp: int) -> int:
    c = chr(cp)
    cat = unicodedata.category(c)
    if c.isspace() or cat in ("Cc", "Zs", "Zl", "Zp"):
        return SPACE
    if cat == "Nd":
        return DIGIT
    if cat in ("Lu", "Lt"):
        return UPPER
    return LOWER if cat[0] in "LM" else SIGN


_CLASSES = np.array([_char_class(i) for i in range(0x3000)], dtype=np.uint8)


def classes_of(cp: np.ndarray) -> np.ndarray:
    """Beyond the first blocks: letters, but signs in the symbol and emoji planes."""
    out = np.where(cp >= 0x1F000, SIGN, LOWER).astype(np.uint8)
    low = cp < 0x3000
    out[low] = _CLASSES[cp[low]]
    out[(cp >= 0x3000) & (cp <= 0x303F)] = SIGN
    out[cp == 0x3000] = SPACE
    out[(cp >= 0xFF00) & (cp <= 0xFF0F)] = SIGN
    return out


@dataclass
class Tokens:
    """Tokens of several texts laid end to end."""

    cp: np.ndarray  # all characters
    start: np.ndarray  # first character of each token, in cp
    end: np.ndarray
    doc: np.ndarray  # text of each token
    base: np.ndarray  # first character of each text, in cp
    spaced: np.ndarray  # white space (or the text's edge) before the token

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def tokenize(texts: list[str]) -> Tokens:
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    base = np.concatenate([[0], np.cumsum(sizes)])
    k = classes_of(cp)
    before = np.concatenate([[SPACE], k[:-1]])
    letter = (k == LOWER) | (k == UPPER)
    letter_before = (before == LOWER) | (before == UPPER)
    same = (letter & letter_before & ~((k == UPPER) & (before == LOWER))) | ((k == DIGIT) & (before == DIGIT))
    first = (k != SPACE) & ~same
    start = np.flatnonzero(first)
    after = np.concatenate([first[1:] | (k[1:] == SPACE), [True]]) & (k != SPACE)
    end = np.flatnonzero(after) + 1
    doc = np.searchsorted(base, start, side="right") - 1
    return Tokens(cp, start, end, doc, base[:-1], before[start] == SPACE)


def types_of(t: Tokens) -> tuple[np.ndarray, list[str]]:
    """Type of each token and the types' texts; types are told apart by a 64-bit hash of up to 64 characters and the length."""
    size = t.end - t.start
    if not len(size):
        return np.zeros(0, np.int64), []
    at = np.repeat(t.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    inside = at - np.repeat(t.start, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(t.cp[at].astype(np.uint64) * _HASHES[inside & 63], np.cumsum(size) - size) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
    _, one, type_id = np.unique(h, return_index=True, return_inverse=True)
    return type_id, [t.text(i) for i in one]


@dataclass
class Model:
    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray  # (2 * REACH + 1, features, labels)
    coarse_weights: np.ndarray  # (coarse ** 3, labels): previous, own, next
    spaced_weights: np.ndarray  # (8, labels): white space before own, next, after next token
    trans: np.ndarray  # (labels + 1, labels): the last row is the start
    coarse: int
    extract: Callable[[str], tuple[list[str], int]] = field(repr=False, default=None)
    channel_weights: np.ndarray | None = None  # (channels, width, labels)

    def emissions(self, t: Tokens, type_id: np.ndarray, types: list[str]) -> np.ndarray:
        n, labels = len(type_id), len(self.labels)
        span = 2 * REACH + 1
        table = np.zeros((len(types), span, labels), dtype=np.float32)
        shape = np.zeros(len(types) + 1, dtype=np.int64)
        for i, word in enumerate(types):
            names, shape[i] = self.extract(word)
            ids = [self.features[f] for f in names if f in self.features]
            if ids:
                table[i] = self.weights[:, ids].sum(1)
        out = np.zeros((n, labels), dtype=np.float32)
        for o in range(-REACH, REACH + 1):
            a, b = max(0, -o), min(n, n - o)
            if b > a:
                near = t.doc[a:b] == t.doc[a + o : b + o]
                out[a:b][near] += table[type_id[a + o : b + o][near], o + REACH]
        out += self.coarse_weights[trigrams(shape[type_id], t.doc, self.coarse)]
        out += self.spaced_weights[spacing(t)]
        if self.channel_weights is not None:
            for w, slot in zip(self.channel_weights, self.extract.channels(t, type_id, types), strict=True):
                out += w[slot]
        return out


def trigrams(shape: np.ndarray, doc: np.ndarray, coarse: int) -> np.ndarray:
    """Index of the coarse shapes before, at and after each token; the edge of a text is shape 0."""
    n = len(shape)
    if not n:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:] = np.where(doc[1:] == doc[:-1], shape[:-1], 0)
    after[:-1] = np.where(doc[1:] == doc[:-1], shape[1:], 0)
    return (before * coarse + shape) * coarse + after


def spacing(t: Tokens) -> np.ndarray:
    s = np.concatenate([t.spaced, [True, True]]).astype(np.int64)
    return s[:-2] * 4 + s[1:-1] * 2 + s[2:]


def viterbi(emit: np.ndarray, chain: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels; ``chain`` numbers the chain of each token (ascending).  Chains of similar length are decoded side by side."""
    n, labels = emit.shape
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(size, kind="stable")
    at = 0
    inner, start = trans[:-1], trans[-1]
    while at < len(order):
        longest = int(size[order[at]] * 1.25) + 4
        stop = at + int(np.searchsorted(size[order[at:]], longest, side="right"))
        stop = min(stop, at + max(1, 400_000 // longest))
        rows = order[at:stop]
        steps = int(size[rows].max())
        score = emit[first[rows]] + start
        back = np.zeros((steps, len(rows), labels), dtype=np.uint8)
        live = size[rows]
        for s in range(1, steps):
            on = np.flatnonzero(live > s)
            way = score[on][:, :, None] + inner[None]
            best = way.argmax(1)
            back[s, on] = best
            score[on] = np.take_along_axis(way, best[:, None], 1)[:, 0] + emit[first[rows[on]] + s]
        label = score.argmax(1)
        for s in range(steps - 1, -1, -1):
            on = np.flatnonzero(live > s)
            out[first[rows[on]] + s] = label[on]
            if s:
                label[on] = back[s, on, label[on]]
        at = stop
    return out


class _Batch:
    """A share of the training texts, laid out for one step."""

    def __init__(self, t: Tokens, at: np.ndarray, type_id: np.ndarray, ids_of: list[list[int]], tri: np.ndarray, sp: np.ndarray, slots: list[np.ndarray], y: np.ndarray, k: int):
        self.tri, self.sp, self.slots, self.n = tri[at], sp[at], [x[at] for x in slots], len(at)
        own, local = np.unique(type_id[at], return_inverse=True)
        self.types = len(own)
        self.ft = np.array([i for i, o in enumerate(own) for _ in ids_of[o]], dtype=np.int64)
        self.ff = np.array([f for o in own for f in ids_of[o]], dtype=np.int64)
        self.by_feature = np.argsort(self.ff, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(self.ff[self.by_feature]) > 0]))
        self.feature_heads, self.used_features = heads, self.ff[self.by_feature][heads]
        self.with_features, self.type_heads = np.unique(self.ft, return_index=True)
        doc, n = t.doc[at], self.n
        self.near = []  # by offset: tokens, their neighbours' types, and how to sum over equal types
        for o in range(-REACH, REACH + 1):
            a, b = max(0, -o), min(n, n - o)
            here = a + np.flatnonzero(doc[a:b] == doc[a + o : b + o])
            src = local[here + o]
            by = np.argsort(src, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(src[by]) > 0]))
            self.near.append((here, src, here[by], heads, src[by][heads]))
        # Longest first, so that the chains still running at a step are the first rows.
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        order = np.argsort(-size, kind="stable")
        self.first, size = first[order], size[order]
        self.live = [int(np.searchsorted(-size, -s, side="left")) for s in range(int(size.max()))]
        self.gold = np.zeros((n, k))
        self.gold[np.arange(n), y[at]] = 1
        prev = np.concatenate([[k], y[at][:-1]])
        prev[first] = k
        self.gold_tr = np.zeros((k + 1, k))
        np.add.at(self.gold_tr, (prev, y[at]), 1)


def fit(rows: list[tuple], labels: list[str], extract, coarse: int, label_of: Callable, rounds: int = 12, batches: int = 12, rate: float = 0.25, decay: float = 0.4, least: int = 4, width: int = 0) -> Model:
    """Maximises the penalised conditional likelihood of labelled texts, some of them at a time.

    ``rows`` start with the text; ``label_of(tokens)`` gives the label number of every token.  A
    feature counts if ``least`` training types or more have it or if it is no word of its own.  With
    ``width`` the extractor's ``channels`` take part.
    """
    t = tokenize([r[0] for r in rows])
    type_id, types = types_of(t)
    y = label_of(t)
    k, span = len(labels), 2 * REACH + 1
    seen = np.bincount(type_id, minlength=len(types))
    named = [extract(word) for word in types]
    shape = np.array([c for _, c in named], dtype=np.int64)
    count: dict[str, int] = {}
    for (names, _), c in zip(named, seen, strict=True):
        for f in names:
            count[f] = count.get(f, 0) + int(c)
    features = {f: i for i, f in enumerate(f for f, c in count.items() if c >= least)}
    ids_of = [[features[f] for f in names if f in features] for names, _ in named]
    tri, tri_used = np.unique(trigrams(shape[type_id], t.doc, coarse), return_inverse=True)
    sp = spacing(t)
    slots, used = [], []
    for slot in extract.channels(t, type_id, types) if width else []:
        own, local = np.unique(slot, return_inverse=True)
        slots.append(local)
        used.append(own)
    shares = [_Batch(t, at, type_id, ids_of, tri_used, sp, slots, y, k) for b in range(batches) if len(at := np.flatnonzero(t.doc % batches == b))]
    w = np.zeros((span, len(features), k))
    wc, ws, tr = np.zeros((len(tri), k)), np.zeros((8, k)), np.zeros((k + 1, k))
    wx = [np.zeros((len(own), k)) for own in used]
    weights = [w, wc, ws, tr, *wx]
    sums = [np.full_like(x, 1e-8) for x in weights]
    for _ in range(rounds):
        for s in shares:
            gradients = _gradients(s, w, wc, ws, tr, wx)
            for x, g, q in zip(weights, gradients, sums, strict=True):
                g -= decay / len(shares) * x
                q += g * g
                x += rate * g / np.sqrt(q)
    full = np.zeros((coarse**3, k), dtype=np.float32)
    full[tri] = wc
    channels = np.zeros((len(used), width, k), dtype=np.float32)
    for c, (own, x) in enumerate(zip(used, wx, strict=True)):
        channels[c, own] = x
    # A run goes on only with its own kind.
    for i in range(k + 1):
        for j, to in enumerate(labels):
            if to[0] == "I" and (i == k or labels[i][1:] != to[1:]):
                tr[i, j] = -1e4
    return Model(labels, features, w.astype(np.float32), full, ws.astype(np.float32), tr.astype(np.float32), coarse, extract, channels if width else None)


def _gradients(s: _Batch, w: np.ndarray, wc: np.ndarray, ws: np.ndarray, tr: np.ndarray, wx: list[np.ndarray]) -> list[np.ndarray]:
    """Of the log likelihood of a batch, by forward and backward passes over its chains side by side."""
    n, k = s.n, len(tr) - 1
    emit = wc[s.tri] + ws[s.sp]
    for x, slot in zip(wx, s.slots, strict=True):
        emit += x[slot]
    for o, (at, src, *_) in enumerate(s.near):
        table = np.zeros((s.types, k))
        table[s.with_features] = np.add.reduceat(w[o][s.ff], s.type_heads, axis=0)
        emit[at] += table[src]
    e = np.exp(emit - emit.max(1, keepdims=True))
    step, begin = np.exp(tr[:-1]), np.exp(tr[-1])
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for i, m in enumerate(s.live):
        at = s.first[:m] + i
        x = (alpha[at - 1] @ step if i else np.broadcast_to(begin, (m, k))) * e[at]
        scale[at] = x.sum(1)
        alpha[at] = x / scale[at, None]
    beta = np.ones((len(s.first), k))
    p, exp_tr = np.zeros((n, k)), np.zeros((k + 1, k))
    for i in range(len(s.live) - 1, -1, -1):
        m = s.live[i]
        at = s.first[:m] + i
        p[at] = alpha[at] * beta[:m]
        if i:
            x = e[at] * beta[:m] / scale[at, None]
            exp_tr[:-1] += step * (alpha[at - 1].T @ x)
            beta[:m] = x @ step.T
    exp_tr[-1] = p[s.first].sum(0)
    d = s.gold - p
    gw = np.zeros_like(w)
    for o, (_, _, sorted_at, heads, which) in enumerate(s.near):
        dt = np.zeros((s.types, k))
        dt[which] = np.add.reduceat(d[sorted_at], heads, axis=0)
        gw[o, s.used_features] = np.add.reduceat(dt[s.ft[s.by_feature]], s.feature_heads, axis=0)
    out = [gw]
    for slot, like in ((s.tri, wc), (s.sp, ws)):
        g = np.zeros_like(like)
        np.add.at(g, slot, d)
        out.append(g)
    out.append(s.gold_tr - exp_tr)
    for slot, like in zip(s.slots, wx, strict=True):
        g = np.zeros_like(like)
        for j in range(k):
            g[:, j] = np.bincount(slot, d[:, j], minlength=len(like))
        out.append(g)
    return out


def spans(labels: np.ndarray, doc: np.ndarray, names: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first token, end token, kind) of every run that the labels B-kind, I-kind mark."""
    on = np.flatnonzero(labels != 0)
    at = 0
    while at < len(on):
        i = on[at]
        kind = names[labels[i]][2:]
        j = i + 1
        at += 1
        while at < len(on) and on[at] == j and names[labels[j]] == "I-" + kind and doc[j] == doc[i]:
            j += 1
            at += 1
        yield int(i), int(j), kind
