"""Columnar JSON: a finite-state tokenizer and a tree ("tape") over whole Arrow batches.

All records of a batch are laid out in one byte buffer, closed by 0xFF (a byte that UTF-8
never uses).  A four-class automaton (quote, backslash, end of record, anything else) with
three states (outside, in a string, after a backslash) finds every string.  The buffer is
cut into equal chunks that are scanned side by side: each chunk first yields its transition
*function* (there are at most 27, so a function is one small integer and composition one
table lookup), the functions are composed across the chunks by a prefix scan, and a second
pass replays each chunk from its now known first state.

Tokens are then ordered by nesting level.  In that order the members of every container lie
side by side, between its opening and its closing token, so the grammar of RFC 8259 becomes a
check of neighbouring tokens and no step walks a record.
"""

from __future__ import annotations

import json
from itertools import product

import numpy as np
import pyarrow as pa

CHUNK = 128
SEP = 0xFF
OUTSIDE, STRING, ESCAPE = 0, 1, 2
QUOTE_C, SLASH_C, SEP_C, OTHER_C = 0, 1, 2, 3

# Next state by character class and state.
_STEP = np.array([[1, 0, 1], [0, 2, 1], [0, 0, 0], [0, 1, 1]], dtype=np.uint8)
_CLASS = np.full(256, OTHER_C, dtype=np.uint8)
_CLASS[ord('"')], _CLASS[ord("\\")], _CLASS[SEP] = QUOTE_C, SLASH_C, SEP_C

# Transition functions, numbered; _THEN[f, g] is "first f, then g".
_FUNCS = list(product(range(3), repeat=3))
_NUMBER = {f: i for i, f in enumerate(_FUNCS)}
_APPLY = np.array(_FUNCS, dtype=np.uint8)
_THEN = np.array([[_NUMBER[tuple(g[f[s]] for s in range(3))] for g in _FUNCS] for f in _FUNCS], dtype=np.uint8)
_OF_CLASS = np.array([_NUMBER[tuple(int(x) for x in row)] for row in _STEP], dtype=np.uint8)
_EXTEND = _THEN[:, _OF_CLASS].copy()  # function so far, class of the next byte
_IDENTITY = _NUMBER[(0, 1, 2)]

# Token kinds.
OBJ, ARR, END_OBJ, END_ARR, COMMA, COLON, STR, SCALAR = range(8)
_KIND = np.full(256, 255, dtype=np.uint8)
for _k, _ch in enumerate("{[}],:"):
    _KIND[ord(_ch)] = _k
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[[ord(c) for c in '"\\/bfnrtu']] = True

# Number grammar: states are start, minus, zero, digits, point, fraction, e, sign, exponent, dead.
_NUM_CLASS = np.full(256, 6, dtype=np.uint8)
_NUM_CLASS[ord("0")] = 0
_NUM_CLASS[[ord(c) for c in "123456789"]] = 1
_NUM_CLASS[ord("-")], _NUM_CLASS[ord("+")], _NUM_CLASS[ord(".")] = 2, 3, 4
_NUM_CLASS[[ord("e"), ord("E")]] = 5
_NUM = np.full((10, 7), 9, dtype=np.uint8)
for _s, _c, _t in (
    (0, 2, 1), (0, 0, 2), (0, 1, 3), (1, 0, 2), (1, 1, 3), (2, 4, 4), (2, 5, 6), (3, 0, 3), (3, 1, 3), (3, 4, 4),
    (3, 5, 6), (4, 0, 5), (4, 1, 5), (5, 0, 5), (5, 1, 5), (5, 5, 6), (6, 2, 7), (6, 3, 7), (6, 0, 8), (6, 1, 8),
    (7, 0, 8), (7, 1, 8), (8, 0, 8), (8, 1, 8),
):
    _NUM[_s, _c] = _t
_NUM_END = np.array([0, 0, 1, 1, 0, 1, 0, 0, 1, 0], dtype=bool)


def lexical_states(data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State before each byte of ``data``; equal for any chunk length."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    lanes = -(-n // chunk)
    cls = np.full(lanes * chunk, OTHER_C, dtype=np.uint8)
    cls[:n] = _CLASS[data]
    cls = np.ascontiguousarray(cls.reshape(lanes, chunk).T)
    func = np.full(lanes, _IDENTITY, dtype=np.uint8)
    for row in cls:
        func = _EXTEND[func, row]
    step = 1  # inclusive prefix composition over the chunks
    while step < lanes:
        func[step:] = _THEN[func[:-step], func[step:]]
        step *= 2
    state = np.zeros(lanes, dtype=np.uint8)
    state[1:] = _APPLY[func[:-1], OUTSIDE]
    before = np.empty((chunk, lanes), dtype=np.uint8)
    for i, row in enumerate(cls):
        before[i] = state
        state = _STEP[row, state]
    return np.ascontiguousarray(before.T).reshape(-1)[:n]


class Tape:
    """The tokens of a batch of JSON records as arrays.

    ``ok`` says of each record whether it is exactly one JSON object; ``blank`` whether it is
    null, empty or white space; ``error`` holds the byte offset of the first fault, or -1.
    The other arrays have one entry for each token of the sound records, in nesting order.
    """

    def __init__(self, values: pa.Array, chunk: int = CHUNK):
        values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
        n = self.n = len(values)
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(values.buffers()[2], dtype=np.uint8) if n and values.buffers()[2] is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        if values.null_count:
            sizes = np.where(np.asarray(values.is_null()), 0, sizes)
        self.start = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=self.start[1:])
        data = self.data = np.full(self.start[-1], SEP, dtype=np.uint8)
        if values.null_count or (n and offsets[-1] - offsets[0] != sizes.sum()):
            for i in np.flatnonzero(sizes):
                data[self.start[i] : self.start[i] + sizes[i]] = raw[offsets[i] : offsets[i] + sizes[i]]
        elif n:
            inside = np.ones(len(data), dtype=bool)
            inside[self.start[1:] - 1] = False
            data[inside] = raw[offsets[0] : offsets[-1]]
        self.error = np.full(n, -1, dtype=np.int64)
        self._scan(chunk)

    # -- tokens ---------------------------------------------------------------------------

    def _record(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, side="right") - 1

    def _fault(self, pos: np.ndarray) -> None:
        """Notes faults at these ascending or unordered byte positions; the first of a record stays."""
        if len(pos):
            rec = self._record(pos)
            first = np.full(self.n, np.iinfo(np.int64).max)
            np.minimum.at(first, rec, pos - self.start[rec])
            now = np.where(self.error < 0, np.iinfo(np.int64).max, self.error)
            low = np.minimum(first, now)
            self.error = np.where(low == np.iinfo(np.int64).max, -1, low)

    def _scan(self, chunk: int) -> None:
        data = self.data
        state = lexical_states(data, chunk)
        quote = data == ord('"')
        opens = quote & (state == OUTSIDE)
        closes = quote & (state == STRING)
        out = (state == OUTSIDE) & ~quote
        kind = _KIND[data]
        structural = out & (kind != 255)
        sep = data == SEP
        scalar = out & ~structural & ~_SPACE[data] & ~sep
        first = scalar.copy()
        first[1:] &= ~scalar[:-1]
        token = opens | structural | first
        pos = np.flatnonzero(token)
        k = kind[pos]
        k[opens[pos]] = STR
        k[first[pos]] = SCALAR
        rec = self._record(pos)
        self.blank = np.bincount(rec, minlength=self.n)[: self.n] == 0 if self.n else np.zeros(0, bool)

        # Faults inside strings.
        self._fault(np.flatnonzero((state == STRING) & (data < 0x20)))
        after = np.flatnonzero(state == ESCAPE)
        after = after[data[after] != SEP]
        self._fault(after[~_ESCAPED[data[after]]])
        u = after[data[after] == ord("u")]
        if len(u):
            padded = np.concatenate([data, np.full(4, SEP, np.uint8)])
            self._fault(u[~(_HEX[padded[u + 1]] & _HEX[padded[u + 2]] & _HEX[padded[u + 3]] & _HEX[padded[u + 4]])])
        self._fault(np.flatnonzero(sep & (state != OUTSIDE)))

        # Ends of tokens; a string that does not close ends at its record's end.
        end = pos + 1
        s = np.flatnonzero(k == STR)
        if len(s):
            close = np.flatnonzero(closes)
            at = np.searchsorted(close, pos[s])
            stop = np.append(close, len(data))[at] + 1
            end[s] = np.minimum(stop, self.start[rec[s] + 1])
        v = np.flatnonzero(k == SCALAR)
        if len(v):
            last = scalar.copy()
            last[:-1] &= ~scalar[1:]
            end[v] = np.flatnonzero(last) + 1
            self._fault(pos[v[~self._sound_scalars(pos[v], end[v])]])

        # Depth; a record that closes too much or too little is faulty.
        up = (k == OBJ) | (k == ARR)
        down = (k == END_OBJ) | (k == END_ARR)
        run = np.cumsum(up.astype(np.int64) - down)
        base = np.concatenate([[0], run])[np.searchsorted(rec, np.arange(self.n), side="left")] if self.n else np.zeros(0, np.int64)
        depth = run - base[rec] if len(rec) else run
        self._fault(pos[depth < 0])
        if self.n:
            total = np.concatenate([[0], run])[np.searchsorted(rec, np.arange(self.n), side="right")] - base
            self._fault(self.start[1:][total > 0] - 1)

        good = (self.error < 0)[rec] if len(rec) else np.zeros(0, bool)
        self._order(pos[good], end[good], k[good], rec[good], depth[good])

    def _sound_scalars(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - at
        sound = np.zeros(len(at), dtype=bool)
        for word in (b"true", b"false", b"null"):
            c = np.flatnonzero(size == len(word))
            sound[c] |= self._equal(at[c], word)
        rest = np.flatnonzero(~sound)
        state = np.zeros(len(rest), dtype=np.uint8)
        live, i = np.arange(len(rest)), 0
        while len(live):
            done = size[rest[live]] == i
            sound[rest[live[done]]] = _NUM_END[state[live[done]]]
            live = live[~done & (state[live] != 9)]
            state[live] = _NUM[state[live], _NUM_CLASS[self.data[at[rest[live]] + i]]]
            i += 1
        return sound

    def _equal(self, at: np.ndarray, word: bytes) -> np.ndarray:
        same = np.ones(len(at), dtype=bool)
        for i, byte in enumerate(word):
            same &= self.data[at + i] == byte
        return same

    # -- tree -----------------------------------------------------------------------------

    def _order(self, pos, end, k, rec, depth) -> None:
        """Lays the tokens out by level and checks the grammar between neighbours."""
        up = (k == OBJ) | (k == ARR)
        down = (k == END_OBJ) | (k == END_ARR)
        # As a member, an opening token stands in its parent's level, a closing one in its own.
        level = depth - up + down
        heads = np.flatnonzero(up)
        # Each opening token appears twice: as member, and as head of the level it opens.
        ref = np.concatenate([np.arange(len(k)), heads])
        lev = np.concatenate([level, depth[heads]])
        is_head = np.concatenate([np.zeros(len(k), bool), np.ones(len(heads), bool)])
        by_pos = np.argsort(np.concatenate([2 * np.arange(len(k)), 2 * heads + 1]), kind="stable")
        ref, lev, is_head = ref[by_pos], lev[by_pos], is_head[by_pos]
        small = np.uint16 if len(lev) and lev.max() < 65536 else np.int64
        order = np.argsort(lev.astype(small), kind="stable")
        ref, lev, is_head = ref[order], lev[order], is_head[order]

        m = len(ref)
        kk = k[ref]
        box = np.maximum.accumulate(np.where(is_head, np.arange(m), -1)) if m else np.zeros(0, np.int64)
        box = np.where(lev > 0, box, -1)
        of_obj = np.where(box >= 0, kk[box] == OBJ, False)
        prev = np.concatenate([[0], kk[:-1]]) if m else kk
        prev_head = np.concatenate([[False], is_head[:-1]]) if m else is_head
        value = ((kk == STR) | (kk == SCALAR) | (kk == OBJ) | (kk == ARR)) & ~is_head
        starts = prev_head | (prev == COMMA)
        key = of_obj & (kk == STR) & starts & ~is_head & (lev > 0)
        prev_key = np.concatenate([[False], key[:-1]]) if m else key
        plain = value & ~key
        prev_plain = np.concatenate([[False], plain[:-1]]) if m else plain
        fine = np.where(
            of_obj,
            key | ((kk == COLON) & prev_key) | (plain & (prev == COLON) & ~prev_head) | ((kk == COMMA) & prev_plain) | ((kk == END_OBJ) & (prev_plain | prev_head)),
            (plain & starts) | ((kk == COMMA) & prev_plain) | ((kk == END_ARR) & (prev_plain | prev_head)),
        )
        inside = (lev > 0) & ~is_head
        self._fault(pos[ref[inside & ~fine]])
        top = lev == 0
        roots = np.flatnonzero(top & ~is_head)
        r_rec = rec[ref[roots]]
        again = np.concatenate([[False], r_rec[1:] == r_rec[:-1]]) if len(roots) else np.zeros(0, bool)
        self._fault(pos[ref[roots[again | (kk[roots] != OBJ)]]])

        self.ok = ~self.blank & (self.error < 0)
        # Nodes are member values; a container's node and its head are linked both ways.
        head_of_token = np.full(len(k), -1, dtype=np.int64)
        head_of_token[ref[is_head]] = np.flatnonzero(is_head)
        self.is_value = plain
        self.is_key = key
        self.kind = np.where(is_head, 255, kk).astype(np.uint8)
        self.array_head = is_head & (kk == ARR)
        self.pos, self.end, self.rec = pos[ref], end[ref], rec[ref]
        self.box = box  # entry of the head of the container that holds this entry, or -1
        self.head = np.where(up[ref], head_of_token[ref], -1) if m else np.zeros(0, np.int64)
        commas = np.cumsum((kk == COMMA) & ~is_head)
        self.index = commas - np.where(box >= 0, commas[box], 0) if m else commas
        self.root = np.full(self.n, -1, dtype=np.int64)
        sound_root = roots[self.ok[r_rec]] if len(roots) else roots
        self.root[rec[ref[sound_root]]] = sound_root
        self._slashes = None

    def has_escape(self, nodes: np.ndarray) -> np.ndarray:
        if self._slashes is None:
            self._slashes = np.flatnonzero(self.data == ord("\\"))
        return np.searchsorted(self._slashes, self.end[nodes]) > np.searchsorted(self._slashes, self.pos[nodes])

    def member(self, name: str) -> np.ndarray:
        """By entry of a head: the value node under ``name`` (the last, where it is repeated), or -1."""
        keys = np.flatnonzero(self.is_key)
        word = name.encode()
        size = self.end[keys] - self.pos[keys] - 2
        plain = keys[size == len(word)]
        hit = plain[self._equal(self.pos[plain] + 1, word)]
        odd = keys[(size > len(word)) & self.has_escape(keys)]
        if len(odd):
            same = [json.loads(self.data[self.pos[i] : self.end[i]].tobytes(), strict=False) == name for i in odd]
            hit = np.union1d(hit, odd[np.array(same, dtype=bool)])
        found = np.full(len(self.kind) + 1, -1, dtype=np.int64)  # the extra entry serves index -1
        hit = hit[(hit + 2 < len(self.kind))]
        hit = hit[self.is_value[hit + 2]]
        found[self.box[hit]] = hit + 2
        found[-1] = -1
        return found

    def get(self, table: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Member of the objects ``nodes`` (value entries or -1) by a table of :meth:`member`."""
        safe = np.where(nodes >= 0, nodes, 0)
        is_obj = (nodes >= 0) & (self.kind[safe] == OBJ) if len(self.kind) else np.zeros(len(nodes), bool)
        return np.where(is_obj, table[np.where(is_obj, self.head[safe], -1)], -1) if len(self.kind) else np.full(len(nodes), -1)

    def kind_of(self, nodes: np.ndarray) -> np.ndarray:
        """Kinds of value entries; 255 for -1."""
        if not len(self.kind):
            return np.full(len(nodes), 255, dtype=np.uint8)
        return np.where(nodes >= 0, self.kind[np.where(nodes >= 0, nodes, 0)], 255)

    def strings(self, nodes: np.ndarray) -> pa.Array:
        """Decoded texts of string entries; null for -1 and for other kinds.

        A lone surrogate escape has no place in UTF-8 and comes out as U+FFFD.
        """
        nodes = np.asarray(nodes, dtype=np.int64)
        is_str = self.kind_of(nodes) == STR
        at = np.where(is_str, nodes, 0)
        a = np.where(is_str, self.pos[at] + 1, 0) if len(self.kind) else np.zeros(len(nodes), np.int64)
        b = np.where(is_str, self.end[at] - 1, 0) if len(self.kind) else a
        odd = np.zeros(len(nodes), dtype=bool)
        odd[is_str] = self.has_escape(nodes[is_str])
        size = b - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])
        body = self.data[take].tobytes()
        plain = pa.Array.from_buffers(pa.large_binary(), len(nodes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
        if not odd.any():
            out = plain.cast(pa.large_string())
        else:
            texts = plain.to_pylist()
            for i in np.flatnonzero(odd):
                text = json.loads(b'"' + texts[i] + b'"', strict=False)
                texts[i] = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
            out = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        return pa.compute.if_else(pa.array(is_str), out, pa.scalar(None, pa.large_string())) if not is_str.all() else out

    def error_chars(self) -> np.ndarray:
        """First fault of each record as a position in characters; -1 where there is none."""
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        at = np.where(self.error >= 0, self.error, 0) + self.start[:-1]
        return np.where(self.error >= 0, lead[at] - lead[self.start[:-1]], -1)


def slices(values: pa.Array, most: int = 8 << 20):
    """(first, length) runs of ``values`` of at most about ``most`` bytes; a larger record stands alone."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0), dtype=np.int64) + 1
    total = np.cumsum(size)
    i, n = 0, len(values)
    while i < n:
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j - i
        i = j
