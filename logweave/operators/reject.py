"""Problem 7: rows that fail to parse, set apart with the reason, while the others load.

Each Arrow batch goes through the finite-state tokenizer of :mod:`logweave.functions.json_tape`;
the pass needs no shuffle and reads two columns.

Defined results: a null, empty or white-space line is neither failed nor loaded; a repeated key
counts with its last value; a byte order mark is a syntax fault; repeated rows come out as often
as they come in; extra columns are ignored; an empty table gives an empty result; a line of any
length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.json_tape import ARR, OBJ, STR, Tape, slices
from logweave.functions.spark import small_rows

MAX_KINDS = 10_000


@dataclass(frozen=True)
class Kinds:
    """Event kinds: all of them, and those that carry messages."""

    known: frozenset[str]
    carrying: frozenset[str]

    @classmethod
    def of(cls, df: DataFrame) -> Kinds:
        rows = small_rows(df.select("kind", "carries_message").where("kind IS NOT NULL").distinct(), MAX_KINDS)
        return cls(frozenset(r.kind for r in rows), frozenset(r.kind for r in rows if r.carries_message))


@dataclass
class Verdict:
    """What one batch says of its lines."""

    tape: Tape
    reason: np.ndarray  # "" for a sound line
    at: np.ndarray  # position of the fault in characters, -1 where none is known
    event_type: pa.Array
    message: np.ndarray  # value entry of message, or -1
    content: np.ndarray  # value entry of message.content, or -1
    carries: np.ndarray


def judge(values: pa.Array, kinds: Kinds) -> Verdict:
    tape = Tape(values)
    types = tape.member("type")
    messages, contents = tape.member("message"), tape.member("content")
    type_at = tape.get(types, tape.root)
    event_type = tape.strings(type_at)
    known = np.asarray(pc.fill_null(pc.is_in(event_type, pa.array(sorted(kinds.known), pa.large_string())), False))
    carries = np.asarray(pc.fill_null(pc.is_in(event_type, pa.array(sorted(kinds.carrying), pa.large_string())), False))
    message = tape.get(messages, tape.root)
    content = tape.get(contents, message)

    # Arrays with a member that is no object with a string type.
    members = np.flatnonzero(tape.is_value & (tape.box >= 0))
    in_array = members[tape.array_head[tape.box[members]]] if len(members) else members
    bad_head = np.zeros(len(tape.kind) + 1, dtype=bool)
    if len(in_array):
        typed = tape.kind_of(tape.get(types, in_array)) == STR
        bad_head[tape.box[in_array[~typed]]] = True
    kind = tape.kind_of(content)
    head = tape.head[np.where(kind == ARR, content, 0)] if len(tape.kind) else np.full(tape.n, -1)
    bad = tape.kind_of(message) != OBJ
    bad |= (content >= 0) & (kind != STR) & (kind != ARR)
    bad |= (kind == ARR) & bad_head[head]

    reason = np.full(tape.n, "", dtype=object)
    reason[tape.ok & known & carries & bad] = "message"
    reason[tape.ok & ~known] = "type"
    reason[~tape.ok & ~tape.blank] = "syntax"
    at = tape.error_chars()
    where = np.where(reason == "type", type_at, np.where(reason == "message", np.where(content >= 0, content, message), -1))
    if len(tape.kind):
        lead = np.concatenate([[0], np.cumsum((tape.data & 0xC0) != 0x80)])
        p = tape.pos[np.where(where >= 0, where, 0)]
        at = np.where(where >= 0, lead[p] - lead[tape.start[:-1]], at)
    return Verdict(tape, reason, at, event_type, message, content, carries)


def split_records(lines: DataFrame, kinds: Kinds, id_col: str = "line_id", value_col: str = "value") -> DataFrame:
    """One row per line that is not blank: the id, the typed fields, and the fault or null.

    Columns: ``id_col``, ``event_type``, ``event_ts``, ``cwd``, ``branch``, ``role`` and
    ``content_kind`` of a loaded line; ``reason`` and ``error_pos`` (in characters) of a failed one.
    """
    id_type = lines.schema[id_col].dataType.simpleString()
    texts = ("event_type", "event_ts", "cwd", "branch", "role", "content_kind", "reason")
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} string" for c in texts) + ", error_pos bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            for first, size in slices(values):
                v = judge(values.slice(first, size), kinds)
                t = v.tape
                fine = v.reason == ""

                def text(entries: np.ndarray, t: Tape = t, fine: np.ndarray = fine) -> pa.Array:
                    return t.strings(np.where(fine, entries, -1))

                name = np.array(["none", "text", "blocks"], dtype=object)
                kind = t.kind_of(v.content)
                content_kind = pa.array(np.where(fine & v.carries, name[np.where(kind == STR, 1, np.where(kind == ARR, 2, 0))], None), pa.string())
                columns = [
                    pc.if_else(pa.array(fine), v.event_type, pa.scalar(None, pa.large_string())),
                    text(t.get(t.member("timestamp"), t.root)),
                    text(t.get(t.member("cwd"), t.root)),
                    text(t.get(t.member("gitBranch"), t.root)),
                    text(t.get(t.member("role"), v.message)),
                    content_kind,
                    pa.array(np.where(fine, None, v.reason), pa.string()),
                ]
                out = [ids.slice(first, size), *(c.cast(pa.string()) for c in columns), pa.array(np.where(fine, -1, v.at), pa.int64(), mask=fine | (v.at < 0))]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, *texts, "error_pos"]).filter(pa.array(~t.blank))

    return lines.select(id_col, F.col(value_col).cast("string")).mapInArrow(run, schema)


def rejected(split: DataFrame) -> DataFrame:
    return split.where("reason IS NOT NULL")


def loaded(split: DataFrame) -> DataFrame:
    return split.where("reason IS NULL").drop("reason", "error_pos")
