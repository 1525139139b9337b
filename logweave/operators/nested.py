"""Problem 2: deeply nested records turned into related flat tables.

``flatten_blocks`` works on JSON lines: the tree of a batch is read from the tape and laid out
as Arrow list arrays, level by level.  A level is flattened with its list offsets and parent
indices; ids and paths of the parents reach the children by a vectorised take, so no record is
walked.  ``flatten_lists`` does the same for columns that already are nested Arrow lists.
Neither shuffles, and both read only the columns they need.

Defined results for ``flatten_blocks``: lines that fail (see :mod:`logweave.operators.reject`),
blank lines and kinds without messages give no rows; a member of a nested content array that is
no object is no block but keeps its position; a nested object without a string type gives a
block with null type; null, absent or other content gives none; repeated rows give repeated
blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.json_tape import ARR, OBJ, STR, Tape, slices
from logweave.operators.reject import Kinds, Verdict, judge

BLOCK_COLUMNS = "node_path string, parent_path string, block_type string, depth int, text string"


def _content_lists(tape: Tape, content: np.ndarray, child_of: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """For each content entry the list of its member entries; a string stands for itself."""
    kind = tape.kind_of(content)
    first, members = child_of
    safe = np.where(kind == ARR, content, 0)
    head = tape.head[safe] if len(tape.kind) else safe
    count = np.where(kind == ARR, first[head + 1] - first[head], np.where(kind == STR, 1, 0))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(np.where(kind == ARR, first[head], 0) - offsets[:-1], count) + np.arange(offsets[-1])
    values = np.where(np.repeat(kind == ARR, count), members[at] if len(members) else 0, np.repeat(content, count))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def blocks_of(v: Verdict, ids: pa.Array, with_text: bool) -> Iterator[list[pa.Array]]:
    """The blocks of a judged batch, one list of columns per level."""
    tape = v.tape
    if not len(tape.kind):
        return
    types, contents, texts = tape.member("type"), tape.member("content"), tape.member("text")
    # Members of every container in order: entries are in nesting order, so they are contiguous by head.
    members = np.flatnonzero(tape.is_value & (tape.box >= 0))
    first = np.searchsorted(tape.box[members], np.arange(len(tape.kind) + 1))
    child_of = (first, members)

    keep = np.flatnonzero((v.reason == "") & v.carries)
    ids, paths = ids.take(pa.array(keep)), pa.nulls(len(keep), pa.string()).fill_null("")
    content, depth = v.content[keep], 0
    while len(content):
        lists = _content_lists(tape, content, child_of)
        up = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pc.list_parent_indices(lists)
        node = np.asarray(pc.list_flatten(lists))
        parent = np.asarray(up)
        starts = np.asarray(lists.offsets)[parent]
        position = np.arange(len(node)) - starts
        is_text = tape.kind_of(content)[parent] == STR if len(parent) else np.zeros(0, bool)
        real = is_text | (tape.kind_of(node) == OBJ)
        node, parent, position, is_text = node[real], parent[real], position[real], is_text[real]
        take = pa.array(parent)
        ids, above = ids.take(take), paths.take(take)
        here = pa.array(position).cast(pa.string())
        paths = here if depth == 0 else pc.binary_join_element_wise(above, here, ".")
        type_at = np.where(is_text, -1, tape.get(types, node))
        block_type = pc.if_else(pa.array(is_text), pa.scalar("text", pa.large_string()), tape.strings(type_at))
        if with_text:
            text = tape.strings(np.where(is_text, node, tape.get(texts, node)))
        else:
            text = pa.nulls(len(node), pa.large_string())
        yield [ids, paths, above, block_type.cast(pa.string()), pa.array(np.full(len(node), depth, np.int32)), text.cast(pa.string())]
        content = np.where(is_text, -1, tape.get(contents, node))
        depth += 1


def flatten_blocks(lines: DataFrame, kinds: Kinds, id_col: str = "line_id", value_col: str = "value", with_text: bool = True) -> DataFrame:
    """One row per content block of every sound line that carries messages.

    ``node_path`` holds the positions from the top, ``parent_path`` that of the parent ('' at the
    top); together with ``id_col`` they link the table to itself and to the lines.
    """
    id_type = lines.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split(" ")[0] for c in BLOCK_COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            for first, size in slices(values):
                v = judge(values.slice(first, size), kinds)
                for columns in blocks_of(v, ids.slice(first, size), with_text):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return lines.select(id_col, F.col(value_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, {BLOCK_COLUMNS}")


def flatten_lists(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Child table of an array column: id of the parent row, position, and the element's fields.

    The offsets of the Arrow list give parents and positions.  An element that is a struct
    becomes one column per field (a field named like ``id_col`` or ``position`` gets the suffix
    ``_1``), any other element the column ``element``.  A null or empty list gives no rows, a
    null element a row of nulls.  Applied to a child table again it unfolds the next level.
    """
    element = df.schema[list_col].dataType.elementType
    fields = [(f.name, f.dataType) for f in element.fields] if isinstance(element, T.StructType) else [("element", element)]
    taken = {id_col, "position"}
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("position", T.IntegerType())])
    for name, kind in fields:
        schema.add(f"{name}_1" if name in taken else name, kind)
    is_struct = isinstance(element, T.StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            up = pc.list_parent_indices(lists)
            values = pc.list_flatten(lists)
            parent = np.asarray(up)
            counts = np.bincount(parent, minlength=len(lists)) if len(parent) else np.zeros(len(lists), np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            position = (np.arange(len(parent)) - starts[parent]).astype(np.int32) if len(parent) else np.zeros(0, np.int32)
            children = [pc.struct_field(values, [i]) for i in range(len(fields))] if is_struct else [values]
            yield pa.RecordBatch.from_arrays([ids.take(up), pa.array(position), *children], names=schema.fieldNames())

    return df.select(id_col, list_col).mapInArrow(run, schema)
