"""Session log files: <root>/<project>/<sid>.jsonl, one JSON value per line.

Spark's file sources leave out files whose names begin with ``_`` or ``.``; such sessions are not
read.  A line that is no valid UTF-8 is skipped, a trailing carriage return is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions.json_tape import ARR, OBJ, STR, Tape, slices


def _stem(path):
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")


def safe_sid(sid):
    """Ids that could lead out of their folder are no ids."""
    return ~(sid.rlike(r"[/\\]") | sid.contains(".."))


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``sid``, ``mtime_epoch`` of every session file, without reading any content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root.rstrip('/')}/*/*.jsonl")
    return files.select("path", _stem(F.col("path")).alias("sid"), F.unix_seconds("modificationTime").alias("mtime_epoch"))


def find_session(files: DataFrame, sid: str) -> DataFrame:
    """The file of a session: the least path, none for an unsafe id."""
    return files.where((F.col("sid") == sid) & safe_sid(F.lit(sid))).orderBy("path").limit(1)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``, ``sid``, ``line_no``, ``value``, ``mtime``.

    Files may be split.  Lines are numbered within their split (a bounded stretch of a file), and
    the lines of the splits before it are added, so no file ends in one task.  A line that is no
    valid UTF-8 keeps its number and is left out.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.is_valid_utf8("value").alias("sound"),  # before anything decodes and so repairs it
        "value",
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("path", "block").orderBy("place")))
    sizes = lines.groupBy("path", "block").agg(F.max("n").alias("size"))  # one row per split
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    lines = lines.where("sound").join(bases, ["path", "block"])
    return lines.select("path", _stem(F.col("path")).alias("sid"), (F.col("base") + F.col("n") - 1).cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"), "mtime")


def _nested(flat: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """List array of n rows from values in order of their owners."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.cast(pa.string()))


def _events_of(values: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Event columns of lines within the size cap, and which lines are JSON objects."""
    t = Tape(values)
    n = t.n
    message = t.get(t.member("message"), t.root)
    content = t.get(t.member("content"), message)
    types, contents, texts = t.member("type"), t.member("content"), t.member("text")
    kind = t.kind_of(content)
    nodes = np.flatnonzero(t.is_value & (t.box >= 0))
    # Members of the content arrays of the lines, in order of line and place.
    head = t.head[np.where(kind == ARR, content, 0)] if len(t.kind) else np.full(n, -1)
    line_of = np.full(len(t.kind) + 1, -1, dtype=np.int64)
    line_of[head[kind == ARR]] = np.flatnonzero(kind == ARR)
    blocks = nodes[(line_of[t.box[nodes]] >= 0) & (t.kind[nodes] == OBJ)] if len(nodes) else nodes
    block_type = t.strings(t.get(types, blocks))
    own = line_of[t.box[blocks]]
    text_at = np.where(np.asarray(pc.fill_null(pc.equal(block_type, "text"), False)), t.get(texts, blocks), -1)
    on = t.kind_of(text_at) == STR
    whole = np.flatnonzero(kind == STR)
    entry, line = np.concatenate([text_at[on], content[whole]]), np.concatenate([own[on], whole])
    by = np.argsort(line, kind="stable")
    all_texts = _nested(t.strings(entry[by]), line[by], n)
    result_at = np.where(np.asarray(pc.fill_null(pc.equal(block_type, "tool_result"), False)), t.get(contents, blocks), -1)
    on = t.kind_of(result_at) == STR
    results = t.strings(result_at[on])
    short = np.asarray(pc.less(pc.binary_length(results), S.TOOL_RESULT_BYTES)) if len(results) else np.zeros(0, bool)
    results = pc.utf8_slice_codeunits(results.filter(pa.array(short)), 0, S.TOOL_RESULT_CHARS)
    tool_results = _nested(results, own[on][short], n)
    columns = [t.strings(t.get(t.member(name), t.root)).cast(pa.string()) for name in ("type", "timestamp", "gitBranch", "cwd", "customTitle")]
    has = (kind == STR) | (kind == ARR)
    return [*columns, all_texts, tool_results, pa.array(has)], np.asarray(t.ok)


def events(lines: DataFrame) -> DataFrame:
    """Decoded events of raw lines (:data:`logweave.schema.EVENTS`).

    A line above the size cap is never parsed: it comes out as ``oversized``, with the type that
    its text holds in compact form, if any.  Lines that are no JSON object give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in S.EVENTS.split(", ")]
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column("value")), 0))
            big = size > S.LINE_BYTES
            if big.any():
                part = batch.filter(pa.array(big))
                value = part.column("value")
                user = pc.match_substring(value, '"type":"user"')
                kind = pc.if_else(user, "user", pc.if_else(pc.match_substring(value, '"type":"assistant"'), "assistant", pa.scalar(None, pa.string())))
                none, empty = pa.nulls(len(value), pa.string()), pa.array([[]] * len(value), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("line_no"), kind, none, none, none, none, empty, empty, pa.array([False] * len(value)), pa.array([True] * len(value))], names=names)
            part = batch.filter(pa.array(~big))
            for first, length in slices(part.column("value")):
                piece = part.slice(first, length)
                columns, fine = _events_of(piece.column("value"))
                yield pa.RecordBatch.from_arrays([piece.column("sid"), piece.column("line_no"), *columns, pa.array([False] * length)], names=names).filter(pa.array(fine))

    return lines.select("sid", F.col("line_no").cast("bigint").alias("line_no"), F.col("value").cast("string").alias("value")).mapInArrow(run, S.EVENTS)
