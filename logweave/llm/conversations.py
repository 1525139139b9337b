"""Problem 5: conversations rebuilt from message rows.

Rows are counted once per line, roles are inferred from the kind of event, and messages are put
in order of time.  The order comes from one range-partitioned sort over (sid, time, line), so a
sid with a third of all rows is spread over many tasks; each task numbers its stretch of a
session and the stretches are stitched by small per-task summaries.  With a ``gap`` a session is
also split where nobody spoke for longer, the gap being given or calibrated from the data.

Defined results: a null sid is no conversation; a null line number is one line of its own;
null or blank messages are ignored after the checks on their times; a conversation is broken if
two rows of one line differ or a time cannot be read; equal times are ordered by line; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.spark import cut, small_rows

MAX_KINDS = 10_000
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?( ?(Z|z|[+-]\d{2}:?\d{2}))?)?$"
_OFFSET = r"(Z|z|[+-]\d{2}:?\d{2})$"
NO_GAP = 1 << 62


def read_time(text: Column) -> Column:
    """Microseconds since the epoch, or null: ISO (UTC without an offset) or 13 digits of milliseconds."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ",", "."), " ?([+-]\\d{2}):?(\\d{2})$", "$1:$2"), " ?[Zz]$", "+00:00")
    has_time = t.rlike(r"[T ]\d{2}:\d{2}")
    iso = F.when(has_time & ~t.rlike(_OFFSET), F.concat(iso, F.lit("+00:00"))).when(has_time, iso).otherwise(F.concat(t, F.lit("T00:00:00+00:00")))
    return F.when(t.rlike(r"^\d{13}$"), F.expr("1000") * t.try_cast("bigint")).when(t.rlike(_ISO), F.unix_micros(iso.try_cast("timestamp")))


def message_rows(events: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per (sid, line_no) of a speaker, with ``broken`` and ``blank`` marks.

    Two contradictory rows of a line need not be kept: the least and the greatest tell them apart.
    """
    speaker_of = {r.kind.strip().lower(): r.speaker for r in small_rows(kinds.where("kind IS NOT NULL AND speaker IS NOT NULL").select("kind", "speaker").distinct(), MAX_KINDS)}
    if not speaker_of:
        speaker_of = {"": None}
    pairs = F.create_map(*[F.lit(x).cast("string") for kv in sorted(speaker_of.items()) for x in kv])
    strip = F.lower(F.regexp_replace("event_type", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
    rows = events.where("sid IS NOT NULL").select(
        "sid",
        F.col("line_no").cast("long").alias("line_no"),
        F.element_at(pairs, strip).alias("speaker"),
        "event_ts",
        F.col("message").isNull().alias("no_message"),
        F.xxhash64("message").alias("h1"),
        F.hash("message").alias("h2"),
        F.coalesce(F.length("message"), F.lit(-1)).alias("size"),
        F.coalesce(F.col("message").rlike(r"^\p{IsWhite_Space}*$"), F.lit(True)).alias("blank"),
    )
    content = F.struct("speaker", "event_ts", "no_message", "h1", "h2", "size", "blank")
    one = rows.where("speaker IS NOT NULL").groupBy("sid", "line_no").agg(F.min(content).alias("a"), F.max(content).alias("b"))
    ts = read_time(F.col("a.event_ts"))
    return one.select("sid", "line_no", F.col("a.speaker").alias("speaker"), ts.alias("ts"), (~F.col("a").eqNullSafe(F.col("b")) | ts.isNull()).alias("broken"), F.col("a.blank").alias("blank"))


def _ordered(rows: DataFrame) -> DataFrame:
    keys = ["sid", F.col("ts").asc_nulls_first(), F.col("line_no").asc_nulls_first()]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seg", F.spark_partition_id())


def _number(ordered: DataFrame, gap: int) -> DataFrame:
    """Within each task: ``chunk`` counts the splits of a sid so far, ``pos`` the messages of a chunk;
    ``twice`` marks a user message right after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # sid, ts, speaker, chunk, pos
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sid, ts = batch.column("sid"), np.asarray(batch.column("ts"))
            user = np.asarray(pa.compute.equal(batch.column("speaker"), "user"))
            new = np.ones(n, dtype=bool)
            if n > 1:
                new[1:] = np.asarray(pa.compute.not_equal(sid.slice(1), sid.slice(0, n - 1)))
            split = np.zeros(n, dtype=bool)
            split[1:] = ~new[1:] & (ts[1:] - ts[:-1] > gap)
            before = np.zeros(n, dtype=bool)
            before[1:] = user[:-1]
            chunk0, pos0 = 0, 0
            if last and last[0] == sid[0].as_py():
                new[0] = False
                split[0] = ts[0] - last[1] > gap
                before[0] = last[2]
                chunk0, pos0 = last[3], last[4]
            starts = new | split
            i = np.arange(n)
            run_split = np.cumsum(split)
            at_new = np.maximum.accumulate(np.where(new, i, -1))
            chunk = np.where(at_new >= 0, run_split - run_split[at_new], run_split + chunk0)
            at = np.maximum.accumulate(np.where(starts, i, -1))
            pos = np.where(at >= 0, i - at, i + pos0)
            yield pa.RecordBatch.from_arrays(
                [sid, batch.column("line_no"), batch.column("speaker"), batch.column("ts"), batch.column("seg"), pa.array(chunk.astype(np.int64)), pa.array(pos.astype(np.int64)), pa.array(user & before & ~starts)],
                names=["sid", "line_no", "speaker", "ts", "seg", "chunk", "pos", "twice"],
            )
            last = (sid[n - 1].as_py(), ts[-1], bool(user[-1]), int(chunk[-1]), int(pos[-1]) + 1)

    schema = "sid string, line_no bigint, speaker string, ts bigint, seg int, chunk bigint, pos bigint, twice boolean"
    return ordered.select("sid", "line_no", "speaker", "ts", "seg").mapInArrow(run, schema)


def calibrate_gap(ordered: DataFrame) -> int:
    """Microseconds of silence that part two conversations: Otsu's threshold over log2 of all gaps.

    The histogram has at most 64 rows, whatever the input.
    """
    by = Window.partitionBy("seg", "sid").orderBy("ts", "line_no")
    gaps = ordered.select((F.col("ts") - F.lag("ts").over(by)).alias("g")).where("g > 0")
    hist = {r.b: r.n for r in gaps.groupBy(F.floor(F.log2("g")).alias("b")).agg(F.count("*").alias("n")).collect()}
    if len(hist) < 2:
        return NO_GAP
    bins = np.arange(min(hist), max(hist) + 1)
    w = np.array([hist.get(int(b), 0) for b in bins], dtype=float)
    low = np.cumsum(w)[:-1]
    mean_low = np.cumsum(w * bins)[:-1] / low
    high = w.sum() - low
    mean_high = ((w * bins).sum() - np.cumsum(w * bins)[:-1]) / np.maximum(high, 1e-9)
    return 1 << int(bins[int(np.argmax(low * high * (mean_low - mean_high) ** 2))] + 1)


def conversations(events: DataFrame, kinds: DataFrame, gap: int | str | None = None) -> DataFrame:
    """``sid``, ``conv_no``, ``turn_no``, ``speaker``, ``line_no`` of each message of a kept conversation.

    ``gap``: None keeps a sid together, a number splits it after so many microseconds of silence,
    "auto" takes :func:`calibrate_gap`.  A conversation is kept if it starts with the user and an
    assistant message comes right after each user message.
    """
    rows = message_rows(events, kinds)
    broken = rows.groupBy("sid").agg(F.max("broken").alias("broken")).where("broken").select("sid")
    # Both consumers below need the same stretches, and sampled range bounds are not repeatable.
    ordered = cut(_ordered(rows.where("NOT blank AND NOT broken").select("sid", "line_no", "speaker", "ts")))
    limit = calibrate_gap(ordered) if gap == "auto" else NO_GAP if gap is None else int(gap)
    numbered = _number(ordered, limit)

    pieces = numbered.groupBy("sid", "seg", "chunk").agg(
        F.count("*").alias("n"),
        F.min(F.struct("pos", "speaker"))["speaker"].alias("first"),
        F.max(F.struct("pos", "speaker"))["speaker"].alias("last"),
        F.min("ts").alias("from_ts"),
        F.max("ts").alias("to_ts"),
        F.max("twice").alias("twice"),
    )
    # A sid has at most one stretch per task, so these windows are as small as the number of tasks.
    stretch = pieces.groupBy("sid", "seg").agg(F.max("chunk").alias("splits"), F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"))
    by_seg = Window.partitionBy("sid").orderBy("seg")
    parted = F.coalesce((F.col("from_ts") - F.lag("to_ts").over(by_seg)) > F.lit(limit), F.lit(False)).cast("long")
    stretch = stretch.withColumn("step", parted + F.coalesce(F.lag("splits").over(by_seg), F.lit(0)))
    stretch = stretch.select("sid", "seg", F.sum("step").over(by_seg).alias("base"))
    pieces = pieces.join(stretch, ["sid", "seg"]).withColumn("conv_no", F.col("base") + F.col("chunk"))
    conv = Window.partitionBy("sid", "conv_no").orderBy("seg", "chunk")
    whole = Window.partitionBy("sid", "conv_no")
    before = F.lag("last").over(conv)
    fault = F.col("twice") | F.when(before.isNull(), F.col("first") != "user").otherwise((before == "user") & (F.col("first") == "user"))
    fault = fault | (F.lead("first").over(conv).isNull() & (F.col("last") != "assistant"))
    pieces = pieces.withColumn("fault", fault).withColumn("offset", F.sum("n").over(conv) - F.col("n"))
    kept = pieces.withColumn("bad", F.max("fault").over(whole)).where("NOT bad").select("sid", "seg", "chunk", "conv_no", "offset")
    kept = kept.join(broken, "sid", "left_anti")
    return numbered.join(kept, ["sid", "seg", "chunk"]).select(
        "sid", F.col("conv_no").cast("int").alias("conv_no"), (F.col("offset") + F.col("pos") + 1).cast("int").alias("turn_no"), "speaker", "line_no"
    )
