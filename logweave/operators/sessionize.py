"""Events folded into one row per session.

Everything but the search text is a first or last value by (line, tie) and combines on the map
side.  The search text needs the parts of a session together; they are capped per part, and the
list is sorted by (line, tie, place), never taken in arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import schema as S


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\t", "  ")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")


def label_of(title: Column, prompt: Column) -> Column:
    """Custom title, else first prompt, else a fixed word; one line, cut with an ellipsis."""
    c = one_line(F.coalesce(F.nullif(title, F.lit("")), F.nullif(prompt, F.lit("")), F.lit(S.UNTITLED)))
    return F.when(F.length(c) > S.LABEL_CHARS, F.concat(F.left(c, F.lit(S.LABEL_CHARS)), F.lit("…"))).otherwise(c)


def project_of(cwd: Column) -> Column:
    """Last component of a path, trailing slashes aside."""
    return F.substring_index(F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", ""), "/", -1)


def is_command(text: Column, narrow: bool) -> Column:
    return text.startswith("<local-command") | text.startswith("<command-name>/exit" if narrow else "<command-name>")


def sessionize(events: DataFrame, files: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """One row per session with at least one user or assistant message.

    ``files`` (``sid``, ``mtime_epoch``) gives ``modified``; without it the three columns of time are
    null or come from the events alone.  ``tie`` orders events of the same line.
    """
    at = F.struct("line_no", *([tie] if tie else []))
    is_message = F.col("event_type").isin("user", "assistant")
    normal = ~F.coalesce("oversized", F.lit(False))

    def first(c: Column, on: Column) -> Column:
        return F.min_by(F.when(on, c), F.when(on, at))

    text = F.get("texts", F.lit(0))
    parts = F.concat(F.transform("texts", lambda x: F.left(x, F.lit(S.TEXT_CHARS))), F.col("tool_results"))
    rows = events.select(
        "sid", at.alias("at"), "event_type", "event_ts", "branch", "cwd", "title", "texts", "tool_results", "oversized", "line_no", *([tie] if tie else [])
    )
    prompt = (F.col("event_type") == "user") & normal & (text != "") & ~is_command(text, narrow=True)
    grouped = rows.groupBy("sid").agg(
        F.count_if(is_message).alias("msg_count"),
        first(F.left("event_ts", F.lit(10)), normal & (F.col("event_ts") != "")).alias("created"),
        first(F.col("branch"), normal & (F.col("branch") != "") & (F.col("branch") != "HEAD")).alias("branch"),
        first(F.col("cwd"), normal & (F.col("cwd") != "")).alias("cwd"),
        first(text, prompt).alias("prompt"),
        F.max_by(F.when((F.col("event_type") == "custom-title") & F.col("title").isNotNull(), F.col("title")), F.when((F.col("event_type") == "custom-title") & F.col("title").isNotNull(), at)).alias("title"),
        F.array_sort(F.collect_list(F.when(is_message & normal & (F.size(parts) > 0), F.struct(at.alias("at"), parts.alias("parts"))))).alias("parts"),
    )
    grouped = grouped.where("msg_count > 0")
    text_all = F.array_join(F.flatten(F.transform("parts", lambda p: p["parts"])), " ")
    out = grouped.select(
        "sid",
        F.coalesce("created", F.lit("")).alias("created"),
        F.col("msg_count").cast("long").alias("msg_count"),
        label_of(F.col("title"), F.col("prompt")).alias("label"),
        F.coalesce("branch", F.lit("")).alias("branch"),
        project_of(F.col("cwd")).alias("project"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        strip_ansi(one_line(text_all)).alias("search_text"),
    )
    if files is None:
        return out
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("mtime_epoch") / 86400).cast("int")), "yyyy-MM-dd")
    out = out.join(files.select("sid", "mtime_epoch"), "sid").withColumn("modified", F.coalesce(day, F.lit("")))
    return out.withColumn("created", F.coalesce(F.nullif("created", F.lit("")), "modified")).select(*S.SESSION_COLUMNS)


def prompts(events: DataFrame, most: int, chars: int, lines: int | None, first_block: bool, narrow: bool, tie: str | None = None) -> DataFrame:
    """``sid``, ``prompts``: the first user prompts of each session, in order.

    ``first_block`` takes the first text block, else all blocks joined by a space; ``narrow`` leaves
    out only the exit command; ``lines`` stops after so many lines of the file.
    """
    text = F.coalesce(F.get("texts", F.lit(0)), F.lit("")) if first_block else F.array_join("texts", " ")
    rows = events.where((F.col("event_type") == "user") & ~F.coalesce("oversized", F.lit(False)) & F.coalesce("has_content", F.lit(True)))
    rows = rows.select("sid", "line_no", *([tie] if tie else []), text.alias("text"))
    rows = rows.where(~is_command(F.col("text"), narrow))
    if first_block:
        rows = rows.where("text <> ''").withColumn("text", one_line(F.col("text")))
    if lines is not None:
        rows = rows.where(F.col("line_no") < lines)
    order = Window.partitionBy("sid").orderBy("line_no", *([tie] if tie else []))
    rows = rows.select("sid", F.left("text", F.lit(chars)).alias("text"), F.row_number().over(order).alias("n")).where(F.col("n") <= most)
    return rows.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p")).select("sid", F.transform("p", lambda p: p["text"]).alias("prompts"))


def embed_input(sessions: DataFrame, events: DataFrame, tie: str | None = None) -> DataFrame:
    """``sid``, ``embed_text`` of sessions whose label is long enough: the label and the first prompts."""
    found = prompts(events, S.EMBED_PROMPTS, S.EMBED_PROMPT_CHARS, None, first_block=False, narrow=False, tie=tie)
    rows = sessions.where(F.octet_length("label") >= S.EMBED_LABEL_BYTES).select("sid", "label").join(found, "sid", "left")
    return rows.select("sid", F.array_join(F.concat(F.array("label"), F.coalesce("prompts", F.array().cast("array<string>"))), " ").alias("embed_text"))
