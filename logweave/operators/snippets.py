"""Contexts of matches, highlighting, dates for display, list rows and previews."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions.vectors import snap_left, snap_right
from logweave.operators.search import deletion_variants


def contexts(text: str, query: str, most: int) -> list[str]:
    """Up to ``most`` places where the query occurs, case aside, with some bytes of text on both sides.

    Matches do not overlap.  Positions are found in the lower-case text and carried back to the
    original by character, so letters whose lower case is longer or shorter do no harm.
    """
    if not query or not text:
        return []
    lower, back = [], []
    for i, c in enumerate(text):
        for x in c.lower():
            lower.append(x)
            back.append(i)
    low, q = "".join(lower), query.lower()
    data, out, at = text.encode(), [], 0
    byte_at = None
    while len(out) < most and (i := low.find(q, at)) >= 0:
        if byte_at is None:
            byte_at = [0]
            for c in text:
                byte_at.append(byte_at[-1] + len(c.encode()))
        first, last = byte_at[back[i]], byte_at[back[i + len(q) - 1] + 1]
        a, b = snap_left(data, max(0, first - S.CONTEXT_BYTES)), snap_right(data, last + S.CONTEXT_BYTES)
        piece = data[a:b].decode().replace("\n", " ").replace("\t", " ").strip()
        out.append(("…" if a else "") + piece + ("…" if b < len(data) else ""))
        at = i + len(q)
    return out


def deep_contexts(text: str, query: str, most: int) -> list[str]:
    """Contexts of the query, or else of its first variant with one character left out that has any."""
    found = contexts(text, query, most)
    for variant in [] if found else deletion_variants(query):
        found = contexts(text, variant, most)
        if found:
            break
    return found


def with_contexts(rows: DataFrame, query: str, most: int = 3, text_col: str = "search_text", deep: bool = True) -> DataFrame:
    """Adds ``contexts``; meant for rows that a limit has already made few, but right for any number."""
    find = deep_contexts if deep else contexts

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find(t or "", query, most))

    return rows.withColumn("contexts", run(text_col))


def highlight(text: Column, query: str, before: str = "**", after: str = "**") -> Column:
    """Marks every occurrence of a literal query, case aside."""
    if not query:
        return text
    pattern = "(?iu)" + "".join("\\" + c if re.match(r"[^\w\s]", c) and c.isascii() else c for c in query)
    return F.regexp_replace(text, pattern, f"{before}$0{after}")


def parsed_day(day: Column) -> Column:
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def display_date(day: Column) -> Column:
    """Like "Sat Mar 15"; what is no date stays as it is."""
    return F.coalesce(F.date_format(parsed_day(day), "EEE MMM dd"), day)


def relative_date(day: Column, today: Column) -> Column:
    """Distance in days or weeks up to four weeks back, else month and day."""
    d = parsed_day(day)
    n = F.date_diff(today, d)
    text = (
        F.when(n == 0, "today")
        .when(n == 1, "yesterday")
        .when(n.between(2, 6), F.concat(n.cast("string"), F.lit("d ago")))
        .when(n.between(7, 13), "1w ago")
        .when(n.between(14, 29), F.concat(F.floor(n / 7).cast("string"), F.lit("w ago")))
        .otherwise(F.date_format(d, "MMM dd"))
    )
    return F.when(d.isNull(), day).otherwise(text)


def list_rows(sessions: DataFrame, today: Column) -> DataFrame:
    """``sid`` and a line of fixed columns: date (9), project (14), label."""
    date = F.rpad(relative_date(F.coalesce("modified", F.lit("")), today), 9, " ")
    project = F.rpad(F.left(F.coalesce("project", F.lit("")), F.lit(14)), 14, " ")
    return sessions.select("sid", F.concat_ws("  ", date, project, F.coalesce("label", F.lit(""))).alias("line"))


def report(rows: DataFrame, query: str) -> DataFrame:
    """One text block per hit (``rank``, ``block``): dates, messages, project, label, marked contexts, id."""
    marked = F.transform("contexts", lambda c: F.concat(F.lit("    "), highlight(c, query)))
    head = F.concat(F.lit("  "), display_date(F.col("created")), F.lit(" → "), display_date(F.col("modified")), F.lit("  "), F.lpad(F.col("msg_count").cast("string"), 4, " "), F.lit(" msgs  "), F.col("project"))
    lines = F.concat(F.array(head, F.concat(F.lit("  "), "label")), marked, F.array(F.concat(F.lit("  Session ID: "), "sid")))
    return with_contexts(rows, query).select("rank", F.array_join(lines, "\n").alias("block"))


def preview(sessions: DataFrame, prompts: DataFrame, query: str, most: int = 6) -> DataFrame:
    """``sid``, ``meta``, ``branch``, ``cwd``, ``contexts``, ``prompts`` (the label where there are none)."""
    rows = with_contexts(sessions, query, most)
    meta = F.concat_ws("  ", display_date(F.col("created")), display_date(F.col("modified")), F.concat(F.col("msg_count").cast("string"), F.lit(" msgs")), F.col("project"))
    rows = rows.join(prompts, "sid", "left")
    return rows.select("sid", meta.alias("meta"), "branch", "cwd", "contexts", F.coalesce("prompts", F.array("label")).alias("prompts"))
