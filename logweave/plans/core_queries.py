"""Queries of the core problems (2, 4, 7) and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.functions.spark import table
from logweave.operators.incremental import sync_plan
from logweave.operators.nested import flatten_blocks
from logweave.operators.reject import Kinds, loaded, rejected, split_records


def _kinds(spark: SparkSession, d: str) -> Kinds:
    return Kinds.of(table(spark, d, "event_kinds"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = flatten_blocks(table(spark, d, "raw_lines"), _kinds(spark, d), with_text=False)
    return blocks.select("line_id", "node_path", "parent_path", "block_type")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """The parent table of the blocks: one row per sound line."""
    return loaded(split_records(table(spark, d, "raw_lines"), _kinds(spark, d)))


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The child table with the text of each block."""
    return flatten_blocks(table(spark, d, "raw_lines"), _kinds(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sync_plan(table(spark, d, "sessions"), table(spark, d, "session_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(split_records(table(spark, d, "raw_lines"), _kinds(spark, d))).select("line_id", "reason")


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    """Loaded and failed lines together, with the position of the fault."""
    return split_records(table(spark, d, "raw_lines"), _kinds(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_lines, p2_blocks, p4_found, p7_found, p7_split)}

SQL = {
    "p4_found": """
WITH last AS (
  SELECT sid, gone, CASE WHEN mtime_epoch > 100000000000 THEN mtime_epoch // 1000 ELSE mtime_epoch END AS epoch
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, file_id DESC) AS rn FROM session_files)
  WHERE rn = 1),
found AS (
  SELECT sid, max(CASE WHEN NOT gone THEN epoch END) AS t, bool_or(NOT gone) AS live FROM last GROUP BY sid),
stored AS (
  SELECT sid, modified, CASE WHEN mtime_epoch > 100000000000 THEN mtime_epoch // 1000 ELSE mtime_epoch END AS m FROM sessions),
both_sides AS (
  SELECT coalesce(s.sid, f.sid) AS sid, s.sid IS NOT NULL AS known, s.m, s.modified, f.t, f.live
  FROM stored s FULL OUTER JOIN found f ON s.sid = f.sid),
judged AS (
  SELECT sid, CASE
    WHEN NOT known AND t IS NOT NULL THEN 'insert'
    WHEN known AND NOT live THEN 'delete'
    WHEN known AND t IS NOT NULL AND m < t THEN 'update'
    WHEN known AND t IS NOT NULL AND m IS NULL AND (modified IS NULL OR modified = ''
         OR try_strptime(modified, '%Y-%m-%d')::DATE < make_timestamp(t * 1000000)::DATE) THEN 'update' END AS sync_action
  FROM both_sides)
SELECT sid, sync_action FROM judged WHERE sync_action IS NOT NULL""",
}
