"""Queries of the text problems (1, 3, 5, 6, 8, 9, 10) and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.functions.spark import table
from logweave.llm.bpe import build_lexicon, encode_texts
from logweave.llm.conversations import conversations
from logweave.llm.knn import neighbour_pairs
from logweave.llm.packing import pack_texts
from logweave.llm.pii import find_pii, redact_pii
from logweave.llm.secrets import find_secrets, redact_secrets
from logweave.llm.subjects import composition, subjects_of


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "sessions"), table(spark, d, "name_parts")).select("sid", "field_name", "pii_kind", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_pii(table(spark, d, "sessions"), table(spark, d, "name_parts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_secrets(table(spark, d, "sessions")).select("sid", "start_pos")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_secrets(table(spark, d, "sessions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "session_events"), table(spark, d, "event_kinds")).select("sid", "turn_no", "speaker", "line_no")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    """The same, split at the silence that the data itself suggest."""
    return conversations(table(spark, d, "session_events"), table(spark, d, "event_kinds"), gap="auto")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(table(spark, d, "sessions"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents")
    return encode_texts(texts, lexicon=build_lexicon(texts))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects_of(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(_subjects(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_redacted, p5_found, p5_split, p6_found, p8_ids, p9_containers, p10_found, p10_composition)}

SQL = {
    "p5_found": r"""
WITH said AS (
  SELECT e.sid, e.line_no, k.speaker, e.message, e.event_ts, trim(e.event_ts) AS t
  FROM session_events e JOIN event_kinds k ON k.kind = lower(trim(e.event_type)) AND k.speaker IS NOT NULL),
timed AS (
  SELECT sid, line_no, speaker, message, event_ts,
    CASE WHEN regexp_full_match(t, '\d{13}') THEN make_timestamp(t::BIGINT * 1000)
         WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d+)?([Zz]|[+-]\d{2}:\d{2})?')
         THEN TRY_CAST(CASE WHEN regexp_matches(t, '([Zz]|[+-]\d{2}:\d{2})$') THEN t ELSE t || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS ts
  FROM said),
lines AS (
  SELECT sid, line_no, any_value(speaker) AS speaker, any_value(ts) AS ts, any_value(message) AS message,
    count(DISTINCT {'s': speaker, 'm': coalesce('x' || message, ''), 'e': coalesce('x' || event_ts, '')}) > 1 OR bool_or(ts IS NULL) AS broken
  FROM timed GROUP BY sid, line_no),
fine AS (
  SELECT * FROM lines WHERE sid NOT IN (SELECT sid FROM lines WHERE broken)
    AND message IS NOT NULL AND NOT regexp_full_match(message, '[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\v]*')),
turns AS (
  SELECT sid, row_number() OVER w AS turn_no, speaker, line_no, lead(speaker) OVER w AS next_one
  FROM fine WINDOW w AS (PARTITION BY sid ORDER BY ts, line_no)),
bad AS (
  SELECT sid FROM turns GROUP BY sid
  HAVING bool_or((turn_no = 1 AND speaker <> 'user') OR (speaker = 'user' AND (next_one IS NULL OR next_one <> 'assistant'))))
SELECT sid, turn_no, speaker, line_no FROM turns WHERE sid NOT IN (SELECT sid FROM bad)""",    "p6_found": """
WITH good AS (
  SELECT sid, embedding::DOUBLE[384] AS v FROM sessions
  WHERE embedding IS NOT NULL AND len(embedding) = 384 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
near AS (
  SELECT a.sid AS x, b.sid AS y, row_number() OVER (PARTITION BY a.sid ORDER BY array_cosine_similarity(a.v, b.v) DESC, b.sid) AS rn
  FROM good a JOIN good b ON a.sid <> b.sid)
SELECT DISTINCT least(x, y) AS sid_a, greatest(x, y) AS sid_b FROM near WHERE rn <= 5""",
}
