"""Queries over the session index and its events, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import vectors
from logweave.functions.spark import table
from logweave.operators import fuzzy, search, sessionize, snippets
from logweave.sources import logs, store

Q_EXACT, Q_NEAR, Q_FUZZY, Q_MARK = "retry queue", "rertry queue", "harborline", "done"
TODAY = "2026-07-15"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The decoded events table in the shape of :data:`logweave.schema.EVENTS`; ``event_id`` breaks ties of a line."""
    e = table(spark, d, "session_events")
    texts = F.when(F.col("message").isNotNull(), F.array("message")).otherwise(F.array().cast("array<string>"))
    return e.withColumn("texts", texts).withColumn("has_content", F.col("message").isNotNull()).withColumn("tool_results", F.coalesce("tool_results", F.array().cast("array<string>")))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first session that has a usable one."""
    s = table(spark, d, "sessions")
    fine = (F.size("embedding") == 384) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return s.where(F.col("embedding").isNotNull() & fine).orderBy("sid").select("embedding").first().embedding


def session_rollup(spark, d):
    return sessionize.sessionize(_events(spark, d), tie="event_id").select("sid", "created", "msg_count", "label", "branch", "project", "cwd")


def session_search_text(spark, d):
    return sessionize.sessionize(_events(spark, d), tie="event_id").select("sid", "search_text")


def exact_search(spark, d):
    return search.search_exact(table(spark, d, "sessions"), Q_EXACT).select("sid", "label")


def exact_search_top(spark, d):
    return search.search(table(spark, d, "sessions"), Q_EXACT, "exact", 25).select("sid", F.col("rank").cast("long").alias("rank"), "n_total")


def browse_sessions(spark, d):
    return search.browse(table(spark, d, "sessions")).select("sid", "modified", "label")


def near_variants(spark, d):
    q = spark.createDataFrame([(Q_NEAR,)], "q string")
    at = F.sequence(F.lit(1), F.length("q"))
    return q.select(F.explode(F.transform(at, lambda i: F.lower(F.overlay("q", F.lit(""), i, F.lit(1))))).alias("variant")).distinct()


def fuzzy_content_tiers(spark, d):
    s = table(spark, d, "sessions")
    return s.select("sid", search.content_tier(s, Q_NEAR).alias("score")).where("score IS NOT NULL")


def fuzzy_search(spark, d):
    return search.search_fuzzy(table(spark, d, "sessions"), Q_FUZZY).select("sid", "score", "label", "project")


def fuzzy_positions(spark, d):
    s = table(spark, d, "sessions").where("label IS NOT NULL")
    return s.select("sid", fuzzy.match_positions("label", F.lit("fix")).alias("positions")).where(F.size("positions") > 0)


def semantic_topk(spark, d):
    best = search.search_semantic(table(spark, d, "sessions"), _query_vector(spark, d))
    return best.select("sid", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def semantic_rank_join(spark, d):
    s = table(spark, d, "sessions")
    return search.rank_join(search.search_semantic(s, _query_vector(spark, d)), s).select("sid", "label", F.col("rank").cast("long").alias("rank"))


def semantic_text_search(spark, d):
    """The whole way from text: embed the sessions' labels, embed the query, rank."""
    s = table(spark, d, "sessions").where("label IS NOT NULL").select("sid", "label")
    embedded = vectors.embed_texts(s, "sid", "label")
    return search.search_semantic(embedded, vectors.HashingEmbedder()("the retry queue is fixed"), least=0.2).select("sid", "score", "rank")


def embedding_count(spark, d):
    return table(spark, d, "sessions").agg(F.count("embedding").alias("n"))


def pending_embeddings(spark, d):
    return store.pending(table(spark, d, "sessions"))


def vector_mean_pool(spark, d):
    pooled = vectors.mean_pool(table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("x"))


def vector_codec(spark, d):
    back = vectors.from_blob(vectors.to_blob("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(back).alias("dim", "x")).select("vec_id", "dim", F.col("x").cast("double").alias("x"))


def chunk_windows(spark, d):
    return vectors.chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", only_sampled=False)


def chunk_sampled(spark, d):
    return vectors.chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", most=8)


def embed_input_text(spark, d):
    return sessionize.embed_input(table(spark, d, "sessions"), _events(spark, d), tie="event_id")


def user_prompts_preview(spark, d):
    found = sessionize.prompts(_events(spark, d), 10, 200, 500, first_block=True, narrow=True, tie="event_id")
    return found.select("sid", F.array_join("prompts", " | ").alias("prompts"))


def match_contexts(spark, d):
    rows = search.search_exact(table(spark, d, "sessions"), Q_EXACT)
    return snippets.with_contexts(rows.select("sid", "search_text"), Q_EXACT).select("sid", "contexts")


def deep_contexts(spark, d):
    rows = search.search_fuzzy(table(spark, d, "sessions"), Q_NEAR, 10)
    return snippets.with_contexts(rows.select("sid", "search_text"), Q_NEAR).select("sid", "contexts")


def highlight_literal(spark, d):
    return table(spark, d, "sessions").where("label IS NOT NULL").select("sid", snippets.highlight(F.col("label"), Q_MARK).alias("marked"))


def relative_dates(spark, d):
    return table(spark, d, "sessions").select("sid", snippets.relative_date(F.col("modified"), F.to_date(F.lit(TODAY))).alias("shown"))


def display_dates(spark, d):
    return table(spark, d, "sessions").select("sid", snippets.display_date(F.col("created")).alias("shown"))


def text_forms(spark, d):
    """Label, project and cleaned text of single events."""
    e = table(spark, d, "session_events")
    return e.select(
        "event_id",
        sessionize.label_of(F.col("title"), F.col("message")).alias("label"),
        sessionize.project_of(F.col("cwd")).alias("project"),
        sessionize.strip_ansi(sessionize.one_line(F.col("message"))).alias("clean"),
    )


def list_lines(spark, d):
    return snippets.list_rows(table(spark, d, "sessions"), F.to_date(F.lit(TODAY)))


def search_report(spark, d):
    return snippets.report(search.search(table(spark, d, "sessions"), Q_EXACT, "exact", 10), Q_EXACT)


def session_preview(spark, d):
    found = sessionize.prompts(_events(spark, d), 10, 200, 500, first_block=True, narrow=True, tie="event_id")
    rows = search.search_exact(table(spark, d, "sessions"), Q_EXACT, 10)
    return snippets.preview(rows, found, Q_EXACT)


def _live(spark: SparkSession, d: str) -> DataFrame:
    """The newest present file of each session."""
    return store.newest_files(table(spark, d, "session_files").where("NOT gone AND mtime_epoch IS NOT NULL").select("sid", "path", "mtime_epoch"))


def sync_stale(spark, d):
    return store.stale(_live(spark, d), table(spark, d, "sessions").select("sid", "mtime_epoch")).select("sid", "path", "mtime_epoch")


def sync_prune(spark, d):
    return store.prune(table(spark, d, "sessions"), _live(spark, d)).select("sid", "mtime_epoch", "label")


def sync_upsert(spark, d):
    stored = table(spark, d, "sessions").select("sid", "mtime_epoch", "label", "embedding")
    new = store.stale(_live(spark, d), stored.select("sid", "mtime_epoch")).select("sid", "mtime_epoch", F.lit("new").alias("label"))
    return store.upsert(stored, new).select("sid", "mtime_epoch", "label", F.col("embedding").isNotNull().alias("embedded"))


def jsonl_events(spark, d):
    return logs.events(table(spark, d, "raw_lines"))


def jsonl_sessions(spark, d):
    lines = table(spark, d, "raw_lines")
    files = lines.groupBy("sid").agg(F.unix_seconds(F.max("mtime")).alias("mtime_epoch"))
    # A line that was delivered twice counts once.
    once = lines.groupBy("sid", "line_no", "value").agg(F.min("line_id").alias("line_id"))
    return sessionize.sessionize(logs.events(once), files)


QUERIES = {
    f.__name__: f
    for f in (
        session_rollup, session_search_text, exact_search, exact_search_top, browse_sessions, near_variants, fuzzy_content_tiers, fuzzy_search, fuzzy_positions, semantic_topk, semantic_rank_join,
        semantic_text_search, embedding_count, pending_embeddings, vector_mean_pool, vector_codec, chunk_windows, chunk_sampled, embed_input_text, user_prompts_preview, match_contexts, deep_contexts,
        highlight_literal, relative_dates, display_dates, text_forms, list_lines, search_report, session_preview, sync_stale, sync_prune, sync_upsert, jsonl_events, jsonl_sessions,
    )
}

_KEY = "line_no * 10000000000 + event_id"
_LABEL = "CASE WHEN length({0}) > 60 THEN left({0}, 60) || '…' ELSE {0} END"
_ONE_LINE = "replace(replace({0}, chr(10), ' '), chr(9), ' ')"
_PROJECT = r"coalesce(split_part(regexp_replace(coalesce({0}, ''), '/+$', ''), '/', -1), '')"
_FOLDED = f"""
folded AS (
  SELECT sid, count(*) FILTER (event_type IN ('user', 'assistant')) AS msg_count,
    arg_min(left(event_ts, 10), {_KEY}) FILTER (NOT oversized AND event_ts <> '') AS created,
    arg_min(branch, {_KEY}) FILTER (NOT oversized AND branch <> '' AND branch <> 'HEAD') AS branch,
    arg_min(cwd, {_KEY}) FILTER (NOT oversized AND cwd <> '') AS cwd,
    arg_min(message, {_KEY}) FILTER (NOT oversized AND event_type = 'user' AND message <> '' AND NOT starts_with(message, '<local-command')
      AND NOT starts_with(message, '<command-name>/exit')) AS prompt,
    arg_max(title, {_KEY}) FILTER (event_type = 'custom-title' AND title IS NOT NULL) AS title
  FROM session_events GROUP BY sid)"""
_VECTOR = """
q AS (
  SELECT embedding::DOUBLE[] AS qv FROM sessions
  WHERE embedding IS NOT NULL AND len(embedding) = 384 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
  ORDER BY sid LIMIT 1),
scored AS (
  SELECT sid, CASE WHEN len(embedding) = 0 THEN 0.0 ELSE
    list_inner_product(embedding[1:least(len(embedding), 384)]::DOUBLE[], qv[1:least(len(embedding), 384)]) END AS score
  FROM sessions, q WHERE embedding IS NOT NULL),
best AS (
  SELECT sid, score, row_number() OVER (ORDER BY score DESC, sid) AS rank FROM scored WHERE score > 0.5 AND NOT isnan(score))"""
_LIVE = """
live AS (
  SELECT sid, path, mtime_epoch FROM (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY mtime_epoch DESC, path DESC) AS rn FROM session_files WHERE NOT gone AND mtime_epoch IS NOT NULL) WHERE rn = 1),
stale AS (
  SELECT l.* FROM live l LEFT JOIN sessions s ON s.sid = l.sid WHERE s.sid IS NULL OR s.mtime_epoch < l.mtime_epoch)"""
_HIT = f"""(coalesce(contains(lower(label), '{Q_EXACT}'), false) OR coalesce(contains(lower(project), '{Q_EXACT}'), false)
  OR coalesce(contains(lower(branch), '{Q_EXACT}'), false) OR coalesce(contains(lower(search_text), '{Q_EXACT}'), false))"""
_DAY = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({0}, '%Y-%m-%d')::DATE END"
_VARIANTS = "(SELECT DISTINCT lower(substr(t, 1, i - 1) || substr(t, i + 1)) AS variant FROM (SELECT '" + Q_NEAR + "' AS t), range(1, " + str(len(Q_NEAR) + 1) + ") r(i))"

SQL = {
    "session_rollup": f"""
WITH {_FOLDED.strip()},
named AS (SELECT *, {_ONE_LINE.format("coalesce(nullif(title, ''), nullif(prompt, ''), 'untitled')")} AS l FROM folded WHERE msg_count > 0)
SELECT sid, coalesce(created, '') AS created, msg_count, {_LABEL.format("l")} AS label, coalesce(branch, '') AS branch, {_PROJECT.format("cwd")} AS project, coalesce(cwd, '') AS cwd FROM named""",
    "session_search_text": rf"""
WITH parts AS (
  SELECT sid, line_no, event_id, 0 AS place, left(message, 2000) AS part FROM session_events
  WHERE event_type IN ('user', 'assistant') AND NOT oversized AND message IS NOT NULL
  UNION ALL
  SELECT sid, line_no, event_id, r.i, tool_results[r.i] FROM session_events, range(1, 200) r(i)
  WHERE event_type IN ('user', 'assistant') AND NOT oversized AND r.i <= len(tool_results)),
joined AS (SELECT sid, string_agg(part, ' ' ORDER BY line_no, event_id, place) AS t FROM parts GROUP BY sid),
kept AS (SELECT sid FROM session_events WHERE event_type IN ('user', 'assistant') GROUP BY sid)
SELECT k.sid, regexp_replace({_ONE_LINE.format("coalesce(t, '')")}, '\x1b\[[0-9;]*m', '', 'g') AS search_text FROM kept k LEFT JOIN joined j ON j.sid = k.sid""",
    "exact_search": f"SELECT sid, label FROM sessions WHERE {_HIT}",
    "exact_search_top": f"""
SELECT sid, rank, n_total FROM (
  SELECT sid, row_number() OVER (ORDER BY modified DESC NULLS LAST, mtime_epoch DESC NULLS LAST, sid) AS rank, count(*) OVER () AS n_total FROM sessions WHERE {_HIT}) WHERE rank <= 25""",
    "browse_sessions": "SELECT sid, modified, label FROM sessions",
    "near_variants": f"SELECT variant FROM {_VARIANTS}",
    "fuzzy_content_tiers": f"""
SELECT sid, CASE WHEN contains(lower(search_text), '{Q_NEAR}') THEN 500 ELSE 400 END AS score FROM sessions
WHERE contains(lower(search_text), '{Q_NEAR}') OR EXISTS (SELECT 1 FROM {_VARIANTS} v WHERE contains(lower(search_text), v.variant))""",
    "semantic_topk": f"WITH {_VECTOR.strip()} SELECT sid, round(score, 5) AS score, rank FROM best WHERE rank <= 100",
    "semantic_rank_join": f"WITH {_VECTOR.strip()} SELECT s.sid, s.label, b.rank FROM best b JOIN sessions s ON s.sid = b.sid WHERE b.rank <= 100",
    "embedding_count": "SELECT count(embedding) AS n FROM sessions",
    "pending_embeddings": "SELECT sid, label FROM sessions WHERE embedding IS NULL AND strlen(label) >= 10",
    "vector_mean_pool": """
WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x FROM cells GROUP BY label, dim),
norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM means GROUP BY label)
SELECT m.label, m.dim::INT AS dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 5) AS x FROM means m JOIN norms USING (label)""",
    "vector_codec": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "embed_input_text": f"""
WITH said AS (
  SELECT sid, left(message, 500) AS t, row_number() OVER (PARTITION BY sid ORDER BY line_no, event_id) AS n FROM session_events
  WHERE event_type = 'user' AND NOT oversized AND message IS NOT NULL AND NOT starts_with(message, '<local-command') AND NOT starts_with(message, '<command-name>')),
firsts AS (SELECT sid, string_agg(t, ' ' ORDER BY n) AS p FROM said WHERE n <= 30 GROUP BY sid)
SELECT s.sid, s.label || coalesce(' ' || p, '') AS embed_text FROM sessions s LEFT JOIN firsts f ON f.sid = s.sid WHERE strlen(s.label) >= 10""",
    "user_prompts_preview": f"""
WITH said AS (
  SELECT sid, left({_ONE_LINE.format("message")}, 200) AS t, row_number() OVER (PARTITION BY sid ORDER BY line_no, event_id) AS n FROM session_events
  WHERE event_type = 'user' AND NOT oversized AND message <> '' AND line_no < 500 AND NOT starts_with(message, '<local-command') AND NOT starts_with(message, '<command-name>/exit'))
SELECT sid, string_agg(t, ' | ' ORDER BY n) AS prompts FROM said WHERE n <= 10 GROUP BY sid""",
    "highlight_literal": f"SELECT sid, regexp_replace(label, '{Q_MARK}', '**\\0**', 'gi') AS marked FROM sessions WHERE label IS NOT NULL",
    "relative_dates": f"""
WITH days AS (SELECT sid, modified, {_DAY.format("modified")} AS d FROM sessions),
apart AS (SELECT *, date_diff('day', d, DATE '{TODAY}') AS n FROM days)
SELECT sid, CASE WHEN d IS NULL THEN modified WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n BETWEEN 2 AND 6 THEN n || 'd ago' WHEN n BETWEEN 7 AND 13 THEN '1w ago'
  WHEN n BETWEEN 14 AND 29 THEN (n // 7) || 'w ago' ELSE strftime(d, '%b %d') END AS shown FROM apart""",
    "display_dates": f"SELECT sid, coalesce(strftime({_DAY.format('created')}, '%a %b %d'), created) AS shown FROM sessions",
    "text_forms": rf"""
WITH named AS (SELECT *, {_ONE_LINE.format("coalesce(nullif(title, ''), nullif(message, ''), 'untitled')")} AS l FROM session_events)
SELECT event_id, {_LABEL.format("l")} AS label, {_PROJECT.format("cwd")} AS project, regexp_replace({_ONE_LINE.format("message")}, '\x1b\[[0-9;]*m', '', 'g') AS clean FROM named""",
    "sync_stale": f"WITH {_LIVE.strip()} SELECT sid, path, mtime_epoch FROM stale",
    "sync_prune": f"WITH {_LIVE.strip()} SELECT sid, mtime_epoch, label FROM sessions WHERE sid IN (SELECT sid FROM live)",
    "sync_upsert": f"""
WITH {_LIVE.strip()}
SELECT sid, mtime_epoch, label, embedding IS NOT NULL AS embedded FROM sessions WHERE sid NOT IN (SELECT sid FROM stale)
UNION ALL SELECT sid, mtime_epoch, 'new', false FROM stale""",
}
