"""Ranked retrieval over the sessions table: exact, fuzzy and semantic, and their dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import schema as S
from logweave.functions.vectors import dot
from logweave.operators import fuzzy

FIELDS = ("label", "project", "branch", "search_text")


def recency() -> list[Column]:
    """Newest day first, then newest second, then id: a total order."""
    return [F.desc_nulls_last("modified"), F.desc_nulls_last("mtime_epoch"), F.asc("sid")]


def with_lower(sessions: DataFrame) -> DataFrame:
    """Adds lower-case copies of the searched fields, so that a stored table can push substring filters down."""
    return sessions.withColumns({f"{c}_lc": F.lower(c) for c in FIELDS})


def _lc(df: DataFrame, c: str) -> Column:
    return F.col(f"{c}_lc") if f"{c}_lc" in df.columns else F.lower(c)


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Materialises the order as ``rank``, for results that were limited or are small."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def exact_matches(sessions: DataFrame, query: str) -> DataFrame:
    """Rows that hold the query, case aside, in one of four fields; unordered."""
    q = query.lower()
    hit = F.lit(False)
    for c in FIELDS:
        hit = hit | F.coalesce(F.contains(_lc(sessions, c), F.lit(q)), F.lit(False))
    return sessions.where(hit)


def search_exact(sessions: DataFrame, query: str, n: int | None = None) -> DataFrame:
    found = exact_matches(sessions, query).orderBy(*recency())
    return found if n is None else found.limit(n)


def browse(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(*recency())


def deletion_variants(query: str) -> list[str]:
    """The query with one character left out, for queries that are long enough; in order of the character."""
    return [(query[:i] + query[i + 1 :]).lower() for i in range(len(query))] if len(query) >= S.NEAR_CHARS else []


def content_tier(sessions: DataFrame, query: str) -> Column:
    """500 for the query in the text, 400 for a variant with one character left out, else null."""
    text = _lc(sessions, "search_text")
    tier = F.when(F.contains(text, F.lit(query.lower())), 500)
    variants = sorted(set(deletion_variants(query)))
    if variants:
        near = F.lit(False)
        for v in variants:
            near = near | F.contains(text, F.lit(v))
        tier = tier.when(near, 400)
    return tier


def haystack() -> Column:
    return F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("project", F.lit("")), F.coalesce("branch", F.lit("")))


def fuzzy_scored(sessions: DataFrame, query: str, scoring: S.FuzzyScoring | None = None) -> DataFrame:
    """Rows with ``score``: 1000 and more by label, project and branch, else 500 or 400 by content.

    Candidates of the label tier go through the Arrow scorer, all other rows stay native.
    """
    short = haystack()
    candidates = sessions.withColumn("maybe", fuzzy.may_match(short, query))
    label_score = fuzzy.scorer(query, scoring)
    a = candidates.where("maybe").withColumn("label_score", label_score(short))
    a = a.withColumn("score", F.when(F.col("label_score").isNotNull(), F.col("label_score") + 1000).otherwise(content_tier(sessions, query))).drop("label_score")
    b = candidates.where("NOT maybe").withColumn("score", content_tier(sessions, query))
    return a.unionByName(b).drop("maybe").where("score IS NOT NULL")


def search_fuzzy(sessions: DataFrame, query: str, n: int | None = None, scoring: S.FuzzyScoring | None = None) -> DataFrame:
    found = fuzzy_scored(sessions, query, scoring).orderBy(F.desc("score"), *recency())
    return found if n is None else found.limit(n)


def semantic_scores(vectors: DataFrame, query: list[float], id_col: str = "sid", vec_col: str = "embedding", least: float = S.SEMANTIC_LEAST) -> DataFrame:
    """``id_col``, ``score`` above the threshold; vectors of another length count up to the shorter one."""
    score = dot(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query]))
    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, score.alias("score"))
    return rows.where((F.col("score") > least) & ~F.isnan("score"))


def search_semantic(vectors: DataFrame, query: list[float], id_col: str = "sid", vec_col: str = "embedding", least: float = S.SEMANTIC_LEAST, top: int = S.SEMANTIC_TOP) -> DataFrame:
    """The best rows with ``rank``; a per-partition heap, not a full sort."""
    best = semantic_scores(vectors, query, id_col, vec_col, least).orderBy(F.desc("score"), id_col).limit(top)
    return ranked(best, [F.desc("score"), F.asc(id_col)])


def rank_join(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hits with their session rows in the hits' order; hits without a session drop out."""
    return sessions.join(hits.select("sid", "score", "rank"), "sid").orderBy("rank")


def search(sessions: DataFrame, query: str, mode: str | S.SearchMode = "fuzzy", n: int = 10, embed=None) -> DataFrame:
    """Dispatch by mode: the first ``n`` rows, and ``n_total`` of all matches."""
    kind = S.SearchMode.of(mode)
    if kind is S.SearchMode.EXACT:
        found, order = exact_matches(sessions, query), recency()
    elif kind is S.SearchMode.SEMANTIC:
        if embed is None:
            raise ValueError("semantic search needs an embedder")
        found, order = rank_join(search_semantic(sessions, embed(query)), sessions), [F.asc("rank")]
    else:
        found, order = fuzzy_scored(sessions, query), [F.desc("score"), *recency()]
    total = found.agg(F.count("*").alias("n_total"))
    top = found.orderBy(*order).limit(n)
    return ranked(top.drop("rank"), order if kind is not S.SearchMode.SEMANTIC else [F.desc("score"), F.asc("sid")]).join(F.broadcast(total)).orderBy("rank")
