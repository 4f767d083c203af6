"""The hybrid search: a keyword leg, a vector leg and a fuzzy title leg, fused by rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.functions.ranking import global_rank
from tessera.functions.udfs import SNIPPET, build_snippet, jaro_winkler_to
from tessera.operators import bm25, fusion
from tessera.sources.scratch import stored

WEIGHTS = {"bm25": 1.0, "semantic": 1.0, "fuzzy": 0.5}
CHUNK_PENALTY = 0.02
FUZZY_MIN = 0.7


def candidate_pool(top_results: int) -> int:
    return min(500, max(50, top_results * 5))


def keyword_leg(scores: DataFrame, pool: int) -> DataFrame:
    """The best 2 * pool documents pooled to notes, at most pool of them: (path, score, chunk_index, real_chunk, rank)."""
    best = bm25.pool_notes(bm25.top(scores, 2 * pool)).orderBy(F.desc("score"), "path").limit(pool)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def semantic_scores(chunks: DataFrame, query: list[float]) -> DataFrame:
    """(path, score, chunk_index, chunks) over chunk vectors of the query's length: each note's best cosine, less a penalty for its number of
    chunks. The query's vector is a literal: no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.filter(F.col("vec").isNotNull() & (F.size("vec") == len(query)))
    rows = rows.select("path", "chunk_index", vector.cosine(F.col("vec"), q).alias("cos")).filter("NOT isnan(cos)")
    best = rows.groupBy("path").agg(
        F.max("cos").alias("cos"), F.max_by("chunk_index", F.struct("cos", -F.col("chunk_index"))).alias("chunk_index"), F.count(F.lit(1)).alias("chunks")
    )
    return best.select("path", (F.col("cos") - CHUNK_PENALTY * F.log("chunks")).alias("score"), "chunk_index", "chunks")


def fuzzy_titles(notes: DataFrame, query: str, limit: int, least: float = FUZZY_MIN) -> DataFrame:
    """(path, title, score): the titles most like the query."""
    scored = notes.filter("title IS NOT NULL").select("path", "title", jaro_winkler_to(query)("title").alias("score"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "path").limit(limit)


def verbatim_hits(notes: DataFrame, candidates: DataFrame, query: str) -> DataFrame:
    """(path, chunk_index): notes whose title begins with the phrase, that have it as a heading or (quoted) in a candidate chunk; the first
    chunk that shows it, null for a title."""
    parsed = text.parse_verbatim_query(query)
    if parsed is None:
        return notes.select("path", F.lit(None).cast("int").alias("chunk_index")).limit(0)
    phrase, quoted = parsed
    test = text.contains_phrase(F.col("content"), phrase) if quoted else text.has_heading_line(F.col("content"), phrase)
    shown = candidates.filter(test).groupBy("path").agg(F.min("chunk_index").alias("chunk_index"))
    titled = notes.filter(text.title_starts_with(F.col("title"), phrase)).select("path", F.lit(None).cast("int").alias("chunk_index"))
    return shown.unionByName(titled).groupBy("path").agg(F.min("chunk_index").alias("chunk_index"))


def hybrid_search(
    notes: DataFrame, chunks: DataFrame, query: str, query_vec: list[float] | None = None, synonyms: dict[str, list[str]] | None = None, weights: dict[str, float] | None = None,
    top_results: int = 10, scope: str = "all", live: DataFrame | None = None, snippets: bool = True, scores: DataFrame | None = None,
) -> DataFrame:
    """(position, path, title, score, tier, snippet) of the best notes. Without a query vector the search is by keywords and titles. scores may
    bring keyword scores from an index; else they are counted in one pass over the chunks."""
    weights = WEIGHTS | (weights or {})
    query = query.strip()
    expanded = text.expand_query(query, synonyms)
    pool = candidate_pool(top_results)
    docs = bm25.corpus(chunks, notes)
    leg = keyword_leg(bm25.score_text(docs, expanded) if scores is None else scores, pool)
    leg = stored(leg, "leg")
    legs = [(leg.select("path", "rank"), weights["bm25"])]
    semantic = None
    if query_vec is not None:
        semantic = stored(semantic_scores(chunks, query_vec), "semantic")  # one short row for each note, read by the ranks, the fusion and the snippets
        semantic = global_rank(semantic, "score", "path")
        legs.append((semantic.select("path", "rank"), weights["semantic"]))
    legs.append((fusion.rank_map(fuzzy_titles(notes, query, pool)), weights["fuzzy"]))
    fused = fusion.fuse(legs)
    candidates = _bodies(chunks, notes, leg.select("path"))
    exact = verbatim_hits(notes, candidates, query)
    fused = fusion.boost(fused, exact)
    best = fusion.top_n(fused, min(300, top_results * 3))
    rows = notes.select("path", "title", F.coalesce(F.col("tier"), F.lit("hot")).alias("tier"), "description").join(F.broadcast(best), "path")
    if live is not None:
        rows = rows.join(live.select("path").distinct(), "path", "left_semi")
    if scope != "all":
        rows = rows.filter(F.col("tier") == scope)
    rows = rows.orderBy(F.desc("fused"), "path").limit(top_results)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fused"), "path")))
    rows = stored(rows, "rows")
    if not snippets:
        return rows.select("position", "path", "title", F.col("fused").alias("score"), "tier")
    return _with_snippets(rows, chunks, leg, semantic, exact, query, expanded, weights)


def _bodies(chunks: DataFrame, notes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, chunk_index, content) of the chunks of a few notes, without the title that chunking put before them."""
    titles = notes.join(F.broadcast(paths), "path", "left_semi").select("path", "title")
    rows = chunks.join(F.broadcast(titles), "path").select("path", "chunk_index", text.strip_chunk_prefix(F.col("content"), F.col("title")).alias("content"))
    return rows


def _with_snippets(
    rows: DataFrame, chunks: DataFrame, leg: DataFrame, semantic: DataFrame | None, exact: DataFrame, phrase: str, query: str, weights: dict[str, float]
) -> DataFrame:
    """Snippets for the few rows that are left."""
    tokens = [r[0] for r in rows.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(text.query_tokens(F.col("q")))).collect()]
    own = leg.select("path", F.col("rank").alias("kw_rank"), "real_chunk")
    out = rows.join(own, "path", "left")
    if semantic is not None:
        out = out.join(semantic.select("path", F.col("rank").alias("sem_rank"), F.col("chunk_index").alias("sem_chunk"), "chunks"), "path", "left")
    else:
        out = out.selectExpr("*", "CAST(NULL AS INT) sem_rank", "CAST(NULL AS INT) sem_chunk", "CAST(NULL AS BIGINT) chunks")
    out = out.join(exact.withColumnRenamed("chunk_index", "exact_chunk"), "path", "left")
    body = stored(_bodies(chunks, rows, rows.select("path")), "bodies")
    parsed = text.parse_verbatim_query(phrase)
    told = parsed[0] if parsed else None
    take = lambda name: body.select("path", F.col("chunk_index").alias(name), F.col("content").alias(f"{name}_text"))
    out = out.join(take("real_chunk"), ["path", "real_chunk"], "left").join(take("sem_chunk"), ["path", "sem_chunk"], "left").join(take("exact_chunk"), ["path", "exact_chunk"], "left")
    pair = (weights["bm25"], weights["semantic"])

    @F.pandas_udf(SNIPPET)
    def make(kw_rank: pd.Series, sem_rank: pd.Series, kw: pd.Series, kw_text: pd.Series, desc: pd.Series, sem: pd.Series, sem_text: pd.Series, count: pd.Series, at: pd.Series, at_text: pd.Series) -> pd.DataFrame:
        made = []
        for r in zip(kw_rank, sem_rank, kw, kw_text, desc, sem, sem_text, count, at, at_text, strict=True):
            a, b, c, d, e, f, g, n, i, j = (None if pd.isna(x) else x for x in r)
            hit = (int(c), d) if d is not None else None
            near = (int(f), g) if g is not None else None
            shown = (int(i), j, told) if told and j is not None else None
            made.append(build_snippet(tokens, a and int(a), b and int(b), hit, e, near, pair, count=n and int(n), verbatim=shown) or dict.fromkeys(SNIPPET.names))
        return pd.DataFrame(made, columns=SNIPPET.names)

    made = make("kw_rank", "sem_rank", "real_chunk", "real_chunk_text", "description", "sem_chunk", "sem_chunk_text", "chunks", "exact_chunk", "exact_chunk_text")
    return out.withColumn("snippet", made).withColumn("snippet", F.when(F.col("snippet.text").isNotNull(), F.col("snippet"))).select(
        "position", "path", "title", F.col("fused").alias("score"), "tier", "snippet"
    )


def search(notes: DataFrame, chunks: DataFrame, query, scope: str = "all", **options) -> DataFrame:
    """The scripting entry: checks its input."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query must be a non-empty string")
    if scope not in ("hot", "cold", "all"):
        raise ValueError("the scope must be hot, cold or all")
    return hybrid_search(notes, chunks, query, scope=scope, **options)


def keyword_ranks(docs: DataFrame, query: str, exclude: str | None = None, pool: int = fusion.KW_POOL) -> DataFrame:
    """(path, rank): notes in the order of their first hit among the best documents; empty for a blank query."""
    spark = docs.sparkSession
    if not query.strip():
        return spark.createDataFrame([], "path string, rank int")
    hits = bm25.top(bm25.score_text(docs, query), pool)
    hits = hits.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "path", "chunk_index")))
    skip = spark.createDataFrame([(exclude,)], "path string") if exclude is not None else None
    return fusion.first_seen_ranks(hits, skip)
