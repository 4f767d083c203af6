"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranking import global_rank

K = 60
FUSION_POOL = 100
KW_POOL = 500


def share(rank, weight: float = 1.0, k: int = K):
    return F.lit(weight) / (F.lit(k) + rank)


def rank_map(scores: DataFrame, key: str = "path", value: str = "score") -> DataFrame:
    """(key, rank) from 1 by descending value, ties by key."""
    return global_rank(scores.select(key, value), value, key).select(key, "rank")


def fuse(legs: list[tuple[DataFrame, float]], key: str = "path", k: int = K) -> DataFrame:
    """(key, fused): the sum over legs (key, rank) of weight / (k + rank); a leg that lacks a key adds nothing."""
    parts = None
    for ranks, weight in legs:
        one = ranks.select(key, share(F.col("rank"), weight, k).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.sum("part").alias("fused"))


def boost(fused: DataFrame, hits: DataFrame, key: str = "path", k: int = K) -> DataFrame:
    """Adds 1 / (k + 1) once for each hit; hits that were not fused enter with that."""
    extra = hits.select(key).distinct().withColumn("fused", F.lit(1.0) / (k + 1))
    return fused.unionByName(extra).groupBy(key).agg(F.sum("fused").alias("fused"))


def top_n(fused: DataFrame, n: int, key: str = "path") -> DataFrame:
    return fused.orderBy(F.desc("fused"), key).limit(n)


def fuse_keyword_ranks(ranked: DataFrame, keyword: DataFrame, key: str = "path", k: int = K) -> DataFrame:
    """ranked (key, cos_rank, ...) re-ranked with keyword ranks (key, rank): adds fused; a missing rank adds nothing."""
    joined = ranked.join(keyword.select(key, F.col("rank").alias("kw_rank")), key, "left")
    return joined.withColumn("fused", share(F.col("cos_rank"), 1.0, k) + F.coalesce(share(F.col("kw_rank"), 1.0, k), F.lit(0.0)))


def order_pool(fused: DataFrame, pool: int = FUSION_POOL) -> DataFrame:
    """Adds position: the first pool by cosine re-ranked, the rest after them in cosine order, which is their rank."""
    head = fused.filter(F.col("cos_rank") <= pool)
    head = head.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fused"), "cos_rank")))
    return head.unionByName(fused.filter(F.col("cos_rank") > pool).withColumn("position", F.col("cos_rank")))


def first_seen_ranks(hits: DataFrame, exclude: DataFrame | None = None, key: str = "path") -> DataFrame:
    """(key, rank) from hits (key, position): keys in the order of their first hit, without the excluded, numbered contiguously."""
    first = hits.groupBy(key).agg(F.min("position").alias("position"))
    if exclude is not None:
        first = first.join(F.broadcast(exclude), key, "left_anti")
    return first.select(key, F.row_number().over(Window.orderBy("position", key)).alias("rank"))
