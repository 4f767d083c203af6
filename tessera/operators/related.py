"""Notes like a given note, and forgotten notes near the recent ones, by composed vectors re-ranked with keyword ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.functions.ranking import global_rank
from tessera.operators import dismissals, fusion
from tessera.operators.index import finite

PROFILE, TAG_SHARE, GROUP_POOL, GROUP_TAKE = 20, 0.05, 20, 3


def cosine_ranked(notes: DataFrame, anchor: str, min_score: float = 0.5, live: DataFrame | None = None) -> DataFrame:
    """(path, title, tier, score, cos_rank) of the notes near the anchor. notes: (path, title, tier, vec), unit vectors. Only the anchor's row is
    broadcast; rows of another dimension, unreal scores and the anchor itself are left out."""
    own = notes.filter(F.col("path") == anchor).select(F.col("vec").alias("_q")).limit(1)
    rows = notes.filter(F.col("path") != anchor).crossJoin(F.broadcast(own)).filter(F.size("vec") == F.size("_q"))
    rows = rows.withColumn("score", vector.dot(F.col("vec"), F.col("_q"))).filter(finite(F.col("score"), min_score)).drop("vec", "_q")
    if live is not None:
        rows = rows.join(live.select("path").distinct(), "path", "left_semi")
    return global_rank(rows, "score", "path", "cos_rank")


def dimension_mismatches(notes: DataFrame, dim: int) -> DataFrame:
    return notes.filter(F.col("vec").isNotNull() & (F.size("vec") != dim)).agg(F.count(F.lit(1)).alias("n"))


def discover(notes: DataFrame, anchor: str, keyword: DataFrame, min_score: float = 0.5, top_results: int = 10, dismissed: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """Related notes, without the folder cap: (position, path, title, tier, score); the score is the cosine, the order is fused."""
    return _finish(_fused(notes, anchor, keyword, min_score, dismissed, live), top_results)


def _fused(notes, anchor, keyword, min_score, dismissed, live) -> DataFrame:
    ranked = fusion.order_pool(fusion.fuse_keyword_ranks(cosine_ranked(notes, anchor, min_score, live), keyword))
    return ranked if dismissed is None else dismissals.drop_pairs(ranked, anchor, dismissed)


def _finish(rows: DataFrame, top_results: int) -> DataFrame:
    best = rows.orderBy("position").limit(top_results)
    return best.select(F.row_number().over(Window.orderBy("position")).alias("position"), "path", "title", "tier", "score")


def cap_folder(rows: DataFrame, folder: str, cap: int) -> DataFrame:
    """Rows (path, position) with at most cap of the anchor's folder; later rows fill the places."""
    same = text.folder_of(F.col("path")) == folder
    numbered = rows.withColumn("_same", same).withColumn("_nth", F.row_number().over(Window.partitionBy("_same").orderBy("position")))
    return numbered.filter(~F.col("_same") | (F.col("_nth") <= cap)).drop("_same", "_nth")


def find_similar(
    notes: DataFrame, anchor: str, keyword: DataFrame, min_score: float = 0.5, top_results: int = 10, same_folder_cap: int = 3, dismissed: DataFrame | None = None, live: DataFrame | None = None
) -> DataFrame:
    """As discover, with at most same_folder_cap results from the anchor's own folder (0: no cap)."""
    rows = _fused(notes, anchor, keyword, min_score, dismissed, live)
    if same_folder_cap > 0:
        rows = cap_folder(rows, anchor.rpartition("/")[0], same_folder_cap)
    return _finish(rows, top_results)


def tag_counts(notes: DataFrame) -> DataFrame:
    """(tag, n): notes with each tag, counted once a note, without # and case."""
    keys = F.array_distinct(F.transform("tags", lambda t: F.lower(F.regexp_replace(t, "^#", ""))))
    return notes.select(F.explode(keys).alias("tag")).filter("tag != ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def topical_tags(counts: DataFrame, total: int, share: float = TAG_SHARE) -> DataFrame:
    """Tags that at most this share of all notes has."""
    return counts.filter(F.col("n") <= share * total)


def build_profile(candidates: DataFrame, tag_frequency: DataFrame, total: int, k: int = PROFILE) -> DataFrame:
    """(position, path, tags) of the k notes judged last that aren't exempt and have a topical tag; without any, of the k judged last, with no tags.
    candidates: (path, judged_at, tags, exempt)."""
    eligible = candidates.filter("NOT exempt")
    topical = topical_tags(tag_frequency, total).select("tag")
    common = tag_frequency.join(topical, "tag", "left_anti").select("tag")
    tags = eligible.select("path", F.explode(F.array_distinct("tags")).alias("tag")).join(common, "tag", "left_anti")
    tags = tags.groupBy("path").agg(F.array_sort(F.collect_list("tag")).alias("topical"))
    order = [F.desc("judged_at"), "path"]
    with_tags = eligible.select("path", "judged_at").join(tags, "path").orderBy(*order).limit(k).cache()
    plain = eligible.select("path", "judged_at", F.array().cast("array<string>").alias("topical")).orderBy(*order).limit(k)
    chosen = plain if with_tags.isEmpty() else with_tags
    return chosen.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "path", F.col("topical").alias("tags"))


def grouped_rank(cold: DataFrame, centroid: DataFrame, keyword: DataFrame, min_score: float = 0.5, pool: int = GROUP_POOL, take: int = GROUP_TAKE) -> DataFrame:
    """(group_position, grp, position, path, score): for each top-level folder the best few of its nearest notes, folders by their best score.
    Windows are by folder; a folder's rows are cut to the pool before anything else."""
    rows = cold.crossJoin(F.broadcast(centroid.select(F.col(centroid.columns[0]).alias("_c")))).filter(F.size("vec") == F.size("_c"))
    rows = rows.withColumn("score", vector.dot(F.col("vec"), F.col("_c"))).filter(finite(F.col("score"), min_score))
    rows = rows.select("path", "score", text.group_of(F.col("path")).alias("grp"))
    near = rows.withColumn("cos_rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "path"))).filter(F.col("cos_rank") <= pool)
    fused = fusion.fuse_keyword_ranks(near, keyword)
    taken = fused.withColumn("position", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("fused"), "cos_rank"))).filter(F.col("position") <= take)
    best = taken.withColumn("best", F.max("score").over(Window.partitionBy("grp")))
    numbered = best.withColumn("group_position", F.dense_rank().over(Window.orderBy(F.desc("best"), "grp")))
    return numbered.select("group_position", "grp", "position", "path", "score")


def global_discover(
    notes: DataFrame, docs: DataFrame, candidates: DataFrame, min_score: float = 0.5, dismissed: DataFrame | None = None, k: int = PROFILE
) -> DataFrame:
    """Cold notes near the profile of the recent ones, grouped by folder. notes: (path, title, tier, vec, tags)."""
    from tessera.operators.search import keyword_ranks

    profile = build_profile(candidates, tag_counts(notes), notes.count(), k).cache()
    centroid = vector.centroid(notes.join(F.broadcast(profile.select("path")), "path", "left_semi").select("vec"), "vec")
    words = [r[0] for r in profile.select(F.explode("tags")).collect()]
    keyword = keyword_ranks(docs, " ".join(words))
    cold = notes.filter("tier = 'cold' AND vec IS NOT NULL")
    if dismissed is not None:
        cold = dismissals.drop_notes(cold, dismissed)
    return grouped_rank(cold, centroid, keyword, min_score)
