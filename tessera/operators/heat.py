"""Activity tiers from links and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_MS = 2000
DAY_MS = 86_400_000


def derive_tier(created: Column, mtime: Column, outgoing: Column, incoming: Column, self_write: Column, now_ms: int, hot_days: int = 90) -> Column:
    """hot with a link in or out; else by age of the later of creation and change, where a change that was our own write counts as none."""
    own = self_write.isNotNull() & (F.abs(mtime - self_write) <= TOLERANCE_MS)
    latest = F.greatest(F.coalesce(created, F.lit(0)), F.when(own, 0).otherwise(F.coalesce(mtime, F.lit(0))))
    linked = F.coalesce(outgoing, F.lit(False)) | F.coalesce(incoming, F.lit(False))
    return F.when(linked | (F.lit(now_ms) - latest < hot_days * DAY_MS), "hot").otherwise("cold")


def incoming(links: DataFrame) -> DataFrame:
    """(path): notes that another note links to."""
    return links.filter("src != dst").select(F.col("dst").alias("path")).distinct()


def outgoing(links: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(path): notes with a link to another note, or with an unresolved one."""
    own = links.filter("src != dst").select(F.col("src").alias("path"))
    return (own if unresolved is None else own.unionByName(unresolved.select(F.col("src").alias("path")))).distinct()


def resolve_tiers(
    notes: DataFrame, links: DataFrame, now_ms: int, hot_days: int = 90, unresolved: DataFrame | None = None, self_writes: DataFrame | None = None, live: DataFrame | None = None
) -> DataFrame:
    """notes (path, created, mtime, ...) with tier. A note that isn't live is hot, so that a ghost is never promoted."""
    out = notes.drop("tier").join(outgoing(links, unresolved).withColumn("_out", F.lit(True)), "path", "left")
    out = out.join(incoming(links).withColumn("_in", F.lit(True)), "path", "left")
    out = out.join(self_writes.select("path", F.col("mtime").alias("_own")), "path", "left") if self_writes is not None else out.withColumn("_own", F.lit(None).cast("long"))
    tier = derive_tier(F.col("created"), F.col("mtime"), F.col("_out"), F.col("_in"), F.col("_own"), now_ms, hot_days)
    if live is not None:
        out = out.join(live.select("path").distinct().withColumn("_live", F.lit(True)), "path", "left")
        tier = F.when(F.col("_live").isNull(), "hot").otherwise(tier)
    return out.withColumn("tier", tier).drop("_out", "_in", "_own", "_live")


def resolve_created(frontmatter: Column, ctime: Column) -> Column:
    """Epoch milliseconds of a frontmatter date if it can be read (a date, a time, or a number), else of the file."""
    stamp = F.coalesce(F.try_to_timestamp(frontmatter), F.try_to_timestamp(frontmatter, F.lit("yyyy-MM-dd")))
    number = F.when(frontmatter.rlike(r"^[0-9]{9,}$"), frontmatter.try_cast("long"))
    return F.coalesce(number, F.unix_millis(stamp), ctime)


def tier_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def prune_self_writes(ledger: DataFrame, now_ms: int, hot_days: int = 90) -> DataFrame:
    return ledger.filter(F.lit(now_ms) - F.col("mtime") < hot_days * DAY_MS)
