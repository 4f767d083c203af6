"""Dismissed pairs and notes: filters before a cut, and upkeep when notes are renamed or deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of a pair in canonical order."""
    return F.least(a, b), F.greatest(a, b)


def pair_key(a: Column, b: Column, joint: str = "\u0000") -> Column:
    return F.concat_ws(joint, *pair(a, b))


def drop_pairs(results: DataFrame, anchor: str, dismissed: DataFrame) -> DataFrame:
    """Results (path, ...) without those dismissed (a, b) for the anchor."""
    other = F.when(F.col("a") == anchor, F.col("b")).when(F.col("b") == anchor, F.col("a"))
    return results.join(dismissed.select(other.alias("path")).filter("path IS NOT NULL").distinct(), "path", "left_anti")


def drop_notes(results: DataFrame, dismissed: DataFrame) -> DataFrame:
    return results.join(dismissed.select("path").distinct(), "path", "left_anti")


def renamed(path: Column, old: str, new: str) -> Column:
    """The path after a note or a folder was renamed."""
    inside = F.startswith(path, F.lit(old + "/"))
    return F.when(path == old, new).when(inside, F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def rename_pairs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """(a, b, dismissed_at) after a rename; pairs that fall together keep the earliest time, pairs with themselves go."""
    x, y = renamed(F.col("a"), old, new), renamed(F.col("b"), old, new)
    out = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "dismissed_at").filter("a != b")
    return out.groupBy("a", "b").agg(F.min("dismissed_at").alias("dismissed_at"))


def rename_notes(notes: DataFrame, old: str, new: str) -> DataFrame:
    return notes.select(renamed(F.col("path"), old, new).alias("path"), "dismissed_at").groupBy("path").agg(F.min("dismissed_at").alias("dismissed_at"))


def _under(path: Column, gone: str) -> Column:
    return (path == gone) | F.startswith(path, F.lit(gone + "/"))


def delete_pairs(pairs: DataFrame, gone: str) -> DataFrame:
    return pairs.filter(~_under(F.col("a"), gone) & ~_under(F.col("b"), gone))


def delete_notes(notes: DataFrame, gone: str) -> DataFrame:
    return notes.filter(~_under(F.col("path"), gone))
