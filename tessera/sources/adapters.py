"""The supplied tables as the engine's: documents as notes and chunks, embeddings as vectors, orders as links, events as changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

NOW_MS = 1_706_659_200_000  # 2024-01-31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path(source="source", doc_id="doc_id"):
    return F.concat(F.col(source), F.lit("/"), F.lpad(F.col(doc_id).cast("string"), 8, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, chunk_index 0, content): each document as one chunk."""
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 2000, overlap: int = 100) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(doc_path().alias("path"), "text")
    return text.chunk_windows(rows, "text", None, size, overlap).select("path", "chunk_index", "content")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, title, description, tags, tier, mtime, body_vec, desc_vec, vec): vectors by id."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lines = F.split("text", "\n")
    second = F.try_element_at(lines, F.lit(2))
    rows = docs.select(
        "doc_id", doc_path().alias("path"), F.substring(lines[0], 1, 40).alias("title"), F.when(F.length(second) >= 10, second).alias("description"),
        F.array("lang").alias("tags"), F.when(F.col("doc_id") % 3 == 0, "cold").otherwise("hot").alias("tier"), (F.lit(NOW_MS) - F.col("doc_id") * 3_600_000).alias("mtime"),
    )
    joined = rows.join(vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("body_vec")), "doc_id", "left").drop("doc_id")
    return joined.withColumn("desc_vec", F.lit(None).cast("array<float>")).withColumn("vec", F.col("body_vec"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, title, tier, label, vec): one note for each vector, in the folder of its label."""
    rows = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("/"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    return rows.select(path.alias("path"), F.concat(F.lit("note "), F.col("vec_id").cast("string")).alias("title"), F.when(F.col("vec_id") % 2 == 0, "cold").otherwise("hot").alias("tier"), "label", "vec_id", F.col("embedding").alias("vec"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): orders link to the parts of their lines, by number."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
