"""Markdown files as a table of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text


def read_notes(spark: SparkSession, folder: str, excluded: list[str] = (), config: str = ".obsidian") -> DataFrame:
    """(path, mtime, content): one row for each .md file below a folder whose path has none of the excluded strings and isn't in the app's own folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    root = folder.rstrip("/").split("://")[-1]
    name = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^[a-z]+:/*", "/")
    rows = files.select(F.regexp_replace(name, f"^/*{root.strip('/')}/", "").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    for part in excluded:
        if part:
            rows = rows.filter(~F.contains("path", F.lit(part)))
    return rows.filter(~F.startswith("path", F.lit(f"{config}/"))) if config else rows


def parse_notes(files: DataFrame, cap: int | None = None) -> DataFrame:
    """(path, mtime, ctime, frontmatter_title, description, tags, created, h1, body) of files (path, mtime, content, perhaps ctime). Bodies are whole, unless a
    cap in characters is given."""
    head = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1), r"""^["']|["']$""", ""), F.lit(""))
    inline = F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"^\[|\]$", "")
    listed = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]*-.*(?:\n|$))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1))
    body = text.strip_frontmatter(F.col("content"))
    body = body if cap is None else F.substring(body, 1, cap)
    ctime = F.col("ctime") if "ctime" in files.columns else F.lit(None)
    return files.select(
        "path", "mtime", ctime.cast("long").alias("ctime"), field("title").alias("frontmatter_title"), field("description").alias("description"),
        F.when(F.size(listed) > 0, listed).otherwise(text.parse_tags(inline)).alias("tags"), field("created").alias("created"), text.first_h1(body).alias("h1"), body.alias("body"),
    )


def resolve_links(links: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst, n) by target name as links by path, and those without a target. Rule: a name is a path, with or without its ending, or the end of one;
    of several notes that end so, one in the linking note's folder comes first, then the shorter path, then the smaller."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\.md$", ""))
    parts = F.split(bare(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    known = notes.select(F.col("path").alias("target"), F.explode(ends).alias("name"))
    named = links.withColumn("name", bare(F.regexp_replace(F.trim("dst"), "^/+", "")))
    found = named.join(known, "name", "left")
    order = F.struct(text.folder_of(F.col("target")) != text.folder_of(F.col("src")), F.length("target"), F.col("target"))
    best = found.groupBy("src", "dst", "n").agg(F.min_by("target", order).alias("target"))
    resolved = best.filter("target IS NOT NULL").groupBy("src", F.col("target").alias("dst")).agg(F.sum("n").alias("n"))
    return resolved, best.filter("target IS NULL").select("src", "dst", "n")


def links_of(files: DataFrame) -> DataFrame:
    """(src, dst, n): wikilinks by target name, as often as a note has them."""
    found = F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1))
    return files.select(F.col("path").alias("src"), F.explode(found).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
