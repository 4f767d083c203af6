"""Density clusters of result vectors, and tables of contents grouped by them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SAMPLES = 2


def size_gate(n: int) -> str:
    """Whether a table of contents over n notes is made: block, ok or warn."""
    return "block" if n < 5 or n > 100 else "ok" if n <= 50 else "warn"


def size_gate_col(n: Column) -> Column:
    return F.when((n < 5) | (n > 100), "block").when(n <= 50, "ok").otherwise("warn")


def min_cluster_size(n: int) -> int:
    return 2 if n < 40 else 3 if n < 100 else 4


def hdbscan(points: np.ndarray, min_size: int, min_samples: int = MIN_SAMPLES) -> np.ndarray:
    """Cluster labels from 0, -1 for noise: single linkage over mutual reachability distances, condensed to clusters of min_size or more, the
    most stable ones selected. The root is no cluster."""
    n = len(points)
    labels = np.full(n, -1, dtype=np.int64)
    if n < max(2, min_size):
        return labels
    square = (points**2).sum(axis=1)
    dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0.0))
    core = np.sort(dist, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
    # Prim's minimum spanning tree.
    done, near, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64), []
    at = 0
    for _ in range(n - 1):
        done[at] = True
        closer = ~done & (reach[at] < near)
        near[closer], via[closer] = reach[at][closer], at
        nxt = int(np.where(done, np.inf, near).argmin())
        edges.append((near[nxt], int(via[nxt]), nxt))
        at = nxt
    # Merge tree: node n + i joins two others at a distance.
    edges.sort()
    parent, tree, sizes = list(range(n)), [], [1] * n
    top = {i: i for i in range(n)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, a, b in edges:
        ra, rb = find(a), find(b)
        tree.append((top[ra], top[rb], d))
        parent[rb] = ra
        top[ra] = n + len(tree) - 1
        sizes.append(sizes[tree[-1][0]] + sizes[tree[-1][1]])

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += tree[x - n][:2]
        return out

    clusters: list[dict] = [{"node": len(sizes) - 1, "birth": 0.0, "stability": 0.0, "children": [], "falls": []}]
    stack = [(0, len(sizes) - 1)]
    while stack:
        c, node = stack.pop()
        if node < n:
            clusters[c]["falls"].append((node, np.inf))
            continue
        left, right, d = tree[node - n]
        rate = 1 / d if d > 0 else 1e12
        big = [x for x in (left, right) if sizes[x] >= min_size]
        clusters[c]["stability"] += (rate - clusters[c]["birth"]) * sum(sizes[x] for x in (left, right) if len(big) == 2 or sizes[x] < min_size)
        if len(big) == 2:
            for x in (left, right):
                clusters.append({"node": x, "birth": rate, "stability": 0.0, "children": [], "falls": []})
                clusters[c]["children"].append(len(clusters) - 1)
                stack.append((len(clusters) - 1, x))
        elif big:
            stack.append((c, big[0]))
    chosen: set[int] = set()

    def settle(c: int) -> float:
        below = sum(settle(x) for x in clusters[c]["children"])
        if c and (not clusters[c]["children"] or clusters[c]["stability"] >= below):
            drop = list(clusters[c]["children"])
            while drop:
                x = drop.pop()
                chosen.discard(x)
                drop += clusters[x]["children"]
            chosen.add(c)
            return clusters[c]["stability"]
        return below

    settle(0)
    for label, c in enumerate(sorted(chosen, key=lambda c: min(leaves(clusters[c]["node"])))):
        labels[leaves(clusters[c]["node"])] = label
    return labels


def cluster_vectors(rows: DataFrame, key: str = "path", vec: str = "vec") -> DataFrame:
    """rows with label (-1: noise). One group in one task: a search's results; more than the size gate lets through (100) are refused."""
    if rows.limit(101).count() > 100:
        raise ValueError("a table of contents is made of at most 100 notes")
    names = rows.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key).reset_index(drop=True)
        points = np.stack(part[vec].to_numpy()).astype(np.float64) if len(part) else np.zeros((0, 1))
        return part.assign(label=hdbscan(points, min_cluster_size(len(part))))[[*names, "label"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", label long"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


def is_flat(labels: set[int]) -> bool:
    """With at most one cluster a flat list serves better."""
    return len(labels - {-1}) <= 1


def grouped_contents(clustered: DataFrame) -> DataFrame:
    """(label, title, notes, lines): one section for each cluster, noise last, notes by score; the title is the best note's."""
    item = F.struct((-F.col("score")).alias("s"), "path", "title", "tier")
    by = clustered.groupBy("label").agg(F.array_sort(F.collect_list(item)).alias("items"))
    line = lambda x: F.concat(F.lit("- [["), F.regexp_replace(x["path"], r"\.md$", ""), F.lit("|"), x["title"], F.lit("]]"), F.when(x["tier"] == "cold", " ❄").otherwise(""))
    title = F.when(F.col("label") == -1, "Miscellaneous").otherwise(F.col("items")[0]["title"])
    out = by.select("label", title.alias("title"), F.size("items").cast("long").alias("notes"), F.array_join(F.transform("items", line), "\n").alias("lines"))
    return out.orderBy(F.col("label") == -1, "label")


def render_contents(sections: DataFrame, query: str) -> DataFrame:
    """One row (markdown) of all sections in order."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("lines"), F.lit("\n"))
    ordered = sections.agg(F.array_sort(F.collect_list(F.struct((F.col("label") == -1).alias("last"), "label", part.alias("t")))).alias("x"))
    return ordered.select(F.concat(F.lit(f"# {query}\n\n"), F.array_join(F.transform("x", lambda s: s["t"]), "\n")).alias("markdown"))


def contents(clustered: DataFrame, query: str, name_topic: Callable[[list[str]], str] | None = None) -> DataFrame:
    """One row (markdown): sections by cluster, named by a language model where there is one (titles to name; a failure leaves the best note's title), or
    the flat list where there is one cluster at most."""
    sections = grouped_contents(clustered).collect()  # at most 50: the gate bounds the notes
    if is_flat({r.label for r in sections}):
        return flat_contents(clustered)
    named = []
    for r in sections:
        title = r.title
        if name_topic is not None and r.label != -1:
            try:
                title = name_topic(re.findall(r"\|(.*?)\]\]", r.lines)).strip() or title
            except (OSError, ValueError):  # no network, or no usable answer
                pass
        named.append((r.label, title, r.notes, r.lines))
    return render_contents(clustered.sparkSession.createDataFrame(named, "label long, title string, notes long, lines string"), query)


def flat_contents(results: DataFrame) -> DataFrame:
    """One row (markdown): hot notes, then cold ones, each by score."""
    line = F.concat(F.lit("- "), F.lit("[["), F.regexp_replace("path", r"\.md$", ""), F.lit("]]"))
    by = results.groupBy("tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    part = F.concat(F.when(F.col("tier") == "hot", "## Hot\n\n").otherwise("## Cold\n\n"), F.col("lines"), F.lit("\n"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("tier") != "hot").alias("o"), part.alias("t")))), lambda x: x["t"]), "\n").alias("markdown"))
