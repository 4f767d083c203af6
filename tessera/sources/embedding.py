"""Embedding providers, run in batches on the executors; a deterministic one for tests and offline use."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text, udfs, vector
from tessera.functions.udfs import token_chunks
from tessera.operators import index
from tessera.sources.scratch import stored

BATCH = 8


class Provider(Protocol):
    """What an embedding model offers."""

    model_id: str
    dimension: int
    chunk_policy: str | None

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def count_tokens(self, value: str) -> int: ...


class HashingProvider:
    """Vectors from hashed words: no model, the same everywhere."""

    model_id, chunk_policy = "hashing-64", None

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    def count_tokens(self, value: str) -> int:
        return len(re.findall(r"\w+|[^\w\s]", value))


class HttpProvider:
    """A server with an embeddings endpoint; answers are put in the order of their index. Needs a network."""

    chunk_policy = None

    def __init__(self, url: str, model: str, dimension: int, key: str | None = None, timeout: float = 60.0):
        self.url, self.model_id, self.dimension, self.key, self.timeout = url, model, dimension, key, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model_id, "input": texts}).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        vectors = found["embeddings"] if "embeddings" in found else [x["embedding"] for x in sorted(found["data"], key=lambda x: x["index"])]
        if len(vectors) != len(texts) or any(len(v) != self.dimension for v in vectors):
            raise ValueError("the server returned vectors of another number or dimension")
        return vectors

    def count_tokens(self, value: str) -> int:
        return max(1, len(value) // 4)


def embed(rows: DataFrame, provider: Provider, content: str = "content", out: str = "vec", simplify: tuple[str, str] | None = None) -> DataFrame:
    """rows with a vector of each text, cleaned first; the text itself stays raw. Null for texts that cleaning leaves empty."""
    clean = rows.withColumn("_clean", text.denoise(text.simplify_for_embedding(F.col(content), simplify)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, vectors = part["_clean"].tolist(), [None] * len(part)
            real = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(real), BATCH):
                now = real[at : at + BATCH]
                for i, v in zip(now, provider.embed([texts[i] for i in now]), strict=True):
                    vectors[i] = v
            yield part.drop(columns="_clean").assign(**{out: vectors})

    return clean.mapInPandas(run, schema)


def cut_chunks(notes: DataFrame, provider: Provider, size: int = 2000, overlap: int = 100) -> DataFrame:
    """(path, chunk_index, content) of notes (path, title, body): by the tokens of a provider that has a chunk policy (named tokens-overlap, as in
    512-50), else by characters."""
    if provider.chunk_policy is None:
        return text.chunk_windows(notes.select("path", "title", "body"), "body", "title", size, overlap).select("path", "chunk_index", "content")
    tokens, shared = (int(x) for x in re.findall(r"\d+", provider.chunk_policy)[-2:])
    split = token_chunks(provider.count_tokens, tokens=tokens, overlap=shared, window=size)
    return notes.filter("body IS NOT NULL").select("path", F.posexplode(split("body", "title")).alias("chunk_index", "content"))


def index_notes(notes: DataFrame, provider: Provider, size: int = 2000, overlap: int = 100, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Note and chunk rows of notes (path, mtime, created, title, description, tags, tier, body): chunks with vectors, their mean as the
    note's, and the description's (empty where there is nothing to embed). Every text is embedded once: what is stored and what is pooled are the
    same vectors."""
    chunks = stored(embed(cut_chunks(notes, provider, size, overlap), provider), "chunks")
    pooled = vector.mean_pool(chunks, "path", "vec", weight_unit=True).withColumnRenamed("vec", "body_vec")
    described = stored(embed(notes.filter(F.length("description") >= 10).select("path", "description"), provider, "description", "desc_vec"), "described")
    described = described.select("path", F.coalesce("desc_vec", F.array().cast("array<float>")).alias("desc_vec"))
    rows = notes.drop("body").join(pooled, "path", "left").join(described, "path", "left")
    return rows.withColumn("folder", text.folder_of(F.col("path"))).withColumn("body_dim", F.size("body_vec")).withColumn("indexed_at", F.lit(now_ms)), chunks


def map_json(rows: DataFrame, ask: Callable[[str], str], prompt: str, out: str, parse: Callable[[str], dict], schema: str) -> DataFrame:
    """rows with a struct parsed from a language model's answer to each prompt, and error: what went wrong where the call or the answer did (the struct is
    null then). Other exceptions are programming errors and end the job."""
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} {schema}, error string"

    def one(value: str):
        try:
            return parse(ask(value)), None
        except (OSError, ValueError) as failure:  # the network, or an answer that can't be read
            return None, f"{type(failure).__name__}: {failure}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [one(x) for x in part[prompt]]
            yield part.assign(**{out: [x for x, _ in made], "error": [e for _, e in made]})

    return rows.mapInPandas(run, full)


def describe(notes: DataFrame, contents: DataFrame, ask: Callable[[str], str], instruction: str = "Describe this note in one or two sentences, as JSON with description and tags.\n\n") -> DataFrame:
    """(path, expected, description, tags, error) of notes that need a description: each one's text, without addresses and cut to a budget, is the prompt, and the
    answer's reasoning goes. expected is what the note had, for compare and set."""
    due = index.eligible_for_description(notes).select("path", F.col("description").alias("expected"))
    rows = due.join(contents.select("path", "content"), "path")
    rows = rows.select("path", "expected", F.concat(F.lit(instruction), udfs.sample_spread_col(text.strip_urls(F.col("content")))).alias("prompt"))
    made = map_json(rows, ask, "prompt", "made", lambda x: udfs.parse_generated(udfs.strip_reasoning(x)), "struct<description:string,tags:array<string>>")
    trimmed = udfs.trim_description_col(F.col("made.description"))
    return made.select("path", "expected", F.nullif(trimmed, F.lit("")).alias("description"), F.col("made.tags").alias("tags"), "error")
