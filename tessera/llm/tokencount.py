"""Token counts by a two-tier lookup on the map side, without a shuffle of pre-tokens.

First tier: a broadcast table of the token counts of frequent pre-tokens. Each task counts the pre-tokens of its
texts in a bounded counter (lossy counting over all its rows; those above ``LONGEST`` characters aren't candidates) and
hands on its ``TASK_PIECES`` best; the ``table_size`` best of their sums make the table. Second tier: a pre-token that
the table lacks is encoded once and remembered in the worker's bounded cache. The table only saves time: a
count never depends on it.

Cases: a null text is the empty text, with no tokens. A special token's string inside a text is one token, as
the library treats it by default. Repeated rows give repeated results; an empty table gives an empty result;
columns besides the id and the text are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import PairCache
from tessera.llm.common import CACHES, claim, small_batches

#: The split of the byte-level pre-tokenizer (a fixed value of the vocabulary file's format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE = 32_768
TASK_PIECES = 4_096
COUNTER = 100_000
LONGEST = 32


class PieceCounter:
    """Token counts of pre-tokens and texts, by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
        if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("only byte-level BPE files without a normalizer are understood")
        special = [x for x in spec.get("added_tokens", [])]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in special):
            raise ValueError("added tokens that take in their surroundings are not understood")
        self.model = Tokenizer.from_file(path).model
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in special)) if special else None
        self.pattern = regex.compile(BYTE_LEVEL)
        self.letters = byte_letters()
        self.cache = PairCache()

    def piece(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
            self.cache.put(piece, n)
        return n

    def text(self, text: str, table: dict[str, int]) -> int:
        total, parts = 0, [text]
        if self.special is not None and (marks := len(self.special.findall(text))):
            total, parts = marks, self.special.split(text)
        for part in parts:
            pieces = self.pattern.findall(part)
            counts = list(map(table.get, pieces))
            try:
                total += sum(counts)
            except TypeError:
                total += sum(self.piece(p) if n is None else n for p, n in zip(pieces, counts, strict=True))
        return total


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_COUNTERS: dict[str, PieceCounter] = {}
CACHES["tokens"] = _COUNTERS.clear


def piece_counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _task_pieces(batches):
    """Lossy counting: when the counter is full, every count goes down by one, and pre-tokens without a count go."""
    split = regex.compile(BYTE_LEVEL).findall
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(p for p in split(text) if len(p) <= LONGEST)
            if len(seen) > COUNTER:
                seen = Counter({p: n - 1 for p, n in seen.items() if n > 1})
    best = seen.most_common(TASK_PIECES)
    yield pa.RecordBatch.from_pydict(
        {"piece": [p for p, _ in best], "n": [n for _, n in best]}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())])
    )


def frequent_pieces(rows: DataFrame, path: str, table_size: int = TABLE) -> dict[str, int]:
    """Token counts of the corpus's most frequent pre-tokens. What is shuffled is a bounded table of each task, not its pre-tokens."""
    pieces = (
        rows.select("text").mapInArrow(_task_pieces, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(table_size)
    )
    counter = piece_counter(path)
    return {r.piece: counter.piece(r.piece) for r in pieces.collect()}


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, table_size: int = TABLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text.

    The broadcast table has at most table_size entries of LONGEST characters, whatever the corpus.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(rows, path, table_size))

    def run(batches):
        claim("tokens")
        counter, known = piece_counter(path), table.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.text(x, known) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
