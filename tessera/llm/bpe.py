"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of the prefix's encoding. The table of
those last tokens is filled from left to right: the last token of a prefix is the one that ends there and
forms a valid pair with the last token of what stands before it. Reading the table backwards gives the
encoding. Appending bytes only adds entries; after an edit the table is filled again from the edit until
it agrees with the old one over the length of the longest token, from where the old entries hold.

A pair of tokens is valid when merging their joined bytes gives the pair again. It is decided along the two
tokens' merge trees: the pieces that touch across the border must never be due for a merge before one
of them is merged into its own side.

Cases: a null text is the empty text, with no tokens. Bytes of any kind decode. Repeated rows give repeated
results; an empty table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHES, claim, frugal, small_batches

#: A cache's bound: each entry counts once, and once more for every 16 characters of its key.
CACHE = 200_000
#: Lengths of pre-tokens' beginnings whose tables are kept, and how many.
HEADS, HEAD_CACHE = (9, 5), 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base-64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairCache:
    """A map of bounded memory with two generations: what was used since the last turn stays. Keys are texts or bytes, whose values grow no faster
    than they do; a key of more than a sixteenth of the limit isn't kept."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        weight = 1 + len(key) // 16
        if weight > 1 + self.limit // 16:
            return
        if self.held + weight > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        if key not in self.young:
            self.held += weight
        self.young[key] = value


class ByteBPE:
    """A vocabulary of byte tokens; a token's id is its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.odd: set[int] = set()  # tokens that merging their own bytes never gives
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merged(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                else:
                    self.odd.add(rank)
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        # By its last three bytes, how long a token can be.
        self.lengths = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in tails.items()}
        self._heads = PairCache(HEAD_CACHE)
        self._edges: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self._valid: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """Plain merging: again and again the leftmost pair of lowest rank (under below)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The pieces of a token that touch one of its borders, from the outermost inwards to the byte,
        each with the rank at which it vanishes into the next larger one."""
        known = self._edges.get((token, side))
        if known is None:
            known, gone, piece = [], float("inf"), token
            while True:
                known.append((self.tokens[piece], gone))
                if piece not in self.halves:
                    break
                gone = piece
                piece = self.halves[piece][side]
            self._edges[token, side] = known
        return known

    def valid(self, left: int, right: int) -> bool:
        known = self._valid.get((left, right))
        if known is None:
            known = self._decide(left, right)
            if len(self._valid) > 300_000:
                self._valid.clear()
            self._valid[left, right] = known
        return known

    def _decide(self, left: int, right: int) -> bool:
        a, b = self._edge(left, 1), self._edge(right, 0)
        i, j = len(a) - 1, len(b) - 1  # from the bytes upwards, in the order in which merges happen
        while True:
            (x, x_gone), (y, y_gone) = a[i], b[j]
            rank = self.ranks.get(x + y)
            # Of equal ranks the leftmost pair is merged first: that inside the left token, then the border.
            if rank is not None and rank < x_gone and rank <= y_gone:
                return False
            if i == 0 and j == 0:
                return True
            if x_gone <= y_gone:
                i -= 1
            else:
                j -= 1

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill the table of last tokens (last[i]: of the first i + 1 bytes) up to the end of data."""
        get, known, valid, odd, lengths = self.ranks.get, self._valid.get, self.valid, self.odd, self.lengths.get
        for end in range(len(last) + 1, len(data) + 1):
            for n in lengths(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):  # longest first
                start = end - n
                if start < 0:
                    continue
                token = get(data[start:end])
                if token is None or token in odd:
                    continue
                if start:
                    before = last[start - 1]
                    fits = known((before, token))
                    if not (valid(before, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one pre-token. A pre-token that is itself in the vocabulary is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.walk(self._table(data))

    def _table(self, data: bytes) -> list[int]:
        """The table of last tokens. Beginnings that many pre-tokens share are filled once."""
        size = next((n for n in HEADS if n < len(data)), 0)
        if size:
            known = self._heads.get(data[:size])
            if known is None:
                known = self._table(data[:size])
                self._heads.put(data[:size], known)
            last = known[:]
        else:
            last = []
        self.extend(data, last)
        return last

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The encoding of a growing or edited byte string, without pre-tokens."""

    def __init__(self, codec: ByteBPE, data: bytes = b""):
        self.codec, self.data, self.last = codec, bytes(data), []
        codec.extend(self.data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.codec.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many entries were filled anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agree, filled = 0, 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.codec.extend(self.data[: at + 1], self.last)
            filled += 1
            same = at >= start + len(new) and old[at - shift] == self.last[at]
            agree = agree + 1 if same else 0
            if agree >= self.codec.longest:
                self.last += old[at - shift + 1 :]
        return filled

    def ids(self) -> list[int]:
        return self.codec.walk(self.last)


class TextCodec:
    """Texts to ids: each match of the pattern is encoded by itself, through a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe, self.pattern, self.cache = ByteBPE(ranks), regex.compile(pattern), PairCache()
        self.decimal = {i: str(i) for i in self.bpe.tokens}

    def _miss(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = tuple(self.bpe.encode(piece.encode()))
            self.cache.put(piece, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        runs = list(map(self.cache.young.get, pieces))
        if None in runs:
            runs = [self._miss(p) if r is None else r for p, r in zip(pieces, runs, strict=True)]
        return list(chain.from_iterable(runs))

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


_CODECS: dict[tuple[str, str], TextCodec] = {}
CACHES["bpe"] = _CODECS.clear


def codec(path: str, pattern: str) -> TextCodec:
    """One codec for each worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TextCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text and decode its ids again, in one pass without a shuffle.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids.
    """

    def run(batches):
        claim("bpe")
        text_codec = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in texts:
                ids = text_codec.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(text_codec.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(text_codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(frugal(run), schema)
