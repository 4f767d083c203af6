"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever its low bits are all ones; each chunk gives
one base-64 symbol. The block size is the smallest power of two that leaves at most 64 chunks; the
signature at twice that size is kept too, so that texts whose block sizes differ by one step can be
compared. Likeness is one less the edit distance over the longer length, taken at compatible block
sizes; signatures without a common run of five symbols are unlike (0).

Cases: a null text is the empty text, whose fingerprint is ``4::``; two empty texts have likeness 1.
Repeated rows and tied ids are ordered by a hash of the text and then the text. A table of one row is its
own successor; an empty table gives an empty result. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, mix64, small_batches

WINDOW = 7
MAX_CUTS = 63
RUN = 5
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOL_BYTES = np.frombuffer(_SYMBOLS.encode(), dtype=np.uint8)
_CODE = np.full(256, 255, dtype=np.uint8)
_CODE[_SYMBOL_BYTES] = np.arange(64)


def rolling_hashes(data: bytes) -> np.ndarray:
    """A mixed 32-bit hash of the up to WINDOW bytes that end at each position."""
    padded = np.zeros(len(data) + WINDOW - 1, dtype=np.uint32)
    padded[WINDOW - 1 :] = np.frombuffer(data, dtype=np.uint8)
    padded[WINDOW - 1 :] += 1
    h = np.zeros(len(data), dtype=np.uint32)
    for j in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += padded[j : j + len(data)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def _symbols(sums: np.ndarray, cuts: np.ndarray) -> str:
    at = np.concatenate([[0], cuts + 1])
    if at[-1] < len(sums) - 1:
        at = np.append(at, len(sums) - 1)
    if len(at) < 2:
        return ""
    return _SYMBOL_BYTES[(mix64(np.diff(sums[at])) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``."""
    h = rolling_hashes(data)
    bits = 2
    cuts = np.flatnonzero((h & np.uint32(3)) == 3)
    while len(cuts) > MAX_CUTS and bits < 31:
        cuts = cuts[(h[cuts] >> np.uint32(bits)) & np.uint32(1) == 1]
        bits += 1
    if len(cuts) > MAX_CUTS:  # only texts of one repeated byte pattern: all hashes are equal
        cuts = cuts[:0]
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h, dtype=np.uint64, out=sums[1:])
    wider = cuts[(h[cuts] >> np.uint32(bits)) & np.uint32(1) == 1]
    return f"{1 << bits}:{_symbols(sums, cuts)}:{_symbols(sums, wider)}"


def _grid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes, padded to a common width, and the lengths."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    width = max(1, int(lengths.max(initial=0)))
    flat = np.frombuffer("".join(x.ljust(width, "=") for x in texts).encode(), dtype=np.uint8)
    return _CODE[flat].reshape(len(texts), width), lengths


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of many pairs at once: bit-parallel columns, one 64-bit word for each pair."""
    a, m = _grid(left)
    b, n = _grid(right)
    rows = np.arange(len(left))
    masks = np.zeros((len(left), 256), dtype=np.uint64)
    for i in range(a.shape[1]):
        masks[rows, a[:, i]] |= np.uint64(1) << np.uint64(i)
    masks[:, 255] = 0  # padding equals nothing
    up = np.full(len(left), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    down = np.zeros(len(left), dtype=np.uint64)
    top = np.maximum(m - 1, 0).astype(np.uint64)
    one = np.uint64(1)
    distance = m.copy()
    for j in range(b.shape[1]):
        same = masks[rows, b[:, j]]
        xv = same | down
        xh = (((same & up) + up) ^ up) | same
        rise = down | ~(xh | up)
        fall = up & xh
        live = j < n
        distance += live * (((rise >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64))
        rise = (rise << one) | one
        fall = fall << one
        up = fall | ~(xv | rise)
        down = rise & xv
    return np.where(m == 0, n, distance)


def _runs(grid: np.ndarray, lengths: np.ndarray, missing: int) -> np.ndarray:
    width = max(1, grid.shape[1] - RUN + 1)
    codes = np.full((len(grid), width), missing, dtype=np.int64)
    if grid.shape[1] >= RUN:
        total = np.zeros((len(grid), width), dtype=np.int64)
        for k in range(RUN):
            total = total * 64 + grid[:, k : k + width]
        codes = np.where(np.arange(width) + RUN <= lengths[:, None], total, missing)
    return codes


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of signatures at one block size, for many pairs."""
    if not left:
        return np.zeros(0)
    a, m = _grid(left)
    b, n = _grid(right)
    longest = np.maximum(m, n)
    like = 1.0 - edit_distances(left, right) / np.maximum(longest, 1)
    x, y = _runs(a, m, -1), _runs(b, n, -2)
    shared = np.zeros(len(left), dtype=bool)
    for i in range(0, len(left), 256):
        shared[i : i + 256] = (x[i : i + 256, :, None] == y[i : i + 256, None, :]).any(axis=(1, 2))
    return np.where(shared | (np.minimum(m, n) < RUN), like, 0.0)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of the fingerprints of many pairs: the best over compatible block sizes."""
    out = np.zeros(len(left))
    owners: list[int] = []
    xs: list[str] = []
    ys: list[str] = []
    for i, (p, q) in enumerate(zip(left, right, strict=True)):
        if p == q:
            out[i] = 1.0
            continue
        pb, p1, p2 = p.split(":")
        qb, q1, q2 = q.split(":")
        pb, qb = int(pb), int(qb)
        if pb == qb:
            pairs = ((p1, q1), (p2, q2))
        elif pb == 2 * qb:
            pairs = ((p1, q2),)
        elif qb == 2 * pb:
            pairs = ((p2, q1),)
        else:
            pairs = ()
        for x, y in pairs:
            owners.append(i)
            xs.append(x)
            ys.append(y)
    np.maximum.at(out, np.array(owners, dtype=np.int64), signature_likeness(xs, ys))
    return out


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edited(text: str, following: str) -> bytes:
    half = len(text) // 2
    return (text[: len(text) - half] + following[:half]).encode()


def _compare(ids: list, texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> dict:
    changed = [_edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed_prints = [fingerprint(x) for x in changed]
    return {
        "doc_id": ids,
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
        "fingerprint": prints,
        "edited_fingerprint": changed_prints,
        "near_edited": likeness(prints, changed_prints),
        "near_next": likeness(prints, next_prints),
    }


_ROW = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_OPEN = pa.schema([*_ROW, ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])


def _walk(batches):
    """Rows in order; each needs its successor. The first and last row of the task go out with their text."""
    part = TaskContext.get().partitionId()
    last = None  # id, text, fingerprint

    def edge(kind, doc_id, text):
        row = dict.fromkeys(_OPEN.names, [None]) | {"kind": [kind], "part": [part], "doc_id": [doc_id], "text": [text]}
        return pa.RecordBatch.from_pydict(row, schema=_OPEN)

    for batch in batches:
        all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(all_ids), 512):
            ids, texts = all_ids[at : at + 512], all_texts[at : at + 512]
            prints = [fingerprint(x.encode()) for x in texts]
            if last is None:
                yield edge(2, ids[0], texts[0])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            rows = _compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_pydict(rows | {"kind": [0] * n, "part": [part] * n, "text": [None] * n}, schema=_OPEN)
            last = ids[-1], texts[-1], prints[-1]
    if last is not None:
        yield edge(1, last[0], last[1])


def _stitch(batches):
    for batch in batches:
        ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
        prints = [fingerprint(x.encode()) for x in texts]
        rows = _compare(ids, texts, following, prints, [fingerprint(x.encode()) for x in following])
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(_ROW))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form (last half replaced by the start of the next document).

    One range shuffle puts the documents in id order; each task then walks its range. The two rows at a
    range's edges, with their texts, meet their neighbours in a join of as many rows as there are tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    walked = materialize(ordered.mapInArrow(_walk, _RESULT + ", kind int, part int, text string"), "fingerprints")
    heads = walked.filter("kind = 2").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = walked.filter("kind = 1").select("doc_id", "text", "part")
    parts = sorted(r[0] for r in heads.select("next_part").collect())  # one int for each task
    names = [x.split()[0] for x in _RESULT.split(", ")]
    done = walked.filter("kind = 0").select(*names)
    if not parts:
        return done
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    joined = tails.join(F.broadcast(follow), "part").join(heads, "next_part").select("doc_id", "text", "next_text")
    return done.unionByName(joined.mapInArrow(_stitch, _RESULT))
