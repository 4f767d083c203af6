"""Helpers shared by the corpus operators: durable tables, word hashing, crc folds."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space that separates words: space and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of its own; a cluster's is refused,
    as its executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytes of a batch that goes to a Python worker: a batch is held several times over while it is worked on.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of BATCH_BYTES at most: by rows alone, a batch of long texts can be of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: What empties each operator's caches in this worker.
CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str = "") -> None:
    """Called where an operator begins work in a Python worker: workers are used again, and the caches of the operators before it
    would add up."""
    for name, empty in CACHES.items():
        if name != owner:
            empty()
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system: an idle worker would keep it, beside those of the operators after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def frugal(work):
    """A function for mapInArrow that gives its memory back when a task ends."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have, without regard to case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Parts that the rows of one key are spread over in joins: a key with a third of all rows is then in no task with more than a few thousandths of them.
SPREAD = 128


def join_spread(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key: rows of one key are spread by a further column, so that they aren't all in one task."""
    spread = rows.withColumn("spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    keys = spread.select(key, "spread").distinct().join(side, key)
    return spread.join(keys, [key, "spread"], how).drop("spread")


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo n; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is uint64 and is not changed."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(255, _STEP, np.uint64)]))


def powers(n: int) -> np.ndarray:
    """The first n powers of _STEP modulo 2^64; long tables are not kept."""
    global _POWERS
    if n > len(_POWERS):
        steps = np.full(n, _STEP, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n > 1 << 16:
            return table
        _POWERS = table
    return _POWERS[:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words (runs without ASCII white space) of a byte array."""
    edge = np.empty(len(raw) + 2, dtype=np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[raw]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, prefixes: tuple[int, ...] = ()):
    """64-bit hashes of the words of a text, A-Z lower-cased. With prefixes, a list: the hashes of
    whole words, then for each given length those of the words' first bytes (0 where a word is shorter)."""
    raw = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_spans(raw)
    if not len(starts):
        empty = np.zeros(0, dtype=np.uint64)
        return [empty] * (1 + len(prefixes)) if prefixes else empty
    lengths = ends - starts
    # Only the words' bytes, and each byte's place in its word.
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    data = raw[~_SPACE[raw]].astype(np.uint64)
    data += np.uint64(1)
    data *= powers(int(lengths.max()))[place]
    whole = mix64(np.add.reduceat(data, bounds[:-1]) * _PRIME + lengths.astype(np.uint64))
    if not prefixes:
        return whole
    out = [whole]
    for n in prefixes:
        part = np.add.reduceat(np.where(place < n, data, np.uint64(0)), bounds[:-1])
        out.append(np.where(lengths > n, mix64(part * _PRIME + np.uint64(n << 32)), np.uint64(0)))
    return out
