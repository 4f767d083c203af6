"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document's expected copies are the target over the source's size. The whole part
is taken outright; the fractional parts are rounded together. Two partners meet, mass (in words) moves at random
from one to the other until one of them is taken or left whole, and the other goes on; this keeps the words'
sum and every document's expectation. Documents come in descending order of size, and partners weigh alike: the next document, or a bundle of
the next ones where that weighs less than half. What is left at the end is small. Chunks of about ``CHUNK`` documents of a source are rounded
apart, and their residuals meet, pair by pair, in a tree of fan-in ``FAN``. The last residual of a source is drawn by itself.

Random draws come from hashes of the seed, the source and the chunk, and rows are ordered by size, id and text: reruns agree.

Cases: a null text has size 0 and takes nothing. The null source is one source, the last. Rows that repeat id, source and text are
rounded together (n rows at a part of p expect n * p) and share what they take as evenly as whole copies allow; rows that
share an id alone (null ids too) are documents of their own. Sources without words have target 0. An empty table gives an
empty result; columns besides those read are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, materialize, small_batches

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 500
FAN = 32
#: Up to so many bytes the table of sources is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess reshared by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        whole = math.fsum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] > most * sizes[i] * whole]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in above:
            targets[i] = most * sizes[i]
        left -= math.fsum(targets[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def round_pivotal(sizes: np.ndarray, parts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions parts (sizes in descending order) pair by pair so that sum(size * part) and every expectation stay;
    returns them rounded and the place of the one that may still be fractional, or -1.

    The document held is the largest that is still open. Its partner is the next one, or, where that weighs less than half, as many of the
    next ones of one common part as weigh the same: their parts rise or fall together. A bundle that is left fractional is taken apart again.
    """
    out = np.where((sizes > 0) & (parts > 1e-12) & (parts < 1 - 1e-12), parts, np.rint(parts)).astype(np.float64)
    waiting = [(int(i),) for i in np.flatnonzero((out > 0) & (out < 1))[::-1]]  # the next one is the last
    draws = iter(rng.random(2 * len(waiting)).tolist())
    weight, part = sizes.astype(np.float64).tolist(), out.tolist()
    held: tuple[int, ...] = ()
    while waiting:
        if not held:
            held = waiting.pop()
            continue
        other = list(waiting.pop())
        a, b = weight[held[0]], weight[other[0]]
        least = a if b < a / 2 else 0.0
        while b < least and waiting and part[waiting[-1][0]] == part[other[0]]:
            more = waiting.pop()
            other += more
            b += weight[more[0]]
        x, y = part[held[0]] * a, part[other[0]] * b
        give, get = min(x, b - y), min(y, a - x)
        if next(draws) * (give + get) < get:
            x, y = x - give, y + give
        else:
            x, y = x + get, y - get
        still = []
        for members, value in ((held, x / a), (other, y / b)):
            settled = not 1e-9 < value < 1 - 1e-9
            for i in members:
                part[i] = float(round(value)) if settled else value
            if not settled:
                still.append(members)
        held = ()
        for members in reversed(still):  # one at most, but for rounding errors
            waiting += [(i,) for i in reversed(members)]
    return np.array(part, dtype=np.float64), held[0] if held else -1


def _round_group(key, rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "digest"], ascending=[False, True, True], na_position="last", kind="stable")
    name = f"{seed}/{key[0]}/{key[1]}/{rows.level.iloc[0]}"
    rng = np.random.default_rng([zlib.crc32(name.encode()), len(name)])
    part, held = round_pivotal(rows["size"].to_numpy(), rows["part"].to_numpy(), rng)
    if held >= 0 and rows.chunks.iloc[0] <= 1:
        part[held] = float(rng.random() < part[held])
        held = -1
    open_ = np.zeros(len(rows), dtype=bool)
    if held >= 0:
        open_[held] = True
    whole = np.where(open_, 0, np.rint(part)).astype(np.int64)
    return rows.assign(extra=rows.extra + whole, part=np.where(open_, part, 0.0), open=open_)[[x.split()[0] for x in _STATE.split(", ")]]


_STATE = "doc_id long, source string, digest long, size long, n long, extra long, part double, chunk long, chunks long, level int, open boolean"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """doc_id, source, digest (of the text) and size (words) of a whole text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = {"doc_id": docs[id_col].cast("long"), "source": docs[source_col].cast("string"), "digest": F.xxhash64(F.col(text_col).cast("string")), "size": size}
    return [value.alias(name) for name, value in named.items()]


def _small(rows: list, most: int = BROADCAST_BYTES) -> bool:
    """Whether the table of sources may be broadcast, by its bytes."""
    return sum(64 + 4 * len(r.source or "") for r in rows) <= most


def shares(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, digest, size, n, source_size, target, base and extra of every document: each of its n equal rows is taken base times,
    extra of them once more.

    Only ids, sources, sizes and digests are shuffled. The driver holds one row for each source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sizes = materialize(docs.select(*measure(docs, id_col, text_col, source_col)).groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    known = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count(F.lit(1)).alias("units")).collect()
    known.sort(key=lambda r: (r.source is None, r.source or ""))
    total = [float(r.words) for r in known]
    cycle = [weights[i % len(weights)] for i in range(len(known))]
    targets = fill_targets(total, cycle, share * math.fsum(total), most)
    plan = spark.createDataFrame(
        [(r.source, int(r.words), t, t / r.words if r.words else 0.0, max(1, -(-r.units // CHUNK))) for r, t in zip(known, targets, strict=True)],
        "s string, source_size long, target double, rate double, chunks long",
    )
    if _small(known):
        plan = F.broadcast(plan)
    rows = sizes.join(plan, sizes.source.eqNullSafe(F.col("s")))
    expected = F.col("n") * (F.col("rate") - F.floor("rate"))
    state = rows.select(
        "doc_id", "source", "digest", "size", "n", F.floor(expected).alias("extra"), (expected - F.floor(expected)).alias("part"),
        F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.col("chunks")).alias("chunk"), "chunks", F.lit(0).alias("level"),
    )
    levels, most_chunks = 0, max((-(-r.units // CHUNK) for r in known), default=1)
    done = None
    while True:
        rounded = state.groupBy(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "chunk").applyInPandas(
            lambda key, rows: _round_group(key, rows, seed), _STATE
        )
        table = materialize(rounded, "mix")
        settled = table.filter("NOT open").select("doc_id", "source", "digest", "size", "n", "extra")
        done = settled if done is None else done.unionByName(settled)
        if most_chunks <= 1:
            break
        levels, most_chunks = levels + 1, -(-most_chunks // FAN)
        state = table.filter("open").select(
            "doc_id", "source", "digest", "size", "n", "extra", "part", F.floor(F.col("chunk") / FAN).alias("chunk"),
            F.ceil(F.col("chunks") / FAN).alias("chunks"), F.lit(levels).alias("level"),
        )
    discard(sizes)
    return done.join(plan, done.source.eqNullSafe(F.col("s"))).select(*done.columns, "source_size", "target", F.floor("rate").alias("base"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies of every document; options as in shares."""
    rows = shares(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with its own columns. Rows without words are kept once: they have no share
    in the weights. Rows that repeat id, source and text are numbered, and the first ones are taken once more; only these are shuffled for that.
    """
    names = {k: v for k, v in options.items() if k in ("id_col", "text_col", "source_col")}
    keys = ("doc_id", "source", "digest")
    own = [free_name(docs, f"mixed_{k}") for k in keys]
    n, base, extra, nth = (free_name(docs, x) for x in ("mixed_n", "mixed_base", "mixed_extra", "mixed_nth"))
    found = materialize(shares(docs, **options).filter("size > 0").select(*keys, F.col("n").alias(n), F.col("base").alias(base), F.col("extra").alias(extra)), "shares")
    side = found.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], n, base, extra)
    left = docs.select("*", *[c.alias(o) for c, o in zip(measure(docs, **names), own)]).alias("l")
    joined = left.join(side.alias("r"), [F.col(f"l.{o}").eqNullSafe(F.col(f"r.{o}")) for o in own], "left").select("l.*", n, base, extra)
    out = joined.filter(F.col(n).isNull() | (F.col(n) == 1)).withColumn(nth, F.coalesce(F.col(base) + F.col(extra), F.lit(1)).cast("int"))
    if not found.filter(F.col(n) > 1).isEmpty():
        numbered = joined.filter(F.col(n) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(*own).orderBy(*own)))
        out = out.unionByName(numbered.withColumn(nth, (F.col(base) + (F.col(nth) <= F.col(extra)).cast("long")).cast("int")))
    copy = free_name(docs, "mixed_copy")
    return out.filter(F.col(nth) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*docs.columns)
