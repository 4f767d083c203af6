"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles of ``words`` words. A sketch deals the set's members to lanes and keeps
their XOR in each lane, so that a member in which two sets differ changes one lane at most: the number of
lanes that differ is a lower bound of the symmetric difference. Sets that link differ in at most
d = floor(2 (1 - t) / (1 + t) * size) members, t the similarity and size the larger set's. A size band has
g > d lanes, so at least g - d lanes of linked sets agree (pigeonhole): lanes are join keys.

A band is ``RATIO`` wide; a set has a sketch for each further band that a partner may be in (from a similarity of 72 % on that is
the next at most, for sets near a band's upper end). Empty lanes are no keys
(unless a set has so few filled lanes that the count needs them). Sets with at most ``slack`` keys among the crowded
ones (shared by more than ``CROWD`` different sets) drop those: linked sets agree in more than slack lanes, so one that is
not crowded, or crowded on both sides, remains.

A key of few sets gives their pairs, which must share as many keys as linked sets do, less those that may be crowded; a crowded
key is a star, which leads its sets to the first of them. Components of these candidate links are clusters. The sets of a cluster of up to one
block are compared in one place: first the Hamming distance of their bit sketches, then, where that leaves a link possible and the two
aren't linked through others yet, the sets themselves. In larger clusters the candidate links are verified by themselves: a star's texts
come to it in chunks of ``LEAVES``, each with the first one's text. Linked sets that share a key that isn't crowded are found by then. Others
share a star: where the sets of a star are still in several components, those outside its largest one are compared with all of it, in blocks. Equal
sets are one from the start. Rows of one component, star or set needn't all meet in a task: joins on these keys are spread over
``SPREAD`` parts.

Cases: null texts, and texts without words, have the empty set and link with nothing. Texts of fewer words than a shingle has are one
shingle. Repeated rows and equal texts link. Rows without an id link with nothing and have no component. An empty
table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPREAD, claim, discard, free_name, frugal, join_spread, materialize, mix64, small_batches, word_hashes

WORDS = 4
PERCENT = 85
RATIO = 1.4
CROWD = 6
#: Sets that are compared with a star's first one in one group.
LEAVES = 256
#: Sets of a block, of which a task holds two: so many, or so many bytes.
BLOCK, BLOCK_BYTES = 1_000, 8 << 20
#: Up to so many rows of 40 bytes are broadcast to pick texts; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Sets that a task remembers, so as not to work on repeats again.
SEEN = 100_000
#: Links whose components the driver finds by itself (16 bytes each), as each round of joins costs it some 19 jobs with their plans. More links take the rounds.
DRIVER_LINKS = 200_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes((text or "").encode())
    n = min(words, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return np.unique(mix64(out))


def node_of(members: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=None)
def _band(number: int, percent: int) -> tuple[int, int, int, int, int]:
    """Smallest size, size beyond the largest, distance d, lanes g and slack of a size band."""
    low = 1 if number == 0 else _band(number - 1, percent)[1]
    high = max(low + 1, math.ceil(low * RATIO))
    d = 2 * (high - 1) * (100 - percent) // (100 + percent)
    slack = 2 + d // 20
    need = d + 1 + slack
    n = max(1, low * percent // 100)
    g = need
    while g < 4 * high:
        empty = (1 - 1 / g) ** n
        mean = g * (1 - empty)
        spread = max(0.0, g * (g - 1) * (1 - 2 / g) ** n + g * empty - (g * empty) ** 2) if g > 2 else 0.0
        if mean - 3 * math.sqrt(spread) >= need:
            break
        g += 1
    return low, high, d, g, slack


def bands_of(size: int, percent: int = PERCENT) -> list[int]:
    """The bands in which a set of this size meets others: its own, and each next one as long as a larger partner may be there."""
    number = 0
    while _band(number, percent)[1] <= size:
        number += 1
    out = [number]
    while 100 * size >= percent * _band(out[-1], percent)[1]:
        out.append(out[-1] + 1)
    return out


def lanes(members: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch: XOR of the members of each lane, and how many members it has."""
    lane = ((members >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)  # members are sorted, so are lanes
    filled, starts = np.unique(lane, return_index=True)
    words, n = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=np.int64)
    if len(filled):
        words[filled] = np.bitwise_xor.reduceat(mix64(members), starts)
        n[filled] = np.diff(np.append(starts, len(members)))
    return words, n


def lane_keys(members: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """For each band of a set, its slack and the keys of its lanes."""
    out = []
    for number in bands_of(len(members), percent):
        _, _, d, g, slack = _band(number, percent)
        words, n = lanes(members, g)
        filled = n > 0
        place = np.arange(g, dtype=np.uint64) + np.uint64(number << 40)
        keys = mix64(words + mix64(place))
        out.append((slack, keys if filled.sum() < d + 1 + slack else keys[filled]))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def _members(batches, words: int):
    claim()
    for batch in batches:
        sets = [shingles(x, words) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([node_of(x) if len(x) and i is not None else None for i, x in zip(batch.column(0).to_pylist(), sets, strict=True)], pa.int64()),
                batch.column(2),
            ],
            names=["doc_id", "n_shingles", "node", "digest"],
        )


_KEYED = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("slack", pa.int32())])


def _keyed(percent: int, words: int):
    def run(batches):
        claim()
        seen = set()
        for batch in batches:
            keys, nodes, slacks = [], [], []
            for text in batch.column(0).to_pylist():
                members = shingles(text, words)
                if not len(members) or (node := node_of(members)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                for slack, own in lane_keys(members, percent):
                    keys.append(own)
                    nodes.append(np.full(len(own), node, dtype=np.int64))
                    slacks.append(np.full(len(own), slack, dtype=np.int32))
            if keys:
                arrays = [np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(slacks)]
                for at in range(0, len(arrays[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in arrays], schema=_KEYED)

    return run


_STARS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("slack", pa.int32()), ("crowded", pa.bool_())])


def _pairs(nodes: np.ndarray, slacks: np.ndarray, run: np.ndarray) -> list[tuple]:
    """All pairs of nodes of one run; runs are short and contiguous."""
    out = []
    for k in range(1, CROWD):
        same = run[k:] == run[:-k]
        if not same.any():
            break
        out.append((nodes[k:][same], nodes[:-k][same], slacks[k:][same], np.zeros(same.sum(), dtype=bool)))
    return out


def _stars(batches):
    """Rows sorted by key and node. A key of few nodes gives all their pairs, a crowded one a row for each node with its first node. Keys of
    one node give nothing. What is held is the last key's rows while they are few, and its first node afterwards."""
    key = first = last = None  # of the rows so far
    held_nodes, held_slacks = np.zeros(0, np.int64), np.zeros(0, np.int32)  # the last key's, while they are few
    n = 0  # the last key's different nodes

    def batch_of(parts):
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=_STARS)

    def star(nodes, slacks):
        return nodes, np.full(len(nodes), first, dtype=np.int64), slacks, np.ones(len(nodes), dtype=bool)

    for batch in batches:
        k, v, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        fresh[0] = not (k[0] == key and v[0] == last)
        end = k[-1], v[-1]
        k, v, s = k[fresh], v[fresh], s[fresh]
        parts: list[tuple] = []
        goes_on = int(np.searchsorted(k != key, True)) if key is not None else 0  # rows of the last batch's key
        if goes_on:
            n += goes_on
            held_nodes, held_slacks = np.append(held_nodes, v[:goes_on]), np.append(held_slacks, s[:goes_on])
            if n > CROWD:
                parts.append(star(held_nodes, held_slacks))
                held_nodes, held_slacks = held_nodes[:0], held_slacks[:0]
        k, v, s = k[goes_on:], v[goes_on:], s[goes_on:]
        if len(k):
            parts += _pairs(held_nodes, held_slacks, np.zeros(len(held_nodes), np.int64))
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sizes = np.diff(np.append(starts, len(k)))
            run = np.repeat(np.arange(len(sizes)), sizes)
            crowded, final = (sizes > CROWD)[run], run == len(sizes) - 1
            if crowded.any():
                parts.append((v[crowded], v[starts][run][crowded], s[crowded], np.ones(crowded.sum(), dtype=bool)))
            few = ~crowded & ~final
            parts += _pairs(v[few], s[few], run[few])
            first, n = v[starts[-1]], int(sizes[-1])
            held_nodes, held_slacks = (v[final], s[final]) if n <= CROWD else (v[:0], s[:0])
        key, last = end
        yield from batch_of(parts)
    yield from batch_of(_pairs(held_nodes, held_slacks, np.zeros(len(held_nodes), np.int64)))


def candidate_links(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v, crowded): links among which, or among whose stars (v, where crowded), every pair of sets is that may link. One shuffle of the lane keys."""
    keyed = _texts(docs, id_col, text_col).filter("doc_id IS NOT NULL").select("text").mapInArrow(frugal(_keyed(percent, words)), "key long, node long, slack int")
    stars = materialize(
        keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(frugal(_stars), "node long, other long, slack int, crowded boolean")
        .groupBy("node", "other", "slack", "crowded").agg(F.count(F.lit(1)).alias("keys")),
        "stars",
    )
    busy = materialize(stars.filter("crowded").groupBy("node", "slack").agg(F.sum("keys").alias("crowds")), "crowds")
    # Linked sets share more than slack keys. Crowded ones among these are no more than either has.
    plain = stars.filter("NOT crowded").join(busy.withColumnRenamed("crowds", "a"), ["node", "slack"], "left")
    plain = plain.join(busy.select(F.col("node").alias("other"), "slack", F.col("crowds").alias("b")), ["other", "slack"], "left")
    plain = plain.filter(F.col("keys") + F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) > F.col("slack"))
    crowded = stars.filter("crowded AND node != other").join(busy.filter("crowds > slack").select("node", "slack"), ["node", "slack"], "left_semi")
    both = plain.select("node", "other", "crowded").unionByName(crowded.select("node", "other", "crowded"))
    out = materialize(both.groupBy(F.col("node").alias("u"), F.col("other").alias("v")).agg(F.max("crowded").alias("crowded")), "candidates")
    discard(stars)
    discard(busy)
    return out


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) of pairs (u, v): m is the least v of each u. The pairs of one u are spread by v."""
    spread = pairs.withColumn("spread", F.pmod(F.xxhash64("v"), F.lit(SPREAD))).repartition("u", "spread")
    part = spread.groupBy("u", "spread").agg(F.min("v").alias("m"))
    least = part.groupBy("u").agg(F.min("m").alias("m"))
    return spread.join(part.select("u", "spread").join(least, "u"), ["u", "spread"]).select("u", "v", "m")


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), each once, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _components_here(edges: DataFrame) -> DataFrame:
    """components() of few edges, found by the driver."""
    table = edges.select("u", "v").toArrow()
    nodes, roots = least_nodes(table["u"].to_numpy(), table["v"].to_numpy())
    return materialize(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots})), "roots")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge.

    Up to DRIVER_LINKS edges go to the driver. More of them alternate two star steps until the edges are stars; every round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        if seen[0] <= DRIVER_LINKS:
            out = _components_here(now)
            discard(now)
            return out
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        led = _with_least(large)
        small = led.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.distinct(), "edges")
        discard(now)
        now = nxt
    else:
        raise RuntimeError("the components did not settle")
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    discard(now)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Linker:
    """Links among the sets of one block or of two blocks, without those that follow from others."""

    def __init__(self, percent: int):
        self.percent = percent

    def links(self, sets: list[np.ndarray], side: np.ndarray, cross: bool, known: np.ndarray) -> list[tuple[int, int]]:
        """known are the components so far; with cross, only sets of different sides are compared."""
        n = len(sets)
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        bits = 64 * max(1, -(-2 * int(sizes.mean()) // 64))  # of larger sets the bound is weaker
        packed = np.stack([np.packbits(np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1) for x in sets]).view(np.uint64)
        root = np.unique(known, return_inverse=True)[1]
        out = []
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[root[rest] != root[i]]
            if cross:
                rest = rest[side[rest] != side[i]]
            low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[100 * low >= self.percent * high]
            if not len(rest):
                continue
            far = np.bitwise_count(packed[rest] ^ packed[i]).sum(axis=1, dtype=np.int64)
            rest = rest[(100 + self.percent) * far <= (100 - self.percent) * (sizes[rest] + sizes[i])]
            for j in rest:
                if root[j] != root[i] and linked(sets[i], sets[j], self.percent):
                    root[root == root[j]] = root[i]
                    out.append((i, int(j)))
        return out


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], schema=_LINKS)


def _check_stars(percent: int, words: int):
    """Rows sorted by (hub, chunk, side, node, text), the hub's own first. What is held is the hub's set."""

    def run(batches):
        claim()
        key = head = last = None
        for batch in batches:
            found = []
            for hub, chunk, side, node, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (hub, chunk) != key:
                    key, head, last = (hub, chunk), None, None
                if side == 0:
                    head = shingles(text, words) if head is None else head
                elif node != last:
                    last = node
                    if linked(head, shingles(text, words), percent):
                        found.append((node, hub))
            yield _link_batch(found)

    return run


def _check_blocks(percent: int, words: int):
    linker = Linker(percent)

    def settle(rows, cross):
        if len(rows) < 2:
            return []
        nodes, sides, roots, sets = zip(*rows, strict=True)
        pairs = linker.links(list(sets), np.array(sides), cross, np.array(roots))
        return [(nodes[i], nodes[j]) for i, j in pairs]

    def run(batches):
        claim()
        key, rows = None, []
        for batch in batches:
            found = []
            for *now, side, node, root, text in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if now != key:
                    found += settle(rows, key and (key[1] or key[2] != key[3]))
                    key, rows = now, []
                if not rows or rows[-1][0] != node:
                    rows.append((node, side, root, shingles(text, words)))
            yield _link_batch(found)
        yield _link_batch(settle(rows, key and (key[1] or key[2] != key[3])))

    return run


def _bodies(texts: DataFrame, known: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, n, root, large, text) of the sets that may link: one text each (repeats may remain), and whether their cluster is beyond one block."""
    firsts = known.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.max("n_shingles").alias("n"))
    pick = materialize(firsts.join(clusters, "node").select("node", "n", "root", "first.doc_id", "first.digest"), "wanted")
    large = (F.count(F.lit(1)) > BLOCK) | (8 * F.sum("n") > BLOCK_BYTES)
    placed = join_spread(pick, pick.groupBy("root").agg(large.alias("large")), "root", "node")
    if pick.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    chosen = texts.filter("doc_id IS NOT NULL").join(placed, ["doc_id", "digest"]).select("node", "n", "root", "large", "text")

    def once(batches):
        claim()
        seen = set()
        for batch in batches:
            nodes, keep = batch.column(0).to_pylist(), []
            for node in nodes:
                keep.append(node not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
            yield batch.filter(pa.array(keep, pa.bool_()))

    out = materialize(chosen.mapInArrow(frugal(once), "node long, n long, root long, large boolean, text string"), "bodies")
    discard(pick)
    return out


_CELL = ("star", "large", "p", "q")


def _block_links(cells: DataFrame, percent: int, words: int) -> DataFrame:
    """(u, v): links among the sets of each cell; cells has _CELL, side, node, root (the component so far) and text."""
    placed = cells.select(*_CELL, "side", "node", "root", "text").repartition(*_CELL).sortWithinPartitions(*_CELL, "node")
    return placed.mapInArrow(frugal(_check_blocks(percent, words)), "u long, v long")


def _star_links(candidates: DataFrame, bodies: DataFrame, percent: int, words: int) -> DataFrame:
    """(u, v): the candidate links that hold."""
    chunks = candidates.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / LEAVES).alias("chunks"))
    dealt = join_spread(candidates.select("u", "v"), chunks, "v", "u").withColumn("chunk", F.pmod(F.xxhash64("u", F.lit(1)), F.col("chunks")))
    text = F.col("text")
    leaves = dealt.join(bodies, dealt.u == bodies.node).select(F.col("v").alias("hub"), "chunk", F.lit(1).alias("side"), "node", text)
    heads = chunks.join(bodies, chunks.v == bodies.node).select(
        F.col("v").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "node", text
    )
    both = heads.unionByName(leaves).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "side", "node")
    return both.mapInArrow(frugal(_check_stars(percent, words)), "u long, v long")


def _rest_links(candidates: DataFrame, roots: DataFrame, bodies: DataFrame, percent: int, words: int) -> DataFrame | None:
    """(u, v): links within stars whose sets are in several components still; None if there is no such star."""
    stars = candidates.filter("crowded").select(F.col("v").alias("star"), F.col("u").alias("node"))
    members = stars.unionByName(stars.select("star", F.col("star").alias("node")).distinct())
    members = join_spread(members, roots, "node", "star", "left").select("star", "node", F.coalesce("root", "node").alias("root"))
    sizes = bodies.groupBy("node").agg(F.max("n").alias("n"))
    parts = materialize(members.join(sizes, "node"), "members")
    by = parts.groupBy("star", "root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n"))
    total = by.groupBy("star").agg(
        F.max_by("root", F.struct("sets", "root")).alias("most"), F.max(F.struct("sets", "root", "n")).alias("top"), F.sum("sets").alias("sets"), F.sum("n").alias("n")
    ).filter(F.col("sets") > F.col("top.sets"))
    if total.isEmpty():
        discard(parts)
        return None
    blocks = lambda sets, n: F.ceil(F.greatest(sets / BLOCK, 8 * n / BLOCK_BYTES)).cast("int")
    plan = total.select("star", "most", blocks(F.col("top.sets"), F.col("top.n")).alias("large"), blocks(F.col("sets") - F.col("top.sets"), F.col("n") - F.col("top.n")).alias("rest"))
    dealt = join_spread(parts, plan, "star", "node")
    inside = F.col("root") == F.col("most")
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("large")).otherwise(F.col("rest"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda large, p, q, side: F.struct(F.lit(large).alias("large"), p.alias("p"), q.alias("q"), side.alias("side"))
    dealt = dealt.withColumn("own", own)
    of_large = F.transform(upto("rest"), lambda r: cell(True, r, F.col("own"), F.lit(1)))
    of_rest = F.concat(
        F.transform(upto("large"), lambda q: cell(True, F.col("own"), q, F.lit(0))),
        F.transform(upto("rest"), lambda r: cell(False, F.least(r, "own"), F.greatest(r, "own"), F.col("own"))),
    )
    cells = dealt.select("star", "node", "root", F.explode(F.when(inside, of_large).otherwise(of_rest)).alias("cell")).select("star", "cell.*", "node", "root")
    out = materialize(_block_links(cells.join(bodies.select("node", "text"), "node"), percent, words), "links")
    discard(parts)
    return out


def _link_sets(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node (the set), root (its component) and component_id of every row; the last three are null without an id or set."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    known = materialize(texts.mapInArrow(frugal(lambda batches: _members(batches, words)), "doc_id long, n_shingles long, node long, digest long"), "nodes")
    candidates = candidate_links(docs, percent, words, id_col, text_col)
    clusters = components(candidates)
    bodies = _bodies(texts, known, clusters)
    nought = F.lit(0)
    small = bodies.filter("NOT large").select(F.col("root").alias("star"), "large", nought.alias("p"), nought.alias("q"), nought.alias("side"), "node", F.col("node").alias("root"), "text")
    links = materialize(_block_links(small, percent, words), "links")
    far = bodies.filter("large")
    if far.isEmpty():
        roots, done = components(links), [candidates, clusters, bodies, links]
    else:
        inner = materialize(join_spread(candidates, far.select(F.col("node").alias("v")).distinct(), "v", "u"), "candidates")
        held = materialize(_star_links(inner, far, percent, words), "links")
        roots = components(links.unionByName(held))
        more = _rest_links(inner, roots, far, percent, words)
        if more is not None:
            discard(roots)
            roots = components(links.unionByName(held).unionByName(more))
        done = [candidates, clusters, bodies, links, inner, held, more]
    for table in done:
        discard(table)
    sets = known.filter("node IS NOT NULL").drop("digest")
    spread = sets.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    part = spread.groupBy("node", "spread").agg(F.min("doc_id").alias("least"))
    named = part.groupBy("node").agg(F.min("least").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = join_spread(named.select("node", "root"), least, "root", "node")
    placed = spread.join(part.select("node", "spread").join(final, "node"), ["node", "spread"])
    rest = known.filter("node IS NULL").select("doc_id", "n_shingles", "node", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("component_id"))
    return placed.select(*rest.columns).unionByName(rest)


def link_documents(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    linked = _link_sets(docs, percent, words, id_col, text_col)
    return linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_nodes(docs: DataFrame, name: str, words: int, text_col: str) -> DataFrame:
    """docs with each row's set as a further column; null for the empty set."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        claim()
        for batch in batches:
            sets = (shingles(x, words) for x in batch.column(at).to_pylist())
            nodes = pa.array([node_of(x) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, name])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_first(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id (of its texts in the component, the one whose set has the smallest
    name; of rows that repeat id and set, any one), with its own columns. Rows without an id or with the empty set all stay."""
    linked_rows = materialize(_link_sets(docs, percent, words, id_col, text_col).filter("node IS NOT NULL").select("doc_id", "node", "root", "component_id"), "linked")
    node, own_id, own_node = (free_name(docs, x) for x in ("set_node", "own_id", "own_node"))
    ids = [F.col("doc_id").alias(own_id), F.col("node").alias(own_node)]
    # An id may stand on texts of several components, so a row is named by its id and its set.
    first = linked_rows.filter("doc_id = component_id")
    ties = first.groupBy("root").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most")
    # Those that go are fewer than those that stay.
    later = linked_rows.filter("doc_id != component_id").select(*ids).unionByName(first.join(ties, "root").filter("node != least").select(*ids))
    dropped = materialize(later.distinct(), "dropped")

    def join(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
        return rows.join(side, (rows[id_col].cast("long") == F.col(own_id)) & (rows[node] == F.col(own_node)), how)

    own = join(_with_nodes(docs, node, words, text_col), dropped, "left_anti")
    repeated = first.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(*ids)
    if not repeated.isEmpty():
        own = join(own, repeated, "left_anti").unionByName(join(own, repeated, "left_semi").dropDuplicates([id_col, node]))
    return own.drop(node)
