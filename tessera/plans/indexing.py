"""Index runs: from files to notes and chunks, whole or for what changed, and batch by batch from a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, heat, index
from tessera.sources import embedding, markdown
from tessera.sources.scratch import stored as stored_table
from tessera.sources.store import NOTES, Store


@dataclass(frozen=True)
class Run:
    """What an index run did."""

    indexed: int
    removed: int
    refused_wipe: bool = False
    hot: int = 0
    cold: int = 0


def prepare(files: DataFrame, links: DataFrame, now_ms: int, hot_days: int = 90, known: DataFrame | None = None, self_writes: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """files (path, mtime, content, perhaps ctime) as notes ready to index: title, description, tags, created, tier and body. Links by name are resolved among
    the files and known (path); a note's creation is that of its frontmatter, else its file's ctime where there is one."""
    parsed = markdown.parse_notes(files, cap)
    titled = index.resolve_titles(parsed.select("path", "frontmatter_title", "h1")).select("path", "title")
    rows = parsed.join(titled, "path").withColumn("created", heat.resolve_created(F.col("created"), F.col("ctime")))
    rows = rows.select("path", "mtime", "created", "title", "description", "tags", "body")
    targets = files.select("path") if known is None else files.select("path").unionByName(known.select("path")).distinct()
    resolved, unresolved = markdown.resolve_links(links, targets)
    return heat.resolve_tiers(rows, resolved, now_ms, hot_days, unresolved, self_writes)


def _policy(provider: embedding.Provider) -> str:
    return provider.chunk_policy or "char2000-o100"


def _finish(store: Store, provider: embedding.Provider, target: index.ChunkTarget | None, failed: int, now_ms: int) -> None:
    """Write what the pass means for an upgrade of the chunks."""
    done = index.finish_upgrade(failed, store.meta("chunk_policy"), _policy(provider), target, now_ms, True, False)
    if done["stamp"]:
        store.set_meta("chunk_policy", _policy(provider))
    if done["target"] or done["clear_target"]:
        store.set_meta("chunk_target", done["target"])


def update(store: Store, files: DataFrame, provider: embedding.Provider, now_ms: int, rebuild: bool = False, hot_days: int = 90) -> Run:
    """Bring the store in line with the files: rows without a file go (unless so many that the listing must be at fault), new, changed and
    retitled notes are indexed, all tiers are derived again, and the run is stamped. A change of the model re-indexes everything."""
    stored = store.notes()
    rebuild = rebuild or store.meta("model") != provider.model_id or store.meta("dimension") != str(provider.dimension)
    target = None
    if not rebuild and index.chunk_upgrade_state(store.meta("chunk_policy"), provider.chunk_policy) == "reembed":
        target, new = index.plan_upgrade(store.meta("chunk_target"), _policy(provider), now_ms)
        if new:
            store.set_meta("chunk_target", str(target))
    stale = index.stale_paths(stored, files)
    gone, total = stale.count(), stored.count()
    refused = not rebuild and index.is_implausible_wipe(gone, total)
    links = markdown.links_of(files)
    ready = prepare(files, links, now_ms, hot_days)
    due = ready if rebuild else ready.join(index.needs_reindex(ready.select("path", "mtime", "title"), stored, target and target.started_at).select("path"), "path", "left_semi")
    notes, chunks = embedding.index_notes(due, provider, now_ms=now_ms)
    columns = [x.split()[0] for x in NOTES.split(", ")]
    notes = notes.select(*columns)
    kept_notes, kept_chunks = (stored, store.chunks()) if not rebuild else (index.clear(stored), index.clear(store.chunks()))
    if gone and not refused:
        kept_notes, kept_chunks = index.delete(kept_notes, stale), index.delete(kept_chunks, stale)
    merged = index.upsert(kept_notes, notes)
    live = ready.select("path", F.col("tier").alias("_tier"))
    merged = merged.join(live, "path", "left").withColumn("tier", F.coalesce("_tier", "tier")).select(*columns)
    indexed = due.count()
    store.write("chunks", index.upsert(kept_chunks, chunks))  # chunks first: a note never lacks its chunks
    store.write("notes", merged)
    for key, value in (("model", provider.model_id), ("dimension", str(provider.dimension)), ("last_indexed_at", str(now_ms)), ("bootstrapped", "1")):
        store.set_meta(key, value)
    left = 0
    if target:
        left = store.notes().join(ready.select("path"), "path", "left_semi").filter(F.col("indexed_at") < target.started_at).count()
    _finish(store, provider, target, left, now_ms)
    if rebuild:
        store.set_meta("graph_stale", "1")  # vectors of another model or dimension: the graph is to be built anew
    tiers = {r.tier: r.n for r in heat.tier_counts(store.notes()).collect()}
    return Run(indexed, 0 if refused else gone, refused, tiers.get("hot", 0), tiers.get("cold", 0))


def stream_writer(store: Store, provider: embedding.Provider, read_files: Callable[[DataFrame], DataFrame], now_ms: Callable[[], int], picks: str | None = "picks") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: removes and indexes the batch's notes, and keeps the neighbour graph by the changed notes only. A batch that was
    already written (its number is in the meta table) is skipped."""
    schema = "src string, dst string, sim double, pick_rank int"

    def apply(batch: DataFrame, number: int) -> None:
        if int(store.meta("last_batch") or -1) >= number:
            return
        batch = batch.persist()
        gone, fresh = batch.filter("action = 'remove'").select("path"), batch.filter("action = 'index'").select("path")
        files = read_files(fresh)
        notes, chunks = embedding.index_notes(prepare(files, markdown.links_of(files), now_ms(), known=store.notes()), provider, now_ms=now_ms())
        columns = [x.split()[0] for x in NOTES.split(", ")]
        store.write("chunks", index.upsert(index.delete(store.chunks(), gone), chunks))
        store.write("notes", index.upsert(index.delete(store.notes(), gone), notes.select(*columns)))
        if picks:
            old = store.read(picks, schema)
            vectors = index.ranking_vectors(store.notes())
            now = graph.upsert_notes(vectors, graph.remove_notes(old, gone), fresh)
            store.write(picks, now.select("src", "dst", "sim", "pick_rank"))
        store.set_meta("last_batch", str(number))
        batch.unpersist()

    return apply


def maintain_graph(store: Store, now_ms: int, changed: int, picks: str = "picks", k: int = graph.K, folder_cap: int = graph.FOLDER_CAP) -> bool:
    """Build the neighbour graph anew if it is due: it was never built, its vectors are of another model, or so many notes changed since; not within the cooldown of
    the last build. Returns whether it was built."""
    last = int(store.meta("graph_built_at") or 0)
    flagged = store.meta("graph_stale") is not None or not store.version(picks)
    notes = store.notes()
    if not graph.rebuild_due(changed, notes.count(), flagged, last, now_ms):
        return False
    built_for = store.version("notes")
    store.write(picks, graph.knn_picks(index.ranking_vectors(notes), k, folder_cap).select("src", "dst", "sim", F.col("pick_rank").cast("int").alias("pick_rank")))
    for key, value in (("graph_built_at", str(now_ms)), ("graph_version", str(graph.pack_watermark(built_for, []))), ("graph_stale", None)):
        store.set_meta(key, value)
    return True


def trusted_graph(store: Store, picks: str = "picks") -> DataFrame | None:
    """The picks, if they stand for the notes as they are now; else None."""
    version = store.meta("graph_version")
    if not graph.trusted(int(version) if version else None, store.version("notes")):
        return None
    return store.read(picks, "src string, dst string, sim double, pick_rank int")


def start(store: Store, files: DataFrame, provider: embedding.Provider, now_ms: int, excluded: list[str] = (), most: int = index.CATCH_UP) -> str:
    """What a start does: a store that was never filled waits for the user's first run (bootstrap); a few files changed meanwhile are indexed at once
    (caught-up); for more than that the user is asked (ask)."""
    if store.meta("bootstrapped") is None:
        return "bootstrap"
    due, over = index.catch_up(index.changed_paths(store.notes(), files), excluded, most)
    if over:
        return "ask"
    if not due.isEmpty():
        update(store, files, provider, now_ms)
    return "caught-up"


def cancellable(spark, tag: str, work: Callable[[], object]):
    """Run work under a job tag: spark.interruptTag(tag) from another thread ends its jobs."""
    spark.addTag(tag)
    try:
        return work()
    finally:
        spark.removeTag(tag)


def describe_batch(store: Store, files: DataFrame, ask: Callable[[str], str]) -> int:
    """Have a language model describe the notes without a description; a description that changed meanwhile stays. Returns how many failed."""
    made = stored_table(embedding.describe(store.notes(), files, ask), "described")
    store.write("notes", index.apply_descriptions(store.notes(), made.filter("error IS NULL AND description IS NOT NULL")))
    return made.filter("error IS NOT NULL").count()
