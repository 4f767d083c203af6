import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources import embedding, markdown
from tessera.sources.store import Store
from tessera.streaming import changes


def test_markdown(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.md").write_text('---\ntitle: "T"\ntags: [x, y]\n---\n# Head\nbody [[z|shown]] [[z]]')
    (tmp_path / "skip.md").write_text("x")
    files = markdown.read_notes(spark, str(tmp_path), ["skip"])
    r = markdown.parse_notes(files).first()
    assert (r.path, r.frontmatter_title, r.tags, r.h1) == ("d/a b.md", "T", ["x", "y"], "Head")
    assert [tuple(x) for x in markdown.links_of(files).collect()] == [("d/a b.md", "z", 2)]


def test_store_and_search(spark, tmp_path):
    rows = [("f/a", 1, "Apples", None, "the apple tree bears apples"), ("f/b", 2, "Bread", "how to bake a loaf", "flour and water")]
    notes = spark.createDataFrame(rows, "path string, mtime long, title string, description string, body string")
    notes = notes.withColumn("created", F.lit(0).cast("long")).withColumn("tags", F.array().cast("array<string>")).withColumn("tier", F.lit("hot"))
    provider = embedding.HashingProvider()
    made, chunks = embedding.index_notes(notes, provider)
    store = Store(spark, str(tmp_path / "store")).open()
    assert store.notes().count() == 0
    store.upsert(made, chunks)
    store.upsert(made.filter("path = 'f/a'").withColumn("title", F.lit("Apple")), chunks.filter("path = 'f/a'"))
    assert {r.path: r.title for r in store.notes().collect()} == {"f/a": "Apple", "f/b": "Bread"}
    found = search.search(store.notes(), store.chunks(), "apple tree", query_vec=provider.embed(["apple tree"])[0]).collect()
    assert found[0].path == "f/a" and "apple" in found[0].snippet.text
    only = search.search(store.notes(), store.chunks(), "loaf").collect()
    assert only[0].path == "f/b" and only[0].snippet.source == "description"
    store.delete(spark.createDataFrame([("f/a",)], "path string"))
    assert store.notes().count() == 1 and store.chunks().count() == 1
    store.set_meta("k", "v")
    assert store.meta("k") == "v"
    store.clear()
    assert store.notes().count() == 0 and store.meta("k") is None and store.meta("schema_version") == "3"
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "store"), read_only=True).write("notes", store.notes())
    store.set_meta("schema_version", "9")
    with pytest.raises(ValueError):
        store.open()
    with pytest.raises(ValueError):
        search.search(store.notes(), store.chunks(), "")


def test_stream(spark, tmp_path):
    batch = spark.createDataFrame(
        [("a", None, "create", "2024-01-01 00:00:00"), ("a", None, "modify", "2024-01-01 00:00:01"), ("b", "c", "rename", "2024-01-01 00:00:05"), ("z", None, "create", "2024-01-01 01:00:00")],
        "path string, old_path string, type string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    got = []
    stream = changes.to_action(changes.debounce(changes.split_renames(changes.read_events(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " ")))))
    run = changes.apply_changes(stream, lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    run.awaitTermination(60)
    time.sleep(0.1)
    seen = {(r.path, r.type, r.action, r.events) for r in got}
    assert ("a", "modify", "index", 2) in seen and ("c", "delete", "remove", 1) in seen and ("b", "create", "index", 1) in seen


def test_index_run(spark, tmp_path):
    from tessera.plans import indexing

    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("# Alpha\nabout apples [[b]]")
    (folder / "b.md").write_text("# Beta\nabout bread")
    store, provider = Store(spark, str(tmp_path / "store")).open(), embedding.HashingProvider()
    read = lambda: markdown.read_notes(spark, str(folder))
    run = indexing.update(store, read(), provider, 10**13)
    assert (run.indexed, run.removed, run.hot) == (2, 0, 2)  # a links to b
    assert {r.path: r.title for r in store.notes().collect()} == {"a.md": "Alpha", "b.md": "Beta"}
    assert indexing.update(store, read(), provider, 10**13).indexed == 0
    (folder / "b.md").unlink()
    assert indexing.update(store, read(), provider, 10**13).removed == 1
    assert [r.path for r in store.notes().collect()] == ["a.md"] and store.chunks().count() == 1
    batch = spark.createDataFrame([("c.md", "index"), ("a.md", "remove")], "path string, action string")
    (folder / "c.md").write_text("# Gamma\nabout grapes")
    (folder / "d.md").write_text("# Delta\nabout dates")
    write = indexing.stream_writer(store, provider, lambda p: read().join(p, "path", "left_semi"), lambda: 10**13)
    write(batch, 0)
    write(batch, 0)
    assert [r.path for r in store.notes().collect()] == ["c.md"]
    write(spark.createDataFrame([("d.md", "index")], "path string, action string"), 1)
    assert store.read("picks", "src string, dst string, sim double, pick_rank int").select("src").collect()[0].src == "d.md"


def test_links_between_folders(spark):
    links = spark.createDataFrame([("a/One.md", "Two", 1), ("a/One.md", "b/Two", 2), ("b/Four.md", "two.md", 1), ("c/x.md", "Two", 1), ("a/One.md", "gone", 1)], "src string, dst string, n int")
    notes = spark.createDataFrame([("a/One.md",), ("a/Two.md",), ("b/Two.md",), ("b/Four.md",), ("c/x.md",)], "path string")
    found, lost = markdown.resolve_links(links, notes)
    assert {tuple(r) for r in found.collect()} == {("a/One.md", "a/Two.md", 1), ("a/One.md", "b/Two.md", 2), ("b/Four.md", "b/Two.md", 1), ("c/x.md", "a/Two.md", 1)}
    assert [tuple(r) for r in lost.collect()] == [("a/One.md", "gone", 1)]


def test_each_text_is_embedded_once_and_upgrades(spark, tmp_path):
    from tessera.plans import indexing

    class CountingProvider(embedding.HashingProvider):
        """Writes each text that it embeds to a folder."""

        def __init__(self, folder, policy=None):
            super().__init__()
            self.folder, self.chunk_policy = folder, policy

        def embed(self, texts):
            import os
            import uuid

            for _ in texts:
                open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
            return super().embed(texts)

    folder, calls = tmp_path / "notes", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    (folder / "a.md").write_text("# Alpha\n" + "apples and pears. " * 300)
    (folder / "long.md").write_text("word " * 14_000)
    store = Store(spark, str(tmp_path / "store")).open()
    read = lambda: markdown.read_notes(spark, str(folder))
    assert indexing.start(store, read(), CountingProvider(str(calls)), 1) == "bootstrap"
    indexing.update(store, read(), CountingProvider(str(calls)), 1)
    n = store.chunks().count()
    assert len(list(calls.iterdir())) == n > 30 and store.meta("chunk_policy") == "char2000-o100"
    assert sum(len(r.content) for r in store.chunks().filter("path = 'long.md'").collect()) > 69_000
    assert indexing.start(store, read(), CountingProvider(str(calls)), 2) == "caught-up" and len(list(calls.iterdir())) == n
    assert indexing.maintain_graph(store, 10**9, 0) and not indexing.maintain_graph(store, 10**9, 0)
    assert indexing.trusted_graph(store).count() == 2
    by_tokens = CountingProvider(str(calls), "512-50")
    indexing.update(store, read(), by_tokens, 10)
    assert store.meta("chunk_policy") == "512-50" and store.meta("chunk_target") is None
    assert all(by_tokens.count_tokens(r.content) <= 512 for r in store.chunks().collect()) and len(list(calls.iterdir())) == n + store.chunks().count()
    assert indexing.trusted_graph(store) is None
    assert indexing.update(store, read(), by_tokens, 11).indexed == 0


def test_describe_batch(spark, tmp_path):
    from tessera.plans import indexing

    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("# Alpha\nabout apples")
    (folder / "b.md").write_text("# Beta\nBROKEN")
    store = Store(spark, str(tmp_path / "store")).open()
    files = markdown.read_notes(spark, str(folder))
    indexing.update(store, files, embedding.HashingProvider(), 1)

    def ask(prompt):
        if "BROKEN" in prompt:
            raise OSError("no network")
        return '<think>hm</think>{"description": "On apples.", "tags": ["fruit"]}'

    assert indexing.describe_batch(store, files, ask) == 1
    assert {r.path: r.description for r in store.notes().collect()} == {"a.md": "On apples.", "b.md": None}
    assert indexing.cancellable(spark, "batch", lambda: spark.range(3).count()) == 3


def test_verbatim_snippet(spark):
    notes = spark.createDataFrame([("f/a", "Apples", None, "hot"), ("f/b", "Pears", None, "hot")], "path string, title string, description string, tier string")
    chunks = spark.createDataFrame([("f/a", 0, "Apples\ngreen and red"), ("f/a", 1, "Apples\nsome words, then the red apple pie"), ("f/b", 0, "Pears\npie of red pears")], "path string, chunk_index int, content string")
    got = search.search(notes, chunks.withColumn("vec", F.lit(None).cast("array<float>")), '"red apple"').collect()
    assert got[0].path == "f/a" and got[0].snippet.chunk_index == 1 and got[0].snippet.text == "some words, then the red apple pie"
    assert got[0].snippet.ranges[0].s == got[0].snippet.text.index("red apple")


def test_stored_index(spark, tmp_path):
    from tessera.operators import bm25

    docs = spark.createDataFrame([(f"d{i}", 0, f"spark word{i % 7} " + "fast " * (i % 3)) for i in range(60)], "path string, chunk_index int, content string")
    folder = str(tmp_path / "index")
    assert bm25.load_index(spark, folder, "1") is None
    bm25.save_index(bm25.build_index(docs), folder, "1", 8)
    assert bm25.load_index(spark, folder, "2") is None
    terms = bm25.query_terms(spark, "word3 fast absent")
    index = bm25.load_index(spark, folder, "1").read(terms)
    plan = index.postings._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and "PushedFilters: [In(term" in plan
    one = {r.path: round(r.score, 9) for r in bm25.score(index, terms).collect()}
    assert one == {r.path: round(r.score, 9) for r in bm25.score_text(docs, "word3 fast absent").collect()} and len(one) > 20
