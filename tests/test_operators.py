import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import bm25, canvas, cluster, dismissals, fusion, graph, heat, index, related


def near(a, b, e=1e-6):
    return abs(a - b) < e


def test_bm25(spark):
    docs = spark.createDataFrame([("a", 0, "spark fast spark"), ("b", 0, "fast slow"), ("c", 0, "quiet note here")], "path string, chunk_index int, content string")
    built = bm25.build_index(docs)
    for q, want in (("spark fast", {"a": 1.792035, "b": 0.529582}), ("fast", {"b": 0.529582, "a": 0.444974}), ("fast fast", {"b": 1.059163, "a": 0.889948})):
        for scores in (bm25.score(built, bm25.query_terms(spark, q)), bm25.score_text(docs, q)):
            got = {r.path: r.score for r in scores.collect()}
            assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)
    assert bm25.score_text(docs, "absent").count() == 0


def test_postings_arent_shuffled(spark, sf):
    """Terms are counted where their documents lie; document counts are combined by the term alone."""
    from tessera.plans.catalog import QUERIES

    for name in ("bm25_postings", "bm25_idf"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(path" not in plan and "hashpartitioning(term" in plan or name == "bm25_postings" and "Exchange" not in plan
    built = bm25.build_index(spark.createDataFrame([("a", 0, "x")], "path string, chunk_index int, content string"))
    assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString()


def test_terms_of_documents_in_several_rows(spark):
    docs = spark.createDataFrame(
        [("a", 0, "x y X"), ("a", 0, "x z w"), ("a", 1, None), ("b", 0, ""), ("c", 0, "漢字漢字 x"), ("d", 0, "-- É_x")], "path string, chunk_index int, content string"
    ).repartition(3)
    got = {(r.path, r.term): r.tf for r in bm25.term_counts(docs, bigrams=False).collect()}
    assert got == {("a", "x"): 3, ("a", "y"): 1, ("a", "z"): 1, ("a", "w"): 1, ("c", "x"): 1, ("c", "漢字漢"): 1, ("c", "字漢字"): 1, ("d", "--"): 1, ("d", "_x"): 1}
    assert {r.term: r.df for r in bm25.document_counts(docs).collect()}["x"] == 2


def test_pooling(spark):
    rows = spark.createDataFrame([("a", -1, 3.0), ("a", 0, 1.0), ("a", 1, 2.0)], "path string, chunk_index int, score double")
    r = bm25.pool_notes(rows).first()
    assert (r.score, r.chunk_index, r.real_chunk) == (3.0, -1, 1)


def test_fusion(spark):
    one = spark.createDataFrame([("x", 1), ("y", 2)], "path string, rank int")
    two = spark.createDataFrame([("y", 1)], "path string, rank int")
    got = {r.path: r.fused for r in fusion.fuse([(one, 1.0), (two, 1.0)]).collect()}
    assert near(got["x"], 0.0163934) and near(got["y"], 0.0325225)
    hit = {r.path: r.fused for r in fusion.boost(fusion.fuse([(one, 0.5)]), spark.createDataFrame([("z",), ("x",)], "path string")).collect()}
    assert near(hit["z"], 1 / 61) and near(hit["x"], 1.5 / 61)


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([3.0, 4.0], None), ([0.0, 0.0], None)], "b array<float>, d array<float>")
    got = [r[0] for r in rows.select(vector.compose(F.col("b"), F.col("d"))).collect()]
    assert np.allclose(got[0], [0.894427, 0.447214]) and np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]
    assert rows.select(vector.cosine(F.col("b"), F.array(F.lit(1.0)))).collect()[2][0] == 0
    assert vector.centroid(spark.createDataFrame([([float("nan")],)], "v array<float>"), "v").count() == 0


def _edges(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), s) for a, b, s in rows], "a string, b string, sim double")


def test_widest_path(spark):
    edges = _edges(spark, [("A", "E", 0.5), ("A", "B", 0.9), ("B", "C", 0.85), ("C", "E", 0.88)])
    r = graph.widest_path(edges, "A", "E").first()
    assert r.path == ["A", "B", "C", "E"] and near(r.bottleneck, 0.85) and r.hops == 3
    equal = _edges(spark, [("A", "B", 0.7), ("B", "C", 0.9), ("A", "C", 0.7)])
    assert graph.widest_path(equal, "A", "C").first().path == ["A", "C"]
    assert graph.widest_path(edges, "A", "Z").count() == 0
    assert near(graph.edge_percentile(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "sim double")).first()[0], 1.9)
    assert graph.edge_percentile(spark.createDataFrame([], "sim double")).first()[0] == 0
    assert graph.path_verdict(edges, "A", "Z").first().verdict == "none"


def test_knn_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"f{i % 3}/{i:03d}", [float(x) for x in v[i]]) for i in range(60)], "path string, vec array<float>")
    one = {(r.src, r.dst) for r in graph.knn_picks(rows, 4, 2).collect()}
    many = {(r.src, r.dst) for r in graph.knn_picks(rows, 4, 2, block=7).collect()}
    f = np.array([[float(np.float32(x)) for x in r] for r in v])
    want = set()
    for i in range(60):
        taken, own = [], 0
        for j in sorted((j for j in range(60) if j != i), key=lambda j: (-float(f[i] @ f[j]), f"f{j % 3}/{j:03d}")):
            if len(taken) == 4:
                break
            if j % 3 == i % 3:
                if own == 2:
                    continue
                own += 1
            taken.append(j)
        want |= {(f"f{i % 3}/{i:03d}", f"f{j % 3}/{j:03d}") for j in taken}
    assert one == many == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_knn_of_odd_vectors(spark, kind):
    """Many equal vectors, vectors of two lengths, of zeros, huge and tiny, large and single folders: as found one by one, ties by path."""
    rng = np.random.default_rng(5)
    f = ["a" if i < 50 else f"g{i % 11}" if i < 130 else f"own{i}" for i in range(150)]
    p = [f"{f[i]}/{(i * 7919) % 1000:04d}é" for i in range(150)]
    v = [rng.normal(size=8 if i % 7 else 3).astype(np.float32) for i in range(150)]
    for i in range(6, 150, 3):
        v[i] = v[3 * (i % 4 == 0)]
    v[10], v[11], v[13] = np.zeros(8, dtype=np.float32), v[11] * np.float32(1e18), v[13] * np.float32(1e-30)
    rows = spark.createDataFrame([(p[i], v[i].astype(float).tolist()) for i in range(150)], f"path string, vec array<{kind}>").repartition(5)
    in_turn = lambda a, b: functools.reduce(lambda s, t: s + float(t[0]) * float(t[1]), zip(a, b), 0.0)
    dots = [[in_turn(v[i], v[j]) if len(v[i]) == len(v[j]) else None for j in range(150)] for i in range(150)]
    for k, cap, block in ((10, 3, 2048), (4, None, 16), (3, 10, 33)):
        want = {}
        for i in range(150):
            own = n = 0
            for _, name, j in sorted((-dots[i][j], p[j], j) for j in range(150) if j != i and dots[i][j] is not None):
                own += f[i] == f[j]
                if n < k and (f[i] != f[j] or own <= (cap or k)):
                    n += 1
                    want[p[i], n] = (name, dots[i][j])
        assert {(r.src, r.pick_rank): (r.dst, r.sim) for r in graph.knn_picks(rows, k, cap, block=block).collect()} == want


def _tasks(spark, name, run):
    """The tasks of the largest stage."""
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s is not None)


def test_knn_is_spread(spark):
    """Few blocks still give every core some tasks: a group's share of the others can be divided too."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"f/{i}", rng.normal(size=4).tolist()) for i in range(300)], "path string, vec array<float>").coalesce(1)
    assert _tasks(spark, "spread", lambda: graph.knn_picks(rows, 3, 0, block=50).collect()) >= 24
    few = rows.filter("path < 'f/12'").select("path")
    picks = graph.knn_picks(rows, 3, 0, block=50)
    want = {(r.src, r.dst, r.sim) for r in picks.collect()}
    assert {(r.src, r.dst, r.sim) for r in graph.upsert_notes(rows, picks, few, 3, 0, block=50).collect()} == want


def test_knn_upkeep():
    assert graph.rebuild_due(5, 100, False, 0, 60_000) and not graph.rebuild_due(4, 100, False, 0, 60_000) and not graph.rebuild_due(9, 100, True, 1, 60_000)
    assert graph.trusted(3, 3) and not graph.trusted(None, 3) and graph.pack_watermark(5, [7, 6]) == 7


def test_tiers(spark):
    day = heat.DAY_MS
    rows = [(0, 100 * day, True, None), (0, 100 * day, False, 100 * day + 2000), (0, 100 * day, False, 100 * day + 2001), (95 * day, 0, False, None)]
    df = spark.createDataFrame(rows, "created long, mtime long, out boolean, own long")
    tier = heat.derive_tier(F.col("created"), F.col("mtime"), F.col("out"), F.lit(False), F.col("own"), 120 * day)
    assert [r[0] for r in df.select(tier).collect()] == ["hot", "cold", "hot", "hot"]


def test_wipe_guard_and_settings():
    assert not index.is_implausible_wipe(99, 100) and index.is_implausible_wipe(100, 200) and not index.is_implausible_wipe(100, 201)
    s = index.clean_settings({"top_results": float("nan"), "desc_weight": 7, "hot_days": -1, "weights": {"a": 1, "b": float("inf")}})
    assert s["top_results"] == 10 and s["desc_weight"] == 1 and s["hot_days"] == 90 and s["weights"] == {"a": 1}


def test_upgrades():
    t, fresh = index.plan_upgrade(None, "tok", 5)
    assert str(t) == "tok@5#0" and fresh
    assert index.plan_upgrade("tok@3", "tok", 9) == (index.ChunkTarget("tok", 3, 0), False)
    assert index.finish_upgrade(0, None, "tok", t, 5, True, False) == {"stamp": True, "clear_target": True, "target": None, "give_up": False}
    assert index.finish_upgrade(1, None, "tok", t, 5, True, False)["target"] == "tok@5#1"
    assert index.finish_upgrade(1, None, "tok", index.ChunkTarget("tok", 5, 2), 5, True, False)["give_up"]
    assert index.finish_upgrade(1, None, "tok", index.ChunkTarget("tok", 5, 2), 5, True, True)["target"] == "tok@5#2"
    assert index.chunk_upgrade_state(None, None) == "stamp-only" and index.chunk_upgrade_state("x", None) == "reembed" and index.chunk_upgrade_state("char2000-o100", None) == "none"


def test_index_tables(spark):
    notes = spark.createDataFrame([("a", None), ("b", "x" * 499), ("c", "fine.")], "path string, description string")
    assert {r.path for r in index.eligible_for_description(notes).collect()} == {"a", "b"}
    new = spark.createDataFrame([("a", None, "made"), ("c", "other", "made")], "path string, expected string, description string")
    assert {r.path: r.description for r in index.apply_descriptions(notes, new).collect()}["a"] == "made"
    assert {r.path: r.description for r in index.apply_descriptions(notes, new).collect()}["c"] == "fine."
    due, over = index.catch_up(notes.select("path"), ["b"], 1)
    assert over and due.count() == 2


def test_dismissals(spark):
    pairs = spark.createDataFrame([("a/x", "b", 5), ("b", "c/x", 3)], "a string, b string, dismissed_at int")
    got = dismissals.rename_pairs(pairs, "a", "c").collect()
    assert [(r.a, r.b, r.dismissed_at) for r in got] == [("b", "c/x", 3)]
    assert dismissals.delete_pairs(pairs, "a").count() == 1


def test_profile_fallback(spark):
    rows = spark.createDataFrame([("a", 1, ["t"], False), ("b", 2, ["t"], False), ("c", 3, [], True)], "path string, judged_at int, tags array<string>, exempt boolean")
    got = related.build_profile(rows, related.tag_counts(rows), 3).orderBy("position").collect()
    assert [r.path for r in got] == ["b", "a"] and all(r.tags == [] for r in got)


def test_folder_cap(spark):
    rows = spark.createDataFrame([("f/1", 1), ("f/2", 2), ("g/3", 3), ("f/4", 4)], "path string, position int")
    assert [r.path for r in related.cap_folder(rows, "f", 1).orderBy("position").collect()] == ["f/1", "g/3"]


def test_hdbscan():
    line = np.stack([np.arange(15) * 0.1, np.zeros(15)], axis=1)
    pts = np.concatenate([line + c for c in ((0, 0), (5, 5), (0, 9))] + [np.array([[20.0, -20.0]])])
    labels = cluster.hdbscan(pts, 3)
    assert len(set(labels[:15])) == len(set(labels[15:30])) == len(set(labels[30:45])) == 1
    assert len(set(labels[:45])) == 3 and labels[45] == -1
    assert cluster.hdbscan(np.zeros((1, 2)), 2).tolist() == [-1]
    assert [cluster.size_gate(n) for n in (4, 5, 50, 51, 101)] == ["block", "ok", "ok", "warn", "block"]
    assert [cluster.min_cluster_size(n) for n in (39, 40, 100)] == [2, 3, 4] and cluster.is_flat({-1, 0})


def _board():
    node = {"id": "n", "type": "file", "file": "a.md", "x": 0, "y": 0, "width": 400, "height": 360}
    return {"nodes": [node], "edges": []}


def test_expand_canvas():
    got = canvas.expand_canvas(_board(), "a.md", [{"path": "b.md", "tier": "cold", "score": 0.5}, {"path": "c.md", "tier": "hot", "score": 0.4}], {("a.md", "b.md"): 1})
    assert got["added"] == 2 and got["parked_ids"] == []
    b, c = got["canvas"]["nodes"][1:]
    assert b["color"] == "5" and "color" not in c
    e1, e2 = got["canvas"]["edges"]
    assert e1["toEnd"] == "arrow" and "color" not in e1 and e2["color"] == "6" and e1["label"] == "0.50"
    again = canvas.expand_canvas(got["canvas"], "b.md", [{"path": "c.md", "tier": "hot", "score": 0.3}], {})
    assert again["added"] == 0 and again["linked_existing"] == 1
    assert [n.get("color") for n in again["canvas"]["nodes"]][2] == "2"  # two edges lead to c
    with pytest.raises(ValueError):
        canvas.expand_canvas(_board(), "z.md", [], {})


def test_promote_and_groups():
    board = canvas.expand_canvas(_board(), "a.md", [{"path": "b.md", "score": 0.5}], {})["canvas"]
    new, n = canvas.promote_edges(board, [("b.md", "a.md")], False)
    assert n == 1 and new["edges"][0]["fromEnd"] == "arrow" and "color" not in new["edges"][0]
    framed = canvas.add_groups(board, lambda f: "L" if f == "a.md" else None)
    assert [x["type"] for x in framed["nodes"]] == ["group", "file", "file"] and framed["nodes"][0]["width"] == 460
    assert canvas.unique_name("x", {"x.canvas"}) == "x-2.canvas"


def test_path_board(spark):
    chain = spark.createDataFrame([(0, "a", "hot", 0.9), (1, "b", "cold", 0.8), (2, "c", "hot", None)], "position int, path string, tier string, sim double")
    nodes, edges = canvas.path_board(chain, canvas.empty_links(spark))
    assert [r.color for r in nodes.orderBy("position").collect()] == ["4", "5", "4"]
    assert [r.label for r in edges.orderBy("position").collect()] == ["0.90", "0.80"]


def test_global_rank(spark):
    from tessera.functions.ranking import global_rank

    rows = spark.range(2000).select(F.col("id").cast("string").alias("path"), ((F.col("id") * 7919) % 301 / 7).alias("score"))
    one = {r.path: r["rank"] for r in global_rank(rows, "score", "path").collect()}
    many = {r.path: r["rank"] for r in global_rank(rows, "score", "path", single=10, bucket_rows=150).collect()}
    assert one == many and sorted(one.values()) == list(range(1, 2001))
    flat = rows.withColumn("score", F.lit(1.0))
    assert sorted(r["rank"] for r in global_rank(flat, "score", "path", single=10, bucket_rows=150).collect()) == list(range(1, 2001))


def test_percentile_by_ranges(spark):
    """Exact whatever the number of values that is walked, with many ties too."""
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3000), np.repeat([0.1, 0.5, 0.5, 0.9], 700), rng.integers(0, 5, 2500) / 5):
        df = spark.createDataFrame([(float(x),) for x in values], "sim double")
        for percent in (0, 45, 50.5, 99.9, 100):
            assert near(graph.edge_percentile(df, percent, most=50).first()[0], float(np.percentile(values, percent)))


def _counted(spark, edges, columns):
    """The edges, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return edges.mapInArrow(count, columns), seen


def test_percentile_computes_its_edges_once(spark):
    edges, seen = _counted(spark, spark.range(3000).select((F.col("id") * 7919 % 3001 / 7).alias("sim")), "sim double")
    assert near(graph.edge_percentile(edges, 45, most=50).first()[0], float(np.percentile([i * 7919 % 3001 / 7 for i in range(3000)], 45))) and seen.value == 3000


def test_paths_compute_their_edges_once(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1 - i / 500) for i in range(200)], "a string, b string, sim double")
    for run, want in ((graph.widest_path, ["n000", "n001", "n002", "n003"]), (graph.path_verdict, "strong")):
        edges, seen = _counted(spark, chain, chain.schema)
        assert run(edges, "n000", "n003").first()[0] == want and seen.value == 200


def test_contents_fall_back(spark):
    rows = [(f"n{i}", f"T{i}", "hot", [float(i % 2), float(i) / 100], 1.0 - i / 50) for i in range(12)]
    df = spark.createDataFrame(rows, "path string, title string, tier string, vec array<float>, score double")
    clustered = cluster.cluster_vectors(df)
    named = cluster.contents(clustered, "q", lambda titles: f"Topic of {len(titles)}").first()[0]
    assert named.startswith("# q") and "## Topic of 6" in named
    one = df.withColumn("label", F.lit(-1).cast("long"))
    assert cluster.contents(one, "q").first()[0].startswith("## Hot")
    with pytest.raises(ValueError):
        cluster.cluster_vectors(spark.range(101).select(F.col("id").cast("string").alias("path"), F.array(F.lit(1.0)).alias("vec")))


def test_expand_canvas_parks():
    board = canvas.expand_canvas(_board(), "a.md", [{"path": f"n{i}.md", "score": None} for i in range(200)], {})
    assert board["added"] == 200 and len(board["parked_ids"]) > 0 and board["canvas"]["edges"][0]["label"] == "–"
    boxes = [(n["x"], n["y"]) for n in board["canvas"]["nodes"] if n["id"] not in board["parked_ids"]]
    assert all(abs(a - c) >= 500 or abs(b - d) >= 460 for i, (a, b) in enumerate(boxes) for c, d in boxes[:i])
