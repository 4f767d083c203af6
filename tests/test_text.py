import pytest
from pyspark.sql import functions as F

from tessera.functions import text, udfs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_tokens(spark):
    assert one(spark, "小明在很好", text.tokenize) == ["小明在", "明在很", "在很好"]
    assert one(spark, "台北體育館", lambda c: text.tokenize(c, True)) == ["台北體", "北體育", "體育館", "台北", "北體", "體育", "育館"]
    assert one(spark, "台北", lambda c: text.tokenize(c, True)) == ["台北"]
    assert one(spark, "GPT-4 is ok", text.tokenize) == ["gpt-4", "is", "ok"]
    assert one(spark, "大😀家", text.tokenize) == ["大", "😀", "家"]
    assert one(spark, "", text.tokenize) == []
    folded = lambda c: text.tokenize(text.normalize_for_search(c, ("寫筆記", "写笔记")))
    assert one(spark, "使用 Obsidian 寫筆記", folded) == ["使用", "obsidian", "写笔记"]
    assert one(spark, "画", text.normalize_for_search) == "划"


def test_chunks(spark):
    cut = lambda body, size, overlap, title=None: [
        r.content for r in text.chunk_windows(spark.createDataFrame([(body, title)], "b string, t string"), "b", "t", size, overlap).orderBy("chunk_index").collect()
    ]
    assert cut("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert cut("abcdefghij", 4, 4) == ["abcd", "efgh", "ij"]
    assert cut("  ", 4, 1, "T") == ["T"]
    assert cut("abc", 4, 1, "T") == ["T\nabc"]


def test_denoise(spark):
    assert one(spark, "| a | b |\n|---|---|\n| c··d ─── e |\n\n\n\nx", text.denoise) == "a b\nc d e\n\nx"
    assert one(spark, "|--|", text.denoise) == ""
    assert one(spark, "plain", text.has_denoisable) is False


def test_frontmatter_and_titles(spark):
    assert one(spark, "---\na: b\n---\n  body ", text.strip_frontmatter) == "body"
    assert one(spark, "--- open", text.strip_frontmatter) == "--- open"
    assert one(spark, "[[a/b|c]]", text.unwrap_wikilink) == "c"
    assert one(spark, "[[a/b]]", text.unwrap_wikilink) == "b"
    assert one(spark, "20240101 Plan", lambda c: text.title_starts_with(c, "plan")) is True
    assert one(spark, "# A\n## Big Plan \n", lambda c: text.has_heading_line(c, "big plan")) is True
    assert one(spark, "```\n# big plan\n```", lambda c: text.has_heading_line(c, "big plan")) is False
    assert one(spark, "a cat-like", lambda c: text.contains_phrase(c, "cat")) is False


def test_small_functions(spark):
    assert one(spark, "台北 ab", text.display_width) == 7
    assert one(spark, "a `b`` c", text.markdown_safe) == "🔍 ```a `b`` c```"
    assert one(spark, "..a/b:c", text.safe_basename) == "a b c"
    assert one(spark, "", text.safe_basename) == "search"
    assert one(spark, "hello", text.djb2_hex) == "f923099"
    assert one(spark, "a/b/c.md", text.folder_of) == "a/b"
    assert one(spark, "c.md", text.group_of) == "/"
    assert text.expand_query("cat food", {"cat": ["feline", "cat"], "dog": ["x"]}) == "cat food feline"
    assert text.parse_verbatim_query('"a b"') == ("a b", True)
    assert text.parse_verbatim_query('"a"') is None


def test_chunk_prefix(spark):
    row = spark.createDataFrame([("T\nbody", "T"), ("T", "T"), ("x", "T")], "c string, t string")
    assert [r[0] for r in row.select(text.strip_chunk_prefix(F.col("c"), F.col("t"))).collect()] == ["body", "", "x"]


def test_jaro_winkler():
    close = lambda a, b: abs(a - b) < 1e-6
    assert close(udfs.jaro_winkler("martha", "marhta"), 0.961111)
    assert close(udfs.jaro_winkler("abcdef", "abzzzz"), 0.644444)
    assert close(udfs.jaro_winkler("台北車站", "台北車廂"), 0.883333)
    assert udfs.jaro_winkler("", "a") == 0 and udfs.jaro_winkler("a", "a") == 1


def test_token_chunks():
    count = lambda s: len(s)
    assert udfs.split_by_tokens("", "T", count) == ["T"]
    assert udfs.split_by_tokens("abc", "T", count, tokens=10) == ["T\nabc"]
    parts = udfs.split_by_tokens("aaaa. bbbb. cccc.", "", count, tokens=6, overlap=0)
    assert parts[0] == "aaaa." and all(len(p) <= 6 for p in parts) and "".join(parts) == "aaaa. bbbb. cccc."


def test_snippets():
    got = udfs.build_snippet(["fox"], 1, None, (0, "the quick  fox runs"), None, None)
    assert got["text"] == "the quick fox runs" and got["ranges"] == [{"s": 10, "e": 13}]
    assert udfs.build_snippet(["fox"], None, None, None, None, None) is None
    only = udfs.build_snippet(["fox"], 1, None, None, "a fox", None)
    assert only["source"] == "description" and only["anchor"] is None
    swapped = udfs.build_snippet(["fox"], None, 1, None, None, (2, "nothing here"))
    assert swapped["source"] == "semantic" and swapped["ranges"] == []


def test_anchors():
    content = "---\nfox\n---\none fox\ntwo fox"
    assert udfs.locate_anchor(content, "fox") == 3
    assert udfs.locate_anchor(content, "fox", 1, 2, 0.9) == 4
    assert udfs.anchor_match(content, "\nfox") is None
    assert udfs.locate_anchor_offset(content, "") is None


def test_llm_texts():
    assert udfs.sample_spread("short") == "short"
    long = udfs.sample_spread("x!" * 20_000, budget=100, parts=2)
    assert long.count("\n…\n") == 1 and len(long) < 300
    assert udfs.parse_generated('```json\n{"description": "d", "tags": "a, b"}\n```') == {"description": "d", "tags": ["a", "b"]}
    assert udfs.parse_generated("{broken") == {"description": "", "tags": None}
    assert udfs.parse_generated("plain")["description"] == "plain"
    assert udfs.strip_reasoning("<think>x</think> y") == "y"
    assert udfs.trim_description("A b. " * 200, 50).endswith(".")
    assert udfs.trim_description("x" * 600, 50) == "x" * 49 + "…"
    assert udfs.pick_group_label(["#a/B", "c"], None, {"c": 2}, {}) == "B · c"
    assert udfs.pick_group_label([], "This note describes cats", {}, {}) == "cats"


def test_related_section():
    assert udfs.insert_related_link("# A\n", "## R", "[[x]]") == "# A\n\n## R\n- [[x]]\n"
    assert udfs.insert_related_link("## R\n- [[y]]\n\n# B", "## R", "[[x]]") == "## R\n- [[y]]\n- [[x]]\n\n# B"
    assert udfs.insert_related_link("## R\n- [[x]]", "## R", "[[x]]") is None
    assert udfs.insert_related_link("```\ncode", "## R", "[[x]]") == "```\ncode\n```\n\n## R\n- [[x]]\n"


@pytest.mark.parametrize("name", ["token_chunks", "trim_descriptions", "sample_spread", "related_section"])
def test_long_texts_go_in_small_batches(spark, tmp_path, monkeypatch, name):
    """Batches of whole texts are bounded by bytes, not by rows alone."""
    from tessera.plans.catalog import QUERIES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(i, "A word. " * 12_500) for i in range(120)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        df = QUERIES[name](spark, str(tmp_path))
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
        seen = spark.sparkContext.accumulator(0)
        sizes = F.pandas_udf(lambda s: seen.add(len(s) > 60) or s, "string")
        spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.length(sizes("text"))).collect()
        assert seen.value == 0 and df.select("doc_id").distinct().count() == 120
    finally:
        spark.conf.set(key, before)
