"""The catalogue: one query for each operator over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, udfs, vector
from tessera.operators import bm25, canvas, cluster, dismissals, fusion, graph, heat, index, related, search
from tessera.sources import adapters
from tessera.sources.scratch import scratch_dir, stored
from tessera.sources.adapters import NOW_MS, table
from tessera.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

QUERY = "the error of tion"
REPEATED = "the tion tion"
ANCHOR = 0

#: The path of a document in SQL, and its tokens.
_PATH = "source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"
_TOKENS = "list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_-]+'), lambda x: lower(x))"
_VPATH = "'l' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0')"
_VECS = f"vecs AS (SELECT {_VPATH} AS path, 'l' || CAST(label AS VARCHAR) AS folder, vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'cold' ELSE 'hot' END AS tier, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _bm25_sql(words: str, docs: str, tail: str) -> str:
    """BM25 in SQL over docs(path, chunk_index, t), for the query's words with their counts."""
    return f"""
WITH docs AS ({docs}),
q(term, qtf) AS (VALUES {words}),
st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM docs),
tf AS (SELECT path, chunk_index, len(t) AS dl, term, qtf, len(list_filter(t, lambda x: x = term)) AS tf FROM docs, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
sc AS (
  SELECT path, chunk_index, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY path, chunk_index)
{tail}"""


_DOCS_SQL = f"SELECT {_PATH} AS path, 0 AS chunk_index, {_TOKENS.format('text')} AS t FROM documents"
_CHUNK_SQL = f"""SELECT path, chunk_index, substr(b, CAST(chunk_index * 1900 + 1 AS BIGINT), 2000) AS content FROM (
  SELECT path, b, unnest(generate_series(0, CASE WHEN length(b) <= 2000 THEN 0 ELSE CAST(ceil((length(b) - 2000) / 1900.0) AS BIGINT) END)) AS chunk_index
  FROM (SELECT {_PATH} AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents WHERE text IS NOT NULL))"""
_WORDS = "('the', 1), ('error', 1), ('of', 1), ('tion', 1)"
_TOP = "SELECT path, round(score, 6) AS score FROM sc ORDER BY score DESC, path, chunk_index LIMIT 10"


# Keyword ranking


@query(f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf):
    rows = adapters.documents(spark, sf).select(F.explode(text.query_tokens(F.col("content"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT path, len(t)::BIGINT AS dl FROM ({_DOCS_SQL})")
def bm25_doc_stats(spark, sf):
    return bm25.doc_lengths(adapters.documents(spark, sf)).select("path", F.col("dl").cast("long").alias("dl"))


@query(f"SELECT count(*)::BIGINT AS n_docs, round(sum(len(t)) / count(*), 6) AS avgdl FROM ({_DOCS_SQL})")
def bm25_corpus_stats(spark, sf):
    return bm25.corpus_stats(bm25.doc_lengths(adapters.documents(spark, sf))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT path, term, least(count(*), 65535)::BIGINT AS tf FROM (SELECT path, unnest(t) AS term FROM ({_DOCS_SQL})) GROUP BY path, term")
def bm25_postings(spark, sf):
    return bm25.term_counts(adapters.documents(spark, sf)).select("path", "term", F.col("tf").cast("long").alias("tf"))


@query(f"""
WITH d AS ({_DOCS_SQL}), n AS (SELECT count(*) AS n FROM d), x AS (SELECT term, count(DISTINCT path) AS df FROM (SELECT path, unnest(t) AS term FROM d) GROUP BY term)
SELECT term, df::BIGINT AS df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM x, n""")
def bm25_idf(spark, sf):
    docs = adapters.documents(spark, sf)
    found = bm25.with_idf(bm25.document_counts(docs), bm25.corpus_stats(bm25.doc_lengths(docs)))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_bm25_sql(_WORDS, _DOCS_SQL, _TOP))
def bm25_topk(spark, sf):
    return bm25.top(bm25.score_text(adapters.documents(spark, sf), QUERY), 10).select("path", F.round("score", 6).alias("score"))


@query(_bm25_sql(_WORDS, _DOCS_SQL, _TOP))
def bm25_topk_indexed(spark, sf):
    folder = f"{scratch_dir(spark)}/bm25-{uuid.uuid4().hex}"
    bm25.save_index(bm25.build_index(adapters.documents(spark, sf)), folder, sf)
    terms = bm25.query_terms(spark, QUERY)
    return bm25.top(bm25.score(bm25.load_index(spark, folder, sf).read(terms), terms), 10).select("path", F.round("score", 6).alias("score"))


@query(_bm25_sql("('the', 1), ('tion', 2)", _DOCS_SQL, _TOP))
def bm25_query_tf_weight(spark, sf):
    return bm25.top(bm25.score_text(adapters.documents(spark, sf), REPEATED), 10).select("path", F.round("score", 6).alias("score"))


@query(_bm25_sql(_WORDS, f"SELECT path, chunk_index, {_TOKENS.format('content')} AS t FROM ({_CHUNK_SQL})", """
, top AS (SELECT * FROM sc ORDER BY score DESC, path, chunk_index LIMIT 100)
SELECT path, round(max(score), 6) AS score, arg_max(chunk_index, score)::BIGINT AS chunk_index FROM top GROUP BY path""").replace("\n\n, top", "\n, top"))
def bm25_maxpool_note(spark, sf):
    best = bm25.pool_notes(bm25.top(bm25.score_text(adapters.chunks(spark, sf), QUERY), 100))
    return best.select("path", F.round("score", 6).alias("score"), F.col("chunk_index").cast("long").alias("chunk_index"))


# Text


@query(f"SELECT path, chunk_index::BIGINT AS chunk_index, length(content)::BIGINT AS n, md5(content) AS digest FROM ({_CHUNK_SQL})")
def chunk_fixed_windows(spark, sf):
    rows = adapters.chunks(spark, sf)
    return rows.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(string_split(text, chr(10)),
  lambda x: NOT regexp_matches(x, '^\s*\|[\s\-:|]+\|\s*$')),
  lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\||[\x{2500}-\x{259F}]+|\x{00B7}{2,}', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS digest FROM documents""")
def denoise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.denoise(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\||[\x{2500}-\x{259F}]+|\x{00B7}{2,}')")
def has_denoisable(spark, sf):
    return table(spark, sf, "documents").filter(text.has_denoisable(F.col("text"))).select("doc_id")


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def frontmatter_strip(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("---\ntitle: "), "lang", F.lit("\n---\n"), "text").alias("c"))
    return rows.select("doc_id", F.md5(text.strip_frontmatter(F.col("c"))).alias("digest"))


@query("SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest FROM documents")
def fold_ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_ascii(F.col("text"))).alias("digest"))


@query(f"SELECT {_PATH} AS path, source AS folder, source AS grp FROM documents")
def folder_and_group(spark, sf):
    rows = table(spark, sf, "documents").select(adapters.doc_path().alias("path"))
    return rows.select("path", text.folder_of(F.col("path")).alias("folder"), text.group_of(F.col("path")).alias("grp"))


@query("SELECT doc_id, round(w, 6) AS w FROM (SELECT doc_id, length(text) - length(regexp_replace(text, '[^A-Za-z \\n\\t]', '', 'g')) + 0.3::DOUBLE * length(regexp_replace(text, '[^A-Za-z \\n\\t]', '', 'g')) AS w FROM documents)")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(text.estimate_tokens(F.col("text")), 6).alias("w"))


@query("SELECT doc_id, length(text)::BIGINT AS w FROM documents")
def display_width(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.display_width(F.col("text")).cast("long").alias("w"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\((?:https?:|obsidian:)[^)]*\)', '\1', 'g'), '<https?:[^>]*>', '', 'g'), 'https?://[\x21-\x7E]+', '', 'g'),
  '\[\s*\]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM pages WHERE NOT regexp_matches(html, '[Dd][Aa][Tt][Aa]:')""")
def strip_urls(spark, sf):
    # The SQL has no step for data URLs and leaves such pages (and null ones) out; the query gives every page.
    return table(spark, sf, "pages").select("page_id", F.md5(text.strip_urls(F.col("html"))).alias("digest"))


@query("""SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ' || p_brand || ',, x', ','), lambda x: trim(x)), lambda x: x != '') AS tags FROM part""")
def parse_tags(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.parse_tags(F.concat("p_type", F.lit(", "), "p_brand", F.lit(",, x"))).alias("tags"))


@query("""SELECT p_partkey, list_filter(string_split_regex(p_name || '、' || p_brand, '[\\s,、，]+'), lambda x: x != '') AS tags FROM part""")
def coerce_tags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.coerce_tag_list(F.concat("p_name", F.lit("、"), "p_brand")).alias("tags"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) = lower(p_brand) THEN NULL ELSE [p_brand, p_type] END AS tags FROM part""")
def merge_tags(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.merge_tags(F.array("p_brand"), F.array(F.lower("p_brand"), F.col("p_type"))).alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_name END AS q FROM part")
def pseudo_query(spark, sf):
    tags = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", text.pseudo_query(F.col("p_name"), tags).alias("q"))


@query("SELECT doc_id FROM documents WHERE starts_with(lower(regexp_replace(text, '^\\s+', '')), 'the')")
def title_prefix(spark, sf):
    return table(spark, sf, "documents").filter(text.title_starts_with(F.col("text"), "The")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9_-])with($|[^a-z0-9_-])')")
def contains_phrase(spark, sf):
    return table(spark, sf, "documents").filter(text.contains_phrase(F.col("text"), "With")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND starts_with(text, 'The ')")
def heading_line(spark, sf):
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## "), F.substring("text", 1, 4), F.lit("\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").filter(text.has_heading_line(marked, "The")).select("doc_id")


@query("SELECT s_suppkey, printf('%.2f', s_acctbal) AS shown FROM supplier")
def format_score(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.format_score(F.col("s_acctbal")).alias("shown"))


@query("""SELECT p_partkey, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (a * 33 + x) % 4294967296))) AS h FROM part""")
def djb2_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.djb2_hex(F.col("p_name")).alias("h"))


@query("SELECT doc_id, substr(text, 1, 499) AS description FROM documents WHERE length(text) >= 499 AND NOT contains('。！？.!?」』）\"''”’)…', right(regexp_replace(substr(text, 1, 499), '\\s+$', ''), 1))")
def legacy_truncated(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 499).alias("description"))
    return rows.filter(text.is_legacy_truncated(F.col("description")))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) = lower('goldenrod') THEN 0.25 WHEN contains(lower(p_name), 'e b') THEN 0.15
  ELSE round((contains(lower(p_name), 'e')::INT + contains(lower(p_name), 'b')::INT) / 2.0::DOUBLE * 0.08, 6) END::DOUBLE AS boost FROM part""")
def title_boost(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(text.title_boost("e b", F.col("p_name")), 6).alias("boost"))


# Vectors


@query(f"""WITH {_VECS}, q AS (SELECT v FROM vecs WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(vecs.v, q.v) / (sqrt(list_inner_product(vecs.v, vecs.v)) * sqrt(list_inner_product(q.v, q.v))), 6) AS score FROM vecs, q WHERE vec_id != 0
ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    own = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = rows.filter("vec_id != 0").crossJoin(F.broadcast(own)).select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query("SELECT vec_id, round(sqrt(list_inner_product(w, w)), 6) AS n, round(w[1], 5) AS x FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * 3 / sqrt(9 * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS w FROM embeddings)")
def l2_normalize_check(spark, sf):
    unit = vector.l2_normalize(F.transform("embedding", lambda x: (x * 3).cast("float")))
    return table(spark, sf, "embeddings").select("vec_id", unit.alias("w")).select("vec_id", F.round(vector.norm(F.col("w")), 6).alias("n"), F.round(F.col("w")[0].cast("double"), 5).alias("x"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.v AS body, b.v AS other FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0),
u AS (SELECT vec_id, list_transform(body, lambda x: x / sqrt(list_inner_product(body, body))) AS b, list_transform(other, lambda x: x / sqrt(list_inner_product(other, other))) AS o FROM d),
m AS (SELECT vec_id, CASE WHEN o IS NULL THEN b ELSE list_transform(list_zip(b, o), lambda p: 0.5::DOUBLE * p[1] + 0.5::DOUBLE * p[2]) END AS w FROM u)
SELECT vec_id, round(w[1] / sqrt(list_inner_product(w, w)), 4) AS first, round(w[64] / sqrt(list_inner_product(w, w)), 4) AS last FROM m""")
def compose_vec(spark, sf):
    rows = table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")).filter("vec_id % 2 = 0")
    made = rows.join(other, "vec_id", "left").select("vec_id", vector.compose(F.col("embedding"), F.col("o")).alias("w"))
    return made.select("vec_id", F.round(F.col("w")[0].cast("double"), 4).alias("first"), F.round(F.col("w")[63].cast("double"), 4).alias("last"))


@query("SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def mean_pool_by_label(spark, sf):
    pooled = vector.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("""WITH s AS (SELECT pos, sum(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id < 20) GROUP BY pos)
SELECT pos::BIGINT AS pos, round(x / (SELECT sqrt(sum(x * x)) FROM s), 5) AS x FROM s""")
def profile_centroid(spark, sf):
    one = vector.centroid(table(spark, sf, "embeddings").filter("vec_id < 20"), "embedding")
    return one.select(F.posexplode("embedding").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT len(v)::BIGINT AS dim, count(*)::BIGINT AS n FROM (SELECT CASE WHEN vec_id % 5 = 0 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings) GROUP BY 1 ORDER BY n DESC, dim LIMIT 1")
def majority_dim(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("v"))
    return vector.majority_dim(rows, "v").select(F.col("dim").cast("long").alias("dim"), "n")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS c FROM embeddings, q)
SELECT CAST(label AS VARCHAR) AS path, round(max(c) - 0.02 * ln(count(*)), 6) AS score, count(*)::BIGINT AS chunks FROM s GROUP BY label""")
def semantic_chunk_penalty(spark, sf):
    rows = table(spark, sf, "embeddings")
    q = rows.filter("vec_id = 0").select("embedding").first()[0]
    chunks = rows.select(F.col("label").cast("string").alias("path"), F.col("vec_id").cast("int").alias("chunk_index"), F.col("embedding").alias("vec"))
    return search.semantic_scores(chunks, q).select("path", F.round("score", 6).alias("score"), "chunks")


# Fusion


def _two_legs(spark, sf):
    """Keyword ranks of the best 100 documents, and cosine ranks of the notes with vectors, by document number."""
    kw = bm25.top(bm25.score_text(adapters.documents(spark, sf), QUERY), 100)
    kw = fusion.rank_map(kw.select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("long").alias("path"), "score"))
    rows = table(spark, sf, "embeddings")
    own = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    sem = rows.filter("vec_id != 0").crossJoin(F.broadcast(own)).select(F.col("vec_id").alias("path"), F.round(vector.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    return kw, fusion.rank_map(sem)


_LEGS = """
, kw AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM (SELECT CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS doc, score FROM sc ORDER BY score DESC, path LIMIT 100)),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sem AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY round(list_inner_product(v, (SELECT v FROM e WHERE vec_id = 0)), 9) DESC, vec_id) AS rank FROM e WHERE vec_id != 0),
parts AS (SELECT doc, {0}::DOUBLE / (60 + rank) AS s FROM kw UNION ALL SELECT doc, {1}::DOUBLE / (60 + rank) FROM sem {2})
SELECT doc AS path, round(sum(s), 8) AS fused FROM parts GROUP BY doc ORDER BY fused DESC, path LIMIT 30"""


@query(_bm25_sql(_WORDS, _DOCS_SQL, _LEGS.format("1.0", "1.0", "")))
def rrf_fuse_two_legs(spark, sf):
    kw, sem = _two_legs(spark, sf)
    return fusion.top_n(fusion.fuse([(kw, 1.0), (sem, 1.0)]).select("path", F.round("fused", 8).alias("fused")), 30)


@query(_bm25_sql(_WORDS, _DOCS_SQL, _LEGS.format("0.5", "2.0", "")))
def rrf_weighted(spark, sf):
    kw, sem = _two_legs(spark, sf)
    return fusion.top_n(fusion.fuse([(kw, 0.5), (sem, 2.0)]).select("path", F.round("fused", 8).alias("fused")), 30)


@query(_bm25_sql(_WORDS, _DOCS_SQL, _LEGS.format("1.0", "1.0", "UNION ALL SELECT doc_id, 1.0::DOUBLE / 61 FROM documents WHERE doc_id % 100 = 7")))
def verbatim_boost(spark, sf):
    kw, sem = _two_legs(spark, sf)
    hits = table(spark, sf, "documents").filter("doc_id % 100 = 7").select(F.col("doc_id").alias("path"))
    return fusion.top_n(fusion.boost(fusion.fuse([(kw, 1.0), (sem, 1.0)]), hits).select("path", F.round("fused", 8).alias("fused")), 30)


# Related notes

_COS = f"""
WITH {_VECS}, q AS (SELECT * FROM vecs WHERE vec_id = 0),
kw AS (SELECT path, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM vecs WHERE vec_id % 7 = 0 AND vec_id != 0),
cs AS (SELECT vecs.path, vecs.folder, vecs.tier, list_inner_product(vecs.v, q.v) AS score FROM vecs, q WHERE vecs.vec_id != 0),
ck AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS cos_rank FROM cs WHERE score >= {{0}}),
fu AS (SELECT ck.*, 1.0::DOUBLE / (60 + cos_rank) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0) AS fused FROM ck LEFT JOIN kw USING (path)),
po AS (SELECT *, row_number() OVER (ORDER BY cos_rank > 100, CASE WHEN cos_rank <= 100 THEN -fused END, cos_rank) AS position FROM fu)
"""


def _keyword_stub(spark, sf) -> DataFrame:
    rows = adapters.vectors(spark, sf).filter("vec_id % 7 = 0 AND vec_id != 0")
    return rows.select("path", F.row_number().over(Window.orderBy(F.desc("vec_id"))).alias("rank"))


def _anchor(spark, sf) -> str:
    return adapters.vectors(spark, sf).filter("vec_id = 0").first().path


@query(_COS.format("0.0") + "SELECT path, round(score, 6) AS score, round(fused, 8) AS fused, cos_rank::BIGINT AS cos_rank, position::BIGINT AS position FROM po")
def related_fused(spark, sf):
    ranked = related.cosine_ranked(adapters.vectors(spark, sf), _anchor(spark, sf), 0.0)
    out = fusion.order_pool(fusion.fuse_keyword_ranks(ranked, _keyword_stub(spark, sf)))
    return out.select("path", F.round("score", 6).alias("score"), F.round("fused", 8).alias("fused"), F.col("cos_rank").cast("long").alias("cos_rank"), F.col("position").cast("long").alias("position"))


@query(_COS.format("0.0") + """, ca AS (SELECT *, row_number() OVER (PARTITION BY folder = (SELECT folder FROM q) ORDER BY position) AS nth FROM po)
SELECT path, tier, round(score, 6) AS score, row_number() OVER (ORDER BY position)::BIGINT AS position FROM ca WHERE folder != (SELECT folder FROM q) OR nth <= 3 ORDER BY position LIMIT 10""")
def find_similar_capped(spark, sf):
    out = related.find_similar(adapters.vectors(spark, sf), _anchor(spark, sf), _keyword_stub(spark, sf), 0.0)
    return out.select("path", "tier", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query(_COS.format("0.0") + "SELECT path, tier, round(score, 6) AS score, position::BIGINT AS position FROM po ORDER BY position LIMIT 10")
def discover_related(spark, sf):
    out = related.discover(adapters.vectors(spark, sf), _anchor(spark, sf), _keyword_stub(spark, sf), 0.0)
    return out.select("path", "tier", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query(_COS.format("0.0") + """, ke AS (SELECT * FROM po WHERE position % 2 = 0)
SELECT path, round(score, 6) AS score, row_number() OVER (ORDER BY position)::BIGINT AS position FROM ke ORDER BY position LIMIT 10""")
def dismissed_pairs(spark, sf):
    notes, anchor = adapters.vectors(spark, sf), _anchor(spark, sf)
    ranked = fusion.order_pool(fusion.fuse_keyword_ranks(related.cosine_ranked(notes, anchor, 0.0), _keyword_stub(spark, sf)))
    gone = ranked.filter("position % 2 = 1").select(*[c.alias(n) for c, n in zip(dismissals.pair(F.lit(anchor), F.col("path")), "ab", strict=True)])
    out = related.discover(notes, anchor, _keyword_stub(spark, sf), 0.0, dismissed=gone)
    return out.select("path", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@query(f"WITH {_VECS} SELECT path FROM vecs WHERE vec_id % 3 != 0")
def dismissed_notes(spark, sf):
    rows = adapters.vectors(spark, sf)
    return dismissals.drop_notes(rows, rows.filter("vec_id % 3 = 0")).select("path")


@query(_bm25_sql(_WORDS, f"SELECT path, chunk_index, {_TOKENS.format('content')} AS t FROM ({_CHUNK_SQL})", """
, hits AS (SELECT path, row_number() OVER (ORDER BY score DESC, path, chunk_index) AS position FROM sc ORDER BY score DESC, path, chunk_index LIMIT 500)
SELECT path, row_number() OVER (ORDER BY min(position))::BIGINT AS rank FROM hits WHERE path != 'src1/00000001' GROUP BY path"""))
def keyword_ranks(spark, sf):
    return search.keyword_ranks(adapters.chunks(spark, sf), QUERY, "src1/00000001").select("path", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_VECS}, c AS (SELECT pos, sum(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vecs WHERE vec_id < 20) GROUP BY pos),
cv AS (SELECT list(CAST(CAST(x / (SELECT sqrt(sum(x * x)) FROM c) AS FLOAT) AS DOUBLE) ORDER BY pos) AS v FROM c),
s AS (SELECT path, folder AS grp, list_inner_product(vecs.v, cv.v) AS score FROM vecs, cv WHERE tier = 'cold'),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, path) AS cos_rank FROM s WHERE score >= 0.05),
kw AS (SELECT path, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM vecs WHERE vec_id % 7 = 0 AND vec_id != 0),
f AS (SELECT n.*, 1.0::DOUBLE / (60 + cos_rank) + coalesce(1.0::DOUBLE / (60 + rank), 0) AS fused FROM n LEFT JOIN kw USING (path) WHERE cos_rank <= 20),
t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY fused DESC, cos_rank) AS position FROM f),
b AS (SELECT *, max(score) OVER (PARTITION BY grp) AS best FROM t WHERE position <= 3)
SELECT dense_rank() OVER (ORDER BY best DESC, grp)::BIGINT AS group_position, grp, position::BIGINT AS position, path, round(score, 5) AS score FROM b""")
def grouped_discover(spark, sf):
    rows = adapters.vectors(spark, sf)
    out = related.grouped_rank(rows.filter("tier = 'cold'"), vector.centroid(rows.filter("vec_id < 20"), "vec"), _keyword_stub(spark, sf), 0.05)
    return out.select(F.col("group_position").cast("long").alias("group_position"), "grp", F.col("position").cast("long").alias("position"), "path", F.round("score", 5).alias("score"))


def _judged(spark, sf) -> DataFrame:
    """Users as notes: judged at their last event, tagged with the types of their events and a rare tag of their own."""
    rows = table(spark, sf, "events").filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max("ts").alias("last"), F.collect_set("event_type").alias("types"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    own = F.when(F.col("user_id") % 4 == 0, F.array(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select(path.alias("path"), F.unix_millis(F.col("last").cast("timestamp")).alias("judged_at"), F.concat("types", own).alias("tags"), (F.col("user_id") % 10 == 0).alias("exempt"))


_JUDGED = """WITH j AS (SELECT 'u' || user_id AS path, user_id, epoch_ms(max(ts)) AS judged_at, list_concat(list_sort(list_distinct(list(event_type))), CASE WHEN user_id % 4 = 0 THEN ['k' || (user_id % 50)] ELSE [] END) AS tags FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
t AS (SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM j) GROUP BY 1)"""


@query(_JUDGED + " SELECT tag, n::BIGINT AS n FROM t")
def tag_counts(spark, sf):
    return related.tag_counts(_judged(spark, sf))


@query(_JUDGED + " SELECT tag, n::BIGINT AS n FROM t WHERE n <= 0.05 * (SELECT count(*) FROM j)")
def tag_df_topical(spark, sf):
    rows = _judged(spark, sf)
    return related.topical_tags(related.tag_counts(rows), rows.count())


@query(_JUDGED + """, x AS (SELECT path, judged_at, unnest(tags) AS tag FROM j WHERE user_id % 10 != 0),
k AS (SELECT path, judged_at, list(tag ORDER BY tag) AS tags FROM x WHERE tag IN (SELECT tag FROM t WHERE n <= 0.05 * (SELECT count(*) FROM j)) GROUP BY path, judged_at)
SELECT row_number() OVER (ORDER BY judged_at DESC, path)::BIGINT AS position, path, tags FROM k ORDER BY judged_at DESC, path LIMIT 20""")
def profile_recent(spark, sf):
    rows = _judged(spark, sf)
    return related.build_profile(rows, related.tag_counts(rows), rows.count()).select(F.col("position").cast("long").alias("position"), "path", "tags")


# Graph

_PAIRS = f"""
WITH RECURSIVE {_VECS}, pr AS (SELECT a.path AS src, b.path AS dst, a.folder = b.folder AS same, list_inner_product(a.v, b.v) AS sim FROM vecs a JOIN vecs b ON a.vec_id != b.vec_id),
c1 AS (SELECT *, row_number() OVER (PARTITION BY src, same ORDER BY sim DESC, dst) AS nth FROM pr),
picks AS (SELECT src, dst, sim, pick_rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS pick_rank FROM c1 WHERE NOT same OR nth <= {{0}}) WHERE pick_rank <= 10),
edges AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(sim) AS sim FROM picks GROUP BY 1, 2)
"""


def _picks(spark, sf, cap=3) -> DataFrame:
    return graph.knn_picks(adapters.vectors(spark, sf), folder_cap=cap)


@query(_PAIRS.format(10) + "SELECT src, dst, round(sim, 6) AS sim, pick_rank::BIGINT AS pick_rank FROM picks")
def knn_picks(spark, sf):
    return _picks(spark, sf, None).select("src", "dst", F.round("sim", 6).alias("sim"), F.col("pick_rank").cast("long").alias("pick_rank"))


@query(_PAIRS.format(3) + "SELECT src, dst, round(sim, 6) AS sim, pick_rank::BIGINT AS pick_rank FROM picks")
def knn_picks_folder_cap(spark, sf):
    return _picks(spark, sf).select("src", "dst", F.round("sim", 6).alias("sim"), F.col("pick_rank").cast("long").alias("pick_rank"))


@query(_PAIRS.format(3) + "SELECT a, b, round(sim, 6) AS sim FROM edges")
def knn_undirected(spark, sf):
    return graph.undirected(_picks(spark, sf)).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_PAIRS.format(3) + "SELECT round(quantile_cont(sim, 0.45), 6) AS threshold FROM edges")
def edge_percentile(spark, sf):
    return graph.edge_percentile(graph.undirected(_picks(spark, sf))).select(F.round("threshold", 6).alias("threshold"))


def _hops() -> str:
    """One step of the dynamic programme for each hop: the widest way to each node, the smaller trail of equally wide ones."""
    out = ", h0 AS (SELECT (SELECT path FROM vecs WHERE vec_id = 0) AS node, CAST('infinity' AS DOUBLE) AS width, [(SELECT path FROM vecs WHERE vec_id = 0)] AS trail)"
    out += ", sym AS (SELECT a AS src, b AS dst, sim FROM edges UNION ALL SELECT b, a, sim FROM edges)"
    for i in range(1, 7):
        out += f""", h{i} AS (SELECT node, width, trail FROM (SELECT dst AS node, least(width, sim) AS width, list_append(trail, dst) AS trail,
  row_number() OVER (PARTITION BY dst ORDER BY least(width, sim) DESC, array_to_string(list_append(trail, dst), chr(1))) AS r FROM h{i - 1} JOIN sym ON src = node WHERE NOT list_contains(trail, dst)) WHERE r = 1)"""
    union = " UNION ALL ".join(f"SELECT {i} AS hops, width, trail FROM h{i} WHERE node = (SELECT path FROM vecs WHERE vec_id = 7)" for i in range(1, 7))
    return out + f", best AS (SELECT * FROM ({union}) ORDER BY width DESC, hops, array_to_string(trail, chr(1)) LIMIT 1)"


@query(_PAIRS.format(3) + _hops() + " SELECT trail AS path, hops::INTEGER AS hops, round(width, 6) AS bottleneck FROM best")
def widest_path(spark, sf):
    rows = adapters.vectors(spark, sf)
    ends = {r.vec_id: r.path for r in rows.filter("vec_id IN (0, 7)").select("vec_id", "path").collect()}
    return graph.widest_path(graph.undirected(_picks(spark, sf)), ends[0], ends[7]).select("path", "hops", F.round("bottleneck", 6).alias("bottleneck"))


@query(_PAIRS.format(3) + _hops() + """, th AS (SELECT quantile_cont(sim, 0.45) AS t FROM edges)
SELECT CASE WHEN hops IS NULL THEN 'none' WHEN width < t THEN 'weak' ELSE 'strong' END AS verdict, hops::INTEGER AS hops, round(width, 6) AS bottleneck, round(t, 6) AS threshold FROM th LEFT JOIN best ON true""")
def path_verdict(spark, sf):
    rows = adapters.vectors(spark, sf)
    ends = {r.vec_id: r.path for r in rows.filter("vec_id IN (0, 7)").select("vec_id", "path").collect()}
    out = graph.path_verdict(graph.undirected(_picks(spark, sf)), ends[0], ends[7])
    return out.select("verdict", "hops", F.round("bottleneck", 6).alias("bottleneck"), F.round("threshold", 6).alias("threshold"))


@query(_PAIRS.format(3) + "SELECT src, dst, round(sim, 6) AS sim FROM picks WHERE src NOT IN (SELECT path FROM vecs WHERE vec_id % 11 = 0) AND dst NOT IN (SELECT path FROM vecs WHERE vec_id % 11 = 0)")
def knn_remove(spark, sf):
    gone = adapters.vectors(spark, sf).filter("vec_id % 11 = 0").select("path")
    return graph.remove_notes(_picks(spark, sf), gone).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(_PAIRS.format(3) + """, old AS (SELECT src, dst, pick_rank FROM picks),
nv AS (SELECT path, folder, vec_id, CASE WHEN vec_id % 25 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM vecs),
np AS (SELECT a.path AS src, b.path AS dst, a.folder = b.folder AS same, list_inner_product(a.v, b.v) AS sim FROM nv a JOIN nv b ON a.vec_id != b.vec_id WHERE a.vec_id % 25 = 0),
m1 AS (SELECT *, row_number() OVER (PARTITION BY src, same ORDER BY sim DESC, dst) AS nth FROM np),
own AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM m1 WHERE NOT same OR nth <= 3) WHERE r <= 10)
SELECT src, dst, round(sim, 6) AS sim FROM own UNION ALL
SELECT old.src, old.dst, round(list_inner_product(a.v, b.v), 6) FROM old JOIN nv a ON a.path = old.src JOIN nv b ON b.path = old.dst WHERE a.vec_id % 25 != 0""")
def knn_upsert(spark, sf):
    rows = adapters.vectors(spark, sf)
    picks = graph.knn_picks(rows)
    now = rows.withColumn("vec", F.when(F.col("vec_id") % 25 == 0, F.transform("vec", lambda x: -x)).otherwise(F.col("vec")))
    return graph.upsert_notes(now, picks, rows.filter("vec_id % 25 = 0").select("path")).select("src", "dst", F.round("sim", 6).alias("sim"))


# Tiers

_LINKS = "l AS (SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem)"


@query(f"WITH {_LINKS} SELECT DISTINCT dst AS path FROM l WHERE src != dst")
def incoming_links(spark, sf):
    return heat.incoming(adapters.links(spark, sf))


@query(f"WITH {_LINKS} SELECT DISTINCT src AS path FROM l WHERE src != dst")
def outgoing_links(spark, sf):
    return heat.outgoing(adapters.links(spark, sf))


def _users(spark, sf) -> DataFrame:
    """Users as notes, created and changed at their first and last event, linked when their number divides by 5."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("created"), F.unix_millis(F.max("ts").cast("timestamp")).alias("mtime"))
    return rows.select(F.col("user_id").cast("string").alias("path"), "created", "mtime")


_USERS = """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS path, user_id, epoch_ms(min(ts)) AS created, epoch_ms(max(ts)) AS mtime FROM events GROUP BY user_id),
t AS (SELECT path, CASE WHEN user_id % 5 = 0 OR {now} - greatest(created, CASE WHEN user_id % 3 = 0 THEN 0 ELSE mtime END) < {days} * 86400000::BIGINT THEN 'hot' ELSE 'cold' END AS tier FROM u)"""


def _tiers(spark, sf) -> DataFrame:
    notes = _users(spark, sf)
    linked = notes.filter("CAST(path AS LONG) % 5 = 0").select(F.col("path").alias("src"), F.lit("x").alias("dst"), F.lit(1).alias("n"))
    own = notes.filter("CAST(path AS LONG) % 3 = 0").select("path", (F.col("mtime") + 1500).alias("mtime"))
    return heat.resolve_tiers(notes, linked, NOW_MS, 2, self_writes=own)


@query(_USERS.format(now=NOW_MS, days=2) + " SELECT path, tier FROM t")
def derive_tier(spark, sf):
    return _tiers(spark, sf).select("path", "tier")


@query(_USERS.format(now=NOW_MS, days=2) + " SELECT tier, count(*)::BIGINT AS n FROM t GROUP BY tier")
def tier_counts(spark, sf):
    return heat.tier_counts(_tiers(spark, sf))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN epoch_ms(date_trunc('day', o_orderdate)) ELSE 7 END AS created FROM orders")
def resolve_created(spark, sf):
    rows = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date")
    return rows.select("o_orderkey", heat.resolve_created(raw, F.lit(7).cast("long")).alias("created"))


# The store


def _stored(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders")
    return rows.select(F.col("o_orderkey").cast("string").alias("path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_orderstatus").alias("title"), F.lit(1).cast("long").alias("indexed_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def stale_paths(spark, sf):
    files = table(spark, sf, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").cast("string").alias("path"))
    return index.stale_paths(_stored(spark, sf), files)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 4 = 0")
def changed_paths(spark, sf):
    stored = _stored(spark, sf)
    files = stored.withColumn("mtime", F.when(F.col("path").cast("long") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return index.changed_paths(stored, files)


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_chunks(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"))
    return index.orphans(chunks, table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"))).distinct()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 7 = 0 OR o_orderstatus = 'P'")
def needs_reindex(spark, sf):
    rows = _stored(spark, sf)
    key = F.col("path").cast("long")
    files = rows.withColumn("mtime", F.when(key % 7 == 0, F.col("mtime") + 5).otherwise(F.col("mtime"))).withColumn("title", F.when(F.col("title") == "P", "new").otherwise(F.col("title")))
    return index.needs_reindex(files.select("path", "mtime", "title"), rows.filter(key % 10 != 3)).select("path")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
def upsert_merge(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    fresh = rows.filter("o_orderkey % 5 = 0").withColumn("o_totalprice", -F.col("o_totalprice"))
    return index.upsert(rows.filter("o_orderkey % 2 = 0"), fresh, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 16 = 0)")
def delete_rows(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderkey % 16 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return index.delete(table(spark, sf, "customer").select("c_custkey"), gone, "c_custkey")


@query("SELECT doc_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE length(string_split(text, chr(10))[2]) >= 10")
def description_backlog(spark, sf):
    return index.description_backlog(adapters.notes(spark, sf)).select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("doc_id"))


def _titled(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("[[a/"), "p_brand", F.lit("]]"))).alias("frontmatter_title"),
        F.substring("p_name", 1, 6).alias("h1"),
    )


_TITLED = "WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 3 = 0 THEN p_brand END AS ft, substr(p_name, 1, 6) AS h1 FROM part), c AS (SELECT h1, count(*) AS n FROM f WHERE ft IS NULL GROUP BY h1 HAVING count(*) > 1)"


@query(_TITLED + " SELECT h1, n::BIGINT AS n FROM c")
def title_collisions(spark, sf):
    return index.title_collisions(_titled(spark, sf).withColumn("has_frontmatter_title", F.col("frontmatter_title").isNotNull()))


@query(_TITLED + " SELECT path, coalesce(ft, CASE WHEN h1 IN (SELECT h1 FROM c) THEN path ELSE trim(h1) END) AS title FROM f")
def note_titles(spark, sf):
    return index.resolve_titles(_titled(spark, sf)).select("path", "title")


# Dismissals


@query("SELECT vec_id, least(vec_id, (vec_id * 7) % 100)::BIGINT AS a, greatest(vec_id, (vec_id * 7) % 100)::BIGINT AS b FROM embeddings")
def pair_key(spark, sf):
    a, b = dismissals.pair(F.col("vec_id"), (F.col("vec_id") * 7) % 100)
    return table(spark, sf, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))


@query("""WITH p AS (SELECT least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b, p_partkey AS t FROM part WHERE p_brand != p_type),
r AS (SELECT CASE WHEN a = 'Brand#11' THEN 'Brand#12' ELSE a END AS a, CASE WHEN b = 'Brand#11' THEN 'Brand#12' ELSE b END AS b, t FROM p)
SELECT least(a, b) AS a, greatest(a, b) AS b, min(t)::BIGINT AS dismissed_at FROM r WHERE a != b GROUP BY 1, 2""")
def rename_dismissals(spark, sf):
    a, b = dismissals.pair(F.col("p_brand"), F.col("p_type"))
    pairs = table(spark, sf, "part").filter("p_brand != p_type").select(a.alias("a"), b.alias("b"), F.col("p_partkey").alias("dismissed_at"))
    return dismissals.rename_pairs(pairs, "Brand#11", "Brand#12")


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE source != 'src1'")
def delete_dismissals(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    return dismissals.delete_notes(rows, "src1")


# Canvases


def _center_pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("center"), F.col("o_custkey").cast("string").alias("path"))


@query(f"""WITH {_LINKS}, d AS (SELECT DISTINCT src, dst FROM l), p AS (SELECT CAST(o_orderkey AS VARCHAR) AS center, CAST(o_custkey AS VARCHAR) AS path FROM orders)
SELECT center, path, CASE WHEN o.src IS NOT NULL AND i.src IS NOT NULL THEN 'both' WHEN o.src IS NOT NULL THEN 'out' WHEN i.src IS NOT NULL THEN 'in' ELSE 'none' END AS direction
FROM p LEFT JOIN d o ON o.src = center AND o.dst = path LEFT JOIN d i ON i.src = path AND i.dst = center""")
def edge_classify(spark, sf):
    return canvas.classify_edges(_center_pairs(spark, sf), adapters.links(spark, sf)).select("center", "path", "direction")


@query(f"WITH {_LINKS}, d AS (SELECT DISTINCT src, dst FROM l) SELECT dst AS node, count(*)::BIGINT AS in_degree FROM d GROUP BY dst HAVING count(*) >= 2")
def hub_nodes(spark, sf):
    return canvas.hubs(adapters.links(spark, sf))


@query("""SELECT r_regionkey, floor(760 * cos(radians(-90 + r_regionkey * 72.0)) + 0.5)::INTEGER - 200 AS x, floor(760 * sin(radians(-90 + r_regionkey * 72.0)) + 0.5)::INTEGER - 180 AS y,
CASE r_regionkey WHEN 0 THEN 'top' WHEN 1 THEN 'right' WHEN 2 THEN 'bottom' WHEN 3 THEN 'bottom' ELSE 'left' END AS from_side FROM region""")
def radial_layout(spark, sf):
    rows = table(spark, sf, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("position"))
    return canvas.radial_layout(rows, 5).select("r_regionkey", "x", "y", "from_side")


@query(f"""WITH {_LINKS}, e AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey AS VARCHAR) AS d FROM orders WHERE o_orderkey != o_custkey),
k AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l)
SELECT DISTINCT least(s, d) || '.md' AS a, greatest(s, d) || '.md' AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(s, d) AND k.b = greatest(s, d))""")
def unlinked_pairs(spark, sf):
    pairs = _center_pairs(spark, sf).filter("center != path")
    ids = pairs.select("center").union(pairs.select("path")).distinct().toDF("id")
    nodes = ids.select("id", F.concat("id", F.lit(".md")).alias("file"))
    edges = pairs.select(F.concat_ws("-", "center", "path").alias("id"), F.col("center").alias("from_node"), F.col("path").alias("to_node"), F.lit(canvas.UNLINKED).alias("color"), F.lit("0.50").alias("label"))
    links = adapters.links(spark, sf).select(F.concat("src", F.lit(".md")).alias("src"), F.concat("dst", F.lit(".md")).alias("dst"), "n")
    found = canvas.unlinked_pairs(nodes, edges, links, nodes.select(F.col("file").alias("path")))
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    return found.select(F.concat(F.least(bare("a"), bare("b")), F.lit(".md")).alias("a"), F.concat(F.greatest(bare("a"), bare("b")), F.lit(".md")).alias("b")).distinct()


_HASH = "lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (a * 33 + x) % 4294967296)))"
_BOARD = _COS.format("0.0") + f""", top AS (SELECT *, row_number() OVER (ORDER BY position) AS p FROM po ORDER BY position LIMIT 10),
pl AS (SELECT p, path, tier, score, {_HASH.format('path')} || '-' || p AS id, -90.0::DOUBLE + (p - 1) * 36 AS angle, greatest(760, ceil(630 / (2 * sin(pi() / 10)))) AS r FROM top)"""


@query(_BOARD + f""" SELECT 0::BIGINT AS position, {_HASH.format("(SELECT path FROM q)")} || '-0' AS id, (SELECT path FROM q) AS file, -240::BIGINT AS x, -210::BIGINT AS y, '4' AS color
UNION ALL SELECT p, id, path, (floor(r * cos(radians(angle)) + 0.5) - 200)::BIGINT, (floor(r * sin(radians(angle)) + 0.5) - 180)::BIGINT, CASE WHEN tier = 'cold' THEN '5' END FROM pl""")
def canvas_nodes(spark, sf):
    nodes, _ = _canvas(spark, sf)
    return nodes.select(F.col("position").cast("long").alias("position"), "id", "file", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "color")


@query(_BOARD + """, wr AS (SELECT *, angle - 360 * floor((angle + 180) / 360) AS w FROM pl),
sd AS (SELECT *, CASE WHEN w >= -135 AND w < -45 THEN 'top' WHEN w >= -45 AND w < 45 THEN 'right' WHEN w >= 45 AND w < 135 THEN 'bottom' ELSE 'left' END AS side FROM wr)
SELECT p::BIGINT AS position, 'e-' || id AS id, id AS to_node, side AS from_side, CASE side WHEN 'top' THEN 'bottom' WHEN 'bottom' THEN 'top' WHEN 'left' THEN 'right' ELSE 'left' END AS to_side,
  'none' AS to_end, printf('%.2f', score) AS label, '6' AS color FROM sd""")
def canvas_edges(spark, sf):
    _, edges = _canvas(spark, sf)
    return edges.select(F.col("position").cast("long").alias("position"), "id", "to_node", "from_side", "to_side", "to_end", "label", "color")


def _canvas(spark, sf) -> tuple[DataFrame, DataFrame]:
    near = related.discover(adapters.vectors(spark, sf), _anchor(spark, sf), _keyword_stub(spark, sf), 0.0)
    return canvas.relation_graph(_anchor(spark, sf), near, canvas.empty_links(spark))


@query()
def canvas_layout(spark, sf):
    return canvas.canvas_json(*_canvas(spark, sf))


# Changes


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_type AS type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, type ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT path, arg_max(type, {'ts': ts, 'type': type}) AS type, epoch_us(min(ts)) // 1000 AS started, count(*)::BIGINT AS events FROM s GROUP BY path, g""")
def event_debounce(spark, sf):
    rows = table(spark, sf, "events").filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), "ts")
    return changes.debounce(rows).select("path", "type", F.unix_millis(F.col("started").cast("timestamp")).alias("started"), "events")


@query("""SELECT path, type, count(*)::BIGINT AS n FROM (
  SELECT 'new' || user_id AS path, CASE WHEN event_type = 'view' THEN 'create' ELSE event_type END AS type FROM events WHERE user_id IS NOT NULL
  UNION ALL SELECT 'old' || user_id, 'delete' FROM events WHERE event_type = 'view' AND user_id IS NOT NULL) GROUP BY path, type""")
def rename_events(spark, sf):
    user = F.col("user_id").cast("string")
    rows = table(spark, sf, "events").filter("user_id IS NOT NULL").select(
        F.concat(F.lit("new"), user).alias("path"), F.concat(F.lit("old"), user).alias("old_path"), F.when(F.col("event_type") == "view", "rename").otherwise(F.col("event_type")).alias("type"), "ts"
    )
    return changes.split_renames(rows).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


# Rules that have no SQL form


@query()
def fuzzy_title(spark, sf):
    return search.fuzzy_titles(adapters.notes(spark, sf), "the tion of", 50)


@query()
def hybrid_search(spark, sf):
    q = table(spark, sf, "embeddings").filter("vec_id = 3").first().embedding
    notes = adapters.notes(spark, sf)
    chunks = stored(adapters.chunks(spark, sf).join(notes.select("path", "vec"), "path", "left"), "chunks")
    return search.search(notes, chunks, QUERY, query_vec=q)


@query()
def global_discover(spark, sf):
    rows = adapters.vectors(spark, sf)
    notes = rows.withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("vec_id") % 40).cast("string"))))
    judged = notes.select("path", F.col("vec_id").alias("judged_at"), "tags", F.lit(False).alias("exempt"))
    docs = notes.select("path", F.lit(0).alias("chunk_index"), F.array_join("tags", " ").alias("content"))
    return related.global_discover(notes, docs, judged, 0.05)


@query()
def token_chunks(spark, sf):
    import re

    split = udfs.token_chunks(lambda s: len(re.findall(r"\w+|[^\w\s]", s)))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(split("text", F.lit("title"))).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", F.length("content").alias("n"))


@query()
def sample_spread(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(udfs.sample_spread_col("text")).alias("digest"))


@query()
def trim_descriptions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", udfs.trim_description_col("text").alias("description"))


@query()
def related_section(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(udfs.insert_related_link_col("text", F.lit("## Related"), F.lit("[[x]]"))).alias("digest"))


def _results(spark, sf) -> DataFrame:
    """The notes nearest to the anchor among all, as many as a table of contents may have, with their vectors."""
    notes = adapters.vectors(spark, sf)
    best = related.cosine_ranked(notes, _anchor(spark, sf), 0.0).filter("cos_rank <= 100")
    return best.select("path", "title", "tier", "score").join(notes.select("path", "vec"), "path")


@query()
def hdbscan_topics(spark, sf):
    rows = _results(spark, sf).select("path", "title", "tier", "vec", "score")
    return cluster.grouped_contents(cluster.cluster_vectors(rows))


@query(f"""WITH {_VECS}, q AS (SELECT v FROM vecs WHERE vec_id = 0),
s AS (SELECT path, tier, list_inner_product(vecs.v, q.v) AS score FROM vecs, q WHERE vec_id != 0),
b AS (SELECT * FROM s WHERE score >= 0 ORDER BY score DESC, path LIMIT 100),
g AS (SELECT tier, string_agg('- [[' || path || ']]', chr(10) ORDER BY score DESC, path) AS lines FROM b GROUP BY tier)
SELECT string_agg(CASE WHEN tier = 'hot' THEN '## Hot' ELSE '## Cold' END || chr(10) || chr(10) || lines || chr(10), chr(10) ORDER BY tier != 'hot') AS markdown FROM g""")
def flat_contents(spark, sf):
    return cluster.flat_contents(_results(spark, sf).select("path", "tier", "score"))
