"""Keyword ranking: inverted index, corpus statistics, BM25 scores, and their pooling from chunks to notes."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.scratch import small_batches, stored

K1, B, TF_CAP = 1.5, 0.75, 65535
DESCRIPTION = -1  # chunk_index of a note's description


#: The form of stored indexes and of their tokens: others are built anew.
FORM = 2
#: Folders that a stored index deals its terms to, by their hash: a query reads those of its terms.
BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """postings(term, path, chunk_index, tf, dl), docs(path, chunk_index, dl) and stats(n_docs, avgdl)."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame


def corpus(chunks: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(path, chunk_index, content): the chunks, and each note's description as one more document."""
    out = chunks.select("path", "chunk_index", "content")
    if notes is None:
        return out
    described = notes.filter(F.length(text.trim_all(F.col("description"))) > 0)
    return out.unionByName(described.select("path", F.lit(DESCRIPTION).alias("chunk_index"), F.col("description").alias("content")))


def _repeated(docs: DataFrame) -> bool:
    """Whether two rows are of one document: only then its terms lie in more than one row."""
    return bool(docs.groupBy("path", "chunk_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1))


def _counted(docs: DataFrame, bigrams: bool, simplify: tuple[str, str] | None) -> DataFrame:
    """(path, chunk_index, dl, term, tf). Each row's tokens are counted where they are, so that no postings are shuffled; rows of one document and length, if there
    are any, are added up after that."""
    small_batches(docs.sparkSession)
    tokens = text.tokenize(text.normalize_for_search(F.col("content"), simplify), bigrams)
    rows = docs.select("path", "chunk_index", tokens.alias("tokens"))

    def count(batches):
        for b in batches:
            found = pa.table({"row": pc.list_parent_indices(b.column("tokens")), "term": pc.list_flatten(b.column("tokens"))})
            found = found.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            at = found.column("row").combine_chunks()
            lengths = pc.list_value_length(b.column("tokens")).take(at)
            for made in pa.table({
                "path": b.column("path").take(at), "chunk_index": b.column("chunk_index").take(at), "dl": lengths, "term": found.column("term"),
                "tf": pc.cast(found.column("count_all"), pa.int64()),
            }).to_batches(max_chunksize=20_000):
                yield made

    kind = docs.schema["chunk_index"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"path string, chunk_index {kind}, dl int, term string, tf bigint")
    if _repeated(docs):
        counted = counted.groupBy("path", "chunk_index", "dl", "term").agg(F.sum("tf").alias("tf"))
    return counted


def _capped(tf: Column) -> Column:
    return F.least(tf, F.lit(TF_CAP)).cast("int").alias("tf")


def term_counts(docs: DataFrame, bigrams: bool = True, simplify: tuple[str, str] | None = None) -> DataFrame:
    """(path, chunk_index, term, tf). A document's tokens are counted where it lies; only documents in several rows meet in a shuffle."""
    counted = _counted(docs, bigrams, simplify)
    if _repeated(docs):
        counted = counted.groupBy("path", "chunk_index", "term").agg(F.sum("tf").alias("tf"))
    return counted.select("path", "chunk_index", "term", _capped(F.col("tf")))


def doc_lengths(docs: DataFrame, bigrams: bool = True, simplify: tuple[str, str] | None = None) -> DataFrame:
    """(path, chunk_index, dl), without a shuffle."""
    tokens = text.tokenize(text.normalize_for_search(F.col("content"), simplify), bigrams)
    return docs.select("path", "chunk_index", F.coalesce(F.size(tokens), F.lit(0)).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def build_index(docs: DataFrame, bigrams: bool = True, simplify: tuple[str, str] | None = None) -> Index:
    """The index as a plan. The length of a document stands beside each of its terms, so that a query needs no join with all documents."""
    postings = _counted(docs, bigrams, simplify).select("term", "path", "chunk_index", _capped(F.col("tf")), "dl")
    lengths = doc_lengths(docs, bigrams, simplify)
    return Index(postings, lengths, corpus_stats(lengths))


def document_counts(docs: DataFrame, bigrams: bool = True, simplify: tuple[str, str] | None = None) -> DataFrame:
    """(term, df) of all terms, without postings: a document's different terms are combined before the shuffle."""
    tokens = text.tokenize(text.normalize_for_search(F.col("content"), simplify), bigrams)
    rows = docs.select("path", "chunk_index", F.explode(F.array_distinct(tokens)).alias("term"))
    if _repeated(docs):
        rows = rows.distinct()
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def save_index(index: Index, folder: str, version: str, buckets: int = BUCKETS) -> None:
    """Write an index for a version of its documents. The stamp comes last: an index without it is none."""
    spark = index.postings.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    dealt = index.postings.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("term", "path"), F.lit(8))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    corpus_stats(spark.read.parquet(f"{folder}/docs")).write.mode("overwrite").parquet(f"{folder}/stats")
    spark.createDataFrame([(FORM, version, buckets)], "form int, version string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stamp")


@dataclass(frozen=True)
class StoredIndex:
    """An index in a folder."""

    spark: SparkSession
    folder: str
    buckets: int

    def read(self, terms: DataFrame | None = None) -> Index:
        """The index; with terms (a query's few), only their folders and rows of the postings are read."""
        part = lambda name: self.spark.read.parquet(f"{self.folder}/{name}")
        postings = part("postings")
        if terms is not None:
            wanted = terms.select("term", _bucket(F.col("term"), self.buckets).alias("bucket")).collect()
            postings = postings.filter(F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("term").isin([r.term for r in wanted]))
        return Index(postings.select("term", "path", "chunk_index", "tf", "dl"), part("docs"), part("stats"))


def load_index(spark: SparkSession, folder: str, version: str) -> StoredIndex | None:
    """The stored index of this version of the documents, or None: it is to be built anew."""
    jvm = spark.sparkContext._jvm
    stamp = jvm.org.apache.hadoop.fs.Path(f"{folder}/stamp/_SUCCESS")
    if not stamp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(stamp):
        return None
    row = spark.read.parquet(f"{folder}/stamp").first()
    return StoredIndex(spark, folder, row.buckets) if (row.form, row.version) == (FORM, version) else None


def query_terms(spark, query: str, simplify: tuple[str, str] | None = None) -> DataFrame:
    """(term, qtf): a term that the query repeats counts as often. As many rows as the query has words."""
    one = spark.createDataFrame([(query,)], "q string")
    tokens = text.tokenize(text.normalize_for_search(F.col("q"), simplify))
    return one.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))


def idf(postings: DataFrame, stats: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) of the given terms (broadcast: a query's), or of all."""
    rows = postings if terms is None else postings.join(F.broadcast(terms.select("term")), "term", "left_semi")
    return with_idf(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def with_idf(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from (term, df)."""
    value = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return counts.crossJoin(F.broadcast(stats)).select("term", "df", value.alias("idf"))


def score(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(path, chunk_index, score) of the documents that have a term of the query. Only the query's postings leave the scan; nothing else is joined."""
    hits = index.postings.join(F.broadcast(terms), "term")
    weights = idf(index.postings, index.stats, terms)
    rows = hits.join(F.broadcast(weights), "term").crossJoin(F.broadcast(index.stats))
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(0.0)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    return rows.groupBy("path", "chunk_index").agg(F.sum(part).alias("score"))


def score_text(docs: DataFrame, query: str, bigrams: bool = False, k1: float = K1, b: float = B, simplify: tuple[str, str] | None = None) -> DataFrame:
    """As score, in one pass over the texts without an index: each document's length and counts of the query's terms are written once, and the
    statistics and the scores come from that table."""
    tokens = text.tokenize(text.normalize_for_search(F.col("content"), simplify), bigrams)
    wanted = [(r.term, r.qtf) for r in query_terms(docs.sparkSession, query, simplify).collect()]
    rows = docs.select("path", "chunk_index", tokens.alias("tokens"))
    counts = [F.size(F.col("tokens")) - F.size(F.array_remove("tokens", t)) for t, _ in wanted]
    rows = stored(rows.select("path", "chunk_index", F.size("tokens").alias("dl"), *[F.least(c, F.lit(TF_CAP)).alias(f"tf{i}") for i, c in enumerate(counts)]), "counts")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))],
    )
    hit = F.lit(False)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"tf{i}") > 0)
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(0.0)
    total = F.lit(0.0)
    for i, (_, qtf) in enumerate(wanted):
        weight = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        total = total + qtf * weight * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * length))
    return rows.filter(hit).crossJoin(F.broadcast(stats)).select("path", "chunk_index", total.alias("score"))


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best documents; ties by path, then chunk."""
    return scores.orderBy(F.desc("score"), "path", "chunk_index").limit(limit)


def pool_notes(scores: DataFrame) -> DataFrame:
    """(path, score, chunk_index of the best document, real_chunk of the best that isn't a description)."""
    order = F.struct("score", -F.col("chunk_index"))
    return scores.groupBy("path").agg(
        F.max("score").alias("score"), F.max_by("chunk_index", order).alias("chunk_index"),
        F.max_by(F.when(F.col("chunk_index") >= 0, F.col("chunk_index")), F.when(F.col("chunk_index") >= 0, order)).alias("real_chunk"),
    )


def rank(scores: DataFrame, key: str = "path", value: str = "score") -> DataFrame:
    """(key, rank) from 1, by descending value, ties by key. One task: for lists that a limit or a pool has bounded."""
    return scores.select(key, F.row_number().over(Window.orderBy(F.desc(value), key)).alias("rank"))
