"""Quality rules with adaptive thresholds.

One pass over the texts counts what the rules need. For each measure a mergeable quantile sketch is kept for
every language and source: counts in buckets of equal relative width, so that sketches merge by addition and
a quantile is off by at most ``ACCURACY``, relatively. Small groups use their language's merged sketch, or that of all
rows. A measure's limits are the quartiles, widened by ``WIDTH`` times their distance and a least margin;
joining them with the counts gives the verdict.

Cases: a null text has no words and fails the base rules. Null languages and sources are groups of their own.
Repeated rows count as often as they occur. An empty table gives an empty result. Columns besides the
four that are read are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
ACCURACY = 0.02
WIDTH = 3.0
LEAST_ROWS = 50
#: Up to so many groups, the limits are broadcast (a row has about 200 bytes); beyond, the join shuffles.
BROADCAST_GROUPS = 20_000

#: Measures: expression over the counts, and the least margin on each side of the quartiles.
MEASURES = {
    "word_length": ("word_chars / n_words", 1.0),
    "symbols_per_word": ("n_symbols / n_words", 0.15),
    "dup_line_share": ("n_dup_lines / n_lines", 0.25),
    "repeat_share": ("n_repeat_words / n_words", 0.2),
    "upper_share": ("n_upper / n_words", 0.25),
    "marks_per_word": ("n_marks / n_words", 0.25),
}

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS."""
    words = text.encode().split()  # bytes split at ASCII white space only
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            reach = 0  # first position not yet covered
            for at, window in enumerate(windows):
                if often[window] > 1:
                    repeated += at + 3 - max(at, reach)
                    reach = at + 3
    return (
        n, len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
        sum(1 for w in words if len(w) > 1 and w.isupper()), text.count("!") + text.count("?"),
    )


def count_texts(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The counts of every whole text, with its id, language and source."""

    def run(batches):
        for batch in batches:
            rows = [text_counts(x) for x in batch.column(3).to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["doc_id", "lang", "source", *_COUNTS])

    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in _COUNTS))


def bucket(value):
    """A sketch's bucket of a value of 0 or more: equal relative widths, -1000000 for (nearly) zero."""
    base = math.log((1 + ACCURACY) / (1 - ACCURACY))
    return F.when(value < 1e-6, F.lit(-1_000_000)).otherwise(F.ceil(F.log(value) / base)).cast("int")


def bucket_value(column):
    base = (1 + ACCURACY) / (1 - ACCURACY)
    return F.when(column == -1_000_000, 0.0).otherwise(2 * F.pow(F.lit(base), column) / (base + 1))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, bucket, n): the quantile sketch of each group and measure."""
    base = counts.filter("n_words > 0").select(
        *_keys(counts), F.explode(F.array(*[
            F.struct(F.lit(name).alias("measure"), F.expr(e).cast("double").alias("value")) for name, (e, _) in MEASURES.items()
        ])).alias("x"),
    )
    return (
        base.withColumn("bucket", bucket(F.coalesce(F.col("x.value"), F.lit(0.0))))
        .groupBy("lang_key", "source_key", F.col("x.measure").alias("measure"), "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def _keys(df: DataFrame):
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"{c}_key")
    return key("lang"), key("source")


def limits(sketch: DataFrame) -> DataFrame:
    """Per language and source, the lower and upper limit of each measure, from the smallest group with enough rows."""
    def quartiles(level: DataFrame, keys: list[str], mark: str) -> DataFrame:
        ordered = Window.partitionBy(*keys, "measure").orderBy("bucket")
        whole = Window.partitionBy(*keys, "measure")
        ranked = level.withColumn("upto", F.sum("n").over(ordered)).withColumn("rows", F.sum("n").over(whole))
        at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket"))))
        return ranked.groupBy(*keys, "measure").agg(
            at(0.25).alias(f"q1_{mark}"), at(0.75).alias(f"q3_{mark}"), F.max("rows").alias(f"rows_{mark}")
        )

    merged = lambda keys: sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by_source = quartiles(sketch, ["lang_key", "source_key"], "s")
    by_lang = quartiles(merged(["lang_key"]), ["lang_key"], "l")
    overall = quartiles(merged([]), [], "a")
    joined = by_source.join(by_lang, ["lang_key", "measure"]).join(overall, "measure")
    pick = lambda q: F.when(F.col("rows_s") >= LEAST_ROWS, F.col(f"{q}_s")).when(F.col("rows_l") >= LEAST_ROWS, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    margin = F.create_map(*[F.lit(x) for name, (_, m) in MEASURES.items() for x in (name, m)])[F.col("measure")]
    spread = WIDTH * (pick("q3") - pick("q1")) + margin
    one = joined.select("lang_key", "source_key", "measure", (pick("q1") - spread).alias("low"), (pick("q3") + spread).alias("high"))
    return one.groupBy("lang_key", "source_key").agg(*[
        F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{side}_{name}") for name in MEASURES for side in ("low", "high")
    ])


def apply_rules(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", least_words: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counts = materialize(count_texts(docs, id_col, text_col, lang_col, source_col), "quality")
    bounds = materialize(limits(sketches(counts)), "limits")
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    joined = counts.select("*", *_keys(counts)).join(bounds, ["lang_key", "source_key"], "left")
    fits = F.lit(True)
    for name, (expression, _) in MEASURES.items():
        value = F.coalesce(F.expr(f"CASE WHEN n_words > 0 THEN {expression} END"), F.lit(0.0))
        fits = fits & F.coalesce(value.between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & fits).alias("kept"),
    )
