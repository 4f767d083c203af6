"""Language identification by language-bitmask n-gram filters.

A Bloom filter is stored bit-sliced: each slot holds one bit for every language, so that the AND of an n-gram's
slots is the set of all languages whose filter contains it. A text's n-grams are looked up, each language's bits are
counted, the counts are corrected for the language's false-positive rate, and the largest decides.

The filters are fitted on about ``SAMPLE`` labelled rows of each language (those whose hashes are below the language's
share; all rows when there are fewer), so that a rare language is learned beside common ones; an n-gram enters a language's filter when at least ``SHARE`` of the language's fitted texts have it.

Cases: a text that is null or has no letter gets ``und`` and score 0; so does everything when nothing was learned. Ties go
to the language that comes first by code point. Repeated rows give repeated results; an empty table
gives an empty result; columns besides those that are read are ignored.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, small_batches

SAMPLE = 2_500
HASH_PARTS = 1 << 20
SHARE = 0.02
SLOTS = 1 << 17
HASHES = 3
SIZES = (2, 3)

_LETTER = np.zeros(1 << 16, dtype=bool)
_LETTER[[c for c in range(1 << 16) if unicodedata.category(chr(c)).startswith("L")]] = True


def grams(text: str) -> np.ndarray:
    """Codes of the letter n-grams of a text, case folded; a run of other characters counts as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _LETTER[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letters = letters.copy()
        letters[high] = [chr(c).isalpha() for c in points[high]]
    if not letters.any():
        return np.zeros(0, dtype=np.uint64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first blank after a letter
    codes = np.where(letters, points, 32)[keep].astype(np.uint64)
    codes = np.concatenate([np.array([32], np.uint64), codes, np.array([32], np.uint64)])
    out = []
    for n in SIZES:
        code = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(0x110000) + codes[k : len(codes) - n + 1 + k]
        out.append(code * np.uint64(8) + np.uint64(n))
    return np.concatenate(out)


class LanguageFilter:
    """Bit-sliced Bloom filters of up to any number of languages (64 to a plane)."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages = languages
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.width = 8 if kind is np.uint8 else 64
        self.planes = [np.zeros(slots, dtype=kind) for _ in range(0, len(languages), self.width)]
        self.slots = slots
        self.common = 0  # the language to fall back on

    def places(self, codes: np.ndarray) -> list[np.ndarray]:
        h = mix64(codes)
        return [((h >> np.uint64(20 * i)) & np.uint64(self.slots - 1)).astype(np.int64) for i in range(HASHES)]

    def add(self, language: int, codes: np.ndarray) -> None:
        plane = self.planes[language // self.width]
        for at in self.places(codes):
            plane[at] |= plane.dtype.type(1 << (language % self.width))

    def finish(self) -> None:
        fill = [np.mean((self.planes[i // self.width] >> self.planes[0].dtype.type(i % self.width)) & self.planes[0].dtype.type(1)) for i in range(len(self.languages))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """N-grams of each language, corrected for false positives."""
        places = self.places(codes)
        found = np.zeros(len(self.languages))
        for p, plane in enumerate(self.planes):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            here = range(p * self.width, min((p + 1) * self.width, len(self.languages)))
            if self.width == 8:
                by_mask = np.bincount(mask, minlength=256)
                for i in here:
                    found[i] = by_mask[(np.arange(256) >> (i % 8)) & 1 == 1].sum()
            else:
                for i in here:
                    found[i] = np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        return np.maximum(0.0, (found - len(codes) * self.false) / (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text or "")
        if not len(codes) or not self.languages:
            return "und", 0.0
        counts = self.counts(codes)
        order = np.argsort(-counts, kind="stable")
        best = counts[order[0]]
        if best <= 0:
            return self.languages[self.common], 0.0
        second = counts[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(best / (best + second))


def _task_grams(batches):
    """For each language of a task's rows: how many texts have each n-gram."""
    held: dict[str, list[np.ndarray]] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    texts: dict[str, int] = {}

    def fold(lang):
        codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        if lang in totals:
            old, m = totals[lang]
            both = np.concatenate([old, codes])
            codes, place = np.unique(both, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([m, n]), minlength=len(codes)).astype(np.int64)
        totals[lang] = codes, n

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(np.unique(grams(text)))
            texts[lang] = texts.get(lang, 0) + 1
            if len(held[lang]) >= 256:
                fold(lang)
    for lang in list(held):
        fold(lang)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for lang, (codes, n) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n, pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-1], pa.int64()), pa.array([texts[lang]], pa.int64())], schema=schema)


def fit_filter(labelled: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> LanguageFilter:
    """Fit on rows (doc_id, text, lang). Of each language about ``sample`` rows are read, of repeated rows one; what reaches the driver
    is a row for each language, and the filters' n-grams: those that ``share`` of a language's texts have, so a bounded number for each
    language."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang")
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    below = [F.lit(x) for r in sizes for x in (r.lang, math.ceil(min(1.0, sample / r.n) * HASH_PARTS))]
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASH_PARTS)) < F.create_map(*below)[F.col("lang")] if below else F.lit(False)
    chosen = rows.filter(drawn).dropDuplicates(["doc_id", "text", "lang"]).select("lang", "text")
    counted = chosen.mapInArrow(_task_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    totals = {r.lang: r.n for r in counted.filter("gram = -1").collect()}
    languages = sorted(totals)
    out = LanguageFilter(languages)
    if languages:
        out.common = max(range(len(languages)), key=lambda i: (totals[languages[i]], -i))
        least = F.create_map(*[F.lit(v) for k in languages for v in (k, max(1.0, share * totals[k]))])
        kept = counted.filter((F.col("gram") >= 0) & (F.col("n") >= least[F.col("lang")])).select("lang", "gram").toPandas()
        for lang, part in kept.groupby("lang"):
            out.add(languages.index(lang), part.gram.to_numpy().astype(np.uint64))
    out.finish()
    counted.unpersist()
    return out


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text. The filters (SLOTS bytes for up to 8 languages) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
