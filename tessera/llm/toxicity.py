"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into buckets, as a whole and by their first bytes; a word's vector is the sum of its buckets'
vectors. Filters over one, two and three words, their maxima over the text and a logistic layer give a
logit. The decision threshold is calibrated for each language: a naive Bayes head guesses the language from the text,
and each language's logits are shifted so that its own threshold falls on ``THRESHOLD``.

The model is fitted on at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts (those with the smallest hashes of
their ids; all of them when there are fewer), and of either label on at most ``SAMPLE_BYTES`` of features, 12 bytes for each word: a text
that would go beyond them is passed over in training. Scoring reads whole texts.

Cases: null and empty texts are scored as texts without words. Without examples of both labels every score is 0 (1 if all
are toxic). Repeated rows give repeated results, but are one text in training; repeated labels of a document count once, toxic if any
says so; labels without a document aren't used; texts that share an id share its label; an empty table gives an empty result;
columns besides those that are read are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, frugal, materialize, small_batches, word_hashes

THRESHOLD = 0.7
SAMPLE_TOXIC = 2_500
SAMPLE_CLEAN = 3_500
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4)
EPOCHS = 6
STEPS = 1_000  # at least so many updates, for small samples
BATCH = 32
_CUT = float(np.log(THRESHOLD / (1 - THRESHOLD)))


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's words: one row for whole words and one for each prefix; bucket 0 is empty."""
    rows = []
    for i, h in enumerate(word_hashes((text or "").encode(), PREFIXES)):
        rows.append(np.where(h == 0, 0, (h >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32) + i * BUCKETS)
    return np.stack(rows)


class ToxicityModel:
    """Embeddings, filters and the logistic layer, with the language head and the thresholds."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, ((1 + len(PREFIXES)) * BUCKETS, DIM)).astype(np.float32)
        # One column block for each width and place in the window.
        self.filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.constant: float | None = None
        self.languages: list[str] = []
        self.word_logs = np.zeros((BUCKETS, 0), dtype=np.float32)
        self.shifts = np.zeros(0)
        self.shift = 0.0

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """Word vectors, with empty words after the last so that every window has a place."""
        out = np.zeros((rows.shape[1] + max(WIDTHS), DIM), dtype=np.float32)
        for row in rows:
            out[: rows.shape[1]] += self.vectors[row]
        return out

    def responses(self, vectors: np.ndarray, width: int) -> np.ndarray:
        n = len(vectors) - max(WIDTHS) + 1
        total = vectors[:n] @ self.filters[width][0]
        for k in range(1, width):
            total += vectors[k : n + k] @ self.filters[width][k]
        return total

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        vectors = self.embed(rows)
        return np.concatenate([self.responses(vectors, w).max(axis=0) for w in WIDTHS])

    def logit(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.pooled(rows), 0) @ self.out + self.bias)

    def language(self, rows: np.ndarray) -> int:
        if not self.languages or not rows.shape[1]:
            return -1
        return int(self.word_logs[rows[0]].sum(axis=0).argmax())

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        rows = features(text)
        at = self.language(rows)
        z = self.logit(rows) - (self.shifts[at] if at >= 0 else self.shift) + _CUT
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adam on the logistic loss; only the windows that give a filter's maximum pass the gradient back."""
        rng = np.random.default_rng(seed)
        seen = np.zeros(len(self.vectors), dtype=np.int32)
        for x in texts:
            seen[np.unique(x)] += 1
        self.vectors[seen < 2] = 0  # buckets that were not seen in two texts say nothing
        live = (seen >= 2).astype(np.float32)[:, None]
        live[[i * BUCKETS for i in range(1 + len(PREFIXES))]] = 0
        self.vectors *= live
        first, second, touched = np.zeros_like(self.vectors), np.zeros_like(self.vectors), np.zeros(len(self.vectors), dtype=np.int32)
        dense = {"out": self.out, **{w: self.filters[w] for w in WIDTHS}}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in dense.items()}
        bias_moments = [0.0, 0.0]
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        rate, step = 0.02, 0
        epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(texts))))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                step += 1
                grads = {k: np.zeros_like(v) for k, v in dense.items()}
                bias_grad = 0.0
                places: list[np.ndarray] = []
                pushes: list[np.ndarray] = []
                for d in chosen:
                    rows = texts[d]
                    vectors = self.embed(rows)
                    tops = []
                    pooled = []
                    for w in WIDTHS:
                        r = self.responses(vectors, w)
                        top = r.argmax(axis=0)
                        tops.append(top)
                        pooled.append(r[top, np.arange(FILTERS)])
                    hidden = np.concatenate(pooled)
                    active = np.maximum(hidden, 0)
                    slope = (1 / (1 + np.exp(-np.clip(active @ self.out + self.bias, -30, 30))) - labels[d]) * weight[d] / len(chosen)
                    bias_grad += slope
                    grads["out"] += slope * active
                    back = slope * self.out * (hidden > 0)
                    for i, w in enumerate(WIDTHS):
                        part = back[i * FILTERS : (i + 1) * FILTERS].astype(np.float32)
                        for k in range(w):
                            words = tops[i] + k
                            grads[w][k] += vectors[words].T * part
                            real = words < rows.shape[1]
                            push = (self.filters[w][k] * part).T[real]
                            for row in rows:
                                places.append(row[words[real]])
                                pushes.append(push)
                for k, v in dense.items():
                    m, s = moments[k]
                    m += 0.1 * (grads[k] - m)
                    s += 0.001 * (grads[k] ** 2 - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
                bias_moments[0] += 0.1 * (bias_grad - bias_moments[0])
                bias_moments[1] += 0.001 * (bias_grad**2 - bias_moments[1])
                self.bias -= np.float32(rate * bias_moments[0] / (1 - 0.9**step) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-7))
                where, inverse = np.unique(np.concatenate(places), return_inverse=True)
                if len(where):
                    g = np.zeros((len(where), DIM), dtype=np.float32)
                    np.add.at(g, inverse, np.concatenate(pushes))
                    g *= live[where]
                    touched[where] += 1
                    n = touched[where][:, None]
                    first[where] += 0.1 * (g - first[where])
                    second[where] += 0.01 * (g**2 - second[where])
                    self.vectors[where] -= rate * (first[where] / (1 - 0.9**n)) / (np.sqrt(second[where] / (1 - 0.99**n)) + 1e-7) * live[where]
            rate *= 0.7 ** (EPOCHS / epochs)

    def learn_languages(self, texts: list[np.ndarray], langs: list[str]) -> None:
        self.languages = sorted(set(langs))
        counts = np.full((BUCKETS, len(self.languages)), 0.05)
        for x, lang in zip(texts, langs, strict=True):
            np.add.at(counts[:, self.languages.index(lang)], x[0], 1)
        self.word_logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """For each guessed language the logit that best parts the labels; few examples lean on all languages'."""
        z = np.array([self.logit(x) for x in texts])
        guess = np.array([self.language(x) for x in texts])
        self.shift = best_cut(z, labels, 0.0)
        self.shifts = np.full(len(self.languages), self.shift)
        for i in range(len(self.languages)):
            here = guess == i
            n = min(labels[here].sum(), (1 - labels[here]).sum())
            if n:
                self.shifts[i] = (n * best_cut(z[here], labels[here], self.shift) + 5 * self.shift) / (n + 5)


def best_cut(z: np.ndarray, labels: np.ndarray, default: float) -> float:
    """The threshold of best F1, in its gap a third of the way up: fitted clean texts lie further out than new ones."""
    if not labels.any() or labels.all():
        return default
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + labels.sum())
    k = int(f1.argmax())
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + 2 * below) / 3)


def _task_features(batches):
    for batch in batches:
        rows = [features(x).tobytes() for x in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(map(len, rows), pa.int64()), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "lang", "pick", "digest", "bytes", "rows"])


def _within(sizes: list[tuple], limits: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Of (toxic, pick, digest, bytes) in ascending order the keys of the rows that both bounds of their label leave."""
    held, kept = dict.fromkeys(limits, 0), []
    for label, pick, digest, size in sizes:
        if limits[label] > 0 and held[label] + size <= most:
            limits[label] -= 1
            held[label] += size
            kept.append((label, pick, digest))
    return kept


def fit(
    docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES
) -> ToxicityModel:
    """Fit on labels (doc_id, toxic) and the texts and languages of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = ToxicityModel()
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(clean))
    texts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text").join(F.broadcast(chosen), "doc_id")
    keyed = texts.select("toxic", "lang", "text", F.xxhash64("doc_id").alias("pick"), F.xxhash64("doc_id", "lang", "text").alias("digest"))
    schema = "toxic int, lang string, pick long, digest long, bytes long, rows binary"
    found = materialize(keyed.mapInArrow(frugal(_task_features), schema), "toxicity-features")
    key = ["toxic", "pick", "digest"]
    # An id may stand on any number of texts: each label's first rows are taken before anything comes to the driver.
    once = found.groupBy(*key).agg(F.max("bytes").alias("bytes"))
    sizes = [once.filter(F.col("toxic") == label).orderBy("pick", "digest").limit(n) for label, n in ((0, clean), (1, toxic))]
    kept = _within([tuple(r) for r in sizes[0].unionByName(sizes[1]).orderBy(*key).collect()], {0: clean, 1: toxic}, most_bytes)
    few = spark.createDataFrame(kept, "toxic int, pick long, digest long")
    rows = found.join(F.broadcast(few), key).groupBy(*key).agg(F.first("lang").alias("lang"), F.first("rows").alias("rows")).toPandas()
    discard(found)
    if rows.toxic.nunique() < 2:
        model.constant = float(len(rows) > 0 and rows.toxic.iloc[0] == 1)
        return model
    rows = rows.sort_values(["toxic", "lang", "rows"], kind="stable").reset_index(drop=True)
    feats = [np.frombuffer(x, dtype=np.int32).reshape(1 + len(PREFIXES), -1) for x in rows.rows]
    y = rows.toxic.to_numpy().astype(np.float64)
    model.train(feats, y)
    model.learn_languages(feats, rows.lang.tolist())
    model.calibrate(feats, y)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from THRESHOLD on) of every whole text; the model (3 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, score double, predicted int")


def accept_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose own text scores below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(x) < THRESHOLD for x in batch.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)
