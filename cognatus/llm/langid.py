"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, words' borders included, are hashed. A document's value of
an n-gram is its share of the document's n-grams times the inverse document frequency. The
weights are trained by follow-the-regularised-leader with elastic-net penalties, and a
temperature fitted on documents left out of the training calibrates the probabilities.

Scale: document frequencies cover all documents to learn from, in one scan. The classifier is
fitted on a bounded sample of them: the ``per_label`` documents of each label with the least
hashes of their ids; ``per_label`` bounds what the driver holds. Prediction is a scan without
a shuffle. A document's logits are sums over its words, so each distinct word of a batch is
scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cognatus.llm.text import give_back, ragged, slices, small_batches, split_words, tidy

UNKNOWN = "und"
DIMS = 1 << 15
ORDERS = (1, 2, 3)
#: What bounds the driver: documents learned from per label, and labels; more labels than that are an error.
PER_LABEL, MOST_LABELS = 1500, 400


def word_ngrams(words: pa.Array, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """``(features, counts)``: hashed n-grams of the words, word by word, and how many each word has."""
    text = " " + " ".join(words.to_pylist()) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    space = points == 32
    word = np.cumsum(space) - 1  # the space before a word belongs to it
    features, owners = [], []
    for n in ORDERS:
        at = np.arange(len(points) - n + 1)
        inner = ~space[at] if n == 1 else np.ones(len(at), bool)
        for k in range(1, n - 1):
            inner &= ~space[at + k]
        at = at[inner]
        h = np.full(len(at), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        features.append((h * np.uint32(2654435769)) >> np.uint32(32 - (dims - 1).bit_length()))
        owners.append(word[at])
    features, owners = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return features[order].astype(np.int64), np.bincount(owners, minlength=len(words))[: len(words)]


@dataclass
class LanguageModel:
    """``weights`` (features by labels) already hold the inverse document frequencies."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: int, dims: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression, one row at a time, in a fixed order."""
    z, n = np.zeros((dims + 1, labels)), np.zeros((dims + 1, labels))
    order = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        w[np.abs(zs) <= l1] = 0
        return w

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, dims), np.append(x, 1.0)
            w = weights(at)
            p = _softmax((x @ w)[None, :])[0]
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dims + 1))
    return w[:-1], w[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _features(docs: DataFrame, dims: int) -> DataFrame:
    """``(label, hash, at, tf)``: sparse shares of n-grams of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                codes, words, offsets = split_words(piece.column("text"), "utf8")
                feats, counts = word_ngrams(words, dims)
                first = np.cumsum(counts) - counts
                at, tf = [], []
                for d in range(piece.num_rows):
                    own = codes[offsets[d] : offsets[d + 1]]
                    total = np.bincount(feats[ragged(first[own], counts[own])], minlength=dims)
                    on = np.flatnonzero(total)
                    at.append(on.astype(np.int32))
                    tf.append((total[on] / max(1, total.sum())).astype(np.float32))
                arrays = [piece.column("label"), piece.column("hash"), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "hash", "at", "tf"])

    return docs.select("label", "hash", "text").mapInArrow(tidy(run), "label string, hash long, at array<int>, tf array<float>")


def document_frequencies(docs: DataFrame, dims: int = DIMS, block: int = 64) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` (column text) each hashed n-gram occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                codes, words, offsets = split_words(piece.column("text"), "utf8")
                feats, counts = word_ngrams(words, dims)
                first = np.cumsum(counts) - counts
                for at in range(0, piece.num_rows, block):
                    some = range(at, min(at + block, piece.num_rows))
                    seen = np.zeros((len(some), dims), np.uint8)
                    for k, d in enumerate(some):
                        own = np.unique(codes[offsets[d] : offsets[d + 1]])
                        seen[k, feats[ragged(first[own], counts[own])]] = 1
                    df[:dims] += seen.sum(axis=0, dtype=np.int64)
                rows += piece.num_rows
        df[dims] = rows
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], names=["feature", "df"])

    sums = docs.select("text").mapInArrow(tidy(run), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    df = np.zeros(dims + 1, np.int64)
    for r in sums.collect():  # at most dims + 1 rows
        df[r["feature"]] = r["df"]
    return df[:dims], int(df[dims])


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def sample_edges(rows: DataFrame, per_label: int) -> dict[str, int]:
    """Per label a hash that about ``per_label`` rows of ``(label, hash)`` do not exceed, and hardly more.

    Two histograms of 1024 buckets find it, the second within the bucket the first ends in; no
    label's rows meet in one task.
    """

    def counted(df: DataFrame, bucket: Column) -> dict[str, dict[int, int]]:
        out: dict[str, dict[int, int]] = {}
        for r in df.groupBy("label", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            out.setdefault(r["label"], {})[r["b"]] = r["n"]
        return out

    def cut(counts: dict[int, int], wanted: int) -> tuple[int, int]:
        for b in sorted(counts):
            if counts[b] >= wanted:
                return b, wanted
            wanted -= counts[b]
        return max(counts), wanted

    high, low = F.shiftright("hash", 54), F.shiftright("hash", 44).bitwiseAND(F.lit(1023))
    first = {label: cut(counts, per_label) for label, counts in counted(rows, high).items()}
    inside = F.lit(False)
    for label, (b, _) in first.items():
        inside = inside | ((F.col("label") == label) & (high == b))
    second = counted(rows.where(inside), low)
    return {label: (b << 54) + ((cut(second[label], wanted)[0] + 1) << 44) - 1 for label, (b, wanted) in first.items()}


def train(
    docs: DataFrame,
    *,
    label_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = PER_LABEL,
    dims: int = DIMS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 3,
) -> LanguageModel:
    """Fit on ``docs``; rows whose label is null or whose text has no letter are not learned from."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(label_col).isNotNull() & has_letter(text_col)).select(
        F.col(label_col).cast("string").alias("label"), F.xxhash64(id_col).alias("hash"), F.col(text_col).alias("text")
    )
    df, total = document_frequencies(rows, dims)
    edges = sample_edges(rows.select("label", "hash"), per_label)
    if len(edges) > MOST_LABELS:
        raise ValueError(f"{len(edges)} labels; there may be {MOST_LABELS}")
    if not edges:
        return LanguageModel([], np.zeros((dims, 0)), np.zeros(0), 1.0)
    chosen = F.lit(False)
    for label, edge in edges.items():
        chosen = chosen | ((F.col("label") == label) & (F.col("hash") <= edge))
    least = Window.partitionBy("label").orderBy("hash")
    sampled = rows.where(chosen).withColumn("k", F.row_number().over(least)).where(F.col("k") <= per_label)
    sample = _features(sampled, dims).toArrow().combine_chunks()
    sample = sample.take(pc.sort_indices(sample, sort_keys=[("hash", "ascending"), ("label", "ascending")]))
    labels = sorted(edges)
    y = np.array([labels.index(x) for x in sample.column("label").to_pylist()])
    # the hashed values are spread over features: idf times a common scale keeps gradients near one
    idf = (np.log((1 + total) / (1 + df)) + 1) * 20
    at = [x.values.to_numpy() for x in sample.column("at")]
    rows_ = [(a, (t.values.to_numpy() * idf[a]).astype(np.float32)) for a, t in zip(at, sample.column("tf"), strict=True)]
    del sample, at
    held = np.arange(len(rows_)) % 5 == 4
    keep = np.flatnonzero(~held)
    w, bias = ftrl([rows_[i] for i in keep], y[keep], len(labels), dims, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    logits = np.array([x @ w[a] + bias for a, x in (rows_[i] for i in np.flatnonzero(held))]).reshape(-1, len(labels))
    model = LanguageModel(labels, w * idf[:, None], bias, fit_temperature(logits, y[held]))
    del rows_, logits
    give_back()
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its calibrated probability.

    ``und`` and 0 if the text is null or has no letter, or if nothing was learned. Ties go to
    the label first in order. Input columns named like the results are replaced.
    """
    small_batches(docs.sparkSession)
    labels, temperature, bias = model.labels, model.temperature, model.bias
    dims, shared = len(model.weights), docs.sparkSession.sparkContext.broadcast(model.weights)
    docs = docs.drop(*[c for c in names if c in docs.columns])
    if not labels:
        return docs.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})

    @F.arrow_udf("struct<label: string, score: double>")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        weights, out_label, out_score = shared.value, [], []
        for piece in slices(batch, "text"):
            codes, words, offsets = split_words(piece.column("text"), "utf8")
            feats, counts = word_ngrams(words, dims)
            owner = np.repeat(np.arange(len(counts)), counts)
            table = np.stack([np.bincount(owner, weights=weights[feats, k], minlength=len(counts)) for k in range(len(labels))] + [counts.astype(float)], axis=1)
            sums = np.zeros((piece.num_rows, len(labels) + 1))
            some = np.flatnonzero(np.diff(offsets))
            if len(some):
                sums[some] = np.add.reduceat(table[codes], offsets[some], axis=0)
            p = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + bias) / temperature)
            best = p.argmax(axis=1)
            out_label += [labels[b] for b in best]
            out_score += p[np.arange(len(best)), best].tolist()
        give_back()
        return pa.StructArray.from_arrays([pa.array(out_label, pa.string()), pa.array(out_score, pa.float64())], names=["label", "score"])

    found = F.when(has_letter(text_col), scored(F.col(text_col).cast("string")))
    docs = docs.withColumn("__found", found)
    return docs.select(
        *[c for c in docs.columns if c != "__found"],
        F.coalesce("__found.label", F.lit(UNKNOWN)).alias(names[0]),
        F.coalesce("__found.score", F.lit(0.0)).alias(names[1]),
    )


def learns_from(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id's text leaves another remainder than ``fold``; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != fold, F.lit(False))


def language_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from the documents not held out.

    A null text, or one without a letter, is ``und`` with a score of 0, and so is everything if nothing was
    learned; a null label is not learned from, a null id neither. Repeated rows and documents of equal
    hash are rows like any other; of a label's documents at the sample's edge those come first that their hash
    puts first. Very long texts are read whole. Columns named like the results are replaced; an empty table
    stays empty. Labels are not looked at in a prediction.
    """
    model = train(docs.where(learns_from(id_col)), label_col=label_col, id_col=id_col, text_col=text_col, per_label=per_label)
    docs = docs.drop(*[c for c in ("held_out",) if c in docs.columns])
    return predict(docs.withColumn("held_out", ~learns_from(id_col)), model, text_col=text_col)
