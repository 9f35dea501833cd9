"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are words (hashed), trigrams of byte shapes (lower, upper, digit, space, line feed, marks, beyond ASCII) and
words that repeat at a short distance. A bounded sample of labelled rows gives term weights, a truncated singular
value decomposition and its own vectors in that space, all a few megabytes. Every document is then scored alone: its
whole text becomes a vector, one blocked matrix product gives its exact cosines with all labelled vectors, and the
nearest vote with weights that grow with their cosine. Votes are weighted back to the share that
each label has among all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, held_out, release, table, working_on
from brindle.llm.words import LOWER, chunks, hash_words

#: Labelled rows of each label that the model may learn from; those of the smallest id hashes.
PER_LABEL = 2048
#: Latent dimensions, voting neighbours, and the power of the cosine that is a vote's weight.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 8
ACCEPT = 0.7

#: The ASCII marks that have a shape of their own.
MARKS = ".,!#$%&*|"
SHAPES, LAGS, WORDS = 16, 4, 2048
TERMS = SHAPES**3 + LAGS + WORDS
#: Weight of the words beside the shapes, of which either part of a vector is of length 1 before the decomposition.
WORD_WEIGHT = 0.5
#: Texts, and about how many bytes of them, that are counted at once.
BLOCK_ROWS, BLOCK_BYTES = 128, 1 << 20
#: Digits of a cosine that count; rows as near as the last voter vote too, so a score doesn't hang on the order of rows.
DIGITS = 5
_SHAPE = np.full(256, 15, np.int64)
_SHAPE[ord("a") : ord("z") + 1] = 0
_SHAPE[ord("A") : ord("Z") + 1] = 1
_SHAPE[ord("0") : ord("9") + 1] = 2
_SHAPE[ord(" ")] = 3
_SHAPE[ord("\n")] = 4
_SHAPE[[ord(c) for c in MARKS]] = np.arange(5, 5 + len(MARKS))
_SHAPE[128:] = 14
_LETTERS = np.zeros(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _LETTERS[ord(_a) : ord(_b) + 1] = True
_LETTERS[128:] = True


def blocks(texts: list[bytes]) -> list[slice]:
    """Slices of the list, bounded in bytes and in rows: a row's counts take some kilobytes, however short its text is."""
    return [slice(a, min(a + BLOCK_ROWS, s.stop)) for s in chunks(texts, BLOCK_BYTES) for a in range(s.start, s.stop, BLOCK_ROWS)]


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the terms of each text, a row per text."""
    shape = _SHAPE[np.frombuffer(b"".join(texts), np.uint8)]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
    inside = of[:-2] == of[2:] if len(of) > 2 else np.zeros(0, bool)
    counts = np.zeros((len(texts), TERMS), np.float32)
    if inside.any():
        flat = np.bincount(of[:-2][inside] * SHAPES**3 + code[inside], minlength=len(texts) * SHAPES**3)
        counts[:, : SHAPES**3] = flat.reshape(len(texts), -1)
    words = hash_words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.at))
    for lag in range(1, LAGS + 1):
        same = (words.hashes[lag:] == words.hashes[:-lag]) & (text_of[lag:] == text_of[:-lag])
        counts[:, SHAPES**3 + lag - 1] = np.bincount(text_of[lag:][same], minlength=len(texts))
    words = hash_words(texts, _LETTERS, LOWER)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.at))
    flat = np.bincount(text_of * WORDS + (words.hashes % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS)
    counts[:, SHAPES**3 + LAGS :] = flat.reshape(len(texts), -1)
    return counts


@dataclass
class QualityModel:
    terms: np.ndarray  # which terms count
    weights: np.ndarray  # of those
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray  # 0 or 1
    votes: np.ndarray  # weight of each labelled row's vote
    prior: float  # the score where there is nothing to compare

    def vectorise(self, counts: np.ndarray) -> np.ndarray:
        return of_length_one(weighted(counts, self.terms, self.weights) @ self.axes)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1. A blank text is of label 0 where there are rows of it; else, and for a text without known terms, the prior."""
        scores = np.full(len(texts), self.prior)
        if not len(self.labels) or not len(texts):
            return scores
        near = min(NEIGHBOURS, len(self.labels))
        for s in blocks(texts):
            cosines = np.round(self.vectorise(term_counts(texts[s])) @ self.vectors.T, DIGITS)
            least = np.partition(cosines, len(self.labels) - near, axis=1)[:, len(self.labels) - near]
            row, voter = np.nonzero((cosines >= least[:, None]) & (cosines > 0))
            weight = cosines[row, voter].astype(np.float64) ** SHARPNESS * self.votes[voter]
            total = np.bincount(row, weight, len(cosines))
            share = np.bincount(row, weight * self.labels[voter], len(cosines)) / np.maximum(total, 1e-300)
            scores[s] = np.where(total > 0, share, self.prior)
        if (self.labels == 0).any():
            scores[[not t.strip() for t in texts]] = 0.0
        return np.clip(scores, 0.0, 1.0)


def weighted(counts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithms of counts times term weights; shapes and words each of length 1, words then weighted."""
    x = counts[:, terms]
    np.log1p(x, out=x)
    x *= weights
    k = int(np.searchsorted(terms, SHAPES**3 + LAGS))
    for part, weight in ((x[:, :k], 1.0), (x[:, k:], WORD_WEIGHT)):
        part *= (weight / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12))[:, None].astype(np.float32)
    return x


def of_length_one(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def main_axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The main right singular vectors of ``x`` as columns, by subspace iteration from fixed numbers."""
    width = min(dimensions + 16, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions].astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray, share: float) -> QualityModel:
    """A model from term counts of labelled rows; ``share``: of label 1 among all that could be learnt from."""
    df = np.count_nonzero(counts, axis=0)
    terms = np.flatnonzero(df >= 2)
    weights = (np.log((1 + len(counts)) / (1 + df[terms])) + 1).astype(np.float32)
    x = weighted(counts, terms, weights)
    del counts  # one matrix of rows and terms at a time
    axes = main_axes(x, DIMENSIONS) if x.size else np.zeros((len(terms), 0), np.float32)
    of = np.array([1 - share, share])
    there = np.bincount(labels, minlength=2)
    votes = (of * len(labels) / np.maximum(there, 1))[labels]
    model = QualityModel(terms, weights, axes, np.zeros((0, axes.shape[1]), np.float32), labels, votes, share)
    if len(x):
        model.vectors = of_length_one(x @ axes)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """A model from labelled rows that aren't held out.

    A row with several labels has the one that most have (ties: 1). The sample is bounded: the ``PER_LABEL`` rows of
    each label whose ids have the smallest hashes, and of rows of one id the one whose text has the smallest hash. Without labels
    every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    ones, rows = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(PER_LABEL) for c in (0, 1)]
    # at most 2 * PER_LABEL pairs of an id and a label
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("at"))
    sample = texts.join(F.broadcast(some[0].unionByName(some[1])), "key")

    def terms(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            packed = []
            for s in blocks(texts):
                for row in term_counts(texts[s]):
                    at = np.flatnonzero(row)
                    packed.append(at.astype("<i2").tobytes() + row[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "at")), pa.array(packed, pa.binary())], ["key", "label", "at", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    counted = sample.mapInArrow(terms, f"key {kind}, label int, at bigint, terms binary")
    # a row of each id: at most 2 * PER_LABEL, some kilobytes each
    rows_ = counted.groupBy("key").agg(F.min(F.struct("at", "terms", "label")).alias("row")).select("key", "row.*").collect()
    rows_.sort(key=lambda r: r["key"])
    known_labels = np.array([r["label"] for r in rows_], np.int64)
    model = fit(unpacked([r["terms"] for r in rows_]), known_labels, ones / rows if rows else 0.5)
    release()  # the driver goes on with other work
    return model


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Counts of terms, a row each; packed as the numbers of the terms (2 bytes), then their counts (4 bytes)."""
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        counts[i, np.frombuffer(raw, "<i2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return counts


def scorer(spark: SparkSession, model: QualityModel, text: str = "text") -> Column:
    """The score of a column of whole texts."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        working_on("quality")
        return pa.array(sent.value.score([t.encode() for t in texts.to_pylist()]))

    return score(F.coalesce(F.col(text), F.lit("")))


def with_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score (from 0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.7).

    Narrow: one pass over the text, no shuffle of it. Null, empty and blank texts: 0 (the share of label 1 where no row of
    label 0 was learnt). Very long texts: counted whole. Null ids: not held out. Repeated rows: each row on its own. Ties of
    nearness: all vote. An empty table: no rows. Other columns stay; those of the three names are replaced.
    """
    docs = bounded_batches(docs)
    score = scorer(docs.sparkSession, learn(docs, labels, key, text), text)
    return (
        docs.withColumns({"held_out": held_out(key), "score": score})
        .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
