"""Quality classifier: supervised subword embeddings, averaged per document.

A word is the mean of a learned vector for itself and of vectors for its character
n-grams, all in one hashed table; a document is the mean of its words; a softmax gives
the classes. Table and softmax are learned together by stochastic gradient descent in
numpy. As mean and softmax input are linear, a word's part of the logit is one number,
which is remembered by word when whole texts are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordMemo, bounded_sample, fold_of, lean, small_batches, smallest_keys, sum_by_text, text_of, word_groups
from tessera.llm.langid import softmax, sum_ngrams, word_ngrams

ORDERS = (1, 3, 4, 5)
#: Stands in a document for each word that repeats the word before it, as a word of its own.
REPEAT = "\x01="


def words_of(text: str, before: str = "") -> list[str]:
    """Lower-case words by white space, and a mark for each immediate repetition; `before` is the word before the text."""
    words = text.lower().split()
    return words + [REPEAT] * (sum(map(eq, words[1:], words)) + (words[:1] == [before]))


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed units of each word, itself included: bucket and word number, in order of words."""
    found, owner = word_ngrams(words, ORDERS, buckets)
    whole = np.fromiter((hash_word(w, buckets) for w in words), np.int64, len(words))
    order = np.argsort(np.concatenate([owner, np.arange(len(words))]), kind="stable")
    return np.concatenate([found, whole])[order], np.concatenate([owner, np.arange(len(words))])[order]


def hash_word(word: str, buckets: int) -> int:
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 8) % buckets


@dataclass
class QualityModel:
    """The table of vectors (buckets x dimensions), the softmax's weights and biases; its size is fixed."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Each word's part of the logit of class 1 against class 0."""
        unit = (self.table @ (self.out[:, 1] - self.out[:, 0]))[:, None].astype(np.float64)
        sums = sum_ngrams(words, ORDERS, unit)
        whole = np.fromiter((hash_word(w, len(unit)) for w in words), np.int64, len(words))
        return (sums[:, :1] + unit[whole]) / (sums[:, 1:] + 1)


def fit_quality_model(
    texts: list[str], labels: list[int], buckets: int = 1 << 17, dims: int = 10, epochs: int = 8, rate: float = 0.6, seed: int = 3,
) -> QualityModel:
    """Learns from labelled texts by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    examples = []
    for text, label in zip(texts, labels):
        words, n = np.unique(np.array(words_of(text), object), return_counts=True) if text.strip() else ([], [])
        if len(words) == 0:
            continue
        found, owner = subwords(list(words), buckets)
        share = (np.asarray(n) / np.sum(n) / np.bincount(owner, minlength=len(words)))[owner]
        at, back = np.unique(found, return_inverse=True)
        examples.append((at, np.bincount(back, share).astype(np.float32), int(label)))
    steps, done = epochs * max(1, len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, share, label = examples[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ table[at]
            p = softmax((hidden @ out + bias)[None])[0]
            p[label] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # each unit's gradient is its share of the text; the square root of the text's units keeps steps of long texts up
            table[at] -= (lr * np.sqrt(len(at)) * share)[:, None] * back
    return QualityModel(table, out, bias)


def score_quality(model: QualityModel | None, memo: WordMemo | None, texts: list[str], empty: float = 0.0) -> np.ndarray:
    """The probability of class 1 for each text; `empty` for a text without words or without a model."""
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    last: dict[int, str] = {}
    for group in word_groups(texts) if model else ():
        words = []
        for i, piece in group:
            words.append(words_of(piece, last.get(i, "")))
            if words[-1]:
                last = {i: words[-1][-1 - words[-1].count(REPEAT)]}
        if any(words):
            rows = memo([w for ws in words for w in ws])
            at = [i for i, _ in group]
            np.add.at(sums, at, sum_by_text(rows, map(len, words))[:, 0])
            np.add.at(sizes, at, list(map(len, words)))
    if not sizes.any():
        return np.full(len(texts), empty)
    logit = sums / np.maximum(sizes, 1) + float(model.bias[1] - model.bias[0])
    return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), empty)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int, most_chars: int, folds: int, held: int
) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out fold: at most `most`, one a key, of the keys with the smallest md5."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold_of(labels, key, folds) != held))
    keys = smallest_keys(told, key, most)
    if not keys:
        return []
    wanted = docs.sparkSession.createDataFrame([(k,) for k in keys], f"_key {labels.schema[key].dataType.simpleString()}")
    values = told.select(F.col(key).alias("_key"), F.col(label).alias("_value")).join(F.broadcast(wanted), "_key", "left_semi")
    values = values.groupBy("_key").agg(F.max("_value").alias("_value"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(values), "_key")
    return [(t, int(y)) for t, y in bounded_sample(rows, keys, most_chars)]


def classify_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = 0.3, most: int = 4000, most_chars: int = 1 << 26, folds: int = 5, held: int = 0,
) -> DataFrame:
    """Scores every whole text for quality.

    Returns key, held_out (crc32 of the key modulo `folds` is `held`), score (the
    probability of label 1) and predicted (1 if score >= threshold). The model is fitted
    on labelled rows outside the held-out fold, at most `most` of them and `most_chars`
    characters, one a key: a bounded sample, and the model has a fixed size, so it is
    broadcast. Only text is scored. A null or empty text, or one of white space alone,
    scores 0; every text does when there is nothing to learn from. A key with several
    labels counts with the largest; of several rows of one key, one is learned from. A very
    long text is read in parts. Rows are independent: ties, repeated rows and null keys
    pass through; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    told = labelled_sample(docs, labels, key, text, label, most, most_chars, folds, held)
    model = fit_quality_model([t for t, _ in told], [y for _, y in told]) if told else None
    return score_texts(docs, spark.sparkContext.broadcast(model), score_quality, key, text, folds, held, threshold)


def score_texts(docs: DataFrame, shared, score, key: str, text: str, folds: int, held: int, threshold: float) -> DataFrame:
    """Scores texts by a broadcast model with word_rows(); score(model, memo, texts) gives the numbers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        memo = WordMemo(model.word_rows) if model else None
        for batch in batches:
            yield pa.array(score(model, memo, batch.to_pylist()), pa.float64())

    run = lean(run)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    found = docs.select(F.col(key), (fold_of(docs, key, folds) == held).alias("held_out"), scored(text_of(docs, text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
