"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties,
then calibrated by one temperature. n-grams run within words, with a mark at each end
of a word, and are hashed. The term frequency is the share of the text's n-grams, so a
text's logits are a mean over its n-grams, and so a sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordMemo, bounded_sample, fold_of, lean, small_batches, smallest_keys, sum_by_text, text_of, word_groups

UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text))


def word_ngrams(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words with end marks: bucket and word number of each, in order of words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return ngrams_of("\x02" + "\x03\x02".join(words) + "\x03" if words else "", sizes, orders, buckets)


def ngrams_of(joined: str, sizes: np.ndarray, orders: tuple[int, ...], buckets: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """word_ngrams() of marked words of the sizes told, joined; own tells in how many first characters of each an n-gram may begin."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    begins = None
    if own is not None:
        begins = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(own, sizes)
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found, owners = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        if n > len(points):
            break
        last = len(points) - n + 1
        rolling = rolling[:last] * np.uint64(0xD6E8FEB86659FD93) + mixed[n - 1 :]
        if n in orders:
            inside = owner[:last] == owner[n - 1 :]
            if begins is not None:
                inside &= begins[:last]
            code = rolling[inside]
            code = (code ^ (code >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(((code >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
            owners.append(owner[:last][inside])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order], np.concatenate(owners)[order]


def segments(words: list[str], orders: tuple[int, ...], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray | None]]:
    """Words in groups of about `most` characters for ngrams_of(): the numbers they have, the marked words joined, their sizes, and `own`.

    A word longer than that comes in overlapping parts, each in a group of its own; n-grams
    that begin beyond a part's own characters are the next part's.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    short = np.flatnonzero(sizes <= most)
    group = np.cumsum(sizes[short]) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(short)]])
    whole = len(short) == len(words)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if a < b:
            some = words[a:b] if whole else [words[i] for i in short[a:b].tolist()]
            yield short[a:b], "\x02" + "\x03\x02".join(some) + "\x03", sizes[short[a:b]], None
    for i in np.flatnonzero(sizes > most).tolist():
        marked = f"\x02{words[i]}\x03"
        for start in range(0, len(marked), most):
            part = marked[start : start + most + max(orders) - 1]
            yield np.array([i]), part, np.array([len(part)]), np.array([min(most, len(marked) - start)])


def sum_ngrams(words: list[str], orders: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """For each word the sums of its n-grams' rows of weights, and the number of its n-grams."""
    out = np.zeros((len(words), weights.shape[1] + 1))
    for numbers, joined, sizes, own in segments(words, orders):
        found, owner = ngrams_of(joined, sizes, orders, len(weights), own)
        for k in range(weights.shape[1]):
            out[numbers, k] += np.bincount(owner, weights[found, k], len(numbers))
        out[numbers, -1] += np.bincount(owner, minlength=len(numbers))
    return out


@dataclass
class LanguageModel:
    """Weights with idf folded in (buckets x languages), biases and the temperature; its size is fixed."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...]

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word: the sum of its n-grams' weights by language, and the number of its n-grams."""
        return sum_ngrams(words, self.orders, self.weights)

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    high = np.exp(logits - logits.max(axis=1, keepdims=True))
    return high / high.sum(axis=1, keepdims=True)


def fit_language_model(
    texts: list[str], languages: list[str], buckets: int = 1 << 18, orders: tuple[int, ...] = (1, 2, 3, 4),
    epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, scale: float = 40.0,
    most_ngrams: int = 40_000, counts: tuple[np.ndarray, int] | None = None,
) -> LanguageModel:
    """Learns from labelled texts. Each ninth text is set aside to fit the temperature.

    counts are the texts that hold each bucket and the number of texts, of the whole
    corpus; without them, of the texts given.

    A text longer than `most_ngrams` n-grams is cut into several training examples, so
    all of it is learned from. scale multiplies the features, as FTRL's step sizes want
    features of about 1.
    """
    names = sorted(set(languages))
    label = {name: k for k, name in enumerate(names)}
    examples: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    seen = np.zeros(buckets)
    for i, (text, language) in enumerate(zip(texts, languages)):
        found, _ = word_ngrams(text.lower().split(), orders, buckets)
        for start in range(0, len(found), most_ngrams):
            at, n = np.unique(found[start : start + most_ngrams], return_counts=True)
            examples.append((at, n / n.sum(), label[language], i % 9 == 0 and len(texts) >= 50))
            seen[at] += 1
    df, many = counts or (seen, len(examples))
    idf = np.log((1 + many) / (1 + df)) + 1
    z = np.zeros((buckets, len(names)))
    n2 = np.zeros((buckets, len(names)))
    b = np.zeros(len(names))

    def weights_at(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n2[at])) / alpha + l2))

    order = np.random.default_rng(7)
    learn = [e for e in examples if not e[3]] or examples
    for _ in range(epochs):
        for i in order.permutation(len(learn)):
            at, share, target, _ = learn[i]
            x = scale * share * idf[at]
            w = weights_at(at)
            p = softmax((x @ w + b)[None])[0]
            p[target] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / alpha
            z[at] += g - sigma * w
            n2[at] += g * g
            b -= 0.02 * p
    weights = np.zeros_like(z)
    touched = np.flatnonzero(seen)
    weights[touched] = weights_at(touched) * scale * idf[touched, None]
    model = LanguageModel(names, weights, b, 1.0, orders)
    held = [e for e in examples if e[3]]
    if held:
        logits = np.array([share @ weights[at] + b for at, share, _, _ in held])
        target = np.array([e[2] for e in held])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(held)), target] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def predict_languages(
    model: LanguageModel | None, memo: WordMemo | None, texts: list[str], unlearned: str | None = UNDETERMINED
) -> tuple[list[str | None], list[float]]:
    """The language and its calibrated probability for each text; `und` and 0 without a letter, `unlearned` and 0 without a model."""
    lettered = [has_letter(t) for t in texts]
    names, scores = [unlearned if told and not model else UNDETERMINED for told in lettered], [0.0] * len(texts)
    if model and any(lettered):
        sums = np.zeros((len(texts), len(model.languages) + 1))
        for group in word_groups([t if told else "" for t, told in zip(texts, lettered)]):
            words = [piece.lower().split() for _, piece in group]
            if any(words):
                rows = memo([w for ws in words for w in ws])
                np.add.at(sums, [i for i, _ in group], sum_by_text(rows, map(len, words)))
        p = model.probabilities(model.logits(sums))
        best = p.argmax(axis=1)
        for i, told in enumerate(lettered):
            if told:
                names[i], scores[i] = model.languages[best[i]], float(p[i, best[i]])
    return names, scores


class NgramCounter:
    """In how many texts each bucket of n-grams occurs."""

    def __init__(self, orders: tuple[int, ...], buckets: int) -> None:
        self.orders, self.texts = orders, 0
        self.df = np.zeros(buckets, np.int64)
        self.held = np.zeros(buckets, bool)
        self.open: int | None = None  # the text whose buckets are marked in held; it may go on in the next group

    def add_all(self, texts: list[str]) -> None:
        """Counts the texts, a group at a time: the distinct words of a group have their n-grams made together."""
        for group in word_groups(texts):
            words = [piece.lower().split() for _, piece in group]
            known: dict[str, int] = {}
            at = [np.fromiter((known.setdefault(w, len(known)) for w in set(ws)), np.int64) for ws in words]
            names = list(known)
            parts = [(numbers, *ngrams_of(joined, sizes, self.orders, len(self.df), own)) for numbers, joined, sizes, own in segments(names, self.orders)]
            found = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
            owner = np.concatenate([p[0][p[2]] for p in parts]) if parts else np.zeros(0, np.int64)
            if len(parts) > 1:
                order = np.argsort(owner, kind="stable")
                found, owner = found[order], owner[order]
            starts = np.searchsorted(owner, np.arange(len(names) + 1))
            for (i, _), own in zip(group, at):
                if self.open != i:
                    self._close()
                    self.open = i
                length = starts[own + 1] - starts[own]
                self.held[found[np.repeat(starts[own] - np.cumsum(length) + length, length) + np.arange(length.sum())]] = True
        self._close()
        self.texts += len(texts)

    def _close(self) -> None:
        """Counts what the open text holds, once for each bucket."""
        if self.open is not None:
            at = np.flatnonzero(self.held)
            self.df[at] += 1
            self.held[at] = False
        self.open = None


def count_ngrams(texts: DataFrame, orders: tuple[int, ...], buckets: int, blocks: int = 64) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of rows.

    A task sends one vector, in blocks of equal size; each block is summed as its parts arrive.
    The result has the fixed size of the table of buckets.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = NgramCounter(orders, buckets)
        for batch in batches:
            counter.add_all(batch.column(0).to_pylist())
        if counter.texts:
            parts = [p.astype("<i8").tobytes() for p in np.split(counter.df, blocks)]
            n = [counter.texts, *[0] * (blocks - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "df"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for block, more, df in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(df, "<i8")
                total[block] = total[block] + part if block in total else part
                n += more
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n, *[0] * (len(total) - 1)], pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "n", "df"])

    kind = "block int, n long, df binary"
    rows = texts.mapInArrow(lean(counted), kind).repartition(blocks, "block").mapInArrow(lean(summed), kind).collect()
    df = np.zeros((blocks, buckets // blocks), np.int64)
    for r in rows:
        df[r["block"]] = np.frombuffer(r["df"], "<i8")
    return df.ravel(), sum(r["n"] for r in rows)


def train_language_model(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 3000, most_chars: int = 1 << 26,
    folds: int = 3, held: int = 1, buckets: int = 1 << 18,
) -> LanguageModel | None:
    """The model of the rows outside the held-out fold that have a language and a text with a letter; None without any."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (fold_of(docs, key, folds) != held))
    rows = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_value"))
    told = bounded_sample(rows, smallest_keys(rows.select("_key"), "_key", most), most_chars)
    told = [(t, name) for t, name in told if has_letter(t)]
    if not told:
        return None
    orders = (1, 2, 3, 4)
    counts = count_ngrams(rows.where("_text IS NOT NULL").select("_text"), orders, buckets)
    return fit_language_model([t for t, _ in told], [name for _, name in told], buckets, orders, counts=counts)


def language_column(model: LanguageModel | None, docs: DataFrame, text: str = "text", unlearned: str | None = UNDETERMINED) -> Column:
    """A struct of lang_pred and score for each text; other columns of the rows stay in the JVM."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        memo = WordMemo(model.word_rows) if model else None
        for batch in batches:
            names, scores = predict_languages(model, memo, batch.to_pylist(), unlearned)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    run = lean(run)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return found(text_of(docs, text))


def identify_language(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 3000, most_chars: int = 1 << 26,
    folds: int = 3, held: int = 1, unlearned: str | None = UNDETERMINED,
) -> DataFrame:
    """Predicts the language of every whole text.

    Returns key, held_out (crc32 of the key modulo `folds` is `held`), lang_pred and
    score (the calibrated probability, 0 to 1). Document frequencies are counted over all
    rows outside the held-out fold that have a language; weights and temperature are fitted
    on at most `most` of these rows and `most_chars` characters, one row a key, those with
    the smallest md5 of the key. The model has a fixed size and is broadcast. Only text
    and lang are learned from, and only text is scored. A text that is null or has no
    letter gets `und` and 0; when there is nothing to learn from, a text with a letter
    gets `unlearned` and 0. Of several rows of one key, one is learned from.
    A very long text is read in parts. Rows are independent: ties, repeated rows and null
    keys pass through; an empty table gives an empty result; other columns are not read.
    """
    model = train_language_model(docs, key, text, lang, most, most_chars, folds, held)
    found = docs.select(F.col(key), (fold_of(docs, key, folds) == held).alias("held_out"), language_column(model, docs, text, unlearned).alias("_found"))
    return found.select(F.col(key), "held_out", "_found.lang_pred", "_found.score")
