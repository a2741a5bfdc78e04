"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, repeats included; their embeddings are averaged
and go through one linear layer with two outcomes. Few words of a text decide its label, so a text's
logit is the soft maximum (log-sum-exp) over its distinct words, and the gradient reaches embeddings and
layer through it. Misspelt words share n-grams with the words that were seen. Only features that several
labelled texts hold are learned, and weights decay: a wrong label does not get rare words memorised.

Features go by 64-bit hashes that numpy computes for all words of a batch at once, whatever the length
of a word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from agendry.llm.arrow import map_batches, small_batches, utf8

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that a fit takes at most (the least by a hash of doc_id), and the least count of a feature.
SAMPLE, LEAST = 4000, 5
SHORT, LONG = 3, 6
DIMENSIONS, EPOCHS, RATE, DECAY, SHARPNESS = 16, 60, 0.03, 0.03, 4.0
#: Characters whose features are computed at once.
CHUNK = 1 << 18
#: Buckets of the table that rules rare features out, and of each table of learned ones.
SUMS, SLOTS = 1 << 22, 1 << 18
#: Upper bits of a hash that say in which range it is sorted.
RANGES = 4
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower())) or {""}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * SPREAD + np.uint64(size)
    return h ^ (h >> np.uint64(29))


def bags(words: list[str]):
    """For each n-gram size, and 0 for the whole word: (size, hashes, the word that each is of).

    Ends of a word are marked, so n-grams there differ from inner ones.
    """
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(letters))  # letters from here to the word's end
    h = letters + np.uint64(1)
    for n in range(2, LONG + 1):
        h = h[:-1] * BASE + letters[n - 1 :]
        if n >= SHORT:
            own = left[: len(h)] >= n
            yield n, _mixed(h[own], n), word[: len(h)][own]
    place = np.cumprod(np.full(int(lengths.max(initial=1)), BASE, np.uint64))
    spread = (letters + np.uint64(1)) * place[left - 1]
    yield 0, _mixed(np.add.reduceat(spread, ends - lengths), 0) if len(words) else spread, np.arange(len(words), dtype=np.int32)


def _portions(words: list[str]):
    """(first word, words): runs of words of about CHUNK characters."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w) + 2
        if held >= CHUNK:
            yield start, words[start : i + 1]
            start, held = i + 1, 0
    if start < len(words):
        yield start, words[start:]


class Scorer:
    """Logits of words from the logits of their features, and scores of texts."""

    def __init__(self, features: np.ndarray, logits: np.ndarray, bias: float, constant: float | None = None):
        self.features, self.logits, self.bias, self.constant = features, logits, bias, constant
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        # Features that meet in a slot of one table go on to the next.
        while len(features):
            at = (features >> np.uint64(5 * len(self.tables))) & np.uint64(SLOTS - 1)
            _, first = np.unique(at, return_index=True)
            names, values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)
            names[at[first]], values[at[first]] = features[first], logits[first]
            self.tables.append((names, values))
            rest = np.ones(len(features), bool)
            rest[first] = False
            features, logits = features[rest], logits[rest]

    def __reduce__(self):
        return Scorer, (self.features, self.logits, self.bias, self.constant)

    def word_logits(self, words: list[str]) -> np.ndarray:
        """The mean logit of the features that were learned; zero for a word without any."""
        out = np.zeros(len(words))
        for start, part in _portions(words):
            total, known = np.zeros(len(part)), np.zeros(len(part))
            for _, h, word in bags(part):
                for n, (names, values) in enumerate(self.tables):
                    at = (h >> np.uint64(5 * n)) & np.uint64(SLOTS - 1)
                    met = names[at] == h
                    own = word[met]
                    total += np.bincount(own, values[at[met]], len(part))
                    known += np.bincount(own, minlength=len(part))
                    h, word = h[~met], word[~met]
            out[start : start + len(part)] = total / np.maximum(known, 1)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text; words that texts share are looked up once."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        held: list[str] = []
        ends = []
        for text in texts:
            held.extend(distinct_words(text))
            ends.append(len(held))
        words = pa.array(held, pa.string()).dictionary_encode()
        return self._pooled(self.word_logits(words.dictionary.to_pylist())[words.indices.to_numpy()], np.array(ends))

    def _pooled(self, s: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = np.diff(ends, prepend=0)
        top = np.maximum.reduceat(s, ends - lengths)
        z = top + np.log(np.add.reduceat(np.exp(SHARPNESS * (s - np.repeat(top, lengths))), ends - lengths)) / SHARPNESS + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def frequent_features(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, feature, word): hashes of the features that texts hold LEAST times in all, in rising order, and
    (feature, word) for each place of one in the bag of a word.

    A table of sums first rules most rare features out, so few hashes are held at once.
    """
    sums = np.zeros(SUMS, np.int32)
    for start, part in _portions(words):
        for _, h, word in bags(part):
            np.add.at(sums, h & np.uint64(SUMS - 1), counts[start + word].astype(np.int32))
    hashes, owners = [], []
    for start, part in _portions(words):
        for _, h, word in bags(part):
            often = sums[h & np.uint64(SUMS - 1)] >= LEAST
            hashes.append(h[often])
            owners.append((start + word[often]).astype(np.int32))
    del sums
    h, word = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, np.uint64), (owners, np.int32)))
    del hashes, owners
    # Sorted a range of hashes at a time, so that little is held besides the hashes.
    features, numbers, words_of = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    n = 0
    for part in range(1 << RANGES):
        own = np.flatnonzero(h >> np.uint64(64 - RANGES) == part)
        own = own[np.argsort(h[own], kind="stable")]
        if not len(own):
            continue
        mine, holder = h[own], word[own]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        size = np.diff(np.append(first, len(mine)))
        often = np.add.reduceat(counts[holder], first) >= LEAST
        features.append(mine[first[often]])
        numbers.append(np.repeat(np.arange(n, n + int(often.sum()), dtype=np.int32), size[often]))
        words_of.append(holder[np.repeat(often, size)])
        n += int(often.sum())
    return np.concatenate(features), np.concatenate(numbers), np.concatenate(words_of)


def train(texts: list[list[str]], labels: np.ndarray, seed: int = 7) -> Scorer:
    """Fit on the distinct words of each text. Without rows of both labels every score is zero."""
    flat = pa.array([w for words in texts for w in words], pa.string()).dictionary_encode()
    return _train(flat, np.array([len(words) for words in texts], np.int64), np.asarray(labels, np.float64), seed)


def _train(words: pa.DictionaryArray, lengths: np.ndarray, labels: np.ndarray, seed: int = 7) -> Scorer:
    """train(), of the words of all texts one after the other."""
    if not len(labels) or labels.min() == labels.max():
        return Scorer(np.empty(0, np.uint64), np.empty(0, np.float32), 0.0, 0.0)
    tokens, n_words = words.indices.to_numpy(), len(words.dictionary)
    features, feature, word = frequent_features(words.dictionary.to_pylist(), np.bincount(tokens, minlength=n_words))
    n_features = len(features)
    sizes = np.maximum(np.bincount(word, minlength=n_words), 1)
    text_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]

    rng = np.random.default_rng(seed)
    table = (rng.normal(size=(n_features, DIMENSIONS)) * 0.1).astype(np.float32)
    # Two outcomes: the softmax over (0, w.x + b) is all that two linear outputs can say.
    layer, bias = (rng.normal(size=DIMENSIONS) * 0.3).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean())))
    mean, square = [np.zeros_like(table), np.zeros_like(layer)], [np.zeros_like(table), np.zeros_like(layer)]
    for step in range(1, EPOCHS + 1):
        word_logit = np.bincount(word, (table @ layer)[feature], n_words) / sizes
        s = word_logit[tokens]
        top = np.maximum.reduceat(s, text_at)
        share = np.exp(SHARPNESS * (s - np.repeat(top, lengths)))
        total = np.add.reduceat(share, text_at)
        z = top + np.log(total) / SHARPNESS + bias
        error = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        by_word = np.bincount(tokens, share * np.repeat(error / total, lengths), n_words) / sizes
        by_feature = np.bincount(feature, by_word[word], n_features)
        slopes = by_feature[:, None] * layer[None, :] + DECAY / len(labels) * table, table.T @ by_feature + DECAY / len(labels) * layer
        for i, (weights, slope) in enumerate(zip((table, layer), slopes)):
            mean[i] = (0.9 * mean[i] + 0.1 * slope).astype(np.float32)
            square[i] = (0.999 * square[i] + 0.001 * slope * slope).astype(np.float32)
            weights -= (RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        bias -= 2 * float(error.sum())
    return Scorer(features, (table @ layer).astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Train on at most ``sample`` labelled rows that are not held out.

    Labels of one doc_id that differ count as toxic; of texts repeated under one doc_id the least
    is taken; rows with a null doc_id or label are left aside.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column(0), b.column(1), pa.array([sorted(distinct_words(t.decode("utf-8", "replace"))) for t in utf8(b.column(2))], pa.list_(pa.string()))]

    rows = map_batches(texts, one, "doc_id long, toxic int, words array<string>").toArrow().sort_by("doc_id")
    words = rows.column("words").combine_chunks()
    return _train(words.flatten().dictionary_encode(), words.value_lengths().to_numpy().astype(np.int64), rows.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from the whole text alone."""

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column(0), pa.array(scorer.scores([t.decode("utf-8", "replace") for t in utf8(b.column(1))]), pa.float64())]

    scored = map_batches(docs.select("doc_id", "text"), one, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit and score. Null and empty texts get the score of a text without words; repeated rows and null ids stay."""
    return score(docs, fit(docs, labels, sample))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; all columns as they were."""
    scorer = fit(docs, labels, sample)
    judge = F.pandas_udf(lambda texts: pd.Series(scorer.scores(texts.fillna("").tolist())), "double")
    return small_batches(docs).where(judge(F.col("text")) < 0.5)
