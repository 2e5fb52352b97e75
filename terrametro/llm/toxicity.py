"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word's embedding is the sum of rows picked by hashes of the word (twice) and of its beginning,
so that unseen forms of a known stem are recognised and single hash collisions don't decide.
Filters of several widths run over the words; each keeps its maximum over the whole text.
Thresholds are set per language, as guessed from the text's own function words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import staged
from .common import small

#: Labelled rows a fit looks at, and the longest text among them, in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 12_000, 30_000
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 8, 1 << 16
#: Words scored in one matrix.
CHUNK = 1 << 18
PARTS = 4

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as be by this are from",
    "de": "der die und das von den zu mit sich des auf ist nicht ein dem für",
    "fr": "le la les et des du une que qui dans pour est sur par au pas avec",
    "es": "el los las que y en del se por con no una su para al lo como",
}
LANGUAGES = list(FUNCTION_WORDS)
_LANGUAGE_OF = {w: {k for k, v in enumerate(FUNCTION_WORDS.values()) if w in v.split()} for text in FUNCTION_WORDS.values() for w in text.split()}
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def guess_language(vocabulary: dict[str, int], ids: np.ndarray) -> int:
    """The language most of whose function words occur, most often."""
    votes = np.zeros(len(LANGUAGES))
    counts = np.bincount(ids, minlength=len(vocabulary)) if len(ids) else np.zeros(len(vocabulary))
    for word, languages in _LANGUAGE_OF.items():
        at = vocabulary.get(word)
        if at is not None and counts[at]:
            for k in languages:
                votes[k] += counts[at] / len(languages)
    return int(votes.argmax())


def buckets(words: list[str]) -> np.ndarray:
    """Rows of the embedding tables for each word: PARTS columns."""
    out = np.empty((len(words), PARTS), np.int64)
    for i, w in enumerate(words):
        data = w.encode("utf-8")
        out[i] = zlib.crc32(data), zlib.crc32(data, 77), zlib.crc32(w[:4].encode("utf-8"), 4), zlib.crc32(w[:5].encode("utf-8"), 5)
    return out % BUCKETS


class Model:
    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.tables = rnd.normal(0, 0.02, (PARTS, BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: rnd.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0, :2] += 1.0
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full((len(WIDTHS), FILTERS), 0.3, np.float32)
        self.base = np.float32(-2.0)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.tables[p][rows[:, p]] for p in range(PARTS))

    def pooled(self, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Maxima (pieces x widths x filters) of the filters begun at starts[d] up to before stops[d].

        ids index vectors, of which the last is zero.
        """
        out = np.empty((len(starts), len(WIDTHS), FILTERS), np.float32)
        bounds = np.stack([starts, stops], axis=1).ravel()
        for k, w in enumerate(WIDTHS):
            answer = sum((vectors @ self.filters[w][j])[np.concatenate([ids[j:], np.full(j + 1, len(vectors) - 1)])] for j in range(w))
            out[:, k] = np.maximum.reduceat(answer, bounds, axis=0)[::2]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled + self.bias, 0) * self.out).sum(axis=(1, 2)) + self.base

    def score(self, texts) -> np.ndarray:
        """Scores of whole texts; 0.5 is the threshold of the text's guessed language."""
        vocabulary = _Numbered()
        docs = [np.fromiter(map(vocabulary.__getitem__, words_of(t)), np.int64) for t in texts]
        vectors = np.concatenate([self.embed(buckets(list(vocabulary))) if vocabulary else np.zeros((0, DIM), np.float32), np.zeros((1, DIM), np.float32)])
        languages = np.array([guess_language(vocabulary, d) for d in docs], np.int64)
        best = np.full((len(docs), len(WIDTHS), FILTERS), -np.inf, np.float32)
        pending, valid, owners, size = [], [], [], 0
        over = max(WIDTHS) - 1
        for d, ids in enumerate(docs):
            for at in range(0, max(len(ids), 1), CHUNK):
                last = at + CHUNK >= len(ids)  # the others end in the beginning of the next piece
                pending.append(np.concatenate([ids[at:], np.full(over, len(vectors) - 1)]) if last else ids[at : at + CHUNK + over])
                valid.append(len(pending[-1]) - (0 if last else over))
                owners.append(d)
                size += len(pending[-1])
                if size >= CHUNK:
                    self._pool(vectors, pending, valid, owners, best)
                    pending, valid, owners, size = [], [], [], 0
        if pending:
            self._pool(vectors, pending, valid, owners, best)
        margin = self.logits(best) - self.thresholds[languages] if len(docs) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def _pool(self, vectors, pending, valid, owners, best) -> None:
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pending])[:-1]])
        np.maximum.at(best, owners, self.pooled(vectors, np.concatenate(pending), starts, starts + valid))


class _Numbered(dict):
    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, seed: int = 7) -> Model:
    """Fits by minibatches; a fifth of the rows, held back, sets the thresholds."""
    model, rnd = Model(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        model.base = np.float32(4.0 if len(texts) and labels.max() else -4.0)
        model.out[:] = 0
        return model
    vocabulary = _Numbered()
    docs = [np.fromiter(map(vocabulary.__getitem__, words_of(t)), np.int64) for t in texts]
    rows = buckets(list(vocabulary)) if vocabulary else np.zeros((0, PARTS), np.int64)
    order = rnd.permutation(len(docs))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    _warm_start(model, [docs[d] for d in fit], labels[fit], rows)
    pad, over = len(vocabulary), max(WIDTHS) - 1
    rows = np.concatenate([rows, np.zeros((1, PARTS), np.int64)])
    square = np.full(model.tables.shape[:2], 1e-3, np.float32)
    dense = {id(a): np.full(a.shape, 1e-2, np.float32) for a in (*model.filters.values(), model.bias, model.out)}
    for epoch in range(epochs):
        rnd.shuffle(fit)
        for at in range(0, len(fit), 32):
            batch = fit[at : at + 32]
            ids = np.concatenate([np.concatenate([docs[d], np.full(over, pad)]) for d in batch])
            starts = np.concatenate([[0], np.cumsum([len(docs[d]) + over for d in batch])])
            used, local = np.unique(ids, return_inverse=True)
            vectors = model.embed(rows[used])
            vectors[used == pad] = 0
            local_pad = len(used)
            vectors = np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
            pooled, places = np.empty((len(batch), len(WIDTHS), FILTERS), np.float32), np.empty((len(batch), len(WIDTHS), FILTERS), np.int64)
            shifted = [np.concatenate([local[j:], np.full(j, local_pad)]) for j in range(max(WIDTHS))]
            for k, w in enumerate(WIDTHS):
                answer = sum((vectors @ model.filters[w][j])[shifted[j]] for j in range(w))
                for d in range(len(batch)):
                    part = answer[starts[d] : starts[d + 1]]
                    places[d, k] = starts[d] + part.argmax(axis=0)
                    pooled[d, k] = part.max(axis=0)
            logits = model.logits(pooled)
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[batch]) / len(batch)
            active = pooled + model.bias > 0
            back = error[:, None, None] * model.out * active
            steps = {id(model.out): (error[:, None, None] * np.maximum(pooled + model.bias, 0)).sum(axis=0), id(model.bias): back.sum(axis=0)}
            change = np.zeros_like(vectors)
            for k, w in enumerate(WIDTHS):
                step = np.zeros_like(model.filters[w])
                for j in range(w):
                    seen = shifted[j][places[:, k]]
                    step[j] = np.einsum("dfe,df->ef", vectors[seen], back[:, k])
                    np.add.at(change, seen.ravel(), (back[:, k][:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM))
                steps[id(model.filters[w])] = step
            for a in (*model.filters.values(), model.bias, model.out):
                step = steps[id(a)]
                dense[id(a)] += step * step
                a -= rate * step / np.sqrt(dense[id(a)])
            model.base -= np.float32(rate * error.sum())
            touched = np.flatnonzero(np.abs(change[:-1]).sum(axis=1) > 0)
            touched = touched[used[touched] != pad]
            for p in range(PARTS):
                at_rows = rows[used[touched], p]
                np.add.at(square[p], at_rows, (change[touched] ** 2).mean(axis=1))
                np.add.at(model.tables[p], at_rows, -rate * change[touched] / np.sqrt(square[p][at_rows])[:, None])
    _calibrate(model, [texts[d] for d in held], labels[held])
    return model


def _warm_start(model: Model, docs: list[np.ndarray], labels: np.ndarray, rows: np.ndarray) -> None:
    """First coordinate of each row: smoothed log odds of the label where the row occurs."""
    positive = max(labels.sum(), 1)
    for p in range(PARTS):
        seen = np.zeros((2, BUCKETS))
        for ids, label in zip(docs, labels):
            seen[label, np.unique(rows[ids, p])] += 1
        odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (len(labels) - positive + 1))
        enough = seen.sum(axis=0) >= 3
        model.tables[p, :, 0] = np.where(enough, np.clip(odds, -3, 5) / PARTS, 0)


def _calibrate(model: Model, texts: list[str], labels: np.ndarray) -> None:
    """Per guessed language the threshold of fewest errors, in the middle of its range; overall where one lacks either label."""
    if not len(texts):
        return
    margin = np.log(np.maximum(p := model.score(texts), 1e-15)) - np.log(np.maximum(1 - p, 1e-15))
    vocabulary = _Numbered()
    languages = np.array([guess_language(vocabulary, np.fromiter(map(vocabulary.__getitem__, words_of(t)), np.int64)) for t in texts])
    overall = _threshold(margin, labels)
    for k in range(len(LANGUAGES)):
        mine = languages == k
        model.thresholds[k] = _threshold(margin[mine], labels[mine]) if len(set(labels[mine])) == 2 else overall


def _threshold(margin: np.ndarray, labels: np.ndarray) -> float:
    if len(set(labels)) < 2:
        return 0.0
    cuts = np.unique(margin)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    wrong = [((margin >= c) != (labels == 1)).sum() for c in cuts]
    best = np.flatnonzero(np.array(wrong) == min(wrong))
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fits on at most about sample_rows labelled rows, picked by hashes, of at most SAMPLE_CHARS characters.

    Rows with a missing id, text or label teach nothing. Without both labels the model scores all alike.
    """
    marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    rows = marked.count()
    share = min(1.0, 1.2 * sample_rows / max(rows, 1))
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    text = F.col(text_column)
    sample = docs.select(F.col(id_column).alias("id"), text.alias("body")).where(text.isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    picked = sample.join(small(staged(chosen, "labelled")), "id").select("body", F.col("label").cast("int").alias("label")).distinct()
    found = picked.withColumn("h", F.xxhash64("body")).orderBy("h").limit(sample_rows).collect()
    return train([r["body"] for r in found], np.array([r["label"] for r in found], np.int64))


def score_column(text: Column, model: Model, spark: SparkSession) -> Column:
    """Toxicity of each whole text, from 0 to 1; missing and empty texts are scored as texts without words."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return run(text)
