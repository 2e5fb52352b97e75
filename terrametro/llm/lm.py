"""Texts scored by a log-bilinear language model.

Word counts are gathered over the whole training corpus. Words fall into slots: the end, the
most frequent words one each, all others by their last bytes. The network predicts the next slot
from the slots before it; a word's share of its slot comes from the counts, with one added for
every word and one for all unknown ones, so that the probabilities of all next words sum to 1.

The network is fitted on every training text: each task runs noise-contrastive steps on its
rows from the common parameters, and the results are averaged by the tokens they have seen.
Scoring takes exact softmaxes by batched matrix products.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged

#: Slots of single words (the end is slot 0), slots of the other words, embedding size.
TOP, OTHER, DIM = 127, 128, 16
SLOTS = 1 + TOP + OTHER
#: Words before a token that are seen one by one, and those before them seen as a mean.
NEAR, WIDE = 3, 16
NOISE, BATCH, RATE, ROUNDS = 48, 1024, 0.1, 2
#: Words whose counts tasks hold; the counts of all others are joined.
HELD_WORDS = 60_000
_FLUSH = 200_000
_PAD = NEAR + WIDE
_STORED = np.dtype("<u2")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def slot_of_rare(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-3:]) % OTHER


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(body) -> (word binary, c): counts over all rows, folded in each task before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(words_of(text.as_py()))
                if len(counts) > _FLUSH:
                    yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema)
                    counts = Counter()
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema)

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What tasks need of the counts: held words with count and slot, and the slots' totals."""

    def __init__(self, counts: DataFrame, texts: int):
        top = [(bytes(r["word"]), r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(TOP).collect()]
        self.ends = texts
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.distinct = total[0] + texts, total[1] + (texts > 0)
        # Words with a slot of their own are held in any case.
        held = dict(top) | self._held(counts)
        self.words, self.counts = list(held), np.array(list(held.values()), np.int64)
        single = {w: 1 + i for i, (w, _) in enumerate(top)}
        self.slots = np.array([single.get(w) or slot_of_rare(w) for w in self.words], np.int64)
        # Totals of the shared slots without the words that have their own.
        slot = F.crc32(F.substring("word", -3, 3)) % OTHER + 1 + TOP
        self.slot_tokens, self.slot_words = np.zeros(SLOTS), np.zeros(SLOTS)
        for r in counts.groupBy(slot.cast("int").alias("slot")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            self.slot_tokens[r["slot"]], self.slot_words[r["slot"]] = r["n"], r["v"]
        for word, c in top:
            for slot, sign in ((single[word], 1), (slot_of_rare(word), -1)):
                self.slot_tokens[slot] += sign * c
                self.slot_words[slot] += sign
        self.slot_tokens[0], self.slot_words[0] = texts, texts > 0
        self.index: dict[bytes, int] | None = None

    @staticmethod
    def _held(counts: DataFrame) -> dict[bytes, int]:
        """The words of the highest counts, as many whole count classes as HELD_WORDS allow."""
        level = F.floor(F.log2("c") * 8)
        sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least, held = None, 0
        for k, n in sizes:
            held += n
            if held > HELD_WORDS:
                break
            least = k
        rows = [] if least is None else counts.where(level >= least).select("word", "c").collect()
        return {bytes(r["word"]): r["c"] for r in rows}

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Numbers of held words, -1 for others."""
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def slots_of(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        slots = self.slots[codes] if len(self.slots) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(codes < 0).tolist():
            slots[i] = slot_of_rare(words[i])
        return slots


def start(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    share = vocabulary.slot_tokens + 1
    return {
        "context": rnd.normal(0, 0.3, (SLOTS + 1, DIM)).astype(np.float32), "target": rnd.normal(0, 0.1, (SLOTS, DIM)).astype(np.float32),
        "mix": np.full((NEAR + 1, DIM), 0.5, np.float32), "bias": np.log(share / share.sum()).astype(np.float32),
    }


def _window(rows: np.ndarray) -> np.ndarray:
    """Sums over the WIDE rows that end NEAR + 1 before each row; WIDE is a power of two."""
    sums = np.zeros_like(rows)
    sums[NEAR + 1 :] = rows[: -NEAR - 1]
    by = 1
    while by < WIDE:
        more = sums.copy()
        more[by:] += sums[:-by]
        sums, by = more, 2 * by
    return sums


def _window_back(rows: np.ndarray) -> np.ndarray:
    """Each row's sum over the rows whose window holds it."""
    sums, by = rows, 1
    while by < WIDE:
        more = sums.copy()
        more[:-by] += sums[by:]
        sums, by = more, 2 * by
    out = np.zeros_like(rows)
    out[: -NEAR - 1] = sums[NEAR + 1 :]
    return out


def predict(model: dict, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted vectors of all places, with the embeddings and window means they came from."""
    seen = model["context"].take(slots, axis=0)
    mean = _window(seen)
    mean /= WIDE
    out = model["mix"][NEAR] * mean
    for j in range(NEAR):
        out[j + 1 :] += model["mix"][j] * seen[: -j - 1]
    return out, seen, mean


def sequence(slots: list[np.ndarray]) -> np.ndarray:
    """Texts one after another, each after enough pads to see no other text, each with its end."""
    pad, end = np.full(_PAD + 1, SLOTS, np.int64), np.zeros(1, np.int64)
    return np.concatenate([x for s in slots for x in (pad, s, end)])


def fit_batch(model: dict, square: dict, slots: np.ndarray, aims: np.ndarray, noise: np.ndarray, share: np.ndarray) -> None:
    """One noise-contrastive step: the tokens at aims against noise slots drawn by their share of all tokens."""
    vectors, seen, mean = predict(model, slots)
    aim, h = slots[aims], vectors[aims]
    n = max(len(aim), 1)
    shift = np.log(len(noise) * share).astype(np.float32)
    wanted, drawn, level = model["target"].take(aim, axis=0), model["target"][noise], model["bias"] - shift
    good = 1 / (1 + np.exp(np.einsum("td,td->t", h, wanted) + level[aim]))
    bad = h @ drawn.T
    bad += level[noise]
    np.negative(bad, out=bad)
    np.exp(bad, out=bad)
    bad += 1
    np.divide(-1, bad, out=bad)
    pulled = _scatter(noise, bad.T @ h, SLOTS)
    wanted *= good[:, None]
    wanted += bad @ drawn
    back = np.zeros_like(vectors)
    back[aims] = wanted
    h *= good[:, None]
    target, bias = pulled + _scatter(aim, h, SLOTS), np.bincount(aim, good, SLOTS) + np.bincount(noise, bad.sum(axis=0), SLOTS)
    mix = np.stack([np.einsum("td,td->d", back[j + 1 :], seen[: -j - 1]) for j in range(NEAR)] + [np.einsum("td,td->d", back, mean)])
    spread = _window_back(back * (model["mix"][NEAR] / WIDE))
    for j in range(NEAR):
        spread[: -j - 1] += back[j + 1 :] * model["mix"][j]
    steps = {"target": target, "bias": bias, "mix": mix, "context": _scatter(slots, spread, SLOTS + 1)}
    for name, step in steps.items():
        step = (step / n).astype(np.float32)
        square[name] += step * step
        model[name] += RATE * step / np.sqrt(square[name])


def pieces(slots: np.ndarray, size: int):
    """A text with its end in pieces of at most size tokens, each after the _PAD + 1 places before it."""
    line = sequence([slots])
    for at in range(_PAD + 1, len(line), size):
        yield line[at - _PAD - 1 : at + size]


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    places = (rows[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(places, values.ravel(), n * DIM).reshape(n, DIM)


def fit(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Averages what all tasks learned from the common parameters, round by round. texts(slots): as _coded gives them."""
    model = start(vocabulary)
    share = (vocabulary.slot_tokens + 1) / (vocabulary.slot_tokens + 1).sum()
    below = np.cumsum(share)
    names, shapes = list(model), {k: v.shape for k, v in model.items()}
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            own = {k: v.copy() for k, v in shared.value.items()}
            square = {k: np.full(v.shape, 1e-6, np.float32) for k, v in own.items()}
            rnd, tokens, waiting, size = np.random.default_rng(turn), 0, [], 0

            def step():
                starts = np.cumsum([0, *(len(x) for x in waiting)])[:-1]
                aims = np.ones(sum(len(x) for x in waiting), bool)
                aims[(starts[:, None] + np.arange(_PAD + 1)).ravel()] = False
                noise = np.minimum(np.searchsorted(below, rnd.random(NOISE), "right"), SLOTS - 1)
                fit_batch(own, square, np.concatenate(waiting), np.flatnonzero(aims), noise, share)

            for batch in batches:
                for line in batch.column(0).cast(pa.binary()):
                    for piece in pieces(np.frombuffer(line.as_py(), _STORED).astype(np.int64), BATCH):
                        waiting.append(piece)
                        size += len(piece) - _PAD - 1
                        if size >= BATCH:
                            step()
                            tokens, waiting, size = tokens + size, [], 0
            if waiting:
                step()
                tokens += size
            flat = np.concatenate([own[k].ravel() for k in names]).astype(np.float64)
            if tokens:
                yield pa.RecordBatch.from_pydict({"pos": np.arange(len(flat)), "v": flat * tokens, "w": np.full(len(flat), float(tokens))})

        rows = texts.mapInArrow(run, "pos bigint, v double, w double").groupBy("pos").agg((F.sum("v") / F.sum("w")).alias("v")).collect()
        if not rows:
            return model
        flat = np.zeros(len(rows), np.float32)
        for r in rows:
            flat[r["pos"]] = r["v"]
        at = 0
        for k in names:
            size = int(np.prod(shapes[k]))
            model[k] = flat[at : at + size].reshape(shapes[k])
            at += size
    return model


def slot_log10(model: dict, slots: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """log10 probability of every place's slot by exact softmax; 0 at pads."""
    out, vectors = np.zeros(len(slots)), predict(model, slots)[0]
    real, ones = np.flatnonzero(slots < SLOTS), np.ones((SLOTS, 1), np.float32)
    target = np.concatenate([model["target"], model["bias"][:, None], ones], axis=1)
    # Scores are shifted only where their bound could overflow exp.
    bound = np.linalg.norm(vectors, axis=1) * np.linalg.norm(model["target"], axis=1).max() + model["bias"].max()
    shift = -np.maximum(bound - 60, 0)[:, None].astype(np.float32)
    vectors = np.concatenate([vectors, np.ones((len(vectors), 1), np.float32), shift], axis=1)
    for at in range(0, len(real), chunk):
        some = real[at : at + chunk]
        scores = vectors[some] @ target.T
        aim = scores[np.arange(len(some)), slots[some]]
        total = (np.exp(scores, out=scores) @ ones)[:, 0]
        out[some] = (aim - np.log(np.maximum(total, 1e-37))) / np.log(10)
    return out


def _coded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows(id, learn, body), read once: the slots of each text, its sums from held counts and its words that are not held."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        held = shared.value
        base_of = np.log10(held.tokens + held.distinct + 1)
        slot_base = np.log10(held.slot_tokens + held.slot_words + 1)
        logs = np.log10(held.counts + 1) if len(held.counts) else np.zeros(1)
        end = np.log10(held.ends + 1)
        for batch in batches:
            n_tokens, n_known, base, share, rare, lines = [], [], [], [], [], []
            for text in batch.column("body").cast(pa.binary()):
                read = words_of(text.as_py())
                codes = held.codes(read)
                slots = held.slots_of(read, codes)
                known = codes >= 0
                shares = logs[codes[known]].sum() + end
                n_tokens.append(len(read) + 1)
                n_known.append(int(known.sum()) + int(held.ends > 0))
                base.append(shares - (len(read) + 1) * base_of)
                share.append(shares - slot_base[slots].sum() - slot_base[0])
                lines.append(slots.astype(_STORED).tobytes())
                rare.append([read[i] for i in np.flatnonzero(~known).tolist()])
            columns = {
                "uid": batch.column("uid"), "id": batch.column("id"), "learn": batch.column("learn"), "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()), "share": pa.array(share, pa.float64()),
                "slots": pa.array(lines, pa.binary()), "rare": pa.array(rare, pa.list_(pa.binary())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"uid bigint, id {kind}, learn boolean, n_tokens bigint, n_known bigint, base double, share double, slots binary, rare array<binary>"
    return rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema)


def score_texts(docs: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learn: a boolean column; the model learns from the rows where it is true, the others are held out.
    base_score: log10 of add-one unigram probabilities; score: log10 probability by the model.
    Tokens are words, A-Z in lower case, and one end. Missing texts count as empty: their end is
    their one token. Nothing to learn from gives every word the unknown word's probability.
    Repeated rows are answered each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_column).alias("body"))
    texts = rows.where("learn").select("body")
    counts = staged(word_counts(texts), "counts")
    vocabulary = Vocabulary(counts, texts.count())
    kind = rows.schema["id"].dataType.simpleString()
    coded = staged(_coded(rows, vocabulary), "coded")
    model = fit(coded.where("learn").select("slots"), vocabulary)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lines = [np.frombuffer(x.as_py(), _STORED).astype(np.int64) for x in batch.column("slots").cast(pa.binary())]
            yield batch.drop_columns("slots").append_column("score", pa.array(batch.column("share").to_numpy() + _sums(shared.value, lines)))

    read = coded.select("uid", "id", "learn", "n_tokens", "n_known", "base", "share", "slots")
    schema = f"uid bigint, id {kind}, learn boolean, n_tokens bigint, n_known bigint, base double, share double, score double"
    scored = read.mapInArrow(run, schema)
    # Unknown words add log10(1); of the others only the count is missing.
    missing = coded.select("uid", F.explode("rare").alias("word")).join(counts, "word")
    added = missing.groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(added, "uid", "left").select(
        F.col("id").alias(id_column), (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def _sums(model: dict, lines: list[np.ndarray], together: int = 8192) -> np.ndarray:
    """The model's sum over each text; short texts share matrices, long ones are read in pieces."""
    out, waiting, size = np.zeros(len(lines)), [], 0

    def flush():
        starts = np.cumsum([0, *(len(lines[d]) + _PAD + 2 for d in waiting)])[:-1]
        out[waiting] = np.add.reduceat(slot_log10(model, sequence([lines[d] for d in waiting])), starts)

    for d, line in enumerate(lines):
        if len(line) > together:
            out[d] = _whole(model, line)
            continue
        waiting.append(d)
        size += len(line)
        if size >= together:
            flush()
            waiting, size = [], 0
    if waiting:
        flush()
    return out


def _whole(model: dict, slots: np.ndarray, piece: int = 1 << 17) -> float:
    """Sum over a whole text, in pieces that see the words before them."""
    line = sequence([slots])
    total = 0.0
    for at in range(0, len(line), piece):
        begin = max(0, at - _PAD - 1)
        total += slot_log10(model, line[begin : at + piece])[at - begin :].sum()
    return float(total)
