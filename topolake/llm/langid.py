"""Operator 5: language identification.

A byte convolutional network: filters of several widths over windows of fixed length, the greatest response
of each and a softmax over the languages seen in training.  A text's windows vote
by the logarithm of their probabilities, in proportion to the bytes they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topolake.llm.cnn import Adam, Filters, labelled_sample

#: Filters move by GROUP bytes and span 1, 2 and 3 groups; a window has WINDOW bytes.
GROUP, SPANS, FILTERS, WINDOW = 2, (1, 2, 3), 16, 256
#: The model learns from at most so many pieces of texts; a piece is a whole text or, of a longer one, so many characters.
#: Of the windows of all those pieces it takes at most so many, at random.
SAMPLE, PIECE, WINDOWS = 4_000, 20_000, 20_000
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.004, 23
CHUNK = 1 << 17
UNKNOWN = "und"


class LanguageModel:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = Filters(GROUP, SPANS, FILTERS, rng)
        self.weights = (rng.normal(size=(self.filters.size, len(languages))) * 0.1).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """[windows, groups, filters]; filters that would run out of their window are lowest."""
        parts = []
        for span, y in zip(SPANS, self.filters.responses(data), strict=True):
            y = y.reshape(-1, WINDOW // GROUP, FILTERS)
            if span > 1:
                y[:, 1 - span :] = -np.inf
            parts.append(y)
        return np.concatenate(parts, 2)

    def pooled(self, data: np.ndarray) -> np.ndarray:
        out = []
        for span, y in zip(SPANS, self.filters.responses(data), strict=True):
            out.append(y.reshape(-1, WINDOW // GROUP, FILTERS)[:, : WINDOW // GROUP - span + 1].max(1))
        return np.concatenate(out, 1)

    def log_probabilities(self, active: np.ndarray) -> np.ndarray:
        z = active @ self.weights + self.offset
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def window_scores(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([self.log_probabilities(np.tanh(self.pooled(data[at : at + CHUNK]) + self.filters.bias)) for at in range(0, len(data), CHUNK)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        chosen = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(chosen), 128):
            part = chosen[at : at + 128]
            raw = [texts[i].encode() for i in part]
            counts = np.array([-(-len(t) // WINDOW) for t in raw])
            data = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(raw, counts, strict=True)), np.uint8)
            starts = np.cumsum(counts) - counts
            held = np.full(len(data) // WINDOW, float(WINDOW))
            held[starts + counts - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(raw, counts, strict=True)]
            votes = np.add.reduceat(self.window_scores(data) * held[:, None], starts) / np.add.reduceat(held, starts)[:, None]
            p = np.exp(votes - votes.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, s in zip(part, p.argmax(1), p.max(1), strict=True):
                names[i], scores[i] = self.languages[k], float(s)
        return names, scores

    def fit(self, sample: list[tuple[str, str]]) -> "LanguageModel":
        rng = np.random.default_rng(SEED)
        windows, labels = [], []
        for text, lang in sample:
            raw = text.encode()
            windows.append(raw.ljust(-(-len(raw) // WINDOW) * WINDOW, b"\0"))
            labels += [self.languages.index(lang)] * (len(windows[-1]) // WINDOW)
        data, target = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels)
        chosen = np.sort(rng.permutation(len(data))[:WINDOWS])
        data, target = data[chosen], target[chosen]
        optimiser = Adam([*self.filters.parameters(), self.weights, self.offset], RATE)
        for epoch in range(EPOCHS):
            optimiser.rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                flat = data[part].ravel()
                y = self.responses(flat)
                best = y.argmax(1)
                active = np.tanh(np.take_along_axis(y, best[:, None], 1)[:, 0] + self.filters.bias)
                slope = np.exp(self.log_probabilities(active))
                slope[np.arange(len(part)), target[part]] -= 1
                slope /= len(part)
                slopes = slope @ self.weights.T * (1 - active**2)
                places = best + np.arange(len(part))[:, None] * (WINDOW // GROUP)
                optimiser.update([*self.filters.gradients(flat, places, slopes), active.T @ slope, slope.sum(0)])
        return self


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Learns from rows with a language outside the held-out fifth (crc32 of the key modulo 5 is 0).  None without any."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("label"))
    sample = [(t, y) for t, y in labelled_sample(rows.filter(F.col("key").isNotNull() & ~held_out("key")), None, SAMPLE, PIECE, SEED) if t]
    return LanguageModel(sorted({y for _, y in sample})).fit(sample) if sample else None


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row; the prediction sees the text alone.

    A null text, and one without a letter, is ``und`` with score 0; so is every text where nothing could be learned.
    Repeated rows are judged each; a null key is neither held out nor learned from; an empty table gives none.
    """
    model = train(docs, key, text, lang)

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            names, scores = ([UNKNOWN] * len(texts), [0.0] * len(texts)) if model is None else model.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, lang_pred string, score double")
    return found.select(F.col("key").alias(key), held_out("key").alias("held_out"), "lang_pred", "score")
