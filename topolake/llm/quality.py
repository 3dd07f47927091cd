"""Operator 4: a quality classifier.

A byte-level convolutional network: learned filters over overlapping chunks of eight bytes that
cover the whole document, the greatest response of each, and one probability from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from topolake.llm.cnn import Adam, Filters, labelled_sample

#: Chunks start every GROUP bytes and span two groups.
GROUP, FILTERS = 4, 24
#: The model learns from at most so many pieces of labelled documents; a piece is a whole text or, of a longer one, so many characters.
SAMPLE, PIECE = 6_000, 50_000
#: The sample is gone through so often, and more often until so many updates are made.
EPOCHS, UPDATES = 10, 1500
BATCH, RATE, SEED = 32, 0.004, 11
#: Bytes scored at once.
CHUNK = 1 << 18


def as_groups(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each filled up to whole groups and followed by an empty one, and the groups where they start."""
    sizes = np.array([-(-len(t) // GROUP) + 1 for t in texts])
    data = np.frombuffer(b"".join(t.ljust(int(n) * GROUP, b"\0") for t, n in zip(texts, sizes, strict=True)), np.uint8)
    return data, np.cumsum(sizes) - sizes


class QualityModel:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.filters = Filters(GROUP, (2,), FILTERS, rng)
        self.weights = (rng.normal(size=FILTERS) * 0.1).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest responses [documents, filters] before the bias."""
        y = self.filters.responses(data)[0]
        ends = np.append(starts[1:], len(y))
        y[ends[ends - starts > 1] - 1] = -np.inf  # chunks that would begin in the empty group
        return np.maximum.reduceat(y, starts)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        active = np.tanh(pooled + self.filters.bias)
        return 1 / (1 + np.exp(-(active @ self.weights + self.offset[0]).clip(-30, 30)))

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out, group, size = [], [], 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                out.append(self.head(self._long(group[0]) if len(group) == 1 else self.pooled(*as_groups(group))))
                group, size = [], 0
        return np.concatenate(out) if out else np.empty(0)

    def _long(self, text: bytes) -> np.ndarray:
        """Pieces of a text that overlap by a group, so that no chunk is missed."""
        parts = [text[at : at + CHUNK + GROUP] for at in range(0, max(1, len(text)), CHUNK)]
        return np.max([self.pooled(*as_groups([p])) for p in parts], axis=0)

    def fit(self, sample: list[tuple[str, int]]) -> "QualityModel":
        rng = np.random.default_rng(SEED)
        texts, labels = [t.encode() for t, _ in sample], np.array([float(y) for _, y in sample], np.float32)
        if len(sample):
            rate = labels.mean().clip(0.01, 0.99)
            self.offset[0] = np.log(rate / (1 - rate))
        optimiser = Adam([*self.filters.parameters(), self.weights, self.offset], RATE)
        epochs = max(EPOCHS, -(-UPDATES * BATCH // max(1, len(texts))))
        for epoch in range(epochs):
            optimiser.rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                data, starts = as_groups([texts[i] for i in part])
                y = self.filters.responses(data)[0]
                ends = np.append(starts[1:], len(y))
                places = np.stack([s + y[s : max(s + 1, e - 1)].argmax(0) for s, e in zip(starts, ends, strict=True)])
                active = np.tanh(y[places, np.arange(FILTERS)] + self.filters.bias)
                slope = (1 / (1 + np.exp(-(active @ self.weights + self.offset[0]).clip(-30, 30))) - labels[part]) / len(part)
                slopes = slope[:, None] * self.weights * (1 - active**2)
                optimiser.update([*self.filters.gradients(data, places, slopes), active.T @ slope, slope.sum(keepdims=True)])
        return self


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel | None:
    """Learns from labelled rows outside the held-out third (crc32 of the key modulo 3 is 1).  None without labels."""
    marks = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out("key"))
    sized = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sample = labelled_sample(sized, marks, SAMPLE, PIECE, SEED)
    return QualityModel().fit(sample) if sample else None


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def probability(text: Column, model: QualityModel | None) -> Column:
    """The model's probability of label 1; 0.5 without a model.  A null text is scored as an empty one."""

    @F.arrow_udf(T.DoubleType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = np.full(len(batch), 0.5) if model is None else model.probabilities([(t.as_py() or "").encode() for t in batch])
            yield pa.array(np.asarray(found, np.float64))

    return run(text.cast("string"))


def accepted(docs: DataFrame, model: QualityModel | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose probability is ``least`` or more, with their own columns alone; all without a model."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), probability(F.col(f"`{text}`"), model).alias("quality"))
    return rows.filter(F.col("quality") >= least).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row; the score sees the text alone.

    Repeated rows are scored each; a null key isn't held out; an empty table gives none.  Labels other than 0
    and 1 teach nothing; where no label is left, every score is 0.5.
    """
    model = train(docs, labels, key, text)
    scored = docs.select(F.col(key).cast("long").alias("key"), probability(F.col(text), model).alias("score"))
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
