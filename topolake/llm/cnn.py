"""Small convolutional networks over bytes, in numpy.

Bytes become vectors, a few of them side by side a group; a filter spans one or more groups that
follow each other and moves by one group.  Of each filter the greatest response counts, so
training only has to look at the places where these stood.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Numbers that stand for a byte.
DEPTH = 8


class Filters:
    """Convolutions of several spans over groups of bytes."""

    def __init__(self, group: int, spans: tuple[int, ...], count: int, rng: np.random.Generator):
        self.group, self.spans, self.count = group, spans, count
        self.table = (rng.normal(size=(256, DEPTH)) * 0.5).astype(np.float32)
        self.weights = [(rng.normal(size=(s * group * DEPTH, count)) / np.sqrt(s * group * DEPTH)).astype(np.float32) for s in spans]
        self.bias = np.zeros(len(spans) * count, np.float32)

    @property
    def size(self) -> int:
        return len(self.spans) * self.count

    def responses(self, data: np.ndarray) -> list[np.ndarray]:
        """Of each span, [groups, count]; the last span - 1 rows run past the end and are lowest."""
        x = self.table[data].reshape(-1, self.group * DEPTH)
        wide, out = self.group * DEPTH, []
        for span, w in zip(self.spans, self.weights, strict=True):
            y = x @ w[:wide]
            for i in range(1, span):
                y[:-i] += x[i:] @ w[i * wide : (i + 1) * wide]
            out.append(y)
        return out

    def gradients(self, data: np.ndarray, places: np.ndarray, slopes: np.ndarray) -> list[np.ndarray]:
        """Of table, weights and bias; places and slopes: [pools, size], the group where each filter's maximum began and the loss's slope there."""
        grad_table, grad_weights = np.zeros_like(self.table), []
        for k, (span, w) in enumerate(zip(self.spans, self.weights, strict=True)):
            at, slope = places[:, k * self.count : (k + 1) * self.count], slopes[:, k * self.count : (k + 1) * self.count]
            taken = data[(at[..., None] * self.group + np.arange(span * self.group)).clip(max=len(data) - 1)]
            patch = self.table[taken].reshape(*at.shape, -1)
            grad_weights.append(np.einsum("pfx,pf->xf", patch, slope))
            back = (slope[..., None] * w.T[None]).reshape(-1, DEPTH)
            for d in range(DEPTH):
                grad_table[:, d] += np.bincount(taken.ravel(), back[:, d], 256)
        return [grad_table, *grad_weights, slopes.sum(0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.weights, self.bias]


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(p.dtype)


def labelled_sample(rows: DataFrame, labels: DataFrame | None, most: int, piece: int, seed: int) -> list[tuple[str, object]]:
    """(text, label) of the ``most`` pieces of least hash, of rows (key, text) with labels (key, label), or rows (key, text, label), cut into pieces of at most ``piece`` characters.

    Texts of every length take part, long ones with more pieces; most * piece bounds what comes to the driver.
    The hashes are chosen first, without the texts, and then only the chosen texts meet their labels.
    """
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")))
    cut = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n", F.explode(numbers))
    hashed = cut.withColumn("h", F.xxhash64(F.lit(seed), "key", "text", "n"))
    named = lambda part: (part if labels is None else part.join(labels, "key")).filter("label is not null")
    last = named(hashed.drop("text", "n")).select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = hashed.filter(F.col("h") <= last).withColumn("text", F.substring(F.col("text"), F.col("n") * piece + 1, F.lit(piece)))
    found = named(chosen).select("h", "text", "label").limit(most).collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["h"], r["text"], str(r["label"])))]
