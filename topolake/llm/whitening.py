"""Operator 11: embedding whitening from an exact integer scatter.

Entries are scaled to whole numbers and shifted.  Sums S and cross-products of what is left are accumulated
exactly, in tasks as Python's integers and between tasks as limbs of 48 bits; n·XᵀX − SSᵀ is formed from them in whole numbers, and only that
is turned into doubles and decomposed by eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from topolake.shipping import ship

#: Bits of a limb in sums between tasks, bits of a limb in products within a task, rows of a product, and the greatest scaled entry.
LIMB, SPLIT, ROWS, MOST = 48, 20, 8192, 1 << 62
#: Rows of a batch of results, about.
BATCH = 50_000


def integers(vectors: np.ndarray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """x = floor(scale·c) + offset of the rows whose entries are finite and fit, and which rows those are."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(vectors * scale)
        fit = (np.abs(scaled) < MOST).all(axis=1)  # false for NaN
    return scaled[fit].astype(np.int64) + offset, fit


def rows_of(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors with d entries, none of them null, as doubles, and their places."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == d)
    values = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # nulls turn into NaN
    return values, whole


def cross(x: np.ndarray) -> np.ndarray:
    """xᵀx of 64-bit integers as Python's integers; products of limbs are exact in doubles."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    width = max(1, -(-int(np.abs(x).max(initial=0)).bit_length() // SPLIT))
    limbs = [x - ((x >> SPLIT) << SPLIT) if k < width - 1 else x for k, x in ((k, x >> (SPLIT * k)) for k in range(width))]
    for start in range(0, len(x), ROWS):
        parts = [limb[start : start + ROWS].astype(np.float64) for limb in limbs]
        for i, p in enumerate(parts):
            for j, q in enumerate(parts):
                total += (p.T @ q).astype(np.int64).astype(object) << (SPLIT * (i + j))
    return total


def limbs_of(value: int) -> list[tuple[int, int]]:
    """(place, limb) whose sum of limb << 48·place is value; the last has the sign."""
    out, k = [], 0
    while value and value != -1:
        out.append((k, value & ((1 << LIMB) - 1)))
        value, k = value >> LIMB, k + 1
    return [*out, (k, -1)] if value else out


@dataclass(frozen=True)
class Whitening:
    """n, sums and directions over the list that it was fitted on."""

    d: int
    scale: float
    offset: int
    #: What was subtracted from every x, and the exact sums of the rest.
    shift: int
    n: int
    sums: tuple[int, ...]
    #: Unit eigenvectors as columns, by falling eigenvalue, and those values; the trace.
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n·x − S, exact: 64-bit where that holds all, else Python's integers."""
        x = x - self.shift
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.directions / np.sqrt(self.values)


def usual_length(rows: DataFrame) -> int:
    """The commonest length of a vector, of equals the greater; 0 where there is none."""
    found = rows.filter("vector is not null").groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))).first()[0]
    return found["d"] if found else 0


def fit(rows: DataFrame, d: int, components: int, scale: float, offset: int) -> Whitening | None:
    """One pass: a task sends n, d sums and d(d+1)/2 cross-products, the driver gets as many.

    What is subtracted is the offset, which leaves small numbers; any other shift gives the same.
    """
    shift = offset

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(rows_of(batch.column(0), d)[0], scale, offset)[0] - shift
            n += len(x)
            for start in range(0, len(x), 1 << 18):
                part = x[start : start + (1 << 18)]
                sums += sum((((part >> (31 * k)) & (2**31 - 1) if k < 2 else part >> 62).sum(axis=0).astype(object) << (31 * k)) for k in range(3))
                squares += cross(part)
        found = [(-1, -1, k, v) for k, v in limbs_of(n)]
        for i in range(d if n else 0):
            found += [(i, -1, k, v) for k, v in limbs_of(int(sums[i]))]
            found += [(i, j, k, v) for j in range(i + 1) for k, v in limbs_of(int(squares[i, j]))]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "place", "limb"])

    parts = rows.select("vector").mapInArrow(scatter, "i long, j long, place long, limb long")
    totals = parts.groupBy("i", "j", "place").agg(F.sum(F.col("limb").cast("decimal(20,0)")).alias("limb"))
    exact: dict[tuple[int, int], int] = {}
    for i, j, place, limb in totals.collect():
        exact[i, j] = exact.get((i, j), 0) + (int(limb) << (LIMB * place))
    n = exact.get((-1, -1), 0)
    if not n:
        return None
    s = [exact.get((i, -1), 0) for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            v[i, j] = v[j, i] = (n * exact.get((i, j), 0) - s[i] * s[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > d * np.finfo(float).eps * max(values.max(initial=0), 0)]
    return Whitening(d, scale, offset, shift, n, tuple(s), vectors[:, order], values[order], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened rows' covariance minus the identity, over all rows: means and centred products of each task, joined."""
    m = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            x, _ = integers(rows_of(batch.column(0), model.d)[0], model.scale, model.offset)
            for start in range(0, len(x), BATCH):
                z = model.whitened(model.apart(x[start : start + BATCH]))
                own, k = z.mean(axis=0), len(z)
                square += (z - own).T @ (z - own) + np.outer(own - mean, own - mean) * (n * k / (n + k))
                mean += (own - mean) * (k / (n + k))
                n += k
        if n:
            i, j = (a.ravel() for a in np.indices((m, m)))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(mean[i] * n), pa.array(square.ravel()), pa.array((n * np.outer(mean, mean)).ravel())], ["i", "j", "first", "square", "outer"])

    parts = rows.select("vector").mapInArrow(moments, "i long, j long, first double, square double, outer double")
    # the products of a task's mean are those of tiny numbers: taking them from their sum's loses nothing
    totals = parts.groupBy("i", "j").agg(F.sum("first").alias("first"), F.sum("square").alias("square"), F.sum("outer").alias("outer")).collect()
    mean = np.zeros(m)
    for r in totals:
        mean[r["i"]] = r["first"] / model.n
    errors = [abs((r["square"] + r["outer"]) / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in totals]
    return max(errors, default=0.0)


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): for every usable row its coordinates, up to so many.

    An entry c counts as x = floor(scale·c) + offset.  n: rows that are used, all of which the fit takes.  deviation: the exact sum of (n·x − S)² over all dimensions,
    decimal(38,0), null beyond.  whitened: (x − S/n) along a unit eigenvector of x's covariance (divisor n) over the root of its
    eigenvalue; components from 1 by falling eigenvalue.  explained: the eigenvalue's share of the trace.  identity_error: how far the covariance of
    whitened, measured over all rows, is from the identity.

    Left out are rows whose vector is null, holds null or non-finite entries or ones that don't fit in 62 bits after scaling; vectors of another length than the commonest
    count as holding nulls.  Components without variance (equal rows, constant or dependent dimensions) don't exist, so a single row or an empty table gives none.
    Repeated rows and null keys are rows like any other.  Equal eigenvalues leave the choice of axes to eigh, the same for all rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    names = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kind = dict(rows.dtypes)["key"]
    d = usual_length(rows)
    model = fit(rows, d, components, scale, offset) if d else None
    if model is None or not len(model.values):
        return rows.limit(0).select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in names.split(", "))])
    error = identity_error(rows, model)
    m = len(model.values)
    shares = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, places = rows_of(batch.column(1), d)
            x, fit_rows = integers(values, scale, offset)
            places = places[fit_rows]
            for start in range(0, len(x), max(1, BATCH // m)):
                part = slice(start, start + max(1, BATCH // m))
                apart = model.apart(x[part])
                z = model.whitened(apart)
                small = apart.dtype != object and d * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63
                squares = (apart * apart if small else apart.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
                k = len(z)
                each = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places[part])).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, model.n)),
                        deviation.take(each), pa.array(z.ravel()), pa.array(np.tile(shares, k)), pa.array(np.full(k * m, error)),
                    ],
                    ["key", *(x.split()[0] for x in names.split(", "))],
                )

    return rows.mapInArrow(project, f"key {kind}, {names}").withColumnRenamed("key", key)


def as_long(column: Column) -> Column:
    """A whole number as long; null where it doesn't fit."""
    return column.try_cast("long")
