"""Operator 8: near-duplicate embeddings by iterative quantisation.

Rotations learned on a bounded sample (Gong & Lazebnik, 2011) turn vectors into balanced binary codes; several
of them side by side give as many bits as wanted, whatever the dimension.  The code is cut into disjoint
substrings, each the key of one Hamming table (Norouzi et al., 2012).  A vector stands in a
table under its own key and under the keys that differ in one of its least certain bits.  There are as many tables as let
vectors just at the threshold meet but for MISS of them, as measured on held-out vectors with
partners at exactly that angle, so recall falls neither with the rows nor with the dimension.

Those that share a key are first compared by 128 bits of code, then by cosine in double precision.
Vectors close to one leader are linked with each other by the triangle inequality of
angles, so such a core is counted without looking at its pairs; only pairs of different cores are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from topolake.llm.components import Forest, best_leaders, by_unit, connected, mixed_units, shared_buckets, star_units, units_of
from topolake.llm.store import Workspace

#: Vectors that rotations are fitted on, at most, and bytes of them; every vector is indexed.
SAMPLE, SAMPLE_BYTES = 16_000, 1 << 27
#: Pairs at the threshold that tables are counted on; their vectors are of no rotation's sample.
PROBES = 3_000
#: Of pairs at the threshold so many may meet in no table, and so many more may be ruled out by their codes.
MISS, RULED_OUT = 0.004, 0.001
#: Bits of one rotation, of the code that candidates are compared by, and of the whole code at most.
TURN_BITS, CHECK_BITS, MOST_BITS = 64, 128, 2048
#: Bits of a vector that are turned one at a time in each table.
NEAR = 2
#: Widths of keys to choose from, and the cost of a row in a table in comparisons.
WIDTHS, ROW_COST = range(0, 41, 3), 6
#: Bits of a bucket's name that hold its table.
TABLE_BITS = 12
#: Leaders meet so many vectors at a time.
UNIT = 250


def unit_rows(vectors: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Vectors of one length, each of norm 1."""
    x = np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(flat: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """A turn of centred vectors after which their signs lose least."""
    turn = np.linalg.qr(rng.normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    return turn


def projections(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and MOST_BITS columns to project on: rotations of the principal directions, each from a random start and learned on its own part of the sample."""
    rng = np.random.default_rng(3)
    mean = sample.mean(0)
    centred = sample - mean
    directions = np.linalg.svd(centred.T @ centred)[0][:, :TURN_BITS]
    flat = centred @ directions
    turns = []
    for i in range(-(-MOST_BITS // flat.shape[1])):
        part = flat if len(flat) <= 2000 else flat[rng.integers(0, len(flat), 2000)]
        turns.append(directions @ rotation(part, rng, 20 if i == 0 else 4))
    return mean, np.concatenate(turns, 1)[:, :MOST_BITS]


def partners(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at exactly the threshold from those of x."""
    side = np.random.default_rng(7).normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * side


@dataclass
class Index:
    """Codes and tables of vectors of one length."""

    size: int
    mean: np.ndarray
    projection: np.ndarray
    width: int
    tables: int
    radius: int

    def margins(self, x: np.ndarray, bits: int) -> np.ndarray:
        return (x - self.mean) @ self.projection[:, :bits]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """CHECK_BITS of code as bytes, [vectors, bytes]."""
        return np.packbits(self.margins(x, CHECK_BITS) > 0, axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Names of the buckets of each vector, [vectors, tables, 1 + NEAR]."""
        return self.names(table_keys(self.margins(x, self.tables * self.width).reshape(len(x), self.tables, self.width)))

    def names(self, keys: np.ndarray) -> np.ndarray:
        salt = np.uint64(self.size * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        mixed = (keys ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed >> np.uint64(TABLE_BITS) << np.uint64(TABLE_BITS) | np.arange(keys.shape[1], dtype=np.uint64)[None, :, None]


def table_keys(margins: np.ndarray) -> np.ndarray:
    """[vectors, tables, 1 + NEAR] keys from [vectors, tables, width] margins: the own one and those with an uncertain bit turned."""
    width = margins.shape[2]
    powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
    own = ((margins > 0) * powers).sum(2, dtype=np.uint64)
    near = min(NEAR, width)
    if not near:
        return own[:, :, None]
    least = np.argpartition(np.abs(margins), near - 1, axis=2)[:, :, :near].astype(np.uint64)
    return np.concatenate([own[:, :, None], own[:, :, None] ^ (np.uint64(1) << least)], 2)


def tables_needed(a: np.ndarray, b: np.ndarray, width: int) -> int | None:
    """Tables of ``width`` bits in which all but MISS of the pairs with these margins meet; null if the code is too short."""
    met = np.zeros(len(a), bool)
    for n in range(a.shape[1] // max(1, width)):
        left, right = (table_keys(m[:, None, n * width : (n + 1) * width])[:, 0] for m in (a, b))
        met |= (left[:, :, None] == right[:, None, :]).any((1, 2))
        if (~met).mean() <= MISS:
            return n + 1
    return None


def fitted(sample: np.ndarray, total: int, cosine: float) -> Index:
    """The index of ``total`` vectors of one length from a sample of unit vectors.

    Wide keys need more tables, narrow ones more comparisons; the cheapest width is taken.
    """
    held = min(PROBES, len(sample) // 4)
    learned, probes = sample[: len(sample) - held], sample[len(sample) - max(1, held) :]
    mean, projection = projections(learned)
    probes = np.tile(probes, (-(-PROBES // len(probes)), 1))[:PROBES]
    index = Index(sample.shape[1], mean, projection, 0, 1, CHECK_BITS)
    a, b = (index.margins(x, MOST_BITS).astype(np.float32) for x in (probes, partners(probes, cosine)))
    flips = np.sort(((a > 0) != (b > 0))[:, :CHECK_BITS].sum(1))
    index.radius = int(flips[math.ceil((1 - RULED_OUT) * len(flips)) - 1]) + 1
    own = index.margins(learned, max(WIDTHS)) > 0
    best = math.inf
    for width in WIDTHS:
        tables = tables_needed(a, b, width)
        if tables is None or tables >= 1 << TABLE_BITS:
            break
        sizes = np.unique(own[:, :width] @ (np.uint64(1) << np.arange(width, dtype=np.uint64)) if width else np.zeros(len(own)), return_counts=True)[1].astype(float)
        together = max((sizes * (sizes - 1)).sum() / max(1, len(own) * (len(own) - 1)), 0.5**width)
        cost = tables * (1 + NEAR) * (ROW_COST + (1 + NEAR) * total * together)
        if cost < best:
            best, index.width, index.tables = cost, width, tables
        elif cost > 2 * best:
            break
    index.projection = projection[:, : max(CHECK_BITS, index.tables * index.width)]
    return index


def coded(classes: DataFrame, indexes: dict[int, Index], kind: str) -> DataFrame:
    """classes (node, vec, weight, first) with code and buckets, each by the index of its length."""
    wide = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            sizes = np.array([len(v) // wide for v in vectors], np.int64)
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                for at in np.array_split(places, -(-len(places) // 1000)):
                    x = unit_rows([vectors[i] for i in at], kind)
                    index, own = indexes[int(size)], batch.take(pa.array(at))
                    codes, keys = index.codes(x), np.sort(index.keys(x).reshape(len(x), -1).view(np.int64), 1)
                    distinct = [np.unique(k) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(distinct, pa.list_(pa.int64())), pa.array([k.tobytes() for k in distinct], pa.binary()), pa.array(np.full(len(at), size, np.int32))],
                        [*batch.schema.names, "code", "buckets", "keys", "size"],
                    )

    return classes.mapInArrow(run, "node long, vec binary, weight long, first long, code binary, buckets array<long>, keys binary, size int")


def cores(units: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(node, leader) of vectors so close to their leader that any two of them are linked."""
    near = math.sqrt((1 + cosine) / 2) + 1e-9

    def run(batches):
        for (leader, _, _), rows in units_of(batches, ["side", "node", "vec"]):
            size = next(len(r[2]) for r in rows if r[0] == 0)
            rows = [r for r in rows if len(r[2]) == size]
            x = unit_rows([v for _, _, v in rows], kind)
            centre = x[next(i for i, r in enumerate(rows) if r[0] == 0)]
            found = [r[1] for r, c in zip(rows, x @ centre, strict=True) if r[0] and c >= near]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([leader] * len(found), pa.int64())], ["node", "leader"])

    return by_unit(units).mapInArrow(run, "node long, leader long")


UNIT_ROW = "u1 long, u2 int, u3 int, side int, node long, label long, common boolean"
UNIT_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())


def possible(units: DataFrame, radii: dict[int, int]) -> DataFrame:
    """The rows of units that have another label's row within the radius of their codes."""

    def run(batches):
        for key, rows in units_of(batches, ["side", "node", "label", "common", "code", "size"]):
            need: set[int] = set()
            for size in {r[5] for r in rows}:
                left, right = ([i for i, r in enumerate(rows) if r[0] == side and r[5] == size] for side in (0, 1))
                if left and right:
                    a, b = (np.stack([np.frombuffer(rows[i][4], np.uint64) for i in part]) for part in (left, right))
                    label_a, label_b = (np.array([rows[i][2] for i in part], np.int64) for part in (left, right))
                    near = label_a[:, None] != label_b[None, :]
                    near &= sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(a.shape[1])) <= radii[size]
                    need.update(left[i] for i in np.flatnonzero(near.any(1)))
                    need.update(right[j] for j in np.flatnonzero(near.any(0)))
            kept = [(*key, *rows[i][:4]) for i in sorted(need)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), UNIT_TYPES, strict=True)], [f.split()[0] for f in UNIT_ROW.split(", ")])

    return by_unit(units).mapInArrow(run, UNIT_ROW)


def of_one_length(units):
    """Units by the length of their vectors (keys of two lengths meet only by chance)."""
    for key, rows in units:
        for size in sorted({len(r[5]) for r in rows}):
            yield key, [r for r in rows if len(r[5]) == size]


FIELDS = ["side", "node", "label", "common", "weight", "vec", "keys"]


def _first_shared(a: np.ndarray, b: np.ndarray) -> int:
    """The least bucket of two sorted lists."""
    return np.intersect1d(a, b, assume_unique=True)[0]


def linked(units: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(a, b, n): links found in a unit; n of them at a, counting repeated vectors, and b one of those, or null.

    A pair counts in the least bucket that it shares; of two that aren't of the common core each
    is once on side 0.  Rows with n = 0 complete a spanning forest of the unit.
    """

    def run(batches):
        for (bucket, _, _), rows in of_one_length(units_of(batches, FIELDS)):
            left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
            if not left or not right:
                continue
            get = lambda part, k, kind: np.array([r[k] for r in part], kind)
            a, b = (unit_rows([r[5] for r in part], kind) for part in (left, right))
            keys_a, keys_b = ([np.frombuffer(r[6], np.int64) for r in part] for part in (left, right))
            ok = (a @ b.T >= cosine) & (get(left, 2, np.int64)[:, None] != get(right, 2, np.int64)[None, :])
            for i, j in np.argwhere(ok):
                ok[i, j] = _first_shared(keys_a[i], keys_b[j]) == bucket
            common = get(right, 3, bool)
            at_left = ok @ get(right, 4, np.int64)
            at_right = get(left, 4, np.int64) @ ok
            out = [(left[i][1], None, int(at_left[i])) for i in np.flatnonzero(at_left)]
            out += [(right[j][1], None, int(at_right[j])) for j in np.flatnonzero(common & (at_right > 0))]
            names = sorted({r[1] for r in rows})
            place = {name: i for i, name in enumerate(names)}
            forest, first = Forest(len(names)), {}
            for r in rows:
                forest.join(place[r[1]], first.setdefault(r[2], place[r[1]]))
            out += [(left[i][1], right[j][1], 0) for i, j in np.argwhere(ok) if forest.join(place[left[i][1]], place[right[j][1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    return by_unit(units).mapInArrow(run, "a long, b long, n long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    n_links counts the other rows linked directly, copies included; component_id is the smallest key
    reachable; kept says whether it is the row's own.  A vector that is null, empty or zero, or holds
    a null or a non-finite component, is linked with nothing; others only with those of
    their length, which have an index of their own.  A null key
    takes part and is nobody's smallest.  An empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    ws = Workspace(spark, "vectors")
    kind = "<f4" if isinstance(embeddings.schema[vector].dataType, T.ArrayType) and isinstance(embeddings.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    numbers = F.transform(F.col(vector), lambda x: x.cast("float" if kind == "<f4" else "double"))
    usable = F.coalesce((F.size(numbers) > 0) & F.forall(numbers, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(numbers, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col(key).cast("long").alias("key"), F.when(usable, numbers).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    sizes = {r["size"]: r["count"] for r in rows.filter("v is not null").groupBy(F.size("v").alias("size")).count().filter("count > 1").collect()}

    alone = rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone

    def packed(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array([np.array(v, kind).tobytes() for v in vectors], pa.binary())], ["key", "node", "vec"])

    as_bytes = lambda part: part.mapInArrow(packed, "key long, node long, vec binary")
    indexes = {}
    for size, total in sorted(sizes.items()):
        most = max(1_000, min(SAMPLE + PROBES, SAMPLE_BYTES // (8 * size)))
        sample = as_bytes(rows.filter(F.col("v").isNotNull() & (F.size("v") == size)).orderBy(F.xxhash64("key", "node")).limit(most)).select("vec").collect()
        indexes[size] = fitted(unit_rows([r["vec"] for r in sample], kind), total, cosine)

    vectors = as_bytes(rows.filter(F.col("v").isNotNull() & F.size("v").isin(*sizes)))
    grouped = vectors.groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("key").alias("first"))
    classes = ws.keep(coded(grouped.select("node", "vec", "weight", "first"), indexes, kind), "classes")
    members = ws.keep(shared_buckets(classes.select("node", F.explode("buckets").alias("bucket"))), "members")

    stars = star_units(best_leaders(members), classes.select("node", F.lit(1).alias("weight")), UNIT)
    core = ws.keep(cores(stars.join(classes.select("node", "vec"), "node"), cosine, kind), "cores")
    labelled = members.join(core.withColumnRenamed("leader", "core"), "node", "left").select("bucket", "node", F.coalesce("core", F.xxhash64("node")).alias("label"))
    units = mixed_units(labelled).join(classes.select("node", "code", "size"), "node")
    need = ws.keep(possible(units, {size: index.radius for size, index in indexes.items()}), "possible")
    found = ws.keep(linked(need.join(classes.select("node", "weight", "vec", "keys"), "node"), cosine, kind), "links")
    ws.drop(members, need)

    links = found.filter("b is not null").select("a", "b").union(core.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    labels = connected(links, ws)
    weights = classes.select("node", "weight", "first")
    in_core = core.join(weights, "node").groupBy("leader").agg(F.sum("weight").alias("core_weight"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = weights.join(core, "node", "left").join(in_core, "leader", "left").join(counts, "node", "left").join(labels, "node", "left")
    own = own.select("node", "first", (F.coalesce("core_weight", "weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("first").alias("least"))
    of_node = ws.keep(own.join(least, "label").select("node", "n_links", "least"), "components")
    out = rows.select("key", "node").join(of_node, "node", "left")
    component = F.coalesce("least", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
