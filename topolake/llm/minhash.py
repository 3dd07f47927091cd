"""Operator 6: near-duplicate documents by HyperMinHash.

A document's shingle hashes fall into 256 buckets; each bucket keeps the leading-zero count and
ten mantissa bits of its least hash, empty ones borrow from another (optimal densification).  Bands of
these registers find candidates, whose collision-corrected Jaccard estimate sorts out
most; the rest is confirmed on the full sets.

Equal sets are one node from the start.  First every node is compared with the bucket leader that it
shares most bands with, twice more with one of the commonest component.  Then, in buckets where several components are left, nodes
of different components are compared, each pair in the first band that it shares.
No pair within a settled group is looked at, and no group meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from topolake.llm.components import Forest, best_leaders, by_unit, connected, mixed_units, other_leaders, shared_buckets, star_units, units_of
from topolake.llm.store import Workspace

REGISTERS, MANTISSA, BANDS = 256, 10, 32
#: Chance of missing a pair at the threshold in all bands, at most.
MISS = 1e-5
#: Standard errors below the threshold at which an estimate rules a pair out.
DOUBT = 5.0
#: Rounds in which nodes meet a leader of the commonest component in their buckets, before all pairs of components do.
MORE_LEADERS = 2
#: Bytes hashed at once, shingles in one side of a comparison unit, and what a document weighs there beyond its shingles.
CHUNK, UNIT, ROW = 1 << 20, 50_000, 200
_random = np.random.default_rng(20_240_607)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE, PLACE = np.uint64(0x9E3779B97F4A7C15), _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
PROBES = _random.integers(0, REGISTERS, (128, REGISTERS))


def rows_per_band(percent: int) -> int:
    """As many registers a band as MISS allows."""
    return max(r for r in range(1, 9) if (1 - (percent / 100) ** r) ** BANDS <= MISS)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word, A-Z as a-z."""
    data = np.frombuffer(text, np.uint8)
    blank = BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(starts, append=len(data))
    powers = np.full(int(lengths.max()), BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    data, blank = data[starts[0] :], blank[starts[0] :]
    place = np.arange(len(data)) - np.repeat(starts - starts[0], lengths)
    values = BYTE[data] * powers[place]
    values[blank] = 0
    return mixed(np.add.reduceat(values, starts - starts[0])), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a very long text, cut at blanks."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def document_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text) + 1
        if size >= CHUNK or i == len(texts) - 1:
            if len(group) == 1:
                yield np.concatenate([word_hashes(p)[0] for p in _pieces(text)])
            else:
                hashes, starts = word_hashes(b" ".join(group))
                ends = np.cumsum([len(t) + 1 for t in group])
                yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))
            group, size = [], 0


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter sequence is one shingle, no words none."""
    if not len(words):
        return words
    if len(words) < width:
        return mixed((words * PLACE[: len(words)]).sum(keepdims=True, dtype=np.uint64) + PLACE[-len(words)])
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total += words[j : len(words) - width + 1 + j] * PLACE[j]
    return np.unique(mixed(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers (leading zeros, mantissa) of non-empty sets."""
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        has = at < np.append(at[1:], len(s))
        least[i, has] = s[at[has]]
        full[i] = has
    value = (least & np.uint64((1 << 56) - 1)) >> np.uint64(3)
    zeros = (53 - np.frexp(value.astype(np.float64))[1]).astype(np.uint64)
    code = (zeros << np.uint64(MANTISSA) | (value << zeros) >> np.uint64(52 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    empty = ~full
    for probe in PROBES:
        if not empty.any():
            return code
        usable = empty & full[:, probe]
        code = np.where(usable, code[:, probe], code)
        empty &= ~usable
    for i in np.flatnonzero(empty.any(1)):  # the next full one, cyclically
        places = np.flatnonzero(full[i])
        holes = np.flatnonzero(empty[i])
        code[i, holes] = code[i, places[np.searchsorted(places, holes) % len(places)]]
    return code


def _hashed(batches, width: int):
    """(keys, marks, sets) of each batch."""
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        yield batch.column(0).to_pylist(), batch.column(2).to_pylist(), [shingle_set(w, width) for w in document_words(texts)]


def _identity(s: np.ndarray, bits: int) -> tuple[int, int] | tuple[None, None]:
    """The first bits of a 128-bit digest, and its second half."""
    if not len(s):
        return None, None
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    return (digest >> 128 - bits) - (1 << bits - 1), (digest & (1 << 64) - 1) - (1 << 63)


def sketch(docs: DataFrame, width: int, used: int, with_sets: bool = False, bits: int = 64) -> DataFrame:
    """(key, n, node, rest, regs, mark[, shingles]) of each document (key, text, mark).  node and rest: a digest of the set, null for an empty one."""

    def run(batches):
        for keys, marks, sets in _hashed(batches, width):
            for at in range(0, len(sets), 512):
                part = sets[at : at + 512]
                some = [i for i, s in enumerate(part) if len(s)]
                regs: list[bytes | None] = [None] * len(part)
                if some:
                    for i, row in zip(some, registers([part[i] for i in some])[:, :used], strict=True):
                        regs[i] = row.tobytes()
                nodes, rests = zip(*(_identity(s, bits) for s in part), strict=True)
                columns = [pa.array(keys[at : at + 512], pa.int64()), pa.array([len(s) for s in part], pa.int64()), pa.array(nodes, pa.int64()), pa.array(rests, pa.int64()), pa.array(regs, pa.binary()), pa.array(marks[at : at + 512], pa.int64())]
                if with_sets:
                    columns.append(pa.array([s.tobytes() for s in part], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "node", "rest", "regs", "mark", "shingles"][: len(columns)])

    schema = "key long, n long, node long, rest long, regs binary, mark long" + ", shingles binary" * with_sets
    return docs.mapInArrow(run, schema)


def apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows (node, rest, ...) with new nodes for unlike sets that share one of clashes."""
    own = F.when(F.col("clash"), F.xxhash64("node", "rest")).otherwise(F.col("node"))
    return rows.join(clashes.withColumn("clash", F.lit(True)), "node", "left").withColumn("node", own).select(*rows.columns)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of a and rows of b from equal registers, less the chance collisions (HyperMinHash, eq. for equal orders)."""
    same = np.stack([(row == b).mean(1) for row in a])
    ratio = n_a[:, None] / n_b[None, :]
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_links(units: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for (leader, _, _), rows in units_of(batches, ["side", "node", "shingles"]):
            own = {node: np.frombuffer(s, np.uint64) for _, node, s in rows}
            found = [node for side, node, _ in rows if side and _linked(own[leader], own[node], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([leader] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    return by_unit(units).mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple], bucket: int, per_band: int, percent: int) -> list[tuple[int, int]]:
    """Indexes of left and right rows to confirm: other labels, first shared band here, estimate not too low."""
    left, right = [i for i, r in enumerate(rows) if r[0] == 0], [i for i, r in enumerate(rows) if r[0] == 1]
    if not left or not right:  # heavy rows make more blocks, and chance may leave one empty
        return []
    regs = np.stack([np.frombuffer(r[4], np.uint16) for r in rows])
    n, node, label = (np.array([r[k] for r in rows]) for k in (5, 1, 2))
    common = np.array([r[3] for r in rows])
    a, b = np.array(left), np.array(right)
    ok = (label[a][:, None] != label[b][None, :]) & (common[b][None, :] | (node[a][:, None] < node[b][None, :]))
    ok &= 100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :])
    if not ok.any():
        return []
    t = percent / 100
    ok &= estimate(regs[a], regs[b], n[a], n[b]) >= t - DOUBT * math.sqrt(t * (1 - t) / regs.shape[1])
    bands = regs.reshape(len(rows), -1, per_band)
    band = bucket & (BANDS - 1)
    out = []
    for i, j in np.argwhere(ok):
        same = (bands[a[i]] == bands[b[j]]).all(1)
        if same[band] and not same[:band].any():
            out.append((int(a[i]), int(b[j])))
    return out


FIELDS = ["side", "node", "label", "common", "regs", "n"]
UNIT_ROW = "u1 long, u2 int, u3 int, side int, node long, label long, common boolean"


def possible(units: DataFrame, per_band: int, percent: int) -> DataFrame:
    """The rows of units that some pair to be confirmed needs."""

    def run(batches):
        for key, rows in units_of(batches, FIELDS):
            need = sorted({i for p in _pairs(rows, key[0], per_band, percent) for i in p})
            kept = [(*key, *rows[i][:4]) for i in need]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], [f.split()[0] for f in UNIT_ROW.split(", ")])

    return by_unit(units).mapInArrow(run, UNIT_ROW)


def mixed_links(units: DataFrame, per_band: int, percent: int) -> DataFrame:
    """Confirmed links between components, a spanning forest of each unit."""

    def run(batches):
        for key, rows in units_of(batches, [*FIELDS, "shingles"]):
            forest, first = Forest(len(rows)), {}
            for i, r in enumerate(rows):
                forest.join(i, first.setdefault(r[2], i))
            sets = [np.frombuffer(r[6], np.uint64) for r in rows]
            found = [(rows[i][1], rows[j][1]) for i, j in _pairs(rows, key[0], per_band, percent) if forest.find(i) != forest.find(j) and _linked(sets[i], sets[j], percent) and forest.join(i, j)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return by_unit(units).mapInArrow(run, "a long, b long")


def text_mark(text: Column) -> Column:
    """Tells rows that repeat a key apart by their texts."""
    return F.xxhash64(text.isNull(), text)


def judged(docs: DataFrame, width: int, percent: int, key: str, text: str, ws: Workspace, bits: int = 64) -> DataFrame:
    """(key, mark, n, node, least, least_mark) of every row: the smallest key reachable, and of the rows with it and their texts the smallest mark.

    Sets are told apart by 128-bit digests: joins use a node of so many bits, and nodes that unlike sets share are given anew.
    """
    per_band = rows_per_band(percent)
    used = per_band * BANDS
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("mark", text_mark(F.col("text")))
    sketches = ws.keep(sketch(rows, width, used, bits=bits), "sketches")

    def classed() -> DataFrame:
        placed = sketches.filter("node is not null and key is not null").groupBy("node")
        return ws.keep(placed.agg(F.min(F.struct("key", "mark", "n", "regs")).alias("c"), (F.min("rest") != F.max("rest")).alias("clash")).select("node", "c.*", "clash"), "classes")

    classes = classed()
    clashes = classes.filter("clash").select("node")
    clashed = not clashes.isEmpty()
    if clashed:
        sketches = ws.keep(apart(sketches, clashes), "sketches")
        classes = classed()

    slices = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("regs"), b * (2 * per_band) + 1, F.lit(2 * per_band))).bitwiseAND(F.lit(~(BANDS - 1))).bitwiseOR(b))
    keyed = classes.select("node", F.explode(slices).alias("bucket"))  # the band is in the lowest bits
    members = ws.keep(shared_buckets(keyed), "members")

    wanted = ws.keep(members.select("node").distinct().join(classes.select("node", "key"), "node").select("key").distinct(), "wanted")
    sets = sketch(rows.join(wanted, "key", "left_semi"), width, used, True, bits)
    sets = ws.keep((apart(sets, clashes) if clashed else sets).select("node", "n", "regs", "shingles").dropDuplicates(["node"]), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        stars = star_units(pairs, sets.select("node", (F.col("n") + ROW).alias("weight")), UNIT)
        return ws.keep(star_links(stars.join(sets.select("node", "shingles"), "node"), percent), "links")

    def joined(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        labels = ws.keep(connected(links, ws), "labels")
        return labels, members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))

    links = compared(best_leaders(members))
    labels, labelled = joined(links)
    for _ in range(MORE_LEADERS):
        found = compared(other_leaders(labelled))
        if found.isEmpty():  # components stay as they are
            break
        links = ws.keep(links.union(found), "links")
        labels, labelled = joined(links)
    units = mixed_units(labelled, sets.select("node", ((F.col("n") + ROW) / F.lit(float(UNIT))).alias("weight"))).join(sets.select("node", "n", "regs"), "node")
    need = ws.keep(possible(units, per_band, percent), "possible")
    more = ws.keep(mixed_links(need.join(sets, "node"), per_band, percent), "links")
    final = labels if more.isEmpty() else ws.keep(connected(links.union(more), ws), "labels")
    ws.drop(sets, members, need)

    component = classes.select("node", "key", "mark").join(final, "node", "left").select("node", "key", "mark", F.coalesce("label", "node").alias("label"))
    least = component.groupBy("label").agg(F.min(F.struct("key", "mark")).alias("least"))
    of_node = ws.keep(component.join(least, "label").select("node", F.col("least.key").alias("least"), F.col("least.mark").alias("least_mark")), "components")
    ws.drop(links, more, wanted, *{t.kept_path: t for t in (labels, final)}.values())
    return sketches.select("key", "mark", "n", F.when(F.col("key").isNotNull(), F.col("node")).alias("node")).join(of_node, "node", "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents are linked when percent % or more of their united shingles are shared.
    component_id is the smallest key reachable, kept says whether it is the row's own.  Rows without
    words are linked with nothing.  Rows with a null key are linked with nothing either, have a null
    component and are kept.  Rows that repeat a key and have other texts are compared
    each by its own text.  An empty table gives an empty one.
    """
    out = judged(docs, width, percent, key, text, Workspace(docs.sparkSession, "minhash"))
    found = F.coalesce("least", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("key").eqNullSafe(found).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: of those with the smallest key one text, and of rows that repeat key and text one.

    A row goes by its own text, whatever becomes of others with its key.  Rows with a null key all stay.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    first = F.col("node").isNull() | ((F.col("key") == F.col("least")) & (F.col("mark") == F.col("least_mark")))
    rows = ws.keep(judged(docs, width, percent, key, text, ws).filter("key is not null").select("key", "mark", first.alias("first")), "rows")
    gone = rows.filter("not first").drop("first")
    repeated = ws.keep(rows.filter("first").groupBy("key", "mark").count().filter("count > 1").drop("count"), "repeated")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # the row's own columns are out of the way of key and mark
    marked = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_mark(F.col(f"`{text}`").cast("string")).alias("mark"), whole.alias("row"))
    at = ["key", "mark"]
    if repeated.isEmpty():
        return marked.join(gone, at, "left_anti").select("row.*")
    one = marked.join(repeated, at, "left_semi").groupBy(*at).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return marked.join(gone.union(repeated), at, "left_anti").select("row.*").union(one.select("row.*"))
