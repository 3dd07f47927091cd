"""Operator 9: document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, long ones cut at sentence ends) become 64-bit digests.  A sketch
adds each digest to one cell of each of three tables: cells hold a count and XORs of digests and of
check hashes.  The tables are as wide as the text asks for and fold to any smaller power of two, so
sketches of two texts subtract at the width of the narrower one.  Subtracting leaves what differs; peeling
cells with one digest recovers it, first in folded tables, on failure in larger ones.
Where the largest stall, squared counts tell how much differs.  Likeness follows from the two
fingerprints alone.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cells in each of the three tables, at least.
LEAST = 16
#: Of the paragraphs of a text, and on top of that, so many cells in each table: room for as many differing digests as two thirds of them.
ROOM, MORE = 0.3, 4
#: Peeling isn't tried where about so many differing digests stand against one cell of a table; it can't end beyond 2.5.
HOPELESS = 3.6
ROUNDS = 32
PARAGRAPH = "[^\\n]{0,120}[^\\n.!?]*[.!?]*"
CELLS = "array<struct<i:int,n:int,k:bigint,c:bigint>>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def digests(text: Column) -> Column:
    """Distinct digests of non-empty paragraphs, in order."""
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: p != ""), lambda p: F.xxhash64(p))))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit((1 << 32) - 1))


def cell(i: Column, n: Column, k: Column, c: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), n.cast("int").alias("n"), k.alias("k"), c.alias("c"))


def spots(keys: Column, width: Column) -> Column:
    """Three cells for each of keys (n, k, c)."""
    place = lambda k, j: F.xxhash64(k, F.lit(j)).bitwiseAND((width - 1).cast("long")) + j * width
    return F.flatten(F.transform(keys, lambda x: F.array(*[cell(place(x.k, j), x.n, x.k, x.c) for j in range(3)])))


def summed(cells: Column) -> Column:
    """Cells in order, those of one place added up and empty ones left out."""
    add = lambda a, x: cell(x.i, a.n + x.n, a.k.bitwiseXOR(x.k), a.c.bitwiseXOR(x.c))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def grouped(all_: Column) -> Column:
        first = lambda x, j: F.when((j == 0) | (F.get(all_, j - 1).i != x.i), j)
        ends = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(all_))
        of = lambda starts: F.transform(starts, lambda s, j: F.aggregate(F.slice(all_, s + 1, ends(starts, j) - s), zero, add))
        return let(F.filter(F.transform(all_, first), lambda j: j.isNotNull()), of)

    return F.filter(let(F.sort_array(cells), grouped), lambda x: (x.n != 0) | (x.k != 0) | (x.c != 0)).cast(CELLS)


def sketch(keys: Column) -> Column:
    """(width, total, cells) of distinct digests."""
    wanted = F.greatest(F.lit(LEAST), F.ceil(F.size(keys) * F.lit(ROOM) + MORE))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(wanted.cast("double")))).cast("int")
    ones = F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("k"), check(k).alias("c")))
    return let(width, lambda w: F.struct(w.alias("width"), F.size(keys).alias("total"), summed(spots(ones, w)).alias("cells")))


def folded(cells: Column, old: Column, new: Column, sign: int = 1) -> Column:
    return F.transform(cells, lambda x: cell(F.floor(x.i / old) * new + x.i.bitwiseAND(new - 1), x.n * sign, x.k, x.c))


def peel(cells: Column, width: Column) -> Column:
    """The number of digests in the difference ``cells``, or null where peeling stalls."""
    pure = lambda cs: F.array_distinct(F.transform(F.filter(cs, lambda x: (F.abs(x.n) == 1) & (x.c == check(x.k))), lambda x: F.struct((-x.n).alias("n"), x.k.alias("k"), x.c.alias("c"))))
    state = lambda cs, found, over: F.struct(cs.cast(CELLS).alias("cells"), found.alias("found"), over.alias("over"))
    taken = lambda s, found: F.when(F.size(found) == 0, state(s.cells, s.found, F.lit(True))).otherwise(
        let(summed(F.concat(s.cells, spots(found, width))), lambda left: state(left, s.found + F.size(found), F.size(left) == 0))
    )
    step = lambda s, _: F.when(s["over"], s).otherwise(let(pure(s.cells), lambda found: taken(s, found)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, F.lit(0), F.size(cells) == 0), step, lambda s: F.when(F.size(s.cells) == 0, s.found))


def estimate(cells: Column, width: Column, more: Column) -> Column:
    """About how many digests differ, from the squared counts: the mean of a table's sum is their number and what its ``more`` digests on one side add."""
    squares = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x.n * x.n)
    return (squares / 3 - more * more / width) / (1 - 1 / width)


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of digests that only one of two sketches holds; two without any are alike."""
    total, more = a.total + b.total, (a.total - b.total).cast("double")

    def compared(x: Column) -> Column:
        widths = F.array_distinct(F.array(F.lit(LEAST), x.width))
        at = lambda w: F.when(w == x.width, x.cells).otherwise(summed(folded(x.cells, x.width, w)))
        tried = lambda guess: F.aggregate(widths, F.lit(None).cast("int"), lambda found, w: F.coalesce(found, F.when(guess <= HOPELESS * w, peel(at(w), w))))
        about = F.least(F.greatest(estimate(x.cells, x.width, more), F.abs(more)), total.cast("double"))
        return let(about, lambda guess: F.coalesce(tried(guess), guess))

    joint = let(F.least(a.width, b.width), lambda w: F.struct(w.alias("width"), summed(F.concat(folded(a.cells, a.width, w), folded(b.cells, b.width, w, -1))).alias("cells")))
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - let(joint, compared) / total)


def written(sketch: Column) -> Column:
    """The width, then place.count.digest.check of each cell that isn't empty, in hexadecimal but for the counts."""
    hexed = lambda x: F.lower(F.hex(x))
    return F.concat(hexed(sketch.width), F.lit("|"), F.array_join(F.transform(sketch.cells, lambda x: F.concat_ws(".", hexed(x.i), x.n.cast("string"), hexed(x.k), hexed(x.c))), ";"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text, sketch, next_sketch): each text with that of the next key, the last one's with the first's.

    Keys are dealt into ranges between quantiles that are keys themselves, so the first row of a
    range is known beforehand and also goes, as a guest, to the end of the range before.  One
    shuffle of the texts; no range is all of the table.  Equal keys are ordered by text.
    A row with a null key has no place: its next text is empty.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / min(10_000, 4 * partitions) for i in range(1, min(10_000, 4 * partitions))] or [0.5]
    found = rows.agg(F.min("key").alias("least"), F.percentile_approx("key", shares, 10_000).alias("bounds")).first()
    bounds = sorted({found["least"], *(found["bounds"] or [])}) if found["least"] is not None else [0]
    span = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + span] for i in range(0, len(bounds), span)]
    literal = lambda xs: F.lit(xs).cast("array<bigint>")
    outer = F.size(F.filter(literal([g[0] for g in groups]), lambda b: b <= F.col("key"))) - 1
    group = F.get(F.array(*[literal(g) for g in groups]), F.col("outer"))
    inner = F.size(F.filter(group, lambda b: b <= F.col("key"))) - 1
    bucket = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(bounds)))).otherwise(F.col("outer") * span + F.col("inner")).cast("int")
    spot = lambda b, turn, guest: F.struct(b.cast("int").alias("bucket"), F.lit(turn).alias("turn"), F.lit(guest).alias("guest"))
    first = (F.col("key") == F.get(group, F.col("inner"))) & (F.col("bucket") > 0)
    spots = F.array(spot(F.col("bucket"), 0, False), F.when(first, spot(F.col("bucket") - 1, 1, True)), F.when(F.col("key") == bounds[0], spot(F.lit(len(bounds) - 1), 2, True)))
    dealt = rows.withColumn("outer", outer).withColumn("inner", inner).withColumn("bucket", bucket).select("key", "text", F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("spot")).select("key", "text", "spot.*")
    order = Window.partitionBy("bucket").orderBy(F.col("key").isNull(), "turn", "key", "text")
    held = dealt.repartition(partitions, "bucket").withColumn("sketch", let(digests(F.col("text")), sketch))
    led = held.select("key", "text", "sketch", "guest", F.lead("text").over(order).alias("after"), F.lead("sketch").over(order).alias("after_sketch"))
    placed = F.col("key").isNotNull()
    none = F.struct(F.lit(LEAST).alias("width"), F.lit(0).alias("total"), F.array().cast(CELLS).alias("cells"))
    return led.filter(~F.col("guest")).select("key", "text", "sketch", F.when(placed, F.col("after")).otherwise("").alias("next_text"), F.when(placed, F.col("after_sketch")).otherwise(none).alias("next_sketch"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points replaced by the beginning of the next document.
    A null text counts as empty; repeated rows each get a row; an empty table gives none; for one document alone the next is itself.
    """
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = with_next(docs, key, text).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("key", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", let(digests(F.col("edited")), sketch).alias("edited_sketch"))
    others = F.array(F.struct(F.col("sketch").alias("a"), F.col("edited_sketch").alias("b")), F.struct(F.col("sketch").alias("a"), F.col("next_sketch").alias("b")))
    rows = rows.withColumn("near", F.transform(others, lambda p: likeness(p.a, p.b)))
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("near")[0].alias("near_edited"),
        F.col("near")[1].alias("near_next"),
    )
