"""Operator 10: mixing sources to target weights by Poisson replication.

A source's target rate is its weight's share of the wanted rows over the rows it
has.  Each row draws a uniform number from a hash of the seed, its id, its content and its running number among
equal rows, and inverts the Poisson distribution of that mean; it is exploded by the count and the
copies are dealt out by another hash.  DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A table of sources of at most this many rows is broadcast, so that no source gathers its rows in one task; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: exp(-rate) is a normal double up to here: greater rates are the sum of several draws of equal means.
MAX_RATE = 708.0
#: Equal rows are numbered so many at a time.
TWINS = 1_000


def uniform(*parts: Column) -> Column:
    """[0, 1) from the first 13 hex digits of md5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def poisson_levels(rate: Column) -> Column:
    """Cumulative probabilities at 0, 1, 2, ... up to 12 deviations and 30 past the mean."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("levels"))
    step = lambda s, k: F.struct(
        (s.p * rate / k).alias("p"), (s.c + s.p * rate / k).alias("c"), F.concat(s.levels, F.array(s.c + s.p * rate / k)).alias("levels")
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.levels)


def mixing_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, source: str = "source") -> DataFrame:
    """(source, n_rows, rate, draws, levels): levels of one of so many draws.  weights None: equal weights.  Sources without a weight get rate 0;
    weights of sources without rows are left out before the weights are normalised.  total None: as many rows as there are."""
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n_rows"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum("n_rows").alias("n_rows")).first()
    all_weight, wanted = sums["weight"] or 0.0, float((sums["n_rows"] or 0) if total is None else total)
    rate = F.col("weight") / F.lit(all_weight) * F.lit(wanted) / F.col("n_rows") if all_weight > 0 else F.lit(0.0)
    rated = weighed.select("source", "n_rows", rate.alias("rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int"))
    return rated.withColumn("draws", draws).withColumn("levels", poisson_levels(F.col("rate") / F.col("draws")))


def row_mark(fields: list[T.StructField]) -> Column:
    """md5 of all columns' values as text, a null one as the word ``null``."""
    as_text = lambda f: F.base64(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string")
    return F.md5(F.concat_ws("|", *[F.coalesce(as_text(f), F.lit("null")) for f in fields]))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (c0, c1, ...) with mark, a hash of the row, and twin, a number from 0 that tells equal rows apart."""
    hashed = [f.name for f in rows.schema.fields if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]
    marked = rows.withColumns({"mark": row_mark(rows.schema.fields), "same": F.xxhash64(*hashed)})
    at = ["mark", "same"]
    repeated = marked.groupBy(*at).count().filter("count > 1").select(*at)
    columns = [*rows.columns, "mark", "twin"]
    alone = lambda part: part.withColumn("twin", F.lit(0).cast("long")).select(*columns)
    if repeated.isEmpty():
        return alone(marked)
    groups = marked.join(repeated, at, "left_semi").groupBy(*at).agg(*[F.any_value(c).alias(c) for c in rows.columns], F.count("*").alias("n"))
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TWINS))))
    dealt = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mark", "block")
    first = F.col("block") * TWINS
    twins = dealt.withColumn("twin", F.explode(F.sequence(first, F.least(first + TWINS, F.col("n")) - 1)))
    return alone(marked.join(repeated, at, "left_anti")).union(twins.select(*columns))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 17, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs' own columns, once per copy, with ``copy_no`` from 0 (renamed copy_no_ while docs has that name), dealt out at random.

    A row with a null key or source takes part under the word ``null``.  Rows draw apart: by their key and
    content, and equal rows by their running number, so null or repeated keys are neither kept nor dropped together.
    An empty table gives an empty one.  Every source keeps its expected
    share at any size; no row is dropped but by a draw of 0.
    """
    name = "copy_no"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    own = [f"c{i}" for i in range(len(docs.columns))]
    key, of = (own[docs.columns.index(c)] for c in (key, source))
    rates = mixing_rates(docs, weights, total, source).select(F.col("source").alias("name"), "levels", "draws")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = numbered(docs.toDF(*own))
    identity = [F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("mark"), F.col("twin").cast("string")]
    reached = lambda u: F.size(F.filter("levels", lambda c: c <= u)).cast("long")
    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0).cast("long"), lambda n, i: n + reached(uniform(i.cast("string"), F.lit("draw"), *identity)))
    copies = reached(F.col("u")) + F.when(F.col("draws") > 1, more).otherwise(F.lit(0))
    drawn = rows.withColumn("u", uniform(*identity)).join(rates, F.col(of).cast("string").eqNullSafe(F.col("name"))).withColumn("copies", copies)
    out = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    place = F.xxhash64(F.lit(seed), F.col("mark"), F.col("twin"), F.col("copy"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select(*own, "copy", place.alias("place")).repartition(parts, "place").sortWithinPartitions("place").select(*own, "copy").toDF(*docs.columns, name)
