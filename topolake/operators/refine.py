"""Confidence scores from embeddings of evidence.

A score compares a vector with the centroids of two anchor classes.  Vectors come in a column, from a function that the caller
gives, or from ``hashed_embedding``, which needs no model; without any, findings pass unchanged.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from topolake.functions.strings import cosine
from topolake.lineage import cut
from topolake.operators import literals

log = logging.getLogger("topolake")

HIGH, MEDIUM = 0.68, 0.42
#: Dimensions of a hashed embedding, and the seed of its projection.
DIMENSIONS, SEED = 64, 17
#: A gram is common if more than this part of all texts holds it: at most as many grams as this many texts have.
COMMON = 1000


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): element-wise means."""
    items = vectors.select(group, F.posexplode(vector).alias("pos", "x"))
    means = items.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("centroid"))


def score(service: Column, noise: Column) -> Column:
    """Share of the service similarity, within 0 and 1."""
    total = service + noise
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), service / total))).when(service > noise, 0.75).otherwise(0.5)


def band(value: Column) -> Column:
    return F.when(value >= HIGH, "high").when(value >= MEDIUM, "medium").otherwise("low")


def evidence_text(protocol: Column, dependency: Column, code: Column) -> Column:
    return F.concat(F.lit("protocol:"), protocol, F.lit(" dependency:"), F.coalesce(dependency, F.lit("")), F.lit(" code:"), code)


def refine(connections: DataFrame, service: list[float], noise: list[float], vector: str = "embedding") -> DataFrame:
    """connections with ml_confidence, ml_reasoning and confidence anew; rows without evidence keep theirs."""
    near = lambda centre: cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in centre]))
    scored = connections.withColumns({"_s": near(service), "_n": near(noise)}).withColumn("_score", score(F.col("_s"), F.col("_n")))
    has = F.col("evidence").isNotNull()
    usable = has & F.col(vector).isNotNull()
    return scored.withColumns({
        "ml_confidence": F.when(usable, F.col("_score")).otherwise(0.5).cast("float"),
        "ml_reasoning": F.when(~has, "no_evidence").when(usable, F.format_string("service_sim:%.3f noise_sim:%.3f", "_s", "_n")).otherwise("no_embedding"),
        "confidence": F.when(usable, band(F.col("_score"))).otherwise(F.col("confidence")),
    }).drop("_s", "_n", "_score")


def refine_with(connections: DataFrame, embed: Callable[[DataFrame, str], DataFrame] | None, service: list[float], noise: list[float]) -> DataFrame:
    """embed(df, text column) adds an ``embedding`` column; None or a failure, then or in a task, leaves connections as they are.

    Vectors are computed and stored here, so that a failure shows while there is another way.
    """
    if embed is None:
        return connections
    texts = connections.withColumn("_text", evidence_text(F.col("protocol"), F.col("dependency"), F.col("evidence")))
    try:
        embedded = cut(embed(texts, "_text"))
    except Exception as error:  # whatever the caller's function raises
        log.warning("no refinement: %s", str(error).splitlines()[0] if str(error) else type(error).__name__)
        return connections
    return refine(embedded, service, noise).drop("_text", "embedding")


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words) + 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _entries(rows: DataFrame, text: str, dimensions: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (t, id) and the entries (id, at, x) of their embeddings; a text without words has none.

    Grams that many texts hold are few and broadcast; only the others go through a shuffle, with the number of a text in its place.
    """
    texts = cut(rows.select(F.col(text).alias("t")).filter("t is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    n = texts.count()
    words = texts.select("id", F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))  # A-Z in lower case
    each = lambda found: words.select("id", F.explode_outer(found).alias("gram")).filter("gram is not null")  # noqa: E731 (outer: else grams are made once more to see that there are some)
    held = each(F.array_distinct(grams(F.col("w")))).groupBy("gram").agg(F.count("*").alias("df"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), "gram"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    weight = F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1)))
    placed = cut(held.select("gram", "df", (number(1, 8) % dimensions).alias("at"), (weight * (1 - 2 * (number(9, 1) % 2))).alias("x")))
    often = F.col("df") > n // COMMON
    common = literals.small(placed.filter(often).drop("df"))
    said = each(grams(F.col("w")))
    near = said.join(common, "gram").select("id", "at", "x")
    far = said.join(common.select("gram"), "gram", "left_anti").join(literals.small(placed.filter(~often)), "gram").select("id", "at", "x")
    return texts, near.union(far).repartition("id").groupBy("id", "at").agg(F.sum("x").alias("x"))


def embedding_entries(rows: DataFrame, text: str, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(t, at, x): the entries of ``hashed_embedding`` that some gram falls into, once for each distinct text; an x may be 0."""
    texts, entries = _entries(rows, text, dimensions, seed)
    return texts.join(entries, "id").select("t", "at", "x")


def hashed_embedding(rows: DataFrame, text: str, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """rows with ``embedding``: words and pairs of a text, weighed by their rarity over all distinct texts, on a seeded random projection.

    A gram's digest gives its dimension and sign; its weight is floor(1000 * ln((2N + 2) / (2df + 1))), so entries are whole numbers and sums are exact.
    Equal texts are embedded once, and joined to the rows before entries become vectors.  A text without words has zeros, a null one null.
    """
    texts, entries = _entries(rows, text, dimensions, seed)
    sums = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("_m"))
    joined = rows.join(texts.join(sums, "id").select(F.col("t").alias("_t"), "_m"), F.col(text) == F.col("_t"), "left")
    entry = lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)).cast("double")
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long")), entry)
    return joined.withColumn("embedding", F.when(F.col(text).isNotNull(), vector)).drop("_t", "_m")


def refine_by_texts(connections: DataFrame, anchors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """connections refined by hashed embeddings: anchors (text, is_service) are known evidence texts, embedded with the others; without both classes connections stay as they are."""
    shown = connections.withColumn("_text", evidence_text(F.col("protocol"), F.col("dependency"), F.col("evidence")))
    both = shown.select(F.col("_text").alias("text"), F.lit(None).cast("boolean").alias("is_service")).union(anchors.select("text", "is_service")).distinct()
    vectors = cut(hashed_embedding(both, "text", dimensions))
    found = {r["is_service"]: r["centroid"] for r in centroids(vectors.filter("is_service is not null"), "is_service", "embedding").collect()}
    if len(found) < 2:
        return connections
    embedded = shown.join(vectors.filter("is_service is null and text is not null").select(F.col("text").alias("_t"), "embedding"), F.col("_text") == F.col("_t"), "left")
    return refine(embedded, found[True], found[False]).drop("_text", "_t", "embedding")
