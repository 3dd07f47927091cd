"""Connected components and comparison units, shared by the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topolake.llm.store import Workspace

#: Members of one side of a comparison unit, about.
BLOCK = 512


def connected(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, label) of every node in links (a, b): the least node it is joined with.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two
    aggregations by node and writes the edges anew, until each component is a star around its least node.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    edges = ws.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not _stars(edges):
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("least"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.least("u", "least").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest)
        after = ws.keep(small.distinct(), "edges")
        ws.drop(edges)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a, b), a > b, has one edge upwards and none downwards, or only such as lead to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up = 1 and down > 0")
    return odd.agg(F.count("*")).first()[0] == 0


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Of (bucket, node), those in buckets of two or more, with the bucket's least node as leader."""
    stats = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1").drop("size")
    return rows.join(stats, "bucket")


def best_leaders(members: DataFrame) -> DataFrame:
    """(node, leader): the leader with which a node shares most buckets."""
    counts = members.filter("node != leader").groupBy("node", "leader").agg(F.count("*").alias("shared"))
    return counts.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("best")).select("node", "best.leader")


def other_leaders(members: DataFrame) -> DataFrame:
    """(node, leader) of (bucket, node, label): for nodes outside the commonest label of a bucket its greatest node, the one with which they share most such buckets."""
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max("node").alias("leader"))
    top = counts.groupBy("bucket").agg(F.max(F.struct("n", "label", "leader")).alias("top"), F.count("*").alias("labels")).filter("labels > 1").select("bucket", F.col("top.label").alias("common_label"), "top.leader")
    outside = members.join(top, "bucket").filter("label != common_label").groupBy("node", "leader").agg(F.count("*").alias("shared"))
    return outside.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("best")).select("node", "best.leader")


def star_units(pairs: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """(u1, u2, u3, side, node): each leader against some of its nodes at a time.

    A unit's nodes weigh about ``most`` together, so a leader with very many has many units.
    """
    weighed = pairs.join(weights, "node")
    sums = weighed.groupBy("leader").agg(F.ceil(F.sum("weight") / F.lit(float(most))).cast("int").alias("parts"))
    dealt = weighed.join(sums, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "parts")
    unit = lambda part, side, node: [F.col("leader").alias("u1"), F.col(part).alias("u2"), F.lit(0).alias("u3"), F.lit(side).alias("side"), F.col(node).alias("node")]
    leaders = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*unit("part", 1, "node")).union(leaders.select(*unit("part", 0, "leader")))


def mixed_units(members: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(u1, u2, u3, side, node, label, common) of (bucket, node, label): every pair of a bucket whose labels differ.

    Buckets with one label go.  Within a bucket the commonest label is left out of side 0, so that a
    group that is settled but for a few nodes costs in proportion to its size: side 0 (the others) is
    dealt into blocks, side 1 (all) too, and each block of one meets each block of the other.
    A block has about BLOCK nodes at most, and with weights (node, weight) those of about 1 together.
    """
    weighed = members.withColumn("weight", F.lit(0.0)) if weights is None else members.join(weights, "node")
    counts = weighed.groupBy("bucket", "label").agg(F.sum(F.col("weight") + 1.0 / BLOCK).alias("n"))
    stats = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n)).cast("int")
    sized = stats.select("bucket", F.col("top.label").alias("common_label"), blocks(F.col("size") - F.col("top.n")).alias("few"), blocks(F.col("size")).alias("all"))
    rows = members.join(sized, "bucket").withColumn("common", F.col("label") == F.col("common_label"))
    own = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    to = lambda few, every, side: F.struct(few.cast("int").alias("u2"), every.cast("int").alias("u3"), F.lit(side).alias("side"))
    right = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: to(i, own(F.col("all")), 1))
    left = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda i: to(own(F.col("few")), i, 0))
    places = F.when(F.col("common"), right).otherwise(F.concat(right, left))
    return rows.select(F.col("bucket").alias("u1"), "node", "label", "common", F.explode(places).alias("p")).select("u1", "p.u2", "p.u3", "p.side", "node", "label", "common")


class Forest:
    """Union-find over a unit's rows; ``join`` says whether the link was needed."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[i] = j
        return i != j


def units_of(batches, names: list[str]):
    """Lists of rows (tuples of names) of one unit (u1, u2, u3) after another, from batches sorted by unit."""
    held, at = [], None
    for batch in batches:
        keys = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("u1", "u2", "u3")), strict=True)
        rows = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
        for key, row in zip(keys, rows, strict=True):
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def by_unit(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Units whole and in order within partitions; a unit is of bounded size."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "u1", "u2", "u3").sortWithinPartitions("u1", "u2", "u3", "side", "node")
