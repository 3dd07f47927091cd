"""Many globs held against many paths, by an index of what a glob requires.

A glob is filed under one thing that a path must have, whichever the fewest other globs share: its last name or the end of it behind the last wildcard,
directories that it begins with, the name of a directory within, or the beginning of a name before a wildcard.  A path asks for its own by an
equality join, for ends and beginnings only of lengths in use; only pairs that meet run a regular expression.  Globs without any of these meet every path.

    n  the last name            x  the end of the last name     d  directories from the top
    c  the name of a directory  h  the beginning of some name   a  nothing
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topolake.lineage import cut
from topolake.operators.literals import small
from topolake.operators.rules import glob_pattern

WILD = r"[*?\[{\\]"


def filed(globs: DataFrame, by: list[str]) -> DataFrame:
    """(by, glob, pattern, key) of distinct globs (by, glob)."""
    names = F.split("glob", "/")
    last = F.element_at(names, -1)
    start = F.array_position(F.transform(names, lambda n: n.rlike(WILD)), True).cast("int")
    lead = F.slice(names, 1, F.when(start == 0, F.size(names)).otherwise(start) - 1)
    # a wildcard may stand for slashes, and two at the end of a name swallow the next one: only behind other names does a name begin as it is written
    begins = lambda i: (i == 0) | ~F.get(names, i - 1).endswith("**") | (F.get(names, i - 1) == "**")
    whole = begins(F.size(names) - 1) & ~last.rlike(WILD)
    inner = F.transform(names, lambda n, i: F.when(begins(i) & ~n.rlike(WILD) & (i < F.size(names) - 1), F.concat(F.lit("c"), n)).when(begins(i) & n.rlike(WILD), F.concat(F.lit("h"), F.regexp_extract(n, r"^([^*?\[\]{}\\]*)", 1))))
    keys = F.concat(
        F.array(
            F.when(whole, F.concat(F.lit("n"), last)),
            F.when(~whole, F.concat(F.lit("x"), F.regexp_extract(last, r"([^*?\[\]{}\\]*)$", 1))),
            F.when(F.size(lead) > 0, F.concat(F.lit("d"), F.array_join(lead, "/"))),
        ),
        inner,
    )
    some = F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (F.length(k) > 1)))
    each = globs.select(*by, "glob").distinct().withColumn("key", F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("a")))))
    shared = each.groupBy(*by, "key").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.instr(F.lit("ndxcha"), F.left("key", F.lit(1))).alias("kind"), (-F.length("key")).alias("size"), "key")
    best = each.join(shared, [*by, "key"]).groupBy(*by, "glob").agg(F.min_by("key", rank).alias("key"))
    return best.withColumn("pattern", glob_pattern(F.col("glob")))


def path_keys(path: Column, lengths: dict[str, list[int]]) -> Column:
    """The keys under which globs that a path matches may be filed.  lengths: of each kind in use, the lengths of what is filed."""
    names = F.split(path, "/")
    last = F.element_at(names, -1)
    fits = lambda kind, name: F.filter(F.array(*map(F.lit, lengths[kind])), lambda n: n <= F.length(name))
    parts = {
        "n": lambda: F.array(F.concat(F.lit("n"), last)),
        "x": lambda: F.transform(fits("x", last), lambda n: F.concat(F.lit("x"), F.right(last, n))),
        "d": lambda: F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.concat(F.lit("d"), F.array_join(F.slice(names, 1, i), "/"))),
        "c": lambda: F.transform(names, lambda name: F.concat(F.lit("c"), name)),
        "h": lambda: F.flatten(F.transform(names, lambda name: F.transform(fits("h", name), lambda n: F.concat(F.lit("h"), F.left(name, n))))),
        "a": lambda: F.array(F.lit("a")),
    }
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[parts[k]() for k in lengths]))


def matched(files: DataFrame, globs: DataFrame, by: list[str], path: str = "rel_path") -> DataFrame:
    """files (by, path, ...) once for each distinct glob (by, glob) that the path matches, with ``glob``."""
    index = cut(filed(globs, by))
    kinds = index.groupBy(F.left("key", F.lit(1)).alias("kind")).agg(F.collect_set(F.length("key") - 1).alias("lengths")).collect()  # as many numbers as pieces have lengths
    keys = path_keys(F.col(path), {r["kind"]: sorted(r["lengths"]) for r in kinds})
    keyed = files.withColumn("key", F.explode_outer(keys))  # outer: else keys are made once more to see that there are some
    return keyed.join(small(index), [*by, "key"]).filter(F.rlike(F.col(path), F.col("pattern"))).drop("key", "pattern")
