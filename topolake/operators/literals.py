"""Many literals looked for in many lines at once, by an inverted index.

A literal is filed under one required piece of it; the distinct words of all lines ask for their own pieces by an equality join, and only
lines and literals that meet in a word are compared.  What a line costs follows its length and its hits, not the number of literals.

A piece is a run of letters, digits and underscores in the literal.  Whether the literal goes on beyond it says how a line must show it:

    w  as a whole word (the literal has other characters on both sides)
    t  as the tail of a word (the literal begins with the piece)
    h  as the head of a word (the literal ends with it)
    i  somewhere in a word (the literal is the piece): filed under its first GRAM characters
    p  anywhere (no such run in the literal): filed under its first GRAM characters
    e  always (the empty literal)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topolake.lineage import cut

WORD = "[A-Za-z0-9_]+"
GRAM = 4
#: Bytes of a table that is broadcast, at most; a larger one is joined by shuffle.
MOST_BYTES = 16 << 20
#: Literals that are constants of the plan, at most.
FEW = 32
#: A word is common if it makes up more than this part of all words: at most as many are.
COMMON = 1000


def small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if its rows as JSON are at most MOST_BYTES, else to be joined by a shuffle whatever its estimated size."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= MOST_BYTES else table.hint("merge")


def filed(literals: DataFrame, by: list[str]) -> DataFrame:
    """(by, literal, key) of distinct literals (by, literal): of a literal's pieces the one that the fewest others share, then the strictest kind, then the longest."""
    literal = F.col("literal")
    pieces = F.regexp_extract_all("literal", F.lit(WORD), F.lit(0))
    begins, ends = literal.rlike(rf"\A{WORD}"), literal.rlike(rf"{WORD}\z")
    kind = lambda i, n: F.when((i == 0) & begins & (i == n - 1) & ends, "i").when((i == 0) & begins, "t").when((i == n - 1) & ends, "h").otherwise("w")
    key = lambda kind, piece: F.concat(kind, F.when(kind == "i", F.left(piece, F.lit(GRAM))).otherwise(piece))
    keys = F.transform(pieces, lambda p, i: key(kind(i, F.size(pieces)), p))
    other = F.array(F.when(literal == "", "e").otherwise(F.concat(F.lit("p"), F.left(literal, F.lit(GRAM)))))
    each = literals.select(*by, "literal").distinct().withColumn("key", F.explode(F.when(F.size(pieces) > 0, F.array_distinct(keys)).otherwise(other)))
    shared = each.groupBy(*by, "key").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.instr(F.lit("wthipe"), F.left("key", F.lit(1))).alias("kind"), (-F.length("key")).alias("size"), "key")
    return each.join(shared, [*by, "key"]).groupBy(*by, "literal").agg(F.min_by("key", rank).alias("key"))


def words_of(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))


def word_keys(word: Column, lengths: dict[str, list[int]]) -> Column:
    """The distinct keys under which literals that a line with this word contains may be filed.  lengths: of each kind, the lengths of pieces in use."""
    fits = lambda kind: F.filter(F.array(*map(F.lit, lengths[kind])), lambda n: n <= F.length(word))
    parts = {
        "w": lambda: F.array(F.concat(F.lit("w"), word)),
        "t": lambda: F.transform(fits("t"), lambda n: F.concat(F.lit("t"), F.right(word, n))),
        "h": lambda: F.transform(fits("h"), lambda n: F.concat(F.lit("h"), F.left(word, n))),
        "i": lambda: grams("i", word, fits("i")),
    }
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[parts[k]() for k in lengths if k in parts]))


def grams(kind: str, text: Column, sizes: Column) -> Column:
    """The pieces of a text that are of these sizes, behind the kind."""
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(kind), F.substring(text, i, n)))))


def first_word(line: Column, key: Column, literal: Column) -> Column:
    """Of a line's words the first that meets a literal filed under a key of the kinds w, t, h and i."""
    piece = F.substring(key, 2, 1 << 30)
    fits = lambda w: F.when(key.startswith("w"), w == piece).when(key.startswith("t"), F.endswith(w, piece)).when(key.startswith("h"), F.startswith(w, piece)).otherwise(F.contains(w, literal))
    return F.get(F.filter(words_of(line), fits), 0)


def hits(lines: DataFrame, literals: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, line, ...) once for each of the distinct literals (by, literal) that the line contains, with ``literal``.

    A few literals are looked for in each line.  Of many, keys are made and joined for the distinct words of all lines, not for each line; then a line
    meets literals by those of its words that met some: words that many lines have by a broadcast, the others by a shuffle if they are many.
    """
    wanted = literals.select(*by, "literal").distinct()
    few = wanted.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return _plain_hits(lines, few, by)
    index = cut(filed(literals, by))
    kinds = index.groupBy(F.left("key", F.lit(1)).alias("kind")).agg(F.collect_set(F.length("key") - 1).alias("lengths")).collect()  # as many numbers as pieces have lengths
    lengths = {r["kind"]: sorted(r["lengths"]) for r in kinds}
    each = lines.withColumn("_word", F.explode_outer(words_of(F.col("line")))).filter("_word is not null")  # outer: else words are made once more to see that there are some
    told = cut(each.groupBy(*by, "_word").agg(F.count("*").alias("n")))
    asked = told.select(*by, "_word", "n", F.explode(word_keys(F.col("_word"), lengths)).alias("key"))
    met = cut(asked.join(small(index), [*by, "key"]).filter(~F.col("key").startswith("i") | F.contains("_word", "literal")))
    often = F.col("n") > (told.agg(F.sum("n")).first()[0] or 0) // COMMON
    usual = small(told.filter(often).select(*by, "_word"))
    found = each.join(small(met.filter(often).drop("n")), [*by, "_word"])
    if not met.filter(~often).isEmpty():
        found = found.unionByName(each.join(usual, [*by, "_word"], "left_anti").join(small(met.filter(~often).drop("n")), [*by, "_word"]))
    found = found.filter(F.contains("line", "literal")).filter(first_word(F.col("line"), F.col("key"), F.col("literal")) == F.col("_word")).drop("_word", "key")
    wordless = {k: n for k, n in lengths.items() if k in "pe"}
    if wordless:
        keys = F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams("p", F.col("line"), F.filter(F.array(*map(F.lit, n)), lambda x: x <= F.length("line"))) if k == "p" else F.array(F.lit("e")) for k, n in wordless.items()]))
        other = lines.withColumn("key", F.explode_outer(keys)).join(small(index.filter(F.left("key", F.lit(1)).isin(*wordless))), [*by, "key"])
        found = found.unionByName(other.filter(F.contains("line", "literal")).drop("key"))
    return found.select(*by, *[c for c in lines.columns if c not in by], "literal")


def _plain_hits(lines: DataFrame, few: list, by: list[str]) -> DataFrame:
    """hits of at most FEW literals, as constants of the plan."""
    if not few:
        return lines.limit(0).select(*by, *[c for c in lines.columns if c not in by], F.lit(None).cast("string").alias("literal"))
    held = lambda r: F.when(_same(r, by) & F.contains("line", F.lit(r["literal"])), r["literal"])
    return lines.select(*by, *[c for c in lines.columns if c not in by], F.explode_outer(F.filter(F.array(*map(held, few)), lambda x: x.isNotNull())).alias("literal")).filter("literal is not null")


def _same(row, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & (F.col(c) == F.lit(row[c]))
    return out
