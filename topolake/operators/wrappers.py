"""Functions that wrap connections, and their calls.

A call site is the run of characters before a parenthesis; a wrapper's name matches the end of it,
so ``send`` is also found in ``resend(``.  Ends of the distinct call sites, as long as some name, are joined with
the names by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topolake.functions import strings as S
from topolake.lineage import cut
from topolake.operators import literals
from topolake.operators.lines import is_comment_only, lines_of, with_docstring_parity
from topolake.operators.rules import shown_gates

#: Names too general to be wrappers.
GENERAL = (
    "__init__", "run", "main", "start", "stop", "setup", "teardown", "clear", "close", "shutdown", "cleanup", "reset", "init", "dispose", "destroy",
    "configure", "register", "exists", "resolve", "get", "set", "keys", "values", "items", "load", "save", "push", "pop",
)
LONGEST_BODY, DEPTH = 200, 2
SITE = r"([^\s()]+)\("


def seeds(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(language, name, protocol, depth, chain, dependency) of rules for a language, or for all, whose gate some file of it passes."""
    languages = files.select("language").filter("language is not null").distinct()
    of_all = rules.filter(F.coalesce(F.size("languages"), F.lit(0)) <= 0).drop("languages")
    own = rules.withColumn("language", F.explode("languages")).drop("languages")
    placed = own.join(languages, "language", "left_semi").unionByName(of_all.join(languages, F.lit(True)).select(own.columns))  # a few languages
    ungated = F.coalesce(F.size("import_gate"), F.lit(0)) <= 0
    gates = placed.filter(~ungated).select("language", "id", F.explode("import_gate").alias("gate"))
    met = literals.hits(lines_of(files.select("language", "content")), gates.select("language", F.col("gate").alias("literal")), ["language"])
    shown = shown_gates(files, gates.withColumnRenamed("gate", "literal"), ["language"], met).withColumnRenamed("literal", "gate")
    opened = shown.join(gates, ["language", "gate"]).select("language", "id").distinct()
    passed = placed.filter(ungated).unionByName(placed.filter(~ungated).join(opened, ["language", "id"], "left_semi").select(placed.columns))
    named = passed.select("language", "id", "ord", F.posexplode("detections").alias("d_ord", "d")).withColumn("name", F.regexp_replace("d.match", r"\(+$", ""))
    fit = named.filter((F.octet_length("name") >= 4) & ~F.col("name").startswith("."))
    best = fit.groupBy("language", "name").agg(F.min_by(F.struct("d.protocol", "id"), F.struct("ord", "d_ord")).alias("b"))
    return best.select("language", "name", "b.protocol", F.lit(0).alias("depth"), F.array("name").alias("chain"), F.col("b.id").alias("dependency"))


def call_sites(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("site", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(SITE), F.lit(1)))))


def sites_of(sites: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(language, site, wrapper columns): distinct sites that end in a wrapper's name.

    Only ends as long as some name are made: a site costs as many of them as names have lengths, however long it is.
    """
    lengths = sorted(r["n"] for r in wrappers.select(F.length("name").alias("n")).distinct().collect())
    ends = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("site")), lambda n: F.right("site", n))
    tails = sites.select("language", "site").distinct().select("language", "site", F.explode(ends).alias("name"))
    return tails.join(literals.small(wrappers), ["language", "name"])


def trace(functions: DataFrame, start: DataFrame) -> DataFrame:
    """start and the functions (language, name, body, file_ord) that call them, directly or through one other.

    A function's callee is the one of least depth and name; a name keeps its first entry.
    Sizes of rows made from a few columns are estimated far too low, so no join here is left to an estimate.
    """
    known = start
    short = functions.filter((F.size(F.split("body", "\n")) <= LONGEST_BODY) & ~F.col("name").isin(*GENERAL))
    sites = cut(call_sites(short, "body").select("language", F.col("name").alias("caller"), "file_ord", "site"))
    for depth in range(1, DEPTH + 1):
        callee = sites_of(sites, known.select("language", "name", "protocol", "depth", "chain", "dependency"))
        hits = sites.hint("merge").join(callee, ["language", "site"]).filter(F.col("caller") != F.col("name"))
        best = hits.groupBy("language", "caller", "file_ord").agg(F.min_by(F.struct("name", "protocol", "depth", "chain", "dependency"), F.struct("depth", "name")).alias("c"))
        new = best.filter(F.col("c.depth") == depth - 1).groupBy("language", F.col("caller").alias("name")).agg(F.min_by("c", "file_ord").alias("c"))
        grown = new.select("language", "name", "c.protocol", F.lit(depth).alias("depth"), F.concat(F.array("name"), "c.chain").alias("chain"), "c.dependency")
        known = cut(known.unionByName(grown.join(known.select("language", "name").hint("merge"), ["language", "name"], "left_anti").select(known.columns)))
    return known


def wrapper_calls(files: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Connections of lines in files (rel_path, language, service, content) that call a traced wrapper; the definition line counts too."""
    traced = wrappers.filter((F.col("depth") > 0) & ~F.col("name").isin(*GENERAL))
    lines = with_docstring_parity(lines_of(files), "rel_path")
    code = lines.filter(~(F.col("in_doc") & F.col("rel_path").endswith(".py")) & ~is_comment_only(F.col("line")))
    hits = call_sites(code, "line")
    hits = hits.hint("merge").join(sites_of(hits, traced), ["language", "site"]).dropDuplicates(["rel_path", "line_no", "name"])
    return hits.select(
        F.coalesce("service", F.lit("")).alias("source_service"), F.lit("").alias("target_name"), "protocol", F.lit(None).cast("string").alias("method"),
        S.call_argument(F.col("line"), F.col("name")).alias("path"), F.concat_ws(":", "rel_path", F.col("line_no").cast("string")).alias("source_file"), F.lit("medium").alias("confidence"),
        F.concat(F.lit("wrapper_trace:"), F.col("name"), F.lit("→"), F.element_at("chain", -1)).alias("extraction_method"), "dependency", S.trimmed(F.col("line")).alias("evidence"),
        F.col("depth").cast("long").alias("rank"),
    )
