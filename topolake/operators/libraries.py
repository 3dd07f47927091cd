"""Libraries with known protocols and where they are imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topolake.functions import strings as S
from topolake.operators.lines import lines_of


#: Libraries with protocols that are broadcast, at most; more are joined by shuffle.
MOST_LIBRARIES = 20_000


def resolve(deps: DataFrame, scanned: DataFrame, locked: DataFrame) -> DataFrame:
    """(language, dep, protocols): what the library's sources show, else what its locked dependencies suggest.

    deps (language, dep); scanned (dep, protocol) from rules over library sources; locked (language, dep, needs).
    Tool libraries and those without a protocol are left out; each dependency is looked at once.
    """
    wanted = deps.select("language", "dep").distinct().filter(~S.is_tool_library(F.col("dep")))
    shown = scanned.groupBy("dep").agg(F.sort_array(F.collect_set("protocol")).alias("shown"))
    needs = locked.select("language", "dep", F.explode(S.library_protocols(F.col("needs"))).alias("p")).groupBy("language", "dep").agg(F.sort_array(F.collect_set("p")).alias("inherited"))
    both = wanted.join(shown, "dep", "left").join(needs, ["language", "dep"], "left")
    return both.select("language", "dep", F.coalesce("shown", "inherited").alias("protocols")).filter("size(protocols) > 0")


def import_connections(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """One connection a library, protocol and service: the first file in order that imports it, its first such line.

    A line meets the libraries of its language as one array, so no language gathers its lines in one task.
    """
    lines = lines_of(files.filter("language is not null")).select("rel_path", "file_ord", "language", "service", "line_no", "line").filter(F.col("line").rlike("import |from |require|use |extern crate |^\\s*\""))
    known = libraries.groupBy("language").agg(F.collect_list(F.struct("dep", "protocols")).alias("known"))
    if libraries.limit(MOST_LIBRARIES + 1).count() <= MOST_LIBRARIES:
        known = F.broadcast(known)
    met = lines.join(known, "language").withColumn("lib", F.explode(F.filter("known", lambda k: S.imports(F.col("line"), k.dep)))).drop("known")
    hits = met.select("*", "lib.dep", F.explode("lib.protocols").alias("protocol"))
    best = hits.groupBy("dep", "protocol", F.coalesce("service", F.lit("")).alias("source_service")).agg(F.min(F.struct("file_ord", "line_no", "rel_path", "line")).alias("m"))
    return best.select(
        "source_service", F.lit("").alias("target_name"), "protocol", F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("path"),
        F.col("m.rel_path").alias("source_file"), F.lit("medium").alias("confidence"), F.concat(F.lit("library_resolution:"), F.col("dep"), F.lit("→"), F.col("protocol")).alias("extraction_method"),
        F.col("dep").alias("dependency"), S.trimmed(F.col("m.line")).alias("evidence"), F.col("m.file_ord").cast("long").alias("rank"),
    )
