"""Dependencies that manifests and lock files name.

All: (language, dep) from files (rel_path, content); only manifests at the top of a tree count.  Where files
have a column ``repo``, each repository is a tree of its own and the results have it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topolake.functions import strings as S
from topolake.operators.lines import lines_of
from topolake.sources.documents import entries, toml_json


def _own(df: DataFrame) -> list[str]:
    return [c for c in ("repo",) if c in df.columns]


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.col("rel_path") == name)


def _lines(files: DataFrame) -> DataFrame:
    return lines_of(files.select(*_own(files), "rel_path", "content")).withColumn("bare", S.trimmed(F.col("line")))


def _deps(df: DataFrame, language: str, dep: Column) -> DataFrame:
    return df.select(*_own(df), F.lit(language).alias("language"), dep.alias("dep")).filter("dep is not null and dep != ''").distinct()


def _keys(value: Column, path: str) -> Column:
    return F.transform(entries(value, path), lambda e: e.key)


def _toml(files: DataFrame) -> DataFrame:
    return files.select(*_own(files), "rel_path", F.try_parse_json(toml_json("content")).alias("doc"))


def python(files: DataFrame) -> DataFrame:
    """pyproject's, or those of requirements where it names none."""
    doc = _toml(_named(files, "pyproject.toml"))
    listed = F.coalesce(F.try_variant_get("doc", "$.project.dependencies", "array<string>"), F.array().cast("array<string>"))
    poetry = F.filter(_keys(F.col("doc"), "$.tool.poetry.dependencies"), lambda k: k != "python")
    first = _deps(doc.select(*_own(doc), F.explode(F.concat(F.transform(listed, S.requirement_name), poetry)).alias("d")), "python", F.col("d"))
    lines = _lines(_named(files, "requirements.txt")).filter(~F.col("bare").rlike("^(#|-|$)"))
    second = _deps(lines, "python", S.requirement_name(F.col("bare")))
    at = [*_own(files), "language"]
    return first.unionByName(second.join(first.select(*at).distinct(), at, "left_anti").select(first.columns))


def node(files: DataFrame) -> DataFrame:
    doc = _named(files, "package.json").select(*_own(files), F.try_parse_json("content").alias("doc"))
    return _deps(doc.select(*_own(doc), F.explode(_keys(F.col("doc"), "$.dependencies")).alias("d")), "node", F.col("d"))


def rust(files: DataFrame) -> DataFrame:
    return _deps(_toml(_named(files, "Cargo.toml")).select(*_own(files), F.explode(_keys(F.col("doc"), "$.dependencies")).alias("d")), "rust", F.col("d"))


def go(files: DataFrame) -> DataFrame:
    lines = _lines(_named(files, "go.mod"))
    mark = F.when(F.col("bare").rlike(r"^require\s*\("), True).when(F.col("bare") == ")", False)
    inside = F.coalesce(F.last(mark, True).over(Window.partitionBy(*_own(files), "rel_path").orderBy("line_no")), F.lit(False))
    rows = lines.withColumn("inside", inside & mark.isNull())
    name = F.when(F.col("inside"), F.regexp_extract("bare", r"^([^\s/][^\s]*)\s+v", 1)).otherwise(F.regexp_extract("bare", r"^require\s+([^\s(]+)\s+v", 1))
    return _deps(rows, "go", name)


def java(files: DataFrame) -> DataFrame:
    """Compile dependencies of a pom as group:artifact; each tag stands on one line."""
    block = r"(?s)<dependency>(.*?)</dependency>"
    parts = _named(files, "pom.xml").select(*_own(files), F.explode(F.regexp_extract_all("content", F.lit(block), F.lit(1))).alias("b"))
    tag = lambda t: F.regexp_extract("b", f"<{t}>([^<\n]*)</{t}>", 1)
    return _deps(parts.filter(~tag("scope").isin("test", "provided")), "java", F.when((tag("groupId") != "") & (tag("artifactId") != ""), F.concat_ws(":", tag("groupId"), tag("artifactId"))))


def csharp(files: DataFrame) -> DataFrame:
    projects = files.filter(F.col("rel_path").rlike(r"^[^/]*\.csproj$"))
    return _deps(projects.select(*_own(projects), F.explode(F.regexp_extract_all("content", F.lit("PackageReference[^>\n]*Include=\"([^\"]*)\""), F.lit(1))).alias("d")), "csharp", F.col("d"))


def ruby(files: DataFrame) -> DataFrame:
    lines = _lines(_named(files, "Gemfile")).filter(~F.col("bare").rlike(":test|:development"))
    return _deps(lines, "ruby", F.regexp_extract("bare", "^gem\\s+[\"']([^\"']+)[\"']", 1))


def cargo_lock(files: DataFrame) -> DataFrame:
    """(language, dep, needs) of each locked package, and repo where files have it."""
    packages = _toml(_named(files, "Cargo.lock")).select(*_own(files), F.explode(F.try_variant_get("doc", "$.package", "array<variant>")).alias("p"))
    needs = F.try_variant_get("p", "$.dependencies", "array<string>")
    return packages.select(*_own(files), F.lit("rust").alias("language"), F.try_variant_get("p", "$.name", "string").alias("dep"), F.explode(needs).alias("n")).withColumn("needs", F.split_part("n", F.lit(" "), F.lit(1))).drop("n")


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Four blanks before a gem, six before what it needs with a version."""
    lines = lines_of(_named(files, "Gemfile.lock").select(*_own(files), "rel_path", "content"))
    gem = F.when(F.col("line").rlike(r"^ {4}[^ ]"), F.regexp_extract("line", r"^ {4}([^ (]+)", 1))
    rows = lines.withColumn("dep", F.last(gem, True).over(Window.partitionBy(*_own(files), "rel_path").orderBy("line_no")))
    found = rows.withColumn("needs", F.regexp_extract("line", r"^ {6}([^ (]+) \(", 1)).filter("needs != '' and dep is not null")
    return found.select(*_own(files), F.lit("ruby").alias("language"), "dep", "needs")


def go_lock(files: DataFrame) -> DataFrame:
    """Every Go dependency is taken to need all of go.mod."""
    deps = go(files)
    return deps.join(deps.select(*_own(files), "language", F.col("dep").alias("needs")), [*_own(files), "language"])  # one go.mod's lines with each other


READERS = {"python": python, "node": node, "rust": rust, "go": go, "java": java, "csharp": csharp, "ruby": ruby}


def dependencies(files: DataFrame) -> DataFrame:
    found = None
    for reader in READERS.values():
        found = reader(files) if found is None else found.unionByName(reader(files))
    return found


def faults(files: DataFrame) -> DataFrame:
    """(rel_path, extractor, error), and repo where files have it, of manifests and lock files that aren't TOML or JSON."""
    toml = F.col("rel_path").isin("pyproject.toml", "Cargo.toml", "Cargo.lock")
    asked = files.filter(toml | (F.col("rel_path") == "package.json")).filter("content is not null")
    doc = F.when(toml, F.try_parse_json(toml_json("content"))).otherwise(F.try_parse_json("content"))
    return asked.withColumn("doc", doc).filter("doc is null").select(*_own(files), "rel_path", F.lit("manifest").alias("extractor"), F.when(toml, "malformed TOML").otherwise("malformed JSON").alias("error"))
