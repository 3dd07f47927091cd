"""Detection rules over code lines.

rules: id, languages, file_patterns, import_gate, detections (match, protocol, confidence, target_extraction), ord.
Lines meet the literals of rules of their language through an inverted index; globs and import gates are
checked where a file and a rule meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topolake.functions import strings as S
from topolake.lineage import cut
from topolake.operators import literals
from topolake.operators.lines import is_comment, lines_of, with_docstrings

RULE = (
    "id string, languages array<string>, file_patterns array<string>, import_gate array<string>, "
    "detections array<struct<match:string,protocol:string,confidence:string,target_extraction:string>>, ord int"
)
#: Rules that are broadcast, at most; more are joined by shuffle.
MOST_RULES = 20_000
#: Lines looked back for a default, and ahead for a string.
BACK, AHEAD = 20, 5


def flatten_registry(registry: DataFrame) -> DataFrame:
    """rules of {languages: [{language, patterns}]}; a rule without languages has that of its group."""
    groups = registry.select(F.explode("languages").alias("g"))
    rules = groups.select("g.language", F.explode("g.patterns").alias("p")).select("language", "p.*")
    return rules.withColumn("languages", F.when(F.coalesce(F.size("languages"), F.lit(0)) <= 0, F.array("language")).otherwise(F.col("languages"))).drop("language")


def override_rules(rules: DataFrame, own: DataFrame) -> DataFrame:
    """Rules of the same id replaced in place, new ones at the end; unknown confidence is medium."""
    fixed = own.withColumn("detections", F.transform("detections", lambda d: d.withField("confidence", F.when(d.confidence.isin("high", "medium", "low"), d.confidence).otherwise("medium"))))
    last = fixed.groupBy("id").agg(F.max_by(F.struct(*fixed.columns), "ord").alias("r")).select("r.*")
    places = rules.select("id", F.col("ord").alias("_place"))
    end = rules.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).first()["m"] + 1
    moved = last.join(places, "id", "left").withColumn("ord", F.coalesce("_place", F.col("ord") + F.lit(end)).cast("int")).drop("_place")
    return rules.join(own.select("id"), "id", "left_anti").unionByName(moved)


def disable_rules(rules: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """rules without those named by a list, or by a table (id) of any length."""
    if isinstance(ids, DataFrame):
        return rules.join(ids.select("id").distinct(), "id", "left_anti")
    return rules.filter(~F.col("id").isin(*ids)) if ids else rules


def with_env_defaults(lines: DataFrame, file: str = "rel_path", order: str = "line_no") -> DataFrame:
    """lines (language, line, ...) with ``env_default``, the default that an environment read near a line gives.

    Java annotations give theirs inline; Go, C# and Java else the first string from here to five lines ahead;
    the others the nearest read with a default from here to twenty lines back; else a hint ``env:NAME``.
    """
    line, lang = F.col("line"), F.col("language")
    bare = S.trimmed(line)
    first, second = S.first_string(bare), S.second_string(bare)
    python = bare.contains("os.getenv(") | bare.contains("os.environ.get(")
    script, rust = bare.contains("process.env."), bare.contains("env::var(")
    fetch, index = bare.contains("ENV.fetch("), bare.contains("ENV[")
    read = F.when(lang == "python", python).when(lang.isin("typescript", "javascript"), script).when(lang == "rust", rust).when(lang == "ruby", fetch | index)
    default = (
        F.when((lang == "python") & python, second)
        .when(lang.isin("typescript", "javascript") & script, S.nullish_default(bare))
        .when((lang == "rust") & rust & bare.contains(".unwrap_or("), S.unwrap_or_default(bare))
        .when((lang == "ruby") & fetch, second)
        .when((lang == "ruby") & index, S.or_default(bare))
    )
    name = F.when(read, F.when(lang.isin("typescript", "javascript"), S.process_env_var(bare)).otherwise(first))
    by = Window.partitionBy(file).orderBy(order)
    back, ahead = by.rowsBetween(-BACK, 0), by.rowsBetween(0, AHEAD)
    hint = lambda v: F.concat(F.lit("env:"), v)
    inline = S.found(S.trimmed(F.regexp_replace(F.regexp_extract(line, r"\$\{[^:]*:([^}]*)\}", 1), "^[\"']+|[\"']+$", "")))
    annotated = (lang == "java") & line.contains("@Value(")
    in_java = F.coalesce(inline, hint(S.first_string(line)), F.lit(""))
    forward = F.coalesce(hint(F.first(S.first_string(line), True).over(ahead)), F.lit(""))
    nearest = F.coalesce(F.last(default, True).over(back), hint(F.coalesce(S.first_string(line), F.last(name, True).over(back), S.caps_argument(line))), F.lit(""))
    return lines.withColumn("env_default", F.when(annotated, in_java).when(lang.isin("go", "csharp", "java"), forward).otherwise(nearest))


def target(strategy: Column, line: Column, env_default: Column) -> Column:
    """By strategy: none, first_string_arg, named_arg:K, url_hostname, env_default; others give none."""
    key = F.regexp_extract(strategy, "^named_arg:(.*)$", 1)
    at = F.instr(line, F.concat(key, F.lit("=")))
    named = S.first_string(F.when(at > 0, F.substring(line, at + F.length(key) + 1, F.length(line))))
    return F.when(strategy == "first_string_arg", S.first_string(line)).when(strategy.startswith("named_arg:"), named).when(strategy == "url_hostname", S.string_hostname(line)).when(strategy == "env_default", env_default)


def by_language(rules: DataFrame, columns: list[str]) -> DataFrame:
    """(language, rules): the rules of each language as one array, broadcast where they are at most MOST_RULES; ``languages`` is exploded."""
    keyed = rules.withColumn("language", F.explode("languages")).groupBy("language").agg(F.collect_list(F.struct(*columns)).alias("rules"))
    return F.broadcast(keyed) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else keyed


def gated(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(rel_path, rule columns) of files (rel_path, language, content) and rules whose language, globs and import gate agree.

    A file meets all rules of its language in one row; only those that pass become rows, without the text.
    """
    own = [c for c in rules.columns if c != "languages"]
    compiled = rules.withColumn("globs", F.transform(F.coalesce("file_patterns", F.array().cast("array<string>")), glob_pattern))
    passes = lambda r: (F.size(r.globs) == 0) | F.exists(r.globs, lambda g: F.rlike("rel_path", g))
    gate = lambda r: (F.coalesce(F.size(r.import_gate), F.lit(0)) <= 0) | F.exists(r.import_gate, lambda g: F.contains(F.col("content"), g))
    met = files.join(by_language(compiled, [*own, "globs"]), "language")
    kept = [c for c in files.columns if c != "content"]
    return met.select(*kept, F.explode(F.filter("rules", lambda r: passes(r) & gate(r))).alias("rule")).select(*kept, *[F.col(f"rule.{c}") for c in own])


def glob_pattern(glob: Column) -> Column:
    """The glob as an anchored pattern, as functions.strings.glob_regex gives it."""
    out = F.regexp_replace(glob, r"([.+()|^$@%\[\]{}])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("*"))
    out = F.replace(F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\u0001"), F.lit("(?:.*/)?"))
    return F.concat(F.lit("^"), out, F.lit("$"))


def literals_of(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections (language, literal, rule columns) and gates (language, id, ord, literal) of rules."""
    placed = rules.withColumn("language", F.explode("languages")).drop("languages")
    detections = placed.select("language", "id", "ord", "file_patterns", "import_gate", F.posexplode("detections").alias("d_ord", "d")).withColumn("literal", F.col("d.match"))
    return detections, placed.select("language", "id", "ord", F.explode("import_gate").alias("literal"))


def shown_gates(files: DataFrame, gates: DataFrame, keep: list[str], hits: DataFrame) -> DataFrame:
    """(keep, literal) of the gates in files, among literal hits of their lines and, where a gate has a line end, in whole texts."""
    found = hits.join(literals.small(gates.select("language", "literal").distinct()), ["language", "literal"], "left_semi").select(*keep, "literal")
    long = gates.filter(F.col("literal").rlike("[\r\n]")).groupBy("language").agg(F.collect_set("literal").alias("own"))
    if not long.isEmpty():
        found = found.union(files.join(literals.small(long), "language").select(*keep, F.explode(F.filter("own", lambda g: F.contains("content", g))).alias("literal")))
    return found.distinct()


def apply_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Connections of files (rel_path, language, service, content): one a line and detection that match.

    Lines meet detections and import gates through an index of their literals, so no line or file is held against all rules.  Globs and gates are
    checked for files and rules that meet, and only files with a hit are read for docstrings and defaults.  Joins by file are shuffles, as
    Spark's estimate of files made from a few columns is far too low.
    Python docstrings and comments are passed over.  A rule that finds no target gives an empty one with medium confidence.
    """
    own = files.select("rel_path", "language", "content").filter("language is not null")
    detections, gates = literals_of(rules)
    wanted = detections.select("language", "literal").union(gates.select("language", "literal"))
    met = cut(literals.hits(lines_of(own), wanted, ["language"]).select("rel_path", "language", "line_no", "literal"))
    at = met.join(literals.small(detections), ["language", "literal"])
    globs = F.transform(F.coalesce("file_patterns", F.array().cast("array<string>")), glob_pattern)
    at = at.filter((F.size(globs) == 0) | F.exists(globs, lambda g: F.rlike("rel_path", g))).drop("file_patterns", "literal")
    ungated = F.coalesce(F.size("import_gate"), F.lit(0)) <= 0
    shown = shown_gates(own, gates, ["rel_path", "language"], met)
    # only gates of rules that a file meets: a gate may be that of any number of rules
    asked = at.filter(~ungated).select("rel_path", "language", "id", "ord", F.explode("import_gate").alias("literal")).distinct()
    opened = asked.hint("merge").join(shown, ["rel_path", "language", "literal"], "left_semi").select("rel_path", "language", "id", "ord").distinct()
    passed = at.filter(ungated).union(at.filter(~ungated).hint("merge").join(opened, ["rel_path", "language", "id", "ord"], "left_semi").select(at.columns)).select("rel_path", "line_no", "id", "ord", "d_ord", "d")
    chosen = files.filter("language is not null").hint("merge").join(passed.select("rel_path").distinct(), "rel_path", "left_semi")
    lines = with_env_defaults(with_docstrings(lines_of(chosen), "rel_path"))
    code = lines.filter(~(F.col("in_doc") & (F.col("language") == "python")) & ~is_comment(F.col("line")))
    hits = code.hint("merge").join(passed, ["rel_path", "line_no"])
    found, sure = S.demoted(target(F.col("d.target_extraction"), F.col("line"), F.col("env_default")), F.col("d.confidence"))
    return hits.select(
        F.coalesce("service", F.lit("")).alias("source_service"), found.alias("target_name"), F.col("d.protocol").alias("protocol"),
        F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("path"),
        F.concat_ws(":", "rel_path", F.col("line_no").cast("string")).alias("source_file"), sure.alias("confidence"),
        F.concat(F.lit("pattern:"), F.col("id")).alias("extraction_method"), F.col("id").alias("dependency"), S.trimmed(F.col("line")).alias("evidence"),
        (F.col("ord") * 1000 + F.col("d_ord")).cast("long").alias("rank"),
    )
