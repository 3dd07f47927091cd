"""The whole scan: files and rules to services, endpoints, connections and schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.functions import strings as S
from topolake.lineage import cut
from topolake.operators import config_files, libraries, manifests, refine, relations, routes, rules as rule_ops, wrappers
from topolake.operators.functions_of import cut_files, faults_in, functions_in
from topolake.sources import document as parts

#: Files of each language.
LANGUAGES = {"typescript": r"\.(ts|tsx|js|jsx)$", "python": r"\.py$", "go": r"\.go$", "java": r"\.java$", "csharp": r"\.cs$", "rust": r"\.rs$", "ruby": r"\.rb$"}
SERVICE = "name string, root_path string, language string, service_type string, boundary_entry string, confidence string, extraction_method string, rel_path string"
ENDPOINT = "service_name string, method string, path string, handler string, kind string, confidence string, extraction_method string, rel_path string"
CONNECTION = "source_service string, target_name string, protocol string, method string, path string, source_file string, confidence string, extraction_method string, dependency string, evidence string, rank long"
SCHEMA = "name string, role string, file string, fields array<struct<name:string,field_type:string,required:boolean>>, confidence string, extraction_method string, rel_path string"


def language_of(path):
    out = F.lit(None).cast("string")
    for name, pattern in LANGUAGES.items():
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def _ordered(parts: list[DataFrame], empty: DataFrame, order: list[str], stage: int = 0) -> DataFrame:
    """Union with seq, the place of discovery: by stage, extractor, then ``order``."""
    found = empty.withColumn("_part", F.lit("00"))
    for i, part in enumerate(parts):
        found = found.unionByName(part.withColumn("_part", F.lit(f"{i:02d}")), allowMissingColumns=True)
    return relations.numbered(found, ["_part", *order], "seq", stage << 48).drop("_part")


def installed(sources: DataFrame, deps: DataFrame, rules: DataFrame) -> DataFrame:
    """(dep, protocol) that rules find in sources (rel_path, content) of a folder of installed libraries.

    A library's folder is named as it is, with - as _ (Python), or with its version behind (Ruby).
    """
    folder = F.split_part("rel_path", F.lit("/"), F.lit(1))
    named = deps.select("dep", F.explode(F.array_distinct(F.array("dep", F.replace("dep", F.lit("-"), F.lit("_"))))).alias("folder")).distinct()
    keyed = sources.withColumn("folder", F.regexp_replace(folder, r"-[0-9][^/]*$", "")).filter(F.col("rel_path").contains("/")).join(named, "folder")
    files = keyed.select(F.concat_ws("\t", "dep", "rel_path").alias("rel_path"), language_of(F.col("rel_path")).alias("language"), F.col("dep").alias("service"), "content").filter("language is not null")
    return rule_ops.apply_rules(files, rules).select(F.col("source_service").alias("dep"), "protocol").distinct()


def scan(spark: SparkSession, files: DataFrame, rules: DataFrame | None = None, overrides: DataFrame | None = None, repo_name: str = "repo", only: list[str] | None = None, embed: Callable | None = None, anchors: tuple[list[float], list[float]] = ([], []), libraries_at: DataFrame | None = None) -> dict[str, DataFrame]:
    """Relations of files (rel_path, content), with ``faults``, the files that extractors couldn't read.  only: names of config extractors to run, or all.
    libraries_at: sources (rel_path, content) of installed libraries.

    What several relations start from is checkpointed, so it is computed once and survives lost executors.
    """
    files = cut(files.withColumn("language", language_of(F.col("rel_path"))).withColumn("file_ord", F.pmod(F.xxhash64("rel_path"), F.lit(1 << 55))))
    empty = {n: spark.createDataFrame([], s) for n, s in (("services", SERVICE), ("endpoints", ENDPOINT), ("connections", CONNECTION), ("schemas", SCHEMA))}
    docs = cut(config_files.documents(files))
    configs = [f(files, docs) for n, f in config_files.EXTRACTORS.items() if only is None or n in only]
    take = lambda name: [c[name] for c in configs if name in c]
    services = cut(_ordered(take("services"), empty["services"], ["rel_path", "name"]))
    scoped = cut(relations.scope(files, services))
    endpoints = cut(_ordered([*take("endpoints"), routes.routes(scoped)], empty["endpoints"], ["rel_path", "path", "method"]))
    schemas = _ordered(take("schemas"), empty["schemas"], ["rel_path", "name"])

    traced: list[DataFrame] = []
    faults = config_files.faults(files, docs).unionByName(manifests.faults(files)).unionByName(routes.faults(files))
    if rules is not None:
        bodies = cut(cut_files(files))
        faults = faults.unionByName(faults_in(bodies))
        known = wrappers.trace(functions_in(bodies), cut(wrappers.seeds(rules, files)))
        traced = [wrappers.wrapper_calls(scoped.filter("language is not null"), known)]
    libs = manifests.dependencies(files)
    lib_names = {"node": "typescript"}
    spoken = libs.select(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in lib_names.items() for x in kv]), F.col("language")), "language").alias("language"), "dep").filter(~S.is_tool_library(F.col("dep")))
    none = spark.createDataFrame([], "language string, dep string, needs string")
    shown = spark.createDataFrame([], "dep string, protocol string") if libraries_at is None or rules is None else installed(libraries_at, spoken, rules)
    resolved = libraries.resolve(spoken, shown, manifests.cargo_lock(files).unionByName(manifests.gemfile_lock(files)).unionByName(none))
    found = [*([rule_ops.apply_rules(scoped, rules)] if rules is not None else []), libraries.import_connections(scoped, resolved), *traced]
    code = cut(_ordered(found, empty["connections"], ["rank", "source_file"], 1))
    config = _ordered([c.withColumn("rank", F.lit(0).cast("long")).drop("rel_path") for c in take("connections")], empty["connections"], ["source_file", "source_service", "target_name"])
    connections = cut(config.unionByName(relations.drop_covered_wrappers(code)).drop("rank"))

    endpoints = relations.drop_specified_endpoints(endpoints)
    schemas = relations.drop_specified_schemas(schemas)
    services = cut(relations.infer_root(relations.merge_services(services), endpoints.select("seq").unionByName(connections.select("seq")).unionByName(schemas.select("seq")), repo_name))
    if overrides is not None:
        services, endpoints, connections = relations.ignore_services(services, endpoints, connections, overrides)
        services = relations.rename_services(services, overrides, "root_path", "name")
        endpoints = relations.rename_services(endpoints, overrides, "service_name", "service_name")
        connections = relations.rename_services(connections, overrides, "source_service", "source_service")
    connections = relations.resolve_targets(relations.dedupe_connections(connections), endpoints)
    connections = refine.refine_with(connections, embed, *anchors)
    return {"services": services.drop("rel_path"), "endpoints": endpoints.drop("rel_path"), "connections": connections, "schemas": schemas.drop("rel_path"), "faults": faults}


def document_lines(found: dict[str, DataFrame]) -> DataFrame:
    """The scan document as lines, for ``sources.document.write_parts``."""
    return parts.lines(found["services"], found["endpoints"], found["connections"], found["schemas"])


def document(found: dict[str, DataFrame], metadata: dict[str, object]) -> DataFrame:
    nested = relations.exposed(found["services"], found["endpoints"])
    return relations.payload(nested, found["connections"], found["schemas"], {"tool": "cli", "scan_mode": "full", **metadata})
