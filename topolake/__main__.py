"""python -m topolake PATH [options]: scan a repository."""

from __future__ import annotations

import argparse
import json
import logging
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Observation, SparkSession, functions as F

from topolake.lineage import cut, shared_folder
from topolake.operators import rules as rule_ops
from topolake.operators.variables import content_hash
from topolake.plans.scan import document_lines, scan
from topolake.sources import document, settings, sinks
from topolake.sources.repository import read_repository

log = logging.getLogger("topolake")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="topolake")
    parser.add_argument("path")
    parser.add_argument("--output", help="file for the document")
    parser.add_argument("--dry-run", action="store_true", help="print the document")
    parser.add_argument("--upload", action="store_true", help="send the document to --hub")
    parser.add_argument("--hub"), parser.add_argument("--token"), parser.add_argument("--project")
    parser.add_argument("--rules", help="JSON file or folder of detection rules that Spark can read")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--plugins", help="configuration extractors to run, comma separated")
    parser.add_argument("--config", help="repository TOML")
    parser.add_argument("--include-hidden", action="store_true")
    parser.add_argument("--relations", help="folder for the relations as tables")
    parser.add_argument("--log", help="file to which a line of JSON with the counts of the scan is added")
    return parser.parse_args(argv)


def load_rules(spark: SparkSession, path: str | None, own: list[dict], disabled: list[str]):
    """Registry rules with the repository's own over them; none where there is neither."""
    found = spark.createDataFrame([], rule_ops.RULE)
    if path:
        shape = "languages array<struct<language:string,patterns:array<struct<id:string,languages:array<string>,file_patterns:array<string>,import_gate:array<string>,detections:array<struct<match:string,protocol:string,confidence:string,target_extraction:string>>>>>>"
        flat = rule_ops.flatten_registry(spark.read.schema(shape).json(path, multiLine=True))
        found = flat.withColumn("ord", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")).select("id", "languages", "file_patterns", "import_gate", "detections", "ord")
    if own:
        row = lambda i, r: (r["id"], r.get("languages", []), r.get("file_patterns"), r.get("import_gate"), [(d["match"], d.get("protocol"), d.get("confidence", "medium"), d.get("target_extraction", "none")) for d in r.get("detections", [])], i)
        found = rule_ops.override_rules(found, spark.createDataFrame([row(i, r) for i, r in enumerate(own)], rule_ops.RULE))
    return rule_ops.disable_rules(found, disabled)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    args, started = arguments(argv), datetime.now(UTC)
    spark = SparkSession.builder.appName("topolake").getOrCreate()
    toml = Path(args.config or os.path.join(args.path, "topolake.toml"))
    env = {k: os.environ[f"TOPOLAKE_{k.upper()}"] for k in ("hub", "token", "project") if f"TOPOLAKE_{k.upper()}" in os.environ}
    given = {"root": args.path, "project": args.project, "excludes": args.exclude, "only": settings.only_plugins(args.plugins), "hub": args.hub, "token": args.token}
    chosen = settings.merged(given, env, settings.repository_file(toml.read_text() if toml.exists() else None), settings.global_file(Path.home() / ".config/topolake.json"))
    seen = Observation("files")
    found_files = read_repository(spark, args.path, chosen.excludes, args.include_hidden)
    files = cut(found_files.observe(seen, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")))  # counted as they are read
    counts = seen.get
    rows = [(root, bool(o.get("ignore", False)), o.get("name")) for root, o in chosen.overrides.items()]
    overrides = spark.createDataFrame(rows, "root_path string, ignored boolean, new_name string") if rows else None
    git = settings.git_context(args.path)
    if git["commit"] is None:
        sized = files.select(F.lit(0).alias("all"), F.col("rel_path").alias("path"), F.octet_length("content").alias("size"))
        git["commit"] = next((r["sha"] for r in content_hash(sized, "all").collect()), None)
    rules = load_rules(spark, args.rules, chosen.rules, chosen.disabled_rules)
    found = scan(spark, files, rules, overrides, git["repo_name"], chosen.only)
    meta = {**git, "project": chosen.project or git["repo_name"], "files_scanned": counts["files"], "started_at": started.isoformat()}
    folder = f"{shared_folder(spark).removeprefix('file:')}/document-{uuid.uuid4().hex}"
    document.write_parts(document_lines(found), folder, {"tool": "cli", "scan_mode": "full", **meta})
    if args.log:
        took = (datetime.now(UTC) - started).total_seconds()
        with open(args.log, "a", encoding="utf-8") as file:
            file.write(json.dumps({"started_at": started.isoformat(), "seconds": round(took, 3), **counts, "lines": document.counts(folder)}) + "\n")
    if args.relations:
        sinks.write_relations(found, args.relations)
    if args.dry_run:
        for piece in document.texts(folder):
            print(piece, end="")
    elif args.upload:
        if not chosen.hub or not chosen.token:
            log.error("--upload needs a hub and a token")
            return 1
        return 0 if sinks.upload("".join(document.texts(folder)), chosen.hub, chosen.token, args.path) else 1
    else:
        log.info("wrote %s", document.join(folder, sinks.target_of(args.output, args.path)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
