"""A tree of files as a table (rel_path, content).

``read_repository`` lists a tree a level at a time, directories being rows that tasks list, and reads its files in tasks.  ``repository`` is
the same as a Python data source, with a partition for each directory at the top.  Unlike Spark's own file sources both see names that begin with a
dot or an underscore.  ``guarded`` applies the same guards to bytes read by any source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from topolake.functions.strings import glob_regex
from topolake.lineage import cut
from topolake.shipping import ship

#: Directories that are never looked into.
EXCLUDED = (
    ".git", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "target", "dist", "build", "out", ".next", "vendor",
    "tests", "test", "__tests__", "spec", "fixtures",
)
EXCLUDED_PATH = "(^|/)(" + "|".join(re.escape(d) for d in EXCLUDED) + ")/"
#: Bytes of a file at most, and bytes in which NUL or no line end rule a file out.
LARGEST, HEAD = 512_000, 8192
SCHEMA = "rel_path string, content string"
#: Bytes of files that one task reads, about.
PART = 64 << 20


def ignore_pattern(line: str) -> tuple[bool, str] | None:
    """(ignored, pattern) of a line of an ignore file; None for blanks and comments."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    inner = line.rstrip("/")
    body = glob_regex(inner.lstrip("/"))[1:-1].replace(".*", "[^/]*") if "**" not in inner else glob_regex(inner.lstrip("/"))[1:-1]
    anchored = "^" if "/" in inner.strip("/") or line.startswith("/") else "^(?:.*/)?"
    return not keep, f"{anchored}{body}(?:/.*)?$" if not line.endswith("/") else f"{anchored}{body}/.*$"


Rule = tuple[bool, str]


def children(root: str, at: str, rules: list[Rule], excludes: list[str], hidden: bool) -> tuple[list[tuple[str, list[Rule]]], list[tuple[str, int]]]:
    """Directories with the ignore rules that hold in them, and files with their sizes, of the directory ``at``, which rules of those above hold in.

    Of the rules that match the last decides, and an ignored directory isn't looked into.  What ``excludes`` names goes whatever ignore files say.
    Links and special files are left out, and files beyond the size guard.
    """
    prefix = f"{at}/" if at else ""
    with os.scandir(os.path.join(root, at)) as found:
        entries = sorted(found, key=lambda e: e.name)
    own = next((e for e in entries if e.name == ".gitignore" and e.is_file(follow_symlinks=False)), None)
    if own:
        with open(own.path, encoding="utf-8", errors="replace") as file:
            rules = rules + [(i, "^" + re.escape(prefix) + p.removeprefix("^")) for line in file if (q := ignore_pattern(line)) for i, p in [q]]
    out_of = [p for e in excludes if (q := ignore_pattern(e)) for _, p in [q]]
    ignored = lambda path: any(re.match(p, path) for p in out_of) or next((i for i, p in reversed(rules) if re.match(p, path)), False)
    seen = [e for e in entries if hidden or not e.name.startswith(".")]
    dirs = [(prefix + e.name, rules) for e in seen if e.is_dir(follow_symlinks=False) and e.name not in EXCLUDED and not ignored(f"{prefix}{e.name}/")]
    files = [(prefix + e.name, size) for e in seen if e.is_file(follow_symlinks=False) and not ignored(prefix + e.name) and (size := e.stat(follow_symlinks=False).st_size) <= LARGEST]
    return dirs, files


def listed(root: str, at: str, rules: list[Rule], excludes: list[str], hidden: bool) -> Iterator[str]:
    """Files below a directory, a directory at a time."""
    todo = [(at, rules)]
    while todo:
        at, rules = todo.pop()
        dirs, files = children(root, at, rules, excludes, hidden)
        todo += reversed(dirs)
        yield from (path for path, _ in files)


def readable(data: bytes) -> str | None:
    """Text of a file that no guard rules out: size, NUL bytes, a first line beyond the head, encoding."""
    head = data[:HEAD]
    if len(data) > LARGEST or b"\0" in head or (len(head) == HEAD and b"\n" not in head):
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def content_of(root: str, path: str) -> str | None:
    with open(os.path.join(root, path), "rb") as file:
        return readable(file.read(LARGEST + 1))


class Part(InputPartition):
    """Files, and directories with the rules that hold in them, to be read to the bottom."""

    def __init__(self, root: str, paths: list[str], dirs: list[tuple[str, list[Rule]]]):
        self.root, self.paths, self.dirs = root, paths, dirs


class Reader(DataSourceReader):
    """The driver lists the top alone; each directory there is a partition, whose task walks it."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.excludes = [e for e in options.get("exclude", "").split(",") if e]
        self.hidden = str(options.get("includehidden", options.get("includeHidden", "false"))).lower() == "true"

    def partitions(self) -> list[Part]:
        dirs, files = children(self.root, "", [], self.excludes, self.hidden)
        return [Part(self.root, [path for path, _ in files], []), *(Part(self.root, [], [d]) for d in dirs)]

    def read(self, partition: Part) -> Iterator[tuple]:
        below = (path for at, rules in partition.dirs for path in listed(partition.root, at, rules, self.excludes, self.hidden))
        for path in (*partition.paths, *below):
            text = content_of(partition.root, path)
            if text is not None:
                yield path, text


class Repository(DataSource):
    """``spark.read.format("repository").option("exclude", "a/,*.tmp").option("includeHidden", True).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


FOUND = "is_dir boolean, path string, size long, rules array<struct<ignored:boolean,pattern:string>>"


def walk(spark: SparkSession, path: str, exclude: list[str] = (), include_hidden: bool = False) -> DataFrame:
    """(rel_path, size) of the files of a tree that every worker can open.

    The tree is listed by rounds, one for each level: the directories of a level are rows, which tasks list, and ignore rules travel
    down with them.  Every round is stored in the shared folder; no list comes to the driver.
    """
    excludes, root = list(exclude), path

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("is_dir", pa.bool_()), ("path", pa.string()), ("size", pa.int64()), ("rules", pa.list_(pa.struct([("ignored", pa.bool_()), ("pattern", pa.string())])))])
        for batch in batches:
            for row in batch.to_pylist():
                dirs, files = children(root, row["path"], [(r["ignored"], r["pattern"]) for r in row["rules"]], excludes, include_hidden)
                found = [(True, at, None, [{"ignored": i, "pattern": p} for i, p in rules]) for at, rules in dirs] + [(False, at, size, None) for at, size in files]
                for start in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[start : start + 10_000], strict=True), schema, strict=True)], schema=schema)

    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(True, "", None, [])], FOUND)
    files = level.limit(0).select(F.col("path").alias("rel_path"), "size")
    while not level.isEmpty():
        found = cut(level.select("path", "rules").repartition(parts, "path").mapInArrow(look, FOUND))
        files = files.union(found.filter("not is_dir").select("path", "size"))
        level = found.filter("is_dir")
    return files


def read_repository(spark: SparkSession, path: str, exclude: list[str] = (), include_hidden: bool = False) -> DataFrame:
    """(rel_path, content) of a tree that every worker can open; tasks read about PART bytes each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for start in range(0, len(paths), 64):
                texts = [content_of(path, p) for p in paths[start : start + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(paths[start : start + 64], pa.string()), pa.array(texts, pa.string())], ["rel_path", "content"])

    files = walk(spark, path, exclude, include_hidden)
    size = files.agg(F.sum(F.col("size") + 4096)).first()[0] or 0
    dealt = files.select("rel_path").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART)), "rel_path")
    return dealt.mapInArrow(read, SCHEMA).filter("content is not null")


def guarded(files: DataFrame, data: str = "content", path: str = "rel_path") -> DataFrame:
    """(rel_path, content) of (path, bytes) rows, for trees in any store that Spark reads."""
    head = F.substring(F.col(data), 1, HEAD)
    text = F.decode(head, "ISO-8859-1")
    sound = (F.length(data) <= LARGEST) & ~F.contains(text, F.lit("\0")) & ~((F.length(head) == HEAD) & ~F.contains(text, F.lit("\n")))
    kept = files.filter(~F.col(path).rlike(EXCLUDED_PATH)).filter(sound)
    return kept.select(F.col(path).alias("rel_path"), F.try_validate_utf8(F.col(data).cast("string")).alias("content")).filter("content is not null")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A tree in a store that Spark reads; names that begin with a dot or an underscore aren't seen there."""
    root = path.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    tail = F.regexp_replace(F.replace("path", F.lit(root.split(":", 1)[-1].lstrip("/")), F.lit("\u0001")), "^.*\u0001", "")
    return guarded(raw.select(tail.alias("rel_path"), "content"))
