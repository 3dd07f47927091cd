"""The scan document written by the executors: range-sorted parts of one JSON text, joined by a manifest.

Every row of a section is a line.  A service's endpoints stand between the line that opens it and the one that closes it, so that no relation and
no service's endpoints are gathered in a row.  A task writes a file for each section it has rows of and reports it in its commit message with the
kinds of its first and last line; the driver writes those reports down as the manifest, with what must stand between parts.  Files of failed or repeated attempts
have names of their own and are in no manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from topolake.shipping import ship

SECTIONS = ("services", "connections", "schemas")
#: Kinds of lines: a value of its own, one that opens, one within and one that closes.
WHOLE, OPEN, WITHIN, CLOSE = 0, 1, 2, 3
MANIFEST = "manifest.json"
#: Characters that are copied at a time.
CHUNK = 1 << 20


def between(before: int | None, after: int) -> str:
    """What separates two lines of a section."""
    return "," if before in (WHOLE, CLOSE, WITHIN) and after != CLOSE else ""


@dataclass
class Written(WriterCommitMessage):
    partition: int
    #: (section, file, lines, kind of the first line, kind of the last)
    files: list[tuple[str, str, int, int, int]]


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.head = options["path"], options.get("head", "{}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Lines (section, kind, text) of a task, in order."""
        os.makedirs(self.folder, exist_ok=True)
        partition, out, at, file = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            for section, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if section != at:
                    if file:
                        file.close()
                    name = f"{section}-{partition:06d}-{uuid.uuid4().hex}.part"
                    file, at = open(os.path.join(self.folder, name), "w", encoding="utf-8"), section  # noqa: SIM115
                    out.append([section, name, 0, kind, None])
                last = out[-1]
                file.write(("" if last[4] is None else between(last[4], kind) + "\n") + text)
                last[2], last[4] = last[2] + 1, kind
        if file:
            file.close()
        return Written(partition, [tuple(x) for x in out])

    def commit(self, messages: list[Written | None]) -> None:
        parts: dict[str, list[dict]] = {s: [] for s in SECTIONS}
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for section, name, lines, first, last in message.files:
                before = parts[section][-1]["last"] if parts[section] else None
                parts[section].append({"file": name, "lines": lines, "between": between(before, first), "last": last})
        Path(self.folder, MANIFEST).write_text(json.dumps({"head": json.loads(self.head), "sections": parts}))

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for _, name, *_ in message.files if message else ():
                Path(self.folder, name).unlink(missing_ok=True)


class DocumentParts(DataSource):
    """``lines.write.format("scan_document").option("head", json).mode("append").save(folder)``; a folder that every worker can open, new for each document."""

    @classmethod
    def name(cls) -> str:
        return "scan_document"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options)


def _json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def lines(services: DataFrame, endpoints: DataFrame, connections: DataFrame, schemas: DataFrame) -> DataFrame:
    """(section, kind, text) with the columns that order them: services with their endpoints by place and name, the others by discovery.

    Of services of one name the first has the endpoints, as in ``relations.exposed``.
    """
    service = F.struct("name", "root_path", "language", F.col("service_type").alias("type"), "boundary_entry", "confidence", "extraction_method")
    link = F.struct(F.col("source_service").alias("source"), F.col("target_name").alias("target"), *[c for c in ("protocol", "method", "path", "source_file", "confidence", "extraction_method", "dependency", "evidence") if c in connections.columns])
    order = lambda place="", name="", seq="": [F.lit(x).alias(c) if isinstance(x, str) else x.alias(c) for c, x in (("place", place), ("name", name), ("owner", seq))]
    at = [F.coalesce("root_path", F.lit("")), F.coalesce("name", F.lit("")), F.col("seq").cast("string")]
    line = lambda section, kind, text: [F.lit(SECTIONS.index(section)).alias("number"), F.lit(section).alias("section"), F.lit(kind).alias("kind"), text.alias("text")]
    none = F.lit(None).cast(endpoints.schema["seq"].dataType).alias("seq")
    opened = services.select(*line("services", OPEN, F.concat(F.regexp_replace(_json(service), r"\}$", ""), F.lit(',"exposes":['))), *order(*at), none)
    closed = services.select(*line("services", CLOSE, F.lit("]}")), *order(*at), none)
    first = services.groupBy(F.col("name").alias("service_name")).agg(F.min_by(F.struct(*[c.alias(n) for c, n in zip(at, ("place", "name", "owner"), strict=True)]), "seq").alias("first"))
    row = F.struct(*[c for c in endpoints.columns if c not in ("seq", "service_name")])
    within = endpoints.join(first, "service_name").select(*line("services", WITHIN, _json(row)), *[F.col(f"first.{c}").alias(c) for c in ("place", "name", "owner")], "seq")
    links = connections.select(*line("connections", WHOLE, _json(link)), *order(), F.col("seq"))
    shapes = schemas.select(*line("schemas", WHOLE, _json(F.struct(*[c for c in schemas.columns if c != "seq"]))), *order(), F.col("seq"))
    return opened.union(within).union(closed).union(links).union(shapes)


def write_parts(found: DataFrame, folder: str, metadata: dict[str, object]) -> None:
    """Lines in the order of the document, by ranges: no task has more than its share, whatever one service exposes."""
    spark = ship(found.sparkSession)
    spark.dataSource.register(DocumentParts)
    by = ["number", "place", "name", "owner", "kind", "seq"]
    dealt = found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    dealt.select("section", "kind", "text").write.format("scan_document").option("head", json.dumps({"version": "1.0", "metadata": metadata})).mode("append").save(folder)


def texts(folder: str) -> Iterator[str]:
    """The document in pieces, as its manifest joins them."""
    manifest = json.loads(Path(folder, MANIFEST).read_text())
    yield json.dumps(manifest["head"])[:-1]
    for section in SECTIONS:
        yield f',\n"{section}":['
        for part in manifest["sections"][section]:
            yield part["between"] + "\n"
            with open(os.path.join(folder, part["file"]), encoding="utf-8") as file:
                while piece := file.read(CHUNK):
                    yield piece
        yield "]"
    yield ',\n"actors":[]}\n'


def counts(folder: str) -> dict[str, int]:
    """Lines of each section, from the manifest alone."""
    sections = json.loads(Path(folder, MANIFEST).read_text())["sections"]
    return {name: sum(part["lines"] for part in own) for name, own in sections.items()}


def join(folder: str, target: str) -> str:
    """The document as one file, copied a piece at a time."""
    with open(target, "w", encoding="utf-8") as file:
        for piece in texts(folder):
            file.write(piece)
    return target


def read_section(spark: SparkSession, folder: str, section: str) -> DataFrame:
    """The lines (text) of a section's parts that the manifest names, without what separates them."""
    manifest = json.loads(Path(folder, MANIFEST).read_text())
    paths = [os.path.join(folder, part["file"]) for part in manifest["sections"][section]]
    if not paths:
        return spark.createDataFrame([], "text string")
    return spark.read.text(paths).select(F.regexp_replace("value", ",$", "").alias("text"))
