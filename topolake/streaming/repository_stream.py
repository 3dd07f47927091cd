"""Files that arrive in a folder, scanned as they come.

The stream carries (rel_path, content) rows as JSON files; routes of each micro-batch are merged by the
caller's sink.  Gates look at a batch's own manifests, so a repository's files should arrive together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from topolake.plans.scan import scan

SCHEMA = "rel_path string, content string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def scan_stream(files: DataFrame, checkpoint: str, write: Callable[[dict[str, DataFrame], int], None], rules: DataFrame | None = None) -> StreamingQuery:
    """write(relations, batch number) for every micro-batch; with an idempotent sink each counts once."""

    def batch(df: DataFrame, number: int) -> None:
        write(scan(df.sparkSession, df, rules), number)

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
