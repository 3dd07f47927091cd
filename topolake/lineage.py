"""Cutting lineage by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one of a local master."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not current.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='topolake-')}")
        current = sc._jsc.sc().getCheckpointDir()
    return (named or current.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder.

    What follows plans from the stored rows, so several uses cost neither its computation nor its plan again,
    and a lost executor doesn't either.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
