"""From raw documents to packed training sequences.

Each stage reads what the one before it kept, as a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.llm import minhash, mixing, packing, quality, secret_scan
from topolake.llm.queries import tokenizer_path
from topolake.llm.store import Workspace
from topolake.shipping import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a quality score of 0.5 or more."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of near duplicates (five words, 0.8) the one with the smallest id."""
    ship(spark)
    return minhash.one_of_each(docs, width=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: secrets give way to a mark; every document stays."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all sources in equal shares, as many documents as before; rows that share an id draw apart."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", good), ("near_duplicates", single), ("secrets", clean), ("mixing", mixed), ("packing", packed)]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
