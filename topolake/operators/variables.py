"""Layered settings and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topolake.functions import strings as S
from topolake.operators.lines import lines_of
from topolake.sources.documents import entries, structured, text_at


def layered(settings: DataFrame) -> DataFrame:
    """(key, value, layer) of settings (layer, prio, seq, key, value): the lowest layer wins, within it the last read."""
    best = settings.groupBy("key").agg(F.max_by(F.struct("value", "layer"), F.struct(-F.col("layer"), F.col("prio"), F.col("seq"))).alias("v"))
    return best.select("key", "v.value", "v.layer")


def content_hash(files: DataFrame, group: str) -> DataFrame:
    """(group, sha): SHA-256 over ``path:size`` lines in path order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "size"))), lambda f: F.concat(f.path, F.lit(":"), f["size"].cast("string"), F.lit("\n")))
    return files.groupBy(group).agg(F.sha2(F.array_join(lines, ""), 256).alias("sha"))


def settings_of(files: DataFrame) -> DataFrame:
    """settings (layer, prio, seq, key, value, rel_path) of files (rel_path, content).

    Layer 0: .env files by priority of their names; 1: environments in compose files; 2: data of
    ConfigMaps below k8s, kubernetes or manifests, where all values are text.
    """
    path = F.col("rel_path")
    name = F.element_at(F.split(path, "/"), -1)
    key, value = S.env_line(F.col("line"))
    env = lines_of(files.filter(name.startswith(".env"))).select(F.lit(0).alias("layer"), S.env_file_priority(name).alias("prio"), F.col("line_no").cast("long").alias("seq"), key.alias("key"), value.alias("value"), "rel_path")
    docs = files.filter(name.contains("compose") & name.rlike(r"\.ya?ml$")).select("rel_path", structured(F.col("content")).alias("doc"))
    services = docs.select("rel_path", F.explode(entries(F.col("doc"), "$.services")).alias("e"))
    listed = F.transform(F.coalesce(F.try_variant_get("e.value", "$.environment", "array<string>"), F.array().cast("array<string>")), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), S.after(p, "=").alias("value")))
    mapped = F.transform(F.filter(entries(F.col("e.value"), "$.environment"), lambda e: F.schema_of_variant(e.value) == "STRING"), lambda e: F.struct(e.key.alias("key"), e.value.cast("string").alias("value")))
    compose = services.select("rel_path", F.explode(F.concat(listed, mapped)).alias("p")).select(F.lit(1).alias("layer"), F.lit(0).alias("prio"), F.lit(0).cast("long").alias("seq"), "p.key", "p.value", "rel_path")
    parts = files.filter(path.rlike(r"(^|/)(k8s|kubernetes|manifests)/") & name.rlike(r"\.ya?ml$")).select("rel_path", F.posexplode(F.split("content", "\n---")).alias("n", "part")).select("rel_path", "n", structured(F.col("part")).alias("doc"))
    maps = parts.filter(text_at(F.col("doc"), "$.kind") == "ConfigMap").withColumn("data", entries(F.col("doc"), "$.data")).filter(F.forall("data", lambda e: F.schema_of_variant(e.value) == "STRING"))
    config = maps.select("rel_path", "n", F.explode("data").alias("e")).select(F.lit(2).alias("layer"), F.lit(0).alias("prio"), F.col("n").cast("long").alias("seq"), "e.key", F.col("e.value").cast("string").alias("value"), "rel_path")
    return env.filter("key is not null").unionByName(compose).unionByName(config).filter("value is not null")


def resolve(settings: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, host, port) of keys (key) that a layer sets."""
    found = keys.join(layered(settings), "key")
    return found.select("key", "value", S.url_host(F.col("value")).alias("host"), S.url_port(F.col("value")).alias("port"))
