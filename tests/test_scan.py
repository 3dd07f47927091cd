"""Documents of a scan, and endpoints of its services."""

import pytest
import yaml
from pyspark.sql import functions as F

from topolake.operators import config_files, literals, relations
from topolake.plans import scan as scans
from topolake.sources import documents


def test_a_scan_parses_each_document_once(spark, monkeypatch):
    asked, structured = [], config_files.structured
    monkeypatch.setattr(config_files, "structured", lambda text: asked.append(1) or structured(text))
    k8s = "apiVersion: v1\nkind: Service\nmetadata: {name: a}\n---\nkind: [\n"
    rows = [("d/compose.yaml", "services:\n  web: {depends_on: [db]}\n"), ("k8s/a.yaml", k8s), ("x/asyncapi.yml", "channels: ["), ("c/application.yml", "spring: {redis: {host: cache}}"), ("n/compose.yml", None)]
    found = scans.scan(spark, spark.createDataFrame(rows, "rel_path string, content string"))
    assert {r.name for r in found["services"].collect()} == {"web", "a"}
    assert {(r.source_service, r.target_name) for r in found["connections"].collect()} == {("web", "db"), ("c", "cache")}
    assert {(r.rel_path, r.extractor) for r in found["faults"].collect()} == {("k8s/a.yaml", "kubernetes"), ("x/asyncapi.yml", "asyncapi")}
    assert len(asked) == 1


def test_yaml_is_read_as_by_the_plain_loader(monkeypatch):
    texts = ["a: 1\nb: [x, {y: 2020-01-01}]\n", "k: &a {z: !!int '3'}\nl: {<<: *a, m: ~}\n", "yes: no\n010: 1e3\n", "a:\n\t- b", "é: \"\\u00e9\\n\"\n", "", "- - - a\n  - ? b\n    : c\n", "a: [", "!x 1", "[" * 5000]
    read = lambda load, t: documents._json(load, t)
    fast = [read(documents.load_yaml, t) for t in texts]
    assert fast == [read(yaml.safe_load, t) for t in texts]
    monkeypatch.setattr(yaml, "safe_load", lambda t: pytest.fail("the plain loader"))
    assert documents.load_yaml(texts[0])["a"] == 1


def test_endpoints_are_counted_as_exposed(spark):
    services = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3)], "name string, root_path string, seq long")
    endpoints = spark.createDataFrame([("a", "/1", 1), ("a", "/1", 2), ("c", "/2", 3)], "service_name string, path string, seq long")
    counts = {(r.root_path, r.n) for r in relations.exposed_counts(services, endpoints).collect()}
    assert counts == {(r.root_path, len(r.exposes)) for r in relations.exposed(services, endpoints).collect()} == {("x", 0), ("y", 2), ("z", 0)}


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_joins_of_a_scan_are_not_left_to_estimates(spark, monkeypatch):
    """Rows made from a few columns count as a few bytes, however many they are; tables over MOST_BYTES are never broadcast."""
    monkeypatch.setattr(literals, "MOST_BYTES", 0)
    each = spark.range(3).select(F.concat(F.lit("c"), "id").alias("root"))
    files = each.select("root", F.explode(F.array(F.lit("a/x.py"), F.lit("a/b/y.py"), F.lit("z.py"))).alias("path")).select(F.concat_ws("/", "root", "path").alias("rel_path")).unionByName(spark.createDataFrame([("top.py",)], "rel_path string"))
    services = each.select(F.concat("root", F.lit("/a")).alias("root_path"), F.lit("a").alias("name"), F.monotonically_increasing_id().alias("seq"))
    top = spark.createDataFrame([("", "top", 9)], "root_path string, name string, seq long")
    for own, other in ((services, None), (services.unionByName(top), "top")):
        placed = relations.scope(files, own)
        assert _broadcasts(placed) == 0
        assert {r["rel_path"]: r["service"] for r in placed.collect()} == {"top.py": other, **{f"c{i}/{p}": s for i in range(3) for p, s in (("a/x.py", "a"), ("a/b/y.py", "a"), ("z.py", other))}}

    proto = each.select(F.concat("root", F.lit("/m.proto")).alias("rel_path"), F.lit("message Req {\n  string id = 1;\n}\n").alias("content"))
    schemas = config_files.proto(proto)["schemas"]
    assert _broadcasts(schemas) == 0 and [len(r["fields"]) for r in schemas.collect()] == [1, 1, 1]

    link = each.select(F.concat("root", F.lit("/x.py:1")).alias("source_file"), F.lit("rest").alias("protocol"), F.lit("t").alias("target_name"), F.lit("get").alias("method"), F.concat(F.lit("/"), "root").alias("path"), F.explode(F.array(F.lit("pattern:p"), F.lit("wrapper_trace:w"))).alias("extraction_method"), F.lit(1).cast("long").alias("seq"))
    link = link.unionByName(link.withColumns({"method": F.lit(None).cast("string"), "source_file": F.lit("q.py:1")}).filter("extraction_method = 'pattern:p'"))
    endpoints = each.select(F.lit("s").alias("service_name"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "root").alias("path"), F.explode(F.array(F.lit("ast"), F.lit("spec:openapi"))).alias("extraction_method"), F.lit(1).cast("long").alias("seq"))
    left = relations.drop_covered_wrappers(link)
    assert _broadcasts(left) == 0 and left.count() == 6
    specified = relations.drop_specified_endpoints(endpoints)
    assert _broadcasts(specified) == 0 and {r["extraction_method"] for r in specified.collect()} == {"spec:openapi"}
    answered = relations.resolve_targets(left, endpoints)
    assert _broadcasts(answered) == 0 and sorted((r["method"] or "", r["target_name"]) for r in answered.collect()) == [("", "t")] * 3 + [("get", "s")] * 3
    counted = relations.exposed_counts(services.withColumn("name", F.lit("s")), endpoints)
    assert _broadcasts(counted) == 0 and sorted(r["n"] for r in counted.collect())[-1] == 6
