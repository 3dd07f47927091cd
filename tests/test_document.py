"""The document in parts, and the walk of a tree, against plain versions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from topolake.__main__ import main
from topolake.operators import relations
from topolake.plans.derived import derive
from topolake.sources import document, repository

DIR = "/root/testdata/sf0.001"


def sizes(value):
    return {k: len(v) for k, v in value.items() if isinstance(v, list)}


@pytest.mark.parametrize("parts", [1, 7])
def test_parts_join_to_the_document(spark, tmp_path, parts):
    services = relations.merge_services(derive(spark, DIR, "services"))
    endpoints, connections, schemas = (derive(spark, DIR, n) for n in ("endpoints", "connections", "schemas"))
    endpoints = endpoints.withColumn("service_name", F.when(F.col("seq") % 3 > 0, "svc1").otherwise(F.col("service_name")))  # a hot service
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        document.write_parts(document.lines(services, endpoints, connections.limit(500), schemas), f"{tmp_path}/parts", {"tool": "cli", "note": 'a "b"'})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = json.loads("".join(document.texts(f"{tmp_path}/parts")))
    assert json.loads(open(document.join(f"{tmp_path}/parts", f"{tmp_path}/whole.json")).read()) == got
    whole = relations.payload(relations.exposed(services, endpoints), connections.limit(500), schemas, {"tool": "cli", "note": 'a "b"'}).first().asDict(recursive=True)
    assert got["version"] == "1.0" and got["metadata"] == whole["metadata"] and sizes(got) == sizes(whole)
    for own in whole["services"]:
        own["exposes"] = [{k: v for k, v in e.items() if k != "seq"} for e in own["exposes"]]
    key = lambda s: (s["root_path"], s["name"], json.dumps(s, sort_keys=True))
    assert sorted(got["services"], key=key) == sorted(whole["services"], key=key) and [s["root_path"] for s in got["services"]] == [s["root_path"] for s in whole["services"]]
    for section in ("connections", "schemas"):  # numbers of discovery repeat in this table
        assert sorted(map(json.dumps, got[section])) == sorted(map(json.dumps, whole[section]))
    named = {p["file"] for own in json.loads(open(f"{tmp_path}/parts/manifest.json").read())["sections"].values() for p in own}
    assert named == {f for f in os.listdir(f"{tmp_path}/parts") if f.endswith(".part")} and (parts == 1 or len(named) > 3)
    assert document.read_section(spark, f"{tmp_path}/parts", "schemas").count() == len(whole["schemas"])


def test_empty_document(spark, tmp_path):
    none = [derive(spark, DIR, n).limit(0) for n in ("services", "endpoints", "connections", "schemas")]
    document.write_parts(document.lines(*none), f"{tmp_path}/parts", {})
    assert json.loads("".join(document.texts(f"{tmp_path}/parts"))) == {"version": "1.0", "metadata": {}, "services": [], "connections": [], "schemas": [], "actors": []}
    assert document.read_section(spark, f"{tmp_path}/parts", "services").count() == 0


def test_failed_attempts_are_in_no_manifest(tmp_path):
    writer = document.PartWriter({"path": str(tmp_path)})
    (tmp_path / "services-000000-lost.part").write_text("x")
    writer.commit([document.Written(1, [("schemas", "b", 2, 0, 0)]), None, document.Written(0, [("schemas", "a", 1, 0, 0)])])
    sections = json.loads((tmp_path / "manifest.json").read_text())["sections"]
    assert [(p["file"], p["between"]) for p in sections["schemas"]] == [("a", ""), ("b", ",")] and sections["services"] == []
    (tmp_path / "c").write_text("x")
    writer.abort([document.Written(0, [("schemas", "c", 1, 0, 0)]), None])
    assert not (tmp_path / "c").exists()


def test_walk_leaves_out_what_is_ignored_above(spark, tmp_path):
    files = {
        "a/.gitignore": "logs/\n*.tmp\n!keep.tmp\n", "a/logs/x.py": "", "a/b/logs/keep.tmp": "", "a/b/keep.tmp": "x", "a/b/c.tmp": "", "a/b/c/.gitignore": "!c.tmp\nd.py\n", "a/b/c/c.tmp": "y", "a/b/c/d.py": "", "d.py": "z", "a/e.py": "",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "empty").mkdir()
    want = {"a/b/keep.tmp", "a/b/c/c.tmp", "d.py"}
    assert {r["rel_path"] for r in repository.walk(spark, str(tmp_path), ["a/e.py"]).collect()} == want
    assert {r["rel_path"]: r["content"] for r in repository.read_repository(spark, str(tmp_path), ["a/e.py"]).collect()} == {p: files[p] for p in want}
    spark.dataSource.register(repository.Repository)
    assert {r["rel_path"] for r in spark.read.format("repository").option("exclude", "a/e.py").load(str(tmp_path)).collect()} == want
    assert {r["rel_path"] for r in repository.walk(spark, str(tmp_path), ["*.tmp"]).collect()} == {"a/e.py", "d.py"}
    assert repository.read_repository(spark, str(tmp_path / "empty")).count() == 0


def test_command_line_writes_the_document(spark, tmp_path, capsys):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop/Dockerfile").write_text("FROM python\n")
    (tmp_path / "shop/requirements.txt").write_text("fastapi\n")
    (tmp_path / "shop/app.py").write_text('@app.get(\n  "/x"\n)\ndef one():\n    pass\n')
    assert main([str(tmp_path), "--output", str(tmp_path / "out.json"), "--log", str(tmp_path / "log")]) == 0
    got = json.loads((tmp_path / "out.json").read_text())
    assert [(s["name"], [e["path"] for e in s["exposes"]]) for s in got["services"]] == [("shop", ["/x"])] and got["metadata"]["files_scanned"] == 3
    logged = json.loads((tmp_path / "log").read_text())
    assert (logged["files"], logged["bytes"], logged["lines"]) == (3, 64, {"services": 3, "connections": 0, "schemas": 0})
    assert main([str(tmp_path), "--dry-run", "--exclude", "out.json", "--exclude", "/log"]) == 0
    assert json.loads(capsys.readouterr().out)["services"] == got["services"]
