"""The repository source with its guards, settings, git metadata and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from topolake.sources import repository, settings, sinks


@pytest.fixture()
def tree(tmp_path):
    files = {
        "app/__init__.py": b"x = 1\n", "app/.env": b"A=1\n", "node_modules/x/i.js": b"x\n", "tests/t.py": b"x\n", "app/big.txt": b"a\n" * 300_000, "app/bin.dat": b"a\0b\n",
        "app/long.js": b"y" * 10_001 + b"\n", "app/short.js": b"y" * 8_000 + b"\n", "app/latin.txt": b"\xff\xfe\n", ".gitignore": b"*.log\n/only/\n!keep.log\n", "a.log": b"x\n", "keep.log": b"x\n",
        "only/x.py": b"x\n", "app/only/x.py": b"x\n", "sub/.gitignore": b"*.tmp\n", "sub/a.tmp": b"x\n", "b.tmp": b"x\n", "app/empty.py": b"",
    }
    for path, data in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "app/link.py").symlink_to(tmp_path / "app/__init__.py")
    return tmp_path


def test_repository(spark, tree):
    got = {r["rel_path"]: r["content"] for r in repository.read_repository(spark, str(tree)).collect()}
    assert set(got) == {"app/__init__.py", "app/short.js", "keep.log", "app/only/x.py", "b.tmp", "app/empty.py"}
    assert got["app/__init__.py"] == "x = 1\n"


def test_repository_options(spark, tree):
    got = {r["rel_path"] for r in repository.read_repository(spark, str(tree), ["app/only/", "*.tmp"], True).collect()}
    assert got == {"app/__init__.py", "app/.env", "app/short.js", "keep.log", "app/empty.py", ".gitignore", "sub/.gitignore"}


def test_store(spark, tree):
    got = {r["rel_path"] for r in repository.read_store(spark, f"file://{tree}").collect()}
    assert {"app/short.js", "a.log", "b.tmp"} <= got and not got & {"app/big.txt", "app/bin.dat", "app/long.js", "app/latin.txt", "node_modules/x/i.js", "tests/t.py"}


def test_git(tmp_path):
    git = tmp_path / "shop/.git"
    (git / "refs/heads").mkdir(parents=True)
    assert settings.git_context(str(tmp_path / "shop"), {"GITHUB_REF_NAME": "ci", "CI_COMMIT_SHA": "abc"}) == {"remote": None, "repo_name": "shop", "branch": "ci", "commit": "abc"}
    (git / "HEAD").write_text("ref: refs/heads/dev\n")
    (git / "refs/heads/dev").write_text("123\n")
    (git / "config").write_text('[remote "up"]\n\turl = https://h/a.git\n[remote "origin"]\n\turl = git@h:o/cat.git\n')
    assert settings.git_context(str(tmp_path / "shop"), {}) == {"remote": "git@h:o/cat.git", "repo_name": "cat", "branch": "dev", "commit": "123"}


def test_settings():
    repo = settings.repository_file('[scanner]\nproject_slug = "p"\nml_refine = true\n[scanner.exclude]\npaths = ["x/"]\n[services."a/b"]\nname = "n"\n')
    got = settings.merged({"root": "r", "project": None}, {"project": "env"}, repo, {"hub": "h"})
    assert (got.root, got.project, got.refine, got.excludes, got.hub, got.overrides) == ("r", "env", True, ["x/"], "h", {"a/b": {"name": "n"}})
    assert settings.repository_file("not [ toml") == {}
    assert settings.only_plugins(" a, b ,") == ["a", "b"] and settings.only_plugins(None) is None


@pytest.mark.parametrize(("answers", "sent", "taken", "saved"), [([202], 1, True, False), ([409], 1, True, False), ([401], 1, False, False), ([429, 500, 202], 3, True, False), ([500] * 4, 4, False, True), ([None] * 4, 4, False, True)])
def test_upload(tmp_path, answers, sent, taken, saved):
    calls, waits = [], []

    def post(url, token, body):
        calls.append(body)
        return answers[len(calls) - 1]

    assert sinks.upload("{}", "http://hub", "t", str(tmp_path), post, waits.append) is taken
    assert len(calls) == sent and waits == [1, 2, 4][: sent - 1] and bool(list(tmp_path.iterdir())) is saved


def test_document_sinks(spark, tmp_path):
    document = spark.range(1).select(F.lit("1.0").alias("version"), F.lit(None).cast("string").alias("none"))
    path = sinks.write_file(document, None, str(tmp_path))
    assert path.endswith(f"{tmp_path.name}.json") and json.loads(open(path).read()) == {"version": "1.0", "none": None}
    sinks.write_relations({"services": document}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/services")).count() == 1


def test_registry(tmp_path):
    from topolake.sources.registry import registry_file

    cache, asked = tmp_path / "c/rules.json", []

    def get(status, tag, body):
        return lambda url, etag: asked.append(etag) or (status, tag, body)

    assert registry_file("u", cache, get(0, None, "")) == ("none", None)
    assert registry_file("u", cache, get(200, "e1", "{}")) == ("remote", cache)
    assert registry_file("u", cache, get(304, None, "")) == ("cache", cache) and asked[-1] == "e1"
    assert registry_file(None, cache) == ("cache", cache)
