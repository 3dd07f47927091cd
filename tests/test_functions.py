"""Single functions on the cases that their contracts name."""

import random
import re

import pytest
from pyspark.sql import functions as F

from topolake.functions import strings as S
from topolake.operators import functions_of, lines as L, refine, routes
from topolake.operators.lines import without_comments


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (S.normal_path, "/api/:id/{x}/*/end", "/api/{param}/{param}/{*}/end"),
        (S.normal_path, "/static", "/static"),
        (S.url_host, "postgres://u:p@db_1:5432/x", "db_1"),
        (S.url_host, "https://{server}/v2", None),
        (S.url_host, "plain text", None),
        (S.url_host, "", None),
        (S.url_protocol, "rediss://cache", "redis"),
        (S.url_protocol, "mongodb+srv://m/x", "mongodb"),
        (S.url_port, "http://h:8080/x", 8080),
        (S.url_port, "http://h/x", None),
        (S.kafka_host, " k1:9092,k2", "k1"),
        (S.kafka_host, "", None),
        (S.first_string, "f(it's, \"x\")", "x"),
        (S.first_string, "f('')", ""),
        (S.first_string, "none", None),
        (S.second_string, "f('a', \"b\")", "b"),
        (S.requirement_name, "a<2,>1", "a<2,"),
        (S.requirement_name, "b[x]==1", "b[x]"),
        (S.normal_template, "`/a/${x.y}/${f({})}`", "/a/{param}/{param}"),
        (S.normal_template, 'f"/a/{id}/%d"', "/a/{param}/{param}"),
        (S.caps_argument, "connect(&DB_URL)", "DB_URL"),
        (S.caps_argument, "connect(url)", None),
        (S.process_env_var, "x = process.env.API_URL;", "API_URL"),
        (S.nullish_default, "a ?? `d`", "d"),
        (S.is_tool_library, "google.golang.org/grpc", True),
        (S.is_tool_library, "httpx", False),
        (S.key_protocol, "MY_PG_HOST", "postgresql"),
    ],
)
def test_function(spark, function, value, want):
    assert one(spark, function, value) == want


def test_jdbc(spark):
    assert one(spark, lambda c: S.jdbc_target(c)[1], "jdbc:mysql://h:3306/x") == "h"
    assert one(spark, lambda c: S.jdbc_target(c)[0], "jdbc:mysql://h:3306/x") == "mysql"
    assert one(spark, lambda c: S.jdbc_target(c)[1], "mysql://h") is None


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/*.py", "a.py", True), ("**/*.py", "a/b.py", True), ("*.py", "a/b.py", True), ("a?c", "abc", True), ("**/.env.*", "x/.env.local", True), ("**/Dockerfile", "aDockerfile", False)])
def test_globs(spark, glob, path, fits):
    assert one(spark, lambda c: S.matches_globs(c, [glob]), path) is fits


def test_env_lines(spark):
    key = lambda c: S.env_line(c)[0]
    value = lambda c: S.env_line(c)[1]
    assert (one(spark, key, "export A='b c'"), one(spark, value, "export A='b c'")) == ("A", "b c")
    assert one(spark, key, "# A=1") is None
    assert one(spark, key, "=x") is None


@pytest.mark.parametrize(("text", "want"), [("", []), ("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, text, want):
    assert one(spark, L.split_lines, text) == want


def fold(lines):
    """Plain transcription of the docstring rule, to hold the windows against."""
    inside, out = False, []
    for line in lines:
        n = line.count('"""') or line.count("'''")
        out.append(inside or n > 0)
        inside = (n % 2 == 0) if inside and n else inside if inside else n == 1
    return out


def test_docstrings(spark):
    import random

    rng = random.Random(1)
    files = [["x" + rng.choice(['"""', "'''", ""]) * rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, n, line) for i, f in enumerate(files) for n, line in enumerate(f)], "rel_path int, line_no int, line string")
    got = L.with_docstrings(df, "rel_path").orderBy("rel_path", "line_no").collect()
    assert [r["in_doc"] for r in got] == [x for f in files for x in fold(f)]


SOURCES = {
    "a.py": ('x = "#a"  # app.get("/no")\n"""\n@app.get("/no")\n"""\ny = 1\n', 'x = "#a"  \n\ny = 1\n'),
    "a.ts": ('// app.get("/no")\napp.get("http://x/*y*/");/* app.get("/no")\n */ f(`a//b`, \'it\\\'s //\')', '\napp.get("http://x/*y*/"); f(`a//b`, \'it\\\'s //\')'),
    "a.go": ('/* r.GET("/no", x) */r.GET("/yes", x) // r.GET("/no", x)', 'r.GET("/yes", x) '),
    "a.rs": ('#[get("/yes")] // #[get("/no")]\nlet c: &\'a str = \'"\'; // no', '#[get("/yes")] \nlet c: &\'a str = \'"\'; '),
    "a.rb": ("# get '/no'\nget '/yes#x' # no", "\nget '/yes#x' "),
    "a.txt": ("# stays", "# stays"),
}


def test_comments_are_blanked(spark):
    df = spark.createDataFrame([(p, t) for p, (t, _) in SOURCES.items()], "path string, content string")
    got = {r["path"]: r["c"] for r in df.select("path", without_comments(F.col("content"), F.col("path")).alias("c")).collect()}
    assert got == {p: want for p, (_, want) in SOURCES.items()}
    long = spark.createDataFrame([("a.ts", '"' + "\\n" * 50_000 + '"' + "x" * 50_000 + "/*" + "y" * 100_000)], "path string, content string")
    assert long.select(F.length(without_comments(F.col("content"), F.col("path")))).first()[0] == 250_004


def test_routes_in_comments_are_none(spark):
    express = "\n".join(["// app.get('/no', f)", "/* router.post('/no', f)", "*/", "app.get('/yes', f)"])
    python = '"""\n@app.get("/no")\ndef no(): pass\n"""\n# @app.get("/no")\n@app.get("/yes")\ndef yes(): pass\n'
    go = '// r.GET("/no", f)\nr.GET("/yes", f)\n'
    rows = [("s/a.ts", "s", express), ("package.json", None, '{"dependencies": {"express": "1", "gin": 1}}'), ("s/a.py", "s", python), ("requirements.txt", None, "fastapi"), ("s/a.go", "s", go), ("go.mod", None, "github.com/gin-gonic/gin v1")]
    found = routes.routes(spark.createDataFrame(rows, "rel_path string, service string, content string")).select("rel_path", "path", "extraction_method").collect()
    assert sorted(tuple(r)[:2] for r in found) == [("s/a.go", "/yes"), ("s/a.py", "/yes"), ("s/a.ts", "/yes")]


def plain_bodies(lines, head):
    found = []
    for i, line in enumerate(lines):
        at = re.search(head, line)
        name = at and next(g for g in at.groups() if g)
        if not at or name in functions_of.NOT_NAMES:
            continue
        depth, opened = 0, False
        for end in range(i, len(lines)):
            depth += lines[end].count("{") - lines[end].count("}")
            opened = opened or "{" in lines[end]
            if opened and depth <= 0:
                found.append((name, "\n".join(lines[i : end + 1])))
                break
    return found


def test_bodies_in_one_pass():
    rng = random.Random(1)
    kinds = ["function a() {", "function b()", "{", "}", "  x({ y: 1 })", "}}", "const f = (x) =>", "if (x) {", "let g = () => { return 1 }", ""]
    for _ in range(300):
        lines = [rng.choice(kinds) for _ in range(rng.randrange(0, 25))]
        want = [(n, b) for n, b in plain_bodies(lines, functions_of.HEADS["typescript"])]
        got = functions_of._braced(lines, functions_of.HEADS["typescript"])
        assert got == want
    many = ["def a"] * 50_000
    assert functions_of._braced(many, functions_of.HEADS["ruby"]) == []
    assert [n for n, _ in functions_of._indented(["def a():", "  def b():", "    x", "", "  y", "z", "async def c(): pass"])] == ["a", "b", "c"]


def test_refinement_that_fails_changes_nothing(spark):
    rows = [("rest", "dep", "code", "high")]
    connections = spark.createDataFrame(rows, "protocol string, dependency string, evidence string, confidence string")

    def at_once(df, text):
        raise RuntimeError("no model")

    def in_a_task(df, text):
        return df.withColumn("embedding", F.array(F.raise_error(F.lit("no model")).cast("float")))

    for embed in (None, at_once, in_a_task):
        assert [tuple(r) for r in refine.refine_with(connections, embed, [1.0], [0.0]).collect()] == rows
    found = refine.refine_with(connections, lambda df, text: df.withColumn("embedding", F.array(F.lit(1.0))), [1.0], [-1.0]).first()
    assert found["ml_confidence"] is not None
