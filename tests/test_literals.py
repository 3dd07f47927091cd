"""The index of literals, and what is built on it, against plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from topolake.functions import strings as S
from topolake.operators import globs, literals, rules as rule_ops, wrappers


def test_hits_equal_a_plain_search(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["ab", "a", "b_", "1", ".", "(", "->", " ", "é", "send"]) for _ in range(rng.randrange(n)))
    lines = [(i, rng.choice(["x", "y"]), text(14)) for i in range(300)]
    wanted = sorted({(rng.choice(["x", "y"]), text(5)) for _ in range(250)} | {("x", ""), ("y", "send"), ("y", "->"), ("x", "ab.a("), ("x", "nowhere")})
    rows = spark.createDataFrame(lines, "n int, language string, line string")
    got = literals.hits(rows, spark.createDataFrame(wanted * 2, "language string, literal string"), ["language"])
    assert sorted((r["n"], r["literal"]) for r in got.collect()) == sorted((n, w) for n, lang, line in lines for own, w in wanted if own == lang and w in line)
    assert got.columns == ["language", "n", "line", "literal"]
    none = spark.createDataFrame([], "language string, literal string")
    assert literals.hits(rows, none, ["language"]).count() == 0 and literals.hits(rows.limit(0), none, ["language"]).count() == 0


def test_few_literals_and_words_that_many_lines_have(spark, monkeypatch):
    rng = random.Random(4)
    lines = [(i, "x", " ".join(rng.choice(["send", "resend", "a.send(", f"call{rng.randrange(300)}(", "::"]) for _ in range(6))) for i in range(400)]
    wanted = ["send", "send(", ".send(", "::", ""] + [f"call{i}(" for i in range(60)]
    rows = spark.createDataFrame(lines, "n int, language string, line string")
    want = sorted((n, w) for n, _, line in lines for w in wanted if w in line)
    for few in (0, 1000):
        monkeypatch.setattr(literals, "FEW", few)
        got = literals.hits(rows, spark.createDataFrame([("x", w) for w in wanted], "language string, literal string"), ["language"])
        assert sorted((r["n"], r["literal"]) for r in got.collect()) == want and got.columns == ["language", "n", "line", "literal"]


def test_a_gate_of_many_rules_is_not_joined_to_all_of_them(spark, monkeypatch):
    made = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, on=None, how=None: made.append((set(self.columns), set(other.columns), on)) or join(self, other, on, how))
    rules = spark.createDataFrame([rule(i, f"call{i}(", ["import lib"]) for i in range(40)], rule_ops.RULE)
    files = spark.createDataFrame([("a.py", "python", "s", "import lib\ncall3(x)"), ("b.py", "python", "s", "call3(x)")], "rel_path string, language string, service string, content string")
    assert [r["source_file"] for r in rule_ops.apply_rules(files, rules).collect()] == ["a.py:2"]
    assert not [on for left, right, on in made if on == ["language", "literal"] and left == {"rel_path", "language", "literal"} and "id" in right]


def test_a_literal_is_filed_once_under_a_rare_piece(spark):
    wanted = [(f"client.call_{i}(",) for i in range(50)] + [("requests.get(",), ("get(",), ("plain",), ("::",)]
    got = {r["literal"]: r["key"] for r in literals.filed(spark.createDataFrame(wanted, "literal string"), []).collect()}
    assert got["client.call_7("] == "wcall_7" and got["requests.get("] in ("wget", "trequests") and got["get("] == "tget"
    assert got["plain"] == "iplai" and got["::"] == "p::" and len(got) == len(wanted)


def test_large_index_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(literals, "MOST_BYTES", 0)
    rows = spark.createDataFrame([("x", "a.b(c)"), ("x", "none")], "language string, line string")
    got = literals.hits(rows, spark.createDataFrame([("x", "a.b("), ("x", "zz")], "language string, literal string"), ["language"])
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("x", "a.b(c)", "a.b(")]


def rule(i, match, gate=None, languages=("python",), globs=None, strategy="none"):
    return (f"r{i}", list(languages), globs, gate, [(match, "rest", "high", strategy)], i)


def test_rules_meet_files_by_language_glob_and_gate(spark):
    files = spark.createDataFrame(
        [
            ("a/x.py", "python", "s", 'import lib\nlib.send("h")\n# lib.send("c")\n"""\nlib.send("d")\n"""\n'),
            ("b/y.py", "python", "s", 'lib.send("h")\r\n'),
            ("c/z.go", "go", None, 'lib.send("h")\nimport (\n  lib\n)'),
            ("d/e.py", "python", "s", ""),
            ("d/f.bin", None, "s", "lib.send("),
        ],
        "rel_path string, language string, service string, content string",
    )
    rules = [
        rule(0, "lib.send("), rule(1, "lib.send(", ["import lib"]), rule(2, "lib.send(", ["nothing", "import lib"]), rule(3, "send(", globs=["b/**"]), rule(4, "b.se", languages=["go", "python"]),
        rule(5, "lib.send(", ["(\n  lib"], ["go"]), rule(6, "nowhere("), rule(7, "", ["h\"", "zz"], ["go"]), rule(8, "lib.send(", [], ["rust"]),
    ]
    got = rule_ops.apply_rules(files, spark.createDataFrame(rules, rule_ops.RULE)).collect()
    hits = {(r["dependency"], r["source_file"]) for r in got}
    ax, by, cz = "a/x.py:2", "b/y.py:1", "c/z.go:1"
    lines = {("r7", f"c/z.go:{n}") for n in (1, 2, 3, 4)}
    assert hits == {("r0", ax), ("r0", by), ("r1", ax), ("r2", ax), ("r3", by), ("r4", ax), ("r4", by), ("r4", cz), ("r5", cz)} | lines and len(got) == len(hits)
    assert {r["confidence"] for r in got} == {"medium"} and {r["source_service"] for r in got} == {"s", ""}
    assert rule_ops.apply_rules(files, spark.createDataFrame([], rule_ops.RULE)).count() == 0


def test_long_call_sites_cost_as_many_ends_as_names_have_lengths(spark):
    names = [("python", f"send{i}", "rest", 1, ["x"], "d") for i in range(30)]
    known = spark.createDataFrame(names, "language string, name string, protocol string, depth int, chain array<string>, dependency string")
    sites = spark.createDataFrame([("python", "A" * 200_000 + "send7"), ("python", "send"), ("go", "send7"), ("python", "xsend29")], "language string, site string")
    began = time.perf_counter()
    found = wrappers.sites_of(sites, known).select(F.length("site").alias("n"), "name").collect()
    assert sorted(tuple(r) for r in found) == [(7, "send29"), (200_005, "send7")] and time.perf_counter() - began < 20
    assert wrappers.sites_of(sites, known.limit(0)).count() == 0


def test_globs_equal_a_plain_search(spark):
    rng = random.Random(5)
    name = lambda: rng.choice(["a", "b.py", "c.test.ts", ".env", "x1.py", "d", "Makefile", "e."])
    paths = sorted({"/".join(name() for _ in range(rng.randrange(1, 5))) for _ in range(200)})
    part = lambda: rng.choice(["**", "*", "a", "b.py", "*.py", "c.*.ts", "*.test.ts", "?", ".*", "x?.py", "d*", "**.py", "e."])
    wanted = sorted({"/".join(part() for _ in range(rng.randrange(1, 4))) for _ in range(150)} | {"**/*.py", "a/**", "*", "nowhere/x"})
    rows = spark.createDataFrame([(p, 1) for p in paths], "rel_path string, n int")
    got = globs.matched(rows, spark.createDataFrame([(w,) for w in wanted * 2], "glob string"), [])
    plain = None
    for w in wanted:
        own = rows.filter(S.matches_globs(F.col("rel_path"), [w])).select("rel_path", F.lit(w).alias("glob"))
        plain = own if plain is None else plain.union(own)
    assert sorted((r["rel_path"], r["glob"]) for r in got.collect()) == sorted(map(tuple, plain.collect()))
    assert got.columns == ["rel_path", "n", "glob"]
    key = {r["glob"]: r["key"][0] for r in globs.filed(spark.createDataFrame([("**/only.py",), ("src/**",), ("**/*.go",), ("*",)], "glob string"), []).collect()}
    assert key == {"**/only.py": "n", "src/**": "d", "**/*.go": "x", "*": "a"}


def test_globs_are_filed_under_ends_and_beginnings_around_wildcards(spark):
    wanted = [f"f?{i}.py" for i in range(30)] + [f"src/**/keep{i}*.tmp" for i in range(30)] + ["*/lib/f*.j?", "x**/y.c"]
    key = {r["glob"]: r["key"] for r in globs.filed(spark.createDataFrame([(w,) for w in wanted], "glob string"), []).collect()}
    assert key["f?7.py"] == "x7.py" and key["src/**/keep7*.tmp"] == "hkeep7" and key["*/lib/f*.j?"] == "clib" and key["x**/y.c"] != "ny.c"
    paths = ["fa7.py", "a/f/7.py", "src/keep7.tmp", "src/a/keep29/b.tmp", "src/akeep7.tmp", "r/lib/fx.js", "r/lib/z.js", "xy.c", "x/a/y.c", "y.c"]
    got = globs.matched(spark.createDataFrame([(p,) for p in paths], "rel_path string"), spark.createDataFrame([(w,) for w in wanted], "glob string"), [])
    assert sorted(map(tuple, got.collect())) == sorted((p, w) for p in paths for w in wanted if re.search(S.glob_regex(w), p)) != []


def test_call_sites_do_not_come_to_the_driver(spark):
    n = F.col("id").cast("string")
    body = F.concat(F.lit("def f(x):\n"), F.when(F.col("id") == 7, "  send(x)").otherwise(F.concat(F.lit("  some_rather_long_name_of_an_other_function_"), n, F.lit("(x)"))))
    functions = spark.range(60_000).select(F.lit("python").alias("language"), F.concat(F.lit("func_"), n).alias("name"), body.alias("body"), F.col("id").alias("file_ord"))
    known = spark.createDataFrame([("python", "send", "rest", 0, ["send"], "d")], "language string, name string, protocol string, depth int, chain array<string>, dependency string")
    conf = spark._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        assert sorted(r["name"] for r in wrappers.trace(functions, known).collect()) == ["func_7", "send"]
    finally:
        conf.remove("spark.driver.maxResultSize")
