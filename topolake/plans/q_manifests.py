"""Queries over manifests, lock files, libraries and rule registries, written from the parts: some forty in a repository, more repositories in a larger table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.operators import libraries, manifests as M, rules as rule_ops
from topolake.plans import scan as scans
from topolake.plans.q_rules import part_rules
from topolake.plans.registry import query, table

#: Parts with their number and repository, for DuckDB.
PARTS = "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, 'r' || (p_partkey - p_partkey % 40) AS repo FROM part)"
#: Of each manifest its name, what stands before, between and behind the lines of parts, a part's line, and the dependency with its condition in DuckDB's SQL.
MANIFESTS = {
    "python": ("requirements.txt", "# own\n", "\n", "\n", "CASE k % 4 WHEN 0 THEN 'lib_' || k || '>=1,<2' WHEN 1 THEN 'Lib-' || k || '[extra]' WHEN 2 THEN '# lib_' || k ELSE '-r lib_' || k END", "CASE k % 4 WHEN 0 THEN 'lib_' ELSE 'Lib-' END || k", "k % 4 < 2"),
    "node": ("package.json", '{"dependencies": {', ", ", '}, "devDependencies": {"jest": "1"}}', "'\"@own/lib_' || k || '\": \"^1\"'", "'@own/lib_' || k", "TRUE"),
    "rust": ("Cargo.toml", '[package]\nname = "own"\n[dependencies]\n', "\n", '\n[dev-dependencies]\nmock = "1"\n', "'lib_' || k || CASE k % 2 WHEN 0 THEN ' = \"1\"' ELSE ' = { version = \"1\", features = [\"a\"] }' END", "'lib_' || k", "TRUE"),
    "go": ("go.mod", "module own\n\nrequire (\n", "\n", "\n)\n", "chr(9) || CASE k % 3 WHEN 0 THEN '// ' ELSE '' END || 'github.com/own/lib' || k || ' v1.2'", "'github.com/own/lib' || k", "k % 3 > 0"),
    "java": ("pom.xml", "<project>\n", "\n", "\n</project>\n", "'<dependency>' || chr(10) || '<groupId>org.own</groupId>' || chr(10) || '<artifactId>lib' || k || '</artifactId>' || chr(10) || CASE k % 3 WHEN 0 THEN '<scope>test</scope>' || chr(10) ELSE '' END || '</dependency>'", "'org.own:lib' || k", "k % 3 > 0"),
    "csharp": ("own.csproj", '<Project Sdk="x">\n', "\n", "\n</Project>\n", "'<PackageReference Version=\"1\" Include=\"Own.Lib' || k || '\" />'", "'Own.Lib' || k", "TRUE"),
    "ruby": ("Gemfile", "source 'own'\n", "\n", "\n", "'gem ' || chr(39) || 'lib_' || k || chr(39) || CASE k % 3 WHEN 0 THEN ', group: :test' WHEN 1 THEN ', ' || chr(39) || '~> 1' || chr(39) ELSE '' END", "'lib_' || k", "k % 3 > 0"),
}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("r"), (k - k % 40).cast("string")).alias("repo"))


def files_of(spark, sf_dir, name: str, head: str, between: str, foot: str, line: str) -> DataFrame:
    """(repo, rel_path, content): one file a repository, with a line for each part; another of that name deeper in the tree doesn't count."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(line).alias("line")))), lambda x: x.line)
    top = parts(spark, sf_dir).groupBy("repo").agg(F.concat(F.lit(head), F.array_join(lines, between), F.lit(foot)).alias("content"))
    return top.select("repo", F.explode(F.array(F.lit(name), F.lit(f"deep/{name}"))).alias("rel_path"), F.when(F.col("rel_path") == name, F.col("content")).otherwise(F.replace("content", F.lit("lib"), F.lit("deep"))).alias("content"))


def deps(language: str, name: str, head: str, between: str, foot: str, line: str, dep: str, condition: str) -> None:
    @query(f"q_deps_{language}", f"{PARTS} SELECT repo, '{language}' AS language, {dep} AS dep FROM p WHERE {condition}")
    def run(spark, sf_dir):
        return M.READERS[language](files_of(spark, sf_dir, name, head, between, foot, line))


for _language, _manifest in MANIFESTS.items():
    deps(_language, *_manifest)


@query("q_pyproject", f"""{PARTS} SELECT repo, 'python' AS language, 'lib_' || k AS dep FROM p""")
def q_pyproject(spark, sf_dir):
    """Where pyproject names dependencies, requirements don't count."""
    project = files_of(spark, sf_dir, "pyproject.toml", "[project]\ndependencies = [", ", ", "]\n", "'\"lib_' || k || CASE k % 2 WHEN 0 THEN '>=1' ELSE '' END || '\"'")
    return M.python(project.unionByName(files_of(spark, sf_dir, *MANIFESTS["python"][:5])))


@query("q_lock_graphs", f"{PARTS} SELECT repo, 'rust' AS language, 'lib_' || k AS dep, n AS needs FROM p, (VALUES ('serde'), ('lib_')) t(x), LATERAL (SELECT CASE x WHEN 'serde' THEN x ELSE x || (k + 1) END AS n) UNION ALL SELECT repo, 'ruby', 'lib_' || k, 'lib_' || (k + 1) FROM p WHERE k % 2 = 0")
def q_lock_graphs(spark, sf_dir):
    cargo = files_of(spark, sf_dir, "Cargo.lock", "", "\n", "\n", "'[[package]]' || chr(10) || 'name = \"lib_' || k || '\"' || chr(10) || 'dependencies = [\"lib_' || (k + 1) || ' 0.3\", \"serde\"]'")
    gem = files_of(spark, sf_dir, "Gemfile.lock", "GEM\n  specs:\n", "\n", "\n", "'    lib_' || k || ' (1.0)' || CASE k % 2 WHEN 0 THEN chr(10) || '      lib_' || (k + 1) || ' (>= 4)' ELSE chr(10) || '      other' END")
    return M.cargo_lock(cargo).unionByName(M.gemfile_lock(gem))


@query("q_libres_resolve", f"""{PARTS}, shown AS (SELECT k, CASE k % 2 WHEN 0 THEN 'go' ELSE 'ruby' END AS language, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 9 = 0 THEN 'grpc,rest' ELSE 'rest' END ELSE CASE k % 4 WHEN 0 THEN 'kafka' WHEN 1 THEN 'amqp' WHEN 2 THEN 'amqp,kafka' END END AS protocols FROM p)
  SELECT language, 'own_' || k AS dep, protocols FROM shown WHERE protocols IS NOT NULL""")
def q_libres_resolve(spark, sf_dir):
    """What a library's sources show, else what its locked dependencies suggest."""
    own = parts(spark, sf_dir).select("k", F.when(F.col("k") % 2 == 0, "go").otherwise("ruby").alias("language"), F.concat(F.lit("own_"), F.col("k").cast("string")).alias("dep"))
    tools = own.select("language", F.lit("golang.org/x").alias("dep"))
    shown = own.filter("k % 3 = 0").select("dep", F.explode(F.when(F.col("k") % 9 == 0, F.array(F.lit("rest"), F.lit("grpc"))).otherwise(F.array(F.lit("rest"), F.lit("rest")))).alias("protocol"))
    needs = F.when(F.col("k") % 4 == 0, F.array(F.lit("aiokafka"))).when(F.col("k") % 4 == 1, F.array(F.lit("pika"))).when(F.col("k") % 4 == 2, F.array(F.lit("pika"), F.lit("aiokafka"))).otherwise(F.array(F.lit("nothing")))
    locked = own.select("language", "dep", F.explode(needs).alias("needs"))
    return libraries.resolve(own.select("language", "dep").union(tools), shown, locked).select("language", "dep", F.array_join("protocols", ",").alias("protocols"))


@query("q_installed_libraries", f"{PARTS} SELECT 'own-' || k AS dep, 'rest' AS protocol FROM p WHERE k % 2 = 0")
def q_installed_libraries(spark, sf_dir):
    """Protocols that rules find in the sources of installed libraries."""
    name = F.concat(F.lit("own_"), F.col("k").cast("string"))
    text = F.when(F.col("k") % 2 == 0, "import httpx\nhttpx.get('http://x/y')\n").otherwise("import httpx\n# httpx.get('http://x')\n")
    sources = parts(spark, sf_dir).select(F.explode(F.array(F.concat(name, F.lit("/client.py")), F.concat(F.lit("other/"), name, F.lit(".py")), F.concat(name, F.lit(".py")))).alias("rel_path"), text.alias("content"))
    wanted = parts(spark, sf_dir).select(F.lit("python").alias("language"), F.concat(F.lit("own-"), F.col("k").cast("string")).alias("dep"))
    rules = spark.createDataFrame([("py-httpx", ["python"], None, ["httpx"], [("httpx.get(", "rest", "high", "url_hostname")], 0)], rule_ops.RULE)
    return scans.installed(sources, wanted, rules)


_RULES = "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), top AS (SELECT max(k) + 1 AS m FROM p)"


@query("q_rule_upsert", f"{_RULES} SELECT 'p' || k AS id, CASE k % 20 WHEN 0 THEN 'medium' WHEN 10 THEN 'low' ELSE 'high' END AS confidence, k AS ord FROM p UNION ALL SELECT 'own' || k, 'low', k + m FROM p, top WHERE k % 10 = 1")
def q_rule_upsert(spark, sf_dir):
    """A tenth of the rules replaced in place, one in two with a confidence that is none, and as many new ones at the end."""
    found = part_rules(spark, sf_dir)
    sure = F.when(F.col("ord") % 20 == 0, "sure").otherwise("low")
    changed = found.filter("ord % 10 = 0").withColumn("detections", F.transform("detections", lambda d: d.withField("confidence", sure)))
    new = found.filter("ord % 10 = 1").withColumn("id", F.concat(F.lit("own"), F.col("ord").cast("string"))).withColumn("detections", F.transform("detections", lambda d: d.withField("confidence", F.lit("low"))))
    return rule_ops.override_rules(found, changed.unionByName(new)).select("id", F.get("detections", 0)["confidence"].alias("confidence"), F.col("ord").cast("long").alias("ord"))


@query("q_rule_disable", f"{_RULES} SELECT 'p' || k AS id FROM p WHERE k % 7 <> 3")
def q_rule_disable(spark, sf_dir):
    found = part_rules(spark, sf_dir)
    return rule_ops.disable_rules(found, found.filter("ord % 7 = 3").select("id")).select("id")


@query("q_registry_flatten", f"{_RULES} SELECT 'p' || k AS id, CASE k % 4 WHEN 0 THEN 'go,java' ELSE 'lang' || k % 5 END AS languages FROM p")
def q_registry_flatten(spark, sf_dir):
    """A registry for every forty parts, its rules by language; a rule of none has that of its group."""
    k = F.col("k")
    rule = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.when(k % 4 == 0, F.array(F.lit("go"), F.lit("java"))).when(k % 4 == 1, F.array().cast("array<string>")).alias("languages"))
    groups = parts(spark, sf_dir).groupBy("repo", F.concat(F.lit("lang"), (k % 5).cast("string")).alias("language")).agg(F.collect_list(rule).alias("patterns"))
    registry = groups.groupBy("repo").agg(F.collect_list(F.struct("language", "patterns")).alias("languages"))
    return rule_ops.flatten_registry(registry).select("id", F.array_join("languages", ",").alias("languages"))
