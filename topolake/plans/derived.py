"""Inputs in the shape of scan findings, derived from the driver's tables.

Each is one SELECT in the part of SQL that Spark and DuckDB share, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from topolake.plans.registry import table

DERIVED = {
    "services": """
        SELECT 'svc' || CAST(s_suppkey % 97 AS STRING) AS name, 'r' || CAST(s_nationkey AS STRING) || '/s' || CAST(s_suppkey % 20 AS STRING) AS root_path,
               '' AS language, 'service' AS service_type, CAST(NULL AS STRING) AS boundary_entry, 'high' AS confidence,
               CASE s_suppkey % 4 WHEN 0 THEN 'compose' WHEN 1 THEN 'dockerfile' WHEN 2 THEN 'kubernetes' ELSE 'spec:openapi' END AS extraction_method,
               CAST(s_suppkey AS BIGINT) AS seq FROM {supplier}""",
    "endpoints": """
        SELECT 'svc' || CAST(p_partkey % 97 AS STRING) AS service_name, CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'post' WHEN 2 THEN 'PUT' ELSE '' END AS method,
               '/v' || CAST(p_partkey % 211 AS STRING) || '/items/' || CASE p_size % 3 WHEN 0 THEN ':id' WHEN 1 THEN '{{key}}' ELSE '*' END AS path,
               CAST(NULL AS STRING) AS handler, 'rest' AS kind, 'high' AS confidence,
               CASE p_partkey % 5 WHEN 0 THEN 'spec:openapi' WHEN 1 THEN 'spec:asyncapi' WHEN 2 THEN 'ast_express' ELSE 'python_fastapi_flask_decorator' END AS extraction_method,
               CAST(p_partkey AS BIGINT) AS seq FROM {part}""",
    "connections": """
        SELECT 'svc' || CAST(l_suppkey % 97 AS STRING) AS source_service, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'svc' || CAST(l_partkey % 53 AS STRING) END AS target_name,
               CASE l_returnflag WHEN 'A' THEN 'rest' WHEN 'N' THEN 'grpc' ELSE 'kafka' END AS protocol,
               CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) WHEN l_linestatus = 'F' THEN 'GET' ELSE 'Post' END AS method,
               '/v' || CAST(l_partkey % 211 AS STRING) || '/items/' || CASE l_linenumber % 2 WHEN 0 THEN '{{x}}' ELSE ':y' END AS path,
               'src/f' || CAST(l_partkey % 499 AS STRING) || '.py:' || CAST(l_linenumber AS STRING) AS source_file, 'medium' AS confidence,
               CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'pattern:p' || CAST(l_suppkey % 11 AS STRING) WHEN 1 THEN 'wrapper_trace:w' WHEN 2 THEN 'library_resolution:l' ELSE 'spec:env' END AS extraction_method,
               'dep' || CAST(l_suppkey % 11 AS STRING) AS dependency, 'line ' || CAST(l_orderkey AS STRING) AS evidence,
               CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM {lineitem}""",
    "schemas": """
        SELECT 'T' || CAST(p_partkey % 101 AS STRING) AS name, CASE p_partkey % 3 WHEN 0 THEN 'spec:openapi' WHEN 1 THEN 'spec:proto' ELSE 'ast' END AS extraction_method,
               CAST(p_partkey AS BIGINT) AS seq FROM {part}""",
    "overrides": """
        SELECT 'r' || CAST(n_nationkey AS STRING) || '/s' || CAST(n_nationkey % 20 AS STRING) AS root_path, CASE WHEN n_nationkey % 3 = 0 THEN TRUE ELSE FALSE END AS ignored,
               CASE WHEN n_nationkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'renamed' || CAST(n_nationkey AS STRING) END AS new_name FROM {nation}""",
    "files": """
        SELECT 'r' || CAST(c_nationkey AS STRING) || '/s' || CAST(c_custkey % 25 AS STRING) || '/src/' || CASE c_custkey % 4 WHEN 0 THEN 'main.py' WHEN 1 THEN 'lib/__init__.py' WHEN 2 THEN 'node_modules/x/index.js' ELSE '.env' END AS rel_path,
               CAST(c_custkey AS BIGINT) AS file_ord FROM {customer}""",
    "settings": """
        SELECT CAST(event_id AS BIGINT) AS seq, CAST(user_id % 3 AS INT) AS layer, CAST(event_id % 5 AS INT) AS prio,
               CASE event_type WHEN 'view' THEN 'DATABASE_URL' ELSE 'APP_' || upper(event_type) END || CASE WHEN user_id % 4 = 0 THEN '' ELSE '_' || CASE user_id % 3 WHEN 0 THEN 'URL' WHEN 1 THEN 'HOST' ELSE 'NAME' END END AS key,
               CASE user_id % 6 WHEN 0 THEN 'postgres://u:p@db' || CAST(user_id % 9 AS STRING) || ':5432/app' WHEN 1 THEN 'http://{{host}}/v1' WHEN 2 THEN 'redis.internal.example'
                    WHEN 3 THEN 'k1:9092, k2:9092' WHEN 4 THEN 'jdbc:mysql://my' || CAST(user_id % 9 AS STRING) || ':3306/x' ELSE 'HTTPS://API.Example.COM:8443/x?y#z' END AS value FROM {events}""",
    "code": """
        SELECT CAST(o_orderkey AS BIGINT) AS line_id, CAST(o_orderkey - o_orderkey % 400 AS BIGINT) AS file_id, CASE o_orderkey % 12
            WHEN 0 THEN '  db = connect("postgres://user:pw@db' || CAST(o_custkey % 7 AS STRING) || '.internal:5432/app", timeout=5)'
            WHEN 1 THEN 'const u = process.env.API_URL ?? "http://api' || CAST(o_custkey % 7 AS STRING) || '.local:8080/v1";'
            WHEN 2 THEN 'let v = env::var("PORT").unwrap_or("svc' || CAST(o_custkey % 7 AS STRING) || '");'
            WHEN 3 THEN 'client.call(base=' || chr(39) || 'c' || chr(39) || ', "second", target="host' || CAST(o_custkey % 7 AS STRING) || '")'
            WHEN 4 THEN '# requests.get("http://comment")'
            WHEN 5 THEN 'x = ENV["DB"] || ' || chr(39) || 'db' || CAST(o_custkey % 7 AS STRING) || chr(39)
            WHEN 6 THEN 'Connect(&DB_URL, ' || chr(39) || 'a' || chr(39) || ')'
            WHEN 7 THEN 'import y from ' || chr(39) || 'lib-http' || chr(39)
            WHEN 8 THEN '    requests.get(' || chr(39) || 'http://svc' || CAST(o_custkey % 7 AS STRING) || '/items' || chr(39) || ')'
            WHEN 9 THEN '    ' || repeat(chr(34), 3) || 'docs' || repeat(chr(34), 3)
            WHEN 10 THEN '    ' || repeat(chr(34), 3)
            ELSE 'return ""' END AS line FROM {orders}""",
    "calls": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS line_id, CAST(l_orderkey - l_orderkey % 200 AS BIGINT) AS file_id, CASE l_linenumber % 7
            WHEN 0 THEN '  # client' || CAST(l_partkey AS STRING) || '.send("x")'
            WHEN 1 THEN 'r = client' || CAST(l_partkey AS STRING) || '.send("http://svc' || CAST(l_suppkey % 97 AS STRING) || '/items", timeout=5)'
            WHEN 2 THEN 'out = my_topic_' || CAST(l_partkey AS STRING) || '(payload)'
            WHEN 3 THEN 'import sdk' || CAST(l_partkey % 40 AS STRING)
            WHEN 4 THEN 'queue->bind(' || CAST(l_partkey AS STRING) || ')'
            WHEN 5 THEN 'x = total + ' || CAST(l_partkey AS STRING)
            ELSE 'bus.topic_' || CAST(l_partkey AS STRING) || '.publish(target="t' || CAST(l_suppkey AS STRING) || '")' END AS line FROM {lineitem}""",
    "part_rules": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS INT) AS ord, CASE p_partkey % 4 WHEN 0 THEN 'client' || CAST(p_partkey AS STRING) || '.send(' WHEN 1 THEN 'topic_' || CAST(p_partkey AS STRING) || '('
                   WHEN 2 THEN '.topic_' || CAST(p_partkey AS STRING) || '.publish(' ELSE '->bind(' || CAST(p_partkey AS STRING) || ')' END AS detect,
               CASE WHEN p_partkey % 5 = 0 THEN 'sdk' || CAST(p_partkey % 40 AS STRING) END AS gate, CASE p_partkey % 3 WHEN 0 THEN 'rest' ELSE 'kafka' END AS protocol FROM {part}""",
    "route_files": """
        SELECT 'svc' || CAST(o_custkey % 7 AS STRING) AS service, 'src/r' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.java' WHEN 2 THEN '.py' ELSE '.go' END AS rel_path, CASE o_orderkey % 4
            WHEN 0 THEN 'router' || chr(10) || '  .' || CASE WHEN o_custkey % 2 = 0 THEN 'get' ELSE 'post' END || '(' || chr(10) || '  guard("' || o_orderstatus || ')", limits({{a: [1, 2]}})),' || chr(10) || '  "/o' || CAST(o_custkey AS STRING) || '/items",' || chr(10)
                        || '  audit, // router.put("/no", x)' || chr(10) || '  handle' || CAST(o_orderkey AS STRING) || chr(10) || ');' || chr(10) || 'router.use(log("/none"), app.all);'
            WHEN 1 THEN '@RequestMapping(value = "/a' || CAST(o_custkey AS STRING) || '")' || chr(10) || 'class A {{' || chr(10) || '  @GetMapping(' || chr(10) || '    produces = "text",' || chr(10) || '    path = "/x"' || chr(10) || '  )' || chr(10)
                        || '  public String one(@Named("q") String id) {{ return f("("); }}' || chr(10) || '}}' || chr(10) || '@RestController' || chr(10) || '@RequestMapping("/b' || CAST(o_custkey AS STRING) || '")' || chr(10) || 'class B {{ @PostMapping String none() {{}} @PostMapping("/y") List<String> two() {{}} }}'
            WHEN 2 THEN '@app.post(' || chr(10) || '    "/p' || CAST(o_custkey AS STRING) || '",' || chr(10) || '    tags=["a", "b("],' || chr(10) || ')' || chr(10) || '@limit(of(3))' || chr(10) || 'async def add_' || CAST(o_orderkey AS STRING) || '(x):' || chr(10) || '    pass'
            ELSE 'r.POST("/g' || CAST(o_custkey AS STRING) || '", chain(auth("x"), log), handle)' || chr(10) || 'fmt.Println("POST")' END AS content FROM {orders}""",
    "deps": """
        SELECT CAST(p_partkey AS BIGINT) AS dep_id, CASE p_partkey % 10 WHEN 0 THEN 'requests>=2.0,<3' WHEN 1 THEN 'aiokafka[ssl]==0.8' WHEN 2 THEN 'golang.org/x/net' WHEN 3 THEN 'google.golang.org/grpc'
               WHEN 4 THEN 'psycopg2-binary ~= 2' WHEN 5 THEN 'Flask<2,>1' WHEN 6 THEN 'lib_http' WHEN 7 THEN 'redis; python_version > "3"' WHEN 8 THEN 'ioredis' ELSE lower(p_brand) END AS dep FROM {part}""",
}


def derive(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """The rows of that name.  spread: a key of the table that they come from, by which its rows are dealt out first where what follows needs more tasks than the table has parts."""
    sql = DERIVED[name]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = lambda t: table(spark, sf_dir, t).repartition(parts, spread) if spread else table(spark, sf_dir, t)
    return spark.sql(sql, **{t: read(t) for t in re.findall(r"\{(\w+)\}", sql.replace("{{", "").replace("}}", ""))})


def ctes(*names: str) -> str:
    """WITH clause that gives DuckDB the same inputs."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'(?<!{){(\w+)}(?!})', r'\1', DERIVED[n]).replace('{{', '{').replace('}}', '}')})" for n in names)
