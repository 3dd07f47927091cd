"""Queries over the embedded repository, once a supplier; the oracles are rows written by hand from what each file says."""

from __future__ import annotations

from pyspark.sql import functions as F

from topolake.operators import config_files as C, relations, routes as R, variables as V
from topolake.operators.functions_of import functions
from topolake.plans import scan as scans
from topolake.plans.corpus import corpus
from topolake.plans.derived import derive
from topolake.plans.q_rules import rule_ops
from topolake.plans.registry import query


def values(columns: str, *rows: tuple) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


def copied(columns: str, *rows: tuple) -> str:
    """The rows once a supplier, with its root in place of ``{root}``."""
    rooted = {i for r in rows for i, v in enumerate(r) if isinstance(v, str) and "{root}" in v}
    shown = [f"replace({c}, '{{root}}', 'c' || s_suppkey) AS {c}" if i in rooted else c for i, c in enumerate(columns.split(", "))]
    return f"SELECT {', '.join(shown)} FROM ({values(columns, *rows)}) v CROSS JOIN supplier"


ENDPOINT, LINK, SERVICE, SCHEMA = ["service_name", "method", "path", "handler"], ["source_service", "target_name", "protocol", "evidence"], ["name", "root_path", "boundary_entry"], ["name", "fields"]


def config(name: str, kind: str, part: str, *rows: tuple) -> None:
    columns = {"endpoints": ENDPOINT, "connections": LINK, "services": SERVICE, "schemas": SCHEMA}[part]

    @query(name, copied(", ".join(columns), *rows))
    def run(spark, sf_dir):
        found = C.EXTRACTORS[kind](corpus(spark, sf_dir))[part]
        if part == "schemas":
            found = found.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(" "), f.field_type, F.when(f.required, "!").otherwise(""))), ","))
        return found.select(*columns)


config("q_openapi", "openapi", "endpoints", ("Catalog", "GET", "/things", "listThings"), ("Catalog", "POST", "/things", None), ("swagger", "GET", "/old", "old"))
config("q_openapi_services", "openapi", "services", ("Catalog", "", "{root}/api/openapi.yaml"), ("swagger", "", "{root}/api/swagger.json"))
config("q_openapi_schemas", "openapi", "schemas", ("Thing", "id string!,owner unknown,tags array[string]"))
config("q_swagger", "openapi", "connections", ("Catalog", "catalog.example.com", "http", None), ("swagger", "old.example.com", "http", None))
config("q_asyncapi", "asyncapi", "endpoints", ("Bus", "publish", "orders", None), ("Bus", "subscribe", "orders", "onOrder"))
config("q_proto", "proto", "endpoints", ("Shop", "rpc", "Shop/Get", None))
config("q_proto_schemas", "proto", "schemas", ("Req", "id string,int32 repeated"))
config("q_graphql", "graphql", "endpoints", ("shop", "query", "item", None))
config("q_graphql_schemas", "graphql", "schemas", ("Item", "name unknown"))
config("q_compose", "compose", "connections", ("web", "db", "compose-depends_on", "web depends_on db"), ("db", "vol", "compose-depends_on", "db depends_on vol"), ("web", "db", "postgresql", "DATABASE_URL=postgres://u:p@db:5432/x"), ("db", "cache", "redis", "REDIS_URL=redis://cache"))
config("q_compose_services", "compose", "services", ("db", "{root}/deploy", None), ("web", "{root}/deploy", None))
config("q_k8s", "kubernetes", "connections", ("web-deploy", "db.internal", "tcp", "DB_HOST=db.internal"), ("web-deploy", "api", "http", "API_URL=http://api:80/x"))
config("q_k8s_services", "kubernetes", "services", ("web-deploy", "{root}/k8s", None), ("web-svc", "{root}/k8s", None))
config("q_dockerfile", "dockerfile", "services", *[(n, f"{{root}}/{n}", f"{{root}}/{n}/Dockerfile") for n in ("shop", "web", "gw", "pay")])
config("q_env", "env", "connections", ("{root}/conf", "n", "mysql", "DATABASE_URL=mysql://n/x"), ("{root}/conf", "k1", "kafka", "KAFKA_BROKERS=k1:9092,k2:9092"))
config("q_spring", "spring", "connections", ("{root}/conf", "pg", "postgresql", "spring.datasource.url=jdbc:postgresql://pg:5432/x"), ("{root}/conf", "mq", "rabbitmq", "spring.rabbitmq.host=mq"), ("{root}/conf", "cache", "redis", "spring.data.redis.host=cache"), ("{root}/conf", "kb", "kafka", "spring.kafka.bootstrap-servers=kb:1,kc:2"))


def route(name: str, tag: str, *rows: tuple) -> None:
    @query(name, copied(", ".join(ENDPOINT), *rows))
    def run(spark, sf_dir):
        files = corpus(spark, sf_dir)
        return R.routes(files, [tag], C.dockerfile(files)["services"].withColumn("seq", F.xxhash64("rel_path"))).select(*ENDPOINT)


route("q_express", "ast_express", ("web", "GET", "/health", None), ("web", "POST", "/orders", "createOrder"))
route("q_nest", "ast_nestjs_two_phase", ("web", "GET", "/pets/:id", None), ("web", "POST", "/pets", None))
route("q_fastify", "ast_fastify", ("web", "PUT", "/fast", "handlePut"))
route("q_next", "nextjs_api_routes", ("", "GET", "/{root}/app/users", None), ("", "GET", "/{root}/pages/api/pay/[id]", None))
route("q_fastapi", "python_fastapi_flask_decorator", ("shop", "GET", "/items", "list_items"), ("shop", "POST", "/items/{id}", "add_item"))
route("q_django", "python_django_urlpatterns", ("shop", "GET", "about/", "views.about"), ("shop", "GET", "^team/$", "views.team"))
route("q_gin", "go-gin-echo-fiber-route", ("gw", "GET", "/ping", "ping"), ("gw", "HANDLEFUNC", "/raw", "raw"))
route("q_chi", "go-chi-route", ("gw", "GET", "/ping", "ping"), ("gw", "HANDLEFUNC", "/raw", "raw"))
route("q_gorilla", "go-gorilla-mux-route", ("gw", "", "/ping", "ping"), ("gw", "", "/raw", "raw"))
route("q_nethttp", "go-http-handlefunc", ("gw", "", "/raw", "raw"))
route("q_springmvc", "java_spring_boot", ("pay", "GET", "/pay/{id}", "one"), ("pay", "POST", "/pay/", "add"))
route("q_aspnet", "csharp-attribute", ("unknown", "GET", "/bills", "All"))
route("q_minimal_api", "csharp-minimal-api", ("unknown", "POST", "/bills/new", None))
route("q_actix", "ast_actix_macro", ("", "GET", "/rs/{id}", "one"))
route("q_axum", "ast_axum_route", ("", "POST", "/ax", "post(make)"))
route("q_rails", "ast_rails_route", ("", "GET", "/status", None), ("", "POST", "/hook", None))
_BOOKS = (("GET", ""), ("POST", ""), ("GET", "/new"), ("GET", "/:id"), ("GET", "/:id/edit"), ("PUT", "/:id"), ("DELETE", "/:id"))
route("q_rails_resources", "ast_rails_resources", *[("", v, f"/books{s}", None) for v, s in _BOOKS])
route("q_rails_resource", "ast_rails_resource", *[("", v, f"/profile{s}", None) for v, s in _BOOKS[1:]])


#: Manifests that open the gates of the derived files.
MANIFESTS = {"package.json": '{"express": "4"}', "pom.xml": "spring-boot-starter-web", "requirements.txt": "fastapi", "go.mod": "github.com/gin-gonic/gin v1"}


@query("q_route_calls", """WITH o AS (SELECT *, 'svc' || o_custkey % 7 AS service_name, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
  SELECT service_name, CASE WHEN o_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/o' || c || '/items' AS path, 'handle' || k AS handler, 'ast_express' AS extraction_method FROM o WHERE o_orderkey % 4 = 0
  UNION ALL SELECT service_name, 'GET', '/a' || c || '/x', 'one', 'java_spring_boot' FROM o WHERE o_orderkey % 4 = 1 UNION ALL SELECT service_name, 'POST', '/b' || c || '/y', 'two', 'java_spring_boot' FROM o WHERE o_orderkey % 4 = 1
  UNION ALL SELECT service_name, 'POST', '/p' || c, 'add_' || k, 'python_fastapi_flask_decorator' FROM o WHERE o_orderkey % 4 = 2
  UNION ALL SELECT service_name, 'POST', '/g' || c, 'handle', 'go-gin-echo-fiber-route' FROM o WHERE o_orderkey % 4 = 3""")
def q_route_calls(spark, sf_dir):
    """Routes of calls over several lines, after other arguments and behind nested calls, and of two classes in a file."""
    manifests = spark.createDataFrame(list(MANIFESTS.items()), "rel_path string, content string").withColumn("service", F.lit(None).cast("string"))
    return R.routes(derive(spark, sf_dir, "route_files", "o_orderkey").unionByName(manifests)).select("service_name", "method", "path", "handler", "extraction_method")


@query("q_framework_gates", values("framework", *[(n,) for n in ("express", "nestjs", "fastify", "fastapi", "django", "gin", "chi", "gorilla", "nethttp", "spring", "aspnet", "minimal_api", "actix", "axum", "rails", "sinatra")]))
def q_framework_gates(spark, sf_dir):
    return R.gates(corpus(spark, sf_dir))


@query("q_functions", copied("rel_path, name", ("{root}/shop/app.py", "list_items"), ("{root}/shop/app.py", "add_item"), ("{root}/shop/app.py", "fetch_all"), ("{root}/rs/main.rs", "one"), ("{root}/app/users/route.ts", "GET"), ("{root}/app/users/route.ts", "POST"), ("{root}/pages/api/pay/[id].js", "getPay"), ("{root}/web/src/pets.ts", "one"), ("{root}/web/src/pets.ts", "add"), ("{root}/bill/Bills.cs", "All")))
def q_functions(spark, sf_dir):
    files = corpus(spark, sf_dir).withColumns({"language": scans.language_of(F.col("rel_path")), "file_ord": F.lit(0)})
    return functions(files).select("rel_path", "name")


def own_rules(spark):
    return spark.createDataFrame([("py-httpx", ["python"], None, ["httpx"], [("httpx.get(", "rest", "high", "url_hostname")], 0)], rule_ops.RULE)


@query("q_scan", copied("source_service, target_name, protocol, extraction_method, confidence", ("shop", "stock", "rest", "pattern:py-httpx", "high"), ("shop", "stock", "rest", "pattern:py-httpx", "high")))
def q_scan(spark, sf_dir):
    """Code connections of the whole scan; wrapper calls go, as a rule has found the file's protocol."""
    found = scans.scan(spark, corpus(spark, sf_dir), own_rules(spark))["connections"].filter("extraction_method like 'pattern:%' or extraction_method like 'wrapper%'")
    return found.select("source_service", "target_name", "protocol", "extraction_method", "confidence")


_PLACES = values("name, root, n", ("shop", "/shop", 5), ("web", "/web", 5), ("gw", "/gw", 7), ("pay", "/pay", 2), ("db", "/deploy", 0), ("web-deploy", "/k8s", 0))


@query("q_scan_services", f"""SELECT name, 'c' || s_suppkey || root AS root_path, CASE WHEN 'c' || s_suppkey = (SELECT min('c' || s_suppkey) FROM supplier) THEN n * (SELECT count(*) FROM supplier) ELSE 0 END AS n FROM ({_PLACES}) p CROSS JOIN supplier
  UNION ALL SELECT 'Catalog', '', 2 * count(*) FROM supplier""")
def q_scan_services(spark, sf_dir):
    """Of services of one name the first exposes the endpoints of all; specifications stand at the top."""
    found = scans.scan(spark, corpus(spark, sf_dir))
    return relations.exposed_counts(found["services"], found["endpoints"]).select("name", "root_path", "n")


@query("q_var_store", copied("layer, key, value", (0, "DATABASE_URL", "mysql://m/x"), (0, "KAFKA_BROKERS", "k1:9092,k2:9092"), (0, "NAME", "x"), (0, "DATABASE_URL", "mysql://n/x"), (1, "DATABASE_URL", "postgres://u:p@db:5432/x"), (1, "REDIS_URL", "redis://cache"), (2, "DATABASE_URL", "postgres://cm/x"), (2, "CACHE_URL", "redis://cm:6379")))
def q_var_store(spark, sf_dir):
    return V.settings_of(corpus(spark, sf_dir)).select(F.col("layer").cast("int").alias("layer"), "key", "value")


@query("q_var_resolve", values("key, value, host, port", ("DATABASE_URL", "mysql://n/x", "n", None), ("CACHE_URL", "redis://cm:6379", "cm", 6379)))
def q_var_resolve(spark, sf_dir):
    keys = spark.createDataFrame([("DATABASE_URL",), ("CACHE_URL",), ("NONE",)], "key string")
    return V.resolve(V.settings_of(corpus(spark, sf_dir)), keys)
