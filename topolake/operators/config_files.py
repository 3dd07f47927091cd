"""Services, endpoints, connections and schemas in configuration and specification files.

Every function takes files (rel_path, content, ...) and picks its own by globs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topolake.functions import strings as S
from topolake.operators.lines import lines_of
from topolake.sources.documents import entries, structured, text_at

#: Where each kind of file is looked for.
GLOBS = {
    "openapi": [f"**/{stem}.{end}" for stem in ("openapi", "swagger", "*.openapi", "*.swagger") for end in ("json", "yaml", "yml")],
    "asyncapi": [f"**/{stem}.{end}" for stem in ("asyncapi", "*.asyncapi") for end in ("json", "yaml", "yml")],
    "proto": ["**/*.proto"],
    "graphql": ["**/*.graphql", "**/*.gql"],
    "compose": ["**/docker-compose*.yml", "**/docker-compose*.yaml", "**/compose*.yml", "**/compose*.yaml"],
    "kubernetes": ["**/*.yaml", "**/*.yml"],
    "dockerfile": ["**/Dockerfile", "**/Dockerfile.*", "**/Containerfile", "**/Containerfile.*"],
    "env": ["**/.env", "**/.env.local", "**/.env.development", "**/.env.production", "**/.env.*"],
    "spring": ["**/application.properties", "**/application-*.properties", "**/application.yml", "**/application-*.yml"],
}
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Job")
#: Spring keys that hold addresses, and how they are read.
SPRING_KEYS = {
    "spring.datasource.url": "jdbc", "spring.datasource.host": "datasource", "spring.redis.host": "redis",
    "spring.data.redis.host": "redis", "spring.kafka.bootstrap-servers": "kafka", "spring.rabbitmq.host": "rabbitmq",
}


def picked(files: DataFrame, kind: str) -> DataFrame:
    return files.filter(S.matches_globs(F.col("rel_path"), GLOBS[kind]))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def service_rows(df: DataFrame, name: Column, root: Column, boundary: Column | None, method: str) -> DataFrame:
    return df.select(
        name.alias("name"), root.alias("root_path"), F.lit("").alias("language"), F.lit("service").alias("service_type"),
        (F.lit(None).cast("string") if boundary is None else boundary).alias("boundary_entry"), F.lit("high").alias("confidence"), F.lit(method).alias("extraction_method"), "rel_path",
    )


def endpoint_rows(df: DataFrame, service: Column, method: Column, path: Column, handler: Column | None, kind: str, tag: str, confidence: str = "high") -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(service.alias("service_name"), method.alias("method"), path.alias("path"), (none if handler is None else handler).alias("handler"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(tag).alias("extraction_method"), "rel_path")


def connection_rows(df: DataFrame, source: Column, target: Column, protocol: Column, evidence: Column | None, tag: str, confidence: str = "high") -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        source.alias("source_service"), target.alias("target_name"), protocol.alias("protocol"), none.alias("method"), none.alias("path"), F.concat("rel_path", F.lit(":0")).alias("source_file"),
        F.lit(confidence).alias("confidence"), F.lit(tag).alias("extraction_method"), none.alias("dependency"), (none if evidence is None else evidence).alias("evidence"), "rel_path",
    )


#: Kinds whose files are read as one document.
WHOLE = ("openapi", "asyncapi", "compose", "spring")


def documents(files: DataFrame, kinds: tuple[str, ...] = (*WHOLE, "kubernetes")) -> DataFrame:
    """(rel_path, kinds, text, doc) of the files that extractors of these kinds pick: each text is parsed once for all of them, a manifest's by its parts; doc is null where it can't be."""
    text, path = F.col("content"), F.col("rel_path")
    whole = F.filter(F.array(*[F.when(S.matches_globs(path, GLOBS[k]) & ~path.endswith(".properties"), k) for k in WHOLE if k in kinds]).cast("array<string>"), lambda k: k.isNotNull())
    one = F.when(F.size(whole) > 0, F.array(F.struct(whole.alias("kinds"), text.alias("text"))))
    manifest = S.matches_globs(path, GLOBS["kubernetes"]) & text.contains("apiVersion:") & text.contains("kind:") & F.lit("kubernetes" in kinds)
    parts = F.when(manifest, F.transform(F.split(text, "---"), lambda p: F.struct(F.array(F.lit("kubernetes")).alias("kinds"), p.alias("text"))))
    none = F.array().cast("array<struct<kinds:array<string>,text:string>>")
    own = files.filter(text.isNotNull()).select("rel_path", F.explode_outer(F.concat(F.coalesce(one, none), F.coalesce(parts, none))).alias("t")).filter("t is not null")
    return own.select("rel_path", "t.kinds", "t.text", structured(F.col("t.text")).alias("doc"))


def documents_of(kind: str, files: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Sound documents of a kind among docs, or else read from files."""
    docs = documents(files, (kind,)) if docs is None else docs
    return docs.filter(F.array_contains("kinds", kind) & F.col("doc").isNotNull()).drop("kinds")


# --- OpenAPI, Swagger, AsyncAPI ----------------------------------------------


def openapi_documents(files: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(rel_path, doc, version 3 or 2); an unquoted version isn't recognised."""
    text = F.col("text")
    third = text.contains('"openapi": "3.') | text.contains('openapi: "3.')
    second = text.contains('"swagger": "2.') | text.contains('swagger: "2.')
    found = documents_of("openapi", files, docs).withColumn("version", F.when(third, 3).when(second, 2)).filter("version is not null")
    return found.select("rel_path", "version", "doc").withColumn("title", F.coalesce(text_at(F.col("doc"), "$.info.title"), F.when(F.col("version") == 2, stem(F.col("rel_path"))))).filter("title is not null")


def operations(docs: DataFrame, path: str, verbs: tuple[str, ...]) -> DataFrame:
    """One row a path item and verb: (…, item, verb, operation)."""
    items = docs.select("*", F.explode(entries(F.col("doc"), path)).alias("e")).select("*", F.col("e.key").alias("item"), F.col("e.value").alias("v")).drop("e")
    each = F.filter(entries(F.col("v"), "$"), lambda o: o.key.isin(*verbs))
    return items.select("*", F.explode(each).alias("o")).select("*", F.col("o.key").alias("verb"), F.col("o.value").alias("operation")).drop("o", "v")


def openapi(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    docs = openapi_documents(files, docs)
    tag = "spec:openapi"
    routes = operations(docs, "$.paths", VERBS)
    servers = docs.filter("version = 3").select("*", F.explode(F.coalesce(F.try_variant_get("doc", "$.servers", "array<variant>"), F.array().cast("array<variant>"))).alias("s")).withColumn("url", text_at(F.col("s"), "$.url"))
    hosts = docs.filter("version = 2").withColumn("url", F.concat(F.lit("http://"), text_at(F.col("doc"), "$.host")))
    urls = servers.select("rel_path", "title", "url").unionByName(hosts.select("rel_path", "title", "url")).filter(S.url_host(F.col("url")).isNotNull())
    named = docs.filter("version = 3").select("rel_path", F.explode(entries(F.col("doc"), "$.components.schemas")).alias("e"))
    plain = named.filter(text_at(F.col("e.value"), "$['$ref']").isNull())
    required = F.coalesce(F.try_variant_get("e.value", "$.required", "array<string>"), F.array().cast("array<string>"))
    fields = F.transform(entries(F.col("e.value"), "$.properties"), lambda p: F.struct(p.key.alias("name"), field_type(p.value).alias("field_type"), F.array_contains(required, p.key).alias("required")))
    schemas = plain.select(F.col("e.key").alias("name"), F.lit("type").alias("role"), F.col("rel_path").alias("file"), fields.alias("fields"), F.lit("high").alias("confidence"), F.lit(tag).alias("extraction_method"), "rel_path")
    return {
        "services": service_rows(docs, F.col("title"), F.lit(""), F.col("rel_path"), tag),
        "endpoints": endpoint_rows(routes, F.col("title"), F.upper("verb"), F.col("item"), text_at(F.col("operation"), "$.operationId"), "rest", tag),
        "connections": connection_rows(urls, F.col("title"), S.url_host(F.col("url")), S.url_protocol(F.col("url")), None, tag, "medium"),
        "schemas": schemas,
    }


def field_type(value: Column) -> Column:
    kind = text_at(value, "$.type")
    return F.when(kind.isin("string", "number", "integer", "boolean", "object"), kind).when(kind == "array", F.concat(F.lit("array["), F.coalesce(text_at(value, "$.items.type"), F.lit("unknown")), F.lit("]"))).otherwise("unknown")


def asyncapi(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    named = documents_of("asyncapi", files, docs).withColumn("title", F.coalesce(text_at(F.col("doc"), "$.info.title"), stem(F.col("rel_path"))))
    routes = operations(named, "$.channels", ("publish", "subscribe"))
    return {"endpoints": endpoint_rows(routes, F.col("title"), F.col("verb"), F.col("item"), text_at(F.col("operation"), "$.operationId"), "asyncapi", "spec:asyncapi")}


# --- line grammars ------------------------------------------------------------


def blocks(files: DataFrame, kind: str, opening: str, closing: str = r"^\}$") -> DataFrame:
    """Trimmed lines with the block (kind, name) they stand in; opening and closing lines have none."""
    lines = lines_of(picked(files, kind).select("rel_path", "content")).withColumn("bare", S.trimmed(F.col("line")))
    start = F.struct(F.regexp_extract("bare", opening, 1).alias("kind"), F.regexp_extract("bare", opening, 2).alias("name"))
    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("name"))
    mark = F.when(F.col("bare").rlike(opening), start).when(F.col("bare").rlike(closing), none)
    seen = Window.partitionBy("rel_path").orderBy("line_no")
    return lines.withColumn("mark", mark).withColumn("block", F.last("mark", True).over(seen)).filter("mark is null and block.kind != ''")


def proto(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    inside = blocks(files, "proto", r"^(service|message)\s+([A-Za-z0-9_]+)\s+\{$")
    rpc = inside.filter("block.kind = 'service'").withColumn("rpc", F.regexp_extract("bare", r"^rpc\s+([A-Za-z0-9_]+)", 1)).filter("rpc != ''")
    first = F.split("bare", r"\s+")
    fields = inside.filter("block.kind = 'message'").filter(~F.col("bare").rlike("^(//|$|option|reserved|oneof|\\})") & (F.size(first) >= 2))
    field = F.struct("line_no", F.struct(F.get(first, 1).alias("name"), F.get(first, 0).alias("field_type"), F.lit(False).alias("required")).alias("f"))
    opened = lines_of(picked(files, "proto").select("rel_path", "content")).select("rel_path", F.regexp_extract(S.trimmed(F.col("line")), r"^message\s+([A-Za-z0-9_]+)\s+\{$", 1).alias("name")).filter("name != ''")
    return {"endpoints": endpoint_rows(rpc, F.col("block.name"), F.lit("rpc"), F.concat("block.name", F.lit("/"), "rpc"), F.lit(None).cast("string"), "grpc", "spec:proto"), "schemas": _line_schemas(opened, fields, field, "spec:proto")}


def _line_schemas(opened: DataFrame, fields: DataFrame, field: Column, tag: str) -> DataFrame:
    grouped = fields.select("rel_path", F.col("block.name").alias("name"), field.alias("x")).groupBy("rel_path", "name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda s: s.f).alias("fields"))
    none = F.array().cast("array<struct<name:string,field_type:string,required:boolean>>")
    joined = opened.distinct().hint("merge").join(grouped, ["rel_path", "name"], "left")
    return joined.select("name", F.lit("type").alias("role"), F.col("rel_path").alias("file"), F.coalesce("fields", none).alias("fields"), F.lit("high").alias("confidence"), F.lit(tag).alias("extraction_method"), "rel_path")


def graphql(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    opening = r"^(type|input)\s+([A-Za-z0-9_]+)[^{]*\{$"
    inside = blocks(files, "graphql", opening).filter(~F.col("bare").rlike("^(#|$)"))
    named = inside.withColumn("field", S.trimmed(F.regexp_extract("bare", r"^([^(:]+)", 1))).filter(F.col("bare").contains(":"))
    root = F.col("block.name").isin("Query", "Mutation", "Subscription")
    opened = lines_of(picked(files, "graphql").select("rel_path", "content")).select("rel_path", F.regexp_extract(S.trimmed(F.col("line")), opening, 2).alias("name")).filter(~F.col("name").isin("", "Query", "Mutation", "Subscription"))
    field = F.struct("line_no", F.struct(F.col("field").alias("name"), F.lit("unknown").alias("field_type"), F.lit(False).alias("required")).alias("f"))
    return {"endpoints": endpoint_rows(named.filter(root), stem(F.col("rel_path")), F.lower("block.name"), F.col("field"), None, "graphql", "spec:graphql"), "schemas": _line_schemas(opened, named.filter(~root), field, "spec:graphql")}


# --- deployment ---------------------------------------------------------------


def compose(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    services = documents_of("compose", files, docs).select("rel_path", F.explode(entries(F.col("doc"), "$.services")).alias("e")).select("rel_path", F.col("e.key").alias("name"), F.col("e.value").alias("v"))
    listed = F.try_variant_get("v", "$.depends_on", "array<string>")
    needs = F.coalesce(listed, F.transform(entries(F.col("v"), "$.depends_on"), lambda e: e.key))
    depends = services.select("rel_path", "name", F.explode(needs).alias("on"))
    pairs = F.transform(F.coalesce(F.try_variant_get("v", "$.environment", "array<string>"), F.array().cast("array<string>")), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), S.after(p, "=").alias("value")))
    mapped = F.transform(F.filter(entries(F.col("v"), "$.environment"), lambda e: F.schema_of_variant(e.value) == "STRING"), lambda e: F.struct(e.key.alias("key"), e.value.cast("string").alias("value")))
    env = services.select("rel_path", "name", F.explode(F.concat(pairs, mapped)).alias("p")).filter(S.is_address_key(F.col("p.key")) & S.url_host(F.col("p.value")).isNotNull())
    links = connection_rows(depends, F.col("name"), F.col("on"), F.lit("compose-depends_on"), F.concat_ws(" depends_on ", "name", "on"), "compose")
    urls = connection_rows(env, F.col("name"), S.url_host(F.col("p.value")), S.url_protocol(F.col("p.value")), F.concat_ws("=", "p.key", "p.value"), "compose")
    return {"services": service_rows(services, F.col("name"), directory(F.col("rel_path")), None, "compose"), "connections": links.unionByName(urls)}


def kubernetes(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """A workload whose containers lack a list ``env`` is passed over, as a malformed document is."""
    docs = documents_of("kubernetes", files, docs).select("rel_path", "doc", text_at(F.col("doc"), "$.kind").alias("kind"), text_at(F.col("doc"), "$.metadata.name").alias("name"))
    containers = F.try_variant_get("doc", "$.spec.template.spec.containers", "array<variant>")
    sound = containers.isNotNull() & F.forall(containers, lambda c: F.try_variant_get(c, "$.env", "array<variant>").isNotNull())
    workloads = docs.filter(F.col("kind").isin(*WORKLOADS) & sound)
    services = workloads.select("rel_path", "name").unionByName(docs.filter("kind = 'Service'").select("rel_path", "name")).filter("name is not null")
    env = workloads.select("rel_path", "name", F.explode(containers).alias("c")).select("rel_path", "name", F.explode(F.try_variant_get("c", "$.env", "array<variant>")).alias("e"))
    env = env.select("rel_path", "name", text_at(F.col("e"), "$.name").alias("key"), text_at(F.col("e"), "$.value").alias("value")).filter(F.col("value").isNotNull() & S.is_deployment_key(F.col("key")))
    scheme, host = S.raw_url_parts(F.col("value"))
    plain = S.looks_like_hostname(F.col("value"))
    found = env.withColumns({"protocol": F.when(host.isNotNull(), scheme).when(plain, S.key_protocol(F.col("key"))), "host": F.when(host.isNotNull(), host).when(plain, F.col("value"))}).filter("host is not null")
    return {"services": service_rows(services, F.col("name"), directory(F.col("rel_path")), None, "kubernetes"), "connections": connection_rows(found, F.col("name"), F.col("host"), F.col("protocol"), F.concat_ws("=", "key", "value"), "kubernetes")}


def dockerfile(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    found = picked(files, "dockerfile").withColumn("dir", directory(F.col("rel_path")))
    name = F.when(F.col("dir") == "", "root").otherwise(F.element_at(F.split("dir", "/"), -1))
    return {"services": service_rows(found, name, F.col("dir"), F.col("rel_path"), "dockerfile")}


# --- environment --------------------------------------------------------------


def env_pairs(files: DataFrame, kind: str, export: bool) -> DataFrame:
    """(rel_path, key, value): of each file the last value of a key."""
    key, value = S.env_line(F.col("line"), export)
    pairs = lines_of(picked(files, kind).select("rel_path", "content")).select("rel_path", "line_no", key.alias("key"), value.alias("value")).filter("key is not null")
    return pairs.groupBy("rel_path", "key").agg(F.max_by("value", "line_no").alias("value"))


def env(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    pairs = env_pairs(files, "env", True).filter(S.is_address_key(F.col("key")))
    brokers = F.col("key") == "KAFKA_BROKERS"
    found = pairs.withColumns({"host": F.when(brokers, S.kafka_host(F.col("value"))).otherwise(S.url_host(F.col("value"))), "protocol": F.when(brokers, "kafka").otherwise(S.url_protocol(F.col("value")))}).filter("host is not null")
    return {"connections": connection_rows(found, directory(F.col("rel_path")), F.col("host"), F.col("protocol"), F.concat_ws("=", "key", "value"), "spec:env")}


def spring(files: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    flat = env_pairs(files.filter(F.col("rel_path").endswith(".properties")), "spring", False)
    docs = documents_of("spring", files, docs)
    paths = F.array(*[F.struct(F.lit(k).alias("key"), text_at(F.col("doc"), "$." + ".".join(p if "-" not in p else f"['{p}']" for p in k.split(".")).replace(".[", "[")).alias("value")) for k in SPRING_KEYS])
    nested = docs.select("rel_path", F.explode(paths).alias("p")).select("rel_path", "p.key", "p.value").filter("value is not null")
    pairs = flat.filter(F.col("key").isin(*SPRING_KEYS)).unionByName(nested)
    kinds = F.create_map(*[F.lit(x) for kv in SPRING_KEYS.items() for x in kv])
    read = pairs.withColumn("kind", F.element_at(kinds, F.col("key")))
    jdbc = S.jdbc_target(F.col("value"))
    found = read.withColumns({"host": F.when(F.col("kind") == "jdbc", jdbc[1]).when(F.col("kind") == "kafka", S.kafka_host(F.col("value"))).otherwise(S.found(F.col("value"))), "protocol": F.when(F.col("kind") == "jdbc", jdbc[0]).otherwise(F.col("kind"))}).filter("host is not null")
    return {"connections": connection_rows(found, directory(F.col("rel_path")), F.col("host"), F.col("protocol"), F.concat_ws("=", "key", "value"), "spec:spring")}


#: In the order in which their findings count.  Each takes files and, where it reads documents, those that were read before.
EXTRACTORS = {"openapi": openapi, "proto": proto, "graphql": graphql, "asyncapi": asyncapi, "compose": compose, "kubernetes": kubernetes, "dockerfile": dockerfile, "env": env, "spring": spring}


def faults(files: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(rel_path, extractor, error) of files that an extractor of whole documents picks but that aren't JSON or YAML; each extractor passes them over."""
    brace = F.regexp_replace("text", r"^\s+", "").startswith("{")
    unread = (documents(files) if docs is None else docs).filter("doc is null")
    return unread.select("rel_path", F.explode("kinds").alias("extractor"), F.when(brace, "malformed JSON").otherwise("malformed YAML").alias("error")).distinct()
