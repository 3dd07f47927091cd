"""Queries over scalar functions and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from topolake.functions import strings as S
from topolake.plans.derived import ctes, derive
from topolake.plans.registry import query, table

_URL = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#\[\]]*)(?::[0-9]*)?(?:[/?#].*)?$'"
_QUOTED = "'\"([^\"]*)\"|''([^'']*)'''"
_FIRST = f"CASE WHEN regexp_matches(LINE, {_QUOTED}) THEN regexp_replace(regexp_extract(LINE, {_QUOTED}, 0), '^.|.$', '', 'g') END"


def first_sql(line: str) -> str:
    return _FIRST.replace("LINE", line)


def cut_sql(line: str, mark: str) -> str:
    return f"CASE WHEN strpos({line}, '{mark}') > 0 THEN substr({line}, strpos({line}, '{mark}') + {len(mark)}) END"


def host_sql(url: str) -> str:
    host = f"nullif(regexp_extract({url}, {_URL}, 2), '')"
    return f"CASE WHEN NOT contains({host}, '{{') THEN CASE WHEN lower(regexp_extract({url}, {_URL}, 1)) IN ('http','https','ws','wss','ftp') THEN lower({host}) ELSE {host} END END"


def protocol_sql(scheme: str) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.SCHEMES.items())
    return f"CASE {scheme} {whens} ELSE {scheme} END"


def over(source: str, keys: list[str], columns: Callable[[], dict[str, Column]], sql: dict[str, str]):
    """A query of columns over a derived input, and its oracle."""

    def run(spark, sf_dir) -> DataFrame:
        return derive(spark, sf_dir, source).select(*keys, *[c.alias(n) for n, c in columns().items()])

    return run, f"{ctes(source)} SELECT {', '.join(keys)}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {source}"


def add(name: str, *parts) -> None:
    run, oracle = over(*parts)
    query(name, oracle)(run)


_nn = "nullif({}, '')".format
_port = _URL.replace("(\\[[^\\]]*\\]|[^:/?#\\[\\]]*)(?::[0-9]*)?", "(?:\\[[^\\]]*\\]|[^:/?#\\[\\]]*):([0-9]+)").replace("^([A-Za-z]", "^(?:[A-Za-z]").replace("*)://", "*)://")

add("q_normalize_path", "endpoints", ["seq"], lambda: {"normal": S.normal_path(F.col("path"))}, {"normal": "array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN starts_with(s, ':') OR (starts_with(s, '{') AND ends_with(s, '}')) THEN '{param}' WHEN s = '*' THEN '{*}' ELSE s END), '/')"})
add("q_conn_key", "settings", ["seq"], lambda: {"address": S.is_address_key(F.col("key")), "deployment": S.is_deployment_key(F.col("key"))}, {"address": "key IN ('DATABASE_URL','REDIS_URL','AMQP_URL','KAFKA_BROKERS') OR regexp_matches(key, '_(URL|HOST|ENDPOINT|ADDR|DSN)$')", "deployment": "regexp_matches(upper(key), 'URL|HOST|ENDPOINT|BROKER|ADDRESS')"})
add("q_k8s_key_protocol", "settings", ["seq"], lambda: {"protocol": S.key_protocol(F.col("key"))}, {"protocol": "CASE WHEN contains(upper(key), 'REDIS') THEN 'redis' WHEN regexp_matches(upper(key), 'POSTGRES|PG|DATABASE') THEN 'postgresql' WHEN contains(upper(key), 'MYSQL') THEN 'mysql' WHEN contains(upper(key), 'MONGO') THEN 'mongodb' WHEN regexp_matches(upper(key), 'KAFKA|BROKER') THEN 'kafka' ELSE 'tcp' END"})
add("q_setting_targets", "settings", ["seq"], lambda: {"host": S.url_host(F.col("value")), "protocol": S.url_protocol(F.col("value")), "port": S.url_port(F.col("value")).cast("long")}, {"host": host_sql("value"), "protocol": f"CASE WHEN ({host_sql('value')}) IS NOT NULL THEN {protocol_sql(f'lower(regexp_extract(value, {_URL}, 1))')} END", "port": f"CAST(nullif(regexp_extract(value, {_port}, 1), '') AS BIGINT)"})
add("q_raw_url", "settings", ["seq"], lambda: {"scheme": S.raw_url_parts(F.col("value"))[0], "host": S.raw_url_parts(F.col("value"))[1]}, {"scheme": _nn("regexp_extract(value, '^(.*?)://([^/:]+)', 1)"), "host": _nn("regexp_extract(value, '^(.*?)://([^/:]+)', 2)")})
add("q_jdbc_host", "settings", ["seq"], lambda: {"protocol": S.jdbc_target(F.col("value"))[0], "host": S.jdbc_target(F.col("value"))[1]}, {"protocol": protocol_sql(_nn("regexp_extract(value, '^jdbc:([^:/]+)://([^:/]+)', 1)")), "host": _nn("regexp_extract(value, '^jdbc:([^:/]+)://([^:/]+)', 2)")})
add("q_kafka_host", "settings", ["seq"], lambda: {"host": S.kafka_host(F.col("value"))}, {"host": _nn("split_part(trim(split_part(value, ',', 1)), ':', 1)")})
add("q_hostname_like", "settings", ["seq"], lambda: {"hostname": S.looks_like_hostname(F.col("value"))}, {"hostname": "value <> '' AND NOT contains(value, ' ') AND contains(value, '.') AND NOT contains(value, '://')"})
add("q_first_string", "code", ["line_id"], lambda: {"s": S.first_string(F.col("line"))}, {"s": first_sql("line")})
add("q_second_string", "code", ["line_id"], lambda: {"s": S.second_string(F.col("line"))}, {"s": f"regexp_replace(regexp_extract_all(line, {_QUOTED}, 0)[2], '^.|.$', '', 'g')"})
add("q_named_arg", "code", ["line_id"], lambda: {"s": S.named_arg(F.col("line"), "target")}, {"s": first_sql(f"({cut_sql('line', 'target=')})")})
add("q_url_hostname", "code", ["line_id"], lambda: {"s": S.string_hostname(F.col("line"))}, {"s": f"CASE WHEN contains({first_sql('line')}, '://') THEN regexp_extract({first_sql('line')}, '://([^/]*)', 1) END"})
add("q_process_env", "code", ["line_id"], lambda: {"s": S.process_env_var(F.col("line"))}, {"s": _nn(r"regexp_extract(line, 'process\.env\.([A-Za-z0-9_]+)', 1)")})
add("q_nullish_default", "code", ["line_id"], lambda: {"s": S.nullish_default(F.col("line"))}, {"s": "CASE WHEN contains(line, '??') THEN nullif(regexp_extract(line, '[?][?]\\s*\"([^\"]*)\"', 1), '') WHEN contains(line, '||') THEN nullif(regexp_extract(line, '[|][|]\\s*''([^'']*)''', 1), '') END"})
add("q_or_default", "code", ["line_id"], lambda: {"s": S.or_default(F.col("line"))}, {"s": "CASE WHEN contains(line, '||') THEN nullif(regexp_extract(line, '[|][|]\\s*''([^'']*)''', 1), '') END"})
add("q_unwrap_or", "code", ["line_id"], lambda: {"s": S.unwrap_or_default(F.col("line"))}, {"s": first_sql(f"({cut_sql('line', '.unwrap_or(')})")})
add("q_caps_argument", "code", ["line_id"], lambda: {"s": S.caps_argument(F.col("line"))}, {"s": "CASE WHEN contains(line, '(') AND regexp_matches(regexp_extract(line, '^[^(]*[(][&\\s]*([A-Za-z0-9_]+)', 1), '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') THEN regexp_extract(line, '^[^(]*[(][&\\s]*([A-Za-z0-9_]+)', 1) END"})
add("q_env_parse", "settings", ["seq"], lambda: {"k": S.env_line(F.concat(F.lit("export "), F.col("key"), F.lit("=\""), F.col("value"), F.lit("\" ")))[0], "v": S.env_line(F.concat(F.lit("export "), F.col("key"), F.lit("=\""), F.col("value"), F.lit("\" ")))[1]}, {"k": "key", "v": "value"})
add("q_properties_parse", "settings", ["seq"], lambda: {"k": S.env_line(F.concat(F.col("key"), F.lit(" = "), F.col("value")), False)[0], "v": S.env_line(F.concat(F.col("key"), F.lit(" = "), F.col("value")), False)[1]}, {"k": "key", "v": "value"})
add("q_template_literal", "endpoints", ["seq"], lambda: {"t": S.normal_template(F.concat(F.lit('f"/a/${b.c({d})}/%s'), F.col("path"), F.lit('/#{x}"')))}, {"t": "'/a/{param}/{param}' || replace(path, '{key}', '{param}') || '/{param}'"})
add("q_call_argument", "code", ["line_id"], lambda: {"a": S.call_argument(F.col("line"), F.lit("requests.get"))}, {"a": f"CASE WHEN contains(line, 'requests.get(') THEN {first_sql('line')} END"})
add("q_py_package_name", "deps", ["dep_id"], lambda: {"name": S.requirement_name(F.col("dep"))}, {"name": "CASE WHEN contains(dep, '>') THEN trim(split_part(dep, '>', 1)) WHEN contains(dep, '=') THEN trim(split_part(dep, '=', 1)) WHEN contains(dep, '<') THEN trim(split_part(dep, '<', 1)) WHEN contains(dep, '!') THEN trim(split_part(dep, '!', 1)) WHEN contains(dep, '~') THEN trim(split_part(dep, '~', 1)) WHEN contains(dep, '[') THEN trim(split_part(dep, '[', 1)) WHEN contains(dep, ';') THEN trim(split_part(dep, ';', 1)) WHEN contains(dep, ' ') THEN trim(split_part(dep, ' ', 1)) ELSE trim(dep) END"})
_libs = "[" + ", ".join(f"{{'f': '{a.lower()}', 'p': '{b}'}}" for a, b in S.KNOWN_LIBRARIES) + "]"
_protocols = f"list_transform(list_filter({_libs}, lambda t: contains(lower(dep), t.f)), lambda t: t.p)"
add("q_dep_protocols", "deps", ["dep_id"], lambda: {"protocols": F.array_join(F.array_sort(S.library_protocols(F.col("dep"))), ",")}, {"protocols": f"array_to_string(list_sort(list_distinct({_protocols})), ',')"})
add("q_tool_libraries", "deps", ["dep_id"], lambda: {"blocked": S.is_tool_library(F.col("dep"))}, {"blocked": "regexp_matches(lower(dep), '^(" + "|".join(S.TOOL_LIBRARIES) + ")')"})
add("q_import_lines", "code", ["line_id"], lambda: {"imports": S.imports(F.col("line"), F.lit("lib_http"))}, {"imports": "(contains(line, 'lib_http') OR contains(line, 'lib-http')) AND (regexp_matches(line, '^(import |from |use |extern crate )') OR contains(line, 'require(') OR contains(line, 'from '''))"})
add("q_method_score", "connections", ["seq"], lambda: {"score": S.method_score(F.col("extraction_method")).cast("long")}, {"score": "CAST(CASE WHEN starts_with(extraction_method, 'pattern') THEN 3 WHEN starts_with(extraction_method, 'wrapper_trace') THEN 2 WHEN starts_with(extraction_method, 'library_resolution') THEN 1 ELSE 0 END AS BIGINT)"})
add("q_confidence_demotion", "connections", ["seq"], lambda: {"target": S.demoted(F.nullif("target_name", F.lit("svc1")), F.lit("high"))[0], "confidence": S.demoted(F.nullif("target_name", F.lit("svc1")), F.lit("high"))[1]}, {"target": "CASE WHEN target_name IN ('', 'svc1') THEN '' ELSE target_name END", "confidence": "CASE WHEN target_name IN ('', 'svc1') THEN 'medium' ELSE 'high' END"})
add("q_env_file_priority", "files", ["file_ord"], lambda: {"prio": S.env_file_priority(F.element_at(F.split("rel_path", "/"), -1)).cast("long")}, {"prio": "CAST(CASE WHEN ends_with(rel_path, '/.env') THEN 0 ELSE 4 END AS BIGINT)"})


@query("q_parse_url", f"SELECT page_id, CASE WHEN ({host_sql('url')}) IS NOT NULL THEN {protocol_sql(f'lower(regexp_extract(url, {_URL}, 1))')} END AS protocol, {host_sql('url')} AS host FROM pages")
def q_parse_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.url_protocol(url).alias("protocol"), S.url_host(url).alias("host"))


_SCHEMES = [*S.SCHEMES, "ftp", "nats"]


@query("q_scheme_protocol", f"SELECT CAST(p_partkey AS BIGINT) AS k, {protocol_sql('scheme')} AS protocol FROM (SELECT p_partkey, [{', '.join(map(repr, _SCHEMES))}][1 + p_partkey % {len(_SCHEMES)}] AS scheme FROM part)")
def q_scheme_protocol(spark, sf_dir):
    """A scheme for each part."""
    schemes = F.array(*map(F.lit, _SCHEMES))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.get(schemes, F.col("p_partkey").cast("int") % len(_SCHEMES)).alias("scheme"))
    return parts.select("k", S.scheme_protocol(F.col("scheme")).alias("protocol"))


@query("q_html_paths", r"""SELECT page_id, i, array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN s = '*' THEN '{*}' WHEN starts_with(s, ':') THEN '{param}' ELSE s END), '/') AS path
  FROM (SELECT page_id, unnest(range(len(a))) AS i, unnest(a) AS p FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) AS a FROM pages))""")
def q_html_paths(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("i", "p"))
    return found.select("page_id", F.col("i").cast("long").alias("i"), S.normal_path(F.col("p")).alias("path"))


@query("q_json_reader", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE starts_with(trim(props), '{')")
def q_json_reader(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(S.trimmed(F.col("props")).startswith("{"))
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("q_cosine", "SELECT vec_id, round(CASE WHEN n = 0 THEN 0.0 ELSE d / n END, 6) AS c FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS d, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(len(embedding)::DOUBLE) AS n FROM embeddings)")
def q_cosine(spark, sf_dir):
    ones = F.transform("embedding", lambda _: F.lit(1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), ones), 6).alias("c"))
