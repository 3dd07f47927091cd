"""Queries over merged findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from topolake.operators import refine as refining, relations as R, variables as V
from topolake.plans.derived import ctes, derive
from topolake.plans.registry import query, table

_NORMAL = "array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN starts_with(s, ':') OR (starts_with(s, '{') AND ends_with(s, '}')) THEN '{param}' WHEN s = '*' THEN '{*}' ELSE s END), '/')"
_SCORE = "CASE WHEN starts_with(extraction_method, 'pattern') THEN 3 WHEN starts_with(extraction_method, 'wrapper_trace') THEN 2 WHEN starts_with(extraction_method, 'library_resolution') THEN 1 ELSE 0 END"
MERGED = """merged AS (SELECT * EXCLUDE (rn) FROM (SELECT s.*, row_number() OVER (PARTITION BY root_path ORDER BY CASE WHEN first_method = 'dockerfile' AND extraction_method = 'compose' THEN 0 ELSE 1 END, seq) AS rn
  FROM (SELECT *, first_value(extraction_method) OVER (PARTITION BY root_path ORDER BY seq) AS first_method FROM services) s) WHERE rn = 1)"""
DEDUPED = f"deduped AS (SELECT * FROM connections QUALIFY row_number() OVER (PARTITION BY source_file, protocol, target_name ORDER BY {_SCORE} DESC, seq) = 1)"
ANSWERS = f"answers AS (SELECT upper(method) AS m, {_NORMAL} AS p, arg_max(service_name, seq) AS service FROM endpoints GROUP BY ALL)"
RESOLVED = f"resolved AS (SELECT c.* REPLACE (coalesce(a.service, c.target_name) AS target_name) FROM (SELECT *, upper(method) AS m, {_NORMAL} AS p FROM deduped) c LEFT JOIN answers a ON c.m = a.m AND c.p = a.p)"


@query("q_service_merge", f"{ctes('services')}, {MERGED} SELECT root_path, name, extraction_method, seq FROM merged")
def q_service_merge(spark, sf_dir):
    return R.merge_services(derive(spark, sf_dir, "services")).select("root_path", "name", "extraction_method", "seq")


@query("q_service_roots", f"{ctes('services')} SELECT root_path, arg_max(name, seq) AS service FROM services GROUP BY root_path")
def q_service_roots(spark, sf_dir):
    return R.service_roots(derive(spark, sf_dir, "services"))


@query("q_scope_nearest", f"""{ctes('services', 'files')}, roots AS (SELECT root_path, arg_max(name, seq) AS service FROM services GROUP BY root_path)
  SELECT f.file_ord, f.rel_path, arg_max(r.service, length(r.root_path)) AS service FROM files f LEFT JOIN roots r ON starts_with(f.rel_path, r.root_path || '/') GROUP BY ALL""")
def q_scope_nearest(spark, sf_dir):
    return R.scope(derive(spark, sf_dir, "files"), derive(spark, sf_dir, "services")).select("file_ord", "rel_path", "service")


@query("q_spec_endpoint_antijoin", f"""{ctes('endpoints')}, spec AS (SELECT * FROM endpoints WHERE extraction_method IN ('spec:openapi', 'spec:asyncapi'))
  SELECT seq, service_name, method, path FROM endpoints e WHERE extraction_method IN ('spec:openapi', 'spec:asyncapi')
  OR NOT EXISTS (SELECT 1 FROM spec s WHERE s.service_name = e.service_name AND s.method = e.method AND s.path = e.path)""")
def q_spec_endpoint_antijoin(spark, sf_dir):
    return R.drop_specified_endpoints(derive(spark, sf_dir, "endpoints")).select("seq", "service_name", "method", "path")


@query("q_spec_schema_antijoin", f"""{ctes('schemas')} SELECT seq, name, extraction_method FROM schemas s WHERE starts_with(extraction_method, 'spec:')
  OR NOT EXISTS (SELECT 1 FROM schemas t WHERE t.name = s.name AND starts_with(t.extraction_method, 'spec:'))""")
def q_spec_schema_antijoin(spark, sf_dir):
    return R.drop_specified_schemas(derive(spark, sf_dir, "schemas")).select("seq", "name", "extraction_method")


@query("q_wrapper_suppress", f"""{ctes('connections')}, findings AS (SELECT * FROM connections WHERE extraction_method <> 'spec:env'),
  others AS (SELECT DISTINCT split_part(source_file, ':', 1) AS f, protocol FROM findings WHERE NOT starts_with(extraction_method, 'wrapper_trace'))
  SELECT seq, source_file, protocol FROM findings c WHERE (NOT starts_with(extraction_method, 'wrapper_trace') OR NOT EXISTS (SELECT 1 FROM others o WHERE o.f = split_part(c.source_file, ':', 1) AND o.protocol = c.protocol))""")
def q_wrapper_suppress(spark, sf_dir):
    findings = derive(spark, sf_dir, "connections").filter("extraction_method <> 'spec:env'")
    return R.drop_covered_wrappers(findings).select("seq", "source_file", "protocol")


@query("q_priority_dedup", f"{ctes('connections')}, {DEDUPED} SELECT seq, source_file, protocol, target_name, extraction_method FROM deduped")
def q_priority_dedup(spark, sf_dir):
    return R.dedupe_connections(derive(spark, sf_dir, "connections")).select("seq", "source_file", "protocol", "target_name", "extraction_method")


@query("q_resolve_targets", f"{ctes('connections', 'endpoints')}, {ANSWERS}, deduped AS (SELECT * FROM connections), {RESOLVED} SELECT seq, target_name FROM resolved")
def q_resolve_targets(spark, sf_dir):
    return R.resolve_targets(derive(spark, sf_dir, "connections"), derive(spark, sf_dir, "endpoints")).select("seq", "target_name")


@query("q_endpoint_keys", f"{ctes('endpoints')}, {ANSWERS} SELECT m, p, service FROM answers")
def q_endpoint_keys(spark, sf_dir):
    endpoints = derive(spark, sf_dir, "endpoints")
    return endpoints.groupBy(F.upper("method").alias("m"), R.normal_path(F.col("path")).alias("p")).agg(F.max_by("service_name", "seq").alias("service"))


@query("q_infer_root", f"{ctes('endpoints')} SELECT 'repo' AS name, '.' AS root_path, 'inferred_root' AS extraction_method FROM endpoints LIMIT 1")
def q_infer_root(spark, sf_dir):
    services = derive(spark, sf_dir, "services").filter("name = 'none'")
    return R.infer_root(services, derive(spark, sf_dir, "endpoints"), "repo").select("name", "root_path", "extraction_method")


@query("q_override_ignore", f"{ctes('services', 'overrides')} SELECT seq, name, root_path FROM services WHERE root_path NOT IN (SELECT root_path FROM overrides WHERE ignored)")
def q_override_ignore(spark, sf_dir):
    parts = [derive(spark, sf_dir, n) for n in ("services", "endpoints", "connections", "overrides")]
    return R.ignore_services(*parts)[0].select("seq", "name", "root_path")


@query("q_override_rename", f"{ctes('services', 'overrides')} SELECT s.seq, coalesce(o.new_name, s.name) AS name, s.root_path FROM services s LEFT JOIN overrides o ON s.root_path = o.root_path AND o.new_name IS NOT NULL")
def q_override_rename(spark, sf_dir):
    return R.rename_services(derive(spark, sf_dir, "services"), derive(spark, sf_dir, "overrides"), "root_path", "name").select("seq", "name", "root_path")


@query("q_union_findings", f"{ctes('connections')} SELECT protocol, extraction_method, count(*) AS n FROM (SELECT * FROM connections UNION ALL SELECT * FROM connections WHERE protocol = 'rest') GROUP BY ALL")
def q_union_findings(spark, sf_dir):
    connections = derive(spark, sf_dir, "connections")
    return connections.unionByName(connections.filter("protocol = 'rest'")).groupBy("protocol", "extraction_method").agg(F.count("*").alias("n"))


@query("q_payload_nest", f"""{ctes('services', 'endpoints')}, {MERGED}, firsts AS (SELECT name, min(seq) AS first FROM merged GROUP BY name)
  SELECT m.seq, m.name, m.root_path, CASE WHEN f.first = m.seq THEN coalesce(e.exposes, '') ELSE '' END AS exposes
  FROM merged m JOIN firsts f ON f.name = m.name LEFT JOIN (SELECT service_name, string_agg(method || ' ' || path, ';' ORDER BY seq) AS exposes FROM endpoints GROUP BY service_name) e ON e.service_name = m.name""")
def q_payload_nest(spark, sf_dir):
    nested = R.exposed(R.merge_services(derive(spark, sf_dir, "services")), derive(spark, sf_dir, "endpoints"))
    text = F.array_join(F.transform("exposes", lambda e: F.concat_ws(" ", e.method, e.path)), ";")
    return nested.select("seq", "name", "root_path", text.alias("exposes"))


@query("q_payload_document", f"""{ctes('services', 'connections')}, {MERGED}, {DEDUPED} SELECT (SELECT count(*) FROM merged) AS n_services, (SELECT count(*) FROM deduped) AS n_connections, '1.0' AS version, 'cli' AS tool""")
def q_payload_document(spark, sf_dir):
    services = R.exposed(R.merge_services(derive(spark, sf_dir, "services")), derive(spark, sf_dir, "endpoints"))
    document = R.payload(services, R.dedupe_connections(derive(spark, sf_dir, "connections")), derive(spark, sf_dir, "schemas"), {"tool": "cli", "scan_mode": "full"})
    return document.select(F.size("services").cast("long").alias("n_services"), F.size("connections").cast("long").alias("n_connections"), "version", "metadata.tool")


@query("q_topology", f"""{ctes('services', 'endpoints', 'connections')}, {MERGED}, {DEDUPED}, {ANSWERS}, {RESOLVED}
  SELECT m.name AS service, m.root_path, coalesce(e.n, 0) AS n_endpoints, r.protocol, r.target_name AS target, r.n AS n_connections
  FROM merged m JOIN (SELECT source_service, protocol, target_name, count(*) AS n FROM resolved GROUP BY ALL) r ON r.source_service = m.name
  LEFT JOIN (SELECT service_name, count(*) AS n FROM endpoints GROUP BY ALL) e ON e.service_name = m.name""")
def q_topology(spark, sf_dir):
    """Which service exposes how many endpoints and calls whom."""
    endpoints = derive(spark, sf_dir, "endpoints")
    resolved = R.resolve_targets(R.dedupe_connections(derive(spark, sf_dir, "connections")), endpoints)
    calls = resolved.groupBy("source_service", "protocol", F.col("target_name").alias("target")).agg(F.count("*").alias("n_connections"))
    counts = endpoints.groupBy("service_name").agg(F.count("*").alias("n"))
    services = R.merge_services(derive(spark, sf_dir, "services"))
    joined = services.join(calls, services["name"] == calls["source_service"]).join(counts, services["name"] == counts["service_name"], "left")
    return joined.select(F.col("name").alias("service"), "root_path", F.coalesce("n", F.lit(0)).alias("n_endpoints"), "protocol", "target", "n_connections")


@query("q_env_layers", f"{ctes('settings')} SELECT key, value, CAST(layer AS BIGINT) AS layer FROM settings QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, prio DESC, seq DESC) = 1")
def q_env_layers(spark, sf_dir):
    return V.layered(derive(spark, sf_dir, "settings")).withColumn("layer", F.col("layer").cast("long"))


@query("q_content_hash", "SELECT source, sha256(string_agg(doc_id || ':' || n_chars || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR), n_chars)) AS sha FROM documents GROUP BY source")
def q_content_hash(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"))
    return V.content_hash(files, "source")


@query("q_scan_counts", f"{ctes('endpoints', 'connections')} SELECT (SELECT count(*) FROM endpoints) AS endpoints, (SELECT count(*) FROM connections) AS connections, (SELECT count(DISTINCT split_part(source_file, ':', 1)) FROM connections) AS files")
def q_scan_counts(spark, sf_dir):
    counted = derive(spark, sf_dir, "connections").agg(F.count("*").alias("connections"), F.count_distinct(R.file_of(F.col("source_file"))).alias("files"))
    return derive(spark, sf_dir, "endpoints").agg(F.count("*").alias("endpoints")).join(F.broadcast(counted), F.lit(True))  # one row each


@query("q_centroid", "SELECT CAST(label AS BIGINT) AS label, i AS pos, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def q_centroid(spark, sf_dir):
    found = refining.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select(F.col("label").cast("long").alias("label"), F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"))


@query("q_cosine_refine", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  s AS (SELECT vec_id, list_cosine_similarity(v, list_transform(range(len(v)), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS s, list_cosine_similarity(v, list_transform(range(len(v)), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS n FROM e),
  t AS (SELECT vec_id, CASE WHEN s + n > 0 THEN greatest(0.0, least(1.0, s / (s + n))) WHEN s > n THEN 0.75 ELSE 0.5 END AS score FROM s)
  SELECT vec_id, round(score, 5) AS score, CASE WHEN score >= 0.68 THEN 'high' WHEN score >= 0.42 THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def q_cosine_refine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit("x").alias("evidence"), F.lit("medium").alias("confidence"))
    width = 64
    near = lambda odd: F.array(*[F.lit(float(i % 2 == odd)) for i in range(width)])
    scored = rows.select("vec_id", refining.score(refining.cosine(F.col("embedding"), near(0)), refining.cosine(F.col("embedding"), near(1))).alias("score"))
    return scored.select("vec_id", F.round("score", 5).alias("score"), refining.band(F.col("score")).alias("confidence"))


@query("q_discovery_order", f"""{ctes('connections')} SELECT source_file, protocol, target_name, row_number() OVER (ORDER BY source_file, protocol, target_name) - 1 AS number FROM connections""")
def q_discovery_order(spark, sf_dir):
    """Places of discovery over the whole table, without a task that sees all rows."""
    order = ["source_file", "protocol", "target_name"]
    return R.numbered(derive(spark, sf_dir, "connections").select(*order), order, "number")
