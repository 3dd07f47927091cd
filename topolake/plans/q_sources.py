"""Queries over the guards of files, malformed files and sinks."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from topolake.lineage import shared_folder
from topolake.operators import config_files, globs, manifests, relations as R, routes
from topolake.operators.functions_of import cut_files, faults_in
from topolake.plans import scan as scans
from topolake.plans.derived import ctes, derive
from topolake.plans.q_relations import DEDUPED, MERGED
from topolake.plans.registry import query, table
from topolake.sources import document, repository, sinks

#: Files in the part of SQL that Spark and DuckDB share: some too large, with NUL bytes, with a long first line or below excluded directories.
TREE = """SELECT doc_id, 'r' || CAST(doc_id % 25 AS STRING) || CASE doc_id % 6 WHEN 0 THEN '/src' WHEN 1 THEN '/node_modules/x' WHEN 2 THEN '/tests' WHEN 3 THEN '/targets' WHEN 4 THEN '/lib/build' ELSE '/app' END || '/f' || CAST(doc_id AS STRING) || '.py' AS rel_path,
  CASE WHEN doc_id % 97 = 0 THEN repeat('ab' || chr(10), 170667) WHEN doc_id % 97 = 3 THEN repeat('ab' || chr(10), 170666) WHEN doc_id % 11 = 0 THEN text || chr(0) WHEN doc_id % 11 = 1 THEN repeat('y', 8192) || chr(10) || text
    WHEN doc_id % 11 = 2 THEN repeat('y', 8191) || chr(10) || text WHEN doc_id % 11 = 3 THEN repeat('ab' || chr(10), 3000) || chr(0) ELSE text END AS content FROM {documents}"""


@query("q_file_guards", f"""WITH tree AS ({TREE.format(documents="documents")}), sized AS (
    SELECT *, octet_length(encode(content)) AS size, octet_length(encode(split_part(content, chr(10), 1))) AS line, CASE WHEN contains(content, chr(0)) THEN octet_length(encode(split_part(content, chr(0), 1))) ELSE 8192 END AS nul FROM tree WHERE content IS NOT NULL)
  SELECT rel_path, size, md5(content) AS digest FROM sized WHERE NOT regexp_matches(rel_path, '/(node_modules|tests|build)/') AND size <= 512000 AND line < 8192 + CASE WHEN size < 8192 THEN 1 ELSE 0 END AND nul >= 8192 AND doc_id % 13 <> 3""")
def q_file_guards(spark, sf_dir):
    """Files that the guards let through; every thirteenth isn't UTF-8."""
    tree = spark.sql(TREE, documents=table(spark, sf_dir, "documents"))
    data = F.col("content").cast("binary")
    files = tree.select("rel_path", F.when(F.col("doc_id") % 13 == 3, F.concat(F.unhex(F.lit("FF")), data)).otherwise(data).alias("content"))
    return repository.guarded(files).select("rel_path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query("q_faults", """SELECT 'r' || doc_id || '/docker-compose.yml' AS rel_path, 'compose' AS extractor, CASE doc_id % 4 WHEN 0 THEN 'malformed YAML' ELSE 'malformed JSON' END AS error FROM documents WHERE doc_id % 4 < 2
  UNION ALL SELECT 'r' || doc_id || '/k8s/web.yaml', 'kubernetes', 'malformed YAML' FROM documents WHERE doc_id % 4 = 3""")
def q_faults(spark, sf_dir):
    """Files that an extractor picks but can't read; one part of a file with several documents is enough."""
    n = F.col("doc_id")
    made = F.when(n % 4 == 0, "services: [open").when(n % 4 == 1, '{"services": ').when(n % 4 == 2, "services: {a: {}}").otherwise("apiVersion: v1\nkind: Service\n---\nkind: {open\n---\nkind: [open\n")
    path = F.concat(F.lit("r"), n.cast("string"), F.when(n % 4 == 3, "/k8s/web.yaml").otherwise("/docker-compose.yml"))
    return config_files.faults(table(spark, sf_dir, "documents").select(path.alias("rel_path"), made.alias("content")))


@query("q_stage_faults", """SELECT rel_path, extractor, error FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'package.json' WHEN 2 THEN 'src/d' || doc_id || '.ts' WHEN 3 THEN 'src/d' || doc_id || '.rs' WHEN 4 THEN 'src/d' || doc_id || '.py' END AS rel_path,
    CASE WHEN doc_id % 6 < 2 THEN 'manifest' WHEN doc_id % 6 < 4 THEN 'routes' ELSE 'functions' END AS extractor,
    CASE doc_id % 6 WHEN 0 THEN 'malformed TOML' WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'unclosed brackets' WHEN 3 THEN 'unopened brackets' ELSE 'no text' END AS error FROM documents) WHERE rel_path IS NOT NULL""")
def q_stage_faults(spark, sf_dir):
    """Texts that manifests, routes and function bodies can't be read from; the rest of the job goes on."""
    n = F.col("doc_id")
    word = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 2000), r"[^A-Za-z ]", " ")
    name = lambda end: F.concat(F.lit("src/d"), n.cast("string"), F.lit(end))
    path = F.when(n % 6 == 0, "Cargo.lock").when(n % 6 == 1, "package.json").when(n % 6 == 2, name(".ts")).when(n % 6 == 3, name(".rs")).when(n % 6 == 4, name(".py")).otherwise(name(".go"))
    made = F.when(n % 6 == 0, F.concat(F.lit("[[package\n"), word)).when(n % 6 == 1, F.concat(F.lit('{"dependencies": "'), word)).when(n % 6 == 2, F.concat(F.lit('app.get("/x)", (q) => { // })\n/* ) */ `)` '), word))
    made = made.when(n % 6 == 3, F.concat(F.lit("fn a<'x>() {} } // {\n"), word)).when(n % 6 == 5, F.concat(F.lit('func f() { return g("(") }\n'), word))
    files = table(spark, sf_dir, "documents").select(path.alias("rel_path"), made.alias("content")).withColumns({"language": scans.language_of(F.col("rel_path")), "file_ord": F.lit(0)})
    return manifests.faults(files).unionByName(routes.faults(files)).unionByName(faults_in(cut_files(files)))


@query("q_relations_sink", f"{ctes('services')}, {MERGED} SELECT 'parquet' AS form, seq, name, root_path FROM merged UNION ALL SELECT 'json', seq, name, root_path FROM merged")
def q_relations_sink(spark, sf_dir):
    """Merged services as the executors wrote them, in two formats, read again."""
    services = R.merge_services(derive(spark, sf_dir, "services"))
    read = []
    for form in ("parquet", "json"):
        folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
        sinks.write_relations({"services": services}, folder, form)
        read.append(spark.read.format(form).schema(services.schema).load(f"{folder}/services").select(F.lit(form).alias("form"), "seq", "name", "root_path"))
    return read[0].unionByName(read[1])


#: Files, and ignore files below some roots, that a query writes for the walk to find.
LEAVES = """SELECT 'r' || CAST(c_nationkey AS STRING) || '/s' || CAST(c_custkey % 25 AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '/src' WHEN 1 THEN '/node_modules' WHEN 2 THEN '/logs' WHEN 3 THEN '/.own' ELSE '' END
  || CASE c_custkey % 7 WHEN 0 THEN '/keep' WHEN 1 THEN '/.f' ELSE '/f' END || CAST(c_custkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '.tmp' WHEN 1 THEN '.py' ELSE '.js' END AS rel_path, c_name || chr(10) || c_mktsegment AS content FROM {customer}"""
IGNORED = """SELECT 'r' || CAST(n_nationkey AS STRING) || '/.gitignore' AS rel_path, '# own' || chr(10) || '*.tmp' || chr(10) || '!keep*.tmp' || chr(10) || '/s3/' || chr(10) || 'logs/' || chr(10) AS content FROM {nation}
  UNION ALL SELECT 'r' || CAST(n_nationkey AS STRING) || '/s4/.gitignore', '!*.tmp' || chr(10) FROM {nation}"""


def write_tree(files, root: str) -> int:
    """Files (rel_path, content) written by tasks below a folder that all can open; how many."""

    def put(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
                with open(os.path.join(root, path), "w", encoding="utf-8") as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("rel_path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


@query("q_repository_walk", f"""WITH leaves AS ({LEAVES.format(customer="customer")})
  SELECT rel_path, octet_length(encode(content)) AS size, md5(content) AS digest FROM leaves
  WHERE NOT regexp_matches(rel_path, '/(node_modules|logs|[.]own)/|/[.]f[0-9]+[.]|^r[0-9]+/s3/') AND (NOT ends_with(rel_path, '.tmp') OR regexp_matches(rel_path, '/keep[0-9]+[.]tmp$|^r[0-9]+/s4/'))""")
def q_repository_walk(spark, sf_dir):
    """A tree with ignore files, written by tasks, listed a level at a time and read."""
    root = f"{shared_folder(spark).removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    read = lambda sql, name: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    write_tree(read(LEAVES, "customer").union(read(IGNORED, "nation")), root)
    files = repository.read_repository(spark, root)
    return files.select("rel_path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query("q_document_parts", f"""{ctes('services', 'endpoints', 'connections', 'schemas')}, {MERGED}, {DEDUPED}
  SELECT 'service' AS part, name, root_path AS detail FROM merged UNION ALL SELECT 'endpoint', path, method FROM endpoints WHERE service_name IN (SELECT name FROM merged)
  UNION ALL SELECT 'connection', source_service, target_name || '|' || source_file FROM deduped UNION ALL SELECT 'schema', name, extraction_method FROM schemas""")
def q_document_parts(spark, sf_dir):
    """The scan document as tasks wrote it in parts, read again line by line."""
    folder = f"{shared_folder(spark).removeprefix('file:')}/document-{uuid.uuid4().hex}"
    lines = document.lines(R.merge_services(derive(spark, sf_dir, "services")), derive(spark, sf_dir, "endpoints"), R.dedupe_connections(derive(spark, sf_dir, "connections")), derive(spark, sf_dir, "schemas"))
    document.write_parts(lines, folder, {"tool": "cli"})
    text = lambda name: F.get_json_object(F.col("whole"), f"$.{name}")
    services, links, shapes = (document.read_section(spark, folder, s).withColumn("whole", F.regexp_replace("text", r",\"exposes\":\[$", "}")) for s in document.SECTIONS)
    services = services.filter("text != ']}'")
    opened = F.col("text").endswith("[")
    rows = services.select(F.when(opened, "service").otherwise("endpoint").alias("part"), F.when(opened, text("name")).otherwise(text("path")).alias("name"), F.when(opened, text("root_path")).otherwise(text("method")).alias("detail"))
    rows = rows.union(links.select(F.lit("connection"), text("source"), F.concat_ws("|", text("target"), text("source_file"))))
    return rows.union(shapes.select(F.lit("schema"), text("name"), text("extraction_method")))


#: A glob for each part, and its pattern in DuckDB's SQL.
GLOBS = """SELECT CASE k % 6 WHEN 0 THEN '**/f' || k || '.py' WHEN 1 THEN 'r' || (k % 25) || '/s' || (k % 25) || '/**' WHEN 2 THEN '**/s' || (k % 25) || '/**/*' || (k % 10) || '.js'
  WHEN 3 THEN 'r' || (k % 25) || '/**/keep' || k || '*.tmp' WHEN 4 THEN '*/s' || (k % 25) || '/src/f*' || (k % 100) || '.j?' ELSE 'f?' || k || '.py' END AS mask, CASE k % 6 WHEN 0 THEN '^(?:.*/)?f' || k || '[.]py$' WHEN 1 THEN '^r' || (k % 25) || '/s' || (k % 25) || '/.*$'
  WHEN 2 THEN '^(?:.*/)?s' || (k % 25) || '/(?:.*/)?.*' || (k % 10) || '[.]js$' WHEN 3 THEN '^r' || (k % 25) || '/(?:.*/)?keep' || k || '.*[.]tmp$' WHEN 4 THEN '^.*/s' || (k % 25) || '/src/f.*' || (k % 100) || '[.]j.$' ELSE '^f.' || k || '[.]py$' END AS pattern
  FROM (SELECT p_partkey, CAST(p_partkey AS INT) AS k FROM {part})"""


@query("q_glob_index", f"WITH leaves AS ({LEAVES.format(customer='customer')}), globs AS ({GLOBS.format(part='part')}) SELECT rel_path, mask FROM leaves JOIN (SELECT DISTINCT mask, pattern FROM globs) ON regexp_matches(rel_path, pattern)")
def q_glob_index(spark, sf_dir):
    """A glob for each part against a path for each customer."""
    paths = spark.sql(LEAVES, customer=table(spark, sf_dir, "customer")).select("rel_path")
    return globs.matched(paths, spark.sql(GLOBS, part=table(spark, sf_dir, "part")).select(F.col("mask").alias("glob")), []).select("rel_path", F.col("glob").alias("mask"))
