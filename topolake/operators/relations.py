"""Joins, deduplication and assembly of scan findings.

Relations: services (name, root_path, ..., extraction_method, seq), endpoints (service_name, method, path, ...,
extraction_method, seq), connections (source_service, target_name, protocol, method, path, source_file, ...,
extraction_method, seq) and schemas (name, extraction_method, seq).  ``seq`` is a finding's place in discovery order.

Winners are picked by aggregates with a map-side part, not by windows, so a
frequent key costs no more than its partial results.  Spark takes the sizes of rows made from a few columns for far too small, so
no join with a table that grows is left to an estimate: it is by shuffle, or a broadcast once the size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from topolake.functions.strings import method_score, normal_path
from topolake.lineage import cut
from topolake.operators.literals import small

SPECIFIED = ("spec:openapi", "spec:asyncapi")


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def file_of(source_file: Column) -> Column:
    return F.split_part(source_file, F.lit(":"), F.lit(1))


# --- services ---------------------------------------------------------------


def service_roots(services: DataFrame) -> DataFrame:
    """(root_path, service): the last service found at a root names the files below it."""
    return services.groupBy("root_path").agg(F.max_by("name", "seq").alias("service"))


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it; the top is an empty string."""
    parts = F.split(directory, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), prefixes))


def scope(files: DataFrame, services: DataFrame) -> DataFrame:
    """files (rel_path, ...) with ``service`` of the nearest directory that is a service root; null without one.

    Solved for distinct directories by an equality join on their ancestors; the top, which is above all, is a row of its own.
    """
    directory = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    placed = files.withColumn("_dir", directory)
    roots = cut(service_roots(services))
    above = placed.select("_dir").distinct().select("_dir", F.explode(F.filter(ancestors(F.col("_dir")), lambda a: a != "")).alias("root_path"))
    nearest = above.join(small(roots), "root_path").groupBy("_dir").agg(F.max_by("service", F.length("root_path")).alias("_near"))
    top = roots.filter("root_path = ''").select(F.col("service").alias("_top"))
    found = placed.hint("merge").join(nearest, "_dir", "left").join(F.broadcast(top), F.lit(True), "left")
    return found.withColumn("service", F.coalesce("_near", "_top")).drop("_dir", "_near", "_top")


def merge_services(services: DataFrame) -> DataFrame:
    """One service a root: the first found, but a compose service takes a dockerfile's place."""
    row = _whole(services)
    compose = F.when(F.col("extraction_method") == "compose", row)
    best = services.groupBy("root_path").agg(F.min_by(row, "seq").alias("first"), F.min_by(compose, F.when(compose.isNotNull(), F.col("seq"))).alias("compose"))
    pick = F.when((F.col("first.extraction_method") == "dockerfile") & F.col("compose").isNotNull(), F.col("compose")).otherwise(F.col("first"))
    return best.select(pick.alias("s")).select("s.*").select(*services.columns)


def infer_root(services: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """services, or one row for the whole repository where there is none but ``others`` has rows."""
    inferred = {"name": name, "root_path": ".", "language": "", "service_type": "service", "confidence": "high", "extraction_method": "inferred_root", "seq": 0}
    row = others.limit(1).select(*[F.lit(inferred.get(f.name)).cast(f.dataType).alias(f.name) for f in services.schema])
    has = services.limit(1).select(F.lit(1).alias("_has"))
    return services.unionByName(row.join(F.broadcast(has), F.lit(True), "left_anti"))  # has is one row at most


def ignore_services(services: DataFrame, endpoints: DataFrame, connections: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without what overrides (root_path, ignored, new_name) say to ignore; findings go where their service's name is the root."""
    gone = overrides.filter("ignored").select(F.col("root_path").alias("_gone")).distinct()
    keep = lambda df, column: df.join(gone, df[column] == gone["_gone"], "left_anti")
    return keep(services, "root_path"), keep(endpoints, "service_name"), keep(connections, "source_service")


def rename_services(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """df with ``column`` renamed where ``key`` is an override's root."""
    names = overrides.filter("new_name is not null").groupBy(F.col("root_path").alias("_root")).agg(F.max("new_name").alias("_name"))
    return df.join(names, df[key] == names["_root"], "left").withColumn(column, F.coalesce("_name", column)).drop("_root", "_name")


# --- endpoints and schemas --------------------------------------------------


def drop_specified_endpoints(endpoints: DataFrame) -> DataFrame:
    """Without rows from code that a specification covers by service, method and path."""
    keys = ["service_name", "method", "path"]
    specified = endpoints.filter(F.col("extraction_method").isin(*SPECIFIED))
    code = endpoints.filter(~F.col("extraction_method").isin(*SPECIFIED))
    return code.join(small(specified.select(*keys).distinct()), keys, "left_anti").unionByName(specified)


def drop_specified_schemas(schemas: DataFrame) -> DataFrame:
    specified = schemas.filter(F.col("extraction_method").startswith("spec:"))
    code = schemas.filter(~F.col("extraction_method").startswith("spec:"))
    return code.join(small(specified.select("name").distinct()), "name", "left_anti").select(*schemas.columns).unionByName(specified)


# --- connections ------------------------------------------------------------


def drop_covered_wrappers(findings: DataFrame) -> DataFrame:
    """Without wrapper calls in files where another finding has the same protocol."""
    wrapper = F.col("extraction_method").startswith("wrapper_trace")
    keyed = findings.withColumn("_file", file_of(F.col("source_file")))
    other = keyed.filter(~wrapper).select("_file", "protocol").distinct()
    kept = keyed.filter(wrapper).hint("merge").join(other, ["_file", "protocol"], "left_anti").select(*findings.columns)
    return findings.filter(~wrapper).unionByName(kept)


def dedupe_connections(connections: DataFrame) -> DataFrame:
    """Of each file, protocol and target the row of the surest method, the first found of those, of one place the least by its other columns, so that the result doesn't hang on how rows are dealt out."""
    row = _whole(connections)
    best = connections.groupBy("source_file", "protocol", "target_name").agg(F.min_by(row, F.struct(-method_score(F.col("extraction_method")), F.col("seq"), row)).alias("c"))
    return best.select("c.*")


def resolve_targets(connections: DataFrame, endpoints: DataFrame) -> DataFrame:
    """connections whose method and path an endpoint answers get its service as target; of several endpoints the last found.

    Those without a method or path, often the most, are dealt out by their file, as all would meet in one task by their key.
    """
    key = lambda method, path: [F.upper(method).alias("_method"), normal_path(F.col(path)).alias("_path")]
    answers = endpoints.groupBy(*key("method", "path")).agg(F.max_by("service_name", "seq").alias("_service"))
    keyed = connections.withColumns({"_method": F.upper("method"), "_path": normal_path(F.col("path"))})
    keyed = keyed.withColumn("_deal", F.when(F.col("_method").isNull() | F.col("_path").isNull(), F.xxhash64("source_file")).otherwise(F.lit(0).cast("long")))
    return keyed.join(small(answers.withColumn("_deal", F.lit(0).cast("long"))), ["_method", "_path", "_deal"], "left").withColumn("target_name", F.coalesce("_service", "target_name")).select(*connections.columns)


# --- order ------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with a dense number from ``start`` on in the given order, of equal rows in any.

    Rows are dealt out by ranges, sorted and stored; a row's place in its range and the sum of the ranges before it make its number, so
    what comes to the driver is one count a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = cut(rows)  # else the sample that sets the ranges would compute them once more
    placed = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = start, {}
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets[r["p"]], before = before, before + r["count"]
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long")).limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv]), part)
    return placed.withColumn(name, (offset + within).cast("long")).drop("_place")


# --- payload ----------------------------------------------------------------


def _to_first(services: DataFrame, grouped: DataFrame, none: Column) -> DataFrame:
    """services with the last column of grouped (service_name, ...), which of services of one name only the first has; the others have none."""
    name = grouped.columns[-1]
    first = services.groupBy(F.col("name").alias("_name")).agg(F.min("seq").alias("_first"))
    owner = first.hint("merge").join(grouped, first["_name"] == grouped["service_name"]).select("_name", "_first", F.col(name).alias("_own"))
    joined = services.hint("merge").join(owner, (services["name"] == owner["_name"]) & (services["seq"] == owner["_first"]), "left")
    return joined.withColumn(name, F.coalesce("_own", none)).drop("_name", "_first", "_own")


def exposed(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """services with ``exposes``, their endpoints in order; of services of one name only the first has them."""
    row = F.struct("seq", *[c for c in endpoints.columns if c not in ("seq", "service_name")])
    grouped = endpoints.groupBy("service_name").agg(F.array_sort(F.collect_list(row)).alias("exposes"))
    return _to_first(services, grouped, F.array().cast(grouped.schema["exposes"].dataType))


def exposed_counts(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """services with ``n``, the number of endpoints that ``exposed`` gives them; none are gathered."""
    return _to_first(services, endpoints.groupBy("service_name").agg(F.count("*").alias("n")), F.lit(0).cast("long"))


def payload(services: DataFrame, connections: DataFrame, schemas: DataFrame, metadata: dict[str, object]) -> DataFrame:
    """One row: the scan document.  It is the report of one repository, so its parts are gathered as lists."""
    gather = lambda df, row, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x.r).alias("rows"))
    service = F.struct("name", "root_path", "language", F.col("service_type").alias("type"), "boundary_entry", "exposes", "confidence", "extraction_method")
    link = F.struct(F.col("source_service").alias("source"), F.col("target_name").alias("target"), *[c for c in ("protocol", "method", "path", "source_file", "confidence", "extraction_method", "dependency", "evidence") if c in connections.columns])
    shape = F.struct(*[c for c in schemas.columns if c != "seq"])
    parts = [gather(services, service, F.struct("root_path", "name")), gather(connections, link, F.col("seq")), gather(schemas, shape, F.col("seq"))]
    one = lambda df, name: df.select(F.lit(1).alias("_one"), F.col("rows").alias(name))
    joined = one(parts[0], "services").join(one(parts[1], "connections"), "_one").join(one(parts[2], "schemas"), "_one")
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    return joined.select(F.lit("1.0").alias("version"), meta.alias("metadata"), "services", "connections", "schemas", F.array().alias("actors"))


def payload_json(document: DataFrame) -> DataFrame:
    """The document as text, nulls written out."""
    return document.select(F.to_json(F.struct(*[F.col(c) for c in document.columns if c != "actors"]), {"ignoreNullFields": "false"}).alias("json"))
