"""HTTP routes in source code.

A framework is one row of a table: which manifest shows it, which calls, decorators or attributes are
routes and which of their arguments count.  All are found in one pass over the calls of files; a framework's routes
count only if its gate is open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from topolake.operators.calls import arguments, calls, string_arguments, strings, unquoted
from topolake.operators.lines import DOUBLE, SINGLE, TICKS, lines_of, without_comments
from topolake.operators.relations import scope

#: Verbs of each framework.
EXPRESS_VERBS = "get|post|put|delete|patch|head|options|all"
GO_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|ANY|HANDLE|USE"
CHI_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|HANDLE"
NEXT_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: The routes of a resource, (verb, suffix, action).
RESOURCES = (("GET", "", "index"), ("POST", "", "create"), ("GET", "/new", "new"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PUT", "/:id", "update"), ("DELETE", "/:id", "destroy"))
#: Verbs that the text of a handler is searched for, in this order.
HANDLER_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


GO_NAME = r"^[A-Za-z_]\w*\."


@dataclass(frozen=True)
class Framework:
    """manifest and marker: patterns of a file name and its content that open the gate.
    callee: the name of the calls, decorators or attributes that are routes, its group the verb.  inside: what must stand around them.
    path: the string among the arguments, or of the named ones the last.  optional: a route without one.  more: another argument must follow.
    handler: "last" (a name that ends the call), "rest" (what follows the path), "declared" or "declared_out" (what it stands before).
    prefix: the call whose first string in the file, or "class" if that of the class, comes before the path.
    unscoped: the service where none holds the file; None drops the route."""

    name: str
    files: str
    manifest: str
    marker: str
    callee: str
    tag: str
    verb: Callable[[Column], Column] = F.upper
    path: Callable[[Column], Column] = lambda p: p
    names: str = ""
    optional: bool = False
    more: bool = False
    inside: str = ""
    handler: str = ""
    prefix: str = ""
    content: str = "."
    confidence: str = "high"
    unscoped: str | None = ""


SCRIPT = r"\.(ts|tsx|js|jsx)$"
GET, NONE = (lambda v: F.lit("GET")), (lambda v: F.lit(""))
ASPNET = r"Microsoft\.AspNetCore|Sdk=\"Microsoft\.NET\.Sdk\.Web\""
FRAMEWORKS = (
    Framework("express", SCRIPT, r"package\.json$", '"express"', rf"^(?:app|router|api|r|v1|v2)\.({EXPRESS_VERBS})$", "ast_express", handler="last"),
    Framework("nestjs", SCRIPT, r"package\.json$", '"@nestjs/core"', r"^@(Get|Post|Put|Delete|Patch)$", "ast_nestjs_two_phase", optional=True, prefix="@Controller"),
    Framework("fastify", SCRIPT, r"package\.json$", '"fastify"', rf"^(?:fastify|app|instance|server|f)\.({EXPRESS_VERBS})$", "ast_fastify", handler="last", content="fastify"),
    Framework("fastapi", r"\.py$", r"(requirements\.txt|pyproject\.toml)$", "fastapi|flask|Flask", r"^@\w+\.(get|post|put|delete|patch|head|options)$", "python_fastapi_flask_decorator", handler="declared"),
    Framework("django", r"\.py$", r"(requirements\.txt|pyproject\.toml)$", "django|Django", "^(path|re_path|url)$", "python_django_urlpatterns", verb=GET, inside=r"^urlpatterns = \[$", more=True, handler="next", confidence="medium"),
    Framework("gin", r"\.go$", r"go\.mod$", r"gin-gonic/gin|labstack/echo|gofiber/fiber", rf"{GO_NAME}(\w*(?i:{GO_VERBS})\w*)$", "go-gin-echo-fiber-route", more=True, handler="last", unscoped=None),
    Framework("chi", r"\.go$", r"go\.mod$", "go-chi/chi", rf"{GO_NAME}(\w*(?i:{CHI_VERBS})\w*)$", "go-chi-route", more=True, handler="last", unscoped=None),
    Framework("gorilla", r"\.go$", r"go\.mod$", "gorilla/mux", rf"{GO_NAME}(\w+)$", "go-gorilla-mux-route", verb=NONE, handler="last", confidence="medium", unscoped=None),
    Framework("nethttp", r"\.go$", "", "", r"^(?:http|mux|r|router)\.(HandleFunc|Handle)$", "go-http-handlefunc", verb=NONE, more=True, handler="last", confidence="medium", unscoped=None),
    Framework("spring", r"\.java$", r"(pom\.xml|build\.gradle)$", "spring-boot-starter", "^@(Get|Post|Put|Delete|Patch)Mapping$", "java_spring_boot", names="value|path", optional=True, handler="declared", prefix="class", unscoped="unknown"),
    Framework("aspnet", r"\.cs$", r"\.csproj$", ASPNET, "^Http(Get|Post|Put|Delete|Patch)$", "csharp-attribute", path=lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)), inside=r"\[$", handler="declared_out", confidence="medium", unscoped="unknown"),
    Framework("minimal_api", r"\.cs$", r"\.csproj$", ASPNET, r"\.Map(Get|Post|Put|Delete)$", "csharp-minimal-api", unscoped="unknown"),
    Framework("actix", r"\.rs$", r"Cargo\.toml$", "actix-web", "^(get|post|put|delete|patch|head|options)$", "ast_actix_macro", inside=r"# \[$", handler="declared_out"),
    Framework("axum", r"\.rs$", r"Cargo\.toml$", "axum", r"^\.([a-z_]+)$", "ast_axum_route", verb=lambda v: v, more=True, handler="rest"),
)
#: Frameworks whose routes are lines: a verb and a string.
LINES = r"(?:^|\n)\s*(get|post|put|patch|delete|root|match)\s+[\"']([^\"']*)[\"']"
BY_LINE = (("rails", r"routes\.rb$", r"Gemfile$", "[\"']rails[\"']"), ("sinatra", r"\.rb$", r"Gemfile$", "[\"']sinatra[\"']"))
#: Files of resources, and those whose path is a route.
RESOURCE_FILES, NEXT_APP, NEXT_PAGES = r"routes\.rb$", r"(^|/)app/(.*/)?route\.(ts|tsx|js|jsx)$", r"(^|/)pages/api/.*\.(ts|tsx|js|jsx)$"
#: Extraction methods of routes that aren't calls.
NEXT_TAG, LINE_TAG, RESOURCE_TAGS = "nextjs_api_routes", "ast_rails_route", ("ast_rails_resources", "ast_rails_resource")
#: Decorators of a class whose last string comes before the paths of its methods.
CLASS_MARK = "^@(RestController|Controller|RequestMapping)$"


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def gates(files: DataFrame, names: set[str] | None = None) -> DataFrame:
    """(framework) of each framework, of ``names`` or of all, that some manifest shows; at most one row a framework."""
    gated = [(f.name, f.manifest, f.marker) for f in FRAMEWORKS] + [(name, manifest, marker) for name, _, manifest, marker in BY_LINE]
    gated = [g for g in gated if names is None or g[0] in names]
    shown = F.filter(F.array(*[F.when((F.lit(manifest == "")) | (F.col("rel_path").rlike(manifest) & F.col("content").rlike(marker)), name) for name, manifest, marker in gated]), lambda x: x.isNotNull())
    return files.select(F.explode(shown).alias("framework")).distinct()


def with_prefixes(found: list[tuple]) -> list[tuple[str | None, str | None] | None]:
    """Of each of a text's calls, as ``calls_of`` gives them, the last string of the decorators of the class around it, and the first string of the text's first @Controller; None for a class."""
    marks, classes, out, controller = {}, {}, [], None
    for call, _, _, args in found:
        if call.callee == "@Controller" and controller is None:
            controller = (string_arguments(args) or [None])[:1]
        if call.callee == "class":  # it lies around the level below its own
            classes[call.level] = marks.pop(call.level, "")
            out.append(None)
            continue
        out.append(classes.get(call.level - 1))
        if re.match(CLASS_MARK, call.callee):
            for mark in string_arguments(args, ("value", "path"))[-1:]:
                marks[call.level] = mark
    of_file = controller[0] if controller else None
    return [None if call.callee == "class" else (of_class, of_file) for (call, *_), of_class in zip(found, out, strict=True)]


def call_routes(files: DataFrame, frameworks: tuple[Framework, ...] = FRAMEWORKS) -> DataFrame:
    """Routes that are calls, decorators or attributes, of all frameworks in one pass; a file meets those of its own kind alone."""
    kinds = {f.files: [g for g in frameworks if g.files == f.files] for f in frameworks}
    kind = F.coalesce(*[F.when(F.col("rel_path").rlike(k), i) for i, k in enumerate(kinds)])
    own = files.filter(F.col("rel_path").rlike(any_of(kinds))).withColumns({"fastify": F.col("content").contains("fastify"), "kind": kind})
    wanted = any_of([*dict.fromkeys(f.callee for f in FRAMEWORKS), CLASS_MARK, "^class$"])  # of all: they stand among the arguments of others
    counts = [any_of(dict.fromkeys(f.callee for f in k)) for k in kinds.values()]
    found = calls(own, wanted, ["service", "fastify", "kind"], ("of_class string, of_file string", with_prefixes), ("kind", counts))
    texts = arguments(F.col("args"))
    kinds_of = {n: f"_strings_{i}" for i, n in enumerate(dict.fromkeys(f.names for f in frameworks))}
    found = found.withColumns({"_texts": texts, "_bare": F.transform(texts, unquoted)} | {c: strings(F.col("args"), n) for n, c in kinds_of.items()})
    rows = []
    for f in frameworks:
        named = F.col(kinds_of[f.names])
        string = F.element_at(named, -1) if f.names else F.get(named, 0)
        string = F.when(F.size(named) > 0, string)
        at = F.array_position("_bare", string)
        rest = F.filter(F.slice("_texts", F.greatest(at, F.lit(1)).cast("int") + 1, F.size("_texts")), lambda a: a != "")
        name = lambda a: F.when(a.rlike(r"^[A-Za-z_$][\w$.:]*$"), a)
        handler = {
            "last": F.when(F.size(rest) > 0, name(F.element_at(rest, -1))), "next": F.when(F.size(rest) > 0, F.regexp_extract(F.get(rest, 0), r"^[\w.]*", 0)), "rest": F.array_join(rest, ","),
            "declared": F.col("declared"), "declared_out": F.col("declared_out"), "": F.lit(None).cast("string"),
        }[f.handler]
        verb = f.verb(F.regexp_extract("callee", f.callee, 1))
        if f.name == "axum":
            verb = F.lit("GET")
            for v in reversed(HANDLER_VERBS):
                verb = F.when(F.lower(handler).contains(f"{v.lower()}("), v).otherwise(verb)
        path = f.path(F.coalesce(string, F.lit("")))
        if f.prefix:
            path = F.concat(F.coalesce(F.col("of_class") if f.prefix == "class" else F.col("of_file"), F.lit("")), path)
        fits = (F.col("kind") == [*kinds].index(f.files)) & F.col("callee").rlike(f.callee)
        if f.inside:
            fits &= F.col("inside").rlike(f.inside)
        if not f.optional:
            fits &= string.isNotNull()
        if f.more:
            fits &= F.size(rest) > 0
        if f.content == "fastify":
            fits &= F.col("fastify")
        if f.unscoped is None:
            fits &= F.col("service").isNotNull()
        if f.handler == "declared" and f.name == "fastapi":
            fits &= F.col("declared").isNotNull() & (string != "")
        if f.name == "django":
            fits &= string != ""
        values = [
            F.coalesce("service", F.lit(f.unscoped or "")).alias("service_name"), verb.alias("method"), path.alias("path"), handler.alias("handler"), F.lit("rest").alias("kind"),
            F.lit(f.confidence).alias("confidence"), F.lit(f.tag).alias("extraction_method"), F.lit(f.name).alias("framework"),
        ]
        rows.append(F.when(fits, F.struct(*values)))
    each = found.select("rel_path", F.explode_outer(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).filter("r is not null")  # outer: else all frameworks are tried once more to see that there is a route
    return each.select("r.service_name", "r.method", "r.path", "r.handler", "r.kind", "r.confidence", "r.extraction_method", "rel_path", "r.framework")


def line_routes(files: DataFrame, service: Column) -> DataFrame:
    found = None
    for name, pattern, _, _ in BY_LINE:
        group = lambda i: F.regexp_extract_all("content", F.lit(LINES), F.lit(i))
        rows = files.filter(F.col("rel_path").rlike(pattern)).withColumn("m", F.explode(F.arrays_zip(group(1).alias("verb"), group(2).alias("path")))).select(
            F.coalesce(service, F.lit("")).alias("service_name"), F.upper("m.verb").alias("method"), F.col("m.path").alias("path"), F.lit(None).cast("string").alias("handler"), F.lit("rest").alias("kind"),
            F.lit("high").alias("confidence"), F.lit(LINE_TAG).alias("extraction_method"), "rel_path", F.lit(name).alias("framework"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def next_routes(files: DataFrame, service: Column) -> DataFrame:
    """Routes that the path of a file is; a verb counts where a function of its name is exported, case aside."""
    path = F.col("rel_path")
    app, pages = path.rlike(NEXT_APP), path.rlike(NEXT_PAGES)
    route = F.when(app, F.regexp_replace(F.regexp_replace(path, "^app/", ""), r"/route\.[a-z]+$", "")).otherwise(F.regexp_replace(F.regexp_replace(path, "^pages/api/", ""), r"\.[a-z]+$", ""))
    verbs = F.filter(F.array(*[F.lit(v) for v in NEXT_VERBS]), lambda v: F.contains(F.lower("content"), F.concat(F.lit("export function "), F.lower(v))))
    return files.filter(app | pages).select(
        F.coalesce(service, F.lit("")).alias("service_name"), F.explode(verbs).alias("method"), F.concat(F.lit("/"), route).alias("path"), F.lit(None).cast("string").alias("handler"),
        F.lit("rest").alias("kind"), F.lit("high").alias("confidence"), F.lit(NEXT_TAG).alias("extraction_method"), "rel_path", F.lit("nextjs").alias("framework"),
    )


def resource_routes(files: DataFrame, service: Column) -> DataFrame:
    """The routes that ``resources :x`` and ``resource :x`` stand for; a single resource has no index."""
    lines = lines_of(files.filter(F.col("rel_path").rlike(RESOURCE_FILES)))
    rows = lines.withColumns({"many": F.regexp_extract("line", r"^\s*(resources?)\s+:([A-Za-z0-9_]+)", 1), "name": F.regexp_extract("line", r"^\s*(resources?)\s+:([A-Za-z0-9_]+)", 2)}).filter("name != ''")
    table = F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(s).alias("suffix"), F.lit(a).alias("action")) for v, s, a in RESOURCES])
    each = rows.withColumn("r", F.explode(F.filter(table, lambda r: (F.col("many") == "resources") | (r.action != "index"))))
    return each.select(
        F.coalesce(service, F.lit("")).alias("service_name"), F.col("r.verb").alias("method"), F.concat(F.lit("/"), "name", "r.suffix").alias("path"), F.lit(None).cast("string").alias("handler"),
        F.lit("rest").alias("kind"), F.lit("medium").alias("confidence"), F.concat(F.lit("ast_rails_"), "many").alias("extraction_method"), "rel_path", F.lit("rails").alias("framework"),
    )


def routes(files: DataFrame, methods: list[str] | None = None, services: DataFrame | None = None) -> DataFrame:
    """Endpoints of files (rel_path, service, content) in every framework whose gate is open; comments aren't read.
    methods: the extraction methods to look for, or all; files and manifests that only others need aren't looked into.
    services: those to place files by that have no service yet; only files that may hold such routes are placed."""
    asked = lambda *tags: methods is None or any(t in methods for t in tags)
    unknown = {*(methods or [])} - {f.tag for f in FRAMEWORKS} - {NEXT_TAG, LINE_TAG, *RESOURCE_TAGS}
    if unknown or methods == []:
        raise ValueError(f"no such extraction method: {sorted(unknown)}")
    service, by_call = F.col("service"), tuple(f for f in FRAMEWORKS if asked(f.tag))
    looked_into = [f.files for f in by_call] + [RESOURCE_FILES] * asked(*RESOURCE_TAGS) + [p for _, p, *_ in BY_LINE] * asked(LINE_TAG) + [NEXT_APP, NEXT_PAGES] * asked(NEXT_TAG)
    placed = files if services is None else scope(files.filter(F.col("rel_path").rlike(any_of(dict.fromkeys(looked_into)))), services)
    bare = placed.withColumn("content", without_comments(F.col("content"), F.col("rel_path")))
    parts, names = [], {f.name for f in by_call}
    if asked(*RESOURCE_TAGS):
        parts.append(resource_routes(bare, service))
        names.add("rails")
    if asked(LINE_TAG):
        parts.append(line_routes(bare, service))
        names |= {name for name, *_ in BY_LINE}
    if by_call:
        parts.append(call_routes(bare, by_call))
    found = next_routes(bare, service).drop("framework") if asked(NEXT_TAG) else None  # its gate is always open
    if parts:
        gated, always = reduce(DataFrame.unionByName, parts), [f.name for f in by_call if not f.manifest]
        if names - {*always}:  # without manifests there is nothing to read for gates
            opened = gates(files, names - {*always}).agg(F.collect_set("framework").alias("opened"))  # one row of some names
            shown = lambda name: F.array_contains("opened", name)
            twice = (F.col("framework") == "rails") & (F.col("extraction_method") == LINE_TAG) & shown("sinatra")  # Sinatra reads every file
            gated = gated.crossJoin(F.broadcast(opened)).filter((shown(F.col("framework")) | F.col("framework").isin(always)) & ~twice).drop("opened")
        gated = gated.drop("framework")
        found = gated if found is None else found.unionByName(gated)
    return found if methods is None else found.filter(F.col("extraction_method").isin(methods))


def faults(files: DataFrame) -> DataFrame:
    """(rel_path, extractor, error) of source files whose brackets don't add up, so that routes may be missed; comments and strings aside."""
    own = files.filter(F.col("rel_path").rlike("|".join(f"(?:{f})" for f in dict.fromkeys(f.files for f in FRAMEWORKS))) & F.col("content").isNotNull())
    bare = F.regexp_replace(without_comments(F.col("content"), F.col("rel_path")), F.when(F.col("rel_path").endswith(".rs"), F.lit(DOUBLE)).otherwise(F.lit(f"{DOUBLE}|{SINGLE}|{TICKS}")), "")
    brackets = F.regexp_replace(bare, r"[^()\[\]{}]+", "")
    more = F.length(F.regexp_replace(brackets, r"[)\]}]+", "")) * 2 - F.length(brackets)
    return own.withColumn("more", more).filter("more <> 0").select("rel_path", F.lit("routes").alias("extractor"), F.when(F.col("more") > 0, "unclosed brackets").otherwise("unopened brackets").alias("error"))
