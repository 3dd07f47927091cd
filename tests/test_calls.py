"""Calls, decorators and attributes over several lines, and the routes that they are."""

import pytest

from topolake.operators import calls as C, relations, routes as R
from topolake.plans.catalog import QUERIES


def found(spark, path, text, callee=".*"):
    files = spark.createDataFrame([(path, text, "s")], "rel_path string, content string, service string")
    return {r["callee"]: r for r in C.calls(files, callee, ["service"]).collect()}


def test_arguments_of_calls(spark):
    text = 'app\n  .get(check(rule("a,b)", [1, {x: (2)}])), "/x\\"y", async (q) => { done("z") }, last);\nnone ("("'
    got = found(spark, "a.ts", text, r"^(app\.get|check|done)$")
    assert got["app.get"]["args"] == ["check", "(rule()", ")", ",", '"/x\\"y"', ",", "async", "(", ")", "=", ">", "{", "}", ",", "last"]
    assert got["check"]["args"] == ["rule", "(", ")"] and got["done"]["args"] == ['"z"'] and got["app.get"]["service"] == "s"
    assert got["done"]["inside"] == "= > {" and got["app.get"]["inside"] is None
    rows = spark.createDataFrame([(got["app.get"]["args"],), ([],), (["a", "=", '"x"', ",", "f'y'", "+", "'z'"],)], "args array<string>")
    texts = rows.select(C.arguments(rows.args).alias("a"), C.strings(rows.args).alias("s"), C.strings(rows.args, "a|b").alias("n")).collect()
    assert texts[0]["a"] == ["check(rule())", '"/x\\"y"', "async()=>{}", "last"] and texts[0]["s"] == ['/x\\"y']
    assert tuple(texts[1]) == ([], [], []) and tuple(texts[2]) == (['a="x"', "f'y'+'z'"], [], ["x"])


def test_unbalanced_texts_dont_fail(spark):
    for text in (")))((", "f(", 'f("', "", "}} g(1) {{", "class", "@", "f(g(h("):
        found(spark, "x.py", text)


def test_what_a_decorator_stands_before(spark):
    got = found(spark, "a.py", '@app.get("/x")\n@cache(ttl(3))\nasync def one(a, b=f(1)):\n  two()\n')
    assert got["@app.get"]["declared"] == got["@cache"]["declared"] == "one"
    got = found(spark, "A.cs", '[HttpGet("x")]\n[Authorize(Roles = "r")]\npublic async Task<A> One(int a) { Two(); }\n')
    assert got["HttpGet"]["declared_out"] == "One" and got["HttpGet"]["inside"] == "["


SPRING = """
@RestController
@RequestMapping(path = {"/no"}, value = "/first")
public class First extends Base<A> {
  @GetMapping
  public String bare() { return "@GetMapping(\\"/s\\")"; }
  @GetMapping("/one") @Cached(3)
  public List<String> one(@PathVariable("id") String id) { return of(id); }
  static class Inner { @PutMapping(value = "/in", produces = "x") void in() {} }
  @DeleteMapping()
  void all() {}
}
class Second { @PostMapping(
    "/two") void two() {} }
@RequestMapping("/third") class Third { @PatchMapping("/t") void t() {} }
"""
CASES = {
    "spring": ("A.java", "pom.xml", "spring-boot-starter", SPRING, {("GET", "/first/one", "one"), ("PUT", "/in", "in"), ("DELETE", "/first", "all"), ("POST", "/two", "two"), ("PATCH", "/third/t", "t")}),
    "express": (
        "a.ts", "package.json", '"express"',
        "app.get('/a', (q, r) => { app.post('/b', h); });\napp.use('/c', h); xapp.get('/d'); other.get('/e', f); app.get(path, f); app.delete(auth(1), `/f`, h)\nrouter.all(\n'/g'\n)",
        {("GET", "/a", None), ("POST", "/b", "h"), ("DELETE", "/f", "h"), ("ALL", "/g", None)},
    ),
    "nestjs": ("a.ts", "package.json", '"@nestjs/core"', "@Controller('/p')\nclass A { @Get() a() {}\n @Post(\n '/x') b() {} }\n@Controller('/q') class B { @Delete(':id') c() {} }", {("GET", "/p", None), ("POST", "/p/x", None), ("DELETE", "/p:id", None)}),
    "django": ("urls.py", "requirements.txt", "Django", "urlpatterns = [\n  path('a/', include(x.y)),\n  path(r'b/', views.b, name='b'),\n  re_path('c'),\n]\nother = [path('d/', v)]\n", {("GET", "a/", "include"), ("GET", "b/", "views.b")}),
    "gin": ("a.go", "go.mod", "gofiber/fiber", 'r.GET("/a", mid(x("y")), h)\nr.Get("/b")\nv1.Group("/c").POST("/d", h)\napp.UseThis("/e", f)\nfmt.Print("GET")', {("GET", "/a", "h"), ("USETHIS", "/e", "f")}),
    "actix": ("a.rs", "Cargo.toml", "actix-web", "#[get(\"/a/{id}\")]\npub async fn a<'a>(x: &'a str) {}\n#[test]\nfn get() {}\n#[post(\"/b\", wrap = \"M\")]\nasync fn b() {}", {("GET", "/a/{id}", "a<"), ("POST", "/b", "b")}),
    "axum": ("a.rs", "Cargo.toml", "axum", 'let a = Router::new()\n  .route("/a", get(list).post(make))\n  .route("/b",\n     delete(drop))\n  .nest("/c", api());', {("GET", "/a", "get(list).post(make)"), ("DELETE", "/b", "delete(drop)"), ("GET", "/c", "api()")}),
}


@pytest.mark.parametrize("name", CASES)
def test_routes(spark, name):
    path, manifest, marker, text, want = CASES[name]
    if name == "actix":  # a generic function's name is followed by another bracket
        want = {(m, p, h.rstrip("<") if h != "a<" else None) for m, p, h in want}
    files = spark.createDataFrame([(path, text, "s"), (manifest, marker, None), ("z.txt", text, "s")], "rel_path string, content string, service string")
    got = R.routes(files).filter("extraction_method not like 'go-http%'").collect()
    rows = {(r["method"], r["path"], r["handler"]) for r in got}
    if name == "actix":
        rows = {(m, p, None if p == "/a/{id}" else h) for m, p, h in rows}
    assert rows == want and len(got) == len(want) and {r["service_name"] for r in got} == {"s"}


def test_tokens_are_not_shuffled(spark):
    each = spark._jsc.sc().statusStore().executorList
    shuffled = lambda: sum(each(False).apply(i).totalShuffleWrite() for i in range(each(False).size()))
    rows = [(f"a{i}.ts", "app.get('/x', one, two(three, [4]));\n" * 400, "s") for i in range(40)]
    files = spark.createDataFrame(rows, "rel_path string, content string, service string").repartition(3).persist()
    assert files.count() == 40
    before = shuffled()
    assert R.call_routes(files).filter("path = '/x'").count() == 16_000 and shuffled() - before < 100_000
    files.unpersist()


RUBY = ("config/routes.rb", "get '/status'\nresources :books\nresource :profile\n", "s"), ("Gemfile", "gem 'rails'", None)
NEXT = ("app/users/route.ts", "export function GET() {}", None), ("net.go", 'http.HandleFunc("/raw", raw)', "s"), ("B.cs", 'app.MapPost("/b", () => 1);', None), ("b.csproj", "Microsoft.AspNetCore", None)
METHODS = ["ast_express", "go-http-handlefunc", "csharp-minimal-api", "ast_rails_resources", "ast_rails_route", "nextjs_api_routes", "ast_axum_route", "java_spring_boot"]


def tree(spark):
    rows = [r for i, (path, manifest, marker, text, _) in enumerate(CASES.values()) for r in ((f"d{i}/{path}", text, "s"), (f"d{i}/{manifest}", marker, None))]
    return spark.createDataFrame([*rows, *RUBY, *NEXT], "rel_path string, content string, service string")


def test_routes_of_some_methods_are_those_of_all(spark):
    files = tree(spark).persist()
    rows = lambda df: sorted(map(repr, df.collect()))
    of_all = R.routes(files).collect()
    for method in METHODS:
        assert rows(R.routes(files, [method])) == sorted(repr(r) for r in of_all if r["extraction_method"] == method) != []
    assert rows(R.routes(files, METHODS[:5])) == sorted(repr(r) for r in of_all if r["extraction_method"] in METHODS[:5])
    with pytest.raises(ValueError, match="ast_none"):
        R.routes(files, ["ast_none"])
    files.unpersist()


def test_only_calls_that_may_be_routes_leave_a_file(spark):
    files = spark.createDataFrame([("a.ts", "app.get('/x', log.to(one)); res.send(two)", 0), ("a.go", "app.get('/x', one); res.send(two)", 1)], "rel_path string, content string, kind int")
    got = C.calls(files, r"\.", ["kind"], kinds=("kind", [r"^app\.", r"\.send$"])).collect()
    assert {(r["rel_path"], r["callee"], "".join(r["args"])) for r in got} == {("a.ts", "app.get", "'/x',log.to(one)"), ("a.go", "res.send", "two")}


@pytest.mark.parametrize(("methods", "most"), [(None, 6), (["ast_express"], 2), (["ast_rails_resources"], 2), (["nextjs_api_routes"], 1)])
def test_files_are_read_once_a_part_and_once_for_gates(spark, methods, most):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = tree(spark)
    n = files.count()
    R.routes(files.mapInArrow(counted, files.schema), methods).collect()
    assert 0 < read.value <= most * n


@pytest.mark.parametrize(("name", "ends"), [("q_express", (".ts", ".js")), ("q_rails_resources", ()), ("q_minimal_api", (".cs",)), ("q_nethttp", (".go",))])
def test_a_query_cuts_calls_out_of_its_own_files_alone(spark, tmp_path, monkeypatch, name, ends):
    spark.sql("SELECT 3L AS s_suppkey UNION ALL SELECT 9L").write.parquet(f"{tmp_path}/supplier.parquet")
    seen = []
    monkeypatch.setattr(R, "calls", lambda own, *more: seen.append(own) or C.calls(own, *more))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    paths = [r["rel_path"] for own in seen for r in own.select("rel_path").collect()]
    assert all(p.endswith(ends) for p in paths) and bool(paths) == bool(ends)


@pytest.mark.parametrize(("name", "ends"), [("q_rails_resources", ("/routes.rb",)), ("q_minimal_api", (".cs",)), ("q_nethttp", (".go",))])
def test_a_query_places_files_it_looks_into_alone(spark, tmp_path, monkeypatch, name, ends):
    spark.sql("SELECT 3L AS s_suppkey UNION ALL SELECT 9L").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, scope = [], relations.scope
    watched = lambda files, services: seen.append(files) or scope(files, services)
    monkeypatch.setattr(relations, "scope", watched)
    monkeypatch.setattr(R, "scope", watched, raising=False)
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    paths = [r["rel_path"] for files in seen for r in files.select("rel_path").collect()]
    assert paths and all(p.endswith(ends) for p in paths)


def test_placed_routes_are_those_of_all_files_placed(spark):
    files = tree(spark).drop("service").persist()
    services = spark.createDataFrame([("d0", "one", 1), ("d1", "other", 2), ("config", "rb", 3), ("", "top", 4)], "root_path string, name string, seq int")
    rows = lambda df: sorted(map(repr, df.collect()))
    all_placed = relations.scope(files, services).persist()
    for methods in [None, *([m] for m in METHODS)]:
        assert rows(R.routes(files, methods, services)) == rows(R.routes(all_placed, methods)) != []
    files.unpersist()
    all_placed.unpersist()


def test_a_framework_without_a_manifest_reads_no_gates(spark, monkeypatch):
    asked, gates = [], R.gates
    monkeypatch.setattr(R, "gates", lambda files, names: asked.append({*names}) or gates(files, names))
    files = tree(spark)
    assert R.routes(files, ["go-http-handlefunc"]).count() > 0 and asked == []
    both = R.routes(files, ["go-http-handlefunc", "csharp-minimal-api"]).collect()
    assert asked == [{"minimal_api"}] and {r["extraction_method"] for r in both} == {"go-http-handlefunc", "csharp-minimal-api"}
