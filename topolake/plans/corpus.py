"""A small repository of our own, for queries whose input is source text; a folder of tables holds it as many times as it has suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.plans.registry import table

FILES = {
    "shop/Dockerfile": "FROM python:3.12\nCMD python app.py\n",
    "shop/requirements.txt": "# web\nfastapi==0.110\nhttpx>=0.27\nDjango<5\n",
    "shop/app.py": 'import httpx\n\n\n@app.get("/items")\n@cached\nasync def list_items():\n    """Calls httpx.get( for you."""\n    return httpx.get("http://stock/items")\n\n\n@router.post(\'/items/{id}\')\ndef add_item(id):\n    return fetch_all(id)\n\n\ndef fetch_all(id):\n    return httpx.get(f"http://stock/items/{id}")\n',
    "shop/urls.py": "urlpatterns = [\n    path('about/', views.about),\n    re_path(r'^team/$', views.team),\n]\n",
    "web/Dockerfile": "FROM node:22\n",
    "web/package.json": '{"dependencies": {"express": "4", "@nestjs/core": "10", "fastify": "4", "axios": "1"}, "devDependencies": {"jest": "29"}}',
    "web/src/server.ts": "import axios from 'axios';\napp.get('/health', (req, res) => res.send('ok'));\nrouter.post(\"/orders\", auth, createOrder);\n",
    "web/src/pets.ts": "@Controller('/pets')\nexport class Pets {\n  @Get('/:id')\n  one() {}\n  @Post()\n  add() {}\n}\n",
    "web/src/fast.js": "const fastify = require('fastify')();\nfastify.put('/fast', handlePut);\n",
    "app/users/route.ts": "export function GET() {}\nexport async function POST() {}\n",
    "pages/api/pay/[id].js": "export function getPay() {}\n",
    "gw/Dockerfile": "FROM golang\n",
    "gw/go.mod": "module gw\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9\n\tgithub.com/go-chi/chi v5\n\tgithub.com/gorilla/mux v1\n)\n",
    "gw/main.go": 'r.GET("/ping", ping)\nhttp.HandleFunc("/raw", raw)\n',
    "pay/Dockerfile": "FROM eclipse-temurin\n",
    "pay/pom.xml": "<project>\n<dependency>\n<groupId>org.spring</groupId>\n<artifactId>spring-boot-starter-web</artifactId>\n</dependency>\n<dependency>\n<groupId>junit</groupId>\n<artifactId>junit</artifactId>\n<scope>test</scope>\n</dependency>\n</project>\n",
    "pay/Pay.java": '@RestController\n@RequestMapping("/pay")\npublic class Pay {\n  @GetMapping("/{id}")\n  public String one(String id) { return id; }\n  @PostMapping("/")\n  public String add() { return ""; }\n}\n',
    "bill/bill.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web">\n<PackageReference Include="RabbitMQ.Client" Version="6" />\n</Project>\n',
    "bill/Bills.cs": '[HttpGet("bills")]\npublic IActionResult All() { }\napp.MapPost("/bills/new", () => 1);\n',
    "rs/Cargo.toml": '[package]\nname = "rs"\n[dependencies]\nactix-web = "4"\naxum = { version = "0.7" }\n',
    "rs/main.rs": '#[get("/rs/{id}")]\nasync fn one() {}\nlet a = Router::new().route("/ax", post(make));\n',
    "rb/Gemfile": 'gem "rails"\ngem \'sinatra\'\ngem "rspec", group: :test\n',
    "rb/config/routes.rb": "get '/status', to: 'status#show'\nresources :books\nresource :profile\n",
    "rb/app.rb": "post '/hook' do\nend\n",
    "api/openapi.yaml": 'openapi: "3.0.3"\ninfo: {title: Catalog}\nservers: [{url: "https://Catalog.example.com/v1"}, {url: "https://{env}.example.com"}]\npaths:\n  /things:\n    get: {operationId: listThings}\n    post: {}\ncomponents:\n  schemas:\n    Thing:\n      required: [id]\n      properties:\n        id: {type: string}\n        tags: {type: array, items: {type: string}}\n        owner: {$ref: "#/x"}\n',
    "api/swagger.json": '{"swagger": "2.0", "host": "old.example.com", "paths": {"/old": {"get": {"operationId": "old"}}}}',
    "api/asyncapi.yml": "asyncapi: 2.0.0\ninfo: {title: Bus}\nchannels:\n  orders:\n    subscribe: {operationId: onOrder}\n    publish: {}\n",
    "api/shop.proto": "service Shop {\n  rpc Get(Req) returns (Res);\n}\nmessage Req {\n  string id = 1;\n  repeated int32 n = 2;\n}\n",
    "api/shop.graphql": "type Query {\n  item(id: ID): Item\n}\ntype Item {\n  name: String\n}\nenum Kind {\n  A\n}\n",
    "deploy/docker-compose.yml": "services:\n  web:\n    depends_on: [db]\n    environment:\n      DATABASE_URL: postgres://u:p@db:5432/x\n      PORT: 80\n  db:\n    depends_on: {vol: {}}\n    environment: [REDIS_URL=redis://cache]\n",
    "k8s/web.yaml": "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: web-deploy}\nspec:\n  template:\n    spec:\n      containers:\n        - env:\n            - {name: DB_HOST, value: db.internal}\n            - {name: API_URL, value: 'http://api:80/x'}\n            - {name: MODE, value: a.b}\n---\napiVersion: v1\nkind: Service\nmetadata: {name: web-svc}\n",
    "conf/.env": "# c\nexport DATABASE_URL=\"mysql://m/x\"\nKAFKA_BROKERS=k1:9092,k2:9092\nNAME=x\nDATABASE_URL=mysql://n/x\n",
    "conf/application.properties": "spring.datasource.url=jdbc:postgresql://pg:5432/x\nspring.rabbitmq.host=mq\nother=1\n",
    "conf/application.yml": "spring:\n  data: {redis: {host: cache}}\n  kafka: {bootstrap-servers: 'kb:1,kc:2'}\n",
    "k8s/settings.yaml": "kind: ConfigMap\ndata: {DATABASE_URL: 'postgres://cm/x', CACHE_URL: 'redis://cm:6379'}\n---\nkind: ConfigMap\ndata: {N: 1}\n",
    "Cargo.lock": '[[package]]\nname = "own"\ndependencies = ["rdkafka 0.3", "serde"]\n',
    "Gemfile.lock": "GEM\n  specs:\n    own (1.0)\n      redis (>= 4)\n      other\n    lone (2)\n",
}

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files (rel_path, content): all, once below the root ``c<n>`` of each supplier, so there are more in a larger folder."""
    roots = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("root"))
    each = F.explode(F.create_map(*[F.lit(x) for file in FILES.items() for x in file])).alias("path", "content")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return roots.repartition(parts, "root").select("root", each).select(F.concat_ws("/", "root", "path").alias("rel_path"), "content")

