"""Column expressions over strings: URLs, paths, code lines and configuration keys.

Absent results are null unless said otherwise; an empty string is a value.
All patterns keep to what Java and RE2 have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: URL schemes and the protocols they stand for.
SCHEMES = {
    "postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mysql", "redis": "redis", "rediss": "redis",
    "amqp": "amqp", "amqps": "amqp", "kafka": "kafka", "mongodb": "mongodb", "mongodb+srv": "mongodb",
    "http": "http", "https": "http", "grpc": "grpc", "grpcs": "grpc",
}
#: Environment keys that hold addresses.
ADDRESS_KEYS = ("DATABASE_URL", "REDIS_URL", "AMQP_URL", "KAFKA_BROKERS")
ADDRESS_SUFFIX = "_(URL|HOST|ENDPOINT|ADDR|DSN)$"
#: Words in keys of deployments, and the protocols that keys suggest, in order.
DEPLOYMENT_KEY = "URL|HOST|ENDPOINT|BROKER|ADDRESS"
KEY_PROTOCOLS = (("REDIS", "redis"), ("POSTGRES|PG|DATABASE", "postgresql"), ("MYSQL", "mysql"), ("MONGO", "mongodb"), ("KAFKA|BROKER", "kafka"))

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#\[\]]*)(?::[0-9]*)?(?:[/?#].*)?$"
URL_PORT = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(?:\[[^\]]*\]|[^:/?#\[\]]*):([0-9]+)(?:[/?#].*)?$"
QUOTED = "\"([^\"]*)\"|'([^']*)'"
#: Delimiters of a requirement, in the order in which they are looked for.
REQUIREMENT_ENDS = (">", "=", "<", "!", "~", "[", ";", " ")
#: Pieces of dependency names and the protocols they speak.
KNOWN_LIBRARIES = (
    ("reqwest", "rest"), ("tonic", "grpc"), ("tokio-postgres", "postgresql"), ("sqlx", "postgresql"), ("redis", "redis"), ("rdkafka", "kafka"),
    ("rumqttc", "mqtt"), ("lapin", "amqp"), ("httpx", "rest"), ("aiohttp", "rest"), ("requests", "rest"), ("psycopg", "postgresql"),
    ("pymongo", "mongodb"), ("motor", "mongodb"), ("boto3", "sqs"), ("aiokafka", "kafka"), ("pika", "amqp"), ("axios", "rest"),
    ("node-fetch", "rest"), ("got", "rest"), ("ky", "rest"), ("pg", "postgresql"), ("mongoose", "mongodb"), ("ioredis", "redis"),
    ("mysql2", "mysql"), ("kafkajs", "kafka"), ("amqplib", "amqp"), ("mqtt", "mqtt"), ("grpc", "grpc"), ("google.golang.org/grpc", "grpc"),
    ("net/http", "rest"), ("RestTemplate", "rest"), ("WebClient", "rest"), ("OkHttp", "rest"), ("Faraday", "rest"), ("typhoeus", "rest"),
)
#: Prefixes of dependencies that are no connection libraries.
TOOL_LIBRARIES = (
    "numpy", "pandas", "scipy", "matplotlib", "pillow", "django", "flask", "fastapi", "react", "vue", "angular", "svelte", "express", "nestjs",
    "next", "nuxt", "gatsby", "pytest", "unittest", "eslint", "prettier", "webpack", "vite", "rollup", "babel", "jest", "mocha", "vitest",
    "setuptools", "pip", "poetry", "cargo", "rustc", "go", "javac",
)


def found(column: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(column, F.lit(""))


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def first_line_match(column: Column, pattern: str, group: int = 1) -> Column:
    return found(F.regexp_extract(column, pattern, group))


# --- URLs -------------------------------------------------------------------


def scheme_protocol(scheme: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    return F.coalesce(F.element_at(known, scheme), scheme)


def url_scheme(url: Column) -> Column:
    return F.lower(first_line_match(url, URL, 1))


def url_host(url: Column) -> Column:
    """Host of an absolute URL; null without one, and for templates."""
    host = first_line_match(url, URL, 2)
    web = url_scheme(url).isin("http", "https", "ws", "wss", "ftp")
    return F.when(~host.contains("{"), F.when(web, F.lower(host)).otherwise(host))


def url_protocol(url: Column) -> Column:
    return F.when(url_host(url).isNotNull(), scheme_protocol(url_scheme(url)))


def url_port(url: Column) -> Column:
    return first_line_match(url, URL_PORT).cast("int")


def raw_url_parts(value: Column) -> tuple[Column, Column]:
    """Scheme as written and host up to ``/`` or ``:``."""
    pattern = "^(.*?)://([^/:]+)"
    return first_line_match(value, pattern, 1), first_line_match(value, pattern, 2)


def jdbc_target(value: Column) -> tuple[Column, Column]:
    """Protocol and host of ``jdbc:sub://host``."""
    pattern = "^jdbc:([^:/]+)://([^:/]+)"
    return scheme_protocol(first_line_match(value, pattern, 1)), first_line_match(value, pattern, 2)


def kafka_host(value: Column) -> Column:
    return found(F.split_part(trimmed(F.split_part(value, F.lit(","), F.lit(1))), F.lit(":"), F.lit(1)))


# --- keys -------------------------------------------------------------------


def is_address_key(key: Column) -> Column:
    return key.isin(*ADDRESS_KEYS) | key.rlike(ADDRESS_SUFFIX)


def is_deployment_key(key: Column) -> Column:
    return F.upper(key).rlike(DEPLOYMENT_KEY)


def looks_like_hostname(value: Column) -> Column:
    return (value != "") & ~value.contains(" ") & value.contains(".") & ~value.contains("://")


def key_protocol(key: Column) -> Column:
    out = F.lit("tcp")
    for words, protocol in reversed(KEY_PROTOCOLS):
        out = F.when(F.upper(key).rlike(words), protocol).otherwise(out)
    return out


def env_file_priority(name: Column) -> Column:
    """Order in which files are read; a later one wins."""
    return F.when(name == ".env", 0).when(name == ".env.local", 1).when(name == ".env.development", 2).when(name == ".env.production", 3).otherwise(4)


# --- code lines -------------------------------------------------------------


def _unquoted(match: Column) -> Column:
    return F.when(F.length(match) >= 2, F.regexp_replace(match, "(?s)^.|.$", ""))


def first_string(line: Column) -> Column:
    """Content of the first quoted string; may be empty."""
    return _unquoted(F.regexp_extract(line, QUOTED, 0))


def second_string(line: Column) -> Column:
    return _unquoted(F.get(F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0)), 1))


def after(line: Column, mark: str) -> Column:
    """What follows the first mark; null without it."""
    at = F.instr(line, mark)
    return F.when(at > 0, F.substring(line, at + len(mark), F.length(line)))


def named_arg(line: Column, key: str) -> Column:
    return first_string(after(line, f"{key}="))


def string_hostname(line: Column) -> Column:
    """First quoted string, what stands between :// and the next slash, with port and user."""
    return F.when(first_string(line).contains("://"), F.regexp_extract(first_string(line), "://([^/]*)", 1))


def process_env_var(line: Column) -> Column:
    return first_line_match(line, r"process\.env\.([A-Za-z0-9_]+)")


def nullish_default(line: Column) -> Column:
    """String after ``??``, or after ``||`` where there is no ``??``."""
    rest = F.when(line.contains("??"), after(line, "??")).otherwise(after(line, "||"))
    match = F.regexp_extract(rest, "^\\s*(\"[^\"]*\"|'[^']*'|`[^`]*`)", 1)
    return _unquoted(match)


def or_default(line: Column) -> Column:
    return _unquoted(F.regexp_extract(after(line, "||"), "^\\s*(\"[^\"]*\"|'[^']*')", 1))


def unwrap_or_default(line: Column) -> Column:
    return first_string(after(line, ".unwrap_or("))


def caps_argument(line: Column) -> Column:
    """An ALL_CAPS identifier right after the first parenthesis."""
    word = F.regexp_extract(after(line, "("), r"^[&\s]*([A-Za-z0-9_]+)", 1)
    return F.when(word.rlike("^[A-Z0-9_]+$") & word.rlike("[A-Z]"), word)


def env_line(line: Column, export: bool = True) -> tuple[Column, Column]:
    """Key and value of ``KEY=VALUE``, matching quotes taken off; null keys for other lines and comments."""
    bare = trimmed(line)
    if export:
        bare = F.regexp_replace(bare, "^export ", "")
    fits = ~bare.startswith("#") & bare.contains("=")
    key = F.when(fits, found(trimmed(F.split_part(bare, F.lit("="), F.lit(1)))))
    value = trimmed(after(bare, "="))
    quoted = value.rlike("^\".*\"$|^'.*'$") & (F.length(value) >= 2)
    return key, F.when(key.isNotNull(), F.when(quoted, F.regexp_replace(value, "^.|.$", "")).otherwise(value))


# --- paths, templates, names ------------------------------------------------


def normal_path(path: Column) -> Column:
    """Parameters of any framework as {param}, a lone star as {*}."""
    return F.array_join(
        F.transform(F.split(path, "/"), lambda s: F.when(s.startswith(":") | (s.startswith("{") & s.endswith("}")), "{param}").when(s == "*", "{*}").otherwise(s)), "/"
    )


def normal_template(text: Column) -> Column:
    """String templates of several languages with each hole as {param}; braces in holes nest up to three deep."""
    bare = F.regexp_replace(F.regexp_replace(text, "`", ""), "^f?[\"']|[\"']$", "")
    inner = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*"
    bare = F.regexp_replace(bare, r"[$#]\{" + inner + r"\}", "{param}")
    bare = F.regexp_replace(bare, r"[$#]\{.*$", "{param}")
    bare = F.regexp_replace(bare, r"\{[A-Za-z_][A-Za-z0-9_.]*\}", "{param}")
    bare = F.regexp_replace(bare, "%[sdvfgxq]", "{param}")
    return F.regexp_replace(bare, r"\{\}", "{param}")


def call_argument(line: Column, name: Column) -> Column:
    """Template given to a call of name: in back quotes, an f-string, or else the first quoted string."""
    at = F.instr(line, F.concat(name, F.lit("(")))
    rest = F.when(at > 0, F.substring(line, at + F.length(name) + 1, F.length(line)))
    pick = F.coalesce(found(F.regexp_extract(rest, "`[^`]*`", 0)), found(F.regexp_extract(rest, "f\"[^\"]*\"|f'[^']*'", 0)), found(F.regexp_extract(rest, QUOTED, 0)))
    return normal_template(pick)


def requirement_name(requirement: Column) -> Column:
    """Cut at the delimiter that comes first in the fixed order, not in the text."""
    out = trimmed(requirement)
    for end in reversed(REQUIREMENT_ENDS):
        out = F.when(requirement.contains(end), trimmed(F.split_part(requirement, F.lit(end), F.lit(1)))).otherwise(out)
    return out


def library_protocols(dep: Column) -> Column:
    """Protocols whose name pieces occur in a dependency, in table order."""
    table = F.array(*[F.struct(F.lit(piece.lower()).alias("piece"), F.lit(protocol).alias("protocol")) for piece, protocol in KNOWN_LIBRARIES])
    return F.array_distinct(F.transform(F.filter(table, lambda t: F.contains(F.lower(dep), t.piece)), lambda t: t.protocol))


def is_tool_library(dep: Column) -> Column:
    return F.lower(dep).rlike("^(" + "|".join(TOOL_LIBRARIES) + ")")


def imports(line: Column, library: Column) -> Column:
    """Whether a line imports a library, with - and _ taken for each other."""
    names = F.array(library, F.replace(library, F.lit("-"), F.lit("_")), F.replace(library, F.lit("_"), F.lit("-")))
    named = F.exists(names, lambda n: F.contains(line, n))
    shape = line.rlike("^(import |from |use |extern crate |require '|require \")|require\\(|from ['\"]")
    go = line.contains('"') & (F.ltrim(line).startswith('"') | line.contains("import "))
    return named & (shape | go)


def method_score(method: Column) -> Column:
    return F.when(method.startswith("pattern"), 3).when(method.startswith("wrapper_trace"), 2).when(method.startswith("library_resolution"), 1).otherwise(0)


def demoted(target: Column, confidence: Column) -> tuple[Column, Column]:
    """A rule that finds no target has an empty one and medium confidence."""
    missing = target.isNull() | (target == "")
    return F.when(missing, "").otherwise(target), F.when(missing, "medium").otherwise(confidence)


def glob_regex(glob: str) -> str:
    """A glob as an anchored pattern; * and ? cross slashes, **/ may be nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_/-" else "\\" + c)
            i += 1
    return f"^{out}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether any glob fits; none for an empty list."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
