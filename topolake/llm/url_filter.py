"""Operator 1: URL filters.

Pattern rules are indexed by their rarest literal token, as counted over all
URLs to be judged.  The tokens of a URL fetch candidate rules from that index,
and only those run their regular expressions.  The index is a constant of the
plan, so judging is a projection: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN = "[A-Za-z0-9]+"
ENTRY = "token string, rule string, action string, tier int, host_len int, path_len int, regex string"


@dataclass(frozen=True)
class UrlRule:
    """Either a host rule (``host`` and its subdomains, paths that start with ``path``)
    or a pattern rule over host + path: ``*`` any characters, ``^`` one separator,
    the start or the end.  Host rules rank before pattern rules, longer before shorter
    ones; of equally long rules that block and allow, the one that blocks."""

    action: str
    host: str | None = None
    path: str = "/"
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.pattern if self.host is None else self.host + self.path

    @property
    def regex(self) -> str:
        if self.host is not None:
            return rf"(?s)^(?:[^/]*\.)?{_literal(self.host)}(?={_literal(self.path[:1]) or '/|$'}){_literal(self.path)}"
        separator = r"(?:^|[^A-Za-z0-9_%-]|$)"
        return "(?s)" + "".join({"*": ".*", "^": separator}.get(c) or _literal(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in every URL that fits: no letter or digit can adjoin them."""
        text = f"^{self.host}{self.path}*" if self.host is not None else f"*{self.pattern}*"
        return [m[0] for m in re.finditer(TOKEN, text) if text[m.start() - 1] != "*" and text[m.end()] != "*"]


def _literal(text: str) -> str:
    """Java and Python escape alike where only punctuation gets a backslash."""
    return re.sub(r"([^A-Za-z0-9_])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], text)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or for null."""
    host = F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows each wanted token stands.  At most one row a wanted token comes to the driver."""
    host, path = url_parts(F.col("url"))
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(TOKEN), F.lit(0)))
    kept = F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(kept).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in rows}


def rule_index(rules: Iterable[UrlRule], counts: dict[str, int]) -> tuple[int, list[list[dict]], list[dict]]:
    """Buckets of rules by crc32 of their rarest token (ties: the first in order), and the rules without a token."""
    rules = list(dict.fromkeys(rules))
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(rules)))]
    rest = []
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        entry = {"token": token, "rule": rule.name, "action": rule.action, "tier": int(rule.host is not None), "host_len": len(rule.host or ""), "path_len": len(rule.path if rule.host is not None else rule.pattern), "regex": rule.regex}
        (rest if token is None else buckets[zlib.crc32(token.encode()) % len(buckets)]).append(entry)
    return len(buckets), buckets, rest


def judge_urls(pages: DataFrame, rules: Iterable[UrlRule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, pattern, verdict) of every row, in its partition.

    rule: the host rule that decides, else null.  pattern: the pattern rule that decides
    where no host rule fits, else null.  verdict: that rule's action, else ``default``.
    Null, empty and odd URLs have an empty host and path, which only a pattern without
    literals can fit.  Repeated rows are judged each; an empty table gives none; further
    columns are not read.  The rules are a list on the driver and a constant in the plan.
    """
    rules = list(rules)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    wanted = sorted({t for rule in rules for t in rule.tokens})
    size, buckets, rest = rule_index(rules, token_counts(rows, wanted) if wanted else {})
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{_fields()}>>>")
    always = F.from_json(F.lit(json.dumps(rest)), f"array<struct<{_fields()}>>")
    host, path = url_parts(F.col("url"))
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0)))
    bucket = lambda t: F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int"))
    candidates = F.concat(F.flatten(F.transform(tokens, lambda t: F.filter(bucket(t), lambda r: r.token == t))), always)
    fits = F.filter(candidates, lambda r: F.rlike("text", r.regex))
    order = F.transform(fits, lambda r: F.struct(r.tier.alias("tier"), r.host_len, r.path_len, r.action.alias("action"), r.rule.alias("rule")))
    judged = rows.select("key", host.alias("host"), path.alias("path")).withColumn("text", F.concat("host", "path")).select("key", "host", "path", F.array_max(order).alias("best"))
    return judged.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.when(F.col("best.tier") == 1, F.col("best.rule")).alias("rule"),
        F.when(F.col("best.tier") == 0, F.col("best.rule")).alias("pattern"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def _fields() -> str:
    return ENTRY.replace(" string", ":string").replace(" int", ":int")
