"""The opN queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from topolake.llm import embed_dedup, fingerprint, langid, lexical, minhash, mixing, packing, pieces, quality, secret_scan, token_count, url_filter, whitening
from topolake.shipping import ship

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: The host rules in force, then the method's own patterns.
URL_RULES = (
    url_filter.UrlRule("allow", "com"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
    url_filter.UrlRule("block", pattern="^spam-farm^"),
    url_filter.UrlRule("block", pattern="^cheap-pills^"),
    url_filter.UrlRule("block", pattern="^adult-x^"),
    url_filter.UrlRule("block", pattern="^casino^"),
    url_filter.UrlRule("block", pattern="^free-*-download"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
    CASE WHEN regexp_matches(host || path, '(?:^|[^A-Za-z0-9_%-])(?:spam-farm|cheap-pills|adult-x|casino)(?:[^A-Za-z0-9_%-]|$)|(?:^|[^A-Za-z0-9_%-])free-.*-download') THEN 1 ELSE 0 END AS hit,
    host || path AS t
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL OR hit = 0 THEN NULL
       WHEN regexp_matches(t, '(?:^|[^A-Za-z0-9_%-])free-.*-download') THEN '^free-*-download'
       WHEN regexp_matches(t, '(?:^|[^A-Za-z0-9_%-])cheap-pills(?:[^A-Za-z0-9_%-]|$)') THEN '^cheap-pills^'
       WHEN regexp_matches(t, '(?:^|[^A-Za-z0-9_%-])spam-farm(?:[^A-Za-z0-9_%-]|$)') THEN '^spam-farm^'
       WHEN regexp_matches(t, '(?:^|[^A-Za-z0-9_%-])adult-x(?:[^A-Za-z0-9_%-]|$)') THEN '^adult-x^'
       ELSE '^casino^' END AS pattern,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR hit = 1 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest matches over a byte-level vocabulary of 50,257 pieces."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return scanned.select(
        "row.doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words and a similarity of 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, as many rows as there are."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT count(*) FROM documents)::DOUBLE / n_rows AS rate FROM counts),
parts AS (SELECT source, greatest(1, CAST(ceil(rate / 708.0) AS BIGINT)) AS draws, rate / greatest(1, CAST(ceil(rate / 708.0) AS BIGINT)) AS rate FROM rates),
levels(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM parts
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM levels WHERE k + 1 <= ceil(rate + 12.0 * sqrt(rate) + 30.0)),
numbered AS (
  SELECT *, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, 'null'), coalesce(lang, 'null'), coalesce(source, 'null'), coalesce(CAST(n_chars AS VARCHAR), 'null'))) AS mark FROM documents),
named AS (
  SELECT *, '17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || mark || ':' || (row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1) AS name FROM numbered),
draws AS (
  SELECT n.doc_id, n.text, n.lang, n.source, n.n_chars, n.name, unnest(range(p.draws)) AS i FROM named n JOIN parts p ON p.source IS NOT DISTINCT FROM n.source),
drawn AS (
  SELECT *, CAST('0x' || substr(md5(CASE WHEN i = 0 THEN name ELSE i || ':draw:' || name END), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM draws),
copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.name, count(*) AS n FROM drawn d JOIN levels l ON l.source IS NOT DISTINCT FROM d.source AND l.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n)) AS copy_no FROM copies
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", whitening.as_long(F.col("deviation")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH found AS (
  SELECT rowid_ AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
docs AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
postings AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, big_n),
impacts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS impact FROM postings JOIN weights USING (term), totals),
scored AS (SELECT item_id, text, row, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without begin and end, and the text that they decode to; as further columns digests of the pieces' spans and the bytes that they cover."""
    path = tokenizer_path("piece_bpe_32k.model")
    listed = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return pieces.encode(_table(spark, sf_dir, "documents"), path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        listed("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        listed("ends").alias("ends_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("begins", F.lit(1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_token_count, op3_secret_scan, op4_quality, op5_language_id,
        op6_minhash, op7_packing, op8_embedding_dedup, op9_fingerprints, op10_mixing,
        op11_whitening, op12_lexical_search, op13_sentencepiece,
    )
}
ORACLES = {"op1_url_filter": OP1_SQL, "op10_mixing": OP10_SQL, "op12_lexical_search": OP12_SQL}
