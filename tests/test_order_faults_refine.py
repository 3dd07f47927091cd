"""Places of discovery, faults of stages and hashed embeddings, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from topolake.operators import functions_of, manifests, refine, relations, routes


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, n int, id int").repartition(7)
    got = relations.numbered(df, ["s", "n"], "place", 1 << 48).collect()
    assert sorted(r["place"] - (1 << 48) for r in got) == list(range(500)) and {r["id"] for r in got} == set(range(500))
    ordered = [(r["s"] or "", r["n"]) for r in sorted(got, key=lambda r: r["place"])]
    assert ordered == sorted(ordered)
    assert relations.numbered(df.limit(0), ["s"], "place").count() == 0


def test_faults_leave_other_files_alone(spark, monkeypatch):
    plain = functions_of._indented

    def breaks(lines):
        if any("BREAK" in line for line in lines):
            raise RecursionError("too deep")
        return plain(lines)

    monkeypatch.setattr(functions_of, "_indented", breaks)
    rows = [("python", "a.py", "def a():\n  pass\n"), ("python", "b.py", "def b(): BREAK"), ("python", "c.py", None), ("go", "d.go", "func d() {\n}\n"), ("cobol", "e.cob", "x"), (None, "f", "x")]
    assert functions_of._cut("python", "BREAK") == ([], "RecursionError: too deep")
    found = functions_of.cut_files(spark.createDataFrame([(*r, 0) for r in rows], "language string, rel_path string, content string, file_ord int"))
    assert {(r["rel_path"], r["name"]) for r in functions_of.functions_in(found).collect()} >= {("a.py", "a"), ("d.go", "d")}
    assert {r["rel_path"]: r["error"] for r in functions_of.faults_in(found).collect()}["c.py"] == "no text"


def test_faults_of_manifests_and_routes(spark):
    rows = [
        ("package.json", "{"), ("Cargo.toml", "[x"), ("Cargo.lock", "a = 1"), ("deep/package.json", "{"), ("pyproject.toml", None), ("a.ts", 'f("(", `)`) // )'), ("b.ts", "f(("), ("c.py", "x = ')'\n]"), ("d.rb", "(("), ("e.go", None),
    ]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    assert {(r["rel_path"], r["error"]) for r in manifests.faults(files).collect()} == {("package.json", "malformed JSON"), ("Cargo.toml", "malformed TOML")}
    assert {(r["rel_path"], r["error"]) for r in routes.faults(files).collect()} == {("b.ts", "unclosed brackets"), ("c.py", "unopened brackets")}


def plain_embeddings(texts, dimensions):
    grams = {}
    for t in texts:
        words = re.findall("[a-z0-9]+", t.lower())
        grams[t] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    held = Counter(g for own in grams.values() for g in own)
    out = {}
    for t, own in grams.items():
        vector = [0.0] * dimensions
        for g, tf in own.items():
            digest = hashlib.md5(f"17:{g}".encode()).hexdigest()
            weight = math.floor(1000 * math.log((2 * len(grams) + 2) / (2 * held[g] + 1)))
            vector[int(digest[:8], 16) % dimensions] += tf * weight * (1 - 2 * (int(digest[8], 16) % 2))
        out[t] = vector
    return out


def test_hashed_embedding(spark):
    texts = ["protocol:rest code:requests.get(url)", "Requests GET get", "", "?!", "a", "x " * 500, "é b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None, "a"])], "id int, text string, at int")
    got = refine.hashed_embedding(df, "text", 16)
    rows = {r["id"]: r["embedding"] for r in got.collect()}
    want = plain_embeddings(texts, 16)
    assert rows == {i: want[t] for i, t in enumerate(texts)} | {7: None, 8: want["a"]} and got.columns == ["id", "text", "at", "embedding"]
    assert refine.hashed_embedding(df.limit(0), "text").count() == 0


def shuffled(spark):
    each = spark._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_hashed_embedding_of_many_texts_shuffles_rare_grams_alone(spark):
    usual = [f"w{i}" for i in range(300)]
    texts = [" ".join([*usual, f"own{i}", f"pair{i // 2}", usual[i % 7]]) for i in range(2500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    before = shuffled(spark)
    got = {r["text"]: r["embedding"] for r in refine.hashed_embedding(df, "text", 16).collect()}
    assert got == plain_embeddings(texts, 16)
    assert shuffled(spark) - before < 4 * sum(map(len, texts))  # each of 600 grams with its text would be a hundred times that


def test_refinement_by_known_texts(spark):
    service, noise = ["requests.get(url)", "httpx.post(url, body)", "client.get(url)"], ["log.debug(x)", "print(x)", "assert x == y"]
    rows = [(i, "rest", "d", t, "medium") for i, t in enumerate(["requests.post(url)", "print(y)", None])]
    links = spark.createDataFrame(rows, "id int, protocol string, dependency string, evidence string, confidence string")
    text = lambda t: refine.evidence_text(F.lit("rest"), F.lit("d"), F.lit(t))
    one = spark.range(1)
    anchors = None
    for known, texts in ((True, service), (False, noise)):
        for t in texts:
            row = one.select(text(t).alias("text"), F.lit(known).alias("is_service"))
            anchors = row if anchors is None else anchors.union(row)
    got = {r["id"]: r for r in refine.refine_by_texts(links, anchors).collect()}
    assert got[0]["confidence"] == "high" and got[1]["confidence"] == "low" and got[2]["confidence"] == "medium" and got[2]["ml_reasoning"] == "no_evidence"
    assert got[0]["ml_confidence"] > 0.6 > got[1]["ml_confidence"]
    assert refine.refine_by_texts(links, anchors.filter("is_service")).columns == links.columns


def test_deduplication_of_equal_places_does_not_hang_on_order(spark):
    rows = [("a", "f:1", "rest", "t", "pattern:x", 5), ("b", "f:1", "rest", "t", "pattern:y", 5), ("c", "f:1", "rest", "t", "wrapper_trace:w", 1)]
    made = lambda own: relations.dedupe_connections(spark.createDataFrame(own, "source_service string, source_file string, protocol string, target_name string, extraction_method string, seq long").coalesce(1)).collect()
    assert made(rows) == made(rows[::-1]) and made(rows)[0]["source_service"] == "a"
