"""Operators 2, 4, 5, 6, 7 and 8, and the pipeline, against plain versions."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topolake.llm import embed_dedup, langid, minhash, packing, quality, queries, token_count
from topolake.llm.components import connected, mixed_units
from topolake.llm.store import Workspace

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    return df.withColumns({"key": F.lit(1), "n": F.lit("t"), "score": F.lit(0.1), "node": F.lit(3), "label": F.lit("x")}) if extra else df


ODD = [None, "", " \t\n", "x", "it's a Test", "ÉTÉ Straße İstanbul ΣΑΣ e\u0301", "<|endoftext|> 12 a1b2", "é<|startoftext|>x <|STARTOFTEXT|>", "\x85\xa0a\x0bb\x0cc", "日本語 テキスト", "w" * 3000, "a b " * 9000]


# --- 2 ------------------------------------------------------------------------


def test_token_counts(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    pieces = {*token_count.vocabulary(path), *(bytes([b]) for b in range(256))}

    def greedy(word):
        n = 0
        while word:
            word = word[next(k for k in range(min(len(word), 140), 0, -1) if word[:k] in pieces) :]
            n += 1
        return n

    got = {r["doc_id"]: tuple(r)[1:] for r in token_count.token_counts(documents(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(greedy(b" " + w) for w in words), len((t or "").encode()))
    assert token_count.token_counts(documents(spark, []), path).count() == 0


def test_automaton_with_few_pieces():
    pieces = [b"abc", b"ab", b"bcd", b"cde", b"abcdx"]
    known = {*pieces, *(bytes([b]) for b in range(256))}
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdex") for _ in range(rng.randrange(0, 30))) for _ in range(500)]

    def greedy(word):
        n = 0
        while word:
            word, n = word[next(k for k in range(len(word), 0, -1) if word[:k] in known) :], n + 1
        return n

    assert token_count.Automaton(pieces).counts(words).tolist() == [greedy(w) for w in words]


def test_long_words_in_a_loop():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(80)]
    automaton = token_count.Automaton(pieces)
    words = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 1, 7, 900, 5000)]
    assert automaton.counts(words).tolist() == [automaton.count(w) for w in words]
    began = time.perf_counter()
    automaton.count(b"abcab" * 200_000)
    assert time.perf_counter() - began < 5


# --- 4 and 5 ------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdehilnorstu") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(5, 200))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(rng.randrange(5, 200)))
    texts = [bad() if i % 4 == 0 else good() for i in range(900)] + [None, "", "x" * 300_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(documents(spark, ["a", None]), labels).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_long_text_scores_as_its_worst_chunk():
    model = quality.QualityModel()
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(32, 127, 3 * quality.CHUNK + 5, dtype=np.uint8))
    whole = model.head(model.pooled(*quality.as_groups([text])))
    assert model.probabilities([text]) == pytest.approx(whole, abs=1e-6)


def test_language(spark):
    rng = random.Random(6)
    letters = {"xx": "abcde", "yy": "éèàçu", "zz": "qwxyz"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randrange(5, 150)))
    langs = [rng.choice(list(letters)) for _ in range(600)]
    rows = [(i, make(lang), lang) for i, lang in enumerate(langs)] + [(1000, None, "xx"), (1001, "123 !?", "xx"), (1002, "", None), (None, "abcde abc", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(none).first()["lang_pred"] == "und" and langid.identify(none.limit(0)).count() == 0


# --- 6 ------------------------------------------------------------------------


def components(sets, percent):
    label = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\x0b "]).join(copy))
    return texts + [None, "", " ", "One", "one", "one two", "ONE TWO", "one two three"] + texts[:5]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    texts = near_texts(width)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(documents(spark, texts), width, percent).collect()}
    sets = {i: shingles(t, width) for i, t in enumerate(texts)}
    label = components(sets, percent)
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_odd_rows(spark):
    same = "a b c d e f g"
    rows = [(5, same), (5, same), (3, same), (None, same), (7, "other words here now"), (7, same), (9, None)]
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 7, True), (9, 9, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = minhash.one_of_each(documents(spark, [same, same + " h", "x y z", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == documents(spark, []).columns


def test_sets_that_share_a_node(spark):
    """Nodes of 6 bits, which unlike sets share."""
    texts = near_texts(3)
    rows = documents(spark, texts, False).select(F.col("doc_id").alias("key"), "text")
    got = {r["key"]: (r["n"], r["least"] if r["node"] is not None else r["key"]) for r in minhash.judged(rows, 3, 85, "key", "text", Workspace(spark, "test"), bits=6).collect()}
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    label = components(sets, 85)
    assert len({frozenset(s) for s in sets.values()}) > 64
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_long_documents_that_share_bands_unlinked(spark):
    """Each alone weighs two fifths of a unit, so that few of them make several blocks, of which some are empty."""
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join([*words[: 1_000 * k], *(f"v{k}x{i}" for i in range(1_000)), *words[1_000 * (k + 1) :]]) for k in range(8)]
    got = minhash.near_duplicates(documents(spark, [*texts, texts[3] + " end"]), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{k: k for k in range(8)}, 8: 3}


def test_one_of_each_with_repeated_ids(spark):
    same = "a b c d e f g"
    rows = [(3, same, "x"), (7, same, "x"), (7, "other words here now", "x"), (7, "other words here now", "y"), (5, "p q r s t", "x"), (5, "P q  r s t", "x"), (8, "p q r s t", "x")]
    rows += [(9, None, "x"), (9, None, "x"), (9, "", "x"), (None, same, "x"), (None, same, "x")]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = sorted((r["doc_id"] or -1, " ".join((r["text"] or "").lower().split()), r["text"] is None) for r in kept)
    assert got == [(-1, same, False), (-1, same, False), (3, same, False), (5, "p q r s t", False), (7, "other words here now", False), (9, "", False), (9, "", True)]


def test_words_in_pieces(monkeypatch):
    text = ("ab cde  f\n" * 300 + "z" * 900 + " end").encode()
    whole = minhash.word_hashes(text)[0]
    monkeypatch.setattr(minhash, "CHUNK", 256)
    assert np.array_equal(np.concatenate([minhash.word_hashes(p)[0] for p in minhash._pieces(text)]), whole)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    assert all(label[x] == got.get(x, x) for x in label)


# --- 7 ------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ODD + [" ".join("".join(rng.choice("abcéÀ.,!'s") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 3000))) for _ in range(40)]
    rows = packing.pack(documents(spark, texts).repartition(3), path).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for held in sequences.values():
        held.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in held)
        assert [r["offset"] for r in held] == np.cumsum([0, *[r["length"] for r in held]])[:-1].tolist()
        assert total <= 4096 and total & (total - 1) == 0
    full = sum(i.doc_tokens // 4096 for i in (p[0] for p in pieces.values()))
    assert len(rows) - full < 2 * len(texts) + 12 * 3
    assert packing.pack(documents(spark, []), path).count() == 0


def test_bins_take_k_documents_of_class_k():
    rng = random.Random(4)
    bins, rows = packing.Bins(1, 64), []
    sizes = [rng.randrange(1, 150) for _ in range(3000)]
    for i, n in enumerate(sizes):
        rows += bins.put(i, bytes(4 * n))
    whole = len(rows)
    rows += bins.close()
    held = {}
    for r in rows:
        held.setdefault(r[5], []).append(r)
    assert all(sum(p[2] for p in held[r[5]]) == 64 for r in rows[:whole])
    for own in held.values():
        last = [p for p in own if p[1] + p[2] == p[4]]
        if own[0] in rows[:whole] and len(own) > 1:  # k documents of class k, then heads of others in the gap
            k = 64 // own[0][2]
            assert all(64 // p[2] == k and p in last for p in own[:k]) and all(p[1] == 0 for p in own[k:])
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r[0], []).append((r[1], r[2]))
    assert all(sum(n for _, n in by_doc[i]) == size and len(by_doc[i]) <= 2 + size // 64 or i in {r[0] for r in rows[whole:]} for i, size in enumerate(sizes))


# --- 8 ------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(60, 32))
    vectors = [c + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.2]) for c in centres for _ in range(rng.integers(1, 20))]
    vectors += [vectors[0], vectors[0] * 1e200, vectors[3]]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] + [0.0] * 31, [1.0, 2.0]]
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], 0) for i, v in enumerate([*vectors, *odd])]
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))).collect()}
    x = np.stack(vectors)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    n = len(vectors)
    found = sum(got[i][0] for i in range(n))
    assert found <= near.sum() and found >= 0.97 * near.sum() and all(got[i][0] <= near[i].sum() for i in range(n))
    assert all(got[n + i] == (0, n + i, True) for i in range(len(odd)))
    assert got[n - 3][1] == got[0][1] and all(k == (c == i) for i, (_, c, k) in got.items())


@pytest.mark.parametrize("dims", [4, 8, 16, 64, 384])
@pytest.mark.parametrize("total", [10_000, 1 << 20, 10**9])
def test_tables_meet_at_any_size_and_dimension(dims, total):
    """Held-out vectors with partners at exactly the threshold meet in some table and stay after their codes are compared."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(min(total, embed_dedup.SAMPLE) + 4000, dims)))
    index, a = embed_dedup.fitted(x[:-4000], total, 0.95), x[-4000:]
    b = rng.normal(size=a.shape)
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * unit(b - (a * b).sum(1, keepdims=True) * a)
    keys = [index.keys(v) for v in (a, b)]
    met = (keys[0][:, :, :, None] == keys[1][:, :, None, :]).any((1, 2, 3))
    near = np.bitwise_count(index.codes(a) ^ index.codes(b)).sum(1) <= index.radius
    assert (met & near).mean() >= 0.985
    assert dims < 16 or index.tables * total / 2**index.width < 2000


def test_embeddings_of_two_lengths(spark):
    rng = np.random.default_rng(13)
    wide, narrow = ([v for c in rng.normal(size=(12, dims)) for v in (c, c, c + 0.01 * rng.normal(size=dims))] for dims in (24, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*wide, *narrow, *narrow[:3], np.ones(5)])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    n = len(wide)
    assert all(got[i] == (2, i // 3 * 3) for i in [*range(n), *range(n + 3, 2 * n)])
    assert all(got[i] == (5, n) for i in [*range(n, n + 3), *range(2 * n, 2 * n + 3)]) and got[2 * n + 3] == (0, 2 * n + 3)


def test_few_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(empty).count() == 0
    same = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(same).collect()) == [(0, 2, 1), (1, 2, 1), (2, 2, 1)]


# --- pipeline -----------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdehilnorstu") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(60)) for _ in range(80)]
    texts = good + [t.upper().replace(" ", "!! ") for t in good[:20]] + good[:10] + [good[20] + " token=abcdefghijklmnop1"]
    documents(spark, texts, False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 80 <= i < 100), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.count())
        assert docs.columns == columns or name == "packing"
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in docs.filter("doc_id < 80").select("doc_id").collect()) == list(range(80))
            assert docs.filter("doc_id between 100 and 109").count() == 0
        if name == "secrets":
            assert docs.filter("text like '%abcdefghijklmnop1%'").count() == 0
    assert seen[0] >= seen[1] == seen[2] and len(seen) == 5
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.select("doc_id", "length").exceptAll(docs.select("doc_id", "length")).count() == 0


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    texts = ["the same words stand here twice and once more"] * 3 + [f"{w} other words in a row that nobody repeats {w}" for w in "abc"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7, f"x{i}", i, "m") for i, t in enumerate(texts)], f"{DOC}, _one_key int, `a.b` string, row int, mark string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.union(docs.filter("doc_id = 0"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r["_one_key"], r["a.b"], r["row"], r["mark"]) == (7, f"x{r['doc_id']}", r["doc_id"], "m")
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == [0, 3, 4, 5]


def test_heavy_nodes_make_units_smaller(spark):
    members = spark.createDataFrame([(1, n, n % 3) for n in range(60)], "bucket long, node long, label long")
    weights = spark.createDataFrame([(n, 0.1) for n in range(60)], "node long, weight double")
    light, heavy = mixed_units(members), mixed_units(members, weights)
    pairs = lambda units: {(min(a, b), max(a, b)) for rows in units for a, x in rows[0] for b, y in rows[1] if x != y}
    sides = lambda df: [tuple([(r["node"], r["label"]) for r in own if r["side"] == side] for side in (0, 1)) for own in _by_unit(df.collect())]
    assert pairs(sides(light)) == pairs(sides(heavy)) == {(b, a) for a in range(60) for b in range(a) if a % 3 != b % 3}
    assert max(len(r[1]) for r in sides(light)) == 60 and max(len(r[1]) for r in sides(heavy)) < 25


def _by_unit(rows):
    units = {}
    for r in rows:
        units.setdefault((r["u1"], r["u2"], r["u3"]), []).append(r)
    return units.values()
