"""Operators 11, 12 and 13 against plain versions."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from topolake.llm import lexical, pieces, queries, whitening

DOC = "doc_id long, text string, score double, component string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "c") for i, t in enumerate(texts)], DOC).withColumnRenamed("component", "a.b")


# --- 11 -----------------------------------------------------------------------


def plain_whitening(vectors, k=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    centred = np.array([[float(n * c - t) / n for c, t in zip(row, s, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize(("d", "size"), [(5, 1.0), (40, 1e7), (3, 1e12)])
def test_whitening(spark, d, size):
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(300, d)) @ np.diag(np.linspace(1, 3, d)) * size + size
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n int").repartition(5)
    got = whitening.whiten(rows).toPandas()
    deviation, whitened, explained = plain_whitening(vectors)
    m = min(d, 32)
    assert len(got) == 300 * m and set(got["component"]) == set(range(1, m + 1)) and set(got["n"]) == {300}
    for i, own in got.groupby("vec_id"):
        own = own.sort_values("component")
        assert {int(v) for v in own["deviation"]} == {deviation[i]}
        assert np.abs(own["whitened"].to_numpy()) == pytest.approx(np.abs(whitened[i]), abs=1e-6)
        assert own["explained"].to_numpy() == pytest.approx(explained, rel=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_exact_products_and_limbs():
    rng = np.random.default_rng(1)
    for bits in (8, 20, 21, 40, 62):
        x = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (9000 if bits == 20 else 50, 3))
        assert (whitening.cross(x) == x.astype(object).T @ x.astype(object)).all()
    for value in (0, 1, -1, -5, 1 << 48, -(1 << 48), 12345678901234567890123456789, -98765432109876543210987654321):
        assert sum(limb << (whitening.LIMB * k) for k, limb in whitening.limbs_of(value)) == value


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (6, [1e300, 1.0]), (7, [inf, 0.0]), (8, []), (9, [4.0, 7.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 9: 2} and {r["n"] for r in got} == {4}
    same = spark.createDataFrame([(1, [2.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


# --- 12 -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    found = [(key, Counter(own)) for key, t in docs if (own := terms(t))]
    big_n, big_l = len(found), sum(c.total() for _, c in found)
    out = []
    for item, query in items:
        scores = []
        for key, counts in found:
            m = 10 + (90 * counts.total() * big_n) // big_l
            score = 0
            for t in set(terms(query)):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(1 for _, c in found if t in c) + 1)))
                    score += w * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, i + 1, key, -score) for i, (score, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("documents_of_block", "leaf"), [(1 << 14, 256), (60, 4), (7, 1)])
def test_search(spark, monkeypatch, documents_of_block, leaf):
    rng = random.Random(7)
    word = lambda: f"{rng.choice(['Ab', 'x', 'é', '0'])}{int(rng.paretovariate(0.5)) % 300}"
    text = lambda: rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.choice([0, 1, 5, 40, 300])))
    docs = [(i, text()) for i in range(400)] + [(None, "ab1 x1 x2"), (7, "x1"), (7, "x1"), (500, None), (501, "?! \x7f")] + [(i, "Ab1 é1 é1") for i in range(600, 700)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 30])))) for i in range(25)] + [(30, "AB1 ab1"), (31, None), (32, ""), (33, "nowhere"), (None, "x1 É1"), (30, "x1")]
    monkeypatch.setattr(lexical, "DOCUMENTS", documents_of_block)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rows = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in [*items, (30, "x1")]], "item_id long, text string, rank int")
    got = lexical.search(rows, asked).collect()
    want = plain_search(docs, items)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_search_in_passes(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(50)]
    items = [(i, f"a{i} b{i % 3} c") for i in range(9)]
    monkeypatch.setattr(lexical, "QUERY_BYTES", 20)
    rows, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r) for r in lexical.search(rows, asked, k=4).collect()], key=str) == plain_search(docs, items, 4)
    assert lexical.search(rows.limit(0), asked).count() == lexical.search(rows, asked.limit(0)).count() == 0
    assert lexical.search(rows, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_treaps_are_heaps_and_search_trees():
    rng = np.random.default_rng(3)
    n = 2000
    sizes = rng.integers(0, 9, n)
    terms = np.concatenate([np.sort(rng.choice(12, s, replace=False)) for s in sizes])
    block = lexical.Block(rng.permutation(n).tolist(), rng.integers(1, 50, n), terms, rng.integers(1, 4, len(terms)), sizes, np.full(12, 900), n, 50_000)
    assert block.keys == sorted(block.keys)
    seen = 0
    for root in block.root:
        stack, depth = [(int(root), -1, n, 1 << 62, 1)], 0
        while stack:
            v, low, high, most, level = stack.pop()
            if v >= 0:
                assert low < block.doc[v] < high and block.impact[v] <= most
                seen, depth = seen + 1, max(depth, level)
                stack += [(int(block.left[v]), low, block.doc[v], block.impact[v], level + 1), (int(block.right[v]), block.doc[v], high, block.impact[v], level + 1)]
        assert depth < 60
    assert seen == len(terms)


def test_pruning_leaves_most_documents_out():
    n = 1 << 14
    block = lexical.Block(list(range(n)), np.full(n, 10), np.zeros(n, np.int32), np.where(np.arange(n) % 997 == 0, 9, 1), np.ones(n, np.int64), np.array([900]), n, 10 * n)
    visited = []
    plain = block.scores
    block.scores = lambda terms, low, high: visited.append(high - low) or plain(terms, low, high)
    best = block.search(np.array([0]), [], 10)
    assert [d for _, _, d in best] == [997 * i for i in range(10)] and sum(visited) < n / 2


# --- 13 -----------------------------------------------------------------------

PATH = queries.tokenizer_path("piece_bpe_32k.model")
LETTERS = "ab c  ▁é日́ﬁ①　\n\tİΩ𝒳\x00 ½¨<s>0x0A"


def library_pieces(processor, text):
    found = processor.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


def test_pieces(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "▁", "a" * 3000, "日本語" * 20_000, "<s> </s> <unk> <0x0A>", "word " * 5000] + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(600)]
    got = pieces.encode(documents(spark, texts), PATH, decoded=True).select("*", pieces.decode(F.col("ids"), PATH).alias("text")).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert (r["ids"], r["begins"], r["ends"]) == library_pieces(processor, text)
        assert r["ids"] == processor.encode(text) and r["text"] == r["decoded"] == processor.decode(r["ids"]) == text.replace("▁", " ")
        data = text.encode()
        assert "".join(data[b:e].decode() for b, e in zip(r["begins"], r["ends"], strict=True)) == text
    assert pieces.encode(documents(spark, []), PATH).count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert {tuple(r["ids"]) for r in pieces.encode(repeated, PATH).collect()} == {tuple(processor.encode("a b"))}


def test_query_of_texts_without_pieces(spark, tmp_path):
    texts = [None, "", "a b", "\u200b"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, str(tmp_path)).collect()}
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, text in enumerate(texts):
        ids = processor.encode(text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids)))
    assert [got[i]["n_bytes"] for i in range(3)] == [0, 0, 3] and got[0]["ends_sha256"] == got[1]["ends_sha256"] == hashlib.sha256(b"").hexdigest()


def test_query_digests(spark):
    row = queries.op13_sentencepiece(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id") == row["doc_id"]).first()["text"]
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = processor.encode(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids)))


def message(*parts):
    """A protocol-buffer message of (number, value); bytes, whole numbers or, as floats, 32 bits."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    out = b""
    for at, value in parts:
        if isinstance(value, bytes):
            out += number(at << 3 | 2) + number(len(value)) + value
        elif isinstance(value, float):
            out += number(at << 3 | 5) + struct.pack("<f", value)
        else:
            out += number(at << 3) + number(value)
    return out


def model(vocabulary, *trainer, normal=()):
    """A model of (piece, score, type)."""
    own = [(1, message((1, p.encode()), (2, float(s)), (3, kind))) for p, s, kind in vocabulary]
    return message(*own, (2, message((3, 2), *trainer)), (3, message(*normal)))


@pytest.mark.parametrize("rule", ["nmt_nfkc_cf", "nfkc", "nmt_nfkc"])
@pytest.mark.parametrize(("dummy", "trim", "escape"), [(1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 0), (0, 1, 0)])
def test_character_maps(rule, dummy, trim, escape):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=bool(dummy), remove_extra_whitespaces=bool(trim), escape_whitespaces=bool(escape))
    compiled = dict(pieces.fields(normalizer.serialized_normalizer_spec()))[pieces.MAP]
    own = pieces.PieceModel(model([("<unk>", 0, 2), ("a", -1, 1)], normal=((2, compiled), (3, dummy), (4, trim), (5, escape))))
    rng = random.Random(rule)
    for _ in range(1500):
        text = "".join(rng.choice("ab c  ▁é日́ﬁ①　\n\tİΩ𝒳½¨ｶﾞ가가éﬃ ​A") for _ in range(rng.randrange(14)))
        form, places = own.normalized(text)
        want, at = normalizer.normalize(text, with_offsets=True)
        assert form == want and (not form or places.tolist() == list(at))


def test_models_of_other_kinds():
    rng = random.Random(4)
    spread = [("▁", -1), ("a", -2), ("b", -3), ("c", -4), ("ab", -5), ("▁a", -6), ("abc", -7), ("bc", -8), ("▁ab", -9), ("b▁", -10), ("aa", -5), ("▁▁", -5)]
    base = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(p, s, 1) for p, s in spread]
    fallback = [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    kinds = [
        model(base), model(base[:-3]), model([*base, ("[x]", 0, 4), ("ca", 0, 4)]), model([(p, s, 5 if p in ("ab", "▁ab") else kind) for p, s, kind in base]),
        model([*base, *fallback], (35, 1)), model(base, (24, 1)), model(base[:3] + base[4:]),
    ]
    for data in kinds:
        processor, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel(data)
        for _ in range(400):
            text = "".join(rng.choice(["a", "b", "c", " ", "[x]", "é", "日", "z"]) for _ in range(rng.choice([3, 12, 90])))
            assert tuple(x.tolist() for x in own.encode([text])[0]) == library_pieces(processor, text)
    with pytest.raises(ValueError, match="merge"):
        pieces.PieceModel(message((1, message((1, b"<unk>"), (3, 2)))))
