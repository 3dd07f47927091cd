"""Operator 12: ranked lexical search with inverted treaps.

The terms that the queries ask for are counted once in every document.  That table is then searched in blocks of
documents, each within one task: a block holds a treap for every term, a search tree by document and a heap by impact.  A query walks the
treaps of its terms together.  The roots over a range of documents are its greatest impacts, so a range whose roots add up to
less than the k-th score so far is left out whole.  Tasks keep their k best from block to block; nothing but those is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from topolake.llm.store import Workspace
from topolake.shipping import ship

#: Bytes of query texts that are searched for in one pass, about; more queries take more passes.
QUERY_BYTES = 8 << 20
#: Documents and postings of a block, at most (a document more), and documents of a range that is scored at once.
DOCUMENTS, POSTINGS, LEAF = 1 << 14, 1 << 21, 256
#: All ASCII bytes but letters and digits end a term.
BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(BREAKS).split()  # bytes: A-Z only


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Treaps over the postings of some documents.

    Postings lie by term, then document.  ``left`` and ``right`` are a posting's children, -1 where there is none; ``root`` has each term's.
    A node's impact is at least those below it; equal ones are ordered by a hash, which keeps trees of many equal impacts flat.
    """

    def __init__(self, keys: list, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, documents: int, words: int):
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
        self.keys, self.size = [keys[i] for i in order], len(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        doc = place[np.repeat(np.arange(len(keys)), sizes)]
        places = terms.astype(np.int64) * self.size + doc
        by = np.argsort(places, kind="stable")
        self.places, self.doc = places[by], doc[by]
        term, tf = terms[by], counts[by].astype(np.int64)
        m = np.array([100 - 90 + (90 * int(n) * documents) // words for n in lengths], np.int64)[np.array(order, np.int64)]
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self._build(term, len(weights))

    def _build(self, term: np.ndarray, n_terms: int) -> None:
        n = len(term)
        at = np.arange(n)
        rank = np.append((self.impact << 16) | ((self.doc * 0x9E3779B1 >> 7) & 0xFFFF), np.iinfo(np.int64).max)  # the last stands for no node
        before = np.where(np.append(-1, term)[:-1] == term, at - 1, n)
        after = np.where(np.append(term, -1)[1:] == term, at + 1, n)
        for near, less in ((before, np.less), (after, np.less_equal)):  # nearest greater postings of the term: all between are less
            todo = at
            while len(todo := todo[less(rank[near[todo]], rank[todo])]):
                near[todo] = near[near[todo]]
        up_right = rank[after] < rank[before]
        parent = np.where(up_right, after, before)
        self.left, self.right, self.root = np.full(n, -1), np.full(n, -1), np.full(n_terms, -1)
        top = parent == n
        self.root[term[top]] = at[top]
        self.left[parent[up_right & ~top]] = at[up_right & ~top]
        self.right[parent[~up_right & ~top]] = at[~up_right & ~top]

    def within(self, nodes: np.ndarray, low: int, high: int) -> np.ndarray:
        """Of each tree below nodes the highest node from low to below high; trees without one go."""
        nodes = nodes.copy()
        while True:
            nodes = nodes[nodes >= 0]
            doc = self.doc[nodes]
            small, large = doc < low, doc >= high
            if not (small.any() or large.any()):
                return nodes
            nodes[small] = self.right[nodes[small]]
            nodes[large] = self.left[nodes[large]]

    def scores(self, terms: np.ndarray, low: int, high: int) -> np.ndarray:
        """Scores of all documents from low to below high."""
        start, end = np.searchsorted(self.places, np.concatenate([terms * self.size + low, terms * self.size + high])).reshape(2, -1)
        sizes = end - start
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.zeros(high - low, np.int64)
        np.add.at(out, self.doc[at] - low, self.impact[at])
        return out

    def search(self, terms: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The k best of ``best`` and of this block, as (-score, is null, document), in order."""
        roots = self.root[terms]
        ranges = [(0, self.size, roots[roots >= 0])]
        while ranges:
            low, high, nodes = ranges.pop()
            enough = -best[k - 1][0] if len(best) >= k else 1
            if not len(nodes) or self.impact[nodes].sum() < enough:
                continue
            if high - low <= LEAF:
                best = self._kept(best, self.scores(terms, low, high), low, enough, k)
                continue
            pivot = int(self.doc[nodes[self.impact[nodes].argmax()]])
            best = self._kept(best, self.scores(terms, pivot, pivot + 1), pivot, enough, k)
            halves = [(a, b, self.within(nodes, a, b)) for a, b in ((low, pivot), (pivot + 1, high)) if a < b]
            ranges += sorted(halves, key=lambda r: int(self.impact[r[2]].sum()))  # the more promising one is next
        return best

    def _kept(self, best: list[tuple], scores: np.ndarray, low: int, enough: int, k: int) -> list[tuple]:
        found = np.flatnonzero(scores >= enough)
        if not len(found):
            return best
        if len(found) > k:  # of equals the first, as documents are in order
            found = found[np.argsort(-scores[found], kind="stable")[:k]]
        new = [(-int(scores[i]), self.keys[low + i] is None, self.keys[low + i]) for i in found]
        return sorted(best + new)[:k]


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, words: int) -> Iterator[Block]:
    """Blocks of rows (key, n, terms, counts)."""

    def built(parts: list) -> Block:
        keys, lengths, terms, counts, sizes = zip(*parts, strict=True)
        return Block([k for own in keys for k in own], *(np.concatenate(x) for x in (lengths, terms, counts, sizes)), weights, documents, words)

    parts, rows, postings = [], 0, 0
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(sizes[start:])
            take = max(1, min(DOCUMENTS - rows, int(np.searchsorted(ends, POSTINGS - postings, side="right"))))
            part = batch.slice(start, take)
            parts.append((part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(), sizes[start : start + take]))
            rows, postings, start = rows + len(part), postings + int(ends[len(part) - 1]), start + len(part)
            if rows >= DOCUMENTS or postings >= POSTINGS or start < batch.num_rows:
                yield built(parts)
                parts, rows, postings = [], 0, 0
    if parts:
        yield built(parts)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, counts) of docs (key, text) with at least one term: all terms with repeats, and those of the vocabulary by number with their occurrences."""
    kind = dict(docs.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = vocabulary.get, len(vocabulary) + 1
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lengths, found = [], []
                for i, text in enumerate(part.column(1)):
                    words = terms_of(text.as_py())
                    lengths.append(len(words))
                    own = [t for t in map(number, words) if t is not None]
                    found.append(np.array(own, np.int64) + i * size)
                pairs, counts = np.unique(np.concatenate(found), return_counts=True)
                each = np.bincount(pairs // size, minlength=len(lengths))
                offsets = pa.array(np.append(0, np.cumsum(each)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % size, counts)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], ["key", "n", "terms", "counts"])
                yield out.filter(pa.array(np.array(lengths) > 0))

    return docs.mapInArrow(run, f"key {kind}, n long, terms array<int>, counts array<int>")


def holding(counted: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents that hold each term; a task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return dict(counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents of every query, those with a score above 0, ranks from 1; equal scores by ascending key, null last.

    Terms are runs of letters, digits and all that isn't ASCII, of whole texts, with A-Z in lower case.  A document's score sums over the query's
    distinct terms w * ((1e9 * tf) div (1000 * tf + 8 * m)), in whole numbers, with w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L.
    Null and empty texts have no terms and count nowhere.  Every row of docs is a document, whether its key is null or repeated; equal rows of
    queries are one query, and rows that differ in text alone are several, each ranked apart.  An empty table on either side gives none.

    Queries are the stated set that is held against all documents: QUERY_BYTES of their texts at a time are on the driver and in tasks.
    """
    spark = ship(docs.sparkSession)
    ws = Workspace(spark, "lexical")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    asked = queries.select(F.col(item).alias("item"), F.col(query).cast("string").alias("text")).filter("text is not null").distinct()
    kinds = dict(asked.dtypes)["item"], dict(rows.dtypes)["key"]
    schema = f"item {kinds[0]}, query long, key {kinds[1]}, score long"
    passes = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / QUERY_BYTES))
    found = None
    for i in range(passes):
        part = [(r["item"], set(terms_of(r["text"]))) for r in asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).collect()]
        own = _one_pass(rows, part, i, k, schema, ws)
        if own is not None:
            found = own if found is None else found.union(own)
    if found is None:
        found = spark.createDataFrame([], schema)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _one_pass(rows: DataFrame, queries: list[tuple], number: int, k: int, schema: str, ws: Workspace) -> DataFrame | None:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in queries))))}
    counted = ws.keep(count_terms(rows, vocabulary), "counted")
    documents, words = counted.agg(F.count("*"), F.sum("n")).first()
    if not documents or not vocabulary:
        return None
    held = holding(counted, len(vocabulary))
    weights = np.array([weight(documents, held[i]) if i in held else 0 for i in range(len(vocabulary))], np.int64)
    numbered = [(item, (number << 40) + i, np.array(sorted(t for t in map(vocabulary.get, terms) if weights[t] > 0), np.int64)) for i, (item, terms) in enumerate(queries)]
    item_kind = rows.sparkSession.createDataFrame([], schema).schema["item"].dataType
    key_kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: list[list[tuple]] = [[] for _ in numbered]
        for block in _blocks(batches, weights, documents, words):
            for i, (_, _, terms) in enumerate(numbered):
                best[i] = block.search(terms, best[i], k)
        out = [(item, query, row[2], -row[0]) for (item, query, _), own in zip(numbered, best, strict=True) for row in own]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [to_arrow_type(item_kind), pa.int64(), to_arrow_type(key_kind), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "query", "key", "score"])

    return counted.mapInArrow(run, schema)
