"""Operator 2: token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are found in one pass over its bytes (Song et al.,
2021): a trie of the vocabulary, whose nodes carry failure links and the number of pieces
that following the link pops.  Only counts are kept; no piece is built.
"""

from __future__ import annotations

import json
import random
from array import array
from collections import deque
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OUT = "key long, n_words long, n_tokens long, n_bytes long"
#: Words whose counts a worker remembers, and bytes from which a word is counted by itself and forgotten.
CACHE, LONG = 500_000, 2_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizers file; a piece that begins a word begins with a blank."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    return [bytes(letters[c] for c in e) for e in entries if all(c in letters for c in e)]


class Automaton:
    """Arrays of a double-array trie: the child of v by byte c is at ``base[v] + c`` if ``owner`` of that place is v.

    fail, pops: where to go on and how many pieces that ends, where no child fits.  rest: pieces
    that are left when the word ends at a node.  Single bytes are all pieces, so the root always has a child.
    """

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    whole.append(False)
                at = children[at][c]
            whole[at] = bool(piece)
        n = len(children)
        fail, pops = [0] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                queue.append(v)
                if whole[v]:
                    pops[v] = 1
                else:
                    z, popped = fail[u], pops[u]
                    while c not in children[z]:
                        popped += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = children[z][c], popped
        rest = [0] * n
        for v in range(n):
            at = v
            while at:
                rest[v] += pops[at]
                at = fail[at]
        base, owner, target = self._laid(children)
        self.base, self.owner, self.target = (np.array(x, np.int32) for x in (base, owner, target))
        self.fail, self.pops, self.rest = (np.array(x, np.int32) for x in (fail, pops, rest))

    @staticmethod
    def _laid(children: list[dict[int, int]]) -> tuple[list[int], list[int], list[int]]:
        """Nodes with many children first, each at random places until one is free."""
        size, rng = 4 * len(children) + 1024, random.Random(1)
        owner, target, base = [-1] * (size + 256), [0] * (size + 256), [0] * len(children)
        for v in sorted(range(len(children)), key=lambda v: -len(children[v])):
            own = children[v]
            if own:
                at = rng.randrange(size)
                while any(owner[at + c] >= 0 for c in own):
                    at = rng.randrange(size)
                base[v] = at
                for c, child in own.items():
                    owner[at + c], target[at + c] = v, child
        return base, owner, target

    def count(self, word: bytes) -> int:
        """Pieces of one word, in a plain loop: for long ones, where few others would advance with it."""
        base, owner, target, fail, pops = self.plain
        at = total = 0
        for c in word:
            place = base[at] + c
            while owner[place] != at:
                total += pops[at]
                at = fail[at]
                place = base[at] + c
            at = target[place]
        return total + int(self.rest[at])

    @cached_property
    def plain(self) -> list[array]:
        return [array("i", x.tobytes()) for x in (self.base, self.owner, self.target, self.fail, self.pops)]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words a byte at a time."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        state, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        for i, n in enumerate(alive):
            c = data[starts[:n] + i].astype(np.int32)
            todo = np.arange(n)
            while len(todo):
                at = state[todo]
                place = self.base[at] + c[todo]
                fits = self.owner[place] == at
                state[todo[fits]] = self.target[place[fits]]
                todo, at = todo[~fits], at[~fits]
                total[todo] += self.pops[at]
                state[todo] = self.fail[at]
        out = np.empty(len(words), np.int64)
        out[order] = total + self.rest[state]
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_bytes) of every row.

    Words are runs between ASCII white space; a word's pieces are the greedy longest matches in a
    blank and its bytes.  A null text counts as empty: 0 of each.  Repeated rows and null keys are
    counted like any other; an empty table gives none.  path: a byte-level tokenizers file on every worker.
    """

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                texts = [(t.as_py() or "").encode() for t in batch.column(1)[at : at + 256]]
                split = [t.split() for t in texts]
                long = [[w for w in words if len(w) >= LONG] for words in split]
                short = [[w for w in words if len(w) < LONG] if some else words for words, some in zip(split, long, strict=True)]
                if len(counts) > CACHE:
                    counts = {}
                new = list(set().union(*short) - counts.keys())
                if new:
                    counts.update(zip(new, automaton(path).counts([b" " + w for w in new]).tolist(), strict=True))
                extra = [sum(automaton(path).count(b" " + w) for w in words) for words in long]
                found += [(len(words), sum(map(counts.__getitem__, few)) + more, len(t)) for words, few, more, t in zip(split, short, extra, texts, strict=True)]
            words, tokens, sizes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (words, tokens, sizes)]], ["key", "n_words", "n_tokens", "n_bytes"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT).withColumnRenamed("key", key)
