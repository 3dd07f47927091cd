"""Operator 7: harmonic packing of tokenised documents into fixed-length sequences.

A document longer than a sequence fills whole ones; what is left of it goes, uncut, to class
k = capacity // length, whose bins take exactly k documents.  The gap that a full bin leaves is closed by the head of
the next document, the only cut that packing makes.  Every task fills its own bins and nothing is shuffled.  At a
task's end the bins still open are joined into full sequences and, at the very end, ones of powers of two, so no padding arises.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

OUT = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers; the memory of full tables is given back at once.
CACHE = 700_000
LETTERS = re.compile(r"[\x00-\x7fß-öø-ÿ]*", re.S)
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\s0-9a-z\x80-\xff]+")


class WordIds(dict):
    """Little-endian ids of a run of lower-case text between blanks; fills itself."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        pieces = PIECES.findall(word)
        if len(pieces) == 1:
            found = array("I", self.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        else:
            found = b"".join([self[p] for p in pieces])
        self[word] = found
        return found


@lru_cache(maxsize=2)
def token_ids(path: str):
    """A function text -> little-endian unsigned 32-bit ids, as tokenizers gives them for the whole text.

    The tokenizer lower-cases, drops white space and encodes each word by itself, so ids of
    words are kept and joined.  Texts with other characters than ASCII and the lower-case letters of
    Latin-1, for which NFC or case may matter across that rule, and texts that hold one of the
    tokenizer's added tokens, which it gives an id of their own, go to the tokenizer whole.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    word = Tokenizer.from_file(path)
    word.encode_special_tokens = True
    word.normalizer = None
    word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    ids = WordIds(word.encode)

    def encode(text: str) -> bytes:
        low = text.lower()
        if not (low.isascii() or LETTERS.fullmatch(low)) or any(t in text for t in added):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(ids) > CACHE:
            ids.clear()
        return b"".join(map(ids.__getitem__, low.encode().split()))

    return encode


class Bins:
    """Open bins by class; ``put`` places a document's ids and ``close`` what is still open.  Both return rows."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next = capacity, task << 40
        self.open: dict[int, list[tuple]] = {}
        #: A bin with its k documents whose gap waits for the next document, and the size of that gap.
        self.waiting: list[tuple] = []
        self.gap = 0

    def put(self, key: int | None, ids: bytes) -> list[tuple]:
        total, at, out = len(ids) // 4, 0, []
        if self.gap:
            at = min(self.gap, total)
            self.waiting.append((key, 0, ids[: 4 * at], total))
            self.gap -= at
            if not self.gap:
                out += self.sequence(self.waiting)
                self.waiting = []
        while total - at >= self.capacity:
            out += self.sequence([(key, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if at < total:
            k = self.capacity // (total - at)
            held = self.open.setdefault(k, [])
            held.append((key, at, ids[4 * at :], total))
            if len(held) == k:
                del self.open[k]
                out += self.full(held)
        return out

    def full(self, held: list[tuple]) -> list[tuple]:
        """A bin that has its k documents: a sequence, or one that waits for the next document."""
        gap = self.capacity - sum(len(ids) for _, _, ids, _ in held) // 4
        if not gap:
            return self.sequence(held)
        self.waiting, self.gap = held, gap
        return []

    def sequence(self, pieces: list[tuple]) -> list[tuple]:
        number, self.next, at, out = self.next, self.next + 1, 0, []
        for key, start, ids, total in pieces:
            out.append((key, start, len(ids) // 4, zlib.crc32(ids), total, number, at))
            at += len(ids) // 4
        return out

    def close(self) -> list[tuple]:
        """One stream of all pieces left, cut where a sequence ends: full ones, then the powers of two that make up the rest."""
        left = [*self.waiting, *(piece for k in sorted(self.open) for piece in self.open[k])]
        size = sum(len(ids) for _, _, ids, _ in left) // 4
        room = [self.capacity] * (size // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if size % self.capacity >> b & 1]
        out, held, free = [], [], 0
        rooms = iter(room)
        for key, start, ids, total in left:
            while ids:
                if not free:
                    out += self.sequence(held) if held else []
                    held, free = [], next(rooms)
                taken, ids = ids[: 4 * free], ids[4 * free :]
                held.append((key, start, taken, total))
                start += len(taken) // 4
                free -= len(taken) // 4
        self.open, self.waiting, self.gap = {}, [], 0
        return out + (self.sequence(held) if held else [])


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    capacity is a power of two; vocabulary is the path of a tokenizers file.  A null or
    empty text is the end id alone.  Repeated rows and null keys are packed like any other;
    an empty table gives none.  A sequence belongs to one task, whose number is in its id.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    tail = array("I", [end_id]).tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = token_ids(vocabulary), Bins(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += bins.put(k, encode(t.as_py() or "") + tail)
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows + bins.close())

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(fill, OUT)
    return out.withColumnRenamed("key", key)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in OUT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
