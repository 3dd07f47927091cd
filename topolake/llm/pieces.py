"""Operator 13: SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest rules of the model's compiled character map, and every
character of the normal form remembers the source byte that it came from.  Pieces are merged pairs of that
normal form, so their ends lead back to bytes of the original text.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topolake.shipping import ship

LISTS = ["ids", "begins", "ends"]
#: Runs whose pieces a worker remembers, characters of the longest such run, and texts of an output batch.
CACHE, REMEMBERED, BATCH = 600_000, 48, 512
#: Fixed values of the model format: field numbers, piece and model types, and the mark for a blank.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, SUFFIX, FALLBACK, BPE = 3, 24, 35, 2
MAP, DUMMY, TRIM, ESCAPE = 2, 3, 4, 5
BLANK = "▁"
#: The rank of pairs that don't merge, and where the numbers of characters begin that are no pieces.
NEVER, OTHER = 1 << 40, 1 << 24


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed 32-bit values as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """A compiled map: a double-array trie over the bytes of what is replaced, and the replacements' texts.

    A unit of the array holds a label in its low byte, an offset to its children and whether a value is
    among them (bit 8); a value is the place of its text.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = array("I", compiled[4 : 4 + size]) if size else array("I", [0])
        self.texts = compiled[4 + size :]
        self.known: dict[str, tuple[int, str | None] | None] = {}

    def step(self, at: int, data: bytes) -> int:
        """The unit reached from unit ``at`` by data, or -1."""
        for byte in data:
            unit = self.units[at]
            at ^= (unit >> 10) << ((unit & 512) >> 6) ^ byte
            if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
                return -1
        return at

    def value(self, at: int) -> str | None:
        unit = self.units[at]
        if not unit & 256:
            return None
        place = self.units[at ^ (unit >> 10) << ((unit & 512) >> 6)] & 0x7FFFFFFF
        return self.texts[place : self.texts.index(b"\0", place)].decode()

    def first(self, char: str) -> tuple[int, str | None] | None:
        """The unit and value of one character; None if no rule begins with it."""
        if char not in self.known:
            at = self.step(0, char.encode())
            self.known[char] = None if at < 0 else (at, self.value(at))
        return self.known[char]

    def longest(self, text: str, start: int) -> tuple[str, int] | None:
        """Replacement and length of the longest rule at a place."""
        at, value = self.first(text[start]) or (-1, None)
        best, end = (None if value is None else (value, 1)), start + 1
        while at >= 0 and end < len(text):
            at = self.step(at, text[end].encode())
            end += 1
            if at >= 0 and (value := self.value(at)) is not None:
                best = value, end - start
        return best


class Runs(dict):
    """Encoded runs; fills itself and keeps the short ones."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        found = self.encode(run)
        if len(run) <= REMEMBERED:
            self[run] = found
        return found


class PieceModel:
    """A pair-merging model of the library's file format."""

    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(data):
            if number == PIECES:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number in (TRAINER, NORMALIZER):
                (trainer if number == TRAINER else normal).update(fields(value))
        if trainer.get(MODEL_TYPE, 1) != BPE:
            raise ValueError("the model doesn't merge pairs")
        self.map = CharacterMap(normal.get(MAP, b""))
        self.dummy, self.trim, escape = (bool(normal.get(k, 1)) for k in (DUMMY, TRIM, ESCAPE))
        self.suffix = bool(trainer.get(SUFFIX, 0))
        self.blank = BLANK if escape else " "
        merged = (NORMAL, USER, UNUSED)
        self.score = {p: s for p, s, kind in pieces if kind in merged}
        self.unused = {p for p, _, kind in pieces if kind == UNUSED}
        user = sorted((p for p, _, kind in pieces if kind == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        self.user_starts = {p[0] for p in user}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in merged} | {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in merged}
        self.lengths = np.array([len(p) for p, _, _ in pieces])
        self.kind = [kind for _, _, kind in pieces]
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = [self.id[f"<0x{b:02X}>"] for b in range(256)] if trainer.get(FALLBACK, 0) else None
        #: No piece goes on with a blank after another character, so that runs which begin with blanks are encoded each by itself.
        self.apart = self.blank in self.score and not any(re.search(f"[^{self.blank}]{self.blank}", p) for p in self.score)
        joined = "".join(sorted({c for p in self.score if len(p) > 1 for c in p} - {self.blank}))
        if self.bytes and joined:  # characters that no longer piece has stand alone too
            letters = "".join(map(re.escape, joined))
            self.runs = re.compile(f"{self.blank}*[{letters}]+|{self.blank}+|[^{letters}{self.blank}]+")
        else:
            self.runs = re.compile(f"{self.blank}*[^{self.blank}]+|{self.blank}+")
        self.known = Runs(self.encode_run)

    # --- the normal form ------------------------------------------------------

    def units(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(normal form, start, length) of consecutive parts; a part with rules, user pieces or, when blanks are trimmed, blanks is the shortest possible."""
        special = {c for c in set(text) if self.map.first(c) or c in self.user_starts or (self.trim and c == " ")}
        at = 0
        if special:
            marks = re.compile("[" + "".join(map(re.escape, sorted(special))) + "]")
            while found := marks.search(text, at):
                start = found.start()
                if start > at:
                    yield text[at:start], at, start - at
                own = self.user and self.user.match(text, start)
                rule = (own[0], len(own[0])) if own else self.map.longest(text, start) or (text[start], 1)
                yield rule[0], start, rule[1]
                at = start + rule[1]
        if at < len(text):
            yield text[at:], at, len(text) - at

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form, and the source character of each of its characters and of its end."""
        out: list[str] = []
        source: list[np.ndarray] = []
        after_blank, end, begun = self.trim, 0, 0
        for form, start, length in self.units(text):
            kept = form.lstrip(" ") if after_blank else form
            if kept:
                if not out:
                    begun = start
                out.append(kept)
                source.append(np.arange(start, start + length) if len(form) == length and form == text[start : start + length] and len(kept) == length else np.full(len(kept), start))
                after_blank = self.trim and kept.endswith(" ")
            end = start + length
        normal, places = "".join(out), np.concatenate([*source, [end]])
        if self.trim:
            length = len(normal.rstrip(" "))
            normal, places = normal[:length], places[: length + 1]
        normal = normal.replace(" ", self.blank)
        if self.trim and normal.endswith(BLANK) and self.blank == BLANK:  # written blank marks at the end go too
            length = len(normal.rstrip(BLANK))
            normal, places = normal[:length], places[: length + 1]
        if not normal and (self.trim or not text):
            return "", places[:1]
        if self.dummy:
            if self.suffix:
                normal, places = normal + self.blank, np.append(places, places[-1])
            else:
                normal, places = self.blank + normal, np.append(begun, places)
        return normal, places

    # --- pieces ---------------------------------------------------------------

    def merge(self, run: str) -> list[str]:
        """Pieces of a run of any length: always the pair with the best score next, the leftmost of equals."""
        if self.user:
            symbols, at = [], 0
            for found in self.user.finditer(run):
                symbols += [*run[at : found.start()], found[0]]
                at = found.end()
            symbols += run[at:]
            frozen = [self.kind[self.id.get(s, self.unknown)] == USER for s in symbols]
        else:
            symbols, frozen = list(run), None
        score, n = self.score, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        made: dict[str, tuple[str, str]] = {}
        agenda: list[tuple[float, int, str, int]] = []

        def add(i: int, j: int) -> None:
            if i < 0 or j < 0 or (frozen and (frozen[i] or frozen[j])):
                return
            pair = symbols[i] + symbols[j]
            if (s := score.get(pair)) is not None:
                heapq.heappush(agenda, (-s, i, pair, j))
                if pair in self.unused:
                    made[pair] = symbols[i], symbols[j]

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, pair, j = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            add(left[i], i)
            add(i, right[i])
        out = [s for s in symbols if s]
        while made and any(s in made for s in out):
            out = [part for s in out for part in (made[s] if s in made else (s,))]
        return out

    def encode_run(self, run: str) -> bytes:
        return self.packed(map(self.symbol, self.merge(run)))

    def packed(self, symbols: Iterable[int]) -> bytes:
        """(id, length) of symbols, the length in characters of the normal form, all as 32-bit numbers.

        An unknown character becomes its bytes, of which the last has its length, or else joins the unknown ones before it.
        """
        out, before = array("i"), False
        for number in symbols:
            unknown = number >= OTHER
            if not unknown:
                out.extend((number, int(self.lengths[number])))
            elif self.bytes:
                *data, last = chr(number - OTHER).encode()
                out.extend(x for b in data for x in (self.bytes[b], 0))
                out.extend((self.bytes[last], 1))
            elif before:
                out[-1] += 1
            else:
                out.extend((self.unknown, 1))
            before = unknown
        return out.tobytes()

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of symbols, in order, as left << 32 | right; what each becomes, and its rank among all scores.

        A symbol is a piece's id, or for a character that isn't one a number beyond all ids.
        """
        ranks = {s: i for i, s in enumerate(sorted({*self.score.values()}, reverse=True))}
        found = {(self.symbol(p[:i]) << 32) | self.symbol(p[i:]): (self.id[p], ranks[s]) for p, s in self.score.items() for i in range(1, len(p)) if (i == 1 or p[:i] in self.score) and (len(p) - i == 1 or p[i:] in self.score)}
        keys = sorted(found)
        return np.array(keys or [-1], np.int64), *np.array([found[k] for k in keys] or [(0, NEVER)], np.int64).T

    def symbol(self, piece: str) -> int:
        number = self.id.get(piece)
        return OTHER + ord(piece) if number is None or number == self.unknown else number

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols become, and their ranks; NEVER where they stay apart."""
        keys, made, ranks = self.pairs
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        fits = keys[at] == wanted
        return made[at], np.where(fits, ranks[at], NEVER)

    def remember(self, runs: list[str]) -> None:
        """Encode short runs without user pieces: those of one length together, a merge in each at a time."""
        by_length: dict[int, list[str]] = {}
        for run in runs:
            by_length.setdefault(len(run), []).append(run)
        for width, own in by_length.items():
            points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
            chars, place = np.unique(points, return_inverse=True)
            symbols = np.array([self.symbol(chr(c)) for c in chars], np.int64)[place].reshape(-1, width)
            rows = np.arange(len(own))
            made, ranks = self.merged(symbols[:, :-1], symbols[:, 1:])
            while True:
                at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
                going = ranks[np.arange(len(rows)), at] < NEVER if ranks.shape[1] else np.zeros(len(rows), bool)
                self._settle([own[i] for i in rows[~going]], symbols[~going])
                if not going.any():
                    break
                rows, symbols, made, ranks, at = rows[going], symbols[going], made[going], ranks[going], at[going]
                each, n = np.arange(len(rows)), ranks.shape[1]
                symbols[each, at] = made[each, at]
                right, pair = np.arange(n), np.arange(n - 1)
                symbols = np.take_along_axis(symbols, right + (right > at[:, None]), 1)
                made, ranks = (np.take_along_axis(x, pair + (pair >= at[:, None]), 1) for x in (made, ranks))
                for beside in (at - 1, at):
                    some = np.flatnonzero((beside >= 0) & (beside < n - 1))
                    b = beside[some]
                    made[some, b], ranks[some, b] = self.merged(symbols[some, b], symbols[some, b + 1])

    def _settle(self, runs: list[str], symbols: np.ndarray) -> None:
        known = (symbols < OTHER).all(axis=1)
        out = np.stack([symbols, self.lengths[np.where(symbols < OTHER, symbols, 0)]], axis=2).astype(np.int32)
        data, size = out.tobytes(), 8 * symbols.shape[1]
        for i, (run, whole) in enumerate(zip(runs, known.tolist(), strict=True)):
            self.known[run] = data[i * size : (i + 1) * size] if whole else self.packed(symbols[i].tolist())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids and the original bytes, begin and end, of its pieces."""
        if len(self.known) > CACHE:
            self.known.clear()
        forms = [self.normalized(text) for text in texts]
        runs = [self.runs.findall(form) if self.apart else [form] if form else [] for form, _ in forms]
        if not self.user and not self.unused:
            self.remember([run for run in set().union(*runs) if len(run) <= REMEMBERED and run not in self.known])
        out = []
        for text, (_, places), own in zip(texts, forms, runs, strict=True):
            ids, lengths = np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32).reshape(-1, 2).T
            ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
            if not text.isascii():
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                places = np.append(0, np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)))[places]
            cuts = places[ends]
            out.append((ids, cuts[:-1], cuts[1:]))
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


@lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids, begins, ends) of every row: ids of the text's pieces and the bytes of its UTF-8 form that each stands for.

    path: a pair-merging SentencePiece model on every worker.  The pieces of one text lie side by side: where the normal form drops
    blanks, a gap is left; of the bytes that an unknown character falls back to, the last has its span and the others are empty; so is the
    blank put before a text.  Neither begin nor end ids are added.  A null or empty text has no pieces.  decoded: add the text that decode makes of the ids.
    Repeated rows and null keys are encoded like any other; an empty table gives none.
    """
    ship(docs.sparkSession)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    names = [*LISTS, "decoded"] if decoded else LISTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                found = model.encode([t.as_py() or "" for t in part.column(1)])
                offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own).astype(np.int32))) for own in zip(*found, strict=True)]
                if decoded:
                    columns.append(pa.array([library(path).decode(ids.tolist()) for ids, _, _ in found], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *names])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def decode(ids, path: str):
    """A column of texts for a column of arrays of ids, as the library decodes them; null for null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        return pa.array([library(path).decode(values[a:b].tolist()) if valid else None for a, b, valid in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)], pa.string())

    return run(ids)
