"""Operator 3: secret scans.

Three patterns give the base spans.  Every other long token has its encoding inferred and runs a battery of
tests of randomness: chi-squared uniformity over the alphabet, runs of character classes and of
vowels, and lag-1 serial correlation.  A token that any of them rejects at REJECT is
no secret.  For the others the same statistics say how well ordinary writing would explain
them; within each length class, those that pass a Benjamini-Hochberg step over
the whole table are secrets.  DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LOWER, DIGITS, OTHER = "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_-"
UPPER, VOWELS = LOWER.upper(), "aeiou"
ALPHABET = LOWER + UPPER + DIGITS + OTHER
#: Standard errors from what a random token would give beyond which a test rejects it: 1 in 10,000 random tokens.
REJECT = 3.9
#: Ordinary writing: of each hundred letters so many are a, b, ..., the chance that the class changes from one
#: character to the next, and that a vowel follows a consonant or the other way round.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
CHANGE, ALTERNATION = 0.25, 0.6
#: Of each hundred letters of writing in both cases so many are lower ones.
LOWER_SHARE = 90
#: Writing in any language: so much of it is like LETTERS, the rest like a random choice of letters; and the factor
#: by which letters of a word depend on each other.
LIKE, DEPENDENT = 0.9, 1.0
#: -log10 p is kept in steps of 1/STEPS, at most TOP of them.
STEPS, TOP = 10, 3000
#: Matches whose places are summed up at a time.
BLOCK = 256
SPAN = "struct<start:int,end:int,kind:string>"


#: How much likelier each letter is in a random token than in writing, as a logarithm.
RARITY = [-math.log(LIKE * w / sum(LETTERS) * 26 + 1 - LIKE) for w in LETTERS]


@dataclass(frozen=True)
class Encoding:
    """What tokens of an alphabet look like when they are random and when they are written."""

    pattern: str
    letters: str

    @property
    def size(self) -> int:
        return len(self.letters)

    def classes(self, power: int) -> float:
        """Chance that ``power`` random characters are of one class."""
        return sum((sum(c in kind for c in self.letters) / self.size) ** power for kind in (LOWER, UPPER, DIGITS, OTHER))

    @property
    def vowels(self) -> float:
        own = [c for c in self.letters.lower() if c in LOWER]
        return sum(c in VOWELS for c in own) / max(1, len(own))

    def written(self, power: int) -> float:
        """Chance that ``power`` characters of ordinary writing in this alphabet agree."""
        both = any(c in LOWER for c in self.letters) and any(c in UPPER for c in self.letters)
        case = lambda c: (LOWER_SHARE if c in LOWER else 100 - LOWER_SHARE) / 100 if both else 1.0
        weights = [LETTERS[LOWER.index(c.lower())] * case(c) for c in self.letters if c.lower() in LOWER]
        return sum((w / sum(weights)) ** power for w in weights)

    @property
    def rarity(self) -> tuple[float, float, float]:
        """Mean, variance and greatest distance from the mean of the rarity of written letters; see ``RARITY``."""
        own = sorted({c for c in self.letters.lower() if c in LOWER})
        weights = [LETTERS[LOWER.index(c)] for c in own]
        shares = [LIKE * w / sum(weights) + (1 - LIKE) / len(own) for w in weights]
        values = [RARITY[LOWER.index(c)] for c in own]
        mean = sum(p * x for p, x in zip(shares, values, strict=True))
        return mean, sum(p * (x - mean) ** 2 for p, x in zip(shares, values, strict=True)), max(values) - mean

    def facts(self) -> Column:
        """Constants of the tests, as a struct."""
        change, v, rarity = 1 - self.classes(2), self.vowels, self.rarity
        mixed = v * (1 - v)
        values = {
            "k": float(self.size), "change": change, "change_cov": self.classes(3) - self.classes(2) ** 2,
            "vowel": 2 * mixed, "vowel_cov": mixed * (1 - 4 * mixed), "pair": self.written(2), "triple": self.written(3),
            "rare": rarity[0], "rare_var": rarity[1] * DEPENDENT, "rare_most": rarity[2],
        }
        return F.struct(*[F.lit(float(x)).alias(name) for name, x in values.items()])


#: Smallest alphabet first; tokens of digits alone are no candidates.
ENCODINGS = (
    Encoding("[0-9a-f]+", DIGITS + "abcdef"), Encoding("[0-9A-F]+", DIGITS + "ABCDEF"),
    Encoding("[a-z]+", LOWER), Encoding("[A-Z]+", UPPER),
    Encoding("[a-z2-7]+", LOWER + "234567"), Encoding("[A-Z2-7]+", UPPER + "234567"),
    Encoding("[a-z0-9]+", LOWER + DIGITS), Encoding("[A-Z0-9]+", UPPER + DIGITS),
    Encoding("[A-Za-z]+", LOWER + UPPER), Encoding("[A-Za-z0-9]+", LOWER + UPPER + DIGITS),
    Encoding("[A-Za-z0-9+/]+", LOWER + UPPER + DIGITS + "+/"), Encoding("[A-Za-z0-9_-]+", LOWER + UPPER + DIGITS + "_-"),
)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end, word) in code points of the leftmost non-overlapping matches whose group has ``least`` characters; word is the group.

    Lengths of gaps and matches are summed in blocks, so that work stays near linear in the matches.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    sizes = F.zip_with(hits, words, lambda h, g: F.struct(F.length(h).alias("hit"), g.alias("word")))
    steps = F.filter(F.zip_with(gaps, sizes, lambda g, s: F.struct(F.length(g).alias("gap"), s.hit.alias("hit"), s.word.alias("word"))), lambda s: s.hit.isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,word:string>>")
    span = lambda start, end, word: F.struct(start.alias("start"), end.alias("end"), word.alias("word"))
    walk = lambda block: F.aggregate(
        block,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, s: F.struct((a["at"] + s.gap + s.hit).alias("at"), F.concat(a.spans, F.array(span(a["at"] + s.gap, a["at"] + s.gap + s.hit, s.word))).alias("spans")),
    )
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: walk(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
    whole = F.aggregate(
        let(steps, blocks),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a.spans, F.transform(b.spans, lambda s: span(s.start + a["at"], s.end + a["at"], s.word))).alias("spans")),
        lambda a: F.filter(a.spans, lambda s: F.length(s.word) >= least),
    )
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    place = lambda s: F.when(s.kind == "assign", 0).when(s.kind == "access", 1).when(s.kind == "hex", 2).otherwise(3)
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), place(s).alias("place"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def base_spans(text: Column) -> Column:
    return in_order(F.concat(of_kind(located(text, ASSIGN, 2, 12), "assign"), of_kind(located(text, ACCESS), "access"), of_kind(located(text, HEX), "hex")))


def statistics(token: Column) -> Column:
    """Of a token without its padding: n, sum of squared counts, class runs, vowel changes, pairs of letters, and the sums of serial correlation."""
    classes = F.translate(token, ALPHABET, "l" * 26 + "u" * 26 + "d" * 10 + "o" * 4)
    vowels = F.translate(token, ALPHABET, "".join("." if c.lower() not in LOWER else "v" if c.lower() in VOWELS else "c" for c in ALPHABET))
    start = F.struct(F.lit(0.0).alias("squares"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("code_squares"), F.lit(0.0).alias("letters"), F.lit(0.0).alias("rarity"))
    count = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double")
    rarity = F.array(*[F.lit(RARITY[LOWER.index(c.lower())] if c.lower() in LOWER else None).cast("double") for c in ALPHABET])
    counts = F.zip_with(F.split(F.lit(ALPHABET), ""), rarity, lambda c, r: F.struct(count(c).alias("n"), F.ascii(c).cast("double").alias("code"), r.alias("rarity")))
    add = lambda a, x: F.struct((a.squares + x.n * x.n).alias("squares"), (a["sum"] + x.n * x.code).alias("sum"), (a.code_squares + x.n * x.code * x.code).alias("code_squares"), (a.letters + F.when(x.rarity.isNotNull(), x.n).otherwise(0.0)).alias("letters"), (a.rarity + F.coalesce(x.n * x.rarity, F.lit(0.0))).alias("rarity"))
    neighbours = lambda cs: F.zip_with(F.slice(cs, F.lit(1), F.size(cs) - 1), F.slice(cs, F.lit(2), F.size(cs) - 1), lambda a, b: F.ascii(a) * F.ascii(b))
    pairs_of = lambda w, pair: (F.length(w) - F.length(F.replace(w, F.lit(pair), F.lit("")))) / 2
    letters = lambda w: F.length(F.regexp_replace(w, "\\.+", ""))
    return F.struct(
        F.length(token).cast("double").alias("n"),
        F.aggregate(counts, start, add).alias("sums"),
        F.length(F.regexp_replace(classes, "l+|u+|d+|o+", ".")).cast("double").alias("runs"),
        let(vowels, lambda w: F.struct((pairs_of(w, "vc") + pairs_of(w, "cv")).alias("changes"), (letters(w) - F.length(F.regexp_replace(F.regexp_replace(w, "[vc]+", "L"), "\\.+", ""))).cast("double").alias("pairs"))).alias("vowels"),
        (F.ascii(token) + F.ascii(F.right(token, F.lit(1)))).cast("double").alias("ends"),
        F.aggregate(let(F.split(token, ""), neighbours), F.lit(0.0), lambda a, x: a + x).alias("products"),
    )


def evidence(token: Column) -> Column:
    """-log10 of the p-value under ordinary writing, in steps; null where the token is a number or a test of randomness rejects it.

    Uniformity: chi-squared over the alphabet, by the cube root of Wilson and Hilferty; as a rate of agreeing pairs it is a
    U-statistic, whose mean and deviation in writing follow from LETTERS, and so does how rare the letters are (by Bernstein's
    bound); the stronger of the two counts, less log 2.  Runs: changes between classes and between
    vowels and consonants against their expectation in a random token, and, as binomial counts bounded by exp(-n KL), in
    writing.  The three join by Fisher's rule.  Serial correlation only rejects.
    """
    facts = F.lit(None)
    for e in reversed(ENCODINGS):
        facts = F.when(token.rlike(f"^(?:{e.pattern})=*$"), e.facts()).otherwise(facts)
    facts = F.when(~token.rlike("^[0-9]+=*$"), facts)
    return let(F.struct(facts.alias("e"), statistics(F.regexp_replace(token, "=+$", "")).alias("s")), lambda x: F.when(x.e.isNotNull() & (x.s.n > 15), _steps(x.e, x.s)))


def _steps(e: Column, s: Column) -> Column:
    n, k, sums = s.n, e.k, s.sums
    chi = k / n * sums.squares - n
    spread = 2 / (9 * (k - 1))
    uniform = (F.cbrt(chi / (k - 1)) - (1 - spread)) / F.sqrt(spread)
    off = lambda changes, pairs, rate, cov: F.when(pairs * rate > 0, (changes - pairs * rate) / F.sqrt(pairs * rate * (1 - rate) + 2 * pairs * cov)).otherwise(0.0)
    class_runs = off(s.runs - 1, n - 1, e.change, e.change_cov)
    vowel_runs = off(s.vowels.changes, s.vowels.pairs, e.vowel, e.vowel_cov)
    mean = sums["sum"] / n
    varied = sums.code_squares - n * mean * mean
    serial = (s.products - mean * (2 * sums["sum"] - s.ends) + (n - 1) * mean * mean) / varied * F.sqrt(n)
    random = (varied > 0) & (F.abs(uniform) <= REJECT) & (F.abs(class_runs) <= REJECT) & (F.abs(vowel_runs) <= REJECT) & (F.abs(serial) <= REJECT)
    agree = (sums.squares - n) / (n * (n - 1))
    error = F.sqrt(2 * e.pair * (1 - e.pair) / (n * (n - 1)) + 4 * (e.triple - e.pair * e.pair) / n)
    z = F.greatest(F.lit(0.0), (e.pair - agree) / error)
    kl = lambda rate, p: F.when(rate > 0, rate * F.ln(rate / p)).otherwise(0.0) + F.when(rate < 1, (1 - rate) * F.ln((1 - rate) / (1 - p))).otherwise(0.0)
    class_rate = (s.runs - 1) / (n - 1)
    vowel_rate = s.vowels.changes / s.vowels.pairs
    more = F.when(class_rate > CHANGE, (n - 1) * kl(class_rate, CHANGE)).otherwise(0.0)
    fewer = F.when((s.vowels.pairs > 0) & (vowel_rate < ALTERNATION), s.vowels.pairs * kl(vowel_rate, ALTERNATION)).otherwise(0.0)
    rare = F.greatest(F.lit(0.0), sums.rarity / sums.letters - e.rare)
    letters = F.when(sums.letters > 0, sums.letters * rare * rare / (2 * (e.rare_var + rare * e.rare_most / 3))).otherwise(0.0)
    alike = F.greatest(F.lit(0.0), F.greatest(z * z / 2, letters) - math.log(2))
    log_p = let(alike + more + fewer, lambda x: -x + F.ln(1 + x + x * x / 2))
    return F.when(random, F.least(F.lit(TOP), F.floor(-log_p / math.log(10) * STEPS).cast("int")))


def length_class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double"))).cast("int")


def overlapping(base: Column, spans: Column, length: Column) -> Column:
    """Those of spans that no base span overlaps.  Both are looked up by stretches of text, about as many as the root of the base spans."""
    stretch = F.ceil((length + 1) / F.ceil(F.sqrt(F.size(base)) + 1)).cast("int")
    meets = lambda s, b: (b.start < s.end) & (s.start < b.end)

    def apart(x: Column) -> Column:
        by_stretch = F.transform(F.sequence(F.lit(0), F.floor(length / x.size).cast("int")), lambda i: F.filter(base, lambda b: (b.start < (i + 1) * x.size) & (i * x.size < b.end)))
        near = lambda s, lists: F.exists(F.sequence(F.floor(s.start / x.size).cast("int"), F.floor((s.end - 1) / x.size).cast("int")), lambda i: F.exists(F.get(lists, i), lambda b: meets(s, b)))
        return let(by_stretch, lambda lists: F.filter(spans, lambda s: ~near(s, lists)))

    return F.when(F.size(base) == 0, spans).otherwise(let(F.struct(stretch.alias("size")), apart))


def candidates(text: Column, base: Column) -> Column:
    """Long tokens (start, end, class, steps) that no base span overlaps; steps null where they can't be secrets."""
    free = let(located(text, TOKEN), lambda spans: F.when(F.size(spans) > 0, overlapping(base, spans, F.length(text))).otherwise(spans))
    return F.transform(free, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), length_class(s.end - s.start).alias("class"), evidence(s.word).alias("steps")))


def thresholds(scanned: DataFrame, level: float) -> dict[int, int]:
    """Least steps that the Benjamini-Hochberg rule accepts, by length class.  The counts that come
    to the driver have at most TOP + 2 rows for each power of two of lengths."""
    found = scanned.select(F.explode_outer("found.tokens").alias("t")).filter("t is not null").groupBy("t.class", "t.steps").count().collect()
    out = {}
    for c in {r["class"] for r in found}:
        own = {r["steps"]: r["count"] for r in found if r["class"] == c}
        total, above = sum(own.values()), 0
        for steps in sorted((s for s in own if s is not None), reverse=True):
            above += own[steps]
            if 10 ** (-steps / STEPS) <= level * above / total:
                out[c] = steps
    return out


def scan(docs: DataFrame, text: str = "text", level: float = 0.01) -> DataFrame:
    """(row, text, base, spans): each row as a struct, its text (null counts as empty) and arrays of (start, end, kind).

    Ends are exclusive, in code points.  Overlapping
    spans of several kinds all stay.  Two passes over the texts: one counts the p-values, one decides.
    Repeated rows are scanned each; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = let(base_spans(F.col("text")), lambda base: F.struct(base.alias("base"), candidates(F.col("text"), base).alias("tokens")))
    scanned = rows.withColumn("found", found)
    least = thresholds(scanned, level)
    accepted = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in least.items()])
    passes = lambda t: F.exists(accepted, lambda x: (t["class"] == x.c) & F.coalesce(t.steps >= x.s, F.lit(False)))
    more = F.transform(F.filter("found.tokens", passes), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), F.lit("random").alias("kind"))) if least else F.array().cast(f"array<{SPAN}>")
    return scanned.select("row", "text", "found.base", in_order(F.concat("found.base", more)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]", level: float = 0.01) -> DataFrame:
    """docs with each secret in ``text`` replaced by a mark and ``length``, if there, put right.  A null text stays null; other columns stay as they are."""
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s.end).alias("at"),
            F.when(s.start >= a["at"], F.concat(a.out, F.substring(F.col("text"), a["at"] + 1, s.start - a["at"]), F.lit(mark))).otherwise(a.out).alias("out"),
        ),
        lambda a: F.concat(a.out, F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    own = lambda c: F.col(f"row.`{c}`")
    found = F.size("spans") > 0
    new = scan(docs, text, level).withColumn("new", F.when(found, pieces).otherwise(own(text)))
    columns = {text: F.col("new")} | ({length: F.when(found, F.length("new").cast(docs.schema[length].dataType)).otherwise(own(length))} if length in docs.columns else {})
    return new.select(*[columns.get(c, own(c)).alias(c) for c in docs.columns])
