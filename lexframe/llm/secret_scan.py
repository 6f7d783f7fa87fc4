"""Secret scans: fixed patterns, and a battery of randomness tests on all other long tokens.

A candidate is a run of at least `MIN_TOKEN` characters of an encoding's alphabet. The encoding
is inferred as the smallest alphabet that holds all its characters (letters of one case, hex, base32,
letters and digits, base64 and its URL form); digits alone are a number and no candidate. The battery has
three tests of the sequence of its characters, each as a normal score under random draws: chi-squared of the
counts against the uniform alphabet, the number of runs of the encoding's own two kinds (vowels and others,
letters and digits, small letters and others), and the serial correlation of neighbours.

* A token that any of the tests rejects at `REJECT` as random draws is no secret.
* For each encoding and length class a model of writing (words, names and numbers) gives the mean and
  spread of the three scores. They are combined, each weighted by how far writing lies from random
  draws, and the p-value is the chance that writing looks as random as the token.

The p-values of all candidates of the corpus, also those that the battery rejects, go through
Benjamini-Hochberg at `FALSE_SHARE`, for each length class on its own, so that the many short tokens don't set
the bar for the long ones. They are counted in fixed steps, a table of bounded size; each class's bar is
found from it.

Defined cases: a null text is empty and has no spans; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table

#: The kinds in order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

MIN_TOKEN, REJECT, FALSE_SHARE = 20, 1e-4, 0.005
#: Steps of -log10 p that are told apart, characters to a length class, and classes at most (the last holds all longer
#: tokens, whose p-values are then too large, never too small).
STEPS, STEP, CLASS, CLASSES = 400, 0.1, 8, 64
#: Draws from the model of writing for each encoding and class.
DRAWS = 300

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Encodings, the smaller ones first: alphabet, characters of its first kind.
ENCODINGS = (
    (_HEX, "0123456789"),
    (_HEX.upper(), "0123456789"),
    (_LOWER, "aeiou"),
    (_LOWER.upper(), "AEIOU"),
    (_B32, "234567"),
    (_LOWER + "0123456789", "0123456789"),
    (_LOWER.upper() + "0123456789", "0123456789"),
    (_ALNUM, _LOWER),
    (_ALNUM + "+/", _LOWER),
    (_ALNUM + "-_", _LOWER),
)
#: Letters of English writing by how often they occur in a thousand, and how often a vowel or another letter
#: is followed by the other kind, in hundredths.
FREQUENT = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
AFTER_VOWEL, AFTER_OTHER = 85, 62


@lru_cache(maxsize=None)
def _places(encoding: int) -> tuple[dict[str, int], frozenset[str]]:
    alphabet, first = ENCODINGS[encoding]
    return {c: i for i, c in enumerate(alphabet)}, frozenset(first)


def infer(token: str) -> int | None:
    """The number of the smallest encoding with all characters of the token; None for numbers and other tokens."""
    found = set(token)
    if found <= set("0123456789"):
        return None
    return next((e for e in range(len(ENCODINGS)) if found <= _places(e)[0].keys()), None)


def uniformity(places: list[int], size: int) -> float:
    """Normal score of the counts' chi-squared under uniform draws (Wilson and Hilferty's cube root)."""
    n, counts = len(places), [0] * size
    for p in places:
        counts[p] += 1
    chi = max(0.0, sum(c * c for c in counts) * size / n - n)
    free = size - 1
    return ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))


def runs(first: list[bool], share: float) -> float:
    """Normal score of the number of runs of two kinds, where draws are of the first kind with chance `share`."""
    n = len(first)
    both = share * (1 - share)
    mean = 1 + 2 * (n - 1) * both
    var = 2 * (n - 1) * both * (1 - 2 * both) + 2 * (n - 2) * both * (1 - 4 * both)
    return (1 + sum(a != b for a, b in zip(first, first[1:])) - mean) / math.sqrt(max(var, 1e-9))


def serial(places: list[int]) -> float:
    """Normal score of the correlation of neighbours."""
    n, mean = len(places), sum(places) / len(places)
    off = [p - mean for p in places]
    var = sum(x * x for x in off)
    return (sum(a * b for a, b in zip(off, off[1:])) / var + 1 / n) * math.sqrt(n) if var else math.sqrt(n)


def scores(token: str, encoding: int) -> tuple[float, float, float]:
    at, first = _places(encoding)
    places = [at[c] for c in token]
    return uniformity(places, len(at)), runs([c in first for c in token], len(first) / len(at)), serial(places)


def writing(draw: random.Random, encoding: int, length: int) -> str:
    """A token of words, names and numbers as they are written in an encoding's alphabet."""
    alphabet = _places(encoding)[0]
    known = [c for c in _LOWER if c in alphabet or c.upper() in alphabet]
    vowels, others = ([c for c in known if (c in "aeiou") == v] for v in (True, False))
    digits = [c for c in "0123456789" if c in alphabet]
    both_cases = "a" in alphabet and "A" in alphabet
    joints = [c for c in "-_+/" if c in alphabet]
    out = ""
    while len(out) < length:
        if digits and draw.random() < 0.25:
            out += "".join(draw.choices(digits, k=draw.choice((1, 2, 2, 3, 4, 4, 6))))
            continue
        word, vowel = "", draw.random() < 0.35
        for _ in range(draw.choice((2, 3, 4, 4, 5, 6, 7, 8, 10))):
            pool = vowels if vowel else others
            word += draw.choices(pool, [FREQUENT[c] for c in pool])[0]
            vowel = draw.randrange(100) < AFTER_OTHER if not vowel else draw.randrange(100) >= AFTER_VOWEL
        if both_cases:
            kind = draw.random()
            word = word.capitalize() if kind < 0.6 else word.upper() if kind < 0.7 else word
        elif "a" not in alphabet:
            word = word.upper()
        out += word + (draw.choice(joints) if joints and draw.random() < 0.3 else "")
    return out[:length]


@lru_cache(maxsize=None)
def written(encoding: int, length_class: int) -> tuple[tuple[float, ...], float, float]:
    """Weights of the three scores, and the mean and spread that writing has of their weighted sum."""
    draw = random.Random(1_009 * encoding + length_class)
    rows = [scores(writing(draw, encoding, CLASS * length_class + CLASS // 2), encoding) for _ in range(DRAWS)]
    means = [sum(column) / DRAWS for column in zip(*rows)]
    spreads = [sum((x - m) ** 2 for x in column) / DRAWS for column, m in zip(zip(*rows), means)]
    weights = tuple(m / (v + 1) for m, v in zip(means, spreads))
    sums = [sum(w * x for w, x in zip(weights, row)) for row in rows]
    mean = sum(sums) / DRAWS
    return weights, mean, math.sqrt(sum((x - mean) ** 2 for x in sums) / DRAWS)


def length_class(token: str) -> int:
    return min(CLASSES, len(token) // CLASS)


def battery(token: str) -> float:
    """-log10 of the chance that writing looks as random; 0 for a token that isn't like random draws."""
    body = token.rstrip("=")
    encoding = infer(body)
    if encoding is None:
        return 0.0
    found = scores(body, encoding)
    high, (both, turn) = found[0], found[1:]
    if min(math.erfc(high / math.sqrt(2)) / 2, math.erfc(abs(both) / math.sqrt(2)), math.erfc(abs(turn) / math.sqrt(2))) < REJECT:
        return 0.0
    weights, mean, spread = written(encoding, length_class(body))
    z = (mean - sum(w * x for w, x in zip(weights, found))) / max(spread, 1e-9)
    # The tail of the normal distribution, by its expansion where it is too small for erfc.
    if z > 30:
        return (z * z / 2 + math.log(z) + 0.92) / math.log(10)
    return max(0.0, -math.log10(math.erfc(z / math.sqrt(2)) / 2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, step) of the tokens that don't overlap a fixed pattern. `taken` is sorted."""
    out, at, upto = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # `upto` is the end of the patterns that start before the token ends.
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][2])
            at += 1
        if upto > m.start() or infer(m[0].rstrip("=")) is None:
            continue
        out.append((m.start(), m.end(), length_class(m[0].rstrip("=")), min(STEPS, int(battery(m[0]) / STEP))))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_TOKEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("step", pa.int32())]))
_FOUND = "doc_id long, base array<struct<start:long,kind:int,end:long>>, tokens array<struct<start:long,end:long,length:int,step:int>>"


def _scan(batches):
    for batch in batches:
        base, tokens = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            spans = sorted(base_spans(text))
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            tokens.append([{"start": s, "end": e, "length": c, "step": p} for s, e, c, p in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(base, _SPAN), pa.array(tokens, _TOKEN)], ["doc_id", "base", "tokens"])


def bars(found: DataFrame) -> dict[int, int]:
    """For each length class, the lowest step that is a discovery (Benjamini-Hochberg)."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.step").count().collect()
    out, classes = {}, {}
    for r in counts:
        classes.setdefault(r["length"], {})[r["step"]] = r["count"]
    for length, steps in classes.items():
        total, above = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if step and 10 ** (-step * STEP) <= FALSE_SHARE * above / total:
                out[length] = step
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans of every document, as arrays of (start, kind, end)."""
    found = cut_lineage(docs.select("doc_id", "text").mapInArrow(_scan, _FOUND), "secrets")
    # A token past the longest class's bar is rare; one longer than any class has a class of its own.
    limits = bars(found)
    passed = " OR ".join(f"(t.length = {c} AND t.step >= {s})" for c, s in sorted(limits.items())) or "false"
    drawn = F.expr(f"transform(filter(tokens, t -> {passed}), t -> struct(t.start AS start, 3 AS kind, t.end AS end))")
    return found.select("doc_id", "base", F.array_sort(F.concat("base", drawn)).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with their spans replaced. `spans` is a row of `scan` for each doc_id."""
    once = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.max("spans").alias("__spans"))
    rows = docs.join(once, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    merged = F.expr(
        "aggregate(coalesce(__spans, array()), struct(cast('' AS string) AS out, 0L AS upto), (a, x) -> struct("
        f"CASE WHEN x.start >= a.upto THEN concat(a.out, substring(text, cast(a.upto + 1 AS int), cast(x.start - a.upto AS int)), '{mark}') ELSE a.out END AS out,"
        " greatest(a.upto, x.end) AS upto), a -> concat(a.out, substring(text, cast(a.upto + 1 AS int))))"
    )
    return rows.withColumn("text", merged).select(*docs.columns)


def _listed(spans: str):
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.kind], x.start, x.end)), ',')")


def _count(kind: int):
    return F.expr(f"cast(size(filter(base, x -> x.kind = {kind})) AS bigint)")


@register("op4_secret_scans")
def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every document with its secrets."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", _count(0).alias("n_assign"), _count(1).alias("n_access"), _count(2).alias("n_hex"),
        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )
