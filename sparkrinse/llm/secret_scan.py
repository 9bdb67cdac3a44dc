"""Find secrets in texts: fixed patterns, and long tokens that pass for random.

A token of letters and digits is tested as draws from the alphabet of the encoding it fits: chi-squared
for even use of the characters, runs above and below the middle, and correlation of neighbours. The
three tail probabilities are combined. Over the whole corpus, false-discovery control in strata of
encoding and length decides which tokens are refused as not random; those left are reported.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm.quality_rules import let
from sparkrinse.staging import stage

# Fixed patterns: the whole match and, of an assignment, its value; with the least length of the part that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encoding -> what fits it, its alphabet in order of value, and whether case is folded.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", True),
    "base32": ("^[A-Z2-7]+$", CAPITAL + "234567", False),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + SMALL, True),
    "base62": ("^[0-9A-Za-z]+$", CAPITAL + SMALL + DIGITS, False),
    "base64": ("^[0-9A-Za-z+/]+$", CAPITAL + SMALL + DIGITS + "+/", False),
}
# Share of truly random tokens that may be among those refused.
FALSE_DISCOVERIES = 0.1
# Probabilities are counted in tenths of a power of ten, down to this many.
CELLS = 400

SPAN = "array<struct<start: int, kind: int, end: int>>"


def matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points, end exclusive.

    Text between matches and the matches themselves, laid end to end, give the places. With ``least``,
    group 1 must have that many characters; failing matches still use up their text.
    """

    def spans(pieces: Column, found: Column, values: Column | None) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            if values is not None:
                span = F.when(F.length(F.get(values, i)) >= least, span).otherwise(F.array().cast(SPAN))
            return F.struct(end.alias("at"), F.concat(s["spans"], span).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda s: s["spans"])

    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), group)
    pieces = F.split(text, pattern, -1)
    if least:
        scanned = let(pieces, lambda p: let(all_of(0), lambda f: let(all_of(1), lambda v: spans(p, f, v))))
    else:
        scanned = let(pieces, lambda p: let(all_of(0), lambda f: spans(p, f, None)))
    return F.when(text.rlike(pattern), scanned).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal value above ``z``, to about 1e-7 of a polynomial in 1 / (1 + pz)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Fixed coefficients of the published rational approximation of the error function.
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, tail / 2).otherwise(1 - tail / 2)


def encoding_of(token: Column) -> Column:
    """The first encoding that fits a token with letters and digits; null for words and numbers."""
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    fit = None
    for name, (pattern, _, _) in ENCODINGS.items():
        fit = F.when(plain.rlike(pattern), name) if fit is None else fit.when(plain.rlike(pattern), name)
    return F.when(mixed, fit)


def random_probability(token: Column, encoding: Column) -> Column:
    """Combined tail probability of the three tests, for a token drawn evenly from its alphabet."""
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    alphabet, folded, size = F.lit(""), plain, F.lit(2)
    for name, (_, letters, fold) in ENCODINGS.items():
        alphabet = F.when(encoding == name, letters).otherwise(alphabet)
        size = F.when(encoding == name, len(letters)).otherwise(size)
        folded = F.when(encoding == name, F.lower(plain) if fold else plain).otherwise(folded)

    def tests(word: Column, values: Column) -> Column:
        n = F.size(values).cast("double")
        kinds = size.cast("double")
        total = lambda over, f: F.aggregate(over, F.lit(0.0), lambda s, v: s + f(v))
        squares = total(F.array_distinct(F.split(word, "")), lambda c: F.pow(F.length(word) - F.length(F.replace(word, c, F.lit(""))), F.lit(2.0)))
        chi = squares * kinds / n - n
        free = kinds - 1
        # The cube root of chi-squared over its degrees of freedom is nearly normal.
        z_even = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        high = total(values, lambda v: F.when(v * 2 >= size, 1.0).otherwise(0.0))
        low = n - high
        pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = 1 + total(pairs, lambda p: F.when((p["a"] * 2 >= size) != (p["b"] * 2 >= size), 1.0).otherwise(0.0))
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
        z_runs = F.when((high == 0) | (low == 0), F.sqrt(n)).otherwise((turns - mean) / spread)
        middle = total(values, lambda v: v.cast("double")) / n
        variance = total(values, lambda v: F.pow(v - middle, F.lit(2.0)))
        common = total(pairs, lambda p: (p["a"] - middle) * (p["b"] - middle))
        z_serial = F.when(variance == 0, F.sqrt(n)).otherwise((common / variance + 1 / n) * F.sqrt(n))
        logs = F.lit(0.0)
        for p in (upper_tail(z_even), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))):
            logs = logs - F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-40)))
        # Twice the sum of the logs is chi-squared with six degrees of freedom, whose tail has this closed form.
        return let(logs, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(folded, lambda word: let(
        F.transform(F.split(word, ""), lambda c: F.instr(alphabet, c) - 1), lambda values: tests(word, values)
    ))


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ``base`` (spans of the fixed patterns) and ``tokens`` (start, end, stratum, cell) outside of them."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(matches(text, ASSIGN, 0, LEAST_VALUE), matches(text, ACCESS, 1), matches(text, HEX, 2)))

    def tested(spans: Column) -> Column:
        def token(s: Column) -> Column:
            word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
            return let(word, lambda w: let(encoding_of(w), lambda e: F.when(e.isNotNull(), let(
                random_probability(w, e), lambda p: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"),
                    F.concat(e, F.lit("/"), F.floor(2 * F.log2(F.length(w)))).alias("stratum"),
                    F.least(F.floor(-10 * F.log10(p)), F.lit(CELLS)).cast("int").alias("cell"),
                )))))

        free = F.filter(found_tokens(text), lambda t: ~F.exists(spans, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.array_compact(F.transform(free, token))

    return docs.select(F.col(id_column).alias("doc_id"), let(base, lambda spans: F.struct(spans.alias("base"), tested(spans).alias("tokens"))).alias("s")).select(
        "doc_id", F.col("s.base").alias("base"), F.col("s.tokens").alias("tokens")
    )


def found_tokens(text: Column) -> Column:
    return matches(text, TOKEN, 3)


def refused_from(scanned: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """Per stratum the smallest cell that is refused as not random, by the step-up rule on cell counts.

    Strata are few (five encodings, half powers of two in length) and cells are bounded, so the counts
    that reach the driver are too.
    """
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.cell").agg(F.count("*").alias("n")).collect()
    by: dict[str, dict[int, int]] = {}
    for stratum, cell, n in counts:
        by.setdefault(stratum, {})[cell] = n
    limits = {}
    for stratum, cells in by.items():
        tested, seen = sum(cells.values()), 0
        for cell in sorted(cells, reverse=True):
            seen += cells[cell]
            if 10 ** (-cell / 10) <= rate * seen / tested:
                limits[stratum] = cell
    return limits


def secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind, end; kind numbers as in ``KINDS``).

    ``spans`` has the base spans and those of random tokens, by start, then kind. Places are code points,
    ends exclusive. Null and empty texts have none; repeated rows give a row each.
    """
    scanned = stage(scan(docs, id_column=id_column, text_column=text_column), "secrets")
    limits = refused_from(scanned, rate)
    limit = F.lit(CELLS + 1)
    if limits:
        limit_of = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    def kept(t: Column) -> Column:
        return t["cell"] < (F.coalesce(F.try_element_at(limit_of, t["stratum"]), limit) if limits else limit)
    random = F.transform(F.filter("tokens", kept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_digest(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
