"""Quality rules whose cut-offs follow the corpus: fences from quantile sketches per language and source.

Each figure of a document is compared with a fence of its (language, source). Fences come from KLL
sketches, which merge: within a shuffle, from sources into a language, and from languages into the
whole corpus. A group with few documents borrows the fences of its language, then of the corpus.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm.words import LOWER, UPPER
from sparkrinse.staging import stage

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
# Sketches of up to this many documents are exact; beyond it a rank is off by about a thousandth.
SKETCH_K = 2048
LEAST_DOCUMENTS = 100
REACH = 6.0
# Figure -> (smallest spread a group may show, whether low values fail too).
FIGURES = {
    "word_length": (0.25, True),
    "symbols_per_word": (0.05, False),
    "marks_per_word": (0.05, False),
    "capital_share": (0.03, False),
    "repeated_line_share": (0.08, False),
    "repeated_word_share": (0.04, False),
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the list."""

    def covered(grams: Column) -> Column:
        numbered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(numbered, lambda pairs: let(
            F.array_sort(F.transform(
                F.filter(pairs, lambda p, k: (
                    F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
                    | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))
                )),
                lambda p: p["i"],
            )),
            lambda at: F.aggregate(
                at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
                lambda s, i: F.struct(
                    (s["n"] + i + window - F.greatest(i, s["until"])).alias("n"), (i + window).alias("until")
                ),
                lambda s: s["n"],
            ),
        ))

    grams = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))
    )
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(
        grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))
    ))


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def counted(value: Column) -> Column:
    """The counts of one text, as a struct."""
    words = F.filter(F.split(value, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(value, "\n"), lambda x: without(x, SPACE) > 0)
    size = F.length(value)
    return F.struct(
        without(value, SPACE).cast("bigint").alias("word_chars"),
        (size - without(value, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (size - without(value, "!?")).cast("bigint").alias("n_marks"),
        (size - without(value, UPPER)).cast("bigint").alias("n_capitals"),
        (size - without(value, LOWER)).cast("bigint").alias("n_small"),
        let(words, lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words")
        )).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")
        )).alias("l"),
    )


def measure_of(text_column: str) -> Column:
    """Counts of a text column; a null text has none of anything."""
    return let(F.coalesce(F.col(text_column).cast("string"), F.lit("")), counted)


def measures(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct ``__m`` of counts."""
    return docs.withColumn("__m", measure_of(text_column))


def figures(m: Column) -> dict[str, Column]:
    words = F.greatest(m["w"]["n_words"], F.lit(1))
    return {
        "word_length": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "marks_per_word": m["n_marks"] / words,
        "capital_share": m["n_capitals"] / F.greatest(m["n_capitals"] + m["n_small"], F.lit(1)),
        "repeated_line_share": m["l"]["n_dup_lines"] / F.greatest(m["l"]["n_lines"], F.lit(1)),
        "repeated_word_share": m["w"]["n_repeat_words"] / words,
    }


def base_failed(m: Column) -> Column:
    return (m["w"]["n_words"] < LEAST_WORDS) | (100 * m["w"]["n_repeat_words"] > MOST_REPEATED_PERCENT * m["w"]["n_words"])


def sketches(measured: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """One sketch per figure for each (language, source), of documents that pass the fixed rules.

    Tables of such rows from several runs can be united: ``fences`` merges what has the same keys.
    """
    own = measured.filter(~base_failed(F.col("__m"))).select(
        F.col(keys[0]).cast("string").alias("lang"), F.col(keys[1]).cast("string").alias("source"),
        *[value.cast("double").alias(name) for name, value in figures(F.col("__m")).items()],
    )
    return own.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(name, SKETCH_K).alias(name) for name in FIGURES]
    )


def fences(sketched: DataFrame) -> DataFrame:
    """lang, source and ``fence``: lowest and highest value allowed of every figure."""

    def merged(table: DataFrame, *by: str) -> DataFrame:
        return table.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, SKETCH_K).alias(c) for c in FIGURES])

    def read(table: DataFrame, name: str) -> DataFrame:
        limits = []
        for figure, (least, both) in FIGURES.items():
            low, mid, high = (F.kll_sketch_get_quantile_double(figure, F.lit(q)) for q in (0.25, 0.5, 0.75))
            top = mid + REACH * F.greatest(high - mid, F.lit(least))
            bottom = mid - REACH * F.greatest(mid - low, F.lit(least)) if both else F.lit(float("-inf"))
            limits.append(F.struct(bottom.alias("low"), top.alias("high")).alias(figure))
        names = [c for c in ("lang", "source") if c in table.columns]
        return table.select(*names, F.when(F.col("n") >= LEAST_DOCUMENTS, F.struct(*limits)).alias(name))

    groups = stage(merged(sketched, "lang", "source"), "sketches")
    languages = stage(merged(groups, "lang"), "sketches")
    whole = merged(languages.withColumn("all", F.lit(1)), "all").withColumn("n", F.lit(LEAST_DOCUMENTS))
    corpus = read(whole, "corpus").withColumn("all", F.lit(1))
    of_language = read(languages, "language").withColumn("all", F.lit(1)).join(F.broadcast(corpus), "all").withColumnRenamed("lang", "__lang")
    own = read(groups, "own")
    joined = own.join(of_language, F.col("lang").eqNullSafe(F.col("__lang")))
    return joined.select("lang", "source", F.coalesce("own", "language", "corpus").alias("fence"))


def failed_figures(m: Column, fence: Column) -> Column:
    """Names of the figures beyond a fence."""
    return F.array_compact(F.array(*[
        F.when(~value.between(fence[name]["low"], fence[name]["high"]), F.lit(name)) for name, value in figures(m).items()
    ]))


def fenced(docs: DataFrame, limits: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """``docs`` with the ``__fence`` of their language and source."""
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("fence").alias("__fence"))
    on = F.col(keys[0]).cast("string").eqNullSafe(F.col("__lang")) & F.col(keys[1]).cast("string").eqNullSafe(F.col("__source"))
    return docs.join(limits, on, "left").drop("__lang", "__source")


def assess(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and ``failed`` (array of figure names).

    Null and empty texts have no words and fail. Null languages and sources are groups like any other.
    Repeated rows are judged alike; columns other than the four named are not read.
    """
    chosen = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source")
    )
    measured = stage(measures(chosen).drop("text"), "measures")
    m = F.col("__m")
    judged = fenced(measured, fences(sketches(measured, ("lang", "source"))), ("lang", "source"))
    failed = failed_figures(m, F.col("__fence"))
    return judged.select(
        "doc_id", m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"), (~base_failed(m) & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"),
    )


def keep_good(docs: DataFrame, *, text_column: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are measured twice instead of being shuffled."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    measured = stage(docs.select(F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source"), measure_of(text_column).alias("__m")), "measures")
    limits = stage(fences(sketches(measured, ("lang", "source"))), "fences")
    # One expression that names the counts once: as columns, a pushed filter would work them out again for each use.
    passes = let(measure_of(text_column), lambda m: ~base_failed(m) & (F.size(failed_figures(m, F.col("__fence"))) == 0))
    return fenced(docs, limits, keys).filter(passes).select(*names)
