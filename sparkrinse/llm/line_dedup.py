"""Drop lines that repeat an earlier line, exactly or within a few edits.

Equal lines are counted first and stay one row from then on. For the rest, a line is cut into one more
segment than edits are allowed: two lines that close share a segment, at a place that their lengths and
the segment's number bound. Segments by (length, number, content) are the index; a line probes it with
the substrings those bounds leave. Candidates whose character counts at both ends differ too much go within
the join, those that differ too much as a whole once their texts are there; the others are verified with a banded bit-parallel edit distance: one bit vector per character, as wide as
the band, whatever the line's length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm.quality_rules import let
from sparkrinse.llm.words import SPACED_WORD
from sparkrinse.staging import discard, stage

EDITS = 2
# Characters that are counted; any sixteen would do, frequent ones tell more.
COUNTED = tuple("etaoinsrhldcumpg")
# The lower of the two bits of every count.
LOW_BITS = sum(1 << 2 * k for k in range(len(COUNTED)))
# Below the counts.
ROW_BITS = 64 - 2 * len(COUNTED)
# Characters at either end of a line that are counted for its number; shorter lines are counted as a whole.
COUNTED_END = 320
# Numbers of lines that are sent to every task; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _keys(wide: Column, length: Column, edits: int, places: list[tuple[int, int, int]]) -> Column:
    """Keys of segments, read at ``places``: by how much the other line is shorter, the segment, how far it moved.

    The last segments take the remainder, one character each. ``wide`` is the line in UTF-32, where every
    character is four bytes and so found at once. A place outside the line gives a key that finds nothing
    or a candidate that is refused. A lambda over the places: written out, the code would be too long.
    """
    number = edits + 1

    def cut(size: Column) -> Column:
        # Length, length of a short segment, number of short segments.
        return F.struct(size.alias("length"), F.floor(size / number).cast("int").alias("short"), (number - size % number).alias("plain"))

    def key(p: Column, z: Column) -> Column:
        start = p["segment"] * z["short"] + F.greatest(p["segment"] - z["plain"], F.lit(0)) + p["moved"]
        size = z["short"] + F.when(p["segment"] >= z["plain"], 1).otherwise(0)
        return F.xxhash64(z["length"], p["segment"], F.substr(wide, 4 * start + 1, 4 * size))

    each = F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(b).alias("segment"), F.lit(c).alias("moved")) for a, b, c in places])
    sizes = F.transform(F.array(*[F.lit(k) for k in range(edits + 1)]), lambda k: let(length - k, cut))
    return let(sizes, lambda z: F.transform(each, lambda p: let(F.get(z, p["shorter"]), lambda y: key(p, y))))


def index_keys(wide: Column, length: Column, edits: int) -> Column:
    """One key per segment."""
    return _keys(wide, length, edits, [(0, i, 0) for i in range(edits + 1)])


def probe_keys(wide: Column, length: Column, edits: int) -> Column:
    """Keys under which a line not longer, within ``edits``, would be found."""
    places = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            right = edits - i  # segments to the right of this one
            least = max(-i, shorter - right)
            # Lines of equal length probe each other. Up to three edits hold one insertion and one deletion at
            # most, so all segments that moved, moved the same way, and the other way seen from the other line.
            if shorter == 0 and edits <= 3:
                least = 0
            places += [(shorter, i, moved) for moved in range(least, min(i, shorter + right) + 1)]
    return _keys(wide, length, edits, places)


def ends(line: Column) -> Column:
    """Both ends of a long line. An edit inside moves a character out of an end or into it, so that counts
    over the ends, like those over a whole line, change by two at most."""
    size = F.length(line)
    return F.when(size <= 2 * COUNTED_END, line).otherwise(
        F.concat(F.substr(line, F.lit(1), F.lit(COUNTED_END)), F.substr(line, size - (COUNTED_END - 1), F.lit(COUNTED_END)))
    )


def with_counts(number: Column, line: Column) -> Column:
    """``number`` with sixteen character counts modulo 4 in its high bits.

    What was counted is taken out, so that the line gets shorter; the common parts are worked out once.
    """
    for k, character in enumerate(COUNTED):
        rest = F.replace(line, F.lit(character), F.lit(""))
        number = number.bitwiseOR(F.shiftleft(((F.octet_length(line) - F.octet_length(rest)) % 4).cast("bigint"), ROW_BITS + 2 * k))
        line = rest
    return number


def candidate_id(line: Column) -> Column:
    """A number for the line: low bits of its row while it is written, above them the counts of ``line``.

    Rows that follow each other have numbers that compress well. Lines that share a number are told
    apart when their texts are compared.
    """
    return with_counts(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("bigint")), line)


def counts_apart(a: Column, b: Column) -> Column:
    """At most twice the edit distance: an edit takes from one count and adds to another.

    Gray codes of neighbours differ in one bit, so the bits in which they differ are the sum over the
    counts; the code of a difference is the difference of the codes.
    """
    differ = F.shiftrightunsigned(a.bitwiseXOR(b), ROW_BITS)
    return F.bit_count(differ.bitwiseXOR(F.shiftright(differ, 1).bitwiseAND(F.lit(LOW_BITS).cast("bigint"))))


def within_edits(longer: Column, shorter: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``, for lines longer than that whose lengths are as close.

    The band runs along the diagonal, one bit per row of it, and moves down a row with every character
    of the shorter line. ``up`` and ``down`` tell where the distance grows or falls from row to row.
    """
    width = 2 * edits + 2
    full = (1 << width) - 1

    def lit(number: int) -> Column:
        return F.lit(number).cast("bigint")

    def inverse(bits: Column) -> Column:
        return bits.bitwiseXOR(lit(full))

    def distance(long: Column, short: Column) -> Column:
        start = F.struct(
            lit(full ^ ((1 << (width - edits - 1)) - 1)).alias("up"), lit(0).alias("down"), lit(edits).alias("distance")
        )

        def step(s: Column, j: Column) -> Column:
            def matches(character: Column) -> Column:
                bits = lit(0)
                for b in range(width):
                    same = F.get(long, j + (edits + 1 - width + b)) == character
                    bits = bits.bitwiseOR(F.when(same, lit(1 << b)).otherwise(lit(0)))
                return bits

            def diagonal(match: Column) -> Column:
                summed = (match.bitwiseAND(s["up"]) + s["up"]).bitwiseAND(lit(full))
                return summed.bitwiseXOR(s["up"]).bitwiseOR(match).bitwiseOR(s["down"])

            def moved(d: Column) -> Column:
                right_up = s["down"].bitwiseOR(inverse(d.bitwiseOR(s["up"])))
                right_down = d.bitwiseAND(s["up"])
                next_d = F.shiftrightunsigned(d, 1)
                # While the band's last row lies inside the longer line its distance follows the diagonal,
                # afterwards the longer line's last row, one bit further up with each character.
                over = j - (F.size(long) - edits)
                bit = F.get(F.array(*[lit(1 << (width - 2 - k)) for k in range(edits)]), F.greatest(over, F.lit(0)))
                along = F.when(d.bitwiseAND(lit(1 << (width - 1))) == 0, 1).otherwise(0)
                across = F.when(right_up.bitwiseAND(bit) != 0, 1).when(right_down.bitwiseAND(bit) != 0, -1).otherwise(0)
                return F.struct(
                    right_down.bitwiseOR(inverse(next_d.bitwiseOR(right_up))).alias("up"),
                    next_d.bitwiseAND(right_up).alias("down"),
                    (s["distance"] + F.when(over < 0, along).otherwise(across)).alias("distance"),
                )

            return let(let(matches(F.get(short, j)), diagonal), moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(short) - 1), start, step, lambda s: s["distance"])

    if edits == 0:
        return longer == shorter
    return let(F.split(longer, ""), lambda a: let(F.split(shorter, ""), lambda b: distance(a, b))) <= edits


def line_table(docs: DataFrame, id_column: str, text_column: str, least: int | None) -> DataFrame:
    """Every line long enough, without ``least`` every line with a word: ``__id``, ``__row`` (hash of id and text), ``place`` (from 0), ``line``, ``h1``, ``h2``."""
    text = F.col(text_column).cast("string")
    counts = F.col("line").rlike(SPACED_WORD) if least is None else F.length("line") >= least
    return docs.select(
        F.col(id_column).alias("__id"), F.xxhash64(F.col(id_column), text).alias("__row"), F.posexplode(F.split(text, "\n")).alias("place", "line")
    ).filter(counts).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def close_lines(known: DataFrame, edits: int) -> DataFrame:
    """h1, h2 of the distinct lines that have a line within ``edits`` which first stands earlier.

    ``known``: h1, h2, line, ``id`` (``candidate_id``) and ``first`` (what orders lines), one row per line.
    """
    if edits < 1:
        return known.select("h1", "h2").limit(0)
    def keys(of) -> Column:
        # Bound once per line; left to the optimizer, encoding would move into the loop over the places.
        line = F.col("line")
        return let(F.encode(line, "UTF-32"), lambda wide: let(F.length(line), lambda size: of(wide, size, edits)))

    # Outer: an inner one would add a filter that makes all keys another time.
    index = known.select("id", keys(index_keys).alias("keys")).select(F.explode_outer("keys").alias("key"), F.col("id").alias("shorter"))
    probe = known.select("id", keys(probe_keys).alias("keys")).select(F.explode_outer("keys").alias("key"), F.col("id").alias("longer"))
    pairs = stage(
        probe.join(index, "key")
        .filter(counts_apart(F.col("longer"), F.col("shorter")) <= 2 * edits).filter("longer != shorter")
        .select("longer", "shorter").distinct(),
        "line-pairs",
    )
    involved = stage(pairs.select(F.col("longer").alias("id")).unionByName(pairs.select(F.col("shorter").alias("id"))).distinct(), "line-ids")
    # Eight bytes a line: while they are few, the texts of all others need not be shuffled.
    few = involved.count() <= MOST_BROADCAST
    held = stage(
        known.join(F.broadcast(involved) if few else involved, "id", "left_semi").withColumn("counts", with_counts(F.lit(0).cast("bigint"), F.col("line"))),
        "line-texts",
    )

    def side(name: str) -> DataFrame:
        return held.select(F.col("id").alias(name), F.struct("h1", "h2", "line", "first", "counts").alias(name[0]))

    far = F.abs(F.length("l.line") - F.length("s.line")) > edits
    swapped = F.length("l.line") < F.length("s.line")
    alike = ~far & (counts_apart(F.col("l.counts"), F.col("s.counts")) <= 2 * edits) & (F.col("l.line") != F.col("s.line"))
    verified = within_edits(
        F.when(swapped, F.col("s.line")).otherwise(F.col("l.line")), F.when(swapped, F.col("l.line")).otherwise(F.col("s.line")), edits
    )
    # As a case: the optimizer would take the distance first among several conditions.
    close = pairs.join(side("longer"), "longer").join(side("shorter"), "shorter").filter(F.when(alike, verified))
    later = F.when(F.col("l.first") > F.col("s.first"), F.col("l")).when(F.col("l.first") < F.col("s.first"), F.col("s"))
    return close.select(later.alias("x")).filter("x is not null").select("x.h1", "x.h2").distinct()


def duplicate_lines(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS, least: int | None = None
) -> DataFrame:
    """The lines to drop: ``__id``, ``__row``, ``place`` and ``near`` (false: equal to an earlier line).

    Lines are ordered by document id (null first), then place. A line goes if an equal line stands
    earlier, or if a line within ``edits`` (insert, delete or replace a character) first stands earlier,
    whether that one stays or not. Equal lines are found at any length, close ones where both are longer
    than ``edits``; blank lines stay. With ``least`` both begin at that many characters, and shorter lines stay. Rows with the same id and the same line at the same place do not drop each other.
    """
    if least is not None and least <= edits:
        raise ValueError("least must be above edits")
    lines = line_table(docs, id_column, text_column, least)
    known = stage(
        lines.groupBy("h1", "h2").agg(
            F.min(F.struct("__id", "place")).alias("first"), F.count("*").alias("n"), F.any_value("line").alias("line")
        ).withColumn("seen", ends(F.col("line"))).withColumn("id", candidate_id(F.col("seen"))).drop("seen"),
        "lines", "zstd",
    )
    near = close_lines(known.filter(F.length("line") > edits), edits).withColumn("is_near", F.lit(True))
    affected = stage(
        known.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter((F.col("n") > 1) | F.col("is_near")),
        "lines-affected",
    )
    discard(known)
    is_first = F.struct("__id", "place").eqNullSafe(F.col("first"))
    return (
        lines.select("__id", "__row", "place", "h1", "h2").join(affected, ["h1", "h2"])
        .withColumn("near", is_first).filter(F.col("is_near") | ~F.col("near"))
        .select("__id", "__row", "place", "near")
    )


def _dropped(docs: DataFrame, id_column: str, text_column: str, edits: int, least: int | None) -> DataFrame:
    found = duplicate_lines(docs, id_column=id_column, text_column=text_column, edits=edits, least=least)
    return found.groupBy("__id", "__row").agg(
        F.array_sort(F.collect_set("place")).alias("__dropped"), F.array_sort(F.collect_set(F.when(F.col("near"), F.col("place")))).alias("__near")
    ).withColumnsRenamed({"__id": "__d_id", "__row": "__d_row"})


def line_report(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS, least: int | None = None
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact, n_near, dropped (sorted line numbers from 0)."""
    text = F.col(text_column).cast("string")
    counted = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(id_column), text).alias("__row"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    dropped = _dropped(docs, id_column, text_column, edits, least)
    on = F.col("doc_id").eqNullSafe(F.col("__d_id")) & (F.col("__row") == F.col("__d_row"))
    nothing = F.array().cast("array<int>")
    return counted.join(dropped, on, "left").select(
        "doc_id", "n_lines",
        (F.size(F.coalesce("__dropped", nothing)) - F.size(F.coalesce("__near", nothing))).cast("bigint").alias("n_exact"),
        F.size(F.coalesce("__near", nothing)).cast("bigint").alias("n_near"),
        F.coalesce("__dropped", nothing).alias("dropped"),
    )


def drop_duplicate_lines(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS, least: int | None = None
) -> DataFrame:
    """``docs`` without the dropped lines, columns as they were; a document that loses all its words goes."""
    text = F.col(text_column).cast("string")
    dropped = _dropped(docs, id_column, text_column, edits, least)
    on = F.col(f"`{id_column}`").eqNullSafe(F.col("__d_id")) & (F.col("__t_row") == F.col("__d_row"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    rest = F.when(F.col("__dropped").isNull(), text).otherwise(kept)
    joined = docs.withColumn("__t_row", F.xxhash64(F.col(id_column), text)).join(dropped, on, "left").withColumn(text_column, rest)
    lost = F.col("__dropped").isNotNull() & ~F.col(f"`{text_column}`").rlike(SPACED_WORD)
    return joined.filter(~lost).select(*[F.col(f"`{c}`") for c in docs.columns])
