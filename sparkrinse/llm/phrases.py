"""Phrases whose words stand together more often than apart, mined from a sample and closed on all texts.

A sample of the documents proposes the phrases that are frequent in it. One pass over all documents
counts those and their border, the phrases whose parts are all proposed but which are not themselves.
A frequent phrase of the border is a failure: it opens phrases that were not counted yet, which the next
pass counts, until a pass opens none. A last pass spells out what is frequent and counts it exactly.

Passes before the last count 64-bit numbers of phrases. Two phrases of the same number can only make a
count too high, so none is lost, and the last pass counts words as they are. What is proposed travels
as a bitmap of fixed size: phrases that share a bit with a proposed one are counted as well, which
costs time but changes nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse.llm.words import portions
from sparkrinse.staging import stage

# One document in so many is in the sample; a phrase is proposed if it has this share of what it needs there.
SAMPLE, LOWERED = 4, 0.8
# Bits of a set of proposed phrases: 8 MB whatever the corpus.
BITS = 26
PORTION_BYTES = 1 << 20
# Distinct phrases that a task gathers before it hands them on, and that one task adds up.
GATHERED, ADDED = 1_000_000, 2_000_000
SPELLED_ROWS = 400_000
# Bytes of text for one word, to choose how many tasks add up counts.
WORD_BYTES = 6
# Bytes that end a piece, and that part words.
ENDS, GAPS = frozenset(b".,;:!?\n\x0b\x0c\r"), frozenset(b" \t")
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

COUNTED = "part int, size int, numbers binary, counts binary"
SPELLED = "lang string, size int, phrase string, n bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def byte_classes() -> bytes:
    """A-Z lowered, gaps as blanks, ends of pieces as line breaks."""
    return bytes(10 if b in ENDS else 32 if b in GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each word data[start:end], from a polynomial over its bytes."""
    powers = np.full(len(data) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    back = np.full(len(data) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def lang_number(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of some texts: where they are, in which piece and text, and their numbers."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        own = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
        self.data = np.frombuffer(own.translate(byte_classes()), np.uint8)
        inside = (self.data != 10) & (self.data != 32)
        first = np.zeros(len(self.data) + 1, bool)
        first[at - at[0]] = True
        before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~first[1:]
        self.starts, self.ends = np.flatnonzero(inside & ~before[:len(inside)]), np.flatnonzero(inside & ~after[:len(inside)]) + 1
        piece = np.cumsum((self.data == 10) | first[:-1])
        self.piece = piece[self.starts]
        self.text = np.searchsorted(at - at[0], self.starts, "right") - 1

    def array(self) -> pa.Array:
        """The words themselves."""
        inside = (self.data != 10) & (self.data != 32)
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[inside].tobytes()))


class Filter:
    """A set of phrase numbers as bits; other numbers may share a bit with one of the set."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.shift = np.uint64(65 - (8 * len(bits)).bit_length())

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def union(self, other: Filter) -> Filter:
        return Filter(self.bits | other.bits)

    def within(self, other: Filter) -> bool:
        return not (self.bits & ~other.bits).any()


def phrase_numbers(words: Words, langs: list[str]) -> np.ndarray:
    of = np.array([lang_number(x) for x in langs], np.uint64)
    return _mixed(word_numbers(words.data, words.starts, words.ends) ^ of[words.text]) if len(words.starts) else np.zeros(0, np.uint64)


def longer(numbers: np.ndarray, singles: np.ndarray, size: int) -> np.ndarray:
    """Numbers of phrases of ``size`` words from those one word shorter."""
    return _mixed(numbers[:-1] * BASE + singles[size - 1:])


class Round:
    """What one pass counts: phrases whose parts are open now, and were not all open in one pass before."""

    def __init__(self, now: list[Filter], before: list[list[Filter]], longest: int) -> None:
        # The filter at k - 1 holds phrases of k words that are open: parts of phrases to be counted.
        self.now, self.before, self.longest = now, before, longest

    def counted(self, words: Words, langs: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """size, places and numbers of the phrases to be counted."""
        singles = phrase_numbers(words, langs)
        n = len(singles)
        if 1 in sizes:
            yield 1, np.arange(n), singles
        numbers = singles
        for size in range(2, self.longest + 1):
            if n < size or size - 2 >= len(self.now):
                return
            open_now = self.now[size - 2].holds(numbers)
            fits = open_now[:-1] & open_now[1:] & (words.piece[:n - size + 1] == words.piece[size - 1:])
            for opened in self.before:
                known = opened[size - 2].holds(numbers)
                fits &= ~(known[:-1] & known[1:])
            numbers = longer(numbers, singles, size)
            if size in sizes:
                at = np.flatnonzero(fits)
                yield size, at, numbers[at]


def cut(texts: pa.Array, langs: list[str]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Texts in portions of bounded size; a longer text is cut where a piece ends."""
    for lo, hi in portions(texts, PORTION_BYTES):
        if hi - lo > 1 or not texts[lo].is_valid or len(raw := texts[lo].as_buffer().to_pybytes()) <= 2 * PORTION_BYTES:
            yield texts.slice(lo, hi - lo), langs[lo:hi]
            continue
        ends = np.flatnonzero(np.frombuffer(raw.translate(byte_classes()), np.uint8) == 10) + 1
        start = 0
        while start < len(raw):
            later = ends[np.searchsorted(ends, start + PORTION_BYTES):]
            end = int(later[0]) if len(later) else len(raw)
            yield pa.array([raw[start:end].decode("utf-8", "surrogatepass")], pa.string()), langs[lo:hi]
            start = end


def _summed(numbers: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each, total = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
    order = np.argsort(each)
    each, total = each[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.zeros(0, np.int64)
    return each[first], np.add.reduceat(total, first) if len(first) else total


def _count(shared, sizes: list[int], doublings: int):
    """Counts of the phrases of a round, as packed numbers dealt by their leading bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, longest = shared.value
        asked = Round([Filter(b) for b in now], [[Filter(b) for b in opened] for opened in before], longest)
        held: dict[int, tuple[list, list]] = {s: ([], []) for s in sizes}
        firsts = [p << 64 - doublings for p in range(2**doublings)] if doublings else [0]

        def handed_on(size: int) -> pa.RecordBatch:
            numbers, counts = _summed(*held[size])
            held[size] = ([], [])
            bounds = [*np.searchsorted(numbers, np.array(firsts, np.uint64)).tolist(), len(numbers)]
            used = [(p, lo, hi) for p, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
            return pa.RecordBatch.from_arrays([
                pa.array([p for p, _, _ in used], pa.int32()), pa.array([size] * len(used), pa.int32()),
                pa.array([numbers[lo:hi].tobytes() for _, lo, hi in used], pa.binary()),
                pa.array([counts[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in used], pa.binary()),
            ], ["part", "size", "numbers", "counts"])

        for batch in batches:
            for texts, langs in cut(batch.column(0), batch.column(1).to_pylist()):
                for size, _, numbers in asked.counted(Words(texts), langs, sizes):
                    found, n = np.unique(numbers, return_counts=True)
                    held[size][0].append(found)
                    held[size][1].append(n.astype(np.uint32))
                    if sum(map(len, held[size][0])) > GATHERED:
                        yield handed_on(size)
        for size in sizes:
            if held[size][0]:
                yield handed_on(size)

    return count


def _add(least: int, doublings: int, bits: int):
    def add(group: pa.Table) -> pa.Table:
        numbers, counts = _summed(
            [np.frombuffer(x, np.uint64) for x in group.column("numbers").to_pylist()],
            [np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()],
        )
        marked = np.zeros(2 ** (bits - doublings), bool)
        marked[(numbers[counts >= least] >> np.uint64(64 - bits)) & np.uint64(len(marked) - 1)] = True
        return pa.table({
            "part": group.column("part")[:1], "size": group.column("size")[:1],
            "bits": pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary()),
        })

    return add


def frequent(docs: DataFrame, asked: Round, sizes: list[int], least: int, doublings: int) -> dict[int, Filter]:
    """For each size the phrases that a round counts at least ``least`` times, 2**BITS bits each whatever their count.

    A task adds up the numbers with the same ``doublings`` leading bits, which are one slice of the bitmap.
    """
    doublings = min(doublings, BITS - 3)
    before = [[f.bits for f in opened] for opened in asked.before]
    shared = docs.sparkSession.sparkContext.broadcast(([f.bits for f in asked.now], before, asked.longest))
    counts = docs.mapInArrow(_count(shared, sizes, doublings), COUNTED)
    slices = counts.groupBy("part", "size").applyInArrow(_add(least, doublings, BITS), "part int, size int, bits binary").toArrow()
    found = {size: np.zeros((2**doublings, 2 ** (BITS - doublings - 3)), np.uint8) for size in sizes}
    for part, size, bits in zip(*[column.to_pylist() for column in slices.columns]):
        found[size][part] = np.frombuffer(bits, np.uint8)
    return {size: Filter(bits.ravel()) for size, bits in found.items()}


def _spell(shared, doublings: int):
    """How often each frequent phrase and word occurs, words compared as they are, packed by leading bits of its number."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(bits) for bits in shared.value]
        held: list[pa.Table] = []

        def handed_on() -> pa.RecordBatch:
            total = pa.concat_tables(held).group_by(["part", "lang", "size", "phrase"]).aggregate([("n", "sum")]).sort_by("part")
            held.clear()
            part = total.column("part").to_numpy()
            bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            rows = total.select(["lang", "size", "phrase", "n_sum"]).combine_chunks()
            blobs = [_stream(rows.slice(lo, hi - lo)) for lo, hi in zip(bounds, bounds[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "rows"])

        for batch in batches:
            for texts, langs in cut(batch.column(0), batch.column(1).to_pylist()):
                for lang in dict.fromkeys(langs):
                    own = texts.filter(pa.array([x == lang for x in langs]))
                    for size, numbers, phrases, counts in spelled(Words(own), [lang] * len(own), filters):
                        n = len(phrases)
                        part = (numbers >> np.uint64(64 - doublings)).astype(np.int32) if doublings else np.zeros(n, np.int32)
                        held.append(pa.table({
                            "part": pa.array(part), "lang": pa.repeat(pa.scalar(lang, pa.string()), n), "size": pa.repeat(pa.scalar(size, pa.int32()), n),
                            "phrase": phrases.cast(pa.string()), "n": pa.array(counts, pa.int64()),
                        }))
                if sum(t.num_rows for t in held) > SPELLED_ROWS:
                    yield handed_on()
        if held:
            yield handed_on()

    return spell


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _add_spelled(support: int):
    def add(group: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in group.column("rows").to_pylist()])
        total = rows.group_by(["lang", "size", "phrase"]).aggregate([("n_sum", "sum")]).rename_columns(["lang", "size", "phrase", "n"])
        return total.filter(pc.or_(pc.greater_equal(total.column("n"), support), pc.equal(total.column("size"), 0)))

    return add


def spelled(words: Words, langs: list[str], filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """size, numbers, phrases and counts in texts of one language, for phrases that the filters hold; size 0 counts all words."""
    n = len(words.starts)
    yield 0, np.zeros(1, np.uint64), pa.array([""]), np.array([n])
    if not n:
        return
    coded = words.array().dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    singles = phrase_numbers(words, langs)
    numbers, keys = singles, ids
    for size, held in enumerate(filters, 1):
        if n < size:
            return
        if size > 1:
            numbers = longer(numbers, singles, size)
            # Numbers of the shorter phrases as they are spelled, then the last word.
            _, short = np.unique(keys, return_inverse=True)
            keys = short[:-1].astype(np.int64) * len(known) + ids[size - 1:]
        at = np.flatnonzero(held.holds(numbers) & (words.piece[:n - size + 1] == words.piece[size - 1:]))
        _, first, counts = np.unique(keys[at], return_index=True, return_counts=True)
        place = at[first]
        parts = [known.take(pa.array(ids[place + i])) for i in range(size)]
        yield size, numbers[place], pc.binary_join_element_wise(*parts, pa.scalar(" ", known.type)) if size > 1 else parts[0], counts


def phrase_counts(docs: DataFrame, longest: int, support: int) -> DataFrame:
    """lang, size, phrase, n: phrases of 1 to ``longest`` words that occur ``support`` times in their language.

    ``docs`` has the columns text and lang without nulls. Size 0 has all words of the language.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    doublings = (size // (WORD_BYTES * ADDED)).bit_length()
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    lowered = max(1, int(LOWERED * support / SAMPLE))
    counted: list[Filter] = []
    for k in range(1, longest):
        counted.append(frequent(sample, Round(counted, [], longest), [k], lowered, doublings)[k])
    sizes = list(range(1, longest + 1))
    sure = list(frequent(docs, Round(counted, [], longest), sizes, support, doublings).values())
    # What passes had open. A phrase was counted if one pass had all its parts open: parts that share bits
    # with proposed phrases may be open in one pass and the rest in another, so passes are not united.
    passes = [counted]
    while not any(all(a.within(b) for a, b in zip(sure, opened)) for opened in passes):
        # Failures of the border: phrases with a part that was not open when phrases were counted.
        more = frequent(docs, Round(sure[:-1], passes, longest), sizes[1:], support, doublings)
        # What is sure only grows, so the last pass holds those between.
        passes = [counted, sure[:-1]]
        sure = [sure[0], *[sure[k - 1].union(more[k]) for k in sizes[1:]]]
    shared = docs.sparkSession.sparkContext.broadcast([f.bits for f in sure])
    packed = docs.mapInArrow(_spell(shared, doublings), "part int, rows binary")
    return stage(packed.groupBy("part").applyInArrow(_add_spelled(support), SPELLED), "phrase-counts")


def collocations(
    docs: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    shortest: int = 2,
    longest: int = 3,
    support: int = 10,
    covered: int = 50,
    top: int = 2_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, numbers as BIGINT.

    A phrase has ``shortest`` to ``longest`` words of one piece and occurs ``a >= support`` times; ``n`` is
    the number of words of its language. Of its cuts into a first part (``l`` times) and a rest (``r``
    times) the one with the lowest floor(10^6 a^2 / (l r)) counts, the earliest of equals. A phrase goes if
    a longer one that contains it occurs in ``covered`` percent of its places or more. Ranks go by score,
    then ``a``, both descending, then the phrase in byte order. A null text is empty, a null language is
    ``und``; repeated rows count again. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    whole = docs.select(text.alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    counts = phrase_counts(whole, longest, support)
    phrases = counts.where(F.col("size") >= shortest).select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(shortest), F.col("size") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")),
    )))
    within = phrases.where(F.col("size") > shortest).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = phrases.join(within, ["lang", "phrase"], "left").where("longer is null or 100 * longer < %d * a" % covered)

    cuts = free.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("rest"),
    )
    part = counts.where("size > 0")
    scored = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]
    )
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    # A phrase occurs no more often than its parts, so a score is at most a million.
    exact = scored.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * a * a).withColumn("below", l * r).withColumn("score", F.expr("above div below"))
    lowest = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("of")).select("lang", "phrase", "a", "of.*")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = lowest.withColumn("rank", order).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select(F.col("lang"), F.col("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
