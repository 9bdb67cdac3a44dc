"""Pack tokenised documents into sequences of a fixed capacity, large items first.

Items above a third of the capacity go at most two into a bin: the largest one left takes the largest
partner that still fits beside it. All smaller items then go, longest first, into the bin with the
tightest gap that holds them.

Only the number of items per length matters for that, so the plan is made on a histogram of at most
``capacity`` entries and is a list of runs ("these n items of this length go into those n bins"). The
items themselves stay distributed: each gets its rank among the items of its length and finds its run.
"""
from __future__ import annotations

import bisect
import hashlib
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrinse.llm.words import portions, spaced_table, split_words
from sparkrinse.staging import stage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
RUNS = "__len bigint, __first bigint, __last bigint, __per_bin bigint, __bin bigint, __at bigint"
CACHED_WORDS = 1_000_000
# Parts in which the items of one length are ranked.
RANK_PARTS = 64
PORTION_BYTES = 4 << 20
# Marks that end a run of letters and, alone, are a word of their own.
MARKS = ".,;:!?"
# Letters up to U+024F: composed already, one lower-case letter each.
PLAIN_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
# Byte-level vocabularies write a byte as a printable character: itself, or the next free one from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, which runs many tasks."""
    held = sys.modules.setdefault("sparkrinse_worker_memory", types.ModuleType("sparkrinse_worker_memory"))
    return vars(held).setdefault(name, {})


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def token_pieces(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """Token ids of every whole text, ended by ``end_id`` and cut into pieces of ``capacity`` tokens.

    ``tokenizer_json`` is the content of a tokenizer file that drops white space and whose words never
    cross it, so each stretch between ASCII white space is encoded once and remembered. ``ids`` holds
    little-endian unsigned 32-bit numbers (null without ``with_ids``). A null or empty text is the end
    token alone. Rows that repeat are separate documents; other columns are ignored.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        memory = worker_memory(hashlib.sha256(tokenizer_json.encode()).hexdigest())
        if "tokenizer" not in memory:
            memory.update(tokenizer=Tokenizer.from_str(tokenizer_json), known={})
        tokenizer, known = memory["tokenizer"], memory["known"]
        model = tokenizer.model
        end = np.uint32(end_id)

        def letters(core: str) -> bytes:
            # The pre-tokeniser would hand the model just this: one run of letters, its bytes as characters.
            if core not in known:
                characters = core.encode().decode("latin-1").translate(BYTE_CHARACTERS)
                known[core] = packed([t.id for t in model.tokenize(characters)])
            return known[core]

        def learn(words: list[str]) -> None:
            odd = []
            for word in words:
                core = word.rstrip(MARKS)
                if PLAIN_WORD.fullmatch(core) is None or (marks := known.get(word[len(core):])) is None:
                    odd.append(word)
                else:
                    known[word] = letters(core.lower()) + marks
            for lo in range(0, len(odd), 10_000):
                part = odd[lo:lo + 10_000]
                found = tokenizer.encode_batch(part, add_special_tokens=False)
                known.update((word, packed(encoding.ids)) for word, encoding in zip(part, found))

        def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Ids of all texts one after the other, and where each text ends."""
            # The vocabulary is lower case; only its special tokens, which start with "<|", tell cases apart.
            special = pc.any(pc.match_substring(texts, "<|")).as_py()
            found, bounds = split_words(texts, spaced_table(lower=not special))
            coded = found.dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(known) > CACHED_WORDS:
                known.clear()
                known.update(alone)
            learn([w for w in words if w not in known])
            each = [known[w] for w in words]
            sizes = np.fromiter(map(len, each), np.int32, len(each)) // 4
            flat = np.frombuffer(b"".join(each), np.uint32)
            index = coded.indices.to_numpy(zero_copy_only=False)
            length = sizes[index]
            until = np.concatenate([[0], np.cumsum(length, dtype=np.int32)])
            first = (np.cumsum(sizes, dtype=np.int32) - sizes)[index] - until[:-1]
            ids = flat[np.repeat(first, length) + np.arange(until[-1], dtype=np.int32)]
            return ids, until[bounds[1:]]

        alone = {mark: packed(tokenizer.encode(mark, add_special_tokens=False).ids) for mark in ["", *MARKS]}
        known.update(alone)
        for batch in batches:
            for lo, hi in portions(batch.column(1), PORTION_BYTES):
                texts = batch.column(1).slice(lo, hi - lo).fill_null("")
                ids, ends = encoded(texts)
                out: list[list] = [[] for _ in range(6)]
                at = 0
                for doc, until in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), ends.tolist()):
                    own = np.append(ids[at:until], end).astype("<u4")
                    at = until
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity].tobytes()
                        row = (doc, piece, start, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    chosen = docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string"))
    return chosen.mapInArrow(pieces, PIECES)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, items per bin, first bin, offset) for a length histogram.

    Item of rank r in a run goes to bin ``first bin + (r - first) // per_bin`` at
    ``offset + (r - first) % per_bin * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: list[int] = []  # sorted, without repeats
    open_bins: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, number)

    def place(length: int, number: int, per_bin: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + number - 1, per_bin, first_bin, offset))
        used[length] += number
        left[length] -= number

    def leave(gap: int, first_bin: int, number: int) -> None:
        if gap > 0 and number > 0:
            if gap not in open_bins:
                bisect.insort(gaps, gap)
                open_bins[gap] = []
            open_bins[gap].append((first_bin, number))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
            partner = large[at] if at >= 0 else None
            pairs = 0
            if partner is not None:
                pairs = left[length] // 2 if partner == length else min(left[length], left[partner])
            if partner == length and not pairs:  # one left: try the next smaller
                smaller = [n for n in large[:at] if left[n]]
                partner = smaller[-1] if smaller else None
                pairs = 1 if smaller else 0
            if not pairs:
                number = left[length]
                place(length, number, 1, bins, 0)
                leave(capacity - length, bins, number)
                bins += number
            else:
                if partner == length:
                    place(length, 2 * pairs, 2, bins, 0)
                else:
                    place(length, pairs, 1, bins, 0)
                    place(partner, pairs, 1, bins, length)
                leave(capacity - length - partner, bins, pairs)
                bins += pairs
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                number = -(-left[length] // (capacity // length))
                leave(capacity, bins, number)
                bins += number
                continue
            gap = gaps[at]
            first_bin, number = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            per_bin = gap // length
            full = min(number, left[length] // per_bin)
            if full:
                place(length, full * per_bin, per_bin, first_bin, capacity - gap)
                leave(gap - per_bin * length, first_bin, full)
            rest = left[length] if full < number and left[length] < per_bin else 0
            if rest:
                place(length, rest, rest, first_bin + full, capacity - gap)
                leave(gap - rest * length, first_bin + full, 1)
                full += 1
            leave(gap, first_bin + full, number - full)
    return runs


def pack(items: DataFrame, *, capacity: int = 4096, length_column: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; columns of these names are replaced.

    A length that is null, below 1 or above the capacity cannot be placed: both columns are null.
    ``items`` is read twice and must give the same rows both times (a stored table). The histogram that
    reaches the driver has at most ``capacity`` rows; every length is ranked in ``RANK_PARTS`` parts,
    so what is broadcast has at most ``capacity * RANK_PARTS`` rows.
    """
    spark = items.sparkSession
    kept = items.drop("sequence_id", "offset").withColumn("__len", F.col(length_column).cast("bigint"))
    fits = F.col("__len").between(1, capacity)
    plain = [F.col(f"`{name}`") for name, kind in kept.dtypes if not kind.startswith(("map", "variant", "void"))]
    dealt = kept.withColumn("__part", F.pmod(F.xxhash64(*plain), F.lit(RANK_PARTS)).cast("int"))
    sizes = dealt.filter(fits).groupBy("__len", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__len").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__len", "__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    starts = stage(starts, "pack-sizes")
    counts = {row[0]: row[1] for row in starts.groupBy("__len").agg(F.sum("__n")).collect()}
    runs = spark.createDataFrame(plan_runs(counts, capacity), RUNS)
    within = Window.partitionBy("__len", "__part").orderBy(*([F.xxhash64(*plain)]))
    ranked = (
        dealt.join(F.broadcast(starts.drop("__n")), ["__len", "__part"], "left")
        .withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)
    )
    # At most a few runs for each of `capacity` lengths, whatever the number of items.
    at = F.col("__rank") - F.col("__first")
    return (
        ranked.join(
            F.broadcast(runs.withColumnRenamed("__len", "__run_len")),
            (F.col("__len") == F.col("__run_len")) & F.col("__rank").between(F.col("__first"), F.col("__last")),
            "left",
        )
        .withColumn("sequence_id", F.col("__bin") + F.floor(at / F.col("__per_bin")))
        .withColumn("offset", F.col("__at") + at % F.col("__per_bin") * F.col("__len"))
        .drop("__len", "__part", "__before", "__rank", "__run_len", "__first", "__last", "__per_bin", "__bin", "__at")
    )


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Place of every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(
        docs, read_tokenizer(tokenizer_path), capacity=capacity, end_id=end_id, with_ids=False
    ).drop("ids")
    placed = pack(stage(pieces, "pack-pieces"), capacity=capacity)
    return placed.withColumns({name: F.col(name).cast("bigint") for name in ("sequence_id", "offset")})


def packed_ids(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (array of int), doc_ids, starts.

    One sequence holds at most ``capacity`` tokens, so its group is bounded.
    """
    pieces = token_pieces(docs, read_tokenizer(tokenizer_path), capacity=capacity, end_id=end_id)
    placed = pack(stage(pieces, "pack-ids"), capacity=capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))

    def numbers(hexed):
        at = F.sequence(F.lit(1), F.length(hexed), F.lit(8))
        # Each number is eight hex digits, least significant byte first.
        return F.transform(at, lambda i: F.conv(F.concat(*[
            F.substr(hexed, (i + F.lit(k)).cast("int"), F.lit(2)) for k in (6, 4, 2, 0)
        ]), 16, 10).cast("int"))

    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda p: numbers(F.hex(p["ids"])))).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
