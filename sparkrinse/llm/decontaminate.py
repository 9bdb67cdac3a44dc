"""Mark the words of documents that stand inside a passage of a benchmark.

An exact containment join with a prefix filter: a window of benchmark words can only occur in a
document that holds each of its word pairs, so its rarest pair, by the counts of all documents, is the
necessary prefix. Positions of such pairs are the candidates; the window's offset and length bound
where it would have to lie, and its words are compared one by one.

The benchmark is taken in blocks of a fixed number of windows, so what a task holds does not depend on
its size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm import words
from sparkrinse.staging import stage

WINDOW_WORDS = 13
BLOCK_WINDOWS = 40_000
PORTION_BYTES = 16 << 20
SCANNED = "__id bigint, __key string, n_words bigint, hits array<struct<start: bigint, end: bigint>>, items array<string>"


def windows(benchmark: DataFrame, *, id_column: str = "item_id", text_column: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows with the items that have them: words (array), items (sorted array of strings).

    A shorter item is one window; an item without words has none. A null id stays a null item.
    """
    found = F.regexp_extract_all(words.lowered(F.col(text_column).cast("string")), F.lit(words.LETTER_WORD), 0)
    each = benchmark.select(F.col(id_column).cast("string").alias("item"), found.alias("found")).filter(F.size("found") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("found") - F.lit(size - 1), F.lit(1)))
    cut = each.select("item", "found", F.explode(starts).alias("start"))
    return (
        cut.select("item", F.slice("found", F.col("start"), size).alias("words"))
        .groupBy("words").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    )


class Block:
    """Windows as rows of word numbers, with every pair (or single word) they hold."""

    def __init__(self, rows: list) -> None:
        self.vocabulary = sorted({w for row in rows for w in row["words"]})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.items = [list(row["items"]) for row in rows]
        self.lengths = np.array([len(row["words"]) for row in rows], np.int64)
        self.words = np.full((len(rows), max(self.lengths, default=1)), -1, np.int64)
        for i, row in enumerate(rows):
            self.words[i, :len(row["words"])] = [number[w] for w in row["words"]]
        n = len(self.vocabulary)
        second = np.concatenate([self.words[:, 1:], np.full((len(rows), 1), -1)], axis=1)
        # A pair is first * (n + 1) + second + 1; a word alone has no second.
        self.pairs = np.where(second >= 0, self.words * (n + 1) + second + 1, -1)
        single = self.lengths == 1
        self.pairs[single, 0] = self.words[single, 0] * (n + 1)
        self.all_pairs = np.unique(self.pairs[self.pairs >= 0])
        self.singles = bool(single.any())

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, bounds = words.split_words(texts, words.letter_table())
        index = pc.index_in(found, value_set=pa.array(self.vocabulary, found.type))
        return pc.fill_null(index, -1).to_numpy(zero_copy_only=False).astype(np.int64), bounds

    def pairs_of(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each position the pair that starts there, or -1."""
        pairs = np.full(len(numbers), -1, np.int64)
        if len(numbers) > 1:
            both = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            pairs[:-1][both] = (numbers[:-1] * (len(self.vocabulary) + 1) + numbers[1:] + 1)[both]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        pairs[last] = -1
        return pairs

    def order(self, counts: dict[int, int]) -> None:
        """Choose the rarest pair of every window as its prefix; windows with a pair that no document has go."""
        known = np.array([counts.get(int(p), 0) for p in self.all_pairs], np.int64)
        at = np.searchsorted(self.all_pairs, self.pairs)
        number = np.where(self.pairs >= 0, known[np.minimum(at, len(known) - 1)], np.iinfo(np.int64).max)
        self.offset = number.argmin(axis=1)
        rarest = number.min(axis=1)
        chosen = self.pairs[np.arange(len(self.lengths)), self.offset]
        self.live = np.flatnonzero(rarest > 0)
        self.live = self.live[np.argsort(chosen[self.live], kind="stable")]
        self.prefix = chosen[self.live]


def _count_pairs(block: Block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.all_pairs) + 1, np.int64)

        def add(pairs: np.ndarray) -> None:
            at = np.searchsorted(block.all_pairs, pairs)
            at[block.all_pairs[np.minimum(at, len(block.all_pairs) - 1)] != pairs] = len(block.all_pairs)
            total[:] += np.bincount(at, minlength=len(total))

        for batch in batches:
            for lo, hi in words.portions(batch.column(0), PORTION_BYTES):
                numbers, bounds = block.numbers(batch.column(0).slice(lo, hi - lo))
                add(block.pairs_of(numbers, bounds))
                if block.singles:
                    add(np.where(numbers >= 0, numbers * (len(block.vocabulary) + 1), -1))
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(block.all_pairs[seen]), pa.array(total[seen])], ["pair", "n"])

    return count


def _scan(block: Block):
    def hits_of(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur: first word and window."""
        found_at, found = [], []
        kinds = [block.pairs_of(numbers, bounds)]
        if block.singles:
            kinds.append(np.where(numbers >= 0, numbers * (len(block.vocabulary) + 1), -1))
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for pairs in kinds:
            first = np.searchsorted(block.prefix, pairs, "left")
            many = np.searchsorted(block.prefix, pairs, "right") - first
            at = np.flatnonzero(many)
            place = np.repeat(at, many[at])
            nth = np.arange(len(place)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            window = block.live[np.repeat(first[at], many[at]) + nth]
            start = place - block.offset[window]
            text = text_of[place]
            inside = (start >= bounds[text]) & (start + block.lengths[window] <= bounds[text + 1])
            start, window = start[inside], window[inside]
            for j in range(block.words.shape[1]):
                wanted = block.words[window, j]
                same = (wanted < 0) | (numbers[np.minimum(start + j, len(numbers) - 1)] == wanted)
                start, window = start[same], window[same]
            found_at.append(start)
            found.append(window)
        return np.concatenate(found_at), np.concatenate(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.portions(batch.column(2), PORTION_BYTES):
                part = batch.slice(lo, hi - lo)
                numbers, bounds = block.numbers(part.column(2))
                start, window = hits_of(numbers, bounds)
                depth = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + block.lengths[window], -1)
                hit = np.cumsum(depth[:-1]) > 0
                hits: list[list] = [[] for _ in range(part.num_rows)]
                items: list[list] = [[] for _ in range(part.num_rows)]
                text_of = np.searchsorted(bounds, start, "right") - 1
                for text in np.unique(text_of):
                    own = hit[bounds[text]:bounds[text + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    hits[text] = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    items[text] = sorted({i for w in np.unique(window[text_of == text]) for i in block.items[w]})
                pieces = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(hits, pa.list_(pieces)),
                     pa.array(items, pa.list_(pa.string()))],
                    ["__id", "__key", "n_words", "hits", "items"],
                )

    return scan


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = WINDOW_WORDS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, text_md5, n_words, hits (spans of word positions), items (sorted ids).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Repeated rows give
    a row each, null ids included. Other columns of either table are not read.
    """
    chosen = docs.select(
        F.col(id_column).cast("bigint").alias("__id"), F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("__key"),
        F.col(text_column).cast("string").alias("__text"),
    )
    held = stage(windows(benchmark, text_column="text", size=size), "bench-windows")
    blocks = max(1, -(-held.count() // block_windows))
    # Every window has one block, about equal in size; a block alone is collected.
    dealt = held.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        block = Block(dealt.filter(F.col("block") == number).collect())
        counted = chosen.select("__text").mapInArrow(_count_pairs(block), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        block.order({row["pair"]: row["n"] for row in counted.collect()} if block.items else {})
        scanned = chosen.mapInArrow(_scan(block), SCANNED).withColumn("block", F.lit(number))
        found = scanned if found is None else found.unionByName(scanned)
    together = found.groupBy("__id", "__key", "n_words").agg(
        F.count_if(F.col("block") == 0).alias("__copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return together.select(
        F.col("__id").alias("doc_id"), F.col("__key").alias("text_md5"), "n_words", "hits", "items",
        F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"),
    ).drop("__copy")


def hit_words(hits):
    """Words inside any span of a sorted array of spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("until"))
    return F.aggregate(
        hits, zero,
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["end"] - F.greatest(h["start"], s["until"]), F.lit(0))).alias("n"),
            F.greatest(s["until"], h["end"]).alias("until"),
        ),
        lambda s: s["n"],
    )


def verdicts(found: DataFrame) -> DataFrame:
    """Digest columns of ``contamination``: a document is contaminated from a twentieth of its words on."""
    n_hit = hit_words(F.col("hits"))
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "text_md5", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they were; options as in ``contamination``."""
    judged = verdicts(contamination(docs, benchmark, id_column=id_column, text_column=text_column, **options))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("__b_id"), F.col("text_md5").alias("__b_key")).distinct()
    key = F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    on = F.col("__c_id").eqNullSafe(F.col("__b_id")) & (F.col("__c_key") == F.col("__b_key"))
    marked = docs.withColumn("__c_key", key).withColumn("__c_id", F.col(id_column).cast("bigint"))
    return marked.join(bad, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
