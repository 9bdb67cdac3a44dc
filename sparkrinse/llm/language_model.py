"""A hierarchical Pitman-Yor language model of words, seated and applied once per pair of words.

A word is drawn in the restaurant of the word before it, whichever that is; its tables are customers of
the root restaurant, which all contexts share and whose base is even over the known words and one
unknown. Texts become portions of word numbers, which are stored and stay as they are. A portion sends
each of its distinct pairs with a count to a bucket, so a pair costs one entry a portion however often it
stands there. Pairs are dealt by word, those of the most frequent words by word and context. Words are
told by 62-bit keys, some ten thousand frequent ones by short numbers: most of what is stored and moved names them.

Seating is sampled by Gibbs sweeps over blocks: all customers of a word in a context leave and are
seated one by one, given the tables of the sweep before. After a sweep the buckets send what they seated
for each word, as word and as context, to the part that holds the word; the part adds up, seats the
word's customers in the root restaurant and answers. Predictive probabilities are averaged over the last
sweeps. A seating is a function of the seed, the sweep and the bucket, so a lost task repeats it.
"""
from __future__ import annotations

import dataclasses
import gc
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm.words import portions, spaced_table, split_words
from sparkrinse.staging import discard, stage

# Words whose pairs are dealt by word and context.
CONTEXTS = 4096
# Frequent words have the numbers from one up to this in place of keys: those that stand once among so many
# bytes of text at least, so that few words beyond them are sorted.
NUMBERED, ONE_AMONG = 1 << 16, 6 << 20
SWEEPS, AVERAGED = 4, 2
# Rounds in which buckets are scored.
ROUNDS = 4
SEED = 7
TOKENS_PER_BUCKET = 1_000_000
PORTION_BYTES = 4 << 20
BUCKETS_PER_PART = 4
STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 1.0, 1.0, 0.75
END = 0  # key of the end of a text; as a context the same key is the start of a text
PORTION = "portion string, documents binary, names binary, tokens binary"
BLOCK = "bucket int, portion string, pairs binary"
BUCKET = (
    "bucket int, portions array<string>, sizes array<bigint>, places array<binary>, names binary, w binary, c binary, n binary, "
    "tokens bigint, pairs_once bigint, pairs_twice bigint"
)
SEATED = "part int, bucket int, sums binary"
# Per word: its tables, its root tables, tables of its restaurant, its count, customers of its restaurant.
STATE = "bucket int, part int, words binary, tables bigint, root_tables bigint, types bigint"
ANSWER = "portion string, bucket int, answers binary"


def _names(schema: str) -> list[str]:
    return re.findall(r"(\w+) [\w<>]+", schema)


def _kinds(schema: str) -> list[pa.DataType]:
    known = {
        "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()),
    }
    return [known[k] for k in re.findall(r"\w+ ([\w<>]+)", schema)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _names(schema)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _kinds(schema))], _names(schema))


def _chosen(docs: DataFrame, id_column: str, text_column: str, folds: int, held: int) -> DataFrame:
    doc = F.col(id_column).cast("bigint")
    fold = F.coalesce(F.crc32(doc.cast("string")) % folds, F.lit(-1))
    return docs.select(doc.alias("doc_id"), F.col(text_column).cast("string").alias("text"), (fold == held).alias("held_out"))


def frequent_words(chosen: DataFrame, number: int, least: int = 1) -> list[tuple[str, int]]:
    """The most frequent training words of ``least`` occurrences with their counts; ties go to the smaller word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in portions(batch.column(0), PORTION_BYTES):
                words, _ = split_words(batch.column(0).slice(lo, hi - lo), spaced_table(lower=True))
                counted = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])

    counted = chosen.filter("not held_out").select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(number).collect()]


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from zero on, each array in as few bytes a number as its largest needs, compressed together.

    All first bytes of an array stand in front, then all second ones. What is packed lies on disk and travels.
    """
    heads, planes = [len(arrays).to_bytes(1, "little")], []
    for values in arrays:
        kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
        heads += [bytes([kind.itemsize]), len(values).to_bytes(8, "little")]
        planes.append(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return b"".join([*heads, pa.compress(b"".join(planes), codec="zstd", asbytes=True)])


def _unpacked(data: bytes) -> list[np.ndarray]:
    at = 1 + 9 * data[0]
    sizes = [(data[k], int.from_bytes(data[k + 1:k + 9], "little")) for k in range(1, at, 9)]
    planes = np.frombuffer(pa.decompress(pa.py_buffer(data).slice(at), sum(w * n for w, n in sizes), codec="zstd"), np.uint8)
    out, done = [], 0
    for width, number in sizes:
        values = np.ascontiguousarray(planes[done:done + width * number].reshape(width, number).T)
        out.append(values.view(f"u{width}").ravel().astype(np.int64))
        done += width * number
    return out


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each value among them; only distinct ones are sorted."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[codes]


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=0)


def word_keys(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    return (pd.util.hash_array(words, categorize=False).view(np.int64) & np.int64((1 << 62) - 1)) | np.int64(1 << 62)


def _numbered(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys, those of the frequent words (sorted) replaced by numbers that are spread evenly."""
    at = np.searchsorted(frequent, keys)
    found = np.append(frequent, -1)[at] == keys
    return np.where(found, at * NUMBERED // max(1, len(frequent)) + 1, keys)


def _dealt(keys: np.ndarray, number: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % number


def _to_portions(batches: Iterator[pa.RecordBatch], numbered: np.ndarray = np.zeros(0, np.int64)) -> Iterator[pa.RecordBatch]:
    """Texts as numbers into the portion's own list of words; number 0 ends a text."""
    for batch in batches:
        for lo, hi in portions(batch.column(1), PORTION_BYTES):
            words, bounds = split_words(batch.column(1).slice(lo, hi - lo), spaced_table(lower=True))
            coded = words.dictionary_encode()
            docs = hi - lo
            tokens = np.zeros(len(words) + docs, np.int32)
            inner = np.ones(len(tokens), bool)
            inner[bounds[1:] + np.arange(docs)] = False
            tokens[inner] = coded.indices.to_numpy(zero_copy_only=False) + 1
            names = np.append(END, _numbered(word_keys(coded.dictionary.to_numpy(zero_copy_only=False).astype(object)), numbered))
            documents = pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(bounds) + 1, pa.int64())],
                ["doc_id", "held_out", "n_tokens"],
            )
            yield _batch([(uuid.uuid4().hex, _ipc(documents), _packed(names), _packed(tokens))], PORTION)
            pa.default_memory_pool().release_unused()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a word: parts are stretches of the keys in order, the first quarter of them for frequent words."""
    few = parts // 4
    others = few + (((keys & np.int64((1 << 62) - 1)) >> 31) * (parts - few) >> 31)
    return np.where(keys <= NUMBERED, keys * few // (NUMBERED + 1), others)


class Pairs:
    """The distinct (word, context) of a portion in order of their buckets, and where its tokens stand."""

    def __init__(self, documents: bytes, names: bytes, tokens: bytes, frequent: np.ndarray, buckets: int) -> None:
        self.documents = pa.ipc.open_stream(documents).read_next_batch()
        held = self.documents.column(1).to_numpy(zero_copy_only=False).astype(bool)
        keys, ids = _unpacked(names)[0], _unpacked(tokens)[0]
        self.places = np.cumsum(ids == 0) - (ids == 0)
        before = np.concatenate([[0], ids[:-1]])  # the end of a text stands before the start of the next
        inverse, pairs = pd.factorize(ids * len(keys) + before)
        word, context = pairs // len(keys), pairs % len(keys)
        words, contexts = keys[word], keys[context]
        bucket = _dealt(np.where(np.isin(keys, frequent)[word], words * np.int64(1_000_003) + contexts, words), buckets)
        named = np.argsort(np.argsort(keys))  # places in the order of the keys, three of them in one number
        order = np.argsort((bucket * len(keys) + named[word]) * len(keys) + named[context])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.inverse = rank[inverse]
        self.customers = np.bincount(self.inverse[~held[self.places]], minlength=len(pairs))
        self.words, self.contexts, self.bucket = words[order], contexts[order], bucket[order]


def _to_blocks(frequent: np.ndarray, buckets: int):
    """Of every portion a row for each bucket: its pairs with the number of training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            pairs = Pairs(row["documents"], row["names"], row["tokens"], frequent, buckets)
            rows = []
            for b, a, z in zip(*_stretches(pairs.bucket)):
                words, first, last = _stretches(pairs.words[a:z])
                names, at = _ranked(pairs.contexts[a:z])
                rows.append((int(b), row["portion"], _packed(_steps(words), last - first, _steps(names), at, pairs.customers[a:z])))
            yield _batch(rows, BLOCK)

    return run


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each stretch of equal values."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return values[start], start, np.append(start[1:], len(values))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _gather():
    """All blocks of a bucket as one row, every pair once with its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            blocks = [(portion, *_unpacked(pairs)) for _, portion, pairs in group]
            names, at = _ranked(np.concatenate([np.cumsum(steps) for b in blocks for steps in (b[1], b[3])]))
            placed = iter(np.split(at, np.cumsum([len(steps) for b in blocks for steps in (b[1], b[3])])[:-1]))
            own = [np.repeat(next(placed), b[2]) * len(names) + next(placed)[b[4]] for b in blocks]
            pairs, inverse = _ranked(np.concatenate(own))
            n = np.bincount(inverse, weights=np.concatenate([b[5] for b in blocks])).astype(np.int64)
            # Blocks are in the order of the bucket's pairs.
            places = [_packed(_steps(part)) for part in np.split(inverse, np.cumsum([len(x) for x in own])[:-1])]
            yield _batch([(
                bucket, [b[0] for b in blocks], [len(x) for x in own], places, _packed(_steps(names)), _packed(_steps(pairs // len(names))),
                _packed(pairs % len(names)), _packed(n),
                int(n.sum()), int((n == 1).sum()), int((n == 2).sum()),
            )], BUCKET)
            pa.default_memory_pool().release_unused()

    return run


def seated(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating the customers; ``pull`` is the weight of a new table.

    They come one by one at first, and then in companies of up to a 64th of those who sit already, who
    do not see each other's choice; so a hundred times the customers take a few hundred steps more.
    """
    order = np.argsort(-customers, kind="stable")
    pulled, left = pull[order], customers[order]
    sat = np.ones(len(customers), np.int64)
    i, most = 1, int(left[0]) if len(left) else 0
    while i < most:
        n = int(np.searchsorted(-left, -i, "left"))  # those with more than i customers stand in front
        company = max(1, i // 64)
        chance = pulled[:n] / (pulled[:n] + i - discount * sat[:n])
        if company == 1:
            sat[:n] += rng.random(n) < chance
        else:
            sat[:n] += rng.binomial(np.minimum(company, left[:n] - i), chance)
        i += company
    tables = np.empty_like(sat)
    tables[order] = sat
    return tables


@dataclasses.dataclass
class Root:
    """What a sweep knows of the root restaurant as a whole."""

    types: int
    discount: float
    total: int
    root_total: int

    def even(self) -> float:
        return (ROOT_STRENGTH + ROOT_DISCOUNT * self.root_total) / (self.types + 1)

    def base(self, state: np.ndarray) -> np.ndarray:
        """Probability of words in the root restaurant, from their customers (child tables) and tables there."""
        return (state[0] - ROOT_DISCOUNT * state[1] + self.even()) / (ROOT_STRENGTH + self.total)


def _seat_bucket(bucket: int, w: np.ndarray, c: np.ndarray, n: np.ndarray, sweep: int, state: np.ndarray | None, root: Root | None) -> np.ndarray:
    """Tables of the bucket's pairs; the first sweep gives each a single one."""
    sat = np.minimum(n, 1)
    if root is not None:
        many = n > 1
        pull = (STRENGTH + root.discount * state[2][c[many]]) * root.base(state)[w[many]]
        sat[many] = seated(n[many], pull, root.discount, np.random.default_rng([SEED, sweep, bucket]))
    return sat


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries, one in memory at a time: a row is a whole portion."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _joined(buckets: DataFrame, states: dict[int, DataFrame], columns: list[str], number: int) -> DataFrame:
    """Buckets, each followed by its states in order of sweep and part."""
    rows = buckets.select("bucket", F.lit(-1).alias("sweep"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("words"), *columns)
    for sweep, state in states.items():
        rows = rows.unionByName(state.select("bucket", F.lit(sweep).alias("sweep"), "part", "words"), allowMissingColumns=True)
    return rows.repartition(number, "bucket").sortWithinPartitions("bucket", "sweep", "part")


def _seat(sweep: int, root: Root | None, parts: int):
    """For every name of a bucket and part: tables as word and as context, tokens as word and as context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, names, *arrays), states in _with_buckets(batches):
            names = np.cumsum(_unpacked(names)[0])
            w, c, n = np.cumsum(_unpacked(arrays[0])[0]), _unpacked(arrays[1])[0], _unpacked(arrays[2])[0]
            sat = _seat_bucket(bucket, w, c, n, sweep, states.get(sweep - 1), root)
            sums = [np.bincount(at, weights=v, minlength=len(names)).astype(np.int64) for v in (sat, n) for at in (w, c)]
            rows = [(int(p), bucket, _packed(_steps(names[a:z]), *(v[a:z] for v in sums))) for p, a, z in zip(*_stretches(_part(names, parts)))]
            yield _batch(rows, SEATED)
            pa.default_memory_pool().release_unused()

    return run


def _with_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[int, np.ndarray]]]:
    """Each bucket's number and columns, and by sweep what the parts answered for its names."""
    for bucket, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        own = next(group)[4:]
        answers: dict[int, list] = {}
        for row in group:
            answers.setdefault(row[1], []).append(np.stack(_unpacked(row[3])))
        yield (bucket, *own), {sweep: np.concatenate(found, axis=1) for sweep, found in answers.items()}


def _answer(sweep: int, root: Root | None):
    """Add up what the buckets seated for the words of a part, seat them in the root, and tell the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            sent = [(bucket, np.cumsum(steps), np.stack(sums)) for _, bucket, packed in group for steps, *sums in [_unpacked(packed)]]
            names, at = _ranked(np.concatenate([s[1] for s in sent]))
            values = np.concatenate([s[2] for s in sent], axis=1)
            tables, inner, count, customers = (np.bincount(at, weights=v, minlength=len(names)).astype(np.int64) for v in values)
            at_root = np.minimum(tables, 1)
            if root is not None:
                some = tables > 0
                at_root[some] = seated(tables[some], np.full(int(some.sum()), root.even()), ROOT_DISCOUNT, np.random.default_rng([SEED, sweep, part, 1]))
            state = np.stack([tables, at_root, inner, count, customers])
            whole = (int(tables.sum()), int(at_root.sum()), int((count > 0).sum()))
            done = 0
            for bucket, own, _ in sent:
                yield _batch([(bucket, part, _packed(*state[:, at[done:done + len(own)]]), *whole)], STATE)
                done += len(own)
                whole = (0, 0, 0)

    return run


def _score(used: list[tuple[int, Root, Root]]):
    """For every block the logs of its pairs' probabilities and the counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, w, c, n, places, portions_of), states in _with_buckets(batches):
            w, c, n = np.cumsum(_unpacked(w)[0]), _unpacked(c)[0], _unpacked(n)[0]
            chance = np.zeros(len(w))
            for sweep, before, after in used:
                sat = _seat_bucket(bucket, w, c, n, sweep, states[sweep - 1], before)
                state = states[sweep]
                chance += (n - after.discount * sat + (STRENGTH + after.discount * state[2][c]) * after.base(state)[w]) / (STRENGTH + state[4][c])
            logs = np.log10(chance / len(used)).astype(np.float32)
            counts = state[3]
            for portion, place in zip(portions_of, places):
                block = np.cumsum(_unpacked(place)[0])
                yield _batch([(portion, bucket, _packed(logs[block].view(np.uint32), counts[_stretches(w[block])[0]]))], ANSWER)

    return run


def _finish(frequent: np.ndarray, buckets: int):
    """Lay the answers of all buckets beside a portion's tokens and sum them per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            _, _, _, documents, names, tokens = next(group)
            pairs = Pairs(documents, names, tokens, frequent, buckets)
            answers = [_unpacked(r[2]) for r in group]
            logs = np.concatenate([a for a, _ in answers]).astype(np.uint32).view(np.float32)
            # A word's count is told once a block, where its pairs stand side by side.
            first = np.flatnonzero(np.diff(pairs.words, prepend=-1) | np.diff(pairs.bucket, prepend=-1))
            counts = np.repeat(np.concatenate([b for _, b in answers]), np.diff(first, append=len(pairs.words)))
            docs = pairs.documents.num_rows
            base, scored, known = (
                np.bincount(pairs.places, weights=v[pairs.inverse], minlength=docs) for v in (np.log10(counts + 0.5), logs, counts > 0)
            )
            yield pa.RecordBatch.from_arrays(
                [*pairs.documents.columns, pa.array(known.astype(np.int64)), pa.array(base), pa.array(scored)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    return run


def _let_go(df: DataFrame) -> None:
    """Spark deletes the shuffles of finished jobs when the driver's memory is cleaned, seldom by itself."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def score(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held: int = 1, contexts: int = CONTEXTS,
    tokens_per_bucket: int = TOKENS_PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Documents whose crc32 of the id as text, modulo ``folds``, is ``held`` are scored but not learnt from;
    null ids are learnt from. A null or empty text is the end token alone. ``base_score`` is the sum of
    smoothed unigram logs, ``score`` the model's log10 probability, ``perplexity`` 10 ** (-score / tokens).
    Repeated rows count and are scored each; columns beyond the two named are not read.
    """
    chosen = _chosen(docs, id_column, text_column, folds, held)
    size = chosen.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    top = word_keys(np.array([w for w, _ in frequent_words(chosen, max(contexts, NUMBERED), -(-size // ONE_AMONG))], object))
    numbered = np.unique(top[:NUMBERED])
    frequent = np.append(END, _numbered(top[:contexts], numbered))
    _let_go(docs)
    buckets = max(1, -(-size // (6 * tokens_per_bucket)))
    parts = -(-buckets // BUCKETS_PER_PART)
    # Stored before anything is dealt: a repeated task reads the same portions under the same names.
    stored = stage(chosen.mapInArrow(lambda batches: _to_portions(batches, numbered), PORTION), "lm-portions")
    blocks = stored.mapInArrow(_to_blocks(frequent, buckets), BLOCK).repartition(max(buckets, 2), "bucket")
    gathered = stage(blocks.sortWithinPartitions("bucket", "portion").mapInArrow(_gather(), BUCKET), "lm-buckets")
    del blocks
    known, n1, n2 = gathered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "pairs_once", "pairs_twice")]).collect()[0]
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    seats = ["names", "w", "c", "n"]
    states: dict[int, DataFrame] = {}
    roots: dict[int, Root] = {}
    for sweep in range(SWEEPS + 1):  # the first one gives every pair a single table
        root = roots.get(sweep - 1)
        before = {sweep - 1: states[sweep - 1]} if sweep else {}
        sent = _joined(gathered, before, seats, max(buckets, 2)).mapInArrow(_seat(sweep, root, parts), SEATED)
        states[sweep] = stage(sent.repartition(max(parts, 2), "part").sortWithinPartitions("part", "bucket").mapInArrow(_answer(sweep, root), STATE), "lm-words")
        total, root_total, types = states[sweep].agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tables", "root_tables", "types")]).collect()[0]
        roots[sweep] = Root(types, discount, total, root_total)
        if 0 < sweep <= SWEEPS - AVERAGED:
            discard(states.pop(sweep - 1))
        del sent
        _let_go(docs)
    used = [(sweep, roots[sweep - 1], roots[sweep]) for sweep in range(SWEEPS - AVERAGED + 1, SWEEPS + 1)]
    columns = ["w", "c", "n", "places", "portions"]
    answers, rounds = None, min(ROUNDS, buckets)
    for k in range(rounds):  # what a round shuffles is gone before the next
        lo, hi = buckets * k // rounds, buckets * (k + 1) // rounds
        mine = F.col("bucket").between(lo, hi - 1)
        joined = _joined(gathered.where(mine), {sweep: state.where(mine) for sweep, state in states.items()}, columns, max(hi - lo, 2))
        found = stage(joined.mapInArrow(_score(used), ANSWER), "lm-answers")
        answers = found if answers is None else answers.unionByName(found)
    for done in (gathered, *states.values()):
        discard(done)
    _let_go(docs)
    nothing = F.lit(None).cast("binary")
    both = stored.select("portion", F.lit(-1).alias("bucket"), nothing.alias("answers"), "documents", "names", "tokens").unionByName(
        answers.withColumns({"documents": nothing, "names": nothing, "tokens": nothing})
    )
    found = both.repartition(max(buckets, 2), "portion").sortWithinPartitions("portion", "bucket").mapInArrow(
        _finish(frequent, buckets), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
    )
    types = roots[SWEEPS].types
    scale = float(np.log10(known + 0.5 * (types + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
