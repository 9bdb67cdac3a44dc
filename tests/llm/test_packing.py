import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkrinse.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello, World's end...", "don't we'll İstanbul ǅ ﬁ é é ́x", "a b c\x1cd", "x" * 500,
    "<|endoftext|> a<|startoftext|>b", "１２3 ½ 日本語 😀!! can't.", "(word) [x] it's 'quoted' a_b\tc\x0bd\n\n", "STRASSE Straße ΑΣ.", "3×.4÷.x K.Å E\u0301. A\u0300.b I\u0307 <|STARTOFTEXT|> ǄŽ.Ω. end.\u00a0x\u2003.y",
]


def expected(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            out.append((doc, piece, lo, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return sorted(out, key=str)


def valid(rows, capacity):
    bins = {}
    for row in rows:
        bins.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_whole_documents(spark):
    rng = random.Random(1)
    rows = [(i, text) for i, text in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (None, "no id")]
    rows += [(100 + i, " ".join(rng.choice(["Ab,", "cde.", "don't", "Ñu;", "1234", "--"]) for _ in range(rng.randrange(90)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("ids", F.lit(1))
    out = packing.pack_documents(df, PATH, capacity=32).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str)
    assert got == expected(rows, 32)
    assert valid(out, 32) <= 1.1 * -(-sum(r.length for r in out) // 32) + 1


def test_packed_ids_round_trip(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    back = {}
    for row in packing.packed_ids(df, PATH, capacity=64).collect():
        assert len(row["ids"]) == row.n_tokens <= 64
        for doc, start in zip(row.doc_ids, row.starts):
            back.setdefault(doc, [0, []])[0] += 1
    assert set(back) == set(range(len(ODD)))
    whole = sum(r.n_tokens for r in packing.packed_ids(df, PATH, capacity=64).collect())
    assert whole == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in ODD)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 60, 100, 4096])
    counts = {n: rng.choice([0, 1, 3, 50]) for n in range(1, capacity + 1) if rng.random() < 0.3}
    ranks, bins, offsets = {n: 0 for n in counts}, {}, {}
    for length, first, last, per_bin, first_bin, offset in packing.plan_runs(counts, capacity):
        assert first == ranks[length]
        ranks[length] = last + 1
        for r in range(last - first + 1):
            parts = bins.setdefault(first_bin + r // per_bin, [])
            parts.append((offset + r % per_bin * length, length))
    assert ranks == counts
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in parts) <= 2


def test_plan_is_tight():
    counts = {3: 10, 4: 10, 5: 10, 6: 10, 7: 10}
    assert len({b + r // p for _, f, t, p, b, _ in packing.plan_runs(counts, 10) for r in range(t - f + 1)}) == 25


def test_lengths_that_cannot_be_placed(spark):
    df = spark.createDataFrame([(None, 1), (0, 2), (11, 3), (10, 4), (4, 5), (4, 5)], "length int, sequence_id int")
    rows = packing.pack(df, capacity=10).collect()
    assert [r.sequence_id is None for r in sorted(rows, key=lambda r: (r.length is not None, r.length or 0))] == [True, True, False, False, False, True]
    assert packing.pack(df.limit(0), capacity=10).count() == 0
