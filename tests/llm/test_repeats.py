import hashlib
import random
from collections import Counter

import pytest

from sparkrinse.llm import repeats


def expected(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    windows = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if windows[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), bytes(gone).count(b"\1\0"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_bytes int, spans string").repartition(4)
    return sorted((tuple(r) for r in repeats.with_digest(repeats.remove_repeats(df, **options)).collect()), key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh éß𝒳") for _ in range(n))
    base = [prose(rng.randrange(length, 3 * length)) for _ in range(6)]
    rows = []
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice("xyz")
            at = rng.randrange(len(text))
            parts.append(rng.choice(["", prose(30)]) + "".join(text[rng.choice([0, at]):]))
        rows.append("".join(parts))
    rows += [None, "", "short", base[0][:length], base[0][:length - 1], "ab" * length, "a" * (2 * length), prose(length) * 2]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5]), (None, None)]


@pytest.mark.parametrize("seed, length", [(1, 400), (2, 60), (3, 33)])
def test_against_all_windows(spark, seed, length):
    rows = corpus(seed, length)
    assert run(spark, rows, length=length) == expected(rows, length)


def test_small_blocks_and_pieces_give_the_same(spark, monkeypatch):
    rows = corpus(4, 50)
    monkeypatch.setattr(repeats, "BLOCK", 2)
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert run(spark, rows, length=50) == expected(rows, 50)


def test_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = prose(120)
    rows = [(i, prose(200) + "ijklmno"[i] + passage + "ijklmno"[i] + prose(100)) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    occurrences, spans = repeats.repeated_spans(df, length=100)
    texts = [t for _, t in rows]
    assert sorted((s["end"] - s["start"]) for r in spans.collect() for s in r.spans) == [120] * 7
    for anchor in {r.anchor for r in occurrences.collect()}:
        assert occurrences.filter(f"anchor = {anchor}").select("row").distinct().count() == 7
    assert all(passage in t for t in texts)


def test_common_prefix_intervals():
    words = sorted(["banana", "band", "bandana", "can", "candy", "z"])
    shared = [repeats.common(a.encode(), b.encode()) for a, b in zip(words, words[1:])]
    got = {(words[a], words[b], n) for a, b, n in repeats.intervals(shared) if a < b}
    assert got == {("banana", "bandana", 3), ("band", "bandana", 4), ("can", "candy", 3), ("banana", "z", 0)}


def test_empty_table(spark):
    assert run(spark, []) == []
