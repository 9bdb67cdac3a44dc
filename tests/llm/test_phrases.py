import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sparkrinse.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "of", "ñandú", "ÅB", "x\x0bz", "a-b", "q"]
    rows = []
    for _ in range(n):
        made = []
        for _ in range(rng.randrange(0, 40)):
            made.append(rng.choice(["new york city", "New  York", "the\tcity of", rng.choice(words), rng.choice(words), str(rng.randrange(30))]))
            made.append(rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ! "]))
        rows.append((rng.choice(["en", "en", "en", "de", "", None]), "".join(made)))
    rows += [("en", None), ("fr", ""), ("fr", " \t "), ("en", "only\r\none"), ("de", "long word " * 4_000 + "." + "another long word " * 3_000)]
    rows += [("en", "new york city. new york city of the city")] * 12
    rng.shuffle(rows)
    return rows


def expected(rows, shortest=2, longest=3, support=10, covered=50, top=2_000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if a >= support and len(p) > shortest}
    out = {}
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        if any(
            q[0] == lang and len(q) > len(p) and 100 * b >= covered * a
            and any(q[i:i + len(words)] == words for i in range(1, len(q) - len(words) + 1)) for q, b in candidates.items()
        ):
            continue
        cuts = [(10**6 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    return sorted(
        (lang, n, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for n, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    found = phrases.collocations(df, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def test_against_all_phrases(spark):
    rows = texts(1)
    found = mined(spark, rows)
    assert found == expected(rows) and len(found) > 50


def test_longer_phrases_and_few_ranks(spark):
    rows = texts(2)
    options = {"shortest": 2, "longest": 5, "support": 4, "covered": 70, "top": 40}
    assert mined(spark, rows, **options) == expected(rows, **options)


@pytest.mark.parametrize("sample, bits", [(1, 26), (50, 26), (4, 6)])
def test_neither_sample_nor_bitmap_changes_anything(spark, monkeypatch, sample, bits):
    """A sample of all, one that misses nearly everything, and a bitmap that everything is in."""
    monkeypatch.setattr(phrases, "SAMPLE", sample)
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "PORTION_BYTES", 300)
    monkeypatch.setattr(phrases, "GATHERED", 100)
    monkeypatch.setattr(phrases, "ADDED", 500)
    monkeypatch.setattr(phrases, "SPELLED_ROWS", 300)
    rows = texts(3)
    assert mined(spark, rows) == expected(rows)


def test_failures_of_the_border_open_further_passes(spark, monkeypatch):
    passes = []
    counted = phrases.frequent
    monkeypatch.setattr(phrases, "SAMPLE", 1_000_000)
    monkeypatch.setattr(phrases, "frequent", lambda docs, asked, sizes, least, parts: passes.append(list(sizes)) or counted(docs, asked, sizes, least, parts))
    rows = texts(4)
    assert mined(spark, rows) == expected(rows)
    assert passes == [[1], [2], [1, 2, 3], [2, 3], [2, 3]]


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_words_and_pieces():
    words = phrases.Words(pa.array(["A b,C", None, " d\x0be ", "f"]))
    assert words.array().to_pylist() == ["a", "b", "c", "d", "e", "f"]
    assert words.text.tolist() == [0, 0, 0, 2, 2, 3]
    assert len(set(words.piece.tolist())) == 5 and words.piece[0] == words.piece[1]


def test_shared_bits_lose_no_phrase(spark, monkeypatch):
    """Few bits: parts of frequent phrases seem proposed although the sample missed their words."""
    monkeypatch.setattr(phrases, "BITS", 12)
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b, c = (f"w{i}{x}" for x in "abc")
        rows += [("en", f"{a} {b} {c}. {rng.random()}") for _ in range(rng.randrange(10, 13))]
        rows += [("en", f"{b} z{rng.random()} {c}") for _ in range(8)]
    found = mined(spark, rows)
    assert len(found) == 400 and all(phrase.count(" ") == 2 for _, _, phrase, *_ in found)
