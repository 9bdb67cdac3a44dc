import random

from sparkrinse.llm import near_duplicates
from sparkrinse.llm.components import components


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows, numerator, denominator):
    sets = [shingle_set(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        first = min(ids, default=None)
        out.append((doc, len(sets[i]), first, doc == first))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "d", "ñ", "über"]) + str(rng.randrange(40))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 5, 9, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy))
    rows += [None, "", "  \n", "one", "ONE", "x " * 30_000, "x " * 30_001]
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)] + [(5, "one"), (5, "one"), (None, "a null id"), (None, "two null ids"), (None, "A null id")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, n_shingles int")
    found = near_duplicates.with_verdict(near_duplicates.near_duplicates(df, **options))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_against_all_pairs(spark):
    rows = texts(3)
    assert run(spark, rows) == expected(rows, 85, 100)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = texts(4)
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCUMENTS", 2)
    assert run(spark, rows, numerator=80) == expected(rows, 80, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components(spark):
    links = [(i + 1, i) for i in range(1, 30)] + [(100, 40), (40, 60), (60, 100), (7, 7), (None, 3), (200, 201), (200, 201)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 60: 40, 100: 40, 200: 200, 201: 200}


def test_one_row_of_each_group_stays(spark):
    rows = texts(5)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, group string")
    out = near_duplicates.keep_one(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    wordless = [r for r in rows if not (r[1] or "").split()]
    firsts = {r[0] for r in expected(rows, 85, 100) if r[3] and r[0] is not None}
    assert sorted(d for d, t in kept if d is not None and (t or "").split()) == sorted(firsts - {d for d, _ in wordless})
    assert sorted((r for r in kept if not (r[1] or "").split()), key=str) == sorted(wordless, key=str)
    assert sorted(t.lower() for d, t in kept if d is None) == ["a null id", "two null ids"]
