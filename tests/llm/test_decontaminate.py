import hashlib
import random
import re

from sparkrinse.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def expected(docs, bench, size=13):
    windows = {}
    for item, text in bench:
        found = WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(found) - size + 1) if found else 0):
            windows.setdefault(tuple(found[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        found = WORD.findall((text or "").translate(UPPER))
        hit, items = set(), set()
        for window, owners in windows.items():
            for i in range(len(found) - len(window) + 1):
                if tuple(found[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items |= owners
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


def run(spark, docs, bench, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, words string")
    b = spark.createDataFrame([(*r, "y") for r in bench], "item_id long, text string, doc_id string")
    rows = decontaminate.verdicts(decontaminate.contamination(d, b, **options)).drop("text_md5").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Zu", "größe", "a1", "x", "YES", "no", "ñu"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, prose(rng.randrange(1, 30))) for i in range(30)] + [(7, None), (8, ""), (9, "...!"), (11, "the"), (11, "Only one"), (12, "only ONE")]
    docs = [(i, prose(rng.randrange(0, 40))) for i in range(40)]
    docs += [(100 + i, f"{prose(20)}. {bench[i][1].upper()}! {prose(20)}") for i in range(20)]
    docs += [(1, None), (2, ""), (3, "x only-one y"), (3, "x only-one y"), (None, "The"), (5, "z" * 70_000 + " only one"), (6, bench[3][1] * 3000)]
    want = expected(docs, bench)
    assert run(spark, docs, bench) == want
    assert run(spark, docs, bench, block_windows=25) == want
    assert run(spark, docs, bench, size=3) == expected(docs, bench, 3)


def test_empty_tables(spark):
    docs, bench = [(1, "a b"), (None, None)], [(1, "a b")]
    assert run(spark, docs, []) == expected(docs, [])
    assert run(spark, [], bench) == []
    assert [r[2] for r in run(spark, docs, bench)] == [2, 0]


def test_contaminated_rows_go(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = [(1, passage, "en"), (2, "clean " * 30, None), (2, passage + " x", "de"), (3, passage + " y" * 300, "de"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = decontaminate.drop_contaminated(df, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([docs[1], docs[3], docs[4]], key=str)
