import random

import pytest
from pyspark.sql import functions as F

from sparkrinse.llm import line_dedup


def distance(a, b):
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, line, number):
    line = list(line)
    for _ in range(number):
        at = rng.randrange(len(line))
        kind = rng.choice("idr")
        if kind == "i":
            line.insert(at, rng.choice("abñ𝒳 "))
        elif kind == "d":
            del line[at]
        else:
            line[at] = rng.choice("abcé ")
    return "".join(line)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcñ𝒳") for _ in range(rng.randrange(edits + 1, 30)))
        b = edited(rng, a, rng.randrange(0, min(edits + 2, len(a))))
        a, b = sorted((a, b), key=len, reverse=True)
        if len(b) > edits and len(a) - len(b) <= edits:
            rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= edits), (r.a, r.b)


def expected(rows, edits, least):
    lines = []
    for doc, text in rows:
        for place, line in enumerate(text.split("\n") if text is not None else []):
            if (len(line) >= least if least is not None else line.strip(" \t\n\v\f\r")):
                lines.append(((doc is not None, doc or 0, place), line, (doc, text)))
    first = {}
    for order, line, _ in sorted(lines, key=lambda x: x[0]):
        first.setdefault(line, order)
    near = {x for x in first if len(x) > edits and any(len(y) > edits and first[y] < first[x] and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in first if y != x)}
    dropped = {}
    for order, line, row in lines:
        if line in near or order != first[line]:
            dropped.setdefault(row, set()).add(order[2])
    out = []
    for doc, text in rows:
        own = dropped.get((doc, text), set())
        close = sum((doc is not None, doc or 0, p) == first[text.split("\n")[p]] for p in own)
        out.append((doc, len(text.split("\n")) if text is not None else 0, len(own) - close, close, sorted(own)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.randrange(8, 60))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = [edited(rng, x, rng.choice([0, 0, 0, 1, 2, 3, 4])) for x in rng.sample(base, 4)]
        rows.append((100 - i, "\n".join(rng.choice([lines, [*lines, "", "short", lines[0]]]))))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, base[0]), (None, base[1] + "\n" + base[0]), (90, "x" * 60_000), (91, "x" * 60_001)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize(("edits", "least"), [(0, 8), (1, 8), (2, 8), (3, 8), (0, None), (1, None), (2, None), (3, None)])
def test_report_against_all_pairs(spark, edits, least):
    rows = corpus(edits)
    rng = random.Random(edits + 10)
    rows += [(600 + i, "\n".join("".join(rng.choice("abcdé ") for _ in range(rng.randrange(9))) for _ in range(4))) for i in range(8)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, place int, line string")
    found = sorted((tuple(r) for r in line_dedup.line_report(df, edits=edits, least=least).collect()), key=str)
    assert found == expected(rows, edits, least)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_counts_never_refuse_close_lines(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(500):
        a = "".join(rng.choice("etaoinsrhldcumfpgwyb XÉ") for _ in range(rng.randrange(4, 80)))
        rows.append((a, edited(rng, a, edits)))
    apart = line_dedup.counts_apart(line_dedup.candidate_id(F.col("a")), line_dedup.candidate_id(F.col("b")))
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", apart.alias("apart")).collect()
    for r in found:
        lee = sum(min(d, 4 - d) for d in ((r.a.count(c) - r.b.count(c)) % 4 for c in line_dedup.COUNTED))
        assert r.apart == lee <= 2 * edits


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_counts_at_the_ends_never_refuse_close_lines(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("etaoinsrhldcumfpgwyb XÉ") for _ in range(rng.randrange(630, 650) if rng.random() < 0.7 else 900))
        rows.append((a, edited(rng, a, edits)))
    number = [line_dedup.candidate_id(line_dedup.ends(F.col(c))) for c in "ab"]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select("a", F.length(line_dedup.ends(F.col("a"))).alias("seen"), line_dedup.counts_apart(*number).alias("apart")).collect()
    assert all(r.apart <= 2 * edits and r.seen == min(len(r.a), 2 * line_dedup.COUNTED_END) for r in found)


def test_long_lines_that_differ_inside(spark):
    rng = random.Random(3)
    a, b = ("".join(rng.choice("etaoin shrdlu") for _ in range(900)) for _ in range(2))
    inside = a[:450] + "xyz" + a[453:]  # three edits, seen only when whole lines are counted or compared
    rows = [(1, a), (2, a[:440] + "x" + a[441:]), (3, inside), (4, b), (5, b[:50] + b[51:450] + "qq" + b[451:])]
    found = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    dropped = {r.doc_id for r in found if r.n_near}
    assert dropped == {y for y, later in rows for x, earlier in rows if x < y and distance(earlier, later) <= 2}


def test_rewritten_texts(spark):
    line = "a line that many documents have in common"
    rows = [(1, f"{line}\nfirst of its kind, this one"), (2, f"{line}\n{line}"), (3, f"short\n{line}!\nand another one of its own"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "en", 7) for r in rows], "doc_id long, text string, lang string, __dropped int")
    out = line_dedup.drop_duplicate_lines(df.drop("__dropped").withColumn("near", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "near"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [
        (1, rows[0][1]), (3, "short\nand another one of its own"), (4, None), (5, ""),
    ]
    assert line_dedup.drop_duplicate_lines(df.drop("__dropped").limit(0)).count() == 0


def test_short_lines(spark):
    rows = [(1, "Les.\n\nx\n \t\nLes."), (2, "Lea.\nx\n\n \t\nñ"), (3, "Les.\nñ"), (4, "ab\nabc\nxyz\nxyc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_lines, r.n_exact, r.n_near, r.dropped) for r in line_dedup.line_report(df).collect())
    assert found == [(1, 5, 1, 0, [4]), (2, 5, 1, 1, [0, 1]), (3, 2, 2, 0, [0, 1]), (4, 4, 0, 1, [3])]


def test_whole_copies_leave_nothing(spark):
    text = "a line that is long enough for the edit join\n\nLes.\n \t\r\n\nand another line that is long enough"
    rows = [(1, text), (2, text), (3, "the only line of this text\n\n"), (4, "the only line of this text\n\n\n"), (5, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.drop_duplicate_lines(df)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [rows[0], rows[2], rows[4]]
