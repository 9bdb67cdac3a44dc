import random
import re
from collections import Counter

from sparkrinse.llm import quality_rules

WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "house", "größe", "of", "ñandú", "water", "x", "Bird", "river", "𝒳yz", "1984"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [prose(rng.randrange(20, 120)) + "." for _ in range(150)]
    rows += ["\n".join([prose(30), "same line here", prose(9), "same line here", "  ", "  "]) for _ in range(5)]
    passage = prose(12)
    rows += [f"{prose(40)} {passage} {prose(3)} {passage} {passage}" for _ in range(5)]
    rows += [None, "", " \t\n\x0b\f\r", "a", "a " * 40_000, "same eight words that come again and again " * 2, "\n\n\n"]
    return [(i, t) for i, t in enumerate(rows)], prose


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_words string, `__k` double")
    return {r.doc_id: r for r in quality_rules.assess(df).collect()}


def test_counts_against_plain_python(spark):
    rows, _ = corpus(2)
    found = run(spark, [(i, t, random.choice(["en", None]), random.choice(["a", "b", None])) for i, t in rows])
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), text


def test_verdicts_follow_the_group(spark):
    rows, prose = corpus(3)
    rows = [(i, t, "en", "a") for i, t in rows[:150]]
    junk = [" ".join(w + "%%%" for w in prose(60).split()), prose(60).upper().replace(" ", "!! "), prose(60).replace(" ", " | ")]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(junk)]
    # Where every text has symbols, symbols are no defect; a small group borrows from its language.
    rows += [(2000 + i, " ".join(w + "&" for w in prose(50).split()), "xx", "b") for i in range(120)]
    rows += [(3000, prose(40), "en", "tiny"), (3001, junk[0], "en", "tiny"), (3002, prose(40), None, None)]
    found = run(spark, rows)
    assert all(found[i].kept for i in range(150)), [found[i].failed for i in range(150) if not found[i].kept]
    assert [found[1000 + i].kept for i in range(3)] == [False] * 3
    assert all(found[2000 + i].kept for i in range(120))
    assert [found[i].kept for i in (3000, 3001, 3002)] == [True, False, True]


def test_keep_good_keeps_columns(spark):
    rows, _ = corpus(4)
    df = spark.createDataFrame([(*r, "en", None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    found = run(spark, [(i, t, "en", None) for i, t in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in found if found[i].kept)
    assert quality_rules.keep_good(df.limit(0)).count() == 0
    assert run(spark, []) == {}
