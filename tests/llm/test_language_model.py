import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrinse.llm import language_model
from sparkrinse.staging import stage


def tokens(text):
    return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), None]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def corpus(seed, number=300):
    rng = random.Random(seed)
    follows = {}
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ñu", "THE"]
    rows = []
    for i in range(number):
        word, out = rng.choice(vocabulary), []
        for _ in range(rng.randrange(0, 40)):
            out.append(word)
            follows.setdefault(word.lower(), rng.sample(vocabulary, 3))
            word = rng.choice(follows[word.lower()]) if rng.random() < 0.85 else rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(out)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "never seen words"), (1004, "x " * 30_000), (None, "w1 w2"), (5, rows[5][1]), (5, rows[5][1])]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, score string, bucket int").repartition(3)
    return language_model.score(df, **options).collect()


@pytest.mark.parametrize("options", [{}, {"contexts": 7, "tokens_per_bucket": 500}])
def test_counts_and_base_scores(spark, options):
    rows = corpus(1)
    train = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    want = []
    for doc, text in rows:
        own = tokens(text)
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((doc, held(doc), len(own), sum(train[t] > 0 for t in own), n, round(base, 6)))
    found = run(spark, rows, **options)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in found)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = corpus(2, 1500)
    out = [r for r in run(spark, rows) if r.held_out]
    tokens_out = sum(r.n_tokens for r in out)
    model, base = (10 ** (-sum(getattr(r, c) for r in out) / tokens_out) for c in ("score", "base_score"))
    assert model < 0.5 * base
    assert model > 3  # three followers of each word and some noise: nothing can be surer than that


def test_probabilities_at_the_start_stay_below_one(spark):
    # Held-out texts of one word, known or not, and the empty one: what can follow the start of a text.
    rows = [(i, t) for i, t in corpus(3, 200) if i is not None and i < 1000]
    words = sorted({t.decode() for _, text in rows for t in tokens(text) if t is not None})
    held_ids = [i for i in range(10_000, 20_000) if held(i)]
    ends = held_ids.pop()
    extra = [(held_ids[k], w) for k, w in enumerate(words)] + [(held_ids[len(words)], "unheardof"), (ends, "")]
    found = {r.doc_id: r.score for r in run(spark, rows + extra)}
    known = {t for doc, text in rows if not held(doc) for t in tokens(text)}
    total = sum(10 ** found[held_ids[k]] for k, w in enumerate(words) if w.encode() in known) + 10 ** found[ends] + 10 ** found[held_ids[len(words)]]
    assert 0 < total < 1.0001


def test_seating():
    rng = np.random.default_rng(1)
    customers = np.array([1, 2, 50, 5000] * 200)
    none = language_model.seated(customers, np.zeros(800), 0.5, rng)
    assert (none == 1).all()
    some = language_model.seated(customers, np.full(800, 2.0), 0.0, rng)
    # Without discount the expected number of tables is the sum of a / (a + i).
    for c in (2, 50, 5000):
        want = sum(2.0 / (2.0 + i) if i else 1.0 for i in range(c))
        assert abs(some[customers == c].mean() - want) < 0.06 * want + 0.2


def test_lost_tasks_repeat_their_seating(spark):
    rows = corpus(4)
    first, second = ({(r.doc_id, r.n_tokens): round(r.score, 9) for r in run(spark, rows)} for _ in range(2))
    assert first == second


def test_empty_table(spark):
    assert run(spark, []) == []
    one = run(spark, [(1, None)])
    assert one[0].n_tokens == 1


def test_rare_words_are_contexts_of_their_own(spark):
    # However few words count as frequent, the model stays the same but for the sampling.
    rows = corpus(5, 1500)
    scores = []
    for contexts in (2, 4096):
        out = [r for r in run(spark, rows, contexts=contexts, tokens_per_bucket=2000) if r.held_out]
        scores.append(10 ** (-sum(r.score for r in out) / sum(r.n_tokens for r in out)))
    assert math.isclose(*scores, rel_tol=0.02)


def test_hot_pairs_are_not_gathered(spark, monkeypatch):
    sizes = []

    def watched(df, label):
        out = stage(df, label)
        if label == "lm-buckets":
            sizes.extend(sum(r.sizes) for r in out.filter("bucket >= 0").select("sizes").collect())
        return out

    monkeypatch.setattr(language_model, "stage", watched)
    rows = [*corpus(6), *[(2000 + i, "x " * 2000) for i in range(30)]]
    assert len(run(spark, rows, tokens_per_bucket=4000)) == len(rows)
    assert len(sizes) > 1 and max(sizes) <= 4000


def test_repeated_tasks_name_the_same_portions(spark, monkeypatch):
    def run_twice(df, label):
        if label == "lm-buckets":
            first, again = ({r[0] for r in df.select(F.explode("portions")).distinct().collect()} for _ in range(2))
            assert first == again
        return stage(df, label)

    monkeypatch.setattr(language_model, "stage", run_twice)
    assert len(run(spark, [(i, "a b") for i in range(5)])) == 5


def test_tokens_take_few_bytes():
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(1))}" for _ in range(500)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts), pa.array([False] * 100)], ["doc_id", "text", "held_out"])
    [portion] = [row for out in language_model._to_portions(iter([batch])) for row in out.to_pylist()]
    assert len(portion["tokens"]) < 2 * 501 * 100
    pairs = language_model.Pairs(portion["documents"], portion["names"], portion["tokens"], np.zeros(1, np.int64), 3)
    assert len(pairs.inverse) == 501 * 100 and pairs.customers.sum() == 501 * 100
    assert list(zip(pairs.bucket, pairs.words, pairs.contexts)) == sorted(zip(pairs.bucket, pairs.words, pairs.contexts))


def test_answers_come_in_rounds(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(language_model, "stage", lambda df, label: labels.append(label) or stage(df, label))
    rows = corpus(8)
    assert len(run(spark, rows, tokens_per_bucket=4000)) == len(rows)
    assert labels.count("lm-answers") == language_model.ROUNDS


def test_frequent_words_have_short_names():
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(500)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts), pa.array([False] * 100)], ["doc_id", "text", "held_out"])
    top = [w for w, _ in Counter(w for t in texts for w in t.split()).most_common(1000)]
    numbered = np.unique(language_model.word_keys(np.array(top, object)))
    sizes, seen = [], []
    for words in (numbered[:0], numbered):
        [portion] = list(language_model._to_portions(iter([batch]), words))
        [blocks] = list(language_model._to_blocks(np.zeros(1, np.int64), 30)(iter([portion])))
        sizes.append(sum(len(b) for b in blocks.column(2).to_pylist()))
        row = portion.to_pylist()[0]
        pairs = language_model.Pairs(row["documents"], row["names"], row["tokens"], np.zeros(1, np.int64), 30)
        seen.append(sorted(pairs.customers.tolist()))
    assert seen[0] == seen[1] and sizes[1] < 0.75 * sizes[0]


def test_parts_are_stretches_of_the_names():
    rng = np.random.default_rng(1)
    frequent = np.sort(rng.integers(1 << 62, (1 << 63) - 1, 500))
    keys = np.concatenate([[language_model.END], frequent, rng.integers(1 << 62, (1 << 63) - 1, 5000)])
    names = np.sort(language_model._numbered(keys, frequent))
    assert len(np.unique(names)) == len(keys) and (names <= language_model.NUMBERED).sum() == 501
    for parts in (1, 3, 4, 37):
        part = language_model._part(names, parts)
        assert (np.diff(part) >= 0).all() and set(part.tolist()) == set(range(parts))
