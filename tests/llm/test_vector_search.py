import math
import random

import pytest
from pyspark.sql import functions as F

from sparkrinse.llm import exact_search, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score int, block string"


def table(seed, n=220, dims=6):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        if i % 3 == 0:  # a third of all rows are copies of one vector
            v = [0.25, -0.5, 0.125, 0.75, 0.0, 0.5]
        else:
            size = rng.choice([0.2, 1, 1, 5])
            v = [rng.gauss(0, size) for _ in range(dims)]
        made.append([i, v, rng.randrange(4)])
    made[10][1], made[11][1], made[12][1] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.inf] * dims
    made[13][1], made[14][1], made[15][1], made[16][1] = [math.nan] + [0.0] * 5, [], [2.0, 3.0], [0.0] * dims
    made[17][2], made[18][0] = None, None
    made.append(list(made[20]))
    rng.shuffle(made)
    return [(*r, 1, "x") for r in made]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    import numpy as np

    return [min(max(math.floor(scale * float(np.float32(x))), vectors.LEAST), vectors.MOST) for x in v]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), vectors.LEAST), vectors.MOST)


def nearest(rows, k, scale, every):
    held = {r[0]: whole(r[1], scale) for r in rows if r[0] is not None and fine(r[1])}
    out = []
    for q in held:
        if q % every == 0:
            found = sorted((-product(held[q], v), i) for i, v in held.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def negatives(rows, every, scale=256):
    held = {r[0]: (r[2], whole(r[1], scale)) for r in rows if r[0] is not None and r[2] is not None and fine(r[1])}
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-product(v, w), i, of == label) for i, (of, w) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(-t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_VECTORS", 17), ("CHUNK_QUERIES", 5), ("TILE", 3), ("STEP", 4), ("SAMPLE", 40)):
        monkeypatch.setattr(exact_search, name, value)
    for name, value in (("BUCKET_VECTORS", 19), ("CHUNK_TARGETS", 7), ("FOCUS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)


def searched(spark, rows, k=9, every=7, scale=64):
    found = exact_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % every == 0, k, scale=scale)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def mined(spark, rows, every=5):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % every == 0).collect()))


def test_search_against_all_pairs(spark, small):
    rows = table(1)
    assert searched(spark, rows) == nearest(rows, 9, 64, 7)


def test_search_in_one_block_and_with_fewer_rows(spark):
    rows = table(2, n=21)
    assert searched(spark, rows, k=30) == nearest(rows, 30, 64, 7)


def test_search_beyond_64_bits(spark, small):
    rows = [(i, [x * 10.0 ** (i % 25) for x in (1.5, -2.5, 0.5)], 0, 1, "x") for i in range(60)]
    assert searched(spark, rows, k=4, every=3) == nearest(rows, 4, 64, 3)


def test_negatives_against_all_pairs(spark, small):
    rows = table(3)
    expected = negatives(rows, 5)
    assert len(expected) > 300 and mined(spark, rows) == expected


def test_negatives_in_one_bucket(spark):
    rows = table(4, n=90)
    assert mined(spark, rows) == negatives(rows, 5)


def test_empty_tables(spark):
    assert searched(spark, []) == [] and mined(spark, []) == []


def test_exact_vectors_are_read_in_the_order_of_their_bounds():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = vectors.Rows(rng.integers(-40, 40, (5_000, 8)))
    query = rng.integers(-40, 40, 8)
    exact = rows.exact @ query
    scores, at = exact_search._visited(rows, query, (exact + 60).astype(float), 10, None)
    assert len(at) < 1_000 and sorted(scores)[-10:] == sorted(exact)[-10:]


def test_coordinates_prune_only_what_cannot_reach():
    import numpy as np

    rng = np.random.default_rng(1)
    exact = rng.integers(-300, 300, (2_000, 5))
    lengths = np.sqrt((exact.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths)
    exact, lengths = exact[order], lengths[order]
    lists = np.argsort(exact / lengths[:, None], axis=0, kind="stable").T.astype(np.int32)
    data, kind, width = vectors.packed(exact)
    bucket = hard_negatives.Bucket({"ids": list(range(2_000)), "labels": [0] * 2_000, "lengths": lengths.tobytes(), "lists": lists.tobytes(), "exact": data, "kind": kind, "width": width}, 5)
    for query in rng.integers(-300, 300, (50, 5)):
        scores = exact @ query
        low = int(np.sort(scores)[-10])
        found = bucket.candidates(query, low)
        assert set(np.flatnonzero(scores >= low)) <= set(found.tolist()) and len(found) < 1_000
