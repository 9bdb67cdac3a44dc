"""Exact quantiles must agree with numpy on any distribution."""
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrinse.operators import quantiles as q

POINTS = (0.0, 0.25, 0.5, 0.75, 1.0)


@pytest.fixture
def coarse(monkeypatch):
    # short lists, so that small data takes several passes
    monkeypatch.setattr(q, "LISTED", 20)


def samples():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.uniform(-5, 5, 4000),
        "heavy": rng.pareto(0.5, 4000),
        "hot": np.where(rng.uniform(size=4000) < 0.4, 3.0, rng.normal(size=4000)),
        "constant": np.full(4000, 2.5),
        "clusters": np.where(rng.uniform(size=4000) < 0.5, rng.normal(0, 1e-6, 4000), rng.normal(1e9, 1e-3, 4000)),
        "infinite": np.where(rng.uniform(size=4000) < 0.1, np.inf, np.where(rng.uniform(size=4000) < 0.4, -np.inf, rng.normal(size=4000))),
        "wide": np.where(rng.uniform(size=4000) < 0.5, -1.7e308, 1.7e308) * rng.uniform(0, 1, 4000),
        "whole": rng.integers(0, 50, 4000).astype(float),
        "lognormal": rng.lognormal(0, 3, 4000),
        "tiny": rng.integers(-3, 4, 4000) * 5e-324,
        "zeros": np.where(rng.uniform(size=4000) < 0.5, -0.0, 0.0),
    }


def interpolated(values, p):
    at = p * (len(values) - 1)
    low, share = values[int(np.floor(at))], at - np.floor(at)
    return low if share == 0 else low * (1 - share) + values[int(np.ceil(at))] * share


def test_columns(spark, coarse):
    data = samples()
    rows = [tuple(float(v) for v in row) for row in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in data)).repartition(5)
    found = q.quantile_values(df, list(data), POINTS)
    for name, values in data.items():
        # neighbours that numpy would interpolate between infinities or beyond the largest number are taken apart
        wanted = [interpolated(np.sort(values), p) for p in POINTS]
        assert found[name] == pytest.approx(wanted, rel=1e-12), name


def test_groups_with_one_hot_group(spark, coarse):
    rng = np.random.default_rng(3)
    groups = np.where(rng.uniform(size=6000) < 0.6, "hot", rng.choice(list("abcde"), 6000))
    values = rng.normal(size=6000)
    rows = [(str(g), float(v)) for g, v in zip(groups, values)] + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    found = {r["g"]: r for r in q.quantiles(df, ["x"], POINTS, by=["g"]).collect()}
    assert set(found) == set(groups)
    for g in found:
        mine = values[groups == g]
        assert found[g]["n"] == len(mine)
        assert list(found[g]["q"]) == pytest.approx(np.quantile(mine, POINTS).tolist(), rel=1e-12)


def test_short_column(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x DOUBLE")
    assert q.quantile_values(df, ["x"], (0.25, 0.5, 0.75)) == {"x": [2.0, 3.0, 4.0]}


def test_column_without_numbers(spark):
    df = spark.createDataFrame([(None,)], "x DOUBLE").where(F.col("x").isNull())
    assert q.quantile_values(df, ["x"], (0.5,)) == {}
    assert q.numeric_summaries(df, ["x"]) == {}


def test_keys_are_the_bits_of_the_numbers(spark):
    rng = np.random.default_rng(5)
    drawn = rng.integers(-(2**63), 2**63 - 1, 20_000).view(np.float64)
    ends = [2.0**e for e in range(-1074, 1024)]
    near = [float(np.nextafter(x, d)) for x in ends for d in (0.0, np.inf)]
    numbers = [float(x) for x in [*drawn[np.isfinite(drawn)], *ends, *near, 0.0, -0.0, np.inf] if np.isfinite(x) or x > 0]
    numbers += [-x for x in numbers]
    found = q.with_key(spark.createDataFrame([(x,) for x in numbers], "x DOUBLE")).collect()
    for x, row in zip(numbers, found):
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert row["k"] == (-bits if x < 0 else bits), x
        assert struct.pack("<d", row["x"]) == struct.pack("<d", x + 0.0)


def test_four_passes_whatever_the_distribution(spark, monkeypatch):
    passes = []
    narrowed = q._narrowed
    monkeypatch.setattr(q, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    monkeypatch.setattr(q, "LISTED", 1)
    data = samples()
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*data.values())], ", ".join(f"{c} DOUBLE" for c in data))
    q.quantile_values(df, list(data), POINTS)
    assert len(passes) <= 3
    passes.clear()
    q.quantile_values(df, ["constant", "zeros"], POINTS)
    assert not passes
