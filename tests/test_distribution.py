"""Distributed order statistics against numpy."""

import numpy as np
import pytest

from synthspark.functions import distribution as D


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(4000, 7.25), rng.lognormal(3, 2, 5000), rng.integers(0, 5, 3000).astype(float)])
    rng.shuffle(x)
    data = [(float(v), None if i % 3 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "a double, b double").repartition(5)
    return df, x, np.array([v for _, v in data if v is not None])


PROBES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(df, a, b):
    got = D.exact_quantiles(df, ["a", "b"], PROBES)
    assert np.allclose(got["a"], np.quantile(a, PROBES), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile(b, PROBES), rtol=1e-12)


def test_quantiles(skewed):
    check(*skewed)


def test_quantiles_narrow_in_several_rounds(skewed, monkeypatch):
    monkeypatch.setattr(D, "BRACKET_ROWS", 60)
    check(*skewed)


def test_quantiles_survive_a_bad_sample(skewed, monkeypatch):
    real = D._bracket_sketch

    def wrong(*args):
        out = real(*args)
        return {t: {**r, "cuts": sorted(np.linspace(1e6, 2e6, D.GRID + 1).tolist())} for t, r in out.items()}

    monkeypatch.setattr(D, "_bracket_sketch", wrong)
    check(*skewed)


def test_quantiles_of_empty_and_single(spark):
    df = spark.createDataFrame([(None, 3.5), (None, None)], "a double, b double")
    got = D.exact_quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [None], "b": [3.5]}


@pytest.mark.parametrize("cells", [None, 10])
def test_running_totals(spark, cells):
    rng = np.random.default_rng(2)
    values = np.unique(rng.normal(size=3000))
    n = rng.integers(1, 50, len(values))
    counts = spark.createDataFrame([("k", float(v), int(c)) for v, c in zip(values, n)], "column string, num double, n long")
    got = {r["num"]: r["cum_n"] for r in D.running_totals(counts.repartition(7), ["column"], "num", ["n"], cells=cells).collect()}
    assert [got[float(v)] for v in values] == np.cumsum(n).tolist()


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, -1.0), ("a", 2, 1.5), ("b", 1, None)], "s string, i int, f double")
    got = {r["column"]: (r["txt"], r["num"]) for r in D.modes(df, ["s", "i", "f"]).collect()}
    assert got["s"][0] == "a" and got["i"] == ("1", 1.0) and got["f"][1] == 1.5
