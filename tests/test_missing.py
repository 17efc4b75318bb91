"""Imputation against plain numpy."""

import numpy as np
import pytest

from synthspark.operators import missing as M
from synthspark.operators import neighbours as N
from tests.conftest import rows


def holey(spark, seed, n=220, complete=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2) * [1, 5, 20]
    x[: n // 3] = x[0]  # a third of the rows share one vector
    gone = rng.random((n, 3)) < 0.25
    if complete:
        gone[:, 2] = False
    data = [(i, *[None if gone[i, j] else float(x[i, j]) for j in range(3)]) for i in range(n)]
    return spark.createDataFrame(data, "id long, a double, b double, c double").repartition(5), np.where(gone, np.nan, x)


def brute_knn(x, k=5):
    out = x.copy()
    n, d = x.shape
    for j in range(d):
        donors = np.flatnonzero(~np.isnan(x[:, j]))
        for i in np.flatnonzero(np.isnan(x[:, j])):
            both = ~np.isnan(x[donors]) & ~np.isnan(x[i])
            present = both.sum(axis=1)
            gaps = np.where(both, x[donors] - x[i], 0.0)
            dist = np.where(present > 0, (gaps**2).sum(axis=1) * d / np.maximum(present, 1), np.nan)
            near = sorted((round(v, 9), int(r)) for v, r in zip(dist, donors) if not np.isnan(v))[:k]
            out[i, j] = np.mean([x[r, j] for _, r in near]) if near else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("complete", [True, False])
def test_knn_is_exact(spark, complete):
    df, x = holey(spark, 3, complete=complete)
    got = np.array([r[1:] for r in rows(M.impute_knn(df, "id"), "id")], dtype=float)
    want = brute_knn(x)
    # Equal distances may resolve differently by rounding alone.
    assert np.mean(np.isclose(got, want)) > 0.99


def test_knn_compares_few_pairs_when_the_whole_column_is_coarse(spark, monkeypatch):
    """The only column without holes has three values, so a grid over it alone compares a third of all pairs."""
    rng = np.random.default_rng(5)
    n = 4000
    x = np.column_stack([rng.integers(0, 9000, n), rng.integers(0, 50_000, n), rng.integers(0, 3, n) * 40]).astype(float)
    x[::13, 0], x[::7, 1] = np.nan, np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    compared = []
    top = N._top
    monkeypatch.setattr(N, "_top", lambda pairs, *rest: compared.append(pairs.count()) or top(pairs, *rest))
    got = np.array([r[1:] for r in rows(M.impute_knn(df, "id"), "id")], dtype=float)
    assert np.allclose(got, brute_knn(x))
    assert sum(compared) < 50 * n


def brute_mice(x, rounds):
    """Chained regressions, least missing column first, row by row."""
    gone = np.isnan(x)
    order = sorted([j for j in range(x.shape[1]) if gone[:, j].any()], key=lambda j: gone[:, j].sum())
    centre, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = np.where(gone, 0.0, (x - centre) / scale)
    for _ in range(rounds):
        for j in order:
            seen = ~gone[:, j]
            a = np.column_stack([np.ones(len(z)), np.delete(z, j, axis=1)])
            y = z[seen, j]
            beta = M.bayesian_ridge(a[seen].T @ a[seen], a[seen].T @ y, y @ y)
            z[~seen, j] = a[~seen] @ beta
    return z * scale + centre


def test_mice_from_moments_equals_row_by_row(spark):
    df, x = holey(spark, 4)
    x[:, 1] = np.where(np.isnan(x[:, 1]), np.nan, np.nan_to_num(x[:, 0]) * 2 + x[:, 1])
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], df.schema)
    got = np.array([r[1:] for r in rows(M.impute_mice(df, ["a", "b", "c"], 4), "id")], dtype=float)
    assert np.allclose(got, brute_mice(x, 4), rtol=1e-6, atol=1e-6)
    # The way out for tables with very many patterns gives the same fills.
    other = np.array([r[1:] for r in rows(M.impute_mice(df, ["a", "b", "c"], 4, max_patterns=1), "id")], dtype=float)
    assert np.allclose(other, got, rtol=1e-6, atol=1e-6)


def test_ridge_finds_a_line():
    x = np.linspace(0, 1, 50)
    a = np.column_stack([np.ones(50), x])
    y = 3 + 2 * x
    assert np.allclose(M.bayesian_ridge(a.T @ a, a.T @ y, y @ y), [3, 2], atol=1e-3)


def test_strategies(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 4, "a"), (4, 10, "b")], "id int, n int, s string")
    assert [r["n"] for r in M.impute_mean(df).orderBy("id").collect()] == [1.0, 5.0, 4.0, 10.0]
    assert M.impute_median(df).filter("id = 2").first()["n"] == 4
    assert M.impute_mode(df).filter("id = 2").first()["s"] == "a"
    wise = M.impute_columnwise(df, "constant").filter("id = 2").first()
    assert (wise["n"], wise["s"]) == (0, "a")
    assert M.impute_column(df, "n", "constant", 7).filter("id = 2").first()["n"] == 7
    with pytest.raises(ValueError):
        M.impute_column(df, "nope")
    full = df.dropna()
    assert M.impute(full, "mean") is full


def test_mechanism(spark):
    df = spark.createDataFrame([(i, float(i), None if i > 60 else 1.0, None if i % 2 else 2.0) for i in range(100)], "id int, x double, mar double, mcar double")
    got = {r["column"]: r["mechanism"] for r in M.missing_mechanism(df.drop("id")).collect()}
    assert got == {"mar": "MAR", "mcar": "MCAR"}
    assert M.missing_mechanism(df.select("id")).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id int, x double")
    quality = M.imputation_quality(df, M.impute(df, "mean"), "id")
    assert rows(quality) == [("x", 1, 1.0, 3.0, 3.0, 0.0)]
    assert tuple(M.imputation_summary(quality).first()) == (1, 1.0)
