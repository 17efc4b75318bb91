"""Multi-modal generator: Gaussian mixtures per number column, a chosen category as stratum, copula of residuals.

Stands in for adversarial networks: it keeps several modes per column, rare categories and conditioning on a
category.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.rng import uniform, with_normals
from synthspark.generators.copula import ROW, _combine, factor_of, partitions_for, score_correlation
from synthspark.generators.marginals import Marginal, _tree, fit_marginals

HISTOGRAM_BINS = 2048


@dataclass
class Modes:
    """Mixture of one number column; ``weights`` per stratum and mode."""

    marginal: Marginal
    means: list[float]
    deviations: list[float]
    weights: dict[str, list[float]]

    def mode_of(self, x: Column) -> Column:
        """Nearest mode in units of its spread, the hard form of mode-specific normalisation."""
        gaps = [F.abs(x - m) / s for m, s in zip(self.means, self.deviations)]
        least = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        pick = F.lit(len(gaps) - 1)
        for i in range(len(gaps) - 1, -1, -1):
            pick = F.when(gaps[i] <= least, F.lit(i)).otherwise(pick)
        return F.when(x.isNotNull(), pick)


@dataclass
class MixtureModel:
    """Strata, the other categories per stratum, modes per stratum and correlated residuals."""

    spark: SparkSession
    stratum: Marginal
    categories: list[Marginal]
    category_shares: dict[str, dict[str, list[float]]]
    numbers: list[Modes]
    others: list[Marginal]
    correlation: np.ndarray
    order: list[str]

    def sample(self, n: int, conditions: dict[str, Any] | None = None, seed: int = 0, log_frequency: bool = False) -> DataFrame:
        """``n`` rows. ``log_frequency`` draws strata by the logarithm of their size, which favours rare ones."""
        conditions = conditions or {}
        extra = set(conditions) - {self.stratum.name}
        if extra:
            raise ValueError(f"this model conditions on '{self.stratum.name}' only, not {sorted(extra)}")
        shares = list(self.stratum.shares)
        if log_frequency:
            sizes = np.log1p(np.diff([0.0, *shares]) * 1e6)
            shares = np.cumsum(sizes / sizes.sum()).tolist()
        rows = self.spark.range(0, n, 1, partitions_for(self.spark, n)).withColumnRenamed("id", ROW)
        row = F.col(ROW)
        labels = [F.lit(c) for c in self.stratum.categories]
        if self.stratum.name in conditions:
            self.stratum.interval(conditions[self.stratum.name])
            label = F.lit(str(conditions[self.stratum.name]))
        else:
            label = _tree(uniform(row, "stratum", seed), shares[:-1], labels)
        rows = rows.withColumn("_s", label).select(
            "*",
            *[uniform(row, f"r:{m.marginal.name}", seed).alias(f"_r{i}") for i, m in enumerate(self.numbers)],
            *[uniform(row, f"g:{m.name}", seed).alias(f"_g{i}") for i, m in enumerate(self.categories)],
            *[uniform(row, f"k:{m.marginal.name}", seed).alias(f"_k{i}") for i, m in enumerate(self.numbers)],
        )
        rows = with_normals(rows, {f"_r{i}": f"_z{i}" for i in range(len(self.numbers))})
        factor = factor_of(self.correlation)
        rows = rows.select(
            "*",
            *[
                _combine([(factor[i, k], f"_z{k}") for k in range(len(self.numbers))]).alias(f"_y{i}")
                for i in range(len(self.numbers))
            ],
        )
        out = {self.stratum.name: F.col("_s").cast(self.stratum.dtype)}
        for i, m in enumerate(self.categories):
            choices = [F.lit(c) for c in m.categories]
            out[m.name] = self._by_stratum(lambda s, m=m, i=i, c=choices: _tree(F.col(f"_g{i}"), self.category_shares[m.name][s][:-1], c)).cast(m.dtype)
        for i, m in enumerate(self.numbers):
            spots = [m.means[k] + m.deviations[k] * F.col(f"_y{i}") for k in range(len(m.means))]
            x = self._by_stratum(lambda s, m=m, i=i, v=spots: _tree(F.col(f"_k{i}"), m.weights[s][:-1], v))
            x = F.least(F.lit(m.marginal.high), F.greatest(F.lit(m.marginal.low), x))
            out[m.marginal.name] = m.marginal.stored(x)
        for m in self.others:
            if m.kind == "number":
                out[m.name] = m.value(uniform(row, f"o:{m.name}", seed))
            else:
                out[m.name] = m.drawn(row, seed)
        gone = {m.name: m.null_share for m in [self.stratum, *self.categories, *[x.marginal for x in self.numbers], *self.others]}
        return rows.select(
            *[
                (F.when(uniform(row, f"n:{c}", seed) >= gone[c], out[c]) if gone[c] > 0 and c not in conditions else out[c]).alias(c)
                for c in self.order
            ]
        )

    def _by_stratum(self, build) -> Column:
        """One expression per stratum; strata are literals, so this stays inside the projection."""
        names = list(self.stratum.categories)
        value = build(names[-1])
        for s in reversed(names[:-1]):
            value = F.when(F.col("_s") == s, build(s)).otherwise(value)
        return value


def mixture_fit(
    df: DataFrame, stratum: str, sdtypes: dict[str, str] | None = None, modes: int = 5, seed: int = 42, max_strata: int = 64
) -> MixtureModel:
    """Fit mixtures with MLlib on weighted bins, then one aggregate for mode weights and one for residual correlation."""
    marginals = {m.name: m for m in fit_marginals(df, sdtypes, "empirical")}
    base = marginals[stratum]
    if base.kind != "category" or base.table is not None or len(base.categories) > max_strata:
        raise ValueError(f"'{stratum}' must be a category column of at most {max_strata} values")
    plain = [m for m in marginals.values() if m.kind == "number" and not C.is_datetime(m.dtype)]
    groups = [m for m in marginals.values() if m.kind == "category" and m.table is None and m.name != stratum]
    fitted = []
    bins = _histograms(df, plain, HISTOGRAM_BINS) if plain else {}
    for m in plain:
        means, deviations = _fit_modes(df.sparkSession, m, bins[m.name], modes, seed)
        fitted.append(Modes(m, means, deviations, {}))
    key = F.coalesce(C.as_text(df, stratum), F.lit(base.categories[0])).alias("_s")
    placed = df.select(key, *[f.mode_of(C.as_double(df, f.marginal.name)).alias(f"_m{i}") for i, f in enumerate(fitted)])
    aggs = [
        F.count_if(F.col(f"_m{i}") == k).alias(f"w{i}_{k}") for i, f in enumerate(fitted) for k in range(len(f.means))
    ]
    table = {r["_s"]: r for r in placed.groupBy("_s").agg(F.count("*").alias("n"), *aggs).collect()}
    for i, f in enumerate(fitted):
        for s in base.categories:
            sizes = np.array([table[s][f"w{i}_{k}"] if s in table else 0 for k in range(len(f.means))], dtype=float) + 1e-9
            f.weights[s] = np.cumsum(sizes / sizes.sum()).tolist()
    shares = _shares_by_stratum(df, key, base, groups)
    residuals = []
    for f in fitted:
        x = C.as_double(df, f.marginal.name)
        mode = f.mode_of(x)
        residual = F.lit(None).cast("double")
        for k in range(len(f.means)):
            residual = F.when(mode == k, (x - f.means[k]) / f.deviations[k]).otherwise(residual)
        residuals.append(residual)
    correlation = score_correlation(df.select(*[r.alias(f"s{i}") for i, r in enumerate(residuals)]), len(residuals))
    used = {stratum, *[g.name for g in groups], *[f.marginal.name for f in fitted]}
    others = [m for c, m in marginals.items() if c not in used]
    long = [m.name for m in others if m.kind == "category"]
    if long:
        raise ValueError(f"columns {long} have too many categories for this model")
    return MixtureModel(df.sparkSession, base, groups, shares, fitted, others, correlation, df.columns)


def _histograms(df: DataFrame, plain: list[Marginal], bins: int) -> dict[str, list[tuple[float, float]]]:
    """``{column: [(middle of the bin on the unit interval, count)]}`` of all columns from one count."""
    cells = []
    for m in plain:
        place = F.floor((C.as_double(df, m.name) - m.low) / ((m.high - m.low) or 1.0) * bins)
        cells.append(F.struct(F.lit(m.name).alias("column"), F.least(place, F.lit(bins - 1)).alias("bin")))
    counts = df.select(F.inline(F.array(*cells))).filter("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))
    found: dict[str, list[tuple[float, float]]] = {m.name: [] for m in plain}
    for r in counts.collect():
        found[r["column"]].append(((r["bin"] + 0.5) / bins, float(r["n"])))
    return {c: sorted(v) for c, v in found.items()}


def _fit_modes(
    spark: SparkSession, m: Marginal, bins: list[tuple[float, float]], modes: int, seed: int
) -> tuple[list[float], list[float]]:
    """Means and deviations of one column's mixture, fitted to weighted bins: EM never rereads the table."""
    span = (m.high - m.low) or 1.0
    rows = spark.createDataFrame(bins, "x double, w double").coalesce(1)
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    fit = GaussianMixture(k=modes, seed=seed, maxIter=15, tol=0.01, weightCol="w").fit(data)
    found = [(float(g.mean[0]), float(g.cov.toArray()[0, 0]) ** 0.5) for g in fit.gaussians]
    kept = sorted((mean, max(sd, 1e-4)) for (mean, sd), w in zip(found, fit.weights) if w > 0.005) or found[:1]
    return [m.low + span * a for a, _ in kept], [span * b for _, b in kept]


def _shares_by_stratum(df: DataFrame, key: Column, base: Marginal, groups: list[Marginal]) -> dict[str, dict[str, list[float]]]:
    """Cumulative category shares per stratum from one count of (stratum, column, category)."""
    if not groups:
        return {}
    cells = F.array(*[F.struct(F.lit(g.name).alias("column"), C.as_text(df, g.name).alias("value")) for g in groups])
    counts = df.select(key, F.inline(cells)).filter("value is not null").groupBy("_s", "column", "value").agg(F.count("*").alias("n"))
    found = {(r["_s"], r["column"], r["value"]): r["n"] for r in counts.collect()}
    out: dict[str, dict[str, list[float]]] = {}
    for g in groups:
        out[g.name] = {}
        for s in base.categories:
            sizes = np.array([found.get((s, g.name, c), 0) for c in g.categories], dtype=float) + 1e-9
            out[g.name][s] = np.cumsum(sizes / sizes.sum()).tolist()
    return out
