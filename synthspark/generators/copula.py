"""Gaussian copula: column models joined by the correlation of normal scores.

Fitting reads the table in a few aggregates. Sampling is one projection over ``spark.range``.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.rng import normal_cdf, normal_quantile, uniform, with_normals
from synthspark.generators.marginals import Marginal, fit_marginals, normal_scores
from synthspark.spec import OUTPUT_PART_ROWS

ROW = "__row"


@dataclass
class CopulaModel:
    """Fitted copula. ``correlation`` covers the modelled columns in order."""

    spark: SparkSession
    marginals: list[Marginal]
    correlation: np.ndarray
    enforce_min_max: bool = True
    enforce_rounding: bool = True
    start: int = field(default=0)

    @property
    def joint(self) -> list[Marginal]:
        return [m for m in self.marginals if m.modelled]

    def sample(
        self, n: int, conditions: dict[str, Any] | None = None, seed: int = 0, start: int = 0, row_id: str | None = None
    ) -> DataFrame:
        """``n`` rows numbered from ``start``; equal numbers and seeds give equal rows on any layout.

        The result is one long projection. Store it before analysing it: a condition on a sampled column would
        otherwise repeat the formulas of that column.
        """
        rows = self.spark.range(start, start + n, 1, partitions_for(self.spark, n)).withColumnRenamed("id", ROW)
        return self.decode(self.latent(rows, conditions, seed), conditions, seed, row_id)

    def latent(self, rows: DataFrame, conditions: dict[str, Any] | None = None, seed: int = 0) -> DataFrame:
        """Add correlated normals ``_y{i}`` per modelled column to rows keyed by ``__row``."""
        conditions = conditions or {}
        known = {m.name for m in self.marginals}
        if set(conditions) - known:
            raise ValueError(f"conditions on unknown columns {sorted(set(conditions) - known)}")
        joint = self.joint
        fixed = [i for i, m in enumerate(joint) if m.name in conditions]
        free = [i for i in range(len(joint)) if i not in fixed]
        row = F.col(ROW)
        rows = rows.select("*", *[uniform(row, f"z:{joint[i].name}", seed).alias(f"_r{i}") for i in free])
        rows = with_normals(rows, {f"_r{i}": f"_z{i}" for i in free})
        rows = rows.select("*", *[self._held(joint[i], conditions, seed).alias(f"_y{i}") for i in fixed])
        mean, factor = conditional_normal(self.correlation, fixed, free)
        return rows.select(
            "*",
            *[
                _combine([(mean[a, b], f"_y{j}") for b, j in enumerate(fixed)] + [(factor[a, b], f"_z{k}") for b, k in enumerate(free)]).alias(f"_y{i}")
                for a, i in enumerate(free)
            ],
        )

    def _held(self, m: Marginal, conditions: dict[str, Any], seed: int) -> Column:
        """Normal score of a fixed value; a category is drawn within its part of the unit interval."""
        low, high = m.interval(conditions[m.name])
        u = F.lit(low) if low == high else F.lit(low) + (high - low) * uniform(F.col(ROW), f"c:{m.name}", seed)
        return normal_quantile(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), u)))

    def decode(
        self, latent: DataFrame, conditions: dict[str, Any] | None = None, seed: int = 0, row_id: str | None = None,
        keep: list[str] | None = None,
    ) -> DataFrame:
        """Turn normals into column values."""
        conditions = conditions or {}
        place = {m.name: i for i, m in enumerate(self.joint)}
        row = F.col(ROW)
        latent = latent.select(
            "*", *[normal_cdf(F.col(f"_y{i}")).alias(f"_u{i}") for c, i in place.items() if c not in conditions]
        )
        for m in self.marginals:
            if m.table is not None and m.name not in conditions:
                latent = _from_table(latent, m, f"_u{place[m.name]}")
        out = [C.quoted(k) for k in keep or []] + ([row.alias(row_id)] if row_id else [])
        for m in self.marginals:
            if m.name in conditions:
                out.append(F.lit(conditions[m.name]).cast(m.dtype).alias(m.name))
                continue
            if m.table is not None:
                value = F.col(f"_t_{m.name}").cast(m.dtype)
            elif m.name in place:
                value = m.value(F.col(f"_u{place[m.name]}"), self.enforce_min_max, self.enforce_rounding)
            else:
                value = m.drawn(row, seed)
            if m.null_share > 0:
                value = F.when(uniform(row, f"n:{m.name}", seed) >= m.null_share, value)
            out.append(value.alias(m.name))
        return latent.select(*out)


def _combine(terms: list[tuple[float, str]]) -> Column:
    total = F.lit(0.0)
    for weight, name in terms:
        if abs(weight) > 1e-12:
            total = total + float(weight) * F.col(name)
    return total


def _from_table(rows: DataFrame, m: Marginal, unit: str) -> DataFrame:
    """Category of a long list at a unit position, by an equi-join on the bucket of the position."""
    size = m.table.select("buckets").first()["buckets"]
    u = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(0.0), F.col(unit)))
    drawn = rows.withColumn("_u", u).withColumn("bucket", F.least(F.floor(F.col("_u") * size), F.lit(size - 1)))
    hit = (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))
    table = m.table.select("bucket", "low", "high", F.col("value").alias(f"_t_{m.name}"))
    return drawn.join(table, "bucket").filter(hit).drop("bucket", "_u", "low", "high")


def conditional_normal(correlation: np.ndarray, fixed: list[int], free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the fixed scores and the factor of the fresh ones for the free scores."""
    own = correlation[np.ix_(free, free)]
    if not fixed:
        return np.zeros((len(free), 0)), factor_of(own)
    cross = correlation[np.ix_(free, fixed)]
    mean = cross @ np.linalg.pinv(correlation[np.ix_(fixed, fixed)])
    return mean, factor_of(own - mean @ cross.T)


def factor_of(covariance: np.ndarray) -> np.ndarray:
    """Square root of a covariance that may be slightly indefinite."""
    if covariance.size == 0:
        return covariance
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


def score_correlation(named: DataFrame, d: int, attenuation: list[float] | None = None) -> np.ndarray:
    """Correlation matrix of columns ``s0 … s{d-1}`` from one aggregate, made positive semi-definite.

    Cutting a normal variable into categories weakens its correlations; ``attenuation`` undoes that.
    """
    weak = attenuation or [1.0] * d
    matrix = np.eye(d)
    if d > 1:
        # Plain means suffice: scores are centred and of unit size already.
        pairs = list(itertools.combinations(range(d), 2))
        row = named.agg(
            *[F.avg(F.col(f"s{i}")).alias(f"m{i}") for i in range(d)],
            *[F.avg(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"q{i}") for i in range(d)],
            *[F.avg(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)],
        ).first()
        spread = [math.sqrt(max((row[f"q{i}"] or 0.0) - (row[f"m{i}"] or 0.0) ** 2, 0.0)) for i in range(d)]
        for k, (a, b) in enumerate(pairs):
            if row[f"r{k}"] is not None and spread[a] * spread[b] > 1e-12:
                r = (row[f"r{k}"] - row[f"m{a}"] * row[f"m{b}"]) / (spread[a] * spread[b])
                matrix[a, b] = matrix[b, a] = min(0.999, max(-0.999, r / (weak[a] * weak[b])))
    return positive_correlation(matrix)


def positive_correlation(matrix: np.ndarray) -> np.ndarray:
    """The matrix without its negative eigenvalues, with ones on the diagonal again."""
    values, vectors = np.linalg.eigh(matrix)
    fixed = (vectors * np.clip(values, 1e-9, None)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def copula_fit(
    df: DataFrame,
    sdtypes: dict[str, str] | None = None,
    distribution: str = "beta",
    per_column: dict[str, str] | None = None,
    enforce_min_max: bool = True,
    enforce_rounding: bool = True,
) -> CopulaModel:
    """Fit column models and the correlation of their normal scores."""
    marginals = fit_marginals(df, sdtypes, distribution, per_column)
    joint = [m for m in marginals if m.modelled]
    correlation = score_correlation(normal_scores(df, joint), len(joint), [m.attenuation() for m in joint])
    return CopulaModel(df.sparkSession, marginals, correlation, enforce_min_max, enforce_rounding)


def copula_sample(model: CopulaModel | None, n: int, conditions: dict[str, Any] | None = None, seed: int = 0) -> DataFrame:
    if model is None:
        raise RuntimeError("the generator has not been fitted")
    return model.sample(n, conditions, seed)


def conditional_sample(model: CopulaModel, conditions: dict[str, Any], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with fixed column values; the other columns follow their conditional distribution."""
    return model.sample(n, conditions, seed)


def describe(model: CopulaModel) -> DataFrame:
    """``(column, kind, null_share, low, high, decimals, categories)`` of a fitted model."""
    rows = [
        (
            m.name, m.kind, round(m.null_share, 4),
            float(m.low) if m.kind == "number" else None, float(m.high) if m.kind == "number" else None,
            m.decimals, len(m.categories) if m.kind == "category" else None,
        )
        for m in model.marginals
    ]
    return model.spark.createDataFrame(
        rows, "column string, kind string, null_share double, low double, high double, decimals long, categories long"
    )


def partitions_for(spark: SparkSession, n: int, rows: int = OUTPUT_PART_ROWS) -> int:
    """Enough partitions that none makes more than ``rows`` rows, at least one per core for larger outputs."""
    return max(math.ceil(n / rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / 10_000)), 1)
