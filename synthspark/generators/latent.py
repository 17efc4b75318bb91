"""Linear latent-factor generator: normal scores -> principal factors -> sampled factors -> scores -> values.

Stands in for variational autoencoders. The decoder is linear, and residual noise keeps each column's spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.functions.rng import uniform, with_normals
from synthspark.generators.copula import ROW, CopulaModel, _combine, copula_fit, partitions_for


@dataclass
class LatentModel:
    """``loadings`` turn independent factors into scores; ``noise`` is the deviation they leave out."""

    base: CopulaModel
    loadings: np.ndarray
    noise: np.ndarray

    def sample(self, n: int, conditions: dict | None = None, seed: int = 0) -> DataFrame:
        if conditions:
            raise ValueError("a latent-factor model cannot hold columns fixed; use the copula")
        spark = self.base.spark
        d, k = self.loadings.shape
        rows = spark.range(0, n, 1, partitions_for(spark, n)).withColumnRenamed("id", ROW)
        row = F.col(ROW)
        rows = rows.select(
            row,
            *[uniform(row, f"f:{j}", seed).alias(f"_r{j}") for j in range(k)],
            *[uniform(row, f"e:{i}", seed).alias(f"_r{k + i}") for i in range(d)],
        )
        rows = with_normals(rows, {f"_r{j}": f"_z{j}" for j in range(k + d)})
        rows = rows.select(
            row,
            *[
                _combine([(self.loadings[i, j], f"_z{j}") for j in range(k)] + [(self.noise[i], f"_z{k + i}")]).alias(f"_y{i}")
                for i in range(d)
            ],
        )
        return self.base.decode(rows, None, seed)


def latent_fit(df: DataFrame, factors: int | None = None, explained: float = 0.9, **options) -> LatentModel:
    """Principal factors of the score correlation; enough to explain the asked share unless a number is given."""
    base = copula_fit(df, **{"distribution": "empirical", **options})
    values, vectors = np.linalg.eigh(base.correlation)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    if factors is None:
        factors = int(np.searchsorted(np.cumsum(values) / values.sum(), explained) + 1)
    factors = max(1, min(factors, len(values)))
    loadings = vectors[:, :factors] * np.sqrt(values[:factors])
    left = np.clip(1.0 - (loadings**2).sum(axis=1), 0.0, None)
    return LatentModel(base, loadings, np.sqrt(left))
