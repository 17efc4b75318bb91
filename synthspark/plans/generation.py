"""Whole generation job and the benchmark grid."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.generators.copula import copula_fit
from synthspark.generators.latent import latent_fit
from synthspark.generators.mixture import mixture_fit
from synthspark.operators import fidelity as Q
from synthspark.operators import privacy as V
from synthspark.operators.constraints import apply_constraints, validate
from synthspark.operators.profile import sdtypes as detect
from synthspark.session import stored
from synthspark.sources.writers import WRITERS
from synthspark.spec import FIDELITY_THRESHOLD, PRIVACY_THRESHOLD, Constraint

STAGES = ("queued", "training", "generating", "validating", "complete")


def _mixture(df: DataFrame, kinds: dict[str, str], **options: Any):
    names = [c for c, k in kinds.items() if k in ("categorical", "boolean")]
    if not names:
        raise ValueError("the mixture generator needs a category column")
    return mixture_fit(df, options.pop("stratum", names[0]), kinds, **options)


GENERATORS: dict[str, Callable[..., Any]] = {
    "gaussian_copula": lambda df, kinds, **o: copula_fit(df, kinds, **{"distribution": "empirical", **o}),
    "ctgan": _mixture,
    "tvae": lambda df, kinds, **o: latent_fit(df, sdtypes=kinds, **o),
}


@dataclass
class RunConfig:
    """What one generation job does."""

    generator: str = "gaussian_copula"
    num_rows: int = 1000
    constraints: list[Constraint] = field(default_factory=list)
    conditions: dict[str, Any] | None = None
    sdtypes: dict[str, str] | None = None
    output: str | None = None
    output_format: str = "parquet"
    min_fidelity: float = FIDELITY_THRESHOLD
    min_privacy: float = PRIVACY_THRESHOLD
    seed: int = 0
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class RunResult:
    status: str
    stages: list[str]
    synthetic: DataFrame
    scores: DataFrame
    violations: list[str]
    output: str | None


def run_job(real: DataFrame, config: RunConfig, control: DataFrame | None = None) -> RunResult:
    """Analyse, fit, sample, repair, score, gate and export; scores stay available when the gate fails.

    The sampled table is written once to the shared folder and read by every later step.
    """
    stages = ["queued", "training"]
    kinds = config.sdtypes or detect(real)
    model = GENERATORS[config.generator](real, kinds, **config.options)
    stages.append("generating")
    sampled = model.sample(config.num_rows, config.conditions, seed=config.seed)
    synthetic = stored(sampled, "generated")
    stages.append("validating")
    if config.constraints:
        synthetic = apply_constraints(synthetic, config.constraints, seed=config.seed)
    left = validate(synthetic, config.constraints) if config.constraints else []
    scores = score_tables(real, synthetic, kinds, control)
    # Scored once: the row is kept, and the gate and every later reader look at it there.
    gated = stored(V.quality_gate(scores, config.min_fidelity, config.min_privacy), "scores")
    passed = gated.first()["passed"]
    stages.append("complete" if passed else "failed")
    output = None
    if passed and config.output:
        output = config.output
        WRITERS[config.output_format](synthetic, output)
    return RunResult(stages[-1], stages, synthetic, gated, left, output)


def score_tables(real: DataFrame, synthetic: DataFrame, kinds: dict[str, str], control: DataFrame | None = None) -> DataFrame:
    """``(fidelity_score, privacy_score)``. Without a control table no part of an attack counts as chance."""
    judged = {c: k for c, k in kinds.items() if k in ("numerical", "categorical", "boolean")}
    names = list(judged)
    a, b = real.select(*names), synthetic.select(*names)
    report = Q.quality_report(a, b, judged)
    outside = b.limit(0) if control is None else control.select(*names)
    risks = [V.singling_out_univariate(a, b, outside, names)]
    if len(names) > 1:
        risks.append(V.singling_out_multivariate(a, b, outside, names, bins=10))
    return C.side_by_side([report.select(F.col("overall_score").alias("fidelity_score")), V.privacy_score(risks)])


def benchmark_grid(
    tables: dict[str, DataFrame], generators: list[str], sdtypes: dict[str, dict[str, str]] | None = None, seed: int = 0
) -> DataFrame:
    """``(dataset, generator, ks_complement, tv_complement, bn_log_likelihood, duration_s, error)``.

    One row per table and generator; an error becomes a row. Scores are rows of aggregates.
    """
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        kinds = (sdtypes or {}).get(name) or detect(df)
        for generator in generators:
            start = time.monotonic()
            try:
                scores = _grid_scores(df, kinds, generator, seed)
                out.append((name, generator, *scores, time.monotonic() - start, None))
            except Exception as exc:  # noqa: BLE001 - the grid reports failures as rows
                out.append((name, generator, None, None, None, time.monotonic() - start, str(exc)[:500]))
    return spark.createDataFrame(
        out,
        "dataset string, generator string, ks_complement double, tv_complement double, bn_log_likelihood double, duration_s double, error string",
    )


def _grid_scores(df: DataFrame, kinds: dict[str, str], generator: str, seed: int) -> tuple:
    if generator not in GENERATORS:
        raise ValueError(f"unknown generator '{generator}'")
    synthetic = stored(GENERATORS[generator](df, kinds).sample(df.count(), seed=seed), "grid")
    numbers = [c for c, k in kinds.items() if k == "numerical"]
    groups = [c for c, k in kinds.items() if k in ("categorical", "boolean")]
    parts = []
    if numbers:
        parts.append(Q.ks_complement(df, synthetic, numbers))
    if groups:
        parts.append(Q.tv_complement(df, synthetic, groups))
    means = {r["metric"]: r["s"] for r in C.union_all(parts).groupBy("metric").agg(F.avg("score").alias("s")).collect()} if parts else {}
    fit = Q.bn_log_likelihood(df, synthetic, groups).first()["log_likelihood"] if len(groups) > 1 else None
    return means.get("KSComplement"), means.get("TVComplement"), fit


__all__ = ["GENERATORS", "RunConfig", "RunResult", "benchmark_grid", "run_job", "score_tables"]
