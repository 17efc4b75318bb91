"""Structured Streaming forms of profiling, validation, uniqueness, fitting and generation.

Every job reads with ``availableNow`` and keeps its progress in a checkpoint, so a restarted job goes on where
it stopped. Batch writers put each micro-batch in a folder of its own and overwrite it on a retry.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from synthspark.functions import columns as C
from synthspark.generators.copula import ROW, CopulaModel
from synthspark.operators.constraints import ROW_RULES, row_violation
from synthspark.spec import Constraint


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _folder(root: str, name: str) -> str:
    return os.path.join(root, name)


def _per_batch(stream: DataFrame, root: str, label: str, write) -> None:
    """Run ``write(batch, folder)`` once per micro-batch; ``folder`` belongs to that batch alone."""

    def sink(batch: DataFrame, number: int) -> None:
        write(batch, lambda part: os.path.join(root, part, f"batch={number}"))

    run_available(stream.writeStream.foreachBatch(sink).option("checkpointLocation", _folder(root, f"_progress_{label}")))


# --- fitting -----------------------------------------------------------------------------------------------


def moment_columns(names: list[str]) -> list[Column]:
    """Mergeable sufficient statistics of number columns: counts, means, centred products, extremes.

    Products are centred at the means of their own rows, so that neither small nor large values lose digits.
    """
    out = [F.count("*").alias("n")]
    for i, a in enumerate(names):
        x = C.quoted(a).cast("double")
        out += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        for j, b in enumerate(names[i:], i):
            y = C.quoted(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            out += [F.count_if(both).alias(f"k{i}_{j}"), F.avg(F.when(both, x)).alias(f"a{i}_{j}"), F.avg(F.when(both, y)).alias(f"b{i}_{j}")]
            out.append((F.covar_pop(x, y) * F.count_if(both)).alias(f"g{i}_{j}"))
    return out


def merge_moments(parts: DataFrame, names: list[str]) -> DataFrame:
    """One row from many partial rows: means by their counts, products moved to the common means."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    mean = lambda value, count: F.sum(F.col(value) * F.col(count)) / F.nullif(F.sum(count), F.lit(0))
    centres = parts.agg(*[mean(f"{side}{i}_{j}", f"k{i}_{j}").alias(f"{side}{i}_{j}") for i, j in pairs for side in "ab"]).first()
    aggs = [F.sum("n").alias("n")]
    for i in range(d):
        aggs += [F.sum(f"n{i}").alias(f"n{i}"), mean(f"m{i}", f"n{i}").alias(f"m{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
    for i, j in pairs:
        a, b = (F.col(f"{side}{i}_{j}") - F.lit(centres[f"{side}{i}_{j}"]).cast("double") for side in "ab")
        aggs += [F.sum(f"k{i}_{j}").alias(f"k{i}_{j}"), F.sum(F.col(f"g{i}_{j}") + F.col(f"k{i}_{j}") * a * b).alias(f"g{i}_{j}")]
    return parts.agg(*aggs)


def stream_fit(stream: DataFrame, names: list[str], root: str) -> DataFrame:
    """Sufficient statistics of a stream: one small row per micro-batch, merged on read."""
    def write(batch: DataFrame, folder) -> None:
        batch.agg(*moment_columns(names)).write.mode("overwrite").parquet(folder("moments"))

    _per_batch(stream, root, "fit", write)
    return merge_moments(stream.sparkSession.read.parquet(_folder(root, "moments")), names)


def moments_summary(moments: DataFrame, names: list[str]) -> DataFrame:
    """``(column, n, mean, std, min, max)`` from merged statistics."""
    rows = []
    for i, c in enumerate(names):
        n, g = F.col(f"n{i}"), F.col(f"g{i}_{i}")
        var = F.when(n > 1, g / (n - 1))
        rows.append(
            F.struct(
                F.lit(c).alias("column"), n.alias("n"), F.col(f"m{i}").alias("mean"), F.sqrt(var).alias("std"),
                F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            )
        )
    return moments.select(F.inline(F.array(*rows)))


def moments_correlation(moments: DataFrame, names: list[str]) -> np.ndarray:
    """Correlation matrix of the merged statistics on the driver."""
    row = moments.first()
    d = len(names)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = float(row[f"g{i}_{j}"] or 0.0) / max(1, row[f"k{i}_{j}"] or 0)
    scale = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    return cov / np.outer(scale, scale)


# --- profiling ---------------------------------------------------------------------------------------------


def window_profile(df: DataFrame, time: str, value: str, group: str, width: str) -> DataFrame:
    """Rows, nulls and moments per event-time window and group; the same text for batch and stream."""
    x = C.quoted(value)
    return df.groupBy(F.window(time, width).alias("w"), C.quoted(group)).agg(
        F.count("*").alias("rows"),
        F.count_if(x.isNull()).alias("null_count"),
        (F.sum(x.cast("decimal(28,6)")).cast("double") / F.count(x)).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), group, "rows", "null_count", "mean", "min", "max")


def stream_profile(
    stream: DataFrame, time: str, value: str, group: str, root: str, width: str = "1 day", delay: str = "30 days"
) -> DataFrame:
    """Windowed profile of a stream. The watermark bounds the state; the last update of a window counts."""
    profiled = window_profile(stream.withWatermark(time, delay), time, value, group, width)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "profile", f"batch={number}"))

    run_available(
        profiled.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", _folder(root, "_progress_profile"))
    )
    table = stream.sparkSession.read.parquet(_folder(root, "profile"))
    values = [c for c in table.columns if c not in ("window_start", group, "batch")]
    last = table.groupBy("window_start", group).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("window_start", group, "v.*")


# --- validation --------------------------------------------------------------------------------------------


def tagged_violations(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Add ``violated``: positions of the row rules a row breaks, as text."""
    others = [c.constraint_type for c in constraints if c.kind not in ROW_RULES]
    if others:
        raise ValueError(f"rules {others} need the whole table and cannot judge single rows")
    broken = [F.when(row_violation(df, c), F.lit(str(i))) for i, c in enumerate(constraints)]
    return df.withColumn("violated", F.concat_ws(",", *broken))


def stream_validate(stream: DataFrame, constraints: list[Constraint], root: str) -> tuple[DataFrame, DataFrame]:
    """Split a stream into clean rows and violations; both are tables afterwards."""
    tagged = tagged_violations(stream, constraints)

    def write(batch: DataFrame, folder) -> None:
        batch.filter("violated = ''").drop("violated").write.mode("overwrite").parquet(folder("clean"))
        batch.filter("violated <> ''").write.mode("overwrite").parquet(folder("violations"))

    _per_batch(tagged, root, "validate", write)
    spark = stream.sparkSession
    return spark.read.parquet(_folder(root, "clean")).drop("batch"), spark.read.parquet(_folder(root, "violations")).drop("batch")


# --- uniqueness --------------------------------------------------------------------------------------------


def stream_unique(
    stream: DataFrame, columns: list[str], root: str, time: str | None = None, within: str | None = None, unbounded: bool = False
) -> DataFrame:
    """First row per value across micro-batches.

    With a time column the state is bounded by the watermark. Remembering values for ever must be asked for.
    """
    if time and within:
        unique = stream.withWatermark(time, within).dropDuplicatesWithinWatermark(columns)
    elif unbounded:
        unique = stream.dropDuplicates(columns)
    else:
        raise ValueError("give a time column and a period, or ask for unbounded state")
    target = _folder(root, "unique")
    run_available(
        unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(root, "_progress_unique"))
    )
    return stream.sparkSession.read.parquet(target)


# --- generation --------------------------------------------------------------------------------------------


def stream_generate_parts(numbers: DataFrame, column: str, model: CopulaModel, root: str, seed: int = 0) -> DataFrame:
    """Synthetic rows for a stream of row numbers, appended part by part.

    Sampling is a projection of the row number, so the stream keeps no state and equals the batch result.
    """
    rows = numbers.select(C.quoted(column).cast("long").alias(ROW))
    made = model.decode(model.latent(rows, None, seed), None, seed, keep=[ROW])
    target = _folder(root, "parts")
    run_available(
        made.writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(root, "_progress_parts"))
    )
    return numbers.sparkSession.read.parquet(target)
