"""A whole copula from a stream: mergeable quantile sketches, category counts and joint cells per micro-batch.

Each micro-batch leaves one row of sketches, its category counts and, for each pair of modelled columns, counts over cells
that lie between quantiles of the batch, with the mean values of each cell. Nothing is kept in memory between batches. On
read the sketches and counts are merged into column models; the mean values of the cells become normal scores under these
merged models, so their correlation does not depend on how rows were dealt to batches, but for the width of a cell.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.rng import with_normals
from synthspark.generators import marginals as M
from synthspark.generators.copula import CopulaModel, positive_correlation
from synthspark.session import stored
from synthspark.streaming.jobs import _folder, _per_batch

# Size of a sketch: a rank is off by about 0.3 % at most, in 99 of 100 cases.
SKETCH = 1000
# Cells of a number column in a batch.
CELLS = 32


def _roles(df: DataFrame, kinds: dict[str, str]) -> dict[str, str]:
    missing = [c for c in df.columns if c not in kinds]
    if missing:
        raise ValueError(f"a stream cannot be read twice, so the types of {missing} must be given")
    return {c: M._role(df, c, kinds[c]) for c in df.columns}


def _measure(df: DataFrame, name: str, role: str) -> Column:
    x = C.as_double(df, name) if role == "number" else F.length(C.quoted(name)).cast("double")
    return F.when(~F.isnan(x), x)


def _decimal_flags(df: DataFrame, name: str, x: Column, i: int) -> list[Column]:
    if not C.is_float(df.schema[name].dataType):
        return []
    whole = [F.abs(x * 10**d - F.rint(x * 10**d)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x)) for d in range(M.DECIMALS + 1)]
    return [F.bool_and(w).alias(f"d{i}_{d}") for d, w in enumerate(whole)]


def _cell(x: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(C.doubles(cuts), lambda cut: cut <= x))


def _write_batch(batch: DataFrame, roles: dict[str, str], folder) -> None:
    names, spark = list(roles), batch.sparkSession
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        aggs.append(F.count(C.quoted(c)).alias(f"c{i}"))
        if roles[c] in ("number", "text"):
            x = _measure(batch, c, roles[c])
            aggs += [F.kll_sketch_agg_double(x, SKETCH).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            aggs += _decimal_flags(batch, c, x, i)
    batch.agg(*aggs).write.mode("overwrite").parquet(folder("sketches"))

    groups = [(i, c) for i, c in enumerate(names) if roles[c] == "category"]
    if groups:
        values = F.array(*[F.struct(F.lit(i).alias("i"), C.as_text(batch, c).alias("value")) for i, c in groups])
        counts = batch.select(F.inline(values)).where("value is not null").groupBy("i", "value").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(folder("categories"))

    modelled = [(i, c) for i, c in enumerate(names) if roles[c] in ("number", "category")]
    numbers = [i for i, c in modelled if roles[c] == "number"]
    if len(modelled) < 2:
        return
    cuts: dict[int, list[float]] = {i: [] for i in numbers}
    if numbers:
        inner = C.doubles(k / CELLS for k in range(1, CELLS))
        known = spark.read.parquet(folder("sketches"))
        got = known.select(*[F.when(F.col(f"lo{i}").isNotNull(), F.kll_sketch_get_quantile_double(f"s{i}", inner)).alias(f"q{i}") for i in numbers]).first()
        cuts = {i: sorted(set(got[f"q{i}"] or [])) for i in numbers}
    cells = []
    for i, c in modelled:
        x = _measure(batch, c, "number") if i in numbers else F.lit(None).cast("double")
        inside = _cell(x, cuts[i]) if i in numbers and cuts[i] else F.lit(0)
        cell = F.when(x.isNotNull(), inside.cast("string")) if i in numbers else C.as_text(batch, c)
        cells += [cell.alias(f"k{i}"), x.alias(f"x{i}")]
    coded = batch.select(*cells)
    pairs = [
        F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ib"), *[F.col(f"{v}{k}").alias(f"{v}{s}") for k, s in ((i, "a"), (j, "b")) for v in "kx"])
        for (i, _), (j, _) in itertools.combinations(modelled, 2)
    ]
    joint = coded.select(F.inline(F.array(*pairs))).where("ka is not null and kb is not null").groupBy("ia", "ib", "ka", "kb")
    joint.agg(F.count("*").alias("n"), F.avg("xa").alias("xa"), F.avg("xb").alias("xb")).write.mode("overwrite").parquet(folder("pairs"))


def _merged_marginals(stream: DataFrame, roles: dict[str, str], root: str) -> list[M.Marginal]:
    spark, names = stream.sparkSession, list(roles)
    parts = spark.read.parquet(_folder(root, "sketches"))
    ranks = C.doubles(k / M.KNOTS for k in range(M.KNOTS + 1))
    aggs = [F.sum("n").alias("n")]
    for i, c in enumerate(names):
        aggs.append(F.sum(f"c{i}").alias(f"c{i}"))
        if roles[c] in ("number", "text"):
            sketch = F.kll_merge_agg_double(F.when(F.col(f"lo{i}").isNotNull(), F.col(f"s{i}")))
            aggs += [sketch.alias(f"s{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
            aggs += [F.bool_and(d).alias(d) for d in parts.columns if d.startswith(f"d{i}_")]
    merged = parts.agg(*aggs)
    for i, c in enumerate(names):
        if roles[c] in ("number", "text"):
            merged = merged.withColumn(f"s{i}", F.when(F.col(f"lo{i}").isNotNull(), F.kll_sketch_get_quantile_double(f"s{i}", ranks)))
    row = merged.first().asDict()
    shares = _merged_categories(spark, [i for i, c in enumerate(names) if roles[c] == "category"], root)
    out = []
    for i, c in enumerate(names):
        dtype, role = stream.schema[c].dataType, roles[c]
        gone = 1.0 - row[f"c{i}"] / row["n"] if row["n"] else 0.0
        if role == "category":
            listed, cumulative, table = shares[i]
            weak = M._table_attenuation(table) if table is not None else 1.0
            out.append(M.Marginal(c, "category", dtype, gone, categories=listed, shares=cumulative, table=table, table_attenuation=weak))
        elif role == "id":
            out.append(M.Marginal(c, "id", dtype, gone))
        elif row[f"lo{i}"] is None:
            empty = (0.0, 0.0) if role == "number" else (1.0, 1.0)
            out.append(M.Marginal(c, role, dtype, 1.0, empty))
        else:
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            grid = (low, *[float(min(high, max(low, q))) for q in row[f"s{i}"][1:-1]], high)
            decimals = next((d for d in range(M.DECIMALS + 1) if row.get(f"d{i}_{d}")), None)
            out.append(M.Marginal(c, role, dtype, gone, grid, low, high, decimals if role == "number" else None))
    return out


def _merged_categories(spark, columns: list[int], root: str) -> dict:
    if not columns:
        return {}
    counts = spark.read.parquet(_folder(root, "categories")).groupBy("i", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("i").orderBy(F.col("n").desc(), F.col("value"))
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= M.LITERAL_CATEGORIES + 1).orderBy("i", "r").collect()
    out = {}
    for i in columns:
        found = [(r["value"], r["n"]) for r in top if r["i"] == i]
        if len(found) > M.LITERAL_CATEGORIES:
            table = M.category_table(counts.where(F.col("i") == i).select("value", "n"), ordered=True)
            out[i] = ((), (), stored(table, "categories"))
        else:
            total = max(sum(n for _, n in found), 1)
            cumulative = tuple(float(s) / total for s in itertools.accumulate(n for _, n in found))
            out[i] = (tuple(v for v, _ in found) or ("",), cumulative or (1.0,), None)
    return out


def _merged_correlation(spark, marginals: list[M.Marginal], root: str) -> np.ndarray:
    """Correlation of the scores of all joint cells, weighted by their counts."""
    modelled = [i for i, m in enumerate(marginals) if m.modelled]
    matrix = np.eye(len(modelled))
    if len(modelled) < 2:
        return matrix
    cells = spark.read.parquet(_folder(root, "pairs"))
    for side in "ab":
        # Positions of long category lists come by a join, all others from tables in the plan.
        place = F.lit(None).cast("double")
        for i in modelled:
            m = marginals[i]
            if m.table is not None:
                first = F.col("bucket") == F.floor(F.col("low") * F.col("buckets"))
                middles = m.table.where(first).select(F.lit(i).alias(f"i{side}"), F.col("value").alias(f"k{side}"), ((F.col("low") + F.col("high")) / 2).alias(f"_t{i}{side}"))
                cells = cells.join(middles, [f"i{side}", f"k{side}"], "left")
                unit = F.col(f"_t{i}{side}")
            elif m.kind == "number":
                unit = M._interpolate(F.col(f"x{side}"), *M._knots(m.grid))
            else:
                unit = M._category_unit(F.col(f"k{side}"), m.categories, m.shares)
            place = F.when(F.col(f"i{side}") == i, F.least(F.lit(1 - M.EDGE), F.greatest(F.lit(M.EDGE), unit))).otherwise(place)
        cells = cells.withColumn(f"_u{side}", place)
    cells = with_normals(cells.select("ia", "ib", "n", "_ua", "_ub"), {"_ua": "sa", "_ub": "sb"}, once=True)
    mean = lambda value: (F.sum(F.col("n") * value) / F.sum("n"))
    a, b = F.col("sa"), F.col("sb")
    sums = cells.groupBy("ia", "ib").agg(*[mean(v).alias(name) for name, v in {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}.items()])
    weak = [m.attenuation() for m in marginals]
    for r in sums.collect():
        spread = math.sqrt(max(r["aa"] - r["a"] ** 2, 0.0) * max(r["bb"] - r["b"] ** 2, 0.0))
        if spread > 1e-12:
            value = (r["ab"] - r["a"] * r["b"]) / spread / (weak[r["ia"]] * weak[r["ib"]])
            i, j = modelled.index(r["ia"]), modelled.index(r["ib"])
            matrix[i, j] = matrix[j, i] = min(0.999, max(-0.999, value))
    return positive_correlation(matrix)


def stream_fit_copula(stream: DataFrame, sdtypes: dict[str, str], root: str) -> CopulaModel:
    """Copula of all rows a stream has brought so far; called again with the same folder it goes on where it stopped.

    Nulls count in the share of nulls only; a pair of columns counts rows that have both. Number columns are modelled
    by quantiles of the merged sketch with exact ends; merging draws random bits, so two calls may differ by the rank
    error. A stream that never brought a row has no model.
    """
    roles = _roles(stream, sdtypes)
    _per_batch(stream, root, "copula", lambda batch, folder: _write_batch(batch, roles, folder))
    marginals = _merged_marginals(stream, roles, root)
    return CopulaModel(stream.sparkSession, marginals, _merged_correlation(stream.sparkSession, marginals, root))
