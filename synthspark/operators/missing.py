"""Missing values: patterns, imputation and its quality."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.distribution import medians, modes
from synthspark.operators.neighbours import nearest
from synthspark.session import cut_lineage

STRATEGIES = ("mean", "median", "mode", "constant", "knn", "mice")
MAR_CORRELATION = 0.3


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, missing rate and the number of affected columns."""
    counts = [F.count_if(C.quoted(c).isNull()) for c in df.columns]
    wide = df.agg(F.count("*").alias("total_rows"), *[n.alias(f"m{i}") for i, n in enumerate(counts)])
    total = sum(F.col(f"m{i}") for i in range(len(counts)))
    cells = F.col("total_rows") * len(df.columns)
    return wide.select(
        "total_rows",
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        total.alias("total_missing"),
        F.round(F.when(cells > 0, total / cells).otherwise(0.0), 4).alias("missing_rate"),
        sum((F.col(f"m{i}") > 0).cast("long") for i in range(len(counts))).alias("affected_columns"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns that hold nulls: count, rate, type and whether they count as numeric (booleans do)."""
    numeric = set(C.numeric_columns(df, with_boolean=True))
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(C.quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col(f"m{i}").alias("missing_count"),
            F.round(F.col(f"m{i}") / F.col("_n"), 4).alias("missing_rate"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(f.name in numeric).alias("is_numeric"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return wide.select(F.inline(F.array(*rows))).filter("missing_count > 0")


def missing_mechanism(df: DataFrame) -> DataFrame:
    """``(column, max_correlation, mechanism)``.

    MAR when some other median-filled number column correlates above 0.3 with the null indicator, else
    MCAR. All pairs come from one aggregate.
    """
    numbers = C.numeric_columns(df, with_boolean=True)
    holes = [c for c, n in null_counts(df).items() if n]
    if not holes:
        return df.sparkSession.createDataFrame([], "column string, max_correlation double, mechanism string")
    centre = medians(df.select(*[C.quoted(c).cast("double").alias(c) for c in numbers]), numbers)
    filled = {c: F.coalesce(C.quoted(c).cast("double"), F.lit(centre[c])) for c in numbers}
    gone = {c: C.quoted(c).isNull().cast("double") for c in holes}
    strongest = []
    for i, c in enumerate(holes):
        others = [F.abs(F.coalesce(C.correlation(filled[o], gone[c]), F.lit(0.0))) for o in numbers if o != c]
        strongest.append(F.greatest(F.lit(0.0), F.lit(0.0), *others).alias(f"r{i}"))
    long = C.one_row_to_long(df.agg(*strongest), holes, {"r": "r"})
    return long.select(
        "column",
        F.round("r", 4).alias("max_correlation"),
        F.when(F.col("r") > MAR_CORRELATION, "MAR").otherwise("MCAR").alias("mechanism"),
    )


def _fills(df: DataFrame, wanted: dict[str, str], constants: dict[str, Any], fill_value: Any) -> dict[str, Any]:
    """One fill scalar per column for the column-wise strategies; at most one job per statistic."""
    numeric = set(C.numeric_columns(df, with_boolean=True))
    effective = {}
    for c, s in wanted.items():
        if s in ("knn", "mice"):
            s = "mean"
        effective[c] = "mode" if s in ("mean", "median") and c not in numeric else s
    fills: dict[str, Any] = {}
    means = [c for c, s in effective.items() if s == "mean"]
    if means:
        row = df.agg(*[F.avg(C.quoted(c).cast("double")).alias(f"a{i}") for i, c in enumerate(means)]).first()
        fills.update({c: row[f"a{i}"] for i, c in enumerate(means)})
    middle = [c for c, s in effective.items() if s == "median"]
    if middle:
        fills.update(medians(df.select(*[C.quoted(c).cast("double").alias(c) for c in middle]), middle))
    commonest = [c for c, s in effective.items() if s == "mode"]
    if commonest:
        found = {r["column"]: (r["txt"] if r["txt"] is not None else r["num"]) for r in modes(df, commonest).collect()}
        fills.update({c: found.get(c) for c in commonest})
    for c, s in effective.items():
        if s == "constant":
            fills[c] = fill_value if fill_value is not None else constants.get(c, 0)
    return fills


def _filled(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    """Nulls replaced; an integer column that gets a fraction turns into double."""
    out = []
    for f in df.schema.fields:
        c = C.quoted(f.name)
        value = fills.get(f.name)
        if value is None:
            out.append(c)
        elif isinstance(value, float) and not value.is_integer() and not C.is_float(f.dataType):
            out.append(F.coalesce(c.cast("double"), F.lit(value)).alias(f.name))
        elif isinstance(value, float) and C.is_integer(f.dataType):
            out.append(F.coalesce(c, F.lit(int(value)).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(value).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.count_if(C.quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def impute_column(
    df: DataFrame, column: str, strategy: str = "mean", fill_value: Any = None, constants: dict[str, Any] | None = None
) -> DataFrame:
    """Fill one column; ``knn`` and ``mice`` need the whole table and act as mean or mode here."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' is missing from the table")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}'")
    return _filled(df, _fills(df, {column: strategy}, constants or {}, fill_value))


def impute_columnwise(
    df: DataFrame,
    default: str = "mean",
    strategies: dict[str, str] | None = None,
    constants: dict[str, Any] | None = None,
    sdtypes: dict[str, str] | None = None,
) -> DataFrame:
    """Each column by its own strategy, else the default for numbers and the mode for the rest."""
    numeric = set(C.numeric_columns(df, with_boolean=True))
    numeric |= {c for c, t in (sdtypes or {}).items() if t in ("numerical", "float", "integer")}
    wanted = {}
    for c, missing in null_counts(df).items():
        if missing:
            wanted[c] = (strategies or {}).get(c) or (default if c in numeric else "mode")
    return _filled(df, _fills(df, wanted, constants or {}, None)) if wanted else df


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _impute_all(df, "mean", columns)


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _impute_all(df, "median", columns)


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _impute_all(df, "mode", columns)


def impute_constant(df: DataFrame, values: dict[str, Any], fill_value: Any = None) -> DataFrame:
    return _filled(df, _fills(df, {c: "constant" for c in df.columns}, values, fill_value))


def _impute_all(df: DataFrame, strategy: str, columns: list[str] | None) -> DataFrame:
    wanted = columns or [c for c, n in null_counts(df).items() if n]
    return _filled(df, _fills(df, {c: strategy for c in wanted}, {}, None)) if wanted else df


def impute_knn(df: DataFrame, row_id: str, features: list[str] | None = None, k: int = 5) -> DataFrame:
    """Number columns: mean of the ``k`` nearest rows that hold a value; other columns: mode.

    The distance skips coordinates that either row lacks and scales the rest up to all coordinates. Ties go
    to the lower row id. A row without any comparable neighbour gets the column mean.
    """
    features = features or [c for c in C.numeric_columns(df) if c != row_id]
    counts = null_counts(df)
    holes = [c for c in features if counts[c]]
    complete = [c for c in features if not counts[c]]
    partial = sorted(holes, key=lambda c: counts[c])
    out = df
    means = _fills(df, {c: "mean" for c in holes}, {}, None)
    for target in holes:
        others = [c for c in features if c != target]
        # Equal receivers share one search, so a hot vector costs as much as a rare one.
        receivers = df.filter(C.quoted(target).isNull()).groupBy(*[C.quoted(c) for c in others]).agg(F.min(row_id).alias(row_id))
        donors = df.filter(C.quoted(target).isNotNull()).select(row_id, *features)
        pairs = nearest(
            receivers, donors, row_id, k, complete=complete, partial=[c for c in partial if c != target],
            payload=[target], distance=_nan_euclidean(features, target),
        )
        mean = pairs.groupBy("query_id").agg(F.avg(target).alias("_est"))
        by_vector = receivers.join(mean, receivers[row_id] == mean["query_id"]).select(
            F.col("_est"), *[C.quoted(c).alias(f"_v{i}") for i, c in enumerate(others)]
        )
        same = df[target].isNull()
        for i, c in enumerate(others):
            same = same & df[c].eqNullSafe(by_vector[f"_v{i}"])
        estimate = df.join(by_vector, same).select(row_id, "_est")
        out = out.join(estimate, row_id, "left").withColumn(
            target, F.coalesce(C.quoted(target).cast("double"), F.col("_est"), F.lit(means[target]))
        ).drop("_est")
    rest = [c for c in df.columns if c not in features and counts[c] and c != row_id]
    return impute_mode(out.select(*df.columns), rest) if rest else out.select(*df.columns)


def _nan_euclidean(features: list[str], target: str):
    """Squared distance over shared coordinates, scaled by all coordinates over shared ones.

    The target itself is missing in every receiver, so it counts among all coordinates only.
    """
    others = [c for c in features if c != target]

    def squared(query: str, donor: str) -> Column:
        both = [F.col(f"{query}.{c}").isNotNull() & F.col(f"{donor}.{c}").isNotNull() for c in others]
        terms = [
            F.when(b, F.pow(F.col(f"{query}.{c}").cast("double") - F.col(f"{donor}.{c}").cast("double"), 2)).otherwise(0.0)
            for b, c in zip(both, others)
        ]
        present = sum(b.cast("double") for b in both)
        return F.when(present > 0, sum(terms) * float(len(features)) / present)

    return squared


# Most moments of all missing patterns together that come to the driver.
MOMENT_CELLS = 4_000_000


def impute_mice(
    df: DataFrame, features: list[str] | None = None, max_iter: int = 10, max_patterns: int = 4096
) -> DataFrame:
    """Chained regressions from sufficient statistics: one scan to fit, one projection to fill.

    Every regression is linear and starts from column means, so the current fill of a row is an affine
    function of its observed cells that depends only on which cells are missing. Moments per missing
    pattern therefore carry the whole iteration, and no round touches the rows again. Tables with more than
    ``max_patterns`` patterns, or more than ``MOMENT_CELLS`` moments over all of them, go through rounds over the rows
    instead.
    """
    features = features or C.numeric_columns(df)
    counts = null_counts(df)
    holes = sorted([c for c in features if counts[c]], key=lambda c: counts[c])
    if not holes:
        return impute_columnwise(df)
    d = len(features)
    pattern = F.concat(*[F.when(C.quoted(c).isNull(), "1").otherwise("0") for c in holes])
    row = df.agg(
        *[F.avg(C.quoted(c).cast("double")).alias(f"a{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(C.quoted(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    centre = np.array([row[f"a{i}"] for i in range(d)], dtype=float)
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(d)], dtype=float)
    # Standardised cells keep the moments well conditioned; missing cells count as 0.
    cell = [
        F.coalesce((C.quoted(c).cast("double") - float(centre[i])) / float(scale[i]), F.lit(0.0)) for i, c in enumerate(features)
    ]
    grouped = df.groupBy(pattern.alias("pattern"))
    most = min(max_patterns, max(1, MOMENT_CELLS // (d * d)))
    n_patterns = 2 ** len(holes) if 2 ** len(holes) <= most else grouped.count().count()
    if n_patterns > most:
        filled = _mice_by_rounds(df, features, holes, centre, scale, max_iter)
        rest = [c for c in df.columns if c not in features and counts[c]]
        return impute_mode(filled, rest) if rest else filled
    moments = grouped.agg(
        F.count("*").alias("n"),
        *[F.sum(cell[i]).alias(f"s{i}") for i in range(d)],
        *[F.sum(cell[i] * cell[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)],
    ).collect()
    fills = _chained_regressions(moments, features, holes, centre, scale, max_iter)
    # One row of weights per missing pattern; `max_patterns` bounds what is broadcast.
    table = df.sparkSession.createDataFrame(
        [(p, *[[float(x) for x in rows[j]] if j in rows else None for j in map(features.index, holes)]) for p, rows in fills.items()],
        "_pattern string, " + ", ".join(f"_w{b} array<double>" for b in range(len(holes))),
    )
    keyed = df.withColumn("_pattern", pattern).join(F.broadcast(table), "_pattern", "left")
    out = []
    for c in df.columns:
        if c not in holes:
            out.append(C.quoted(c))
            continue
        j, weights = features.index(c), F.col(f"_w{holes.index(c)}")
        guess = weights[0]
        for i in range(d):
            guess = guess + weights[i + 1] * cell[i]
        out.append(F.coalesce(C.quoted(c).cast("double"), guess * float(scale[j]) + float(centre[j])).alias(c))
    filled = keyed.select(*out)
    rest = [c for c in df.columns if c not in features and counts[c]]
    return impute_mode(filled, rest) if rest else filled


def _mice_by_rounds(df: DataFrame, features: list[str], holes: list[str], centre, scale, max_iter: int) -> DataFrame:
    """The same regressions for tables with too many patterns: rows carry their fills, one checkpoint a round."""
    d = len(features)
    cells = [f"_z{i}" for i in range(d)]
    work = df.select(
        "*",
        *[
            F.coalesce((C.quoted(c).cast("double") - float(centre[i])) / float(scale[i]), F.lit(0.0)).alias(cells[i])
            for i, c in enumerate(features)
        ],
    )
    for _ in range(max_iter):
        for c in holes:
            j = features.index(c)
            seen = work.filter(C.quoted(c).isNotNull())
            row = seen.agg(
                F.count("*").alias("n"),
                *[F.sum(cells[i]).alias(f"s{i}") for i in range(d)],
                *[F.sum(F.col(cells[a]) * F.col(cells[b])).alias(f"g{a}_{b}") for a in range(d) for b in range(a, d)],
            ).first()
            full = np.zeros((d + 1, d + 1))
            full[0, 0] = row["n"]
            for a in range(d):
                full[0, a + 1] = full[a + 1, 0] = row[f"s{a}"]
                for b in range(a, d):
                    full[a + 1, b + 1] = full[b + 1, a + 1] = row[f"g{a}_{b}"]
            xs = [0] + [i + 1 for i in range(d) if i != j]
            beta = bayesian_ridge(full[np.ix_(xs, xs)], full[xs, j + 1], full[j + 1, j + 1])
            guess = F.lit(float(beta[0]))
            for weight, i in zip(beta[1:], [i for i in range(d) if i != j]):
                guess = guess + float(weight) * F.col(cells[i])
            work = work.withColumn(cells[j], F.when(C.quoted(c).isNull(), guess).otherwise(F.col(cells[j])))
        work = cut_lineage(work)
    return work.select(
        *[
            F.coalesce(C.quoted(c).cast("double"), F.col(cells[features.index(c)]) * float(scale[features.index(c)]) + float(centre[features.index(c)])).alias(c)
            if c in holes
            else C.quoted(c)
            for c in df.columns
        ]
    )


def _chained_regressions(moments, features, holes, centre, scale, max_iter):
    """Affine fills per pattern: ``{pattern: {column: weights over (1, cells)}}``."""
    d = len(features)
    hole_ix = [features.index(c) for c in holes]
    gram, affine, lost = {}, {}, {}
    for m in moments:
        p = m["pattern"]
        g = np.zeros((d + 1, d + 1))
        g[0, 0] = m["n"]
        for i in range(d):
            g[0, i + 1] = g[i + 1, 0] = m[f"s{i}"]
            for j in range(i, d):
                g[i + 1, j + 1] = g[j + 1, i + 1] = m[f"g{i}_{j}"]
        gram[p] = g
        # Row i + 1 of the map gives the current value of column i; missing ones start at the mean, 0 here.
        a = np.eye(d + 1)
        lost[p] = [j for b, j in enumerate(hole_ix) if p[b] == "1"]
        for j in lost[p]:
            a[j + 1] = 0.0
        affine[p] = a
    for _ in range(max_iter):
        for j in hole_ix:
            seen = sum((affine[p] @ gram[p] @ affine[p].T for p in gram if j not in lost[p]), np.zeros((d + 1, d + 1)))
            xs = [0] + [i + 1 for i in range(d) if i != j]
            beta = bayesian_ridge(seen[np.ix_(xs, xs)], seen[xs, j + 1], seen[j + 1, j + 1])
            for p in gram:
                if j in lost[p]:
                    affine[p][j + 1] = beta @ affine[p][xs]
    return {p: {j: affine[p][j + 1] for j in lost[p]} for p in gram}


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, max_iter: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Intercept and weights by evidence maximisation on centred moments; row 0 of ``gram`` is the constant."""
    n = gram[0, 0]
    mean_x, mean_y = gram[0, 1:] / n, xy[0] / n
    xtx = gram[1:, 1:] - n * np.outer(mean_x, mean_x)
    xty = xy[1:] - n * mean_x * mean_y
    rest = max(yy - n * mean_y**2, 0.0)
    values, vectors = np.linalg.eigh(xtx)
    values = np.clip(values, 0.0, None)
    rotated = vectors.T @ xty
    alpha, lam = 1.0 / (rest / n + 1e-12), 1.0
    weights = np.zeros(len(values))
    for _ in range(max_iter):
        new = vectors @ (rotated / (values + lam / alpha))
        sse = max(rest - 2 * new @ xty + new @ xtx @ new, 0.0)
        used = np.sum(alpha * values / (lam + alpha * values))
        lam = (used + 2e-6) / (new @ new + 2e-6)
        alpha = (n - used + 2e-6) / (sse + 2e-6)
        done = np.sum(np.abs(weights - new)) < tol
        weights = new
        if done:
            break
    return np.concatenate([[mean_y - weights @ mean_x], weights])


def impute(df: DataFrame, strategy: str = "mean", row_id: str | None = None, **options: Any) -> DataFrame:
    """Whole-table imputation; a table without nulls comes back unchanged."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}'")
    if not any(null_counts(df).values()):
        return df
    if strategy == "knn":
        return impute_knn(df, row_id, **options)
    if strategy == "mice":
        return impute_mice(df, [c for c in C.numeric_columns(df) if c != row_id], **options)
    return impute_columnwise(df, strategy, **options)


def imputation_quality(original: DataFrame, imputed: DataFrame, row_id: str) -> DataFrame:
    """Per column with nulls: count, fill rate and how far the imputed mean is from the observed one."""
    names = [c for c in original.columns if c != row_id]
    numeric = set(C.numeric_columns(original, with_boolean=True))
    joined = original.alias("o").join(imputed.alias("i"), row_id)
    aggs = []
    for k, c in enumerate(names):
        old, new = F.col(f"o.`{c}`"), F.col(f"i.`{c}`")
        as_number = (lambda x: x.cast("double")) if c in numeric else (lambda x: F.lit(None).cast("double"))
        aggs += [
            F.count_if(old.isNull()).alias(f"n{k}"),
            F.count_if(old.isNull() & new.isNotNull()).alias(f"f{k}"),
            F.avg(as_number(old)).alias(f"a{k}"),
            F.avg(F.when(old.isNull(), as_number(new))).alias(f"b{k}"),
        ]
    long = C.one_row_to_long(joined.agg(*aggs), names, {"null_count": "n", "filled": "f", "a": "a", "b": "b"})
    b = F.when(F.col("a").isNotNull(), F.coalesce("b", F.lit(0.0)))
    return long.filter("null_count > 0").select(
        "column",
        "null_count",
        F.round(F.col("filled") / F.col("null_count"), 4).alias("fill_rate"),
        F.round("a", 4).alias("original_mean"),
        F.round(b, 4).alias("imputed_mean"),
        F.round(F.abs(F.col("a") - b) / (F.abs("a") + 1e-10), 4).alias("mean_deviation"),
    )


def imputation_summary(quality: DataFrame) -> DataFrame:
    """``(columns_imputed, mean_fill_rate)``; the rate is 1 when no column had nulls."""
    return quality.agg(
        F.count("*").alias("columns_imputed"), F.round(F.coalesce(F.avg("fill_rate"), F.lit(1.0)), 4).alias("mean_fill_rate")
    )
