"""How close a synthetic table is to the real one: column shapes, pair trends, reports and history."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.distribution import running_totals, value_counts
from synthspark.spec import COLUMN_THRESHOLD, FIDELITY_THRESHOLD, HISTORY_LENGTH

SIDES = ["n_real", "n_syn"]


def paired_counts(real: DataFrame, synthetic: DataFrame, names: list[str]) -> DataFrame:
    """``(column, num, txt, n_real, n_syn)``: value counts of both tables in one shuffle."""
    common = []
    for df, flag in ((real, True), (synthetic, False)):
        common.append(df.select(*[C.quoted(c).cast(real.schema[c].dataType).alias(c) for c in names], F.lit(flag).alias("_real")))
    both = common[0].unionByName(common[1])
    return value_counts(both, names, {"n_real": F.col("_real"), "n_syn": ~F.col("_real")})


def _cells(real: DataFrame, synthetic: DataFrame, names: list[str]) -> int:
    """Bound of the number of value counts; row counts come from file footers."""
    return (real.count() + synthetic.count()) * len(names)


def _sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(F.sum("n_real").alias("real_total"), F.sum("n_syn").alias("syn_total"))


def _by_number(counts: DataFrame) -> DataFrame:
    return counts.filter("num is not null").groupBy("column", "num").agg(*[F.sum(s).alias(s) for s in SIDES])


def _ks(counts: DataFrame, cells: int | None = None) -> DataFrame:
    """``(column, score)``: 1 - largest gap of the two step functions; null when a side is empty."""
    numbers = _by_number(counts)
    running = running_totals(numbers, ["column"], "num", SIDES, cells=cells)
    gap = F.abs(F.col("cum_n_real") / F.col("real_total") - F.col("cum_n_syn") / F.col("syn_total"))
    sizes = _sizes(numbers).filter("real_total > 0 and syn_total > 0")
    return running.join(F.broadcast(sizes), "column").groupBy("column").agg((1 - F.max(gap)).alias("score"))


def _tv(counts: DataFrame) -> DataFrame:
    """``(column, score)``: 1 - half the summed absolute difference of the shares."""
    sizes = _sizes(counts).filter("real_total > 0 and syn_total > 0")
    gap = F.abs(F.col("n_real") / F.col("real_total") - F.col("n_syn") / F.col("syn_total"))
    return counts.join(F.broadcast(sizes), "column").groupBy("column").agg((1 - F.sum(gap) / 2).alias("score"))


def _scored(frame: DataFrame, names: list[str], metric: str) -> DataFrame:
    """Add the columns without a score: an empty side scores 0 under the metric name ``empty``."""
    listed = frame.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return listed.join(F.broadcast(frame), "column", "left").select(
        "column",
        F.when(F.col("score").isNull(), "empty").otherwise(metric).alias("metric"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def ks_complement(real: DataFrame, synthetic: DataFrame, names: list[str]) -> DataFrame:
    """``(column, metric, score)`` of number columns."""
    return _rounded(_scored(_ks(paired_counts(real, synthetic, names), _cells(real, synthetic, names)), names, "KSComplement"))


def tv_complement(real: DataFrame, synthetic: DataFrame, names: list[str]) -> DataFrame:
    """``(column, metric, score)`` of category columns."""
    return _rounded(_scored(_tv(paired_counts(real, synthetic, names)), names, "TVComplement"))


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", F.round("score", 4))


def _shapes(real: DataFrame, synthetic: DataFrame, sdtypes: dict[str, str]) -> DataFrame:
    shared = [c for c in real.columns if c in synthetic.columns]
    numbers = [c for c in shared if sdtypes.get(c, "categorical") == "numerical"]
    others = [c for c in shared if c not in numbers]
    parts = []
    if numbers:
        parts.append(_scored(_ks(paired_counts(real, synthetic, numbers), _cells(real, synthetic, numbers)), numbers, "KSComplement"))
    if others:
        parts.append(_scored(_tv(paired_counts(real, synthetic, others)), others, "TVComplement"))
    kinds = F.create_map(*[F.lit(x) for c in shared for x in (c, sdtypes.get(c, "categorical"))])
    return C.union_all(parts).withColumn("sdtype", kinds[F.col("column")])


def column_shapes(real: DataFrame, synthetic: DataFrame, sdtypes: dict[str, str]) -> DataFrame:
    """``(column, metric, score, sdtype)`` for every shared column."""
    return _rounded(_shapes(real, synthetic, sdtypes))


def column_shape(real: DataFrame, synthetic: DataFrame, name: str) -> DataFrame:
    """One column, judged by its storage type."""
    numeric = C.is_numeric(real.schema[name].dataType)
    return (ks_complement if numeric else tv_complement)(real, synthetic, [name])


def correlation_similarity(real: DataFrame, synthetic: DataFrame, names: list[str]) -> DataFrame:
    """``(column_a, column_b, score)``: 1 - half the difference of the correlations, all pairs in one pass per table."""
    pairs = list(itertools.combinations(names, 2))

    def correlations(df: DataFrame, prefix: str) -> DataFrame:
        aggs = [C.correlation(C.as_double(df, a), C.as_double(df, b)).alias(f"{prefix}{i}") for i, (a, b) in enumerate(pairs)]
        wide = df.agg(*aggs)
        rows = [F.struct(F.lit(i).alias("i"), F.col(f"{prefix}{i}").alias(prefix)) for i in range(len(pairs))]
        return wide.select(F.inline(F.array(*rows)))

    both = correlations(real, "r").join(correlations(synthetic, "s"), "i")
    named = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b")) for a, b in pairs])
    gap = F.abs(F.col("r") - F.col("s"))
    return both.select(
        F.inline(F.slice(named, F.col("i") + 1, 1)), (1 - gap / 2).alias("score")
    )


def contingency_similarity(
    real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]], bins: int = 10
) -> DataFrame:
    """``(column_a, column_b, score)``: 1 - total variation of the two joint tables.

    Numbers fall into equal-width bins between the real minimum and maximum.
    """
    used = sorted({c for p in pairs for c in p})
    numbers = [c for c in used if C.is_numeric(real.schema[c].dataType)]
    edges = {}
    if numbers:
        row = real.agg(
            *[F.min(C.as_double(real, c)).alias(f"lo{i}") for i, c in enumerate(numbers)],
            *[F.max(C.as_double(real, c)).alias(f"hi{i}") for i, c in enumerate(numbers)],
        ).first()
        edges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numbers)}

    def label(df: DataFrame, name: str) -> Column:
        if name not in edges or edges[name][0] is None:
            return C.as_text(df, name)
        low, high = edges[name]
        width = (high - low) or 1.0
        place = F.floor((C.as_double(df, name) - low) / width * bins)
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("string")

    def long(df: DataFrame, flag: bool) -> DataFrame:
        cells = [
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), label(df, a).alias("a"), label(df, b).alias("b"))
            for a, b in pairs
        ]
        return df.select(F.inline(F.array(*cells)), F.lit(flag).alias("_real")).filter("a is not null and b is not null")

    counts = long(real, True).unionByName(long(synthetic, False)).groupBy("column_a", "column_b", "a", "b").agg(
        F.count_if("_real").alias("n_real"), F.count_if(~F.col("_real")).alias("n_syn")
    )
    key = ["column_a", "column_b"]
    sizes = counts.groupBy(*key).agg(F.sum("n_real").alias("real_total"), F.sum("n_syn").alias("syn_total"))
    sizes = sizes.filter("real_total > 0 and syn_total > 0")
    gap = F.abs(F.col("n_real") / F.col("real_total") - F.col("n_syn") / F.col("syn_total"))
    return counts.join(F.broadcast(sizes), key).groupBy(*key).agg((1 - F.sum(gap) / 2).alias("score"))


def pair_trends(real: DataFrame, synthetic: DataFrame, sdtypes: dict[str, str]) -> DataFrame:
    """``(column_a, column_b, metric, score)`` for all pairs of number and category columns."""
    shared = [c for c in real.columns if c in synthetic.columns]
    numbers = [c for c in shared if sdtypes.get(c) == "numerical" and C.is_numeric(real.schema[c].dataType)]
    groups = [c for c in shared if sdtypes.get(c) in ("categorical", "boolean")]
    parts = []
    if len(numbers) > 1:
        found = correlation_similarity(real, synthetic, numbers)
        parts.append(found.select("column_a", "column_b", F.lit("CorrelationSimilarity").alias("metric"), "score"))
    mixed = list(itertools.combinations(groups, 2)) + [(a, b) for a in numbers for b in groups]
    if mixed:
        found = contingency_similarity(real, synthetic, mixed)
        parts.append(found.select("column_a", "column_b", F.lit("ContingencySimilarity").alias("metric"), "score"))
    if not parts:
        return real.sparkSession.createDataFrame([], "column_a string, column_b string, metric string, score double")
    return C.union_all(parts)


def column_pair_trends(real: DataFrame, synthetic: DataFrame, sdtypes: dict[str, str]) -> DataFrame:
    """One row: mean pair score (null without pairs) and the number of pairs."""
    pairs = pair_trends(real, synthetic, sdtypes).filter("score is not null")
    return pairs.agg(F.round(F.avg("score"), 4).alias("column_pair_trends_score"), F.count("*").alias("pairs"))


def quality_report(
    real: DataFrame,
    synthetic: DataFrame,
    sdtypes: dict[str, str],
    fidelity_threshold: float = FIDELITY_THRESHOLD,
    column_threshold: float = COLUMN_THRESHOLD,
    compat: bool = False,
) -> DataFrame:
    """One row: overall, shape and pair scores, degraded columns and whether the table passes.

    ``compat`` averages the pair score in twice, as a library total used in place of the shape score does.
    """
    shapes = _shapes(real, synthetic, sdtypes).agg(
        F.avg("score").alias("shapes"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.round("score", 4) < column_threshold, F.col("column")))), ","
        ).alias("degraded_columns"),
    )
    pairs = pair_trends(real, synthetic, sdtypes).agg(F.avg("score").alias("pairs"))
    both = C.side_by_side([shapes, pairs])
    shape = F.coalesce("shapes", F.lit(0.0))
    if compat:
        shape = F.when(F.col("pairs").isNotNull(), (shape + F.col("pairs")) / 2).otherwise(shape)
    overall = F.when(F.col("pairs").isNotNull(), (shape + F.col("pairs")) / 2).otherwise(shape)
    return both.select(
        F.round(overall, 4).alias("overall_score"),
        F.round(shape, 4).alias("column_shapes_score"),
        F.round("pairs", 4).alias("column_pair_trends_score"),
        "degraded_columns",
        (overall >= fidelity_threshold).alias("passed"),
        F.lit(float(fidelity_threshold)).alias("threshold"),
    )


def validate_thresholds(
    report: DataFrame, shapes: DataFrame, fidelity_threshold: float = FIDELITY_THRESHOLD, column_threshold: float = COLUMN_THRESHOLD
) -> DataFrame:
    """``(message)``: one for a low overall score, one per degraded column."""
    overall = report.filter(F.col("overall_score") < fidelity_threshold).select(
        F.format_string(f"the table as a whole reaches %.3f of the {fidelity_threshold} asked for", "overall_score").alias("message")
    )
    low = shapes.filter(F.col("score") < column_threshold).select(
        F.format_string(f"'%s' reaches %.3f of the {column_threshold} asked for in each column", "column", "score").alias("message")
    )
    return overall.unionByName(low)


def diagnostic_report(shapes: DataFrame, column_threshold: float = COLUMN_THRESHOLD) -> DataFrame:
    """``(column, score, recommendation)`` for degraded columns."""
    numeric = "Column '%s' scores %.3f: its values drift from the real ones; refit its marginal or widen its bounds."
    other = "Column '%s' scores %.3f: its category shares drift from the real ones; look at its rare categories."
    text = F.when(F.col("sdtype") == "numerical", F.format_string(numeric, "column", "score")).otherwise(
        F.format_string(other, "column", "score")
    )
    return shapes.filter(F.col("score") < column_threshold).select("column", "score", text.alias("recommendation"))


def quality_history(history: DataFrame, order: list[Column], keep: int = HISTORY_LENGTH) -> DataFrame:
    """Summary of the last evaluations; ``order`` sorts the most recent first."""
    last = history.orderBy(*order).limit(keep)
    return last.agg(
        F.count("*").alias("count"),
        F.round(F.avg("overall_score"), 4).alias("mean_score"),
        F.round(F.min("overall_score"), 4).alias("min_score"),
        F.round(F.max("overall_score"), 4).alias("max_score"),
        F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
    )


# --- Bayesian network likelihood -------------------------------------------------------------------------


def _pair_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("parent"), F.lit(b).alias("child"), C.as_text(df, a).alias("a"), C.as_text(df, b).alias("b"))
        for a, b in pairs
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("parent", "child", "a", "b").agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, names: list[str]) -> DataFrame:
    """``(parent, child, mi)`` in nats for all pairs; one shuffle of joint counts."""
    joint = _pair_counts(df, list(itertools.combinations(names, 2)))
    key = ["parent", "child"]
    left = joint.groupBy(*key, "a").agg(F.sum("n").alias("na"))
    right = joint.groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    size = joint.groupBy(*key).agg(F.sum("n").alias("total"))
    whole = joint.join(left, [*key, "a"]).join(right, [*key, "b"]).join(F.broadcast(size), key)
    p = F.col("n") / F.col("total")
    term = p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))
    return whole.groupBy(*key).agg(F.sum(term).alias("mi"))


def spanning_tree(names: list[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum spanning tree over columns as (parent, child) edges from the first column."""
    inside, edges = [names[0]], []
    both = {**weights, **{(b, a): w for (a, b), w in weights.items()}}
    while len(inside) < len(names):
        a, b = max(((a, b) for a in inside for b in names if b not in inside), key=lambda e: (both.get(e, -np.inf), e))
        edges.append((a, b))
        inside.append(b)
    return edges


def bn_log_likelihood(
    real: DataFrame, synthetic: DataFrame, names: list[str], edges: list[tuple[str, str]] | None = None
) -> DataFrame:
    """``(n_rows, log_likelihood)``: mean log probability of synthetic rows under a tree fitted on the real table.

    Without ``edges`` the tree maximises mutual information. The likelihood is a sum over edges of joint
    counts, so rows never meet the model: only counts join counts. Shares are smoothed by one per category.
    """
    if edges is None:
        found = {(r["parent"], r["child"]): r["mi"] for r in mutual_information(real, names).collect()}
        edges = spanning_tree(names, found)
    root = edges[0][0] if edges else names[0]
    # The root is the edge from a constant.
    links = [(None, root), *edges]

    def counts(df: DataFrame) -> DataFrame:
        cells = [
            F.struct(
                F.lit(i).alias("edge"),
                (F.lit("") if a is None else F.coalesce(C.as_text(df, a), F.lit("\0"))).alias("a"),
                F.coalesce(C.as_text(df, b), F.lit("\0")).alias("b"),
            )
            for i, (a, b) in enumerate(links)
        ]
        return df.select(F.inline(F.array(*cells))).groupBy("edge", "a", "b").agg(F.count("*").alias("n"))

    learned = counts(real)
    per_parent = learned.groupBy("edge", "a").agg(F.sum("n").alias("na"))
    domain = learned.select("edge", "b").distinct().groupBy("edge").agg(F.count("*").alias("k"))
    seen = counts(synthetic).withColumnRenamed("n", "m")
    joined = (
        seen.join(learned, ["edge", "a", "b"], "left")
        .join(per_parent, ["edge", "a"], "left")
        .join(F.broadcast(domain), "edge")
    )
    zero = F.lit(0)
    p = (F.coalesce("n", zero) + 1) / (F.coalesce("na", zero) + F.col("k"))
    return joined.agg(
        F.sum(F.when(F.col("edge") == 0, F.col("m"))).alias("n_rows"),
        (F.sum(F.col("m") * F.log(p)) / F.sum(F.when(F.col("edge") == 0, F.col("m")))).alias("log_likelihood"),
    )
