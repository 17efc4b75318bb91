"""Distributed value counts, running totals and exact quantiles.

Nothing here puts a whole column in one task. Values are counted with map-side combining, so a hot value
is one row after the first shuffle. Running totals are taken inside value-range buckets whose offsets come
from a table of bucket sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions.columns import as_double, doubles, unpivot_values

BUCKETS = 32
# Up to this many counted cells a plain window is cheaper than buckets, and small enough for one task.
SMALL_CELLS = 2_000_000


def value_counts(df: DataFrame, columns: list[str], tags: dict[str, Column] | None = None) -> DataFrame:
    """``(column, num, txt, n)`` for non-null cells; with tags, one count per tag instead of ``n``."""
    tags = tags or {"n": F.lit(True)}
    long = unpivot_values(df, columns, [t.alias(f"_{k}") for k, t in tags.items()])
    return (
        long.filter(F.col("num").isNotNull() | F.col("txt").isNotNull())
        .groupBy("column", "num", "txt")
        .agg(*[F.count_if(F.col(f"_{k}")).alias(k) for k in tags])
    )


def running_totals(
    counts: DataFrame, keys: list[str], order: str, totals: list[str], buckets: int = BUCKETS, prefix: str = "cum_",
    cells: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` per key in the order of a number column.

    ``order`` values must be unique per key, which holds after counting by value. Cut points come from a
    quantile sketch: they shape the balance of the buckets, never the result. ``cells`` is a checked bound of
    the number of counts, if the caller knows one.
    """
    if cells is not None and cells <= SMALL_CELLS:
        inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select("*", *[F.sum(t).over(inside).alias(f"{prefix}{t}") for t in totals])
    steps = doubles(i / buckets for i in range(1, buckets))
    # The condition on the first total keeps this branch's columns equal to the others', so that Spark
    # reuses the exchange under the counts.
    seen = F.when(sum(F.col(t) for t in totals) >= 0, F.col(order))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(seen, steps, 1000).alias("_cuts"))
    # One row of `buckets` numbers per key; keys are column names or other bounded groups.
    placed = counts.join(F.broadcast(cuts), keys).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(order)))
    ).drop("_cuts")
    return chunked_running_totals(placed, keys, "_bucket", [order], totals, prefix).drop("_bucket")


def chunked_running_totals(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], totals: list[str], prefix: str = "cum_"
) -> DataFrame:
    """Running sums per key where ``chunk`` ascends with ``order``: local sums plus chunk offsets."""
    sums = df.groupBy(*keys, chunk).agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, chunk, *[F.coalesce(F.sum(f"_s_{t}").over(before), F.lit(0)).alias(f"_o_{t}") for t in totals]
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, chunk])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(t).over(inside) + F.col(f"_o_{t}")).alias(f"{prefix}{t}") for t in totals],
    )


# Cuts of the sampled distribution, rows sampled for them, and how many rows a bracket may hold before it
# is narrowed once more. Two cuts to each side are about five standard errors of the sample.
GRID = 256
SAMPLE = 100_000
BRACKET_ROWS = 5_000_000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between order statistics, as driver scalars.

    A sample brackets each order statistic; a scan then counts what lies below a bracket and groups only the
    values inside it. No pass shuffles the table: a bracket holds about 2 % of the rows and is narrowed again
    while it is large. Counts tell whether a bracket holds its rank; if not, all values are ranked instead.
    """
    number = {c: as_double(df, c) + F.lit(0.0) for c in columns}
    targets = [(c, p) for c in columns for p in probabilities]
    low = {t: float("-inf") for t in targets}
    high = {t: float("inf") for t in targets}
    sizes: dict[str, int] = {}
    expected = df.count()
    while True:
        rows = _bracket_sketch(df, number, targets, low, high, min(1.0, SAMPLE / max(expected, 1)))
        if not sizes:
            sizes = {c: rows[(c, probabilities[0])]["inside"] for c in columns}
        expected, moved = 0, False
        for t in targets:
            r, n = rows[t], sizes[t[0]]
            cuts = r["cuts"]
            if n == 0 or not cuts or low[t] == high[t]:
                continue
            rank = (n - 1) * t[1]
            at = (rank - r["below"]) / max(r["inside"], 1) * GRID
            first, last = int(at) - 2, int(at) + 3
            bracket = (cuts[first] if first >= 0 else low[t], cuts[last] if last < len(cuts) else high[t])
            moved = moved or bracket != (low[t], high[t])
            low[t], high[t] = bracket
            # A hot value fills a bracket that cannot shrink; grouping turns it into one row per task.
            if low[t] < high[t]:
                expected = max(expected, int(r["inside"] * 5 / GRID))
        if expected <= BRACKET_ROWS or not moved:
            break
    found = _select_ranks(df, number, targets, low, high, sizes)
    return {c: [found[(c, p)] for p in probabilities] for c in columns}


def _bracket_sketch(
    df: DataFrame, number: dict[str, Column], targets: list, low: dict, high: dict, fraction: float
) -> dict:
    """Counts below and inside each bracket plus evenly spaced cuts of a sample of its inside, in one row."""
    steps = doubles(i / GRID for i in range(GRID + 1))
    aggs, seen = [], {}
    for t in targets:
        key = (t[0], low[t], high[t])
        if key in seen:
            continue
        i = seen[key] = len(seen)
        x = number[t[0]]
        inside = F.when((x >= low[t]) & (x <= high[t]), x)
        aggs += [
            F.count_if(x < low[t]).alias(f"b{i}"),
            F.count(inside).alias(f"n{i}"),
            F.percentile_approx(F.when(F.col("_keep"), inside), steps, 2_000).alias(f"c{i}"),
        ]
    # The draw shapes the brackets only, never a result.
    row = df.withColumn("_keep", F.rand(42) < fraction).agg(*aggs).first()
    place = {t: seen[(t[0], low[t], high[t])] for t in targets}
    return {t: {"below": row[f"b{i}"], "inside": row[f"n{i}"], "cuts": row[f"c{i}"]} for t, i in place.items()}


def _select_ranks(df: DataFrame, number: dict, targets: list, low: dict, high: dict, sizes: dict) -> dict:
    live = [t for t in targets if sizes[t[0]] > 0]
    out: dict = {t: None for t in targets}
    if not live:
        return out
    ranks = {t: ((sizes[t[0]] - 1) * t[1]) for t in live}
    row = df.agg(
        *[F.count_if(number[t[0]] < low[t]).alias(f"b{i}") for i, t in enumerate(live)],
        *[F.count_if(number[t[0]] <= high[t]).alias(f"u{i}") for i, t in enumerate(live)],
    ).first()
    below = {t: row[f"b{i}"] for i, t in enumerate(live)}
    sound = {t: below[t] <= int(ranks[t]) and row[f"u{i}"] > -int(-ranks[t] // 1) for i, t in enumerate(live)}
    missed = [t for t in live if not sound[t]]
    wanted = []
    for t in live:
        if sound[t] and low[t] == high[t]:
            # A bracket of one value is the answer already, as with few distinct values.
            out[t] = low[t]
        elif sound[t]:
            wanted.append(t)
    if wanted:
        inside = [(number[t[0]] >= low[t]) & (number[t[0]] <= high[t]) for t in wanted]
        cells = F.array(
            *[F.when(hit, F.struct(F.lit(i).alias("t"), number[t[0]].alias("num"))) for i, (t, hit) in enumerate(zip(wanted, inside))]
        )
        counts = (
            df.filter(reduce(Column.__or__, inside))
            .select(F.inline(F.array_compact(cells)))
            .groupBy("t", "num")
            .agg(F.count("*").alias("n"))
        )
        order = Window.partitionBy("t").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)

        def known(values: dict) -> Column:
            return F.create_map(*[F.lit(v) for i, t in enumerate(wanted) for v in (i, values[t])])[F.col("t")]

        running = counts.withColumn("cum", F.sum("n").over(order) + known(below))
        picked = running.groupBy("t").agg(
            F.min(F.when(F.col("cum") > known({t: int(ranks[t]) for t in wanted}), F.col("num"))).alias("lo"),
            F.min(F.when(F.col("cum") > known({t: -int(-ranks[t] // 1) for t in wanted}), F.col("num"))).alias("hi"),
        )
        for r in picked.collect():
            t = wanted[r["t"]]
            out[t] = r["lo"] + (r["hi"] - r["lo"]) * (ranks[t] - int(ranks[t]))
    for t in missed:
        # The sketch was off for this one: fall back to all values of the column.
        name = t[0]
        counts = df.select(F.lit(name).alias("column"), number[name].alias("num")).filter("num is not null")
        out[t] = _quantile_of_counts(counts.groupBy("column", "num").agg(F.count("*").alias("n")), sizes[name], t[1])
    return out


def _quantile_of_counts(counts: DataFrame, total: int, p: float) -> float:
    running = running_totals(counts, ["column"], "num", ["n"])
    k = (total - 1) * p
    row = running.agg(
        F.min(F.when(F.col("cum_n") > int(k), F.col("num"))).alias("lo"),
        F.min(F.when(F.col("cum_n") > -int(-k // 1), F.col("num"))).alias("hi"),
    ).first()
    return row["lo"] + (row["hi"] - row["lo"]) * (k - int(k))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact interpolated medians as driver scalars, one per column."""
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()} if columns else {}


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, num, txt)``: the smallest most frequent value per column, two map-side combined steps."""
    counts = value_counts(df, columns)
    # Numbers order by value, texts by text; only one of the two decides within a column.
    rank = F.struct(F.col("n"), -F.col("num"))
    numeric = counts.filter(F.col("num").isNotNull()).groupBy("column").agg(F.max_by(F.struct("num", "txt"), rank).alias("v"))
    texts = counts.filter(F.col("num").isNull())
    best = texts.groupBy("column").agg(F.max("n").alias("_best"))
    lowest = texts.join(F.broadcast(best), "column").filter("n = _best").groupBy("column").agg(F.min("txt").alias("txt"))
    return numeric.select("column", "v.num", "v.txt").unionByName(
        lowest.select("column", F.lit(None).cast("double").alias("num"), "txt")
    )
