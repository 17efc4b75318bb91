"""One-column models: how a column maps to the unit interval and back, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions import columns as C
from synthspark.functions.distribution import value_counts
from synthspark.functions.rng import normal_quantile, uniform, with_normals
from synthspark.operators.profile import sdtypes as detect
from synthspark.session import stored

KNOTS = 64
# Ranks below the first and above the last inner knot where a long tail is looked at too: halves down to 1 in 4,096.
TAILS = tuple(2.0**-k for k in range(12, 6, -1))
# Categories up to this many live in the plan as literals; longer lists stay a table and are looked up by joins.
# Both take part in the joint model in the same way.
LITERAL_CATEGORIES = 100
DECIMALS = 6
# Cells of the tabulated distribution function.
CELLS = 512
EDGE = 1e-6
DISTRIBUTIONS = ("beta", "gamma", "norm", "truncnorm", "uniform", "empirical")


@dataclass(frozen=True)
class Marginal:
    """Fitted column. ``grid`` holds evenly spaced quantiles; ``shares`` cumulative category shares.

    ``head`` and ``tail``, if any, are the quantiles at the ranks ``TAILS`` and as far from the other end.
    """

    name: str
    kind: str
    dtype: T.DataType
    null_share: float = 0.0
    grid: tuple[float, ...] = ()
    low: float = 0.0
    high: float = 0.0
    decimals: int | None = None
    categories: tuple[str, ...] = ()
    shares: tuple[float, ...] = ()
    table: DataFrame | None = field(default=None, compare=False)
    table_attenuation: float = 1.0
    head: tuple[float, ...] = ()
    tail: tuple[float, ...] = ()

    @property
    def modelled(self) -> bool:
        """Takes part in the joint model; keys and texts are drawn on their own."""
        return self.kind in ("number", "category")

    # --- value -> unit interval ---

    def unit(self, df: DataFrame) -> Column:
        """Unit position; that of a long category list is looked up beforehand, see ``with_table_units``."""
        if self.kind == "number":
            u = _interpolate(C.as_double(df, self.name), *_knots(self.grid, self.head, self.tail))
        elif self.table is not None:
            u = C.quoted(_unit_name(self.name))
        else:
            u = _category_unit(C.as_text(df, self.name), self.categories, self.shares)
        # `least` and `greatest` skip nulls, so they come inside the null test.
        return F.when(C.quoted(self.name).isNotNull(), F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), u)))

    def attenuation(self) -> float:
        """Correlation of a column's scores with the normal variable its categories cut; 1 for numbers."""
        if self.table is not None:
            return self.table_attenuation
        if self.kind != "category" or len(self.shares) < 2:
            return 1.0
        bell = NormalDist()
        edges = np.clip(np.array([0.0, *self.shares]), 0.0, 1.0)
        share = np.diff(edges)
        score = np.array([bell.inv_cdf(min(1 - EDGE, max(EDGE, m))) for m in (edges[1:] + edges[:-1]) / 2])
        height = np.array([bell.pdf(bell.inv_cdf(e)) if 0 < e < 1 else 0.0 for e in edges])
        mean = float(share @ score)
        spread = math.sqrt(max(float(share @ (score - mean) ** 2), 1e-12))
        return min(1.0, max(float(score @ (height[:-1] - height[1:])) / spread, 0.05))

    def interval(self, value) -> tuple[float, float]:
        """Part of the unit interval a fixed value stands for."""
        if self.kind == "category":
            text = str(value).lower() if isinstance(value, bool) else str(value)
            if self.table is not None:
                span = self.table.filter(F.col("value") == text).select("low", "high").first()
                if span is None:
                    raise ValueError(f"'{value}' was never seen in column '{self.name}'")
                return span["low"], span["high"]
            if text not in self.categories:
                raise ValueError(f"'{value}' was never seen in column '{self.name}'")
            i = self.categories.index(text)
            return (self.shares[i - 1] if i else 0.0), self.shares[i]
        knots, units = _knots(self.grid, self.head, self.tail)
        u = float(np.clip(np.interp(float(value), knots, units), EDGE, 1 - EDGE))
        return u, u

    # --- unit interval -> value ---

    def value(self, u: Column, clip: bool = True, rounded: bool = True) -> Column:
        if self.kind == "category":
            return _tree(u, list(self.shares[:-1]), [F.lit(c) for c in self.categories]).cast(self.dtype)
        steps = len(self.grid) - 1
        place = F.least(F.lit(steps - 1), F.floor(u * steps).cast("int"))
        grid = C.doubles(self.grid)
        lower, upper = F.get(grid, place), F.get(grid, place + 1)
        x = lower + (upper - lower) * (u * steps - place)
        if self.tail:
            x = F.when(u < 1 / steps, self._between(u, 0)).when(u >= 1 - 1 / steps, self._between(u, len(TAILS) + steps - 1)).otherwise(x)
        if clip:
            x = F.least(F.lit(self.high), F.greatest(F.lit(self.low), x))
        return self.stored(x, rounded)

    def _between(self, u: Column, first: int) -> Column:
        """Value at a rank in one of the ``len(TAILS) + 1`` cells from number ``first`` on."""
        values, units = _points(self.grid, self.head, self.tail)
        cells = range(first, first + len(TAILS) + 1)
        made = [values[i] + (u - units[i]) * ((values[i + 1] - values[i]) / (units[i + 1] - units[i])) for i in cells]
        return _tree(u, [units[i] for i in cells[1:]], [F.lit(x) if isinstance(x, float) else x for x in made])

    def stored(self, x: Column, rounded: bool = True) -> Column:
        """Number in the storage type of the column."""
        if C.is_datetime(self.dtype):
            stamp = F.timestamp_seconds(F.floor(x + 0.5))
            return stamp.cast("timestamp_ntz").cast(self.dtype) if isinstance(self.dtype, T.TimestampNTZType) else stamp.cast(self.dtype)
        if C.is_integer(self.dtype):
            return F.floor(x + 0.5).cast(self.dtype)
        if rounded and self.decimals is not None:
            # Whole steps of the last decimal; `round` would go through arbitrary-precision numbers.
            x = F.floor(x * float(10**self.decimals) + 0.5) / float(10**self.decimals)
        return x.cast(self.dtype)

    def drawn(self, row: Column, seed: int) -> Column:
        """Value of a column outside the joint model: fresh keys and made-up text, never a copied one."""
        if self.kind == "id":
            if C.is_numeric(self.dtype):
                return (row + 1).cast(self.dtype)
            return F.concat(F.lit(f"{self.name}-"), F.lpad((row + 1).cast("string"), 12, "0"))
        length = F.greatest(F.lit(1), F.round(self._length(uniform(row, f"len:{self.name}", seed)), 0)).cast("int")
        word = F.translate(F.md5(F.concat_ws(":", row.cast("string"), F.lit(f"{self.name}:{seed}"))), "0123456789", "ghiklmno s")
        return F.rpad(word, length, word)

    def _length(self, u: Column) -> Column:
        steps = len(self.grid) - 1
        place = F.least(F.lit(steps - 1), F.floor(u * steps).cast("int"))
        return F.get(C.doubles(self.grid), place)


def _tree(u: Column, cuts: list[float], leaves: list[Column]) -> Column:
    """Leaf ``i`` where ``cuts[i - 1] <= u < cuts[i]``, as nested conditions of logarithmic depth."""
    if not cuts:
        return leaves[0]
    middle = len(cuts) // 2
    return F.when(u < F.lit(cuts[middle]), _tree(u, cuts[:middle], leaves[: middle + 1])).otherwise(
        _tree(u, cuts[middle + 1 :], leaves[middle + 1 :])
    )


def _points(grid: tuple[float, ...], head: tuple[float, ...] = (), tail: tuple[float, ...] = ()) -> tuple[list[float], list[float]]:
    """All quantiles with their ranks."""
    last = len(grid) - 1
    units = [i / last for i in range(last + 1)]
    if tail:
        grid = (grid[0], *head, *grid[1:-1], *tail, grid[-1])
        units = [units[0], *TAILS, *units[1:-1], *(1 - r for r in reversed(TAILS)), units[-1]]
    return list(grid), units


def _knots(grid: tuple[float, ...], head: tuple[float, ...] = (), tail: tuple[float, ...] = ()) -> tuple[list[float], list[float]]:
    """Distinct quantiles with the middle of the run of unit positions each one covers."""
    values, spots = [], []
    for g, unit in zip(*_points(grid, head, tail)):
        if values and g == values[-1]:
            spots[-1].append(unit)
        else:
            values.append(g)
            spots.append([unit])
    return values, [(s[0] + s[-1]) / 2 for s in spots]


def _interpolate(x: Column, knots: list[float], units: list[float]) -> Column:
    """Distribution function by lookup in a table over equal steps of asinh((x - middle) / scale).

    The scale follows the quartiles, so both the bulk and long tails get fine cells. The lookup costs the
    same for any number of cells and keeps the generated code small.
    """
    if len(knots) == 1:
        return F.lit(0.5)
    middle = float(np.interp(0.5, units, knots))
    scale = float(np.interp(0.75, units, knots) - np.interp(0.25, units, knots)) or (knots[-1] - knots[0])
    low, high = (float(np.arcsinh((k - middle) / scale)) for k in (knots[0], knots[-1]))
    steps = np.linspace(low, high, CELLS + 1)
    table = C.doubles(np.interp(middle + scale * np.sinh(steps), knots, units))
    place = (F.asinh((x - middle) / scale) - low) * (CELLS / (high - low))
    cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(place).cast("int")))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), place - cell))
    left, right = F.get(table, cell), F.get(table, cell + 1)
    return left + (right - left) * part


def _category_unit(text: Column, categories: tuple[str, ...], shares: tuple[float, ...]) -> Column:
    starts = (0.0, *shares[:-1])
    middle = F.create_map(*[F.lit(x) for c, a, b in zip(categories, starts, shares) for x in (c, (a + b) / 2)])
    return F.try_element_at(middle, text)


def _unit_name(column: str) -> str:
    return f"__unit_{column}"


def with_table_units(df: DataFrame, marginals: list[Marginal]) -> DataFrame:
    """Input with the unit position of each long category list, by an equi-join on the category."""
    for m in marginals:
        if m.table is not None:
            first = F.col("bucket") == F.floor(F.col("low") * F.col("buckets"))
            middles = m.table.filter(first).select(F.col("value").alias("__value"), ((F.col("low") + F.col("high")) / 2).alias(_unit_name(m.name)))
            df = df.join(middles, C.as_text(df, m.name) == F.col("__value"), "left").drop("__value")
    return df


def normal_scores(df: DataFrame, marginals: list[Marginal], keep: list[Column] | None = None) -> DataFrame:
    """``(_keep0, …, s0, s1, …)``: normal scores of the modelled columns; null stays null.

    Unit positions are a projection of their own, so the quantile formula does not repeat their lookup.
    """
    df = with_table_units(df, marginals)
    kept = [k.alias(f"_keep{i}") for i, k in enumerate(keep or [])]
    placed = df.select(*kept, *[m.unit(df).alias(f"_u{i}") for i, m in enumerate(marginals)])
    return with_normals(placed, {f"_u{i}": f"s{i}" for i in range(len(marginals))}, once=True)


# --- fitting ---------------------------------------------------------------------------------------------


def fit_marginals(
    df: DataFrame,
    sdtypes: dict[str, str] | None = None,
    distribution: str = "beta",
    per_column: dict[str, str] | None = None,
    tails: bool = False,
) -> list[Marginal]:
    """Marginals of all columns from two aggregates: one wide pass and one count of categories.

    With ``tails`` empirical numbers have finer quantiles at both ends, so that few far values are not spread over the
    whole outermost part.
    """
    kinds = {**(detect(df) if sdtypes is None or set(df.columns) - set(sdtypes) else {}), **(sdtypes or {})}
    chosen = {c: (per_column or {}).get(c, distribution) for c in df.columns}
    bad = {c: d for c, d in chosen.items() if d not in DISTRIBUTIONS}
    if bad:
        raise ValueError(f"unknown distributions {bad}")
    roles = {c: _role(df, c, kinds[c]) for c in df.columns}
    numbers = [c for c, r in roles.items() if r == "number"]
    texts = [c for c, r in roles.items() if r == "text"]
    groups = [c for c, r in roles.items() if r == "category"]
    ranks = [i / KNOTS for i in range(KNOTS + 1)]
    steps = C.doubles([*ranks, *TAILS, *(1 - r for r in reversed(TAILS))] if tails else ranks)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(C.quoted(c)).alias(f"c{i}"))
        if c in numbers or c in texts:
            x = C.as_double(df, c) if c in numbers else F.length(C.quoted(c)).cast("double")
            aggs += [
                F.percentile_approx(x, steps, 10_000).alias(f"q{i}"),
                F.min(x).alias(f"lo{i}"),
                F.max(x).alias(f"hi{i}"),
                F.avg(x).alias(f"m{i}"),
                F.var_pop(x).alias(f"v{i}"),
            ]
            if C.is_float(df.schema[c].dataType):
                # Smallest number of decimals that writes every value exactly.
                aggs += [
                    F.bool_and(F.abs(x * 10**d - F.rint(x * 10**d)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x))).alias(f"d{i}_{d}")
                    for d in range(DECIMALS + 1)
                ]
    row = df.agg(*aggs).first().asDict()
    shares = _category_shares(df, groups)
    out = []
    for i, c in enumerate(df.columns):
        dtype = df.schema[c].dataType
        gone = 1.0 - row[f"c{i}"] / row["n"] if row["n"] else 0.0
        role = roles[c]
        if role == "number":
            decimals = next((d for d in range(DECIMALS + 1) if row.get(f"d{i}_{d}")), None)
            if row[f"lo{i}"] is None:
                out.append(Marginal(c, "number", dtype, 1.0, (0.0, 0.0), 0.0, 0.0, decimals))
                continue
            quantiles = row[f"q{i}"][: KNOTS + 1]
            ends = tuple(float(x) for x in row[f"q{i}"][KNOTS + 1 :]) if chosen[c] == "empirical" and row[f"hi{i}"] > row[f"lo{i}"] else ()
            grid = quantile_grid(chosen[c], quantiles, row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"v{i}"])
            out.append(Marginal(c, "number", dtype, gone, grid, row[f"lo{i}"], row[f"hi{i}"], decimals, head=ends[: len(TAILS)], tail=ends[len(TAILS) :]))
        elif role == "text":
            out.append(Marginal(c, "text", dtype, gone, tuple((row[f"q{i}"] or (1.0, 1.0))[: KNOTS + 1])))
        elif role == "category":
            names, cumulative, table = shares[c]
            weak = _table_attenuation(table) if table is not None else 1.0
            out.append(Marginal(c, "category", dtype, gone, categories=names, shares=cumulative, table=table, table_attenuation=weak))
        else:
            out.append(Marginal(c, "id", dtype, gone))
    return out


def _role(df: DataFrame, name: str, sdtype: str) -> str:
    dtype = df.schema[name].dataType
    if not C.is_atomic(dtype):
        raise ValueError(f"column '{name}' of type {dtype.simpleString()} cannot be generated")
    if sdtype == "id":
        return "id"
    if C.is_datetime(dtype) or (sdtype in ("numerical", "datetime") and C.is_numeric(dtype)):
        return "number"
    return "text" if sdtype == "text" else "category"


def _category_shares(df: DataFrame, names: list[str]) -> dict:
    """``{column: (categories, cumulative shares, table or None)}``, most frequent first."""
    if not names:
        return {}
    counts = value_counts(df, names).select("column", F.coalesce("txt", F.col("num").cast("string")).alias("value"), "n")
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    short = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LITERAL_CATEGORIES + 1)
    found: dict[str, list] = {c: [] for c in names}
    for r in short.orderBy("column", "r").collect():
        found[r["column"]].append((r["value"], r["n"]))
    out = {}
    for c in names:
        if len(found[c]) > LITERAL_CATEGORIES:
            # Stored once at fit time; every sample joins it.
            out[c] = ((), (), stored(category_table(counts.filter(F.col("column") == c).select("value", "n"), ordered=True), "categories"))
            continue
        total = sum(n for _, n in found[c])
        cumulative = np.cumsum([n for _, n in found[c]]) / max(total, 1)
        out[c] = (tuple(v for v, _ in found[c]) or ("",), tuple(float(x) for x in cumulative) or (1.0,), None)
    return out


def _table_attenuation(table: DataFrame) -> float:
    """``Marginal.attenuation`` of a category table, by one aggregate."""
    spans = table.filter(F.col("bucket") == F.floor(F.col("low") * F.col("buckets")))
    inside = lambda u: F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), u))
    height = lambda u: F.when((u > 0) & (u < 1), F.exp(-0.5 * F.pow(normal_quantile(inside(u)), 2)) / math.sqrt(2 * math.pi)).otherwise(0.0)
    share = F.col("high") - F.col("low")
    named = spans.select(share.alias("share"), normal_quantile(inside((F.col("low") + F.col("high")) / 2)).alias("score"), (height(F.col("low")) - height(F.col("high"))).alias("drop"))
    row = named.agg(F.sum(F.col("share") * F.col("score")).alias("m"), F.sum(F.col("share") * F.col("score") * F.col("score")).alias("q"), F.sum(F.col("score") * F.col("drop")).alias("c")).first()
    spread = math.sqrt(max((row["q"] or 0.0) - (row["m"] or 0.0) ** 2, 1e-12))
    return min(1.0, max((row["c"] or 0.0) / spread, 0.05))


def category_table(counts: DataFrame, width: int = 3, ordered: bool = False) -> DataFrame:
    """``(bucket, low, high, value, buckets)``: categories laid out on the unit interval and cut into buckets.

    A draw finds its category by an equi-join on the bucket and one comparison. Categories are laid out by
    hash bucket, or with ``ordered`` by count and name as short lists are, in parts of a global sort. Offsets come
    from a table of part sums, so no task sees all categories; a hot category covers many buckets.
    """
    if ordered:
        ranked = counts.orderBy(F.col("n").desc(), "value").withColumn("_b", F.spark_partition_id())
        hashed = stored(ranked, "categories").withColumn("_h", F.struct(-F.col("n"), F.col("value")))
    else:
        hashed = counts.withColumn("_h", F.md5("value")).withColumn("_b", F.substring("_h", 1, width))
    sums = hashed.groupBy("_b").agg(F.sum("n").alias("_s"), F.count("*").alias("_k"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    offsets = sums.select(
        "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("_t"),
        F.sum("_k").over(whole).alias("_kk"),
    )
    inside = Window.partitionBy("_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    laid = hashed.join(F.broadcast(offsets), "_b").withColumn("_end", F.sum("n").over(inside) + F.col("_o"))
    spans = laid.select(
        "value", ((F.col("_end") - F.col("n")) / F.col("_t")).alias("low"), (F.col("_end") / F.col("_t")).alias("high"),
        F.col("_kk").alias("buckets"),
    )
    first = F.floor(F.col("low") * F.col("buckets"))
    last = F.least(F.floor(F.col("high") * F.col("buckets")), F.col("buckets") - 1)
    return spans.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def quantile_grid(kind: str, empirical: list[float], low: float, high: float, mean: float, var: float) -> tuple[float, ...]:
    """Evenly spaced quantiles of the chosen family, matched by moments."""
    if kind == "empirical" or high <= low or var <= 0:
        return tuple(float(x) for x in empirical) if high > low else (low, high)
    u = np.linspace(0, 1, KNOTS + 1)
    if kind == "uniform":
        return tuple((low + (high - low) * u).tolist())
    sd = math.sqrt(var)
    if kind in ("norm", "truncnorm"):
        x = np.linspace(mean - 8 * sd, mean + 8 * sd, 20001) if kind == "norm" else np.linspace(low, high, 20001)
        density = np.exp(-0.5 * ((x - mean) / sd) ** 2)
    elif kind == "gamma":
        shift = low - 1e-3 * (high - low)
        shape, scale = (mean - shift) ** 2 / var, var / (mean - shift)
        t = np.linspace(1e-4, 1, 20001) ** 3
        x = shift + t * max(high - shift, (shape + 12 * math.sqrt(shape) + 12) * scale)
        density = np.exp((shape - 1) * np.log((x - shift) / scale) - (x - shift) / scale)
    else:
        m, v = (mean - low) / (high - low), var / (high - low) ** 2
        total = max(m * (1 - m) / v - 1, 1e-3)
        a, b = m * total, (1 - m) * total
        # Cosine spacing puts points where the density may be unbounded.
        t = (1 - np.cos(np.linspace(0, np.pi, 20001))) / 2
        t = np.clip(t, 1e-12, 1 - 1e-12)
        x = low + (high - low) * t
        density = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t))
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(x))])
    cdf = mass / mass[-1]
    probe = np.clip(u, 1e-4, 1 - 1e-4) if kind in ("norm", "gamma") else u
    return tuple(float(q) for q in np.interp(probe, cdf, x))
