"""Differentially private generators over public domains.

A domain names, for each column, its public categories or the public bounds and bin count of a number. No
domain is ever read from the data. Rows reach the mechanisms only as counts over domain cells; every count
gets integer noise. Neighbouring tables differ by one row.
"""

from __future__ import annotations

import itertools
import math
import os
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions import columns as C
from synthspark.functions.rng import normal_quantile, uniform
from synthspark.generators import graphical as G
from synthspark.generators.copula import ROW, partitions_for
from synthspark.session import stored

MAX_CELLS = 1_000_000
MAX_EPSILON = 100.0


@dataclass(frozen=True)
class Domain:
    """Public values of one column: a category list, or equal bins between public bounds."""

    values: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 0.0
    bins: int = 0

    @property
    def size(self) -> int:
        return self.bins or len(self.values)

    def code(self, df: DataFrame, name: str) -> Column:
        """Cell number; values outside the domain are null and count nowhere, numbers are clipped."""
        if self.bins:
            place = F.floor((C.as_double(df, name) - self.low) / (self.high - self.low) * self.bins)
            return F.least(F.lit(self.bins - 1), F.greatest(F.lit(0), place)).cast("int")
        known = F.array(*[F.lit(v) for v in self.values])
        return F.nullif(F.array_position(known, C.as_text(df, name)), F.lit(0)).cast("int") - 1

    def place(self, value: Any) -> int:
        """Cell number of one value; it must lie in the domain."""
        if self.bins:
            if not self.low <= float(value) <= self.high:
                raise ValueError(f"{value} lies outside the public bounds")
            return min(self.bins - 1, int((float(value) - self.low) / (self.high - self.low) * self.bins))
        if str(value) not in self.values:
            raise ValueError(f"'{value}' is not in the domain")
        return self.values.index(str(value))

    def value(self, code: Column, u: Column, dtype: T.DataType) -> Column:
        if self.bins:
            x = self.low + (code + u) * ((self.high - self.low) / self.bins)
            return (F.floor(x) if C.is_integer(dtype) else x).cast(dtype)
        return F.get(F.array(*[F.lit(v) for v in self.values]), code).cast(dtype)


Domains = dict[str, Domain]


def check_budget(epsilon: float, delta: float = 1e-5) -> None:
    if not 0 < epsilon <= MAX_EPSILON:
        raise ValueError(f"epsilon must be above 0 and at most {MAX_EPSILON:g}")
    if not 0 < delta < 1:
        raise ValueError("delta must lie strictly between 0 and 1")


def dp_categorical_columns(types: DataFrame) -> DataFrame:
    """Columns a private generator treats as categories, from detected types."""
    return types.filter(F.col("sdtype").isin("categorical", "boolean", "id")).select("column", "sdtype")


def secret_seed() -> int:
    """Noise seed from the operating system; a fixed seed belongs in tests only."""
    return int.from_bytes(os.urandom(32), "big")


def _secret_uniform(key: Column, label: str, seed: int) -> Column:
    """Uniform double inside (0, 1) from a cryptographic hash of the secret seed and the cell."""
    digest = F.sha2(F.concat_ws(":", F.lit(f"{seed}:{label}"), key.cast("string")), 256)
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _check_cells(domains: Domains, groups: list[tuple[str, ...]]) -> None:
    cells = sum(math.prod(domains[c].size for c in g) for g in groups)
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} domain cells exceed {MAX_CELLS}; use coarser public domains")


def _cell_counts(df: DataFrame, domains: Domains, groups: list[tuple[str, ...]]) -> DataFrame:
    """``(g, a, b, n)``: exact counts of occupied cells of one- and two-column groups in one shuffle."""
    codes = df.select(*[d.code(df, c).alias(c) for c, d in domains.items()])
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("g"), C.quoted(g[0]).alias("a"), (C.quoted(g[1]) if len(g) > 1 else F.lit(0)).alias("b"))
            for i, g in enumerate(groups)
        ]
    )
    long = codes.select(F.inline(cells)).filter("a is not null and b is not null")
    return long.groupBy("g", "a", "b").agg(F.count("*").alias("n"))


def _domain_cells(spark: SparkSession, domains: Domains, groups: list[tuple[str, ...]]) -> DataFrame:
    """All cells of all groups, occupied or not, so that no release depends on which cells exist."""
    sizes = spark.createDataFrame(
        [(i, domains[g[0]].size, domains[g[1]].size if len(g) > 1 else 1) for i, g in enumerate(groups)], "g int, sa int, sb int"
    )
    rows = sizes.select("g", "sb", F.explode(F.sequence(F.lit(0), F.col("sa") - 1)).alias("a"))
    return rows.select("g", "a", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("b"))


def _tail(x: float) -> float:
    """Upper tail of the standard normal distribution."""
    return math.erfc(x / math.sqrt(2)) / 2


def gaussian_scale(epsilon: float, delta: float) -> float:
    """Smallest scale at which Gaussian noise on a count (sensitivity 1) is (epsilon, delta)-private, for any epsilon.

    Solves the exact condition ``Phi(1/2s - e s) - exp(e) Phi(-1/2s - e s) <= delta``, which falls with ``s``.
    """

    def exceeds(s: float) -> bool:
        lost = _tail(epsilon * s + 1 / (2 * s))
        return _tail(epsilon * s - 1 / (2 * s)) - (math.exp(epsilon + math.log(lost)) if lost > 0 else 0.0) > delta

    low, high = 1e-6, 1.0
    while exceeds(high):
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if exceeds(middle) else (low, middle)
    return high


def _noise(key: Column, epsilon: float, delta: float | None, seed: int) -> Column:
    """Integer noise for a count: two-sided geometric, or rounded Gaussian when a delta is given."""
    if delta is None:
        decay = -1.0 / epsilon
        one = F.floor(F.log(_secret_uniform(key, "n1", seed)) * decay)
        two = F.floor(F.log(_secret_uniform(key, "n2", seed)) * decay)
        return (one - two).cast("long")
    sigma = gaussian_scale(epsilon, delta)
    return F.round(normal_quantile(_secret_uniform(key, "n", seed)) * sigma).cast("long")


def noisy_counts(
    df: DataFrame, domains: Domains, groups: list[tuple[str, ...]], epsilon: float, delta: float | None, seed: int | None
) -> DataFrame:
    """``(g, a, b, n)`` with noise on every cell, floored at 0; each group gets an equal part of epsilon."""
    _check_cells(domains, groups)
    seed = secret_seed() if seed is None else seed
    part = epsilon / len(groups)
    cells = _domain_cells(df.sparkSession, domains, groups)
    counts = _cell_counts(df, domains, groups)
    # The exact counts are bounded by the domain, which was just checked.
    joined = cells.join(F.broadcast(counts), ["g", "a", "b"], "left")
    key = F.concat_ws(":", "g", "a", "b")
    noisy = F.coalesce("n", F.lit(0)) + _noise(key, part, None if delta is None else delta / len(groups), seed)
    return joined.select("g", "a", "b", F.greatest(F.lit(0).cast("long"), noisy).alias("n"))


def dp_marginals(
    df: DataFrame,
    domains: Domains,
    epsilon: float,
    delta: float = 1e-5,
    mechanism: str = "laplace",
    pairs: list[tuple[str, str]] | None = None,
    seed: int | None = None,
) -> DataFrame:
    """``(marginal, cell, n)``: noisy one-column counts and, when asked for, two-column counts."""
    check_budget(epsilon, delta)
    if mechanism not in ("laplace", "gaussian"):
        raise ValueError(f"unknown mechanism '{mechanism}'")
    groups = [(c,) for c in domains] + list(pairs or [])
    counts = noisy_counts(df, domains, groups, epsilon, delta if mechanism == "gaussian" else None, seed)
    names = F.array(*[F.lit(",".join(g)) for g in groups])

    def label(i: int, code: str) -> Column:
        options = F.lit(None).cast("string")
        for k, g in enumerate(groups):
            if i < len(g):
                d = domains[g[i]]
                text = F.get(F.array(*[F.lit(v) for v in d.values]), F.col(code)) if d.values else F.col(code).cast("string")
                options = F.when(F.col("g") == k, text).otherwise(options)
        return options

    return counts.select(F.get(names, F.col("g")).alias("marginal"), F.concat_ws("|", label(0, "a"), label(1, "b")).alias("cell"), "n")


# --- tree-structured generators ----------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Noisy root shares and noisy conditional shares down a tree of columns."""

    spark: SparkSession
    domains: Domains
    dtypes: dict[str, T.DataType]
    root: str
    root_shares: np.ndarray
    edges: list[tuple[str, str]]
    conditionals: dict[tuple[str, str], np.ndarray]
    epsilon_spent: float

    def sample(self, n: int, conditions: dict[str, Any] | None = None, seed: int = 0) -> DataFrame:
        if conditions:
            raise ValueError("a private tree model cannot hold columns fixed")
        rows = self.spark.range(0, n, 1, partitions_for(self.spark, n)).withColumnRenamed("id", ROW)
        row = F.col(ROW)
        cut = C.doubles(np.cumsum(self.root_shares)[:-1])
        rows = rows.withColumn(f"_c_{self.root}", self._place(cut, uniform(row, f"c:{self.root}", seed), len(self.root_shares)))
        for a, b in self.edges:
            table = np.cumsum(self.conditionals[(a, b)], axis=1)
            lookup = self.spark.createDataFrame(
                [(i, [float(x) for x in line[:-1]]) for i, line in enumerate(table)], f"`_c_{a}` int, _cut array<double>"
            )
            # One row per parent cell: the checked domain bounds what is broadcast.
            rows = rows.join(F.broadcast(lookup), f"_c_{a}")
            rows = rows.withColumn(
                f"_c_{b}", self._place(F.col("_cut"), uniform(row, f"c:{b}", seed), table.shape[1])
            ).drop("_cut")
        return rows.select(
            *[
                d.value(F.col(f"_c_{c}"), uniform(row, f"v:{c}", seed), self.dtypes[c]).alias(c)
                for c, d in self.domains.items()
            ]
        )

    @staticmethod
    def _place(cuts: Column, u: Column, size: int) -> Column:
        if size == 1:
            return F.lit(0)
        return F.size(F.filter(cuts, lambda c: c <= u))


def _shares(counts: np.ndarray, axis: int | None = None) -> np.ndarray:
    counts = counts + 1e-9
    return counts / counts.sum(axis=axis, keepdims=axis is not None)


def _arrays(counts: DataFrame, domains: Domains, groups: list[tuple[str, ...]]) -> list[np.ndarray]:
    """Counts as driver arrays; the checked domain bounds them."""
    out = [np.zeros((domains[g[0]].size, domains[g[1]].size if len(g) > 1 else 1)) for g in groups]
    for r in counts.collect():
        out[r["g"]][r["a"], r["b"]] = r["n"]
    return out


def _choose(scores: dict, epsilon: float, sensitivity: float, rng: np.random.Generator):
    """Exponential mechanism through Gumbel noise."""
    best = {k: epsilon * s / (2 * sensitivity) + rng.gumbel() for k, s in scores.items()}
    return max(best, key=best.get)


def _tree_model(df, domains, singles, edges, joints, spent) -> TreeModel:
    root = edges[0][0] if edges else next(iter(domains))
    dtypes = {c: df.schema[c].dataType for c in domains}
    conditionals = {e: _shares(joints[e], axis=1) for e in edges}
    return TreeModel(df.sparkSession, domains, dtypes, root, _shares(singles[root]), edges, conditionals, spent)


def _rooted(names: list[str], chosen: list[tuple[str, str]], joints: dict) -> tuple[list[tuple[str, str]], dict]:
    """Direct undirected edges away from the first column; joint counts are turned to match."""
    seen, order, out = [names[0]], [], {}
    pending = list(chosen)
    while len(seen) < len(names):
        a, b = next(e for e in pending if (e[0] in seen) != (e[1] in seen))
        pending.remove((a, b))
        edge, joint = ((a, b), joints[(a, b)]) if a in seen else ((b, a), joints[(a, b)].T)
        order.append(edge)
        out[edge] = joint
        seen.append(edge[1])
    return order, out


def mst_synth(df: DataFrame, domains: Domains, epsilon: float, delta: float = 1e-5, seed: int | None = None) -> TreeModel:
    """Noisy one-column counts, privately chosen spanning tree, noisy counts along its edges.

    A third of epsilon goes to each step.
    """
    check_budget(epsilon, delta)
    seed = secret_seed() if seed is None else seed
    rng = np.random.default_rng(seed)
    names = list(domains)
    part = epsilon / 3 if len(names) > 1 else epsilon
    one = [(c,) for c in names]
    singles = {c: a[:, 0] for c, a in zip(names, _arrays(noisy_counts(df, domains, one, part, None, seed), domains, one))}
    chosen: list[tuple[str, str]] = []
    joints: dict = {}
    if len(names) > 1:
        pairs = list(itertools.combinations(names, 2))
        _check_cells(domains, pairs)
        exact = dict(zip(pairs, _arrays(_cell_counts(df, domains, pairs), domains, pairs)))
        group = {c: i for i, c in enumerate(names)}
        for _ in range(len(names) - 1):
            open_pairs = [p for p in pairs if group[p[0]] != group[p[1]]]
            scores = {p: _dependence(exact[p], singles[p[0]], singles[p[1]]) for p in open_pairs}
            # One row moves a cell by 1 and the independent estimate not at all.
            pick = _choose(scores, part / (len(names) - 1), 1.0, rng)
            chosen.append(pick)
            old, new = group[pick[1]], group[pick[0]]
            group = {c: new if g == old else g for c, g in group.items()}
        joints = dict(zip(chosen, _arrays(noisy_counts(df, domains, chosen, part, None, seed + 1), domains, chosen)))
    edges, joints = _rooted(names, chosen, joints)
    return _tree_model(df, domains, singles, edges, joints, epsilon)


def _dependence(joint: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Distance of joint counts from the product of noisy one-column counts."""
    total = max(left.sum(), 1.0)
    return float(np.abs(joint - np.outer(left, right) / total * (total / max(right.sum(), 1.0))).sum())


def aim_synth(
    df: DataFrame, domains: Domains, epsilon: float, delta: float = 1e-5, seed: int | None = None
) -> TreeModel:
    """Adaptive variant limited to trees: choose one pair, measure it, refine the columns it covers, repeat.

    Selection weighs the expected gain against the noise of measuring the pair, and the refined one-column
    counts feed the next choice. Half of epsilon goes to columns, half to the rounds.
    """
    check_budget(epsilon, delta)
    seed = secret_seed() if seed is None else seed
    rng = np.random.default_rng(seed)
    names = list(domains)
    rounds = max(len(names) - 1, 0)
    part = epsilon / 2 if rounds else epsilon
    one = [(c,) for c in names]
    singles = {c: a[:, 0] for c, a in zip(names, _arrays(noisy_counts(df, domains, one, part, None, seed), domains, one))}
    weight = {c: (part / len(names)) ** 2 for c in names}
    chosen: list[tuple[str, str]] = []
    joints: dict = {}
    if rounds:
        pairs = list(itertools.combinations(names, 2))
        _check_cells(domains, pairs)
        exact = dict(zip(pairs, _arrays(_cell_counts(df, domains, pairs), domains, pairs)))
        group = {c: i for i, c in enumerate(names)}
        each = part / rounds
        for i in range(rounds):
            noise = 2.0 / each
            scores = {
                p: _dependence(exact[p], singles[p[0]], singles[p[1]]) - noise * exact[p].size
                for p in pairs
                if group[p[0]] != group[p[1]]
            }
            pick = _choose(scores, each / 2, 1.0, rng)
            joint = _arrays(noisy_counts(df, domains, [pick], each / 2, None, seed + 1 + i), domains, [pick])[0]
            for c, axis in ((pick[0], 1), (pick[1], 0)):
                # Inverse-variance mean of the two measurements of a column.
                own = (each / 2) ** 2 / joint.shape[axis]
                singles[c] = (singles[c] * weight[c] + joint.sum(axis=axis) * own) / (weight[c] + own)
                weight[c] += own
            chosen.append(pick)
            joints[pick] = joint
            old, new = group[pick[1]], group[pick[0]]
            group = {c: new if g == old else g for c, g in group.items()}
    edges, joints = _rooted(names, chosen, joints)
    return _tree_model(df, domains, singles, edges, joints, epsilon)


# --- multiplicative weights --------------------------------------------------------------------------------


def _group_cells(df: DataFrame, domains: Domains, groups: list[G.Group]) -> DataFrame:
    """``(g, cell, n)``: exact counts of the occupied cells of groups of any width, and of all rows as group -1; one scan."""
    sizes = [d.size for d in domains.values()]
    codes = df.select(*[d.code(df, c).alias(G.key(i)) for i, (c, d) in enumerate(domains.items())])
    places = [F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("cell"))]
    places += [F.struct(F.lit(i).alias("g"), G.cell_number(sizes, g).alias("cell")) for i, g in enumerate(groups)]
    return codes.select(F.inline(F.array(*places))).where("cell is not null").groupBy("g", "cell").agg(F.count("*").alias("n"))


@dataclass
class GraphicalModel:
    """Junction tree over the columns that were measured together."""

    tree: G.JunctionTree
    domains: Domains
    dtypes: dict[str, T.DataType]
    measured: list[tuple[str, ...]]
    epsilon_spent: float

    def marginal(self, columns: list[str]) -> DataFrame:
        """``(one code per column, w)``: the model's counts over the columns' domains."""
        names = list(self.domains)
        return self.tree.marginal([names.index(c) for c in columns]).select(*[F.col(G.key(names.index(c))).alias(c) for c in columns], "w")

    def given(self, conditions: dict[str, Any]) -> G.JunctionTree:
        """The tree with columns held at values: other cells of these columns have no weight."""
        tree, names = self.tree, list(self.domains)
        for c, value in conditions.items():
            if c not in self.domains:
                raise ValueError(f"column '{c}' is not in the domain")
            column = names.index(c)
            code = self.domains[c].place(value)
            held = tree.marginal((column,))
            factors = held.withColumn("_f", F.when(F.col(G.key(column)) == code, F.lit(tree.total) / F.col("w")).otherwise(0.0))
            tree = tree.scaled((column,), factors)
        return tree

    def sample(self, n: int, conditions: dict[str, Any] | None = None, seed: int = 0) -> DataFrame:
        """Columns are drawn one by one, each by its shares given the drawn columns of its clique."""
        conditions = conditions or {}
        tree, spark, names = self.given(conditions), self.tree.spark, list(self.domains)
        rows = spark.range(0, n, 1, partitions_for(spark, n)).withColumnRenamed("id", ROW)
        for column, before, clique in tree.steps():
            own, known = G.key(column), G.keys(before)
            weights = tree.table(clique).groupBy(*known, own).agg(F.sum("w").alias("w"))
            running = Window.partitionBy(*known).orderBy(own)
            share = weights.withColumn("_cut", F.sum("w").over(running) / F.nullif(F.sum("w").over(Window.partitionBy(*known)), F.lit(0.0)))
            # All but the last cut, which is one but for rounding.
            lists = share.where(F.col(own) < self.domains[names[column]].size - 1).groupBy(*known)
            cuts = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct(own, "_cut"))), lambda x: x["_cut"]).alias("_cuts"))
            u = uniform(F.col(ROW), f"c:{names[column]}", seed)
            if self.domains[names[column]].size == 1:
                rows = rows.withColumn(own, F.lit(0))
            elif known:
                rows = rows.join(cuts, known).withColumn(own, TreeModel._place(F.col("_cuts"), u, 0)).drop("_cuts")
            else:
                # The values of one column, bounded by its public domain.
                rows = rows.withColumn(own, TreeModel._place(C.doubles(cuts.first()["_cuts"]), u, 0))
        out = []
        for i, (c, d) in enumerate(self.domains.items()):
            drawn = d.value(F.col(G.key(i)), uniform(F.col(ROW), f"v:{c}", seed), self.dtypes[c])
            out.append((F.lit(conditions[c]).cast(self.dtypes[c]) if c in conditions else drawn).alias(c))
        return rows.select(*out)


def mwem_synth(
    df: DataFrame,
    domains: Domains,
    epsilon: float,
    delta: float = 1e-5,
    rounds: int | None = None,
    seed: int | None = None,
    width: int = 2,
    workload: list[tuple[str, ...]] | None = None,
    max_cells: int = MAX_CELLS,
    sweeps: int = 1,
) -> GraphicalModel:
    """Multiplicative weights driven by privately chosen counts over groups of up to ``width`` columns, or a given workload.

    Each round picks the group on which the model is furthest off, measures it with noise and scales the model's cells
    towards the measurement; ``sweeps`` more passes go over all measurements at the end. The weights are a junction
    tree, so the domain as a whole may have any number of cells; ``max_cells`` bounds the largest clique, and a group that
    would need a larger one is never a candidate, which depends on the public domains alone. The table is read once. A
    twentieth of epsilon goes to the row count.
    """
    check_budget(epsilon, delta)
    spark, names = df.sparkSession, list(domains)
    sizes = [domains[c].size for c in names]
    if workload is None:
        groups = [g for k in range(1, min(width, len(names)) + 1) for g in itertools.combinations(range(len(names)), k)]
    else:
        groups = [tuple(sorted(names.index(c) for c in g)) for g in workload]
    seed = secret_seed() if seed is None else seed
    rng = np.random.default_rng(seed)
    rounds = rounds or max(2 * len(names), 4)
    counts = stored(_group_cells(df, domains, groups), "group-cells")
    count_part, part = epsilon / 20, epsilon * 19 / 20 / rounds
    rows = counts.where("g = -1").first()
    total = max(float((rows["n"] if rows else 0) + _integer_noise(rng, count_part, ())), 1.0)
    tree = G.JunctionTree.uniform(spark, sizes, total)
    measured: list[tuple[G.Group, DataFrame]] = []
    off: dict[int, float] = {}
    touched: set[int] = set()

    for turn in range(rounds):
        open_groups = [i for i, g in enumerate(groups) if tree.holder(g) is not None or G.largest_table(sizes, [*tree.cliques, g]) <= max_cells]
        if not open_groups:
            break
        # A group none of whose columns the last step could reach has the answer it had.
        stale = [i for i in open_groups if i not in off or touched & set(groups[i])]
        if stale:
            apart = tree.marginals({i: groups[i] for i in stale}).join(counts, ["g", "cell"], "left")
            found = apart.groupBy("g").agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.col("w"))).alias("off")).collect()
            off |= {r["g"]: r["off"] for r in found}
        # What a measurement would be off by itself: the mean size of two-sided geometric noise is below 2 / epsilon.
        scores = {i: off[i] - math.prod(sizes[c] for c in groups[i]) * 2 / part for i in open_groups}
        pick = _choose(scores, part / 2, 1.0, rng)
        group = groups[pick]
        own = counts.where(F.col("g") == pick).select("cell", "n")
        every = G.cells(spark, sizes, group).withColumn("cell", G.cell_number(sizes, group)).join(own, "cell", "left")
        noisy = F.coalesce("n", F.lit(0)) + _noise(F.concat_ws(":", F.lit(turn), "cell"), part / 2, None, seed)
        seen = stored(every.select(*G.keys(group), F.greatest(F.lit(0), noisy).cast("double").alias("y")), "measured")
        measured.append((group, seen))
        if tree.holder(group) is None:
            tree = tree.over([group])
        tree = _agreeing(tree, group, seen)
        touched = tree.reach(group)
    for _ in range(sweeps):
        for group, seen in measured:
            tree = _agreeing(tree, group, seen)
    dtypes = {c: df.schema[c].dataType for c in names}
    chosen = list(dict.fromkeys(tuple(names[c] for c in g) for g, _ in measured))
    return GraphicalModel(tree, domains, dtypes, chosen, epsilon)


def _agreeing(tree: G.JunctionTree, group: G.Group, seen: DataFrame) -> G.JunctionTree:
    """Tree scaled on the group's cells towards measured counts, by a factor of 20 at most either way."""
    both = tree.marginal(group).join(seen, G.keys(group))
    ratio = (F.col("y") + 0.5) / (F.col("w") + 0.5)
    step = both.withColumn("_f", F.least(F.lit(20.0), F.greatest(F.lit(0.05), ratio)))
    whole = step.agg(F.sum(F.col("w") * F.col("_f"))).first()[0]
    return tree.scaled(group, step.withColumn("_f", F.col("_f") * (tree.total / whole)))


def _integer_noise(rng: np.random.Generator, epsilon: float, shape) -> np.ndarray:
    """Two-sided geometric noise."""
    p = 1 - math.exp(-epsilon)
    return rng.geometric(p, shape) - rng.geometric(p, shape)
