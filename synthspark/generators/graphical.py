"""Log-linear models over public domains, kept as a junction tree of clique tables.

Columns that were measured together share a clique. A clique table has one row per combination of its columns' codes
and is a DataFrame, so what is stored grows with the cliques and not with the product of all domains. A marginal over any
columns is found by joins along the tree, each followed by a sum over the columns no longer needed. New factors enter
one clique and travel outwards as ratios of separator sums. Only the graph of columns is handled on the driver.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.session import scratch_path

Group = tuple[int, ...]
# Cells a task makes; small tables are one task and need no shuffle.
RANGE_ROWS = 200_000


def key(column: int) -> str:
    return f"_k{column}"


def keys(columns) -> list[str]:
    return [key(c) for c in sorted(columns)]


def cells(spark: SparkSession, sizes: list[int], columns) -> DataFrame:
    """One row per combination of the columns' codes, from a range that is spread over tasks."""
    columns = sorted(columns)
    stride = math.prod(sizes[c] for c in columns)
    table, out = spark.range(0, stride, 1, math.ceil(stride / RANGE_ROWS)), []
    for c in columns:
        stride //= sizes[c]
        out.append(F.expr(f"int(id div {stride} % {sizes[c]})").alias(key(c)))
    return table.select(*out)


def cell_number(sizes: list[int], columns):
    """Position of a combination of codes among all combinations of the columns."""
    number = F.lit(0).cast("long")
    for c in sorted(columns):
        number = number * sizes[c] + F.col(key(c))
    return number


def triangulated(sizes: list[int], groups: list[Group]) -> list[Group]:
    """Cliques of a chordal graph in which every group is complete.

    Columns leave one by one, first the one whose table with its remaining neighbours is smallest; these neighbours
    become a clique.
    """
    near: dict[int, set[int]] = {c: set() for c in range(len(sizes))}

    def connect(members) -> None:
        for a, b in itertools.permutations(members, 2):
            near[a].add(b)

    for g in groups:
        connect(g)
    left, cliques = set(near), []
    while left:
        around = {c: (near[c] & left) | {c} for c in left}
        first = min(left, key=lambda c: (math.prod(sizes[x] for x in around[c]), c))
        connect(around[first])
        left.remove(first)
        if not any(around[first] <= c for c in cliques):
            cliques.append(around[first])
    return [tuple(sorted(c)) for c in cliques]


def largest_table(sizes: list[int], groups: list[Group]) -> int:
    return max(math.prod(sizes[c] for c in clique) for clique in triangulated(sizes, groups))


def joined_up(cliques: list[Group]) -> dict[int, list[int]]:
    """Neighbours in a spanning forest of the cliques with the largest separators; cliques sharing no column stay apart."""
    pairs = [(len(set(a) & set(b)), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(cliques), 2)]
    part, edges = list(range(len(cliques))), {i: [] for i in range(len(cliques))}
    for shared, i, j in sorted(pairs, key=lambda p: (-p[0], p[1:])):
        if shared and part[i] != part[j]:
            edges[i].append(j)
            edges[j].append(i)
            part = [part[i] if p == part[j] else p for p in part]
    return edges


@dataclass
class JunctionTree:
    """Clique tables that agree on their separators; each sums to ``total``."""

    spark: SparkSession
    sizes: list[int]
    total: float
    cliques: list[Group]
    path: str
    edges: dict[int, list[int]] = field(init=False)

    def __post_init__(self):
        self.edges = joined_up(self.cliques)

    @classmethod
    def written(cls, spark: SparkSession, sizes: list[int], total: float, cliques: list[Group], tables: list[DataFrame]) -> JunctionTree:
        """Tree over tables of ``(codes, w)``, written once to the shared folder: later steps start from there."""
        path = scratch_path(spark, "cliques")
        every = range(len(sizes))
        rows = [
            t.select(F.lit(i).alias("clique"), *[(F.col(key(c)) if c in q else F.lit(None).cast("int")).alias(key(c)) for c in every], "w")
            for i, (q, t) in enumerate(zip(cliques, tables))
        ]
        reduce(DataFrame.union, rows).write.partitionBy("clique").parquet(path)
        return cls(spark, sizes, total, cliques, path)

    @classmethod
    def uniform(cls, spark: SparkSession, sizes: list[int], total: float) -> JunctionTree:
        """Independent columns, all values alike."""
        cliques = [(c,) for c in range(len(sizes))]
        tables = [cells(spark, sizes, q).withColumn("w", F.lit(total / sizes[q[0]])) for q in cliques]
        return cls.written(spark, sizes, total, cliques, tables)

    def table(self, i: int) -> DataFrame:
        stored = self.spark.read.schema(", ".join([*(f"{key(c)} int" for c in range(len(self.sizes))), "w double", "clique int"]))
        return stored.parquet(self.path).where(F.col("clique") == i).select(*keys(self.cliques[i]), "w")

    def parts(self) -> list[list[int]]:
        """Cliques of each tree of the forest, parents first."""
        seen: list[int] = []
        out = []
        for root in self.edges:
            if root in seen:
                continue
            part = [root]
            for i in part:
                part += [j for j in self.edges[i] if j not in part]
            seen += part
            out.append(part)
        return out

    def reach(self, group: Group) -> set[int]:
        """Columns that are not independent of the group's."""
        parts = [{c for i in part for c in self.cliques[i]} for part in self.parts()]
        return set().union(*[p for p in parts if p & set(group)])

    def holder(self, group: Group) -> int | None:
        """The smallest clique that has all columns of the group."""
        fits = [i for i, q in enumerate(self.cliques) if set(group) <= set(q)]
        return min(fits, key=lambda i: (math.prod(self.sizes[c] for c in self.cliques[i]), i), default=None)

    def marginal(self, wanted) -> DataFrame:
        """``(codes, w)`` over any columns. Columns without a path between them are independent."""
        wanted = set(wanted)
        found = []
        for part in self.parts():
            mine = wanted & {c for i in part for c in self.cliques[i]}
            if mine:
                root = max(part, key=lambda i: (len(mine & set(self.cliques[i])), -i))
                found.append(self._collected(root, None, mine).groupBy(*keys(mine)).agg(F.sum("w").alias("w")))
        if len(found) == 1:
            return found[0]
        out = cells(self.spark, self.sizes, wanted).withColumn("w", F.lit(self.total))
        for m in found:
            shared = [c for c in m.columns if c != "w"]
            out = out.join(m.withColumnRenamed("w", "_m"), shared).withColumn("w", F.col("w") * F.col("_m") / self.total).drop("_m")
        return out

    def marginals(self, groups: dict[int, Group]) -> DataFrame:
        """``(g, cell, w)`` of several groups; those of one clique come from one pass over it."""
        inside: dict[int | None, list[int]] = {}
        for g, columns in groups.items():
            inside.setdefault(self.holder(columns), []).append(g)

        def place(g: int):
            return F.struct(F.lit(g).alias("g"), cell_number(self.sizes, groups[g]).alias("cell"), F.col("w").alias("w"))

        across = [self.marginal(groups[g]).select(F.inline(F.array(place(g)))) for g in inside.pop(None, [])]
        held = [self.table(i).select(F.inline(F.array(*[place(g) for g in some]))) for i, some in inside.items()]
        return reduce(DataFrame.union, held + across).groupBy("g", "cell").agg(F.sum("w").alias("w"))

    def _below(self, i: int, parent: int | None) -> set[int]:
        return set(self.cliques[i]).union(*[self._below(j, i) for j in self.edges[i] if j != parent])

    def _collected(self, i: int, parent: int | None, wanted: set[int]) -> DataFrame:
        """Table of clique ``i`` with the wanted columns of all branches but the parent's."""
        table, have = self.table(i), set(self.cliques[i])
        for j in self.edges[i]:
            shared = set(self.cliques[i]) & set(self.cliques[j])
            more = wanted & self._below(j, i) - have if j != parent else set()
            if not more:
                continue
            branch = self._collected(j, i, wanted).groupBy(*keys(shared | more)).agg(F.sum("w").alias("_m"))
            whole = branch.groupBy(*keys(shared)).agg(F.sum("_m").alias("_whole"))
            share = branch.join(whole, keys(shared)).where("_whole > 0").withColumn("_m", F.col("_m") / F.col("_whole")).drop("_whole")
            table = table.join(share, keys(shared)).withColumn("w", F.col("w") * F.col("_m")).drop("_m")
            have |= more
        return table

    def over(self, groups: list[Group]) -> JunctionTree:
        """The same distribution on cliques that hold the given groups as well as those of this tree."""
        cliques = triangulated(self.sizes, [*self.cliques, *groups])
        return self.written(self.spark, self.sizes, self.total, cliques, [self.marginal(q) for q in cliques])

    def scaled(self, group: Group, factors: DataFrame) -> JunctionTree:
        """Weights times ``_f`` of their cell of the group; the factors must leave the total as it is."""
        start = self.holder(group)
        tables = {i: self.table(i) for i in range(len(self.cliques))}
        fresh = {start: tables[start].join(factors.select(*keys(group), "_f"), keys(group)).withColumn("_v", F.col("w") * F.col("_f")).drop("_f")}
        waiting = [start]
        for i in waiting:
            for j in self.edges[i]:
                if j in fresh:
                    continue
                shared = keys(set(self.cliques[i]) & set(self.cliques[j]))
                sums = fresh[i].groupBy(*shared).agg(F.sum("_v").alias("_v"), F.sum("w").alias("_w"))
                ratio = sums.select(*shared, F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).otherwise(0.0).alias("_r"))
                fresh[j] = tables[j].join(ratio, shared).withColumn("_v", F.col("w") * F.col("_r")).drop("_r")
                waiting.append(j)
        new = [fresh[i].drop("w").withColumnRenamed("_v", "w") if i in fresh else tables[i] for i in tables]
        return self.written(self.spark, self.sizes, self.total, self.cliques, new)

    def steps(self) -> list[tuple[int, Group, int]]:
        """``(column, columns drawn before it that it depends on, clique)`` in an order to draw columns one by one."""
        drawn: set[int] = set()
        out = []
        for part in self.parts():
            for i in part:
                given = drawn & set(self.cliques[i])
                for c in self.cliques[i]:
                    if c not in drawn:
                        out.append((c, tuple(sorted(given)), i))
                        given = given | {c}
                        drawn.add(c)
        return out
