"""Linked tables: parents carry the number of their children, children share an effect of their parent.

Row targets are met exactly, keys are fresh and dense, and no child is an orphan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.distribution import chunked_running_totals
from synthspark.functions.rng import md5_index, uniform, with_normals
from synthspark.generators.copula import ROW, CopulaModel, _combine, copula_fit, factor_of, partitions_for
from synthspark.generators.marginals import normal_scores
from synthspark.operators.constraints import parents_first
from synthspark.operators.profile import sdtypes as detect
from synthspark.session import stored
from synthspark.spec import Relationship

CHUNK = 100_000
# Children of one parent are made in blocks of this size, so a parent with most children is many tasks.
BLOCK = 10_000


def _count_name(rel: Relationship) -> str:
    return f"__n_{rel.child_table}_{rel.child_key}"


@dataclass
class TableModel:
    """Copula of a table without keys, with one child-count column per outgoing link."""

    name: str
    columns: list[str]
    copula: CopulaModel
    own_keys: dict[str, object]
    main: Relationship | None
    others: list[Relationship]
    shared: list[float] = field(default_factory=list)
    foreign_types: dict[str, object] = field(default_factory=dict)


@dataclass
class LinkedModel:
    spark: SparkSession
    tables: dict[str, TableModel]
    relationships: list[Relationship]

    def sample(self, rows: dict[str, int], seed: int = 0) -> dict[str, DataFrame]:
        """One frame per table with exactly the asked number of rows."""
        missing = set(self.tables) - set(rows)
        if missing:
            raise ValueError(f"row targets are missing for {sorted(missing)}")
        raw: dict[str, DataFrame] = {}
        for name in _table_order(self.tables, self.relationships):
            made = self._sample_table(self.tables[name], raw, rows, seed)
            # A parent is read several times by its children: once stored, no level recomputes those above it.
            raw[name] = stored(made, name) if any(r.parent_table == name for r in self.relationships) else made
        return {n: raw[n].select(*[C.quoted(c) for c in self.tables[n].columns]) for n in self.tables}

    def _sample_table(self, model: TableModel, raw: dict[str, DataFrame], rows: dict[str, int], seed: int) -> DataFrame:
        n = rows[model.name]
        if model.main is None:
            base = self.spark.range(0, n, 1, partitions_for(self.spark, n)).withColumnRenamed("id", ROW)
            latent = model.copula.latent(base, None, seed)
        else:
            base = children_of(raw[model.main.parent_table], _count_name(model.main), n)
            latent = self._with_parent_effect(model, model.copula.latent(base, None, seed), seed)
        keep = [ROW] + (["__parent"] if model.main else [])
        out = model.copula.decode(latent, None, seed, keep=keep)
        for key, kind in model.own_keys.items():
            out = out.withColumn(key, _key_value(F.col(ROW), key, kind))
        if model.main:
            out = out.withColumn(model.main.child_key, self._reference(F.col("__parent"), model, model.main))
        for rel in model.others:
            pick = md5_index(F.col(ROW), f"{rel.child_key}:{seed}", rows[rel.parent_table])
            out = out.withColumn(rel.child_key, self._reference(pick, model, rel))
        return out

    def _reference(self, row: Column, model: TableModel, rel: Relationship) -> Column:
        """Value of the parent key that ``rel`` names, for a row number of the parent."""
        kind = self.tables[rel.parent_table].own_keys[rel.parent_key]
        return _key_value(row, rel.parent_key, kind).cast(model.foreign_types[rel.child_key])

    def _with_parent_effect(self, model: TableModel, latent: DataFrame, seed: int) -> DataFrame:
        """Mix each score with one drawn per parent, in the share of variance that lies between parents."""
        joint = model.copula.joint
        d = len(joint)
        if d == 0:
            return latent
        parent = F.col("__parent")
        latent = latent.select("*", *[uniform(parent, f"p:{model.name}:{m.name}", seed).alias(f"_pu{i}") for i, m in enumerate(joint)])
        latent = with_normals(latent, {f"_pu{i}": f"_pz{i}" for i in range(d)})
        factor = factor_of(model.copula.correlation)
        mixed = []
        for i in range(d):
            a = model.shared[i]
            effect = _combine([(factor[i, k], f"_pz{k}") for k in range(d)])
            mixed.append((math.sqrt(a) * effect + math.sqrt(1 - a) * F.col(f"_y{i}")).alias(f"_y{i}"))
        return latent.select(ROW, "__parent", *mixed)


def _key_value(row: Column, name: str, dtype) -> Column:
    if C.is_numeric(dtype):
        return (row + 1).cast(dtype)
    return F.concat(F.lit(f"{name}-"), F.lpad((row + 1).cast("string"), 12, "0"))


def _table_order(tables: dict, relationships: list[Relationship]) -> list[str]:
    order = [n for n in tables if all(r.child_table != n for r in relationships)]
    for rel in parents_first(relationships):
        for name in (rel.parent_table, rel.child_table):
            if name not in order:
                order.append(name)
    # A child comes after all of its parents.
    done: list[str] = []
    while len(done) < len(order):
        ready = [n for n in order if n not in done and all(r.parent_table in done for r in relationships if r.child_table == n)]
        if not ready:
            raise ValueError("the links between the tables form a cycle")
        done += ready
    return done


def apportion(parents: DataFrame, weight: str, target: int) -> DataFrame:
    """Add ``_first`` and ``_many``: consecutive child numbers that add up to the target exactly.

    Children are ``floor(C_i T / S) - floor(C_(i-1) T / S)`` for running sums ``C`` of the weights, taken in
    chunks of the dense row number.
    """
    weighted = parents.withColumn("_w", F.round(F.greatest(F.lit(0.0), F.col(weight).cast("double")) * 1024).cast("long"))
    weighted = weighted.withColumn("_chunk", F.floor(F.col(ROW) / CHUNK))
    total = weighted.agg(F.sum("_w").alias("s"), F.count("*").alias("n")).first()
    if not total["s"]:
        weighted = weighted.withColumn("_w", F.lit(1).cast("long"))
        total = {"s": total["n"], "n": total["n"]}
    running = chunked_running_totals(weighted, [], "_chunk", [ROW], ["_w"])
    whole = float(total["s"])
    upto = F.floor(F.col("cum__w") / whole * target)
    before = F.floor((F.col("cum__w") - F.col("_w")) / whole * target)
    return running.withColumn("_first", before).withColumn("_many", upto - before).drop("_w", "_chunk", "cum__w")


def children_of(parents: DataFrame, weight: str, target: int) -> DataFrame:
    """``(__row, __parent)``: one row per child, numbered densely; children spread in blocks over tasks."""
    counted = apportion(parents.select(ROW, weight), weight, target).filter("_many > 0")
    last = F.floor((F.col("_many") - 1) / BLOCK)
    blocks = counted.select(ROW, "_first", "_many", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))
    spread = blocks.repartition(partitions_for(parents.sparkSession, target), ROW, "_block")
    start = F.col("_block") * BLOCK
    end = F.least(start + BLOCK, F.col("_many")) - 1
    return spread.select(
        F.col(ROW).alias("__parent"), "_first", F.explode(F.sequence(start, end)).alias("_j")
    ).select((F.col("_first") + F.col("_j")).alias(ROW), "__parent")


def hma_fit(tables: dict[str, DataFrame], relationships: list[Relationship], sdtypes: dict[str, dict[str, str]] | None = None) -> LinkedModel:
    """Fit every table. The first link of a child decides its number per parent; further keys are drawn."""
    models = {}
    for name, df in tables.items():
        outgoing = [r for r in relationships if r.parent_table == name]
        incoming = [r for r in relationships if r.child_table == name]
        own = {r.parent_key: df.schema[r.parent_key].dataType for r in outgoing}
        main = incoming[0] if incoming else None
        keys = {*own, *[r.child_key for r in incoming]}
        plain = df
        main_links = [r for r in outgoing if _main_link(relationships, r.child_table) == r]
        for rel in main_links:
            counts = tables[rel.child_table].groupBy(C.quoted(rel.child_key).alias("__k")).agg(F.count("*").alias(_count_name(rel)))
            plain = plain.join(counts, C.quoted(rel.parent_key) == F.col("__k"), "left").drop("__k")
            plain = plain.withColumn(_count_name(rel), F.coalesce(_count_name(rel), F.lit(0)).cast("double"))
        modelled = plain.drop(*keys)
        kinds = {c: k for c, k in (sdtypes or {}).get(name, {}).items() if c in modelled.columns}
        if kinds:
            kinds.update({_count_name(r): "numerical" for r in main_links})
        elif main_links:
            kinds = {**detect(modelled), **{_count_name(r): "numerical" for r in main_links}}
        copula = copula_fit(modelled, kinds or None, "empirical")
        model = TableModel(
            name, df.columns, copula, own, main, [r for r in incoming if r != main],
            foreign_types={r.child_key: df.schema[r.child_key].dataType for r in incoming},
        )
        if main:
            model.shared = _between_shares(plain, main.child_key, copula)
        models[name] = model
    return LinkedModel(next(iter(tables.values())).sparkSession, models, relationships)


def _main_link(relationships: list[Relationship], child: str) -> Relationship:
    return next(r for r in relationships if r.child_table == child)


def _between_shares(df: DataFrame, key: str, copula: CopulaModel) -> list[float]:
    """Share of each score's variance that lies between parents (one-way analysis of variance)."""
    joint = copula.joint
    if not joint:
        return []
    scores = normal_scores(df, joint, [C.quoted(key)])
    sums = scores.groupBy("_keep0").agg(
        *[F.count(f"s{i}").alias(f"n{i}") for i in range(len(joint))],
        *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(joint))],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"q{i}") for i in range(len(joint))],
    )
    aggs = []
    for i in range(len(joint)):
        some = F.col(f"n{i}") > 0
        aggs += [
            F.count_if(some).alias(f"k{i}"),
            F.sum(f"n{i}").alias(f"n{i}"),
            F.sum(F.col(f"n{i}") * F.col(f"n{i}")).cast("double").alias(f"nn{i}"),
            F.sum(f"t{i}").alias(f"t{i}"),
            F.sum(f"q{i}").alias(f"q{i}"),
            F.sum(F.when(some, F.col(f"t{i}") * F.col(f"t{i}") / F.col(f"n{i}"))).alias(f"b{i}"),
        ]
    row = sums.agg(*aggs).first()
    out = []
    for i in range(len(joint)):
        k, n = row[f"k{i}"] or 0, row[f"n{i}"] or 0
        if k < 2 or n <= k:
            out.append(0.0)
            continue
        between = (row[f"b{i}"] - row[f"t{i}"] ** 2 / n) / (k - 1)
        within = (row[f"q{i}"] - row[f"b{i}"]) / (n - k)
        size = (n - row[f"nn{i}"] / n) / (k - 1)
        share = (between - within) / (between + (size - 1) * within) if within > 0 else 1.0
        out.append(float(np.clip(share, 0.0, 1.0)))
    return out


def hma_synth(
    tables: dict[str, DataFrame], relationships: list[Relationship], rows: dict[str, int] | None = None, seed: int = 0
) -> dict[str, DataFrame]:
    """Fit linked tables and sample them; without targets every table keeps its size."""
    if len(tables) < 2:
        raise ValueError("linked generation needs at least two tables")
    rows = rows or {n: t.count() for n, t in tables.items()}
    return hma_fit(tables, relationships).sample(rows, seed)
