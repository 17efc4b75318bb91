"""Junction trees against joint tables in memory, and multiplicative weights on domains too large for one."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthspark.generators import graphical as G
from synthspark.generators.private import Domain, mwem_synth

SIZES = [2, 3, 4, 2, 3]


def _array(table, columns, sizes=SIZES):
    out = np.zeros([sizes[c] for c in columns])
    for r in table.collect():
        out[tuple(r[G.key(c)] for c in columns)] += r["w"]
    return out


def _projected(joint, columns):
    return joint.sum(axis=tuple(i for i in range(joint.ndim) if i not in columns))


def test_cliques_cover_groups_and_run_together():
    groups = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)]
    cliques = G.triangulated(SIZES, groups)
    assert all(any(set(g) <= set(q) for q in cliques) for g in groups)
    edges = G.joined_up(cliques)
    for c in range(len(SIZES)):
        holding = [i for i, q in enumerate(cliques) if c in q]
        reached = holding[:1]
        for i in reached:
            reached += [j for j in edges[i] if j in holding and j not in reached]
        assert sorted(reached) == holding


def test_factors_and_marginals_equal_those_of_the_joint(spark):
    rng = np.random.default_rng(5)
    joint = np.full(SIZES, 100.0 / np.prod(SIZES))
    tree = G.JunctionTree.uniform(spark, SIZES, 100.0)
    for group in [(0, 1), (1, 2), (2, 3), (0, 3)]:
        target = rng.gamma(1.0, 1.0, [SIZES[c] for c in group])
        ratio = target / target.sum() * 100.0 / _projected(joint, group)
        joint = joint * ratio.reshape([SIZES[c] if c in group else 1 for c in range(len(SIZES))])
        rows = [(*map(int, at), float(ratio[at])) for at in np.ndindex(*ratio.shape)]
        factors = spark.createDataFrame(rows, ", ".join([*(f"{k} int" for k in G.keys(group)), "_f double"]))
        if tree.holder(group) is None:
            tree = tree.over([group])
        tree = tree.scaled(group, factors)
    assert max(len(q) for q in tree.cliques) == 3
    for wanted in [(0,), (1, 3), (0, 2), (1, 4), (0, 2, 3), (0, 1, 2, 3)]:
        np.testing.assert_allclose(_array(tree.marginal(wanted), wanted), _projected(joint, wanted), rtol=1e-9)


def test_weights_on_a_domain_of_many_cells(spark):
    """Three columns that only a three-column count explains, beside columns that make the domain large."""
    rows = spark.range(40_000).select(
        F.expr("cast(id % 2 as string)").alias("a"), F.expr("cast(id div 2 % 2 as string)").alias("b"),
        F.expr("cast((id + id div 2) % 2 as string)").alias("c"), F.expr("id % 1000 * 1.0D").alias("x"), F.expr("(id div 1000) * 1.0D").alias("y"),
        F.expr("cast(id % 3 as string)").alias("z"),
    )
    domains = {
        **{c: Domain(("0", "1")) for c in "abc"}, "x": Domain(low=0, high=1000, bins=5000), "y": Domain(low=0, high=40, bins=2000), "z": Domain(("0", "1", "2")),
    }
    assert np.prod([d.size for d in domains.values()]) > 1e8
    model = mwem_synth(rows, domains, 1.0, rounds=4, seed=3, workload=[("a", "b"), ("a", "b", "c"), ("z",), ("x", "y")], max_cells=100_000)
    assert ("a", "b", "c") in model.measured and ("x", "y") not in model.measured
    got = {(r["a"], r["b"], r["c"]): r["w"] for r in model.marginal(["a", "b", "c"]).collect()}
    for at in itertools.product(range(2), repeat=3):
        assert got[at] == pytest.approx(10_000 if at[2] == (at[0] + at[1]) % 2 else 0, abs=800)
    made = model.sample(8000, seed=1)
    right = made.agg(F.avg(F.expr("int(int(c) = (int(a) + int(b)) % 2)"))).first()[0]
    assert made.count() == 8000 and right > 0.9
    held = model.sample(2000, {"a": "1", "c": "0"}, seed=2)
    assert held.where("a <> '1' or c <> '0'").count() == 0
    assert held.agg(F.avg(F.expr("int(b = '1')"))).first()[0] > 0.9


def test_weights_without_rows(spark):
    empty = spark.createDataFrame([], "a string, x double")
    model = mwem_synth(empty, {"a": Domain(("p", "q")), "x": Domain(low=0, high=1, bins=4)}, 5.0, rounds=2, seed=1)
    assert model.sample(10).count() == 10
    with pytest.raises(ValueError):
        model.sample(5, {"a": "r"})
