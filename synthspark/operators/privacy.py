"""Disclosure risk of a synthetic table and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.distribution import value_counts
from synthspark.operators.neighbours import nearest
from synthspark.session import stored
from synthspark.spec import FIDELITY_THRESHOLD, PRIVACY_THRESHOLD


def _adjusted(attack: Column, control: Column) -> Column:
    """Attack success beyond what the control shows, on a scale of 0 to 1."""
    return F.greatest(F.lit(0.0), F.when(control < 1, (attack - control) / (1 - control)).otherwise(0.0))


def _rate(hits: Column, attempts: Column) -> Column:
    return F.when(attempts > 0, hits / attempts).otherwise(0.0)


def _tagged(real: DataFrame, synthetic: DataFrame, control: DataFrame, names: list[str]) -> DataFrame:
    parts = []
    for side, df in (("real", real), ("syn", synthetic), ("control", control)):
        parts.append(df.select(*[C.quoted(c).cast(real.schema[c].dataType).alias(c) for c in names], F.lit(side).alias("_side")))
    return C.union_all(parts)


def _side_flags() -> dict[str, Column]:
    return {f"n_{s}": F.col("_side") == s for s in ("real", "syn", "control")}


def singling_out_univariate(real: DataFrame, synthetic: DataFrame, control: DataFrame, names: list[str]) -> DataFrame:
    """``(attempts, attack_rate, control_rate, risk)`` of one-column predicates read off the synthetic table.

    Predicates are: equal to a value the synthetic table holds once; below its minimum; above its maximum.
    One succeeds when it matches exactly one row. Control rows stand for people outside the real table.
    """
    both = _tagged(real, synthetic, control, names)
    counts = value_counts(both, names, _side_flags())
    equal = counts.filter("n_syn = 1").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("n_real") == 1).alias("hits"), F.count_if(F.col("n_control") == 1).alias("control_hits")
    )
    numbers = [c for c in names if C.is_numeric(real.schema[c].dataType)]
    parts = [equal]
    if numbers:
        # Extremes of the synthetic side are one row; the two counts per predicate are one more aggregate.
        row = synthetic.agg(
            *[F.min(C.as_double(synthetic, c)).alias(f"lo{i}") for i, c in enumerate(numbers)],
            *[F.max(C.as_double(synthetic, c)).alias(f"hi{i}") for i, c in enumerate(numbers)],
        ).first()
        tests = []
        for i, c in enumerate(numbers):
            if row[f"lo{i}"] is not None:
                x = C.as_double(both, c)
                tests += [x <= F.lit(row[f"lo{i}"]), x >= F.lit(row[f"hi{i}"])]
        aggs = [
            F.count_if(t & (F.col("_side") == s)).alias(f"{s}{i}") for i, t in enumerate(tests) for s in ("real", "control")
        ]
        wide = both.agg(*aggs)
        one = F.lit(1)
        parts.append(
            wide.select(
                F.lit(len(tests)).cast("long").alias("attempts"),
                sum(F.when(F.col(f"real{i}") == one, 1).otherwise(0) for i in range(len(tests))).cast("long").alias("hits"),
                sum(F.when(F.col(f"control{i}") == one, 1).otherwise(0) for i in range(len(tests))).cast("long").alias("control_hits"),
            )
        )
    return _risk(C.union_all(parts))


def _risk(parts: DataFrame) -> DataFrame:
    total = parts.agg(*[F.sum(c).alias(c) for c in ("attempts", "hits", "control_hits")])
    rates = total.select(
        "attempts",
        _rate(F.col("hits"), F.col("attempts")).alias("attack_rate"),
        _rate(F.col("control_hits"), F.col("attempts")).alias("control_rate"),
    )
    return rates.select(
        "attempts",
        F.round("attack_rate", 4).alias("attack_rate"),
        F.round("control_rate", 4).alias("control_rate"),
        F.round(_adjusted(F.col("attack_rate"), F.col("control_rate")), 4).alias("risk"),
    )


def singling_out_multivariate(
    real: DataFrame, synthetic: DataFrame, control: DataFrame, names: list[str], bins: int = 50
) -> DataFrame:
    """The same for conjunctions over several columns: number cells (synthetic range in ``bins``) and values.

    Predicates are cell tuples the synthetic table holds once. Tuples are counted, never joined row by row.
    """
    numbers = [c for c in names if C.is_numeric(real.schema[c].dataType)]
    both = _tagged(real, synthetic, control, names)
    edges = {}
    if numbers:
        row = synthetic.agg(
            *[F.min(C.as_double(synthetic, c)).alias(f"lo{i}") for i, c in enumerate(numbers)],
            *[F.max(C.as_double(synthetic, c)).alias(f"hi{i}") for i, c in enumerate(numbers)],
        ).first()
        edges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numbers)}
    cells = []
    for c in names:
        if c in edges and edges[c][0] is not None:
            low, high = edges[c]
            cells.append(F.floor((C.as_double(both, c) - low) / ((high - low) or 1.0) * bins).alias(c))
        else:
            cells.append(C.quoted(c))
    flags = _side_flags()
    counts = both.select(*cells, *[v.alias(f"_{k}") for k, v in flags.items()]).groupBy(*[C.quoted(c) for c in names]).agg(
        *[F.count_if(F.col(f"_{k}")).alias(k) for k in flags]
    )
    return _risk(
        counts.filter("n_syn = 1").agg(
            F.count("*").alias("attempts"), F.count_if(F.col("n_real") == 1).alias("hits"), F.count_if(F.col("n_control") == 1).alias("control_hits")
        )
    )


def linkability_links(
    targets: DataFrame, synthetic: DataFrame, row_id: str, first: list[str], second: list[str], k: int = 1, keep: list[str] | None = None
) -> DataFrame:
    """``(query_id, linked)`` and the ``keep`` columns: whether the k nearest synthetic rows by either column set share a row.

    Distances are Gower: range-scaled differences of numbers plus mismatches of categories.
    """
    out = targets.select(row_id, *[C.quoted(c) for c in dict.fromkeys([*(keep or []), *first, *second])])
    for i, names in enumerate((first, second)):
        keyed = _gower_neighbours(targets, synthetic, row_id, names, k).withColumnRenamed("_near", f"_near{i}")
        same = F.lit(True)
        for j, c in enumerate(names):
            same = same & C.quoted(c).eqNullSafe(F.col(f"_k{j}"))
        out = out.join(keyed, same, "left").drop(*[f"_k{j}" for j in range(len(names))])
    shared = F.col(row_id).isNotNull() & F.coalesce(F.arrays_overlap("_near0", "_near1"), F.lit(False))
    return out.select(F.col(row_id).alias("query_id"), *(keep or []), shared.alias("linked"))


def _gower_neighbours(targets: DataFrame, synthetic: DataFrame, row_id: str, names: list[str], k: int) -> DataFrame:
    """``(_k0, _k1, …, _near)``: ids of the k nearest synthetic rows of every different vector of ``names``."""
    numbers = [c for c in names if C.is_numeric(targets.schema[c].dataType)]
    if not numbers:
        raise ValueError("a linkability column set needs at least one number column")
    others = [c for c in names if c not in numbers]
    row = synthetic.agg(
        *[(F.max(C.quoted(c)) - F.min(C.quoted(c))).cast("double").alias(f"w{i}") for i, c in enumerate(numbers)]
    ).first()
    scale = {c: 1.0 / (row[f"w{i}"] or 1.0) for i, c in enumerate(numbers)}

    def gower(q: str, d: str) -> Column:
        total = F.lit(0.0)
        for c in numbers:
            total = total + F.abs(F.col(f"{q}.{c}").cast("double") - F.col(f"{d}.{c}").cast("double")) * scale[c]
        for c in others:
            total = total + F.when(F.col(f"{q}.{c}").eqNullSafe(F.col(f"{d}.{c}")), 0.0).otherwise(1.0)
        return total

    whole = [C.quoted(c).isNotNull() for c in numbers]
    queries, donors = targets.select(*[C.quoted(c) for c in names]), synthetic.select(row_id, *[C.quoted(c) for c in names])
    for present in whole:
        queries, donors = queries.filter(present), donors.filter(present)
    # Equal targets share one search, under a number of their own.
    vectors = stored(queries.distinct().withColumn(row_id, F.monotonically_increasing_id()), "vectors")
    pairs = nearest(vectors, donors, row_id, k, complete=numbers, distance=gower, reach=lambda w: w, scales=scale)
    near = pairs.groupBy(F.col("query_id").alias("_vector")).agg(F.collect_list("donor_id").alias("_near"))
    keyed = vectors.select(F.col(row_id).alias("_vector"), *[C.quoted(c).alias(f"_k{j}") for j, c in enumerate(names)])
    return keyed.join(near, "_vector").drop("_vector")


def linkability_risk(
    real: DataFrame, synthetic: DataFrame, control: DataFrame, row_id: str, first: list[str], second: list[str], k: int = 1
) -> DataFrame:
    """``(attempts, attack_rate, control_rate, risk)``; every real row is a target.

    Rows of both tables are searched for together, so the synthetic table is prepared once per column set.
    """
    names = list(dict.fromkeys([row_id, *first, *second]))
    sides = [df.select(*[C.quoted(c) for c in names], F.lit(side).alias("_side")) for side, df in (("real", real), ("control", control))]
    links = linkability_links(C.union_all(sides), synthetic, row_id, first, second, k, keep=["_side"])
    both = links.groupBy(F.col("_side").alias("side")).agg(F.count("*").alias("n"), F.count_if("linked").alias("h"))

    def value(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    rates = both.agg(
        F.coalesce(value("real", "n"), F.lit(0)).alias("attempts"),
        _rate(value("real", "h"), value("real", "n")).alias("attack_rate"),
        _rate(value("control", "h"), value("control", "n")).alias("control_rate"),
    )
    return rates.select(
        "attempts",
        F.round("attack_rate", 4).alias("attack_rate"),
        F.round("control_rate", 4).alias("control_rate"),
        F.round(_adjusted(F.col("attack_rate"), F.col("control_rate")), 4).alias("risk"),
    )


def privacy_score(risks: list[DataFrame]) -> DataFrame:
    """``(privacy_score)``: 1 - the largest risk; 1 is safest."""
    return C.union_all([r.select("risk") for r in risks]).agg(F.round(1 - F.max("risk"), 4).alias("privacy_score"))


def quality_gate(
    scores: DataFrame, fidelity: float = FIDELITY_THRESHOLD, privacy: float = PRIVACY_THRESHOLD
) -> DataFrame:
    """Both scores against their thresholds: pass flags and messages, per row of ``scores``."""
    fid, pri = F.col("fidelity_score") >= fidelity, F.col("privacy_score") >= privacy
    messages = F.concat_ws(
        "; ",
        F.when(~fid, F.format_string(f"too far from the real table: %.3f, at least {fidelity} is asked for", "fidelity_score")),
        F.when(~pri, F.format_string(f"discloses too much: %.3f, at least {privacy} is asked for", "privacy_score")),
    )
    return scores.select(
        "*", fid.alias("fidelity_passed"), pri.alias("privacy_passed"), (fid & pri).alias("passed"), messages.alias("violations")
    )
