"""Queries over generators, exports and whole jobs.

Synthetic rows have no SQL twin, so these queries return facts about them: sizes, bounds, orphans, distances.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions.rng import normal
from synthspark.generators import copula as G
from synthspark.generators.latent import latent_fit
from synthspark.generators.linked import hma_synth
from synthspark.generators.mixture import mixture_fit
from synthspark.generators.private import Domain, aim_synth, dp_categorical_columns, dp_marginals, mst_synth, mwem_synth
from synthspark.generators.sequence import long_sequence_fit, par_fit
from synthspark.operators import fidelity as Q
from synthspark.operators.profile import detect_sdtype
from synthspark.plans.generation import RunConfig, benchmark_grid, run_job
from synthspark.plans.registry import ORDERS_MISSING, as_select, query
from synthspark.session import scratch_path, stored
from synthspark.sources import writers as W
from synthspark.spec import Constraint, Relationship

KINDS = {
    "o_orderkey": "id", "o_custkey": "numerical", "o_orderstatus": "categorical", "o_totalprice": "numerical",
    "o_orderdate": "datetime", "o_orderpriority": "categorical",
}
JUDGED = {c: k for c, k in KINDS.items() if k in ("numerical", "categorical")}
MISSING = as_select(ORDERS_MISSING, "orders")


def _copula(t, **options):
    return G.copula_fit(t.orders, KINDS, **{"distribution": "empirical", **options})


def _shape_floor(real, synthetic, kinds=None):
    """Lowest shape score of all columns."""
    kinds = kinds or JUDGED
    return Q.column_shapes(real.select(*kinds), synthetic.select(*kinds), kinds).agg(F.min("score")).first()[0]


# --- generators ----------------------------------------------------------------------------------------------


@query(
    "copula_fit",
    f"""SELECT * FROM (VALUES ('o_orderkey', 'id')) v("column", kind), (SELECT 0.0::DOUBLE AS null_share, NULL::DOUBLE AS low,
          NULL::DOUBLE AS high, NULL::BIGINT AS decimals, NULL::BIGINT AS categories)
        UNION ALL SELECT 'o_custkey', 'number', round(1 - count(o_custkey) / count(*), 4), min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, NULL, NULL FROM {MISSING} x
        UNION ALL SELECT 'o_orderstatus', 'category', round(1 - count(o_orderstatus) / count(*), 4), NULL, NULL, NULL, count(DISTINCT o_orderstatus) FROM {MISSING} x
        UNION ALL SELECT 'o_totalprice', 'number', round(1 - count(o_totalprice) / count(*), 4), min(o_totalprice), max(o_totalprice), 2, NULL FROM {MISSING} x
        UNION ALL SELECT 'o_orderpriority', 'category', 0.0, NULL, NULL, NULL, count(DISTINCT o_orderpriority) FROM {MISSING} x""",
)
def _(t):
    return G.describe(G.copula_fit(t.derived(ORDERS_MISSING, "orders"), {c: k for c, k in KINDS.items() if c != "o_orderdate"}))


@query(
    "copula_sample",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, true AS in_range, 0::BIGINT AS unseen_status, true AS close FROM orders""",
)
def _(t):
    real = t.orders
    made = stored(_copula(t).sample(real.count()))
    low = real.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    floor = _shape_floor(real, made)
    return made.agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"),
        F.bool_and(F.col("o_totalprice").between(low[0], low[1])).alias("in_range"),
        F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")).alias("unseen_status"),
        F.lit(floor > 0.95).alias("close"),
    )


FAMILIES = ("beta", "gamma", "norm", "truncnorm", "uniform", "empirical")


@query(
    "marginal_distributions",
    " UNION ALL ".join(f"SELECT '{f}' AS family, count(*) AS n_rows, true AS close, true AS in_range FROM part" for f in FAMILIES),
)
def _(t):
    real = t.part.select("p_size", "p_retailprice")
    n = real.count()
    edge = real.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    parts = []
    for family in FAMILIES:
        made = G.copula_fit(real, {"p_size": "numerical", "p_retailprice": "numerical"}, "uniform", {"p_retailprice": family}).sample(n)
        made = stored(made)
        score = Q.ks_complement(real, made, ["p_retailprice"]).first()["score"]
        parts.append(
            made.agg(
                F.lit(family).alias("family"), F.count("*").alias("n_rows"), F.lit(score > 0.7).alias("close"),
                F.bool_and(F.col("p_retailprice").between(edge[0], edge[1])).alias("in_range"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("enforce_min_max", "SELECT count(*) AS n_rows, 0::BIGINT AS outside, true AS free_goes_beyond FROM customer")
def _(t):
    real = t.customer.select("c_acctbal")
    n = real.count()
    edge = real.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    outside = ~F.col("c_acctbal").between(edge[0], edge[1])
    kept = G.copula_fit(real, {"c_acctbal": "numerical"}, "norm").sample(n)
    free = G.copula_fit(real, {"c_acctbal": "numerical"}, "norm", enforce_min_max=False).sample(n)
    kept, free = stored(kept), stored(free)
    beyond = free.filter(outside).count()
    return kept.agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("outside"), F.lit(beyond > 0).alias("free_goes_beyond"))


@query(
    "enforce_rounding",
    "SELECT count(*) AS n_rows, 0::BIGINT AS bad_price, 0::BIGINT AS bad_discount, true AS free_has_more FROM lineitem",
)
def _(t):
    real = t.lineitem.select("l_extendedprice", "l_discount")
    kinds = {"l_extendedprice": "numerical", "l_discount": "numerical"}
    n = real.count()
    steps = lambda c, d: F.abs(F.col(c) * 10**d - F.rint(F.col(c) * 10**d)) > 1e-6 * F.greatest(F.lit(1.0), F.abs(c))
    kept = G.copula_fit(real, kinds, "empirical").sample(n)
    free = G.copula_fit(real, kinds, "empirical", enforce_rounding=False).sample(n)
    kept, free = stored(kept), stored(free)
    more = free.filter(steps("l_discount", 2)).count() > 0
    return kept.agg(
        F.count("*").alias("n_rows"), F.count_if(steps("l_extendedprice", 2)).alias("bad_price"),
        F.count_if(steps("l_discount", 2)).alias("bad_discount"), F.lit(more).alias("free_has_more"),
    )


@query(
    "conditional_sample",
    "SELECT count(*) AS n_rows, count(*) AS n_status, count(*) AS n_price, true AS priority_close FROM orders",
)
def _(t):
    real = t.orders
    n = real.count()
    made = G.conditional_sample(_copula(t), {"o_orderstatus": "F", "o_totalprice": 1234.5}, n)
    made = stored(made)
    score = Q.tv_complement(real, made, ["o_orderpriority"]).first()["score"]
    return made.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("n_status"),
        F.count_if(F.col("o_totalprice") == 1234.5).alias("n_price"), F.lit(score > 0.9).alias("priority_close"),
    )


@query(
    "mode_mixture_synth",
    "SELECT count(*) AS n_rows, true AS in_range, true AS close, count(*) AS n_conditioned FROM orders",
)
def _(t):
    real = t.orders
    n = real.count()
    model = mixture_fit(real, "o_orderstatus", KINDS, modes=3)
    made = stored(model.sample(n))
    edge = real.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    close = _shape_floor(real, made) > 0.9
    fixed = model.sample(n, {"o_orderstatus": "P"}).filter("o_orderstatus = 'P'").count()
    return made.agg(
        F.count("*").alias("n_rows"), F.bool_and(F.col("o_totalprice").between(edge[0], edge[1])).alias("in_range"),
        F.lit(close).alias("close"), F.lit(fixed).alias("n_conditioned"),
    )


@query("latent_factor_synth", "SELECT count(*) AS n_rows, true AS in_range, true AS close FROM orders")
def _(t):
    real = t.orders
    made = stored(latent_fit(real, sdtypes=KINDS).sample(real.count()))
    edge = real.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    close = _shape_floor(real, made) > 0.9
    return made.agg(
        F.count("*").alias("n_rows"), F.bool_and(F.col("o_totalprice").between(edge[0], edge[1])).alias("in_range"), F.lit(close).alias("close")
    )


# --- private generators ----------------------------------------------------------------------------------------

DOMAINS = {
    "o_orderstatus": Domain(("F", "O", "P")),
    "o_orderpriority": Domain(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    "o_totalprice": Domain(low=0, high=500_000, bins=20),
}


@query(
    "dp_categorical_columns",
    """SELECT 'o_orderkey' AS "column", 'id' AS sdtype WHERE (SELECT count(DISTINCT o_orderkey) >= 0.99 * count(*) FROM orders)
       UNION ALL SELECT 'o_orderstatus', 'categorical' UNION ALL SELECT 'o_orderpriority', 'categorical'""",
)
def _(t):
    return dp_categorical_columns(detect_sdtype(t.orders))


@query(
    "dp_marginals",
    """SELECT 23::BIGINT + 5 AS cells, 3 * count(*) AS total, true AS exact_at_large_epsilon FROM orders""",
)
def _(t):
    # At a very large epsilon the noise vanishes and cells equal exact counts.
    noisy = dp_marginals(t.orders, DOMAINS, 100.0, seed=7)
    exact = t.orders.groupBy(F.col("o_orderstatus").alias("cell")).agg(F.count("*").alias("m")).withColumn("marginal", F.lit("o_orderstatus"))
    same = noisy.join(exact, ["marginal", "cell"]).agg(F.bool_and(F.col("n") == F.col("m"))).first()[0]
    return noisy.agg(F.count("*").alias("cells"), F.sum("n").alias("total"), F.lit(same).alias("exact_at_large_epsilon"))


def _private_facts(t, model):
    real = t.orders
    n = real.count()
    made = stored(model.sample(n))
    kinds = {"o_orderstatus": "categorical", "o_orderpriority": "categorical", "o_totalprice": "numerical"}
    floor = _shape_floor(real, made, kinds)
    return made.agg(
        F.count("*").alias("n_rows"), F.bool_and(F.col("o_totalprice").between(0, 500_000)).alias("in_domain"),
        F.lit(floor > 0.85).alias("close"), F.lit(model.epsilon_spent).alias("epsilon_spent"),
    )


_PRIVATE = "SELECT count(*) AS n_rows, true AS in_domain, true AS close, 20.0::DOUBLE AS epsilon_spent FROM orders"


@query("mst_synth", _PRIVATE)
def _(t):
    return _private_facts(t, mst_synth(t.orders, DOMAINS, 20.0, seed=11))


@query("mwem_synth", _PRIVATE)
def _(t):
    return _private_facts(t, mwem_synth(t.orders, DOMAINS, 20.0, seed=11))


WIDE = {
    "l_quantity": Domain(low=0, high=51, bins=51),
    "l_extendedprice": Domain(low=0, high=110_000, bins=1100),
    "l_discount": Domain(low=0, high=0.11, bins=11),
    "l_tax": Domain(low=0, high=0.09, bins=9),
    "l_returnflag": Domain(("A", "N", "R")),
    "l_linestatus": Domain(("F", "O")),
    "l_season": Domain(("1", "2", "3", "4")),
}
WIDE_WORKLOAD = [("l_quantity",), ("l_discount",), ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linestatus", "l_season")]


@query(
    "mwem_wide_domain",
    """SELECT g.marginal, g.cells, count(*) AS n_rows, true AS within_bound
       FROM lineitem, (VALUES ('l_quantity', 51::BIGINT), ('l_discount', 11), ('l_returnflag,l_linestatus', 6), ('l_returnflag,l_linestatus,l_season', 24)) g(marginal, cells)
       GROUP BY g.marginal, g.cells""",
)
def _(t):
    """Total variation between the model's counts at epsilon 1 and the exact ones, on a domain of more than 1e8 cells."""
    real = t.lineitem.withColumn("l_season", F.quarter("l_shipdate").cast("string"))
    rounds = 6
    model = mwem_synth(real, WIDE, 1.0, rounds=rounds, seed=5, workload=WIDE_WORKLOAD)
    exact, n = stored(real.select(*[d.code(real, c).alias(c) for c, d in WIDE.items()]), "codes"), real.count()
    out = []
    for g in WIDE_WORKLOAD:
        size = math.prod(WIDE[c].size for c in g)
        # Twice the expected noise of one measurement, and a fiftieth for the group's neighbours.
        bound = 0.02 + size * 2 / (0.95 / rounds / 2) / max(n, 1)
        both = model.marginal(list(g)).join(exact.groupBy(*g).agg(F.count("*").alias("n")), list(g), "full")
        apart = F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("w", F.lit(0.0)))) / (2.0 * max(n, 1))
        facts = [F.lit(",".join(g)).alias("marginal"), F.lit(size).cast("long").alias("cells"), F.lit(n).alias("n_rows"), (apart <= bound).alias("within_bound")]
        out.append(both.agg(*facts))
    return reduce(DataFrame.union, out)


@query("aim_synth", _PRIVATE)
def _(t):
    return _private_facts(t, aim_synth(t.orders, DOMAINS, 20.0, seed=11))


# --- linked tables and sequences ---------------------------------------------------------------------------------


@query(
    "hma_synth",
    """SELECT 'customer' AS table_name, count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS orphans FROM customer
       UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), 0 FROM orders
       UNION ALL SELECT 'lineitem', count(*), NULL, 0 FROM lineitem""",
)
def _(t):
    tables = {
        "customer": t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"),
        "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"),
        "lineitem": t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"),
    }
    links = [
        Relationship("customer", "c_custkey", "orders", "o_custkey"), Relationship("orders", "o_orderkey", "lineitem", "l_orderkey")
    ]
    made = {name: stored(df, name) for name, df in hma_synth(tables, links).items()}
    customers, orders, lines = made["customer"], made["orders"], made["lineitem"]

    def facts(name, df, key, foreign=None, parent=None, parent_key=None):
        orphans = 0
        if parent is not None:
            orphans = df.groupBy(F.col(foreign).alias("k")).count().join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti").count()
        keys = F.count_distinct(key) if key else F.lit(None).cast("long")
        return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), keys.alias("n_keys"), F.lit(orphans).cast("long").alias("orphans"))

    return (
        facts("customer", customers, "c_custkey")
        .unionByName(facts("orders", orders, "o_orderkey", "o_custkey", customers, "c_custkey"))
        .unionByName(facts("lineitem", lines, None, "l_orderkey", orders, "o_orderkey"))
    )


SEQUENCE = "event_id; user_id; ts; event_type; value"


@query(
    "par_synth",
    """SELECT count(DISTINCT user_id) AS sequences, true AS ordered, true AS length_close, true AS value_close, true AS type_close FROM events""",
)
def _(t):
    real = t.events.select("user_id", "ts", "event_type", "value")
    model = par_fit(real, "user_id", "ts", sdtypes={"user_id": "id", "ts": "datetime", "event_type": "categorical", "value": "numerical"})
    n = real.select("user_id").distinct().count()
    made = stored(model.sample(n))
    per = made.groupBy("user_id").agg(F.count("*").alias("m"), F.count_distinct("ts").alias("d"))
    spread = per.agg(F.count("*").alias("s"), F.avg("m").alias("m"), F.bool_and(F.col("m") == F.col("d")).alias("o")).first()
    mean = real.count() / n
    value = Q.ks_complement(real, made, ["value"]).first()["score"]
    kind = Q.tv_complement(real, made, ["event_type"]).first()["score"]
    return per.agg(
        F.count("*").alias("sequences"), F.lit(spread["o"]).alias("ordered"), F.lit(abs(spread["m"] - mean) < 0.1 * mean).alias("length_close"),
        F.lit(value > 0.9).alias("value_close"), F.lit(kind > 0.9).alias("type_close"),
    )


@query(
    "long_sequence_synth",
    "SELECT count(DISTINCT user_id) AS sequences, 40 * count(DISTINCT user_id) AS n_rows, true AS value_close FROM events",
)
def _(t):
    real = t.events.select("user_id", "ts", "value")
    model = long_sequence_fit(real, "user_id", "ts", "value", segment_size=10)
    n = real.select("user_id").distinct().count()
    made = stored(model.sample(n, 40))
    score = Q.ks_complement(real, made, ["value"]).first()["score"]
    return made.agg(F.count_distinct("user_id").alias("sequences"), F.count("*").alias("n_rows"), F.lit(score > 0.85).alias("value_close"))


@query(
    "par_synth_dependence",
    """SELECT count(DISTINCT user_id) AS sequences, true AS steps_together, true AS measures_together, true AS context_close, true AS moves_close,
          true AS moves_by_context FROM events""",
)
def _(t):
    """Events per user: a load that moves slowly and lies higher in one region, an echo of it, and a mode that often stays."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    region = F.when(F.pmod("user_id", F.lit(3)) == 0, "north").otherwise("south")
    load = F.avg("value").over(order.rowsBetween(-3, 0)) + F.when(region == "north", 40.0).otherwise(0.0)
    # In the north two of three events keep the mode, in the south one of three.
    stays = F.pmod(F.xxhash64("event_id"), F.lit(3)) < F.when(region == "north", 2).otherwise(1)
    raw = t.events.select("user_id", "event_id", "ts", region.alias("region"), load.alias("load"), "event_type", stays.alias("stays"))
    mode = F.last(F.when(~F.col("stays"), F.col("event_type")), ignorenulls=True).over(order)
    real = raw.select("user_id", "ts", "region", "load", (0.7 * F.col("load") + 15 * normal(F.col("event_id"), "echo")).alias("echo"), F.coalesce(mode, "event_type").alias("mode"))
    real = stored(real)
    kinds = {"user_id": "id", "ts": "datetime", "region": "categorical", "load": "numerical", "echo": "numerical", "mode": "categorical"}
    n = 5 * real.select("user_id").distinct().count()
    made = stored(par_fit(real, "user_id", "ts", ["region"], kinds).sample(n, seed=5))

    def facts(df):
        steps = Window.partitionBy("user_id").orderBy("ts")
        lagged = df.select("*", F.lag("load").over(steps).alias("last_load"), F.lag("mode").over(steps).alias("last_mode"))
        north = F.col("region") == "north"
        inside = lambda c, where: F.avg(F.when(where, c))
        kept = (F.col("mode") == F.col("last_mode")).cast("double")
        return lagged.agg(
            F.corr("load", "last_load").alias("lag"), F.corr("load", "echo").alias("both"), (inside(F.col("load"), north) - inside(F.col("load"), ~north)).alias("gap"),
            F.avg(kept).alias("kept"), (inside(kept, north) - inside(kept, ~north)).alias("kept_gap"), F.stddev("load").alias("spread"),
        ).first()

    want, got = facts(real), facts(made)
    close = {c: abs(want[c] - got[c]) for c in ("lag", "both", "gap", "kept", "kept_gap")}
    return made.agg(
        (F.count_distinct("user_id") / 5).cast("long").alias("sequences"),
        F.lit(close["lag"] < 0.1).alias("steps_together"),
        F.lit(close["both"] < 0.1).alias("measures_together"),
        F.lit(close["gap"] < 0.25 * abs(want["gap"])).alias("context_close"),
        F.lit(close["kept"] < 0.06).alias("moves_close"),
        F.lit(close["kept_gap"] < 0.12).alias("moves_by_context"),
    )


@query(
    "long_sequence_season",
    """SELECT count(*) AS fitted_steps, 24::BIGINT AS season, 1::BIGINT AS sequences, 2 * count(*) AS n_rows, true AS values_close, true AS season_close,
          true AS measures_together, true AS steps_together FROM events""",
)
def _(t):
    """All events as one sequence with a season of 24 steps in two measures that hang together."""
    turn = F.sin(2 * math.pi * F.pmod("event_id", F.lit(24)) / 24)
    load = F.col("value") / F.lit(20.0) + 3.0 * turn
    real = t.events.select(F.lit(1).alias("k"), "event_id", load.alias("load"), (0.5 * load + normal(F.col("event_id"), "events")).alias("echo"))
    model = long_sequence_fit(real, "k", "event_id", ["load", "echo"])
    made = stored(model.sample(1, 2 * model.length, seed=3))

    def facts(df, step):
        """Correlation of the measures, of a measure with its last step, and its mean per phase."""
        before = df.select((F.col(step) + 1).alias(step), F.col("load").alias("last"))
        lag = df.join(before, step).agg(F.corr("load", "last").alias("r")).first()["r"]
        phases = df.groupBy(F.pmod(F.col(step), F.lit(24)).alias("p")).agg(F.avg("load").alias("m")).orderBy("p").collect()
        return df.agg(F.corr("load", "echo").alias("r")).first()["r"], lag, [r["m"] for r in phases]

    first = real.agg(F.min("event_id").alias("e")).first()["e"]
    steps = real.withColumn("event_id", F.col("event_id") - first)
    (together, lag, phases), (made_together, made_lag, made_phases) = facts(steps, "event_id"), facts(made, "event_id")
    swing = max(phases) - min(phases)
    shape = min(r["score"] for r in Q.column_shapes(real.select("load", "echo"), made.select("load", "echo"), {"load": "numerical", "echo": "numerical"}).collect())
    return made.agg(
        F.lit(model.length).cast("long").alias("fitted_steps"),
        F.lit(len(model.season)).cast("long").alias("season"),
        F.count_distinct("k").alias("sequences"),
        F.count("*").alias("n_rows"),
        F.lit(shape > 0.9).alias("values_close"),
        F.lit(max(abs(a - b) for a, b in zip(phases, made_phases)) < 0.15 * swing).alias("season_close"),
        F.lit(abs(together - made_together) < 0.08).alias("measures_together"),
        F.lit(abs(lag - made_lag) < 0.08).alias("steps_together"),
    )


# --- whole jobs --------------------------------------------------------------------------------------------------


@query(
    "run_generation_job",
    """SELECT count(*) AS n_rows, 'queued,training,generating,validating,complete' AS stages, 0::BIGINT AS violations,
       true AS fidelity_passed, true AS privacy_passed, count(*) AS n_exported FROM orders""",
)
def _(t):
    real = t.orders.select(*JUDGED, "o_orderkey")
    rules = [Constraint("o_totalprice", "range", {"min": 2000, "max": 480000}), Constraint("o_orderstatus", "not_null")]
    target = scratch_path(t.spark, "run-output")
    config = RunConfig(num_rows=real.count(), constraints=rules, sdtypes=KINDS | {}, output=target, min_privacy=0.3)
    config.sdtypes = {c: KINDS[c] for c in real.columns}
    result = run_job(real, config)
    gate = result.scores.first()
    exported = t.spark.read.parquet(target).count() if result.output else 0
    return result.synthetic.agg(
        F.count("*").alias("n_rows"), F.lit(",".join(result.stages)).alias("stages"),
        F.lit(len(result.violations)).cast("long").alias("violations"), F.lit(gate["fidelity_passed"]).alias("fidelity_passed"),
        F.lit(gate["privacy_passed"]).alias("privacy_passed"), F.lit(exported).cast("long").alias("n_exported"),
    )


@query(
    "benchmark_grid",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dataset, '{g}' AS generator, {ok} AS ks_ok, {ok} AS tv_ok, {bad} AS failed"
        for d in ("orders", "customer")
        for g, ok, bad in (("gaussian_copula", "true", "false"), ("tvae", "true", "false"), ("unknown", "NULL::BOOLEAN", "true"))
    ),
)
def _(t):
    tables = {
        "orders": t.orders.select(*JUDGED),
        "customer": t.customer.select("c_acctbal", "c_mktsegment", "c_nationkey"),
    }
    kinds = {"orders": JUDGED, "customer": {"c_acctbal": "numerical", "c_mktsegment": "categorical", "c_nationkey": "categorical"}}
    grid = benchmark_grid(tables, ["gaussian_copula", "tvae", "unknown"], kinds)
    return grid.select(
        "dataset", "generator", (F.col("ks_complement") > 0.9).alias("ks_ok"), (F.col("tv_complement") > 0.9).alias("tv_ok"),
        F.col("error").isNotNull().alias("failed"),
    )


# --- exports -----------------------------------------------------------------------------------------------------

_CODECS = ("snappy", "gzip", "zstd", "lz4", "none")


@query(
    "export_parquet",
    " UNION ALL ".join(
        f"SELECT '{c}' AS codec, count(*) AS n_rows, round(sum(o_totalprice::DECIMAL(20,2)), 2)::DOUBLE AS price FROM orders" for c in _CODECS
    ),
)
def _(t):
    out = None
    for codec in _CODECS:
        path = W.export_parquet(t.orders, scratch_path(t.spark, "export"), codec, row_group_bytes=1 << 20)
        part = t.spark.read.parquet(path).agg(
            F.lit(codec).alias("codec"), F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("price")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "export_csv",
    """SELECT row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1 AS "index", o_orderkey, o_orderpriority,
       strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    path = W.export_csv(df, scratch_path(t.spark, "export"), delimiter=";", include_index=True, index_key="o_orderkey", date_format="dd/MM/yyyy")
    return t.spark.read.schema("index long, o_orderkey long, o_orderpriority string, o_orderdate string").options(header=True, sep=";").csv(path)


@query(
    "export_jsonl",
    f"SELECT count(*) AS n_rows, count(*) AS n_fields_custkey, count_if(o_custkey IS NULL) AS null_custkey FROM {MISSING} x",
)
def _(t):
    path = W.export_jsonl(t.derived(ORDERS_MISSING, "orders"), scratch_path(t.spark, "export"))
    text = t.spark.read.text(path)
    return text.agg(
        F.count("*").alias("n_rows"), F.count_if(F.contains("value", F.lit('"o_custkey":'))).alias("n_fields_custkey"),
        F.count_if(F.contains("value", F.lit('"o_custkey":null'))).alias("null_custkey"),
    )


@query(
    "export_chunked",
    "SELECT count(*) AS total_rows, 2000::BIGINT AS chunk_size, true AS within_chunk, true AS enough_chunks, true AS has_bytes FROM orders",
)
def _(t):
    chunks = W.export_chunked(t.orders, scratch_path(t.spark, "chunks"), "parquet", 2000)
    return W.chunk_manifest(chunks, 2000).select(
        "total_rows", "chunk_size", (F.col("largest_chunk") <= 2000).alias("within_chunk"),
        (F.col("num_chunks") >= F.ceil(F.col("total_rows") / 2000)).alias("enough_chunks"), (F.col("total_bytes") > 0).alias("has_bytes"),
    )


@query(
    "export_dataset",
    """SELECT 'orders' AS name, 'csv' AS output_format, count(*) AS row_count, false AS chunked FROM orders
       UNION ALL SELECT 'lineitem', 'jsonl', count(*), true FROM lineitem""",
)
def _(t):
    plain = W.export_dataset(t.orders, scratch_path(t.spark, "dataset"), "csv", threshold=10**9)
    large = W.export_dataset(t.lineitem, scratch_path(t.spark, "dataset"), "jsonl", threshold=1000)
    return plain.select(F.lit("orders").alias("name"), "*").unionByName(large.select(F.lit("lineitem").alias("name"), "*"))


@query(
    "export_manifest",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{d}' AS dtype, count_if({c} IS NULL) AS null_count, count(*) AS row_count, 5::BIGINT AS column_count,
            'parquet' AS output_format, 'application/octet-stream' AS content_type, 'output.parquet' AS filename, true AS written FROM {MISSING} x"""
        for c, d in (
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")
        )
    ),
)
def _(t):
    df = t.derived(ORDERS_MISSING, "orders")
    path = W.export_parquet(df, scratch_path(t.spark, "export"))
    return W.export_manifest(df, path).withColumn("written", F.col("bytes_written") > 0).drop("bytes_written")


@query(
    "write_partitioned",
    """SELECT o_orderstatus AS tenant_id, count(*) AS n_rows, round(sum(o_totalprice::DECIMAL(20,2)), 2)::DOUBLE AS price FROM orders
       WHERE o_orderpriority = '1-URGENT' GROUP BY 1""",
)
def _(t):
    df = t.orders.select(F.col("o_orderstatus").alias("tenant_id"), F.col("o_orderpriority").alias("job_id"), "o_orderkey", "o_totalprice")
    target = W.write_partitioned(df, scratch_path(t.spark, "jobs"))
    one_job = t.spark.read.parquet(target).filter("job_id = '1-URGENT'")
    return one_job.groupBy("tenant_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("price")
    )


@query("list_artifacts", "SELECT 3::BIGINT AS tenants, true AS all_parquet, true AS all_have_bytes, count(*) AS n_rows FROM orders")
def _(t):
    df = t.orders.select(F.col("o_orderstatus").alias("tenant_id"), F.lit("job-1").alias("job_id"), "o_orderkey")
    target = W.write_partitioned(df, scratch_path(t.spark, "jobs"))
    files = W.list_artifacts(t.spark, target)
    n = t.spark.read.parquet(target).count()
    return files.agg(
        F.count_distinct(F.regexp_extract("uri", "tenant_id=([^/]+)", 1)).alias("tenants"), F.bool_and(F.col("uri").endswith(".parquet")).alias("all_parquet"),
        F.bool_and(F.col("bytes") > 0).alias("all_have_bytes"), F.lit(n).alias("n_rows"),
    )


@query("generate_parts", "SELECT count(*) AS total_rows, true AS within_part, true AS enough_parts FROM lineitem")
def _(t):
    model = G.copula_fit(t.lineitem.select("l_quantity", "l_extendedprice"), {"l_quantity": "numerical", "l_extendedprice": "numerical"})
    parts = W.generate_parts(model, t.lineitem.count(), scratch_path(t.spark, "parts"), part_rows=5000)
    return W.chunk_manifest(parts, 5000).select(
        "total_rows", (F.col("largest_chunk") <= 5000).alias("within_part"), (F.col("num_chunks") >= F.ceil(F.col("total_rows") / 5000)).alias("enough_parts")
    )
