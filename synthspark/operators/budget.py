"""Privacy budget as an append-only ledger.

Amounts are whole micro-epsilons, so sums are exact in any order. Ledger rows are
``(tenant_id, entry, allocation_id, epsilon)`` with entries ``grant``, ``allocation`` and ``consumption``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions.columns import doubles
from synthspark.functions.distribution import chunked_running_totals
from synthspark.session import cut_lineage
from synthspark.spec import PRIVACY_LEVELS

MICRO = 1_000_000
LOW_BUDGET = 1 * MICRO
# Stand-in for unlimited epsilon in whole micro-epsilons.
UNLIMITED = (1 << 62) - 1


def micro(epsilon: Column) -> Column:
    """Epsilon in whole micro-epsilons; infinity becomes the largest amount."""
    return F.when(epsilon >= UNLIMITED / MICRO, F.lit(UNLIMITED)).otherwise(F.round(epsilon * MICRO).cast("long"))


def level_epsilon(level: Column) -> Column:
    """Epsilon of a named privacy level; null for an unknown name."""
    table = F.create_map(*[F.lit(x) for name, (eps, _) in PRIVACY_LEVELS.items() for x in (name, float(eps))])
    return F.try_element_at(table, level)


def budget_status(ledger: DataFrame) -> DataFrame:
    """Per tenant: total, consumed, remaining and number of allocations.

    An allocation holds its full amount until its consumption states the amount really spent.
    """
    per_allocation = ledger.groupBy("tenant_id", "allocation_id").agg(
        F.sum(F.when(F.col("entry") == "grant", F.col("epsilon")).otherwise(0)).alias("granted"),
        F.max(F.when(F.col("entry") == "allocation", F.col("epsilon"))).alias("held"),
        F.max(F.when(F.col("entry") == "consumption", F.col("epsilon"))).alias("spent"),
    )
    return per_allocation.groupBy("tenant_id").agg(
        F.sum("granted").alias("total_budget"),
        F.sum(F.coalesce("spent", "held", F.lit(0))).alias("consumed_budget"),
        (F.sum("granted") - F.sum(F.coalesce("spent", "held", F.lit(0)))).alias("remaining_budget"),
        F.count("held").alias("allocation_count"),
    )


def budget_check(status: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request_id, sufficient, remaining_budget, requested_epsilon, shortfall)``.

    A request states ``epsilon`` in micro-epsilons or a ``level``. A tenant without a ledger has nothing left.
    """
    wanted = F.coalesce("epsilon", micro(level_epsilon(F.col("level"))))
    left = F.coalesce("remaining_budget", F.lit(0))
    joined = requests.withColumn("requested_epsilon", wanted).join(status.select("tenant_id", "remaining_budget"), "tenant_id", "left")
    return joined.select(
        "request_id",
        "tenant_id",
        "requested_epsilon",
        left.alias("remaining_budget"),
        (left >= F.col("requested_epsilon")).alias("sufficient"),
        F.greatest(F.lit(0).cast("long"), F.col("requested_epsilon") - left).alias("shortfall"),
    )


def _judge(waiting: DataFrame) -> DataFrame:
    """``waiting`` with ``_small``, ``_drops`` (takes what is left below its largest power of two) and ``_after`` (left then).

    Both hold if no earlier request dropped it; the same amount is left for every waiting request of a tenant.
    """
    half = F.when(F.col("_left") > 0, F.expr("shiftleft(1L, length(bin(_left)) - 1)")).otherwise(F.lit(0).cast("long"))
    # Many small requests may add up to more than a long holds.
    taken = F.when(F.col("_small"), F.col("epsilon")).otherwise(0).cast("decimal(20,0)")
    rows = waiting.withColumn("_half", half).withColumn("_small", F.col("epsilon") <= F.col("_half")).withColumn("_taken", taken)
    rows = chunked_running_totals(rows, ["tenant_id"], "_chunk", ["seq", "request_id"], ["_taken"])
    left = F.col("_left") - F.col("cum__taken")
    after = F.when(F.col("_small"), left).otherwise(left - F.col("epsilon"))
    drops = F.when(F.col("_small"), (left < F.col("_half")) & (left + F.col("_taken") >= F.col("_half"))).otherwise(after >= 0)
    kept = ["request_id", "tenant_id", "seq", "epsilon", "_chunk", "_small"]
    return rows.select(*kept, drops.alias("_drops"), F.when(drops, after).cast("long").alias("_after"))


def budget_allocate(requests: DataFrame, budgets: DataFrame, chunks: int = 64) -> DataFrame:
    """Admit requests in order of ``seq`` per tenant while the budget lasts; a rejected one uses nothing.

    Input ``(request_id, tenant_id, seq, epsilon)`` and ``(tenant_id, budget)``. A rejection lets later,
    smaller requests through, so running sums alone do not decide. Let ``half`` be the largest power of two
    up to what is left. While at least ``half`` is left, every request up to ``half`` fits, and as soon as a
    larger one fits, less than ``half`` is left. So running sums of the small requests find, for all tenants
    at once, the first request that takes a tenant below ``half``; everything before it is decided. Each
    round takes a binary digit off what is left: there are at most 62, whatever the number of requests. Sums
    run over time chunks, so a tenant with most of the requests is many tasks.
    """
    steps = doubles(i / chunks for i in range(1, chunks))
    cuts = requests.agg(F.percentile_approx("seq", steps, 1000).alias("c")).first()["c"] or []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c < F.col("seq")))
    base = cut_lineage(
        requests.join(budgets, "tenant_id", "left")
        .withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))
        .withColumn("_chunk", place)
    )
    waiting = base.filter("epsilon <= budget").select("request_id", "tenant_id", "seq", "epsilon", "_chunk", F.col("budget").alias("_left"))
    admitted: list[DataFrame] = []
    while True:
        judged = cut_lineage(_judge(waiting))
        if judged.isEmpty():
            break
        first = judged.filter("_drops").groupBy("tenant_id").agg(F.min(F.struct("seq", "request_id", "_after")).alias("_first"))
        told = judged.join(first, "tenant_id", "left")
        at, drop = F.struct("seq", "request_id"), F.struct("_first.seq", "_first.request_id")
        decided = F.col("_first").isNull() | (at < drop)
        admitted.append(told.filter((decided & F.col("_small")) | (at == drop)).select("request_id"))
        waiting = told.filter(~decided & (at != drop) & (F.col("epsilon") <= F.col("_first._after"))).select(
            "request_id", "tenant_id", "seq", "epsilon", "_chunk", F.col("_first._after").alias("_left")
        )
    yes = base.select("request_id").limit(0)
    for part in admitted:
        yes = yes.unionByName(part)
    decided = base.join(yes.withColumn("_yes", F.lit(True)), "request_id", "left").withColumn(
        "_spent", F.when(F.col("_yes"), F.col("epsilon")).otherwise(F.lit(0).cast("long"))
    )
    final = chunked_running_totals(decided, ["tenant_id"], "_chunk", ["seq", "request_id"], ["_spent"])
    after = F.col("budget") - F.col("cum__spent")
    return final.select(
        "request_id",
        "tenant_id",
        "epsilon",
        F.when(F.col("_yes"), "approved").otherwise("rejected").alias("allocation_status"),
        after.alias("remaining_budget"),
        (F.coalesce("_yes", F.lit(False)) & (after < LOW_BUDGET)).alias("low_budget"),
    )


def budget_consume(allocations: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outcome of each attempt ``(attempt_id, allocation_id, actual_epsilon)`` in order of ``attempt_id``.

    ``consumed`` for the first valid attempt, ``already_consumed`` after it, ``exceeds_allocation`` when more
    than the allocated amount is asked for, ``unknown_allocation`` otherwise. Without an amount the whole
    allocation is spent.
    """
    known = attempts.join(
        allocations.select("allocation_id", F.col("epsilon").alias("_held")), "allocation_id", "left"
    ).withColumn("_spent", F.coalesce("actual_epsilon", "_held"))
    valid = F.col("_held").isNotNull() & (F.col("_spent") <= F.col("_held"))
    first = known.filter(valid).groupBy("allocation_id").agg(F.min("attempt_id").alias("_first"))
    judged = known.join(first, "allocation_id", "left")
    outcome = (
        F.when(F.col("_held").isNull(), "unknown_allocation")
        .when(F.col("attempt_id") > F.col("_first"), "already_consumed")
        .when(~valid, "exceeds_allocation")
        .otherwise("consumed")
    )
    return judged.select(
        "attempt_id", "allocation_id", outcome.alias("outcome"), F.when(outcome == "consumed", F.col("_spent")).alias("epsilon_spent")
    )


def bound_contributions(df: DataFrame, sequence_key: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per sequence, the earliest ones; a per-task limit keeps hot sequences small."""
    nth = Window.partitionBy(sequence_key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= limit).drop("_nth")


def budget_per_sequence(df: DataFrame, sequence_key: str, epsilon: int) -> DataFrame:
    """``(sequences, rows, epsilon_per_sequence, epsilon_per_row_charge)``.

    A sequence job is charged once per sequence, not once per row.
    """
    per_key = df.groupBy(sequence_key).agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("sequences"), F.sum("n").alias("rows"), F.max("n").alias("longest")).select(
        "sequences",
        "rows",
        "longest",
        (F.col("sequences") * F.lit(int(epsilon))).alias("epsilon_by_sequence"),
        (F.col("rows") * F.lit(int(epsilon))).alias("epsilon_by_row"),
    )
