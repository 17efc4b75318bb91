"""Queries that drive Structured Streaming over the event and order files."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.generators.copula import copula_fit
from synthspark.operators import fidelity as Q
from synthspark.plans.catalog_scores import JOB_EVENTS, TRANSITIONS_SQL
from synthspark.plans.registry import query
from synthspark.session import scratch_path, stored
from synthspark.sources.readers import read_stream
from synthspark.spec import Constraint
from synthspark.streaming import jobs as J
from synthspark.streaming.copula import stream_fit_copula
from synthspark.streaming.transitions import stream_transitions


def _stream(t, table: str):
    return read_stream(t.spark, t.folder, getattr(t, table).schema, f"{table}.parquet")


NUMBERS = ["event_id", "user_id", "value"]


@query(
    "stream_fit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM events"""
        for c in NUMBERS
    ),
)
def _(t):
    moments = J.stream_fit(_stream(t, "events"), NUMBERS, scratch_path(t.spark, "stream-fit"))
    out = J.moments_summary(moments, NUMBERS)
    return out.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query(
    "stream_profile",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS rows,
       count_if(value IS NULL) AS null_count, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY ALL""",
)
def _(t):
    events = _stream(t, "events")
    out = J.stream_profile(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type", scratch_path(t.spark, "stream-profile"))
    return out.withColumn("mean", F.round("mean", 9))


@query(
    "stream_validate",
    """SELECT violated, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN value < 10 OR value > 90 THEN '0' END,
         CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN '1' END,
         CASE WHEN NOT regexp_matches(props, '^(?:\\{"k": [0-4])') THEN '2' END) AS violated FROM events) GROUP BY violated""",
)
def _(t):
    rules = [
        Constraint("value", "range", {"min": 10, "max": 90}),
        Constraint("event_type", "enum", {"allowed_values": ["view", "click", "purchase"]}),
        Constraint("props", "regex", {"pattern": r'\{"k": [0-4]'}),
    ]
    clean, bad = J.stream_validate(_stream(t, "events"), rules, scratch_path(t.spark, "stream-validate"))
    return clean.agg(F.count("*").alias("n")).select(F.lit("").alias("violated"), "n").unionByName(
        bad.groupBy("violated").agg(F.count("*").alias("n"))
    )


@query("stream_unique", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    pairs = _stream(t, "events").select("user_id", "event_type")
    return J.stream_unique(pairs, ["user_id", "event_type"], scratch_path(t.spark, "stream-unique"), unbounded=True)


@query("stream_generate_parts", "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_numbers, 0::BIGINT AS differs_from_batch FROM orders")
def _(t):
    kinds = {"o_custkey": "numerical", "o_orderstatus": "categorical", "o_totalprice": "numerical"}
    model = copula_fit(t.orders.select(*kinds), kinds, "empirical")
    made = J.stream_generate_parts(_stream(t, "orders"), "o_orderkey", model, scratch_path(t.spark, "stream-parts"))
    rows = t.orders.select(F.col("o_orderkey").alias("__row"))
    batch = model.decode(model.latent(rows), keep=["__row"])
    differs = made.exceptAll(batch).count()
    return made.agg(
        F.count("*").alias("n_rows"), F.count_distinct("__row").alias("n_numbers"), F.lit(differs).alias("differs_from_batch")
    )


FLOWS = {"l_quantity": "numerical", "l_extendedprice": "numerical", "l_discount": "numerical", "l_shipdate": "datetime", "l_returnflag": "categorical"}


@query(
    "stream_fit_copula",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, {low} AS low, {high} AS high, true AS ranks_close,
            true AS correlations_close, true AS sample_close FROM lineitem"""
        for c, low, high in [(c, f"min({c})::DOUBLE", f"max({c})::DOUBLE") for c in ("l_quantity", "l_extendedprice", "l_discount")]
        + [("l_shipdate", "epoch(min(l_shipdate))::DOUBLE", "epoch(max(l_shipdate))::DOUBLE")]
    ),
)
def _(t):
    """Merged sketches against exact ranks, and the correlations and samples against those of a batch fit."""
    real = t.lineitem.select(*FLOWS)
    model = stream_fit_copula(_stream(t, "lineitem").select(*FLOWS), FLOWS, scratch_path(t.spark, "stream-copula"))
    batch = copula_fit(real, FLOWS, "empirical")
    near = bool((abs(model.correlation - batch.correlation) < 0.05).all())
    n = real.count()
    made = stored(model.sample(n, seed=3))
    judged = {c: k for c, k in FLOWS.items() if k != "datetime"}
    shape = Q.column_shapes(real.select(*judged), made.select(*judged), judged).agg(F.min("score")).first()[0]
    numbers = [m for m in model.marginals if m.kind == "number"]
    aggs = []
    for k, m in enumerate(numbers):
        x = C.as_double(real, m.name)
        # A quantile's rank may be anywhere between the shares below it and up to it.
        for q in (16, 32, 48):
            aggs += [F.avg((x < m.grid[q]).cast("int")).alias(f"lo{k}_{q}"), F.avg((x <= m.grid[q]).cast("int")).alias(f"hi{k}_{q}")]
    row = real.agg(*aggs).first()
    out = []
    for k, m in enumerate(numbers):
        close = all(row[f"lo{k}_{q}"] - 0.01 <= q / 64 <= row[f"hi{k}_{q}"] + 0.01 for q in (16, 32, 48))
        facts = {"column": m.name, "n_rows": n, "low": m.low, "high": m.high, "ranks_close": close, "correlations_close": near, "sample_close": shape > 0.9}
        out.append(F.struct(*[F.lit(v).alias(name) for name, v in facts.items()]))
    return t.spark.range(1).select(F.inline(F.array(*out))).withColumn("n_rows", F.col("n_rows").cast("long"))


@query("stream_transitions", TRANSITIONS_SQL)
def _(t):
    """All events as a stream, then, from the checkpoint, a row far ahead that lets the watermark pass them all."""
    events = t.derived(JOB_EVENTS, "events").select("event_id", "job_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    root, closing = scratch_path(t.spark, "stream-transitions"), scratch_path(t.spark, "closing")
    last = events.agg(F.max("ts").alias("ts"))
    blank = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("event_id", "job_id", "status")]
    ahead = last.select(*blank, (F.col("ts") + F.expr("interval 2 days")).alias("ts"))
    ahead.limit(0).write.parquet(closing)
    columns = [e.strip() for e in JOB_EVENTS.split(";")]
    flow = _stream(t, "events").selectExpr(*columns).select("event_id", "job_id", "status", F.col("ts").cast("timestamp").alias("ts"))

    def run():
        return stream_transitions(flow.unionByName(read_stream(t.spark, closing, events.schema)), root, "1 day")

    run()
    ahead.write.mode("append").parquet(closing)
    return run()
