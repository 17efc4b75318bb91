"""Job life cycle as an event table: latest status, illegal jumps, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal moves between job states.
TRANSITIONS = {
    "queued": ["training", "failed"],
    "training": ["generating", "failed"],
    "generating": ["validating", "failed"],
    "validating": ["complete", "failed"],
    "complete": [],
    "failed": [],
}
PAGE_LIMIT = 100


def job_events(events: DataFrame, path: str) -> DataFrame:
    """Append events ``(job_id, tenant_id, status, ts)`` to the event table and return the table."""
    events.write.mode("append").parquet(path)
    return events.sparkSession.read.parquet(path)


def job_status(events: DataFrame) -> DataFrame:
    """``(job_id, status)``: the latest one; equal times resolve by event id."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def previous(df: DataFrame, key: str, order: list[str], value: str, chunk: Column, out: str) -> DataFrame:
    """Value of the previous row per key, computed inside chunks that ascend with the order.

    The first row of a chunk takes the last value of the key's chunk before it, so a hot key is as many
    tasks as it has chunks.
    """
    chunked = df.withColumn("_chunk", chunk)
    stamp = F.struct(*order)
    last = chunked.groupBy(key, "_chunk").agg(F.max_by(value, stamp).alias("_last"), F.min(stamp).alias("_head"))
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    heads = last.select(key, F.col("_head"), F.lag("_last").over(by_chunk).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    local = chunked.withColumn("_lag", F.lag(value).over(inside)).withColumn("_head", stamp)
    return local.join(heads, [key, "_head"], "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("_lag", "_carry").alias(out)
    )


def legal(before: Column, after: Column) -> Column:
    """True when a move is allowed; a job starts as queued."""
    moves = F.create_map(*[x for s, nxt in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in nxt]).cast("array<string>"))])
    return F.when(before.isNull(), after == "queued").otherwise(
        F.coalesce(F.array_contains(F.try_element_at(moves, before), after), F.lit(False))
    )


def invalid_transitions(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """``(event_id, job_id, previous_status, status)`` of moves that are not allowed."""
    chunk = F.date_trunc("day", F.col("ts")) if chunk is None else chunk
    stepped = previous(events, "job_id", ["ts", "event_id"], "status", chunk, "previous_status")
    return stepped.filter(~legal(F.col("previous_status"), F.col("status"))).select(
        "event_id", "job_id", "previous_status", "status"
    )


def list_jobs(jobs: DataFrame, tenant_id, status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a tenant's jobs, newest first, with the total count on every row."""
    size = min(page_size, PAGE_LIMIT)
    chosen = jobs.filter(F.col("tenant_id") == tenant_id)
    if status is not None:
        chosen = chosen.filter(F.col("status") == status)
    total = chosen.agg(F.count("*").alias("total")).first()["total"]
    rows = chosen.orderBy(F.col("created_at").desc(), F.col("job_id")).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", F.lit(total))
