"""Gapless numbers within groups, without sorting or gathering a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.session import stored


def numbered(rows: DataFrame, group: str, name: str, label: str = "numbered") -> DataFrame:
    """Input with ``name``: 0-based, gapless and unique within each value of the non-negative integer ``group``.

    Each task numbers its own rows per group while the table is written once; a small table of (task, group) counts
    gives each task its first number. A group of any size stays spread over the tasks.
    """
    place = rows.columns.index(group)
    fields = [T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, dealt = TaskContext.get().partitionId(), {}
        for batch in batches:
            groups = batch.column(place).to_numpy(zero_copy_only=False)
            nth = np.empty(len(groups), np.int64)
            order = np.argsort(groups, kind="stable")
            values, first, counts = np.unique(groups[order], return_index=True, return_counts=True)
            for value, at, n in zip(values.tolist(), first, counts):
                nth[order[at : at + n]] = dealt.get(value, 0) + np.arange(n)
                dealt[value] = dealt.get(value, 0) + int(n)
            tasks = pa.array(np.full(len(groups), task, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, tasks, pa.array(nth)], [*batch.schema.names, "_task", "_nth"])

    made = stored(rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields])), label)
    counts = made.groupBy("_task", group).agg(F.count("*").alias("n"))
    before = W.partitionBy(group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    joined = made.join(offsets, ["_task", group])
    return joined.withColumn(name, F.col("_before") + F.col("_nth")).select(*rows.columns, name)
