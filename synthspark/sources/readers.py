"""Scans: files, warehouse queries and exact-size samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions.columns import nan_to_null, union_all
from synthspark.functions.rng import md5_text
from synthspark.spec import SAMPLE_ROWS_MAX, SAMPLE_ROWS_MIN


def read_parquet(spark: SparkSession, uri: str, where: Column | str | None = None) -> DataFrame:
    """Column-pruned scan; NaN is read as null.

    ``where`` is applied before and after the NaN rule: the first reaches the file scan, the second drops rows
    that only matched as NaN.
    """
    if where is None:
        return nan_to_null(spark.read.parquet(uri))
    return nan_to_null(spark.read.parquet(uri).filter(where)).filter(where)


def read_csv(spark: SparkSession, uri: str, schema: T.StructType | str, sep: str = ",", **options: str) -> DataFrame:
    """CSV with a declared schema: no inference pass over the files."""
    return nan_to_null(spark.read.schema(schema).options(header=True, sep=sep, escape='"', **options).csv(uri))


def read_chunked(spark: SparkSession, uri: str, max_partition_bytes: int = 134_217_728) -> DataFrame:
    """Parquet in bounded pieces: the split size bounds what one task holds."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(max_partition_bytes)))
    return read_parquet(spark, uri)


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", max_files: int = 100
) -> DataFrame:
    """Parquet folder as a stream, a bounded number of files per trigger."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def read_warehouse_query(
    spark: SparkSession,
    query: str,
    staging: str,
    tenant_id: str,
    job_id: str,
    fmt: str = "sql",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Run a query where the data lives, stage the result as Parquet and return the staged table.

    ``fmt`` is ``sql`` for catalog tables, else the name of a connector: ``jdbc``, ``snowflake``, ``bigquery``.
    """
    if fmt == "sql":
        rows = spark.sql(query)
    else:
        rows = spark.read.format(fmt).options(**(options or {})).option("query", query).load()
    target = os.path.join(staging, "tab-staging", tenant_id, job_id, "source.parquet")
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def sample_rows(df: DataFrame, size: int, key: Column, seed: int = 42, total: int | None = None) -> DataFrame:
    """Exactly ``size`` rows, chosen by the MD5 of the key; all rows when the table is no larger.

    A threshold on the hash keeps about ``size`` rows before the ordered limit, so the last merge sees a
    bounded number of rows however large the table is.
    """
    if not SAMPLE_ROWS_MIN <= size <= SAMPLE_ROWS_MAX:
        raise ValueError(f"sample size must be within {SAMPLE_ROWS_MIN}..{SAMPLE_ROWS_MAX}")
    total = df.count() if total is None else total
    if total <= size:
        return df
    ticket = md5_text(key, seed)
    share = (size + 8.0 * size**0.5 + 8.0) / total
    picked = df
    if share < 1.0:
        bound = format(int(share * 16**12), "012x")
        near = df.filter(ticket < F.lit(bound))
        # 8 standard deviations of slack; the full table is the exact way out if they did not suffice.
        if near.count() >= size:
            picked = near
    return picked.orderBy(ticket).limit(size)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` of a table set."""
    return union_all(
        [t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in tables.items()]
    )
