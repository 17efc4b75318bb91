"""Sinks: single and chunked exports, manifests, partitioned layout and generated parts."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.functions.distribution import chunked_running_totals
from synthspark.session import stored
from synthspark.spec import CHUNKED_EXPORT_ROWS, EXPORT_CHUNK_ROWS, OUTPUT_PART_ROWS

# Content type and default file name by format.
CONTENT_TYPES = {"parquet": "application/octet-stream", "csv": "text/csv", "jsonl": "application/x-ndjson"}
FILENAMES = {"parquet": "output.parquet", "csv": "output.csv", "jsonl": "output.jsonl"}
CODECS = ("snappy", "gzip", "zstd", "brotli", "lz4", "none")


def export_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, **more: Any) -> str:
    """Parquet with a codec; the row-group size is in bytes."""
    if compression not in CODECS:
        raise ValueError(f"unknown codec '{compression}', expected one of {CODECS}")
    if compression == "brotli" and not _has_class(df.sparkSession, "org.apache.hadoop.io.compress.BrotliCodec"):
        raise ValueError("the brotli codec is not on the class path of this Spark installation")
    writer = df.write.mode("overwrite").option("compression", {"lz4": "lz4_raw", "none": "uncompressed"}.get(compression, compression))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    _max_rows(writer, more).parquet(path)
    return path


def _has_class(spark: SparkSession, name: str) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(name)
        return True
    except Exception:  # noqa: BLE001 - any failure means the codec cannot be used
        return False


def _max_rows(writer, more: dict[str, Any]):
    return writer.option("maxRecordsPerFile", int(more["max_rows"])) if more.get("max_rows") else writer


# Parts in which the rows of one key are numbered, so that a frequent key is not one task's work.
_KEY_PARTS = 64


def row_numbers(df: DataFrame, key: str) -> DataFrame:
    """Input behind a dense 0-based ``index``, in the order of the key's MD5.

    Distinct keys get a running sum of their row counts, and rows of one key are numbered in parts.
    """
    rows = stored(df.select(F.coalesce(F.md5(C.quoted(key).cast("string")), F.lit("~")).alias("_label"), F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_all")), "rows")
    part = F.pmod(F.xxhash64("_row"), F.lit(_KEY_PARTS))
    parts = rows.groupBy("_label", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_label", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    keys = rows.groupBy("_label").agg(F.count("*").alias("_n")).withColumn("_chunk", F.substring("_label", 1, 3))
    first = chunked_running_totals(keys, [], "_chunk", ["_label"], ["_n"]).select("_label", (F.col("cum__n") - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_label", "_part").orderBy("_row")) - 1
    numbered = rows.withColumn("_part", part).withColumn("_nth", inside).join(parts, ["_label", "_part"]).join(first, "_label")
    index = (F.col("_first") + F.col("_ahead") + F.col("_nth")).cast("long").alias("index")
    return numbered.select(index, *[F.col("_all")[c].alias(c) for c in df.columns])


def export_csv(
    df: DataFrame, path: str, delimiter: str = ",", encoding: str = "UTF-8", include_index: bool = False,
    index_key: str | None = None, date_format: str | None = None, **more: Any,
) -> str:
    """CSV with header. The index column numbers rows densely in the hash order of ``index_key``.

    Rows that repeat a key get numbers next to each other; null keys come last.
    """
    if include_index:
        if index_key is None:
            raise ValueError("an index column needs a key column to number by")
        df = row_numbers(df, index_key)
    writer = df.write.mode("overwrite").option("header", True).option("sep", delimiter).option("encoding", encoding).option("escape", '"')
    if date_format:
        writer = writer.option("dateFormat", date_format).option("timestampFormat", date_format).option("timestampNTZFormat", date_format)
    _max_rows(writer, more).csv(path)
    return path


def export_jsonl(df: DataFrame, path: str, **more: Any) -> str:
    """One object per line; nulls are written."""
    _max_rows(df.write.mode("overwrite").option("ignoreNullFields", False), more).json(path)
    return path


WRITERS = {"parquet": export_parquet, "csv": export_csv, "jsonl": export_jsonl, "json": export_jsonl}


def _reader(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return {"parquet": spark.read.parquet, "csv": spark.read.option("header", True).csv}.get(fmt, spark.read.json)(path)


def export_chunked(df: DataFrame, path: str, fmt: str = "parquet", chunk_rows: int = EXPORT_CHUNK_ROWS, **options: Any) -> DataFrame:
    """Files of at most ``chunk_rows`` rows; returns ``(chunk_uri, rows, bytes)`` read back from storage."""
    if fmt not in WRITERS:
        raise ValueError(f"unsupported export format '{fmt}'")
    WRITERS[fmt](df, path, max_rows=chunk_rows, **options)
    back = _reader(df.sparkSession, path, "jsonl" if fmt == "json" else fmt)
    return back.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(
        F.count("*").alias("rows")
    ).select(F.col("file_path").alias("chunk_uri"), "rows", F.col("file_size").alias("bytes"))


def chunk_manifest(chunks: DataFrame, chunk_rows: int = EXPORT_CHUNK_ROWS) -> DataFrame:
    """One row: total rows, number of chunks, chunk size, total bytes and the largest chunk."""
    return chunks.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("num_chunks"),
        F.lit(chunk_rows).cast("long").alias("chunk_size"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("largest_chunk"),
    )


def export_dataset(df: DataFrame, path: str, fmt: str = "parquet", threshold: int = CHUNKED_EXPORT_ROWS, **options: Any) -> DataFrame:
    """Chunked export above the row threshold, else a plain one; metadata lie beside the data as ``.meta.json``."""
    if fmt not in WRITERS:
        raise ValueError(f"unsupported export format '{fmt}'")
    rows = df.count()
    chunked = rows > threshold
    if chunked:
        export_chunked(df, path, fmt, **options)
    else:
        WRITERS[fmt](df, path, **options)
    meta = {"format": fmt, "rows": rows, "columns": dict(df.dtypes), "chunked": chunked}
    text = df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".meta.json")
    return df.sparkSession.createDataFrame([(fmt, rows, chunked)], "output_format string, row_count long, chunked boolean")


def export_manifest(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """``(column, dtype, null_count, row_count, column_count, output_format, content_type, filename, bytes_written)``."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(C.quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"m{i}").alias("null_count"), F.col("_n").alias("row_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    size = list_artifacts(df.sparkSession, path).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    return wide.select(F.inline(F.array(*rows))).select(
        "*",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(fmt).alias("output_format"),
        F.lit(CONTENT_TYPES[fmt]).alias("content_type"),
        F.lit(FILENAMES[fmt]).alias("filename"),
        F.lit(size).cast("long").alias("bytes_written"),
    )


def write_partitioned(df: DataFrame, root: str, tenant: str = "tenant_id", job: str = "job_id") -> str:
    """Tables of many jobs below ``tab-jobs``, isolated by tenant and job folders; reads prune folders."""
    target = os.path.join(root, "tab-jobs")
    df.write.mode("append").partitionBy(tenant, job).parquet(target)
    return target


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """``(uri, bytes)`` of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("bytes")).filter(~F.col("uri").rlike(r"/[_.][^/]*$"))


def generate_parts(model: Any, n: int, path: str, part_rows: int = OUTPUT_PART_ROWS, seed: int = 0) -> DataFrame:
    """Write ``n`` sampled rows in parts of bounded size; nothing is gathered. Returns the part list."""
    return export_chunked(model.sample(n, seed=seed), path, "parquet", part_rows)

