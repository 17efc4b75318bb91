"""Named queries with their reference SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.session import tune
from synthspark.sources.readers import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass
class Tables:
    """Lazy access to the tables of one folder."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def plain(self, name: str) -> DataFrame:
        """Dates as text, -0.0 as 0.0: the form that two engines print alike."""
        df = getattr(self, name)
        out = []
        for f in df.schema.fields:
            kind = f.dataType.simpleString()
            if kind.startswith("timestamp"):
                out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
            elif kind in ("double", "float"):
                out.append((F.col(f.name) + F.lit(0.0)).alias(f.name))
            else:
                out.append(F.col(f.name))
        return df.select(*out)

    def derived(self, select: str, name: str) -> DataFrame:
        """A select list over one table; the same text runs in the reference SQL."""
        return getattr(self, name).selectExpr(*[e.strip() for e in select.split(";") if e.strip()])


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its reference SQL when there is one."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def as_select(select: str, table: str) -> str:
    return "(SELECT " + ", ".join(e.strip() for e in select.split(";") if e.strip()) + f" FROM {table})"


# Derived tables. Every one keeps all rows of its source.
ORDERS_MISSING = """
o_orderkey; CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey;
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus;
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice; o_orderpriority
"""
ORDERS_MAR = """
o_orderkey; o_custkey; CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_orderpriority END AS o_orderpriority; o_totalprice
"""
ORDERS_REAL = "o_orderkey; o_custkey; o_orderstatus; o_totalprice; o_orderpriority"
ORDERS_NOISY = """
o_orderkey; o_custkey; CASE WHEN o_orderkey % 9 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus;
CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice;
CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority
"""
ORDERS_SHIFTED = """
o_orderkey; o_custkey + 7 AS o_custkey; o_orderstatus; o_totalprice + 1000.25 AS o_totalprice; o_orderpriority
"""
ORDERS_BAD = """
o_orderkey; CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey;
CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus; o_totalprice; o_orderpriority
"""
POINTS = """
CAST(o_orderkey AS STRING) AS run_id; o_orderpriority AS generator_type; (o_custkey % 100 + 1) / 10.0D AS epsilon;
(CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0D AS fidelity_score; (o_custkey * 37 % 1000) / 1000.0D AS privacy_score;
(o_orderkey * 61 % 1009) / 1009.0D AS utility_score; o_totalprice / 1000.0D AS training_time_s;
o_totalprice / 10000.0D AS generation_time_s; o_orderkey AS num_rows
"""
# The same lists in the other engine's spelling.
POINTS_SQL = POINTS.replace("AS STRING", "AS VARCHAR").replace("0D", "0::DOUBLE")
