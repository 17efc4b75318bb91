"""Key links between tables: inclusion of values, uniqueness of the parent and likeness of names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions import columns as C
from synthspark.spec import Relationship


# Texts longer than this are compared by a hash of 128 bits.
LONG_VALUE = 64


def _key_like(dtype: T.DataType) -> bool:
    return C.is_integer(dtype) or isinstance(dtype, T.StringType)


def _stem(name: str) -> str:
    """Column name without the table prefix: ``o_custkey`` -> ``custkey``."""
    return re.sub("^[A-Za-z]{1,2}_", "", name).lower()


def _name_score(parent: str, child: str) -> float:
    return 1.0 if _stem(parent) == _stem(child) else 0.75 if child.endswith(parent) else 0.0


def _candidates(tables: dict[str, DataFrame], least: float) -> list[tuple[str, str, str, str, str, float]]:
    """``(kind, parent table, column, child table, column, score)`` of all pairs whose names are alike; schema only."""
    keys = [
        (table, f.name, "integer" if C.is_integer(f.dataType) else "string")
        for table, df in tables.items()
        for f in df.schema.fields
        if _key_like(f.dataType)
    ]
    pairs = [(k, pt, pc, ct, cc, _name_score(pc, cc)) for pt, pc, k in keys for ct, cc, kind in keys if k == kind and pt != ct]
    return [p for p in pairs if p[-1] >= least]


def _value(name: str) -> Column:
    """A value as text; long ones by their MD5, which travels lighter."""
    text = C.quoted(name).cast("string")
    return F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)


def _distinct_values(tables: dict[str, DataFrame], wanted: set[tuple[str, str]]) -> DataFrame:
    """``(table_name, column, kind, value, n)`` of the wanted columns; others are not read."""
    parts = []
    for table, df in tables.items():
        cells = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(f.name).alias("column"),
                F.lit("integer" if C.is_integer(f.dataType) else "string").alias("kind"),
                _value(f.name).alias("value"),
            )
            for f in df.schema.fields
            if (table, f.name) in wanted
        ]
        if cells:
            long = df.select(F.inline(F.array(*cells))).filter("value is not null")
            parts.append(long.groupBy("table_name", "column", "kind", "value").agg(F.count("*").alias("n")))
    return C.union_all(parts)


def detect_relationships(tables: dict[str, DataFrame], min_name_score: float = 0.5) -> DataFrame:
    """``(parent_table, parent_column, child_table, child_column, name_score, cardinality)``.

    Names are paired first, from the schemas; only columns with a likely partner are read. One shuffle by value then
    gathers, per value, the list of columns that hold it; the list is bounded by the schema. A child column is
    included in a parent when both meet on every distinct value of the child. A parent without repeated values gives
    ``1:N``; if values repeat on both sides the link is ``N:N``, and goes both ways if each side includes the other.
    """
    spark = next(iter(tables.values())).sparkSession
    pairs = _candidates(tables, min_name_score)
    names = "kind string, parent_table string, parent_column string, child_table string, child_column string, name_score double"
    wanted = {(p[1], p[2]) for p in pairs} | {(p[3], p[4]) for p in pairs}
    if not wanted:
        return spark.createDataFrame([], names + ", cardinality string").drop("kind")
    values = _distinct_values(tables, wanted)
    per_column = values.groupBy("table_name", "column", "kind").agg(F.count("*").alias("distinct"), F.max("n").alias("most"))
    # The condition on the count keeps the columns of this branch equal to the other one's, so both read one
    # exchange and the tables are scanned once.
    held = values.filter("n > 0").groupBy("kind", "value").agg(F.collect_set(F.struct("table_name", "column")).alias("holders"))
    met = (
        held.select("kind", "value", F.explode("holders").alias("c"), "holders")
        .select("kind", "value", "c", F.explode("holders").alias("p"))
        .filter("c.table_name <> p.table_name")
        .groupBy(
            "kind",
            F.col("p.table_name").alias("parent_table"), F.col("p.column").alias("parent_column"),
            F.col("c.table_name").alias("child_table"), F.col("c.column").alias("child_column"),
        )
        .agg(F.count("*").alias("shared"))
    )
    # These three tables have a row per column or pair of columns: bounded by the schema and not by the data.
    parents = per_column.select(F.col("table_name").alias("parent_table"), F.col("column").alias("parent_column"), F.col("most").alias("parent_most"))
    children = per_column.select(
        F.col("table_name").alias("child_table"), F.col("column").alias("child_column"), "distinct", F.col("most").alias("child_most")
    )
    named = F.broadcast(spark.createDataFrame(pairs, names))
    linked = met.join(named, ["kind", "parent_table", "parent_column", "child_table", "child_column"])
    linked = linked.join(F.broadcast(parents), ["parent_table", "parent_column"]).join(F.broadcast(children), ["child_table", "child_column"])
    linked = linked.filter("shared = distinct AND (parent_most = 1 OR child_most > 1)")
    return linked.select(
        "parent_table", "parent_column", "child_table", "child_column", "name_score",
        F.when(F.col("parent_most") > 1, "N:N").otherwise("1:N").alias("cardinality"),
    )


def relationship_cardinality(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """``(parent_max_rows, child_max_rows, cardinality)``: N:N when the parent key repeats."""
    def most(df: DataFrame, key: str, name: str) -> DataFrame:
        per_key = df.filter(C.quoted(key).isNotNull()).groupBy(C.quoted(key)).agg(F.count("*").alias("n"))
        return per_key.agg(F.max("n").alias("n")).select(F.lit(name).alias("side"), "n")

    both = most(parent, parent_key, "parent").unionByName(most(child, child_key, "child"))
    wide = both.agg(
        F.max(F.when(F.col("side") == "parent", F.col("n"))).alias("parent_max_rows"),
        F.max(F.when(F.col("side") == "child", F.col("n"))).alias("child_max_rows"),
    )
    return wide.withColumn("cardinality", F.when(F.col("parent_max_rows") > 1, "N:N").otherwise("1:N"))


def collect_relationships(tables: dict[str, DataFrame]) -> list[Relationship]:
    """Detected links to a parent's key as plain objects; N:N links have none and are left to ``detect_relationships``."""
    rows = detect_relationships(tables).filter("cardinality = '1:N'").orderBy("parent_table", "child_table", "child_column").collect()
    return [
        Relationship(r["parent_table"], r["parent_column"], r["child_table"], r["child_column"], r["cardinality"])
        for r in rows
    ]
