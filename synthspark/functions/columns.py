"""Column typing, null handling and wide-to-long reshaping shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_atomic(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def numeric_columns(df: DataFrame, with_boolean: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_boolean else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one kind of missing value here."""
    floats = {f.name for f in df.schema.fields if is_float(f.dataType)}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns]
    )


def as_double(df: DataFrame, name: str) -> Column:
    """Number used for statistics; text that is no number becomes null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return quoted(name).try_cast("double")
    if is_datetime(dtype):
        return seconds(quoted(name), dtype)
    return quoted(name).cast("double")


def seconds(column: Column, dtype: T.DataType) -> Column:
    """Seconds since 1970 with fraction, the same for both timestamp kinds under a UTC session."""
    return F.unix_micros(column.cast("timestamp")).cast("double") / 1e6


def as_text(df: DataFrame, name: str) -> Column:
    """Text form for grouping mixed types; -0.0 and 0.0 are one value."""
    dtype = df.schema[name].dataType
    if is_float(dtype):
        return (quoted(name) + F.lit(0.0)).cast("string")
    if not is_atomic(dtype):
        return F.to_json(F.struct(quoted(name)))
    return quoted(name).cast("string")


def unpivot_values(df: DataFrame, columns: list[str], keep: list[Column] | None = None) -> DataFrame:
    """Long form ``(column, num, txt, …keep)``: one row per cell.

    Floating columns travel as ``num`` only, texts as ``txt`` only, exact integers as both.
    """
    made, cells = [], []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        # Casts stay in a projection, which Spark compiles; the generator only passes their results on.
        if is_numeric(dtype):
            made.append((as_double(df, name) + F.lit(0.0)).alias(f"_num{i}"))
            number = F.col(f"_num{i}")
        if not is_float(dtype):
            made.append(as_text(df, name).alias(f"_txt{i}"))
            text = F.col(f"_txt{i}")
        cells.append(F.struct(F.lit(name).alias("column"), number.alias("num"), text.alias("txt")))
    keep = keep or []
    wide = df.select(*made, *[k.alias(f"_k{i}") for i, k in enumerate(keep)])
    names = df.select(*keep).columns if keep else []
    return wide.select(F.inline(F.array(*cells)), *[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)])


def one_row_to_long(df: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate ``{prefix}{i}`` into one row per name.

    ``fields`` maps an output field to the prefix of its wide columns.
    """
    rows = [
        F.struct(F.lit(name).alias("column"), *[F.col(f"{prefix}{i}").alias(out) for out, prefix in fields.items()])
        for i, name in enumerate(names)
    ]
    return df.select(F.inline(F.array(*rows)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; null without spread on either side."""
    left, right = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(left) * F.stddev_pop(right), F.lit(0.0)))


def doubles(values) -> Column:
    """Array of finite doubles as one parsed literal instead of one driver call per element."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def computed_once(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """Add value columns that later filters and projections use as they are.

    A plain projection is inlined into whatever follows it, which repeats long formulas in every condition.
    The output of a generator is not.
    """
    if not values:
        return df.select(*[quoted(k) for k in keep])
    # Formulas stay in a projection, which Spark compiles; the generator only passes their results on.
    made = df.select(*[quoted(k) for k in keep], *[v.alias(f"_once_{name}") for name, v in values.items()])
    row = F.array(F.struct(*[F.col(f"_once_{name}").alias(name) for name in values]))
    return made.select(*[quoted(k) for k in keep], F.inline(row))


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """Columns of several one-row frames in one row, by union and maximum instead of a join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
