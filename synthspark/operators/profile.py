"""Column profiles: null rates, types, moments, quantiles, top values, entropy and inferred rules.

Moments come from one wide aggregate without a shuffle of rows. Everything that needs distinct values
shares one ``(column, value) -> count`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions import columns as C
from synthspark.functions.distribution import exact_quantiles, value_counts
from synthspark.sources.readers import sample_rows

# Limits and name parts of the type rules.
ID_RATIO = 0.99
CATEGORY_COUNT = 50
CATEGORY_RATIO = 0.05
TEXT_RATIO = 0.8
TEXT_COUNT = 100
BOOLEAN_TEXTS = ["True", "False", "true", "false"]
NUMBER_ID_PARTS = ["_id", "id_", "uuid", "key", "pk", "fk"]
TEXT_ID_PARTS = ["_id", "id_", "code", "key", "pk", "fk"]
UUID_PARTS = ["uuid", "guid"]
DIGITS_PATTERN = r"\d+"
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Accepted date texts: ISO dates with an optional time part.
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def _missing(name: str) -> Column:
    return C.quoted(name).isNull()


def profile_nulls(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_fraction, total_rows)`` from one pass."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(_missing(c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("null_count"), F.col("_n").alias("total_rows"))
        for i, c in enumerate(df.columns)
    ]
    long = wide.select(F.inline(F.array(*rows)))
    fraction = F.when(F.col("total_rows") > 0, F.col("null_count") / F.col("total_rows")).otherwise(0.0)
    return long.select("column", "null_count", F.round(fraction, 4).alias("null_fraction"), "total_rows")


def profile_high_null_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns whose share of nulls is above the threshold."""
    nulls = profile_nulls(df)
    return nulls.filter(F.col("null_count") > threshold * F.col("total_rows")).select("column", "null_fraction")


def profile_distinct(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(column, unique_count, unique_ratio)``; the ratio is over all rows."""
    nulls = profile_nulls(df).select("column", "total_rows")
    if exact:
        found = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("unique_count"))
    else:
        wide = df.agg(*[F.approx_count_distinct(C.quoted(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
        found = C.one_row_to_long(wide, df.columns, {"unique_count": "d"})
    ratio = F.when(F.col("total_rows") > 0, F.col("unique_count") / F.col("total_rows")).otherwise(0.0)
    return (
        nulls.join(F.broadcast(found), "column", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
        .select("column", "unique_count", F.round(ratio, 6).alias("unique_ratio"))
    )


def column_facts(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Facts the type rules read: one row per column.

    Text rules run once per distinct value, not once per row.
    """
    counts = value_counts(df, df.columns) if counts is None else counts
    as_date = F.col("txt").rlike(DATE_TEXT) & F.col("txt").try_cast("timestamp").isNotNull()
    found = counts.groupBy("column").agg(
        F.count("*").alias("unique_count"),
        F.bool_and(F.col("txt").isin(BOOLEAN_TEXTS)).alias("only_boolean_text"),
        F.bool_and(as_date).alias("only_date_text"),
    )
    kinds = df.sparkSession.createDataFrame(
        [(i, f.name, _kind(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, kind string, dtype string",
    )
    return (
        profile_nulls(df)
        .join(F.broadcast(kinds), "column")
        .join(F.broadcast(found), "column", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
        .withColumn(
            "unique_ratio",
            F.when(F.col("total_rows") > 0, F.col("unique_count") / F.col("total_rows")).otherwise(0.0),
        )
    )


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if C.is_datetime(dtype):
        return "datetime"
    if C.is_integer(dtype):
        return "integer"
    if C.is_numeric(dtype):
        return "number"
    return "string" if isinstance(dtype, T.StringType) else "other"


def _named(parts: list[str]) -> Column:
    hits = [F.contains(F.lower("column"), F.lit(p)) for p in parts]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def sdtype_rules(facts: DataFrame) -> DataFrame:
    """Ordered type rules as one ``when`` chain over the facts; an all-null text column is categorical."""
    kind, ratio, distinct = F.col("kind"), F.col("unique_ratio"), F.col("unique_count")
    number = kind.isin("integer", "number")
    text = (kind == "string") & (distinct > 0)
    sdtype = (
        F.when(kind == "boolean", "boolean")
        .when(text & F.col("only_boolean_text"), "boolean")
        .when((kind == "datetime") | (text & F.col("only_date_text")), "datetime")
        .when((kind == "integer") & _named(NUMBER_ID_PARTS) & (ratio >= ID_RATIO), "id")
        .when(number & (distinct <= CATEGORY_COUNT) & (ratio < CATEGORY_RATIO), "categorical")
        .when(number, "numerical")
        .when(text & _named(UUID_PARTS), "id")
        .when(text & _named(TEXT_ID_PARTS) & (ratio >= ID_RATIO), "id")
        .when(text & (ratio > TEXT_RATIO) & (distinct > TEXT_COUNT), "text")
        .otherwise("categorical")
    )
    pattern = (
        F.when((F.col("sdtype") == "id") & (kind == "integer"), DIGITS_PATTERN)
        .when((F.col("sdtype") == "id") & _named(UUID_PARTS), UUID_PATTERN)
    )
    return facts.withColumn("sdtype", sdtype).withColumn("regex_format", pattern)


def detect_sdtype(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``(column, sdtype, regex_format, unique_count)`` per column."""
    typed = sdtype_rules(column_facts(df))
    return _override(typed, overrides).select("column", "sdtype", "regex_format", "unique_count")


def _override(typed: DataFrame, overrides: dict[str, str] | None) -> DataFrame:
    if not overrides:
        return typed
    forced = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return typed.withColumn("sdtype", F.coalesce(F.try_element_at(forced, F.col("column")), F.col("sdtype")))


# Relative error of the distinct sketch; four times this decides when a rule needs the exact count.
SKETCH_ERROR = 0.02


def sdtypes(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Driver-side map column -> type, equal to ``detect_sdtype``.

    Distinct counts come from sketches in one pass without a shuffle. Only columns whose sketch lies near a
    limit of a rule are counted exactly.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    place = {c: i for i, c in enumerate(df.columns)}
    aggs = [F.count("*").alias("_n")]
    for c, i in place.items():
        aggs.append(F.approx_count_distinct(C.quoted(c) if C.is_atomic(df.schema[c].dataType) else C.as_text(df, c), SKETCH_ERROR).alias(f"d{i}"))
    for c in texts:
        x = C.quoted(c)
        aggs.append(F.bool_and(x.isin(BOOLEAN_TEXTS)).alias(f"b{place[c]}"))
        aggs.append(F.bool_and(x.rlike(DATE_TEXT) & x.try_cast("timestamp").isNotNull()).alias(f"t{place[c]}"))
    row = df.agg(*aggs).first().asDict()
    total = row["_n"]
    limits = (CATEGORY_COUNT, TEXT_COUNT, CATEGORY_RATIO * total, TEXT_RATIO * total, ID_RATIO * total)
    distinct = {c: row[f"d{i}"] for c, i in place.items()}
    near = [c for c, d in distinct.items() if any(abs(d - limit) <= 4 * SKETCH_ERROR * max(d, limit) for limit in limits)]
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    near = [c for c in near if kinds[c] in ("integer", "number", "string")]
    if near:
        found = value_counts(df, near).groupBy("column").agg(F.count("*").alias("d")).collect()
        distinct.update({c: 0 for c in near})
        distinct.update({r["column"]: r["d"] for r in found})
    facts = df.sparkSession.createDataFrame(
        [
            (c, kinds[c], distinct[c], distinct[c] / total if total else 0.0, row.get(f"b{i}"), row.get(f"t{i}"))
            for c, i in place.items()
        ],
        "column string, kind string, unique_count long, unique_ratio double, only_boolean_text boolean, only_date_text boolean",
    )
    return {r["column"]: r["sdtype"] for r in _override(sdtype_rules(facts), overrides).collect()}


def _moments(df: DataFrame, names: list[str]) -> DataFrame:
    aggs = []
    for i, name in enumerate(names):
        x = C.as_double(df, name)
        n = F.count(x)
        aggs += [
            n.alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            # Bias-corrected skewness from the population one; null below three values, 0 without spread.
            F.when(n >= 3, F.coalesce(F.nanvl(F.skewness(x), F.lit(None)), F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / (n - 2)).alias(
                f"skew{i}"
            ),
        ]
    long = C.one_row_to_long(
        df.agg(*aggs), names, {"n": "n", "mean": "mean", "std": "std", "min": "min", "max": "max", "skewness": "skew"}
    )
    return long


def profile_numeric(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, extremes, exact quartiles and skewness of number columns."""
    names = names or C.numeric_columns(df)
    return _numeric_profile(_moments(df, names), _quartiles(df, names))


def _quartiles(df: DataFrame, names: list[str]) -> DataFrame:
    rows = [(c, *q) for c, q in exact_quantiles(df, names, [0.25, 0.5, 0.75]).items()]
    return df.sparkSession.createDataFrame(rows, "column string, q0 double, q1 double, q2 double")


def _numeric_profile(moments: DataFrame, quantiles: DataFrame) -> DataFrame:
    r6 = [F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")]
    return moments.join(F.broadcast(quantiles), "column", "left").select(
        "column",
        *r6,
        F.round("q0", 6).alias("q25"),
        F.round("q1", 6).alias("median"),
        F.round("q2", 6).alias("q75"),
        F.round("skewness", 4).alias("skewness"),
    )


def profile_categorical(df: DataFrame, names: list[str], top: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """``(column, value, frequency, rank)``: the most frequent values; ties by value.

    The rank filter becomes a per-task group limit, so no task sees all values of a wide column.
    """
    counts = _text_counts(value_counts(df, names) if counts is None else counts)
    sizes = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(sizes), "column").select(
        "column", "value", F.round(F.col("n") / F.col("_total"), 4).alias("frequency"), F.col("rank").cast("long").alias("rank")
    )


def _text_counts(counts: DataFrame) -> DataFrame:
    return counts.select("column", F.coalesce("txt", F.col("num").cast("string")).alias("value"), "n")


def profile_entropy(df: DataFrame, names: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Entropy in nats over all values: -sum p ln(p + 1e-10)."""
    counts = value_counts(df, names) if counts is None else counts
    sizes = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    p = F.col("n") / F.col("_total")
    return (
        counts.join(F.broadcast(sizes), "column")
        .groupBy("column")
        .agg(F.round(F.sum(-p * F.log(p + 1e-10)), 4).alias("entropy"))
    )


def profile_datetime(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column, min_date, max_date, date_range_days)``; days are whole 24 h units."""
    names = names or [f.name for f in df.schema.fields if C.is_datetime(f.dataType)]
    aggs = []
    for i, name in enumerate(names):
        stamp = C.quoted(name).try_cast("timestamp")
        aggs += [F.min(stamp).alias(f"lo{i}"), F.max(stamp).alias(f"hi{i}")]
    long = C.one_row_to_long(df.agg(*aggs), names, {"lo": "lo", "hi": "hi"})
    days = F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / 86_400_000_000)
    return long.select(
        "column", F.col("lo").cast("string").alias("min_date"), F.col("hi").cast("string").alias("max_date"),
        days.alias("date_range_days"),
    )


def infer_not_null(df: DataFrame) -> DataFrame:
    """A not-null rule for every column without nulls."""
    return profile_nulls(df).filter("null_count = 0").select("column", F.lit("not_null").alias("constraint_type"))


def infer_range(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Range rules with a margin of 1 % of the span, at least 1, for numerical columns."""
    if names is None:
        names = [c for c, kind in sdtypes(df).items() if kind == "numerical"]
    aggs = []
    for i, name in enumerate(names):
        x = C.as_double(df, name)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    long = C.one_row_to_long(df.agg(*aggs), names, {"lo": "lo", "hi": "hi"})
    return _ranges(long)


def _ranges(long: DataFrame) -> DataFrame:
    margin = F.greatest((F.col("hi") - F.col("lo")) * 0.01, F.lit(1.0))
    return long.filter("lo is not null").select(
        "column",
        F.lit("range").alias("constraint_type"),
        F.round(F.col("lo") - margin, 4).alias("min"),
        F.round(F.col("hi") + margin, 4).alias("max"),
    )


def analyze_table(
    df: DataFrame, sample_size: int | None = None, key: Column | None = None, overrides: dict[str, str] | None = None
) -> DataFrame:
    """The whole profile, one row per column: type, null rate, distinct count, moments, entropy and rules."""
    if sample_size is not None:
        df = sample_rows(df, sample_size, F.xxhash64(*[C.quoted(c) for c in df.columns]) if key is None else key)
    counts = value_counts(df, df.columns)
    typed = _override(sdtype_rules(column_facts(df, counts)), overrides)
    numbers = C.numeric_columns(df)
    moments = _moments(df, numbers)
    numeric = _numeric_profile(moments, _quartiles(df, numbers))
    ranges = _ranges(moments.select("column", F.col("min").alias("lo"), F.col("max").alias("hi")))
    entropy = profile_entropy(df, df.columns, counts)
    is_number = F.col("sdtype") == "numerical"
    out = typed.join(F.broadcast(numeric), "column", "left").join(
        F.broadcast(ranges.select("column", F.col("min").alias("rule_min"), F.col("max").alias("rule_max"))), "column", "left"
    ).join(F.broadcast(entropy), "column", "left")
    return out.select(
        "column",
        "sdtype",
        "null_fraction",
        "unique_count",
        "total_rows",
        (F.col("null_count") == 0).alias("rule_not_null"),
        *[F.when(is_number, F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "q25", "median", "q75", "skewness")],
        *[F.when(is_number, F.col(c)).alias(c) for c in ("rule_min", "rule_max")],
        F.when(F.col("sdtype") == "categorical", F.col("entropy")).alias("entropy"),
    )


# Spark type a user-chosen column type is stored as.
MAPPED_TYPES = {
    "numerical": "double",
    "categorical": "string",
    "boolean": "boolean",
    "datetime": "timestamp_ntz",
    "id": "string",
    "text": "string",
}


def apply_column_mappings(df: DataFrame, mappings: dict[str, str]) -> DataFrame:
    """Recast columns to user-chosen types; a cell that does not parse becomes null."""
    unknown = set(mappings) - set(df.columns)
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    return df.select(
        *[
            C.quoted(c).try_cast(MAPPED_TYPES[mappings[c]]).alias(c) if c in mappings else C.quoted(c)
            for c in df.columns
        ]
    )
