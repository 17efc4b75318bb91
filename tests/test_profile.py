"""Profiles of small hand-made frames."""

import pytest

from synthspark.operators import profile as P
from synthspark.operators import relationships as R
from synthspark.sources import readers as S
from tests.conftest import rows


def kinds(df):
    exact = {r["column"]: r["sdtype"] for r in P.detect_sdtype(df).collect()}
    assert P.sdtypes(df) == exact
    return exact


def test_types(spark):
    data = [
        (i, f"c{i}", "true" if i % 2 else "False", "2024-01-02 03:04:05", None, i % 3, float(i) / 7, f"x{i % 4}", f"monkey{i}", [i])
        for i in range(200)
    ]
    schema = "user_id long, item_code string, flag string, day string, void string, small int, amount double, grp string, note string, arr array<int>"
    got = kinds(spark.createDataFrame(data, schema))
    assert got == {
        "user_id": "id", "item_code": "id", "flag": "boolean", "day": "datetime", "void": "categorical", "small": "categorical",
        "amount": "numerical", "grp": "categorical", "note": "text", "arr": "categorical",
    }


def test_types_follow_the_tables(tables):
    for name in ("orders", "lineitem", "customer", "events", "part"):
        kinds(getattr(tables, name))


def test_override(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert P.sdtypes(df, {"a": "id"})["a"] == "id"


def test_numeric_of_short_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 7.0)], "a double, b double")
    got = {r["column"]: r for r in P.profile_numeric(df).collect()}
    assert got["a"]["std"] is None and got["a"]["skewness"] is None and got["a"]["median"] == 1.0
    assert got["b"]["mean"] == 6.0 and got["b"]["q25"] == 5.5 and got["b"]["skewness"] is None


def test_constant_column_has_no_skew(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "a double")
    assert P.profile_numeric(df).first()["skewness"] == 0.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(P.profile_nulls(df)) == [("a", 0, 0.0, 0), ("b", 0, 0.0, 0)]
    assert {r["unique_count"] for r in P.profile_distinct(df).collect()} == {0}
    assert kinds(df) == {"a": "categorical", "b": "categorical"}


def test_entropy_and_top_values(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "s string")
    assert rows(P.profile_categorical(df, ["s"], 2)) == [("s", "a", 0.5, 1), ("s", "b", 0.25, 2)]
    assert P.profile_entropy(df, ["s"]).first()["entropy"] == 1.0397


def test_nan_reads_as_null(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1.0,), (float("nan"),), (9.0,)], "a double").write.parquet(path)
    assert P.profile_nulls(S.read_parquet(spark, path)).first()["null_count"] == 1
    kept = S.read_parquet(spark, path, "a > 2")
    assert rows(kept) == [(9.0,)]
    assert "GreaterThan(a,2.0)" in kept._jdf.queryExecution().executedPlan().toString()


def test_sample_is_exact_and_layout_free(spark):
    df = spark.range(20_000)
    a = rows(S.sample_rows(df.repartition(3), 700, df["id"]))
    b = rows(S.sample_rows(df.repartition(11), 700, df["id"]))
    assert a == b and len(a) == 700
    assert S.sample_rows(df.limit(50), 700, df["id"]).count() == 50
    with pytest.raises(ValueError):
        S.sample_rows(df, 5, df["id"])


def test_links_need_matching_names(tables):
    found = {
        (r["parent_table"], r["child_table"], r["child_column"])
        for r in R.detect_relationships({n: getattr(tables, n) for n in ("customer", "orders", "events")}).collect()
    }
    # Event users lie within customer numbers by accident.
    assert found == {("customer", "orders", "o_custkey")}


def test_links_by_name_and_repeats(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x_key int, notes string")
    many = spark.createDataFrame([(1, "a" * 100), (1, "b"), (2, None)], "y_key int, body string")
    more = spark.createDataFrame([(1,), (2,), (2,)], "z_key int")
    found = {tuple(r) for r in R.detect_relationships({"one": one, "many": many, "more": more}).collect()}
    assert found == {
        ("one", "x_key", "many", "y_key", 1.0, "1:N"), ("one", "x_key", "more", "z_key", 1.0, "1:N"),
        ("many", "y_key", "more", "z_key", 1.0, "N:N"), ("more", "z_key", "many", "y_key", 1.0, "N:N"),
    }
    assert {r.parent_table for r in R.collect_relationships({"one": one, "many": many, "more": more})} == {"one"}
    assert R.detect_relationships({"one": one.select("notes"), "many": many.select("body")}).count() == 0


def test_many_to_many(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert R.relationship_cardinality(a, "k", a, "k").first()["cardinality"] == "N:N"
