"""Checks and repairs on small hand-made frames."""

import pytest

from synthspark.operators import constraints as K
from synthspark.spec import Constraint, Relationship
from tests.conftest import rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, 5.0, "a", "AB1", 10), (2, None, "z", "xB2", 99), (3, 500.0, None, None, None), (4, -3.0, "b", "AB", 10)],
        "id int, x double, g string, code string, fk int",
    )


def test_messages(frame):
    rules = [
        Constraint("x", "not_null"),
        Constraint("x", "range", {"min": 0, "max": 100}),
        Constraint("g", "enum", {"allowed_values": ["a", "b"]}),
        Constraint("g", "enum", {"allowed_values": []}),
        Constraint("fk", "foreign_key", {"parent_values": [10, 11]}),
        Constraint("fk", "foreign_key", {"parent_values": []}),
        Constraint("fk", "unique"),
        Constraint("code", "regex", {"pattern": "AB|x"}),
        Constraint("code", "regex", {"pattern": "B"}),
        Constraint("code", "regex", {"pattern": "("}),
        Constraint("gone", "unique"),
    ]
    got = K.validate(frame, rules)
    assert got[:6] == [
        "Column 'x' has 1 missing cells where the rule allows none",
        "Column 'x' has 1 cells smaller than 0",
        "Column 'x' has 1 cells larger than 100",
        "Column 'g' has 1 cells outside the listed values, among them [z]",
        "Column 'fk' has 1 cells without a parent; the parent table offers 2 keys",
        "Column 'fk' has 1 cells that repeat an earlier one",
    ]
    assert got[6] == "Column 'code' has 3 cells that do not match the pattern 'B'"
    assert got[7].startswith("Pattern rule of column 'code' cannot be compiled")
    assert got[8] == "Column 'gone' is missing from the table" and len(got) == 9


def test_report_totals(frame):
    rules = [Constraint("x", "range", {"min": 0, "max": 100}), Constraint("id", "unique")]
    report = K.violation_report(frame, rules)
    assert [(r["passed"], r["violation_count"], r["violating_rows"]) for r in report.orderBy("position").collect()] == [
        (False, 2, 2), (True, 0, 0),
    ]
    assert tuple(K.violation_totals(report).first()) == (2, 1, 2, False)


def test_repairs(frame):
    assert [r["x"] for r in K.repair_range(frame, "x", 0, 100).orderBy("id").collect()] == [5.0, None, 100.0, 0.0]
    fixed = K.repair_enum(frame, "g", ["a", "b"], ["id"]).orderBy("id").collect()
    assert fixed[1]["g"] in ("a", "b") and fixed[2]["g"] is None
    assert [r["g"] for r in K.repair_not_null(frame, "g").orderBy("id").collect()] == ["a", "z", "a", "b"]


def test_repair_does_not_depend_on_layout(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as fk")
    parents = spark.createDataFrame([(i,) for i in (100, 101, 102, 3)], "k int")
    one = rows(K.enforce_foreign_key(df.repartition(1), "fk", parents, ["id"]))
    many = rows(K.enforce_foreign_key(df.repartition(7), "fk", parents, ["id"]))
    assert one == many
    assert {r[1] for r in one} == {100, 101, 102, 3}


def test_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, fk int")
    parents = spark.createDataFrame([(5,)], "k int")
    assert rows(K.enforce_foreign_key(df, "fk", parents, ["id"])) == [(1, 5), (2, 5)]
    assert rows(K.enforce_foreign_key(df, "fk", parents, ["id"], replace_nulls=False)) == [(1, None), (2, 5)]
    assert rows(K.enforce_foreign_key(df, "fk", parents.limit(0), ["id"])) == [(1, None), (2, 5)]


def test_unique_keeps_first_and_one_null(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "c")], "id int, v string")
    taken = spark.createDataFrame([("c",)], "v string")
    assert rows(K.enforce_uniqueness(df, "v", ["id"], taken), "id") == [(1, "a"), (2, None)]


def test_dense_index(spark):
    keys = spark.range(10_000).selectExpr("id as _key")
    index = K.indexed_keys(keys)
    assert sorted(r["_index"] for r in index.collect()) == list(range(10_000))


def test_parents_are_repaired_first(spark):
    a = spark.createDataFrame([(1,), (2,)], "a int")
    b = spark.createDataFrame([(1, 1), (2, 77)], "b int, a int")
    c = spark.createDataFrame([(1, 1), (2, 99)], "c int, b int")
    links = [Relationship("b", "b", "c", "b"), Relationship("a", "a", "b", "a")]
    assert [r.child_table for r in K.parents_first(links)] == ["b", "c"]
    out = K.enforce_referential_integrity({"a": a, "b": b, "c": c}, links, {"b": ["b"], "c": ["c"]})
    assert out["c"].join(out["b"], "b", "left_anti").count() == 0 and out["b"].join(a, "a", "left_anti").count() == 0


def test_apply_until_clean(frame):
    rules = [
        Constraint("x", "range", {"min": 0, "max": 100}), Constraint("g", "enum", {"allowed_values": ["a", "b"]}), Constraint("g", "not_null"),
    ]
    assert K.validate(K.apply_constraints(frame, rules, keys=["id"]), rules) == []
    hopeless = [Constraint("code", "regex", {"pattern": "Q"})]
    with pytest.raises(ValueError, match="After 5 rounds"):
        K.apply_constraints(frame, hopeless, keys=["id"], raise_on_unresolvable=True)


def test_scans_do_not_grow_with_rules(spark, tmp_path):
    """Any number of rules reads the table three times: row rules, table rules, samples of the lists."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, k % 7, f"v{k % 11}", k / 2) for k in range(200)], "id long, fk int, g string, x double").write.parquet(path)
    df = spark.read.parquet(path)
    parent = spark.createDataFrame([(k,) for k in (0, 1, 2, 2, None)], "key long")
    few = [
        Constraint("id", "unique"), Constraint("g", "enum", {"allowed_values": ["v0"]}), Constraint("x", "not_null"),
        Constraint("fk", "foreign_key", {"parent_table": "p", "parent_key": "key"}),
    ]
    many = few + [Constraint(c, "unique") for c in ("fk", "g", "x")] + [Constraint("g", "enum", {"allowed_values": [f"v{k}"]}) for k in range(5)]
    many += [Constraint("x", "foreign_key", {"parent_table": "p", "parent_key": "key"}), Constraint("fk", "foreign_key", {"parent_table": "none", "parent_key": "key"})]

    def scans(rules):
        plan = K.violation_messages(df, rules, {"p": parent})._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("parquet")

    assert scans(few) == scans(many) == 3
    assert K.validate(df, many, {"p": parent}) == [
        "Column 'g' has 181 cells outside the listed values, among them [v1, v10, v2, v3, v4]",
        "Column 'fk' has 113 cells without a parent; the parent table offers 3 keys",
        "Column 'fk' has 193 cells that repeat an earlier one",
        "Column 'g' has 189 cells that repeat an earlier one",
        "Column 'g' has 181 cells outside the listed values, among them [v1, v10, v2, v3, v4]",
        "Column 'g' has 181 cells outside the listed values, among them [v0, v10, v2, v3, v4]",
        "Column 'g' has 182 cells outside the listed values, among them [v0, v1, v10, v3, v4]",
        "Column 'g' has 182 cells outside the listed values, among them [v0, v1, v10, v2, v4]",
        "Column 'g' has 182 cells outside the listed values, among them [v0, v1, v10, v2, v3]",
        "Column 'x' has 197 cells without a parent; the parent table offers 3 keys",
    ]


def test_keys_of_other_types_and_empty_parents(spark):
    df = spark.createDataFrame([("1", 1.0, 1), ("2", 1.5, 2), (None, None, None), ("x", 2.0, 9)], "s string, d double, i int")
    parent = spark.createDataFrame([(1,), (2,)], "key int")
    rules = [Constraint(c, "foreign_key", {"parent_table": t, "parent_key": "key"}) for t in ("p", "empty") for c in ("d", "i")]
    got = K.violation_report(df, rules, {"p": parent, "empty": parent.limit(0)}).orderBy("position").collect()
    assert [r["violating_rows"] for r in got] == [1, 1, 0, 0]
