"""Queries over constraint checks and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthspark.operators import constraints as K
from synthspark.plans.registry import ORDERS_BAD, ORDERS_MISSING, as_select, query
from synthspark.spec import Constraint, Relationship

MISSING = as_select(ORDERS_MISSING, "orders")
BAD = as_select(ORDERS_BAD, "orders")
ALLOWED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ALLOWED_SQL = ", ".join(f"'{v}'" for v in ALLOWED)


def pick_sql(key: str, label: str, size: str) -> str:
    """The MD5 pick of the repairs, in SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {key}, '{label}')), 1, 15) AS BIGINT) % {size})"


@query("check_not_null", f"SELECT count_if(o_totalprice IS NULL) AS violating_rows FROM {MISSING} x")
def _(t):
    return K.check_not_null(t.derived(ORDERS_MISSING, "orders"), "o_totalprice")


TEXT_BALANCE = "c_custkey; CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS balance"
TEXT_BALANCE_SQL = as_select(TEXT_BALANCE.replace("STRING", "VARCHAR"), "customer")


@query(
    "check_range",
    f"""SELECT 'quantity' AS source, count_if(l_quantity < 10) AS below_min, count_if(l_quantity > 45) AS above_max FROM lineitem
        UNION ALL SELECT 'balance', count_if(TRY_CAST(balance AS DOUBLE) < 0), count_if(TRY_CAST(balance AS DOUBLE) > 5000)
        FROM {TEXT_BALANCE_SQL} x""",
)
def _(t):
    a = K.check_range(t.lineitem, "l_quantity", 10, 45).select(F.lit("quantity").alias("source"), "*")
    b = K.check_range(t.derived(TEXT_BALANCE, "customer"), "balance", 0, 5000)
    return a.unionByName(b.select(F.lit("balance").alias("source"), "*"))


@query(
    "check_enum",
    f"""SELECT count(*) AS violating_rows, (SELECT string_agg(v, ', ' ORDER BY v) FROM
          (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority NOT IN ({ALLOWED_SQL}) ORDER BY v LIMIT 5)) AS sample
        FROM orders WHERE o_orderpriority NOT IN ({ALLOWED_SQL})""",
)
def _(t):
    return K.check_enum(t.orders, "o_orderpriority", ALLOWED)


@query("check_unique", "SELECT count(l_orderkey) - count(DISTINCT l_orderkey) AS violating_rows FROM lineitem")
def _(t):
    return K.check_unique(t.lineitem, "l_orderkey")


@query(
    "check_foreign_key",
    f"""SELECT count(*) AS violating_rows FROM {BAD} x
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    return K.check_foreign_key(t.derived(ORDERS_BAD, "orders"), "o_custkey", t.customer, "c_custkey")


@query(
    "check_regex",
    """SELECT 'full' AS rule, count_if(NOT regexp_matches(c_name, '^(?:Customer#[0-9]+)')) AS violating_rows FROM customer
       UNION ALL SELECT 'prefix', count_if(NOT regexp_matches(c_name, '^(?:Customer#0000000)')) FROM customer""",
)
def _(t):
    a = K.check_regex(t.customer, "c_name", "Customer#[0-9]+").select(F.lit("full").alias("rule"), "*")
    return a.unionByName(K.check_regex(t.customer, "c_name", "Customer#0000000").select(F.lit("prefix").alias("rule"), "*"))


RULES = [
    Constraint("o_orderstatus", "not_null"),
    Constraint("o_totalprice", "range", {"min": 5000, "max": 300000}),
    Constraint("o_orderpriority", "enum", {"allowed_values": ALLOWED}),
    Constraint("o_custkey", "referential", {"parent_table": "customer", "parent_key": "c_custkey"}),
    Constraint("o_orderkey", "unique"),
    Constraint("o_orderstatus", "regex", {"pattern": "[FO]"}),
    Constraint("gone", "not_null"),
    Constraint("o_orderkey", "nonsense"),
]

_FACTS = f"""WITH t AS {BAD}, f AS (SELECT
    count_if(o_orderstatus IS NULL) AS nulls, count_if(o_totalprice < 5000) AS low, count_if(o_totalprice > 300000) AS high,
    count_if(o_orderpriority NOT IN ({ALLOWED_SQL})) AS enum_bad,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM t
      WHERE o_orderpriority NOT IN ({ALLOWED_SQL}) ORDER BY v LIMIT 5)) AS enum_sample,
    count_if(o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans,
    (SELECT count(DISTINCT c_custkey) FROM customer) AS parents,
    count(o_orderkey) - count(DISTINCT o_orderkey) AS dups,
    count_if(o_orderstatus IS NOT NULL AND NOT regexp_matches(o_orderstatus, '^(?:[FO])')) AS regex_bad FROM t),
  m AS (
    SELECT 0 AS position, 0 AS part, nulls AS n, concat('Column ''o_orderstatus'' has ', nulls, ' missing cells where the rule allows none') AS message FROM f
    UNION ALL SELECT 1, 0, low, concat('Column ''o_totalprice'' has ', low, ' cells smaller than 5000') FROM f
    UNION ALL SELECT 1, 1, high, concat('Column ''o_totalprice'' has ', high, ' cells larger than 300000') FROM f
    UNION ALL SELECT 2, 0, enum_bad, concat('Column ''o_orderpriority'' has ', enum_bad, ' cells outside the listed values, among them [', enum_sample, ']') FROM f
    UNION ALL SELECT 3, 0, orphans, concat('Column ''o_custkey'' has ', orphans, ' cells without a parent; the parent table offers ', parents, ' keys') FROM f
    UNION ALL SELECT 4, 0, dups, concat('Column ''o_orderkey'' has ', dups, ' cells that repeat an earlier one') FROM f
    UNION ALL SELECT 5, 0, regex_bad, concat('Column ''o_orderstatus'' has ', regex_bad, ' cells that do not match the pattern ''[FO]''') FROM f
    UNION ALL SELECT 6, 0, -1, 'Column ''gone'' is missing from the table'
    UNION ALL SELECT 7, 0, -1, 'Column ''o_orderkey'' carries a rule of the unknown kind ''nonsense'''),
  v AS (SELECT * FROM m WHERE n <> 0)"""


@query("validate", f"{_FACTS} SELECT CAST(position AS BIGINT) AS position, message FROM v")
def _(t):
    return K.violation_messages(t.derived(ORDERS_BAD, "orders"), RULES, {"customer": t.customer})


@query(
    "referential",
    f"""SELECT kind, count(*) AS violating_rows FROM (VALUES ('foreign_key'), ('referential')) k(kind), {BAD} x
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY kind""",
)
def _(t):
    rules = [
        Constraint("o_custkey", kind, {"parent_table": "customer", "parent_key": "c_custkey"}) for kind in ("foreign_key", "referential")
    ]
    report = K.violation_report(t.derived(ORDERS_BAD, "orders"), rules, {"customer": t.customer})
    return report.select(F.col("constraint_type").alias("kind"), "violating_rows")


_REPORT = (
    _FACTS
    + """, r(position, constraint_type, "column") AS (VALUES (0, 'not_null', 'o_orderstatus'), (1, 'range', 'o_totalprice'),
      (2, 'enum', 'o_orderpriority'), (3, 'referential', 'o_custkey'), (4, 'unique', 'o_orderkey'),
      (5, 'regex', 'o_orderstatus'), (6, 'not_null', 'gone'), (7, 'nonsense', 'o_orderkey')),
    report AS (SELECT CAST(r.position AS BIGINT) AS position, constraint_type, "column", count(message) = 0 AS passed,
      count(message) AS violation_count, CAST(coalesce(sum(greatest(n, 0)), 0) AS BIGINT) AS violating_rows,
      coalesce(string_agg(message, '; ' ORDER BY part), '') AS violations
    FROM r LEFT JOIN v ON v.position = r.position GROUP BY ALL)"""
)


@query("violation_report", f"{_REPORT} SELECT * FROM report")
def _(t):
    return K.violation_report(t.derived(ORDERS_BAD, "orders"), RULES, {"customer": t.customer})


@query(
    "violation_totals",
    f"""{_REPORT} SELECT count(*) AS total_constraints, count_if(NOT passed) AS failed_constraints,
        CAST(sum(violation_count) AS BIGINT) AS total_violations, bool_and(passed) AS all_passed FROM report""",
)
def _(t):
    return K.violation_totals(K.violation_report(t.derived(ORDERS_BAD, "orders"), RULES, {"customer": t.customer}))


@query(
    "repair_range",
    f"""SELECT c_custkey, CASE WHEN TRY_CAST(balance AS DOUBLE) IS NOT NULL
        THEN least(greatest(TRY_CAST(balance AS DOUBLE), 0), 5000) END AS balance FROM {TEXT_BALANCE_SQL} x""",
)
def _(t):
    return K.repair_range(t.derived(TEXT_BALANCE, "customer"), "balance", 0, 5000)


_ENUM_PICK = f"CASE {pick_sql('CAST(o_orderkey AS VARCHAR)', 'o_orderpriority:0', '3')} " + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(ALLOWED)
) + " END"


@query(
    "repair_enum",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ({ALLOWED_SQL}) THEN {_ENUM_PICK} ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
)
def _(t):
    return K.repair_enum(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ALLOWED, ["o_orderkey"])


@query(
    "repair_not_null",
    f"""WITH t AS {MISSING} SELECT o_orderkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM t WHERE o_orderstatus IS NOT NULL
        GROUP BY o_orderstatus ORDER BY count(*) DESC, o_orderstatus LIMIT 1)) AS o_orderstatus,
        coalesce(o_totalprice, 7.5) AS o_totalprice FROM t""",
)
def _(t):
    df = t.derived(ORDERS_MISSING, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return K.repair_not_null(K.repair_not_null(df, "o_orderstatus"), "o_totalprice", 7.5)


_PARENTS = """p AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR))) - 1 AS i FROM customer),
    n AS (SELECT count(*) AS n FROM p)"""
_FK_PICK = pick_sql("CAST(o_orderkey AS VARCHAR)", "o_custkey:0", "n.n")


@query(
    "enforce_foreign_key",
    f"""WITH t AS {BAD}, {_PARENTS} SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT k FROM p) THEN o_custkey ELSE p.k END AS o_custkey
        FROM t, n LEFT JOIN p ON p.i = {_FK_PICK}""".replace("FROM t, n LEFT", "FROM t CROSS JOIN n LEFT"),
)
def _(t):
    df = t.derived(ORDERS_BAD, "orders").select("o_orderkey", "o_custkey")
    return K.enforce_foreign_key(df, "o_custkey", t.customer.select("c_custkey"), ["o_orderkey"])


@query(
    "enforce_uniqueness",
    """WITH kept AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
         WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1))
       SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER
         (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM kept) WHERE r = 1""",
)
def _(t):
    df = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    taken = t.part.filter("p_size = 1").select("p_partkey")
    return K.enforce_uniqueness(df, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], taken)


BAD_LINES = """
l_orderkey; l_linenumber; CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 500000 ELSE l_partkey END AS l_partkey;
l_suppkey; l_extendedprice
"""


@query(
    "enforce_referential_integrity",
    f"""WITH t AS {BAD}, {_PARENTS}, o AS (SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT k FROM p) THEN o_custkey ELSE p.k END AS o_custkey
          FROM t CROSS JOIN n LEFT JOIN p ON p.i = {_FK_PICK}),
        l AS {as_select(BAD_LINES, "lineitem")},
        pp AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR))) - 1 AS i FROM part),
        pn AS (SELECT count(*) AS n FROM pp),
        lf AS (SELECT CASE WHEN l_partkey IN (SELECT k FROM pp) THEN l_partkey ELSE pp.k END AS l_partkey FROM l CROSS JOIN pn
          LEFT JOIN pp ON pp.i = {pick_sql("concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR))", "l_partkey:0", "pn.n")})
        SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS key_sum,
          count_if(o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM o
        UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_partkey) AS BIGINT),
          count_if(l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lf""",
)
def _(t):
    tables = {
        "customer": t.customer, "part": t.part, "orders": t.derived(ORDERS_BAD, "orders"), "lineitem": t.derived(BAD_LINES, "lineitem")
    }
    links = [
        Relationship("part", "p_partkey", "lineitem", "l_partkey"),
        Relationship("customer", "c_custkey", "orders", "o_custkey"),
        Relationship("nowhere", "x", "orders", "o_custkey"),
    ]
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_suppkey"]}
    out = K.enforce_referential_integrity(tables, links, keys)
    parts = []
    for name, key, parent, parent_key in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey")):
        counted = out[name].groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        known = tables[parent].select(F.col(parent_key).alias("k"), F.lit(True).alias("ok"))
        parts.append(
            counted.join(known, "k", "left").agg(
                F.sum("n").alias("n_rows"), F.sum(F.col("k") * F.col("n")).alias("key_sum"),
                F.coalesce(F.sum(F.when(F.col("ok").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return parts[0].unionByName(parts[1])


REPAIRABLE = RULES[:5]
# The second draw of a repair round uses the next seed, which a clean table never reaches.
_STATUS_MODE = """(SELECT o_orderstatus FROM t WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
    ORDER BY count(*) DESC, o_orderstatus LIMIT 1)"""


@query(
    "apply_constraints",
    f"""WITH t AS {BAD}, {_PARENTS} SELECT o_orderkey,
        CASE WHEN o_custkey IN (SELECT k FROM p) THEN o_custkey ELSE p.k END AS o_custkey,
        coalesce(o_orderstatus, {_STATUS_MODE}) AS o_orderstatus,
        least(greatest(o_totalprice, 5000), 300000) AS o_totalprice,
        CASE WHEN o_orderpriority NOT IN ({ALLOWED_SQL}) THEN {_ENUM_PICK} ELSE o_orderpriority END AS o_orderpriority
        FROM t CROSS JOIN n LEFT JOIN p ON p.i = {_FK_PICK}""",
)
def _(t):
    return K.apply_constraints(t.derived(ORDERS_BAD, "orders"), REPAIRABLE, {"customer": t.customer}, ["o_orderkey"])


@query(
    "validate_and_repair",
    f"""{_FACTS} SELECT 'before' AS stage, 5::BIGINT AS total_constraints,
          count(DISTINCT position) AS failed_constraints, count(*) AS total_violations, false AS all_passed FROM v WHERE position < 5
        UNION ALL SELECT 'after', 5, 0, 0, true""",
)
def _(t):
    before, _, after = K.validate_and_repair(
        t.derived(ORDERS_BAD, "orders"), REPAIRABLE, {"customer": t.customer}, ["o_orderkey"]
    )
    a = K.violation_totals(before).select(F.lit("before").alias("stage"), "*")
    return a.unionByName(K.violation_totals(after).select(F.lit("after").alias("stage"), "*"))
