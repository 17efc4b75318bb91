"""Queries over scans, profiles, relationships and missing values."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from synthspark.operators import missing as M
from synthspark.operators import profile as P
from synthspark.operators import relationships as R
from synthspark.plans.registry import ORDERS_MAR, ORDERS_MISSING, as_select, query
from synthspark.session import scratch_path
from synthspark.sources import readers as S

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_NUMBERS = LINES[:8]
MISSING = as_select(ORDERS_MISSING, "orders")


def _each(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(names))


# --- scans -----------------------------------------------------------------------------------------------


@query(
    "read_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    return S.read_csv(t.spark, path, t.customer.schema)


@query(
    "read_chunked",
    """SELECT l_returnflag, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS price
       FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    lines = S.read_chunked(t.spark, f"{t.folder}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(30,2)")), 2).cast("double").alias("price")
    )


@query(
    "read_warehouse_query",
    """SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderstatus""",
)
def _(t):
    t.orders.createOrReplaceTempView("warehouse_orders")
    text = """SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS top_price FROM warehouse_orders
              WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01' GROUP BY o_orderstatus"""
    return S.read_warehouse_query(t.spark, text, scratch_path(t.spark, "staging"), "tenant-1", "job-1")


@query(
    "sample_rows",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 500""",
)
def _(t):
    return S.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, F.col("o_orderkey"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "table_row_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
        for n in TABLES
    ),
)
def _(t):
    return S.table_row_counts({n: getattr(t, n) for n in TABLES})


# --- profiles --------------------------------------------------------------------------------------------


@query(
    "profile_nulls",
    _each(
        f"""SELECT '{{c}}' AS "column", CAST(sum(CASE WHEN {{c}} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count,
            round(sum(CASE WHEN {{c}} IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS null_fraction, count(*) AS total_rows
            FROM {MISSING} x{{i}}""",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    ),
)
def _(t):
    return P.profile_nulls(t.derived(ORDERS_MISSING, "orders"))


@query(
    "profile_distinct",
    _each(
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
           round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio FROM lineitem""",
        LINES,
    ),
)
def _(t):
    return P.profile_distinct(t.lineitem)


HALF_GONE = "o_orderkey; CASE WHEN o_orderkey % 3 > 0 THEN NULL ELSE o_totalprice END AS sparse; o_custkey"


@query(
    "profile_high_null_columns",
    f"""SELECT 'sparse' AS "column", round(count_if(sparse IS NULL) / count(*), 4) AS null_fraction
        FROM {as_select(HALF_GONE, "orders")} x HAVING count_if(sparse IS NULL) > 0.5 * count(*)""",
)
def _(t):
    return P.profile_high_null_columns(t.derived(HALF_GONE, "orders"))


TYPED = """
o_orderkey; o_custkey; o_orderstatus; o_totalprice; o_orderdate; o_orderpriority;
CAST(o_orderkey AS STRING) AS order_code; CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text;
CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END AS flag; md5(CAST(o_orderkey AS STRING)) AS guid;
concat('note ', CAST(o_orderkey AS STRING)) AS remark; CAST(o_orderkey % 40 AS INT) AS bucket
"""
_TYPED_SQL = as_select(TYPED.replace("STRING", "VARCHAR"), "orders")


def _sdtype_sql() -> str:
    """The ordered type rules per column of the derived table, spelled out from counts."""
    kinds = {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "number",
        "o_orderdate": "datetime", "o_orderpriority": "string", "order_code": "string", "date_text": "string",
        "flag": "string", "guid": "string", "remark": "string", "bucket": "integer",
    }
    facts = " UNION ALL ".join(
        f"""SELECT '{c}' AS col, '{k}' AS kind, count(DISTINCT {c}) AS d, count(DISTINCT {c}) / count(*) AS ratio,
            bool_and(CAST({c} AS VARCHAR) IN ('true', 'false', 'True', 'False')) AS is_bool,
            bool_and(regexp_matches(CAST({c} AS VARCHAR), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) AS is_date FROM t"""
        for c, k in kinds.items()
    )
    number_id = "regexp_matches(col, '_id|id_|uuid|key|pk|fk')"
    text_id = "regexp_matches(col, '_id|id_|code|key|pk|fk')"
    return f"""WITH t AS {_TYPED_SQL}, f AS ({facts}), s AS (
        SELECT *, CASE WHEN kind = 'string' AND is_bool THEN 'boolean'
          WHEN kind = 'datetime' OR (kind = 'string' AND is_date) THEN 'datetime'
          WHEN kind = 'integer' AND {number_id} AND ratio >= 0.99 THEN 'id'
          WHEN kind IN ('integer', 'number') AND d <= 50 AND ratio < 0.05 THEN 'categorical'
          WHEN kind IN ('integer', 'number') THEN 'numerical'
          WHEN regexp_matches(col, 'uuid|guid') THEN 'id'
          WHEN {text_id} AND ratio >= 0.99 THEN 'id'
          WHEN ratio > 0.8 AND d > 100 THEN 'text' ELSE 'categorical' END AS sdtype FROM f)
        SELECT col AS "column", sdtype, CASE WHEN sdtype = 'id' AND kind = 'integer' THEN '\\d+'
          WHEN sdtype = 'id' AND regexp_matches(col, 'uuid|guid')
          THEN '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}' END AS regex_format,
          d AS unique_count FROM s"""


@query("detect_sdtype", _sdtype_sql())
def _(t):
    return P.detect_sdtype(t.derived(TYPED, "orders"))


NUMERIC_SQL = """SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    round(min({c} + 0.0::DOUBLE), 6) AS min, round(max({c} + 0.0::DOUBLE), 6) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) + 0.0::DOUBLE AS q25,
    round(quantile_cont({c}::DOUBLE, 0.5), 6) + 0.0::DOUBLE AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) + 0.0::DOUBLE AS q75,
    round(skewness({c}), 4) AS skewness FROM lineitem"""


@query("profile_numeric", _each(NUMERIC_SQL, LINE_NUMBERS))
def _(t):
    return P.profile_numeric(t.lineitem, LINE_NUMBERS)


GROUPS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_shipdate"]
_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {e} AS value, count(*) AS n FROM lineitem GROUP BY ALL"""
    for c, e in zip(
        GROUPS,
        ["l_returnflag", "l_linestatus", "CAST(l_quantity AS VARCHAR)", "CAST(l_discount + 0.0::DOUBLE AS VARCHAR)", "CAST(l_shipdate AS VARCHAR)"],
    )
)


@query(
    "profile_categorical",
    f"""WITH c AS ({_COUNTS}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
          sum(n) OVER (PARTITION BY "column") AS total FROM c)
        SELECT "column", value, round(n / total, 4) AS frequency, rank FROM r WHERE rank <= 20""",
)
def _(t):
    return P.profile_categorical(t.lineitem, GROUPS)


@query(
    "profile_entropy",
    f"""WITH c AS ({_COUNTS}), p AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM c)
        SELECT "column", round(sum(-p * ln(p + 1e-10)), 4) AS entropy FROM p GROUP BY "column" """,
)
def _(t):
    return P.profile_entropy(t.lineitem, GROUPS)


@query(
    "profile_datetime",
    """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date,
       CAST(floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) AS BIGINT) AS date_range_days FROM orders""",
)
def _(t):
    return P.profile_datetime(t.orders)


@query(
    "infer_not_null",
    _each(
        f"""SELECT '{{c}}' AS "column", 'not_null' AS constraint_type FROM {MISSING} x{{i}}
            HAVING count(*) = count({{c}})""",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    ),
)
def _(t):
    return P.infer_not_null(t.derived(ORDERS_MISSING, "orders"))


@query(
    "infer_range",
    _each(
        """SELECT '{c}' AS "column", 'range' AS constraint_type,
           round(min({c}) - greatest((max({c}) - min({c})) * 0.01::DOUBLE, 1.0::DOUBLE), 4) AS min,
           round(max({c}) + greatest((max({c}) - min({c})) * 0.01::DOUBLE, 1.0::DOUBLE), 4) AS max FROM orders""",
        ["o_custkey", "o_totalprice"],
    ),
)
def _(t):
    return P.infer_range(t.orders)


def _analyze_sql() -> str:
    null = "CAST(NULL AS DOUBLE)"
    parts = []
    kinds = {
        "o_orderkey": "id", "o_custkey": "numerical", "o_orderstatus": "categorical", "o_totalprice": "numerical",
        "o_orderpriority": "categorical",
    }
    for c, kind in kinds.items():
        number = kind == "numerical"
        margin = f"greatest((max({c}) - min({c})) * 0.01::DOUBLE, 1.0::DOUBLE)"
        stats = {
            "mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 6)", "min": f"round(min({c})::DOUBLE, 6)",
            "max": f"round(max({c})::DOUBLE, 6)", "q25": f"round(quantile_cont({c}::DOUBLE, 0.25), 6)",
            "median": f"round(quantile_cont({c}::DOUBLE, 0.5), 6)", "q75": f"round(quantile_cont({c}::DOUBLE, 0.75), 6)",
            "skewness": f"round(skewness({c}), 4)", "rule_min": f"round(min({c}) - {margin}, 4)",
            "rule_max": f"round(max({c}) + {margin}, 4)",
        }
        entropy = null
        if kind == "categorical":
            entropy = f"(SELECT round(sum(-p * ln(p + 1e-10)), 4) FROM (SELECT count(*) / (SELECT count({c}) FROM t) AS p FROM t WHERE {c} IS NOT NULL GROUP BY {c}))"
        chosen = ", ".join(f"{e if number else null} AS {k}" for k, e in stats.items())
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS sdtype, round(count_if({c} IS NULL) / count(*), 4) AS null_fraction,
                count(DISTINCT {c}) AS unique_count, count(*) AS total_rows, count_if({c} IS NULL) = 0 AS rule_not_null,
                {chosen}, {entropy} AS entropy FROM t"""
        )
    return f"WITH t AS {MISSING} " + " UNION ALL ".join(parts)


@query("analyze_table", _analyze_sql())
def _(t):
    return P.analyze_table(t.derived(ORDERS_MISSING, "orders"))


MAPPABLE = "c_custkey; CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS balance; c_nationkey"


@query(
    "apply_column_mappings",
    f"""SELECT c_custkey, TRY_CAST(balance AS DOUBLE) AS balance, CAST(c_nationkey AS VARCHAR) AS c_nationkey
        FROM {as_select(MAPPABLE.replace("STRING", "VARCHAR"), "customer")} x""",
)
def _(t):
    return P.apply_column_mappings(t.derived(MAPPABLE, "customer"), {"balance": "numerical", "c_nationkey": "categorical"})


# Integer and text columns of all tables.
LINKED = {
    "region": ("r_regionkey", "r_name$"),
    "nation": ("n_nationkey", "n_name$", "n_regionkey"),
    "customer": ("c_custkey", "c_name$", "c_nationkey", "c_mktsegment$"),
    "supplier": ("s_suppkey", "s_name$", "s_nationkey"),
    "part": ("p_partkey", "p_name$", "p_brand$", "p_type$", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus$", "o_orderpriority$"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag$", "l_linestatus$"),
    "events": ("event_id", "user_id", "event_type$", "props$"),
    "documents": ("doc_id", "text$", "lang$", "source$", "n_chars"),
    "embeddings": ("vec_id", "label"),
    "pages": ("page_id", "url$", "html$"),
    "benchmark": ("item_id", "text$"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role$", "text$"),
}


def _links_sql() -> str:
    """Names by their endings behind a prefix of one or two letters, then inclusion and repeats, link by link."""
    columns = [(t, c) for t, names in LINKED.items() for c in names]
    bare = lambda c: c[c.find("_") + 1 :] if 1 <= c.find("_") <= 2 else c
    parts = []
    for p, pc in columns:
        for c, cc in columns:
            score = 1.0 if bare(pc) == bare(cc) else 0.75 if cc.endswith(pc) else 0.0
            if p == c or not score:
                continue
            one, many = pc.rstrip("$"), cc.rstrip("$")
            parts.append(
                f"""SELECT '{p}' AS parent_table, '{one}' AS parent_column, '{c}' AS child_table, '{many}' AS child_column,
                {score}::DOUBLE AS name_score, CASE WHEN p.most > 1 THEN 'N:N' ELSE '1:N' END AS cardinality
                FROM (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM {p} WHERE {one} IS NOT NULL GROUP BY {one})) p,
                     (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM {c} WHERE {many} IS NOT NULL GROUP BY {many})) c
                WHERE (p.most = 1 OR c.most > 1)
                  AND NOT EXISTS (SELECT 1 FROM {c} WHERE {many} IS NOT NULL AND {many} NOT IN (SELECT {one} FROM {p} WHERE {one} IS NOT NULL))"""
            )
    return " UNION ALL ".join(parts)


@query("detect_relationships", _links_sql())
def _(t):
    return R.detect_relationships({n: getattr(t, n) for n in LINKED})


@query(
    "relationship_cardinality",
    """SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)) AS parent_max_rows,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS child_max_rows, '1:N' AS cardinality""",
)
def _(t):
    return R.relationship_cardinality(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


# --- missing values --------------------------------------------------------------------------------------


@query(
    "missing_summary",
    f"""SELECT count(*) AS total_rows, 5::BIGINT AS total_columns,
        CAST(sum((o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT) AS BIGINT) AS total_missing,
        round(sum((o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT) / (5 * count(*)), 4) AS missing_rate,
        3::BIGINT AS affected_columns FROM {MISSING} x""",
)
def _(t):
    return M.missing_summary(t.derived(ORDERS_MISSING, "orders"))


@query(
    "missing_by_column",
    f"""WITH t AS {MISSING} """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count_if({c} IS NULL) AS missing_count,
            round(count_if({c} IS NULL) / count(*), 4) AS missing_rate, '{d}' AS dtype, {n} AS is_numeric FROM t"""
        for c, d, n in (("o_custkey", "bigint", "true"), ("o_orderstatus", "string", "false"), ("o_totalprice", "double", "true"))
    ).replace("count_if", "count_if"),
)
def _(t):
    return M.missing_by_column(t.derived(ORDERS_MISSING, "orders"))


@query(
    "missing_mechanism",
    f"""WITH t AS {as_select(ORDERS_MAR, "orders")}, g AS (SELECT *, (o_orderpriority IS NULL)::INT::DOUBLE AS gone FROM t),
        r AS (SELECT greatest(abs(corr(o_orderkey, gone)), abs(corr(o_custkey, gone)), abs(corr(o_totalprice, gone))) AS r,
                     count_if(gone = 1) AS n FROM g)
        SELECT 'o_orderpriority' AS "column", round(r, 4) AS max_correlation,
               CASE WHEN r > 0.3 THEN 'MAR' ELSE 'MCAR' END AS mechanism FROM r""",
)
def _(t):
    return M.missing_mechanism(t.derived(ORDERS_MAR, "orders"))


_MODE = "(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_STATUS = _MODE.replace("{c}", "o_orderstatus")


@query(
    "impute_mean",
    f"""WITH t AS {MISSING} SELECT o_orderkey, round(coalesce(o_custkey, (SELECT avg(o_custkey) FROM t)), 4) AS o_custkey,
        coalesce(o_orderstatus, {_STATUS}) AS o_orderstatus,
        round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    out = M.impute_mean(t.derived(ORDERS_MISSING, "orders"))
    return out.withColumn("o_custkey", F.round(F.col("o_custkey").cast("double"), 4)).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "impute_median",
    f"""WITH t AS {MISSING} SELECT o_orderkey,
        coalesce(o_custkey::DOUBLE, (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM t)) AS o_custkey,
        coalesce(o_orderstatus, {_STATUS}) AS o_orderstatus,
        round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 3) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    out = M.impute_median(t.derived(ORDERS_MISSING, "orders"))
    return out.withColumn("o_custkey", F.col("o_custkey").cast("double")).withColumn("o_totalprice", F.round("o_totalprice", 3))


@query(
    "impute_mode",
    f"""WITH t AS {MISSING} SELECT o_orderkey, coalesce(o_custkey, {_MODE.replace("{c}", "o_custkey")}) AS o_custkey,
        coalesce(o_orderstatus, {_STATUS}) AS o_orderstatus,
        coalesce(o_totalprice, {_MODE.replace("{c}", "o_totalprice")}) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    return M.impute_mode(t.derived(ORDERS_MISSING, "orders"))


@query(
    "impute_constant",
    f"""WITH t AS {MISSING} SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, coalesce(o_orderstatus, '?') AS o_orderstatus,
        coalesce(o_totalprice, 0) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    return M.impute_constant(t.derived(ORDERS_MISSING, "orders"), {"o_custkey": -1, "o_orderstatus": "?"})


@query(
    "impute_column",
    f"""WITH t AS {MISSING} SELECT o_orderkey, o_custkey, o_orderstatus,
        round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    out = M.impute_column(t.derived(ORDERS_MISSING, "orders"), "o_totalprice", "knn")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "impute_columnwise",
    f"""WITH t AS {MISSING} SELECT o_orderkey, coalesce(o_custkey, {_MODE.replace("{c}", "o_custkey")}) AS o_custkey,
        coalesce(o_orderstatus, {_STATUS}) AS o_orderstatus, coalesce(o_totalprice, 0) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    return M.impute_columnwise(t.derived(ORDERS_MISSING, "orders"), "constant", {"o_custkey": "mode"})


def _knn_sql(target: str, others: list[str]) -> str:
    both = " + ".join(f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in others)
    total = " + ".join(
        f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN pow(q.{c}::DOUBLE - d.{c}::DOUBLE, 2) ELSE 0 END" for c in others
    )
    return f"""(SELECT k, avg(v) AS est FROM (SELECT q.o_orderkey AS k, d.{target} AS v,
        row_number() OVER (PARTITION BY q.o_orderkey ORDER BY ({total}) * {len(others) + 1}::DOUBLE / ({both}), d.o_orderkey) AS r
        FROM t q JOIN t d ON q.{target} IS NULL AND d.{target} IS NOT NULL AND ({both}) > 0) WHERE r <= 5 GROUP BY k)"""


KNN_ORDERS = """
o_orderkey; CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey;
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice;
CAST(date_part('doy', o_orderdate) AS DOUBLE) * 40.0 AS season
"""


@query(
    "impute_knn",
    f"""WITH t AS {as_select(KNN_ORDERS, "orders")}, a AS {_knn_sql("o_custkey", ["o_totalprice", "season"])},
        b AS {_knn_sql("o_totalprice", ["o_custkey", "season"])}
        SELECT t.o_orderkey, round(coalesce(t.o_custkey::DOUBLE, a.est), 4) AS o_custkey,
          round(coalesce(t.o_totalprice, b.est), 4) AS o_totalprice, season
        FROM t LEFT JOIN a ON a.k = t.o_orderkey LEFT JOIN b ON b.k = t.o_orderkey""",
)
def _(t):
    out = M.impute_knn(t.derived(KNN_ORDERS, "orders"), "o_orderkey")
    return out.select("o_orderkey", F.round("o_custkey", 4).alias("o_custkey"), F.round("o_totalprice", 4).alias("o_totalprice"), "season")


MICE_ORDERS = """
o_orderkey; CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price;
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 0.1 + o_custkey END AS cost;
CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS buyer
"""


@query(
    "impute_mice",
    """SELECT count(*) AS n_rows, 0::BIGINT AS n_missing, 0::BIGINT AS n_changed, true AS price_close, true AS cost_close
       FROM orders""",
)
def _(t):
    df = t.derived(MICE_ORDERS, "orders")
    done = M.impute_mice(df, ["price", "cost", "buyer"])
    both = done.join(df.select("o_orderkey", *[F.col(c).alias(f"old_{c}") for c in ("price", "cost", "buyer")]), "o_orderkey")
    both = both.join(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey")
    cost = F.col("o_totalprice") * 0.1 + F.col("o_custkey")
    # One hidden cell beside two observed ones is determined by the linear relation.
    alone = F.col("old_cost").isNull() & F.col("old_price").isNotNull() & F.col("old_buyer").isNotNull()
    back = F.col("old_price").isNull() & F.col("old_cost").isNotNull() & F.col("old_buyer").isNotNull()
    return both.agg(
        F.count("*").alias("n_rows"),
        F.sum(sum(F.col(c).isNull().cast("long") for c in ("price", "cost", "buyer"))).alias("n_missing"),
        F.sum(sum((F.col(f"old_{c}").isNotNull() & (F.col(f"old_{c}") != F.col(c))).cast("long") for c in ("price", "cost", "buyer"))).alias("n_changed"),
        (F.avg(F.when(back, F.abs(F.col("price") - F.col("o_totalprice")) / F.col("o_totalprice"))) < 0.2).alias("price_close"),
        (F.avg(F.when(alone, F.abs(F.col("cost") - cost) / cost)) < 0.1).alias("cost_close"),
    )


@query(
    "impute",
    f"""WITH t AS {MISSING} SELECT o_orderkey,
        round(coalesce(o_custkey::DOUBLE, (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM t)), 3) AS o_custkey,
        coalesce(o_orderstatus, {_STATUS}) AS o_orderstatus,
        round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 3) AS o_totalprice, o_orderpriority FROM t""",
)
def _(t):
    out = M.impute(t.derived(ORDERS_MISSING, "orders"), "median")
    return out.withColumn("o_custkey", F.round(F.col("o_custkey").cast("double"), 3)).withColumn("o_totalprice", F.round("o_totalprice", 3))


@query(
    "imputation_quality",
    f"""WITH t AS {MISSING}, m AS (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) AS c, avg(o_custkey) AS ca,
          quantile_cont(o_totalprice, 0.5) AS p, avg(o_totalprice) AS pa FROM t)
        SELECT 'o_custkey' AS "column", count_if(o_custkey IS NULL) AS null_count, 1.0::DOUBLE AS fill_rate,
          round(max(ca), 4) AS original_mean, round(max(c), 4) AS imputed_mean,
          round(abs(max(ca) - max(c)) / (abs(max(ca)) + 1e-10), 4) AS mean_deviation FROM t, m
        UNION ALL SELECT 'o_orderstatus', count_if(o_orderstatus IS NULL), 1.0, NULL, NULL, NULL FROM t
        UNION ALL SELECT 'o_totalprice', count_if(o_totalprice IS NULL), 1.0, round(max(pa), 4), round(max(p), 4),
          round(abs(max(pa) - max(p)) / (abs(max(pa)) + 1e-10), 4) FROM t, m""",
)
def _(t):
    df = t.derived(ORDERS_MISSING, "orders")
    return M.imputation_quality(df, M.impute(df, "median"), "o_orderkey")
