"""Queries over fidelity, privacy, run comparison, budget and run history."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from synthspark.operators import budget as B
from synthspark.operators import evaluate as E
from synthspark.operators import fidelity as Q
from synthspark.operators import history as H
from synthspark.operators import privacy as V
from synthspark.plans.registry import (
    ORDERS_NOISY,
    ORDERS_REAL,
    ORDERS_SHIFTED,
    POINTS,
    POINTS_SQL,
    as_select,
    query,
)
from synthspark.session import scratch_path

REAL = as_select(ORDERS_REAL, "orders")
NOISY = as_select(ORDERS_NOISY, "orders")
SHIFTED = as_select(ORDERS_SHIFTED, "orders")
KINDS = {
    "o_orderkey": "id", "o_custkey": "numerical", "o_orderstatus": "categorical", "o_totalprice": "numerical",
    "o_orderpriority": "categorical",
}
BASE = f"r AS {REAL}, s AS {NOISY}"


def _pair(t):
    return t.derived(ORDERS_REAL, "orders"), t.derived(ORDERS_NOISY, "orders")


def ks_sql(c: str, digits: int | None = None) -> str:
    """1 - the largest gap of the two empirical distribution functions at observed values."""
    value = f"""SELECT 1 - max(abs(cr / (SELECT count({c}) FROM r) - cs / (SELECT count({c}) FROM s))) FROM (
        SELECT v, sum(nr) OVER (ORDER BY v) AS cr, sum(ns) OVER (ORDER BY v) AS cs FROM (
          SELECT v, sum(a) AS nr, sum(b) AS ns FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM r UNION ALL SELECT {c}, 0, 1 FROM s)
          WHERE v IS NOT NULL GROUP BY v))"""
    return f"round(({value}), {digits})" if digits else f"({value})"


def tv_sql(expr: str, digits: int | None = None) -> str:
    """1 - half the summed difference of shares of an expression over both tables."""
    value = f"""SELECT 1 - sum(abs(nr / (SELECT count({expr}) FROM r) - ns / (SELECT count({expr}) FROM s))) / 2 FROM (
        SELECT v, sum(a) AS nr, sum(b) AS ns FROM (SELECT {expr} AS v, 1 AS a, 0 AS b FROM r UNION ALL SELECT {expr}, 0, 1 FROM s)
        WHERE v IS NOT NULL GROUP BY v)"""
    return f"round(({value}), {digits})" if digits else f"({value})"


@query(
    "ks_complement",
    f"WITH {BASE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'KSComplement' AS metric, {ks_sql(c, 4)} AS score""" for c in ("o_custkey", "o_totalprice")
    ),
)
def _(t):
    return Q.ks_complement(*_pair(t), ["o_custkey", "o_totalprice"])


@query(
    "ks_complement_lineitem",
    """WITH r AS (SELECT l_quantity, l_discount + 0.0::DOUBLE AS l_discount, l_extendedprice FROM lineitem),
       s AS (SELECT least(l_quantity + 3, 50) AS l_quantity, l_tax + 0.0::DOUBLE AS l_discount, l_extendedprice * 1.01 AS l_extendedprice FROM lineitem) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'KSComplement' AS metric, {ks_sql(c, 4)} AS score""" for c in ("l_quantity", "l_discount", "l_extendedprice")
    ),
)
def _(t):
    real = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")
    syn = t.lineitem.select(
        F.least(F.col("l_quantity") + 3, F.lit(50.0)).alias("l_quantity"), F.col("l_tax").alias("l_discount"),
        (F.col("l_extendedprice") * 1.01).alias("l_extendedprice"),
    )
    return Q.ks_complement(real, syn, ["l_quantity", "l_discount", "l_extendedprice"])


@query(
    "tv_complement",
    f"WITH {BASE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'TVComplement' AS metric, {tv_sql(c, 4)} AS score""" for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def _(t):
    return Q.tv_complement(*_pair(t), ["o_orderstatus", "o_orderpriority"])


def _shapes_sql(digits: int | None) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{"KSComplement" if k == "numerical" else "TVComplement"}' AS metric,
            {(ks_sql if k == "numerical" else tv_sql)(c, digits)} AS score, '{k}' AS sdtype"""
        for c, k in KINDS.items()
    )


@query("column_shapes", f"WITH {BASE} {_shapes_sql(4)}")
def _(t):
    return Q.column_shapes(*_pair(t), KINDS)


@query(
    "column_shape",
    f"""WITH {BASE} SELECT 'o_totalprice' AS "column", 'KSComplement' AS metric, {ks_sql("o_totalprice", 4)} AS score""",
)
def _(t):
    return Q.column_shape(*_pair(t), "o_totalprice")


NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _corr_sql(a: str, b: str) -> str:
    return f"(1 - abs((SELECT corr({a}, {b}) FROM r) - (SELECT corr({a}, {b}) FROM s)) / 2)"


@query(
    "correlation_similarity",
    f"WITH {BASE} " + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({_corr_sql(a, b)}, 4) AS score" for a, b in itertools.combinations(NUMBERS, 2)
    ),
)
def _(t):
    return Q.correlation_similarity(*_pair(t), NUMBERS).withColumn("score", F.round("score", 4))


def _bin_sql(c: str) -> str:
    lo, hi = f"(SELECT min({c}) FROM r)", f"(SELECT max({c}) FROM r)"
    return f"CAST(CAST(greatest(0, least(9, floor(({c} - {lo})::DOUBLE / ({hi} - {lo})::DOUBLE * 10))) AS BIGINT) AS VARCHAR)"


def _cell_sql(a: str, b: str) -> str:
    label = lambda c: _bin_sql(c) if KINDS[c] == "numerical" else c
    return f"concat({label(a)}, '|', {label(b)})"


MIXED = [("o_orderstatus", "o_orderpriority")] + [
    (a, b) for a in ("o_custkey", "o_totalprice") for b in ("o_orderstatus", "o_orderpriority")
]


@query(
    "contingency_similarity",
    f"WITH {BASE} " + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {tv_sql(_cell_sql(a, b), 4)} AS score" for a, b in MIXED
    ),
)
def _(t):
    return Q.contingency_similarity(*_pair(t), MIXED).withColumn("score", F.round("score", 4))


_PAIRS = " UNION ALL ".join(
    [f"SELECT {tv_sql(_cell_sql(a, b))} AS score" for a, b in MIXED] + [f"SELECT {_corr_sql('o_custkey', 'o_totalprice')}"]
)


@query("column_pair_trends", f"WITH {BASE} SELECT round(avg(score), 4) AS column_pair_trends_score, count(*) AS pairs FROM ({_PAIRS})")
def _(t):
    return Q.column_pair_trends(*_pair(t), KINDS)


_REPORT = f"""WITH {BASE}, sh AS ({_shapes_sql(None)}), pr AS ({_PAIRS}), x AS (SELECT (SELECT avg(score) FROM sh) AS a,
    (SELECT avg(score) FROM pr) AS b), rep AS (SELECT round((a + b) / 2, 4) AS overall_score, round(a, 4) AS column_shapes_score,
    round(b, 4) AS column_pair_trends_score,
    (SELECT coalesce(string_agg("column", ',' ORDER BY "column"), '') FROM sh WHERE round(score, 4) < 0.9) AS degraded_columns,
    (a + b) / 2 >= 0.75 AS passed, 0.75::DOUBLE AS threshold FROM x)"""


@query("quality_report", f"{_REPORT} SELECT * FROM rep")
def _(t):
    return Q.quality_report(*_pair(t), KINDS, column_threshold=0.9)


@query(
    "validate_thresholds",
    f"""{_REPORT} SELECT printf('the table as a whole reaches %.3f of the 0.99 asked for', overall_score) AS message FROM rep WHERE overall_score < 0.99
        UNION ALL SELECT printf('''%s'' reaches %.3f of the 0.95 asked for in each column', "column", round(score, 4)) FROM sh WHERE round(score, 4) < 0.95""",
)
def _(t):
    real, syn = _pair(t)
    return Q.validate_thresholds(Q.quality_report(real, syn, KINDS), Q.column_shapes(real, syn, KINDS), 0.99, 0.95)


@query(
    "diagnostic_report",
    f"""WITH {BASE}, sh AS ({_shapes_sql(4)}) SELECT "column", score, CASE WHEN sdtype = 'numerical'
        THEN printf('Column ''%s'' scores %.3f: its values drift from the real ones; refit its marginal or widen its bounds.', "column", score)
        ELSE printf('Column ''%s'' scores %.3f: its category shares drift from the real ones; look at its rare categories.', "column", score)
        END AS recommendation FROM sh WHERE score < 0.95""",
)
def _(t):
    return Q.diagnostic_report(Q.column_shapes(*_pair(t), KINDS), 0.95)


_HISTORY = "o_orderkey; (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0D AS overall_score; CAST(floor(o_totalprice) AS BIGINT) % 1000 >= 750 AS passed"


@query(
    "quality_history",
    f"""SELECT count(*) AS count, round(avg(overall_score), 4) AS mean_score, round(min(overall_score), 4) AS min_score,
        round(max(overall_score), 4) AS max_score, round(avg(passed::INT), 4) AS pass_rate FROM
        (SELECT * FROM {as_select(_HISTORY.replace("0D", "0::DOUBLE"), "orders")} x ORDER BY o_orderkey DESC LIMIT 200)""",
)
def _(t):
    return Q.quality_history(t.derived(_HISTORY, "orders"), [F.col("o_orderkey").desc()])


TREE = [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber"), ("l_linenumber", "l_quantity")]


def _bn_sql() -> str:
    real = "(SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity FROM lineitem)"
    syn = """(SELECT CASE WHEN l_suppkey % 7 = 0 THEN 'N' ELSE l_returnflag END AS l_returnflag, l_linestatus,
        CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(51 - l_quantity AS VARCHAR) AS l_quantity FROM lineitem)"""
    logs = ["""ln((coalesce((SELECT n FROM root WHERE root.b = s.l_returnflag), 0) + 1.0::DOUBLE)
        / ((SELECT sum(n) FROM root) + (SELECT count(*) FROM root)))"""]
    ctes = ["root AS (SELECT l_returnflag AS b, count(*) AS n FROM r GROUP BY ALL)"]
    joins = []
    for i, (a, b) in enumerate(TREE):
        ctes.append(f"e{i} AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM r GROUP BY ALL)")
        ctes.append(f"p{i} AS (SELECT a, sum(n) AS n FROM e{i} GROUP BY a)")
        joins.append(f"LEFT JOIN e{i} ON e{i}.a = s.{a} AND e{i}.b = s.{b} LEFT JOIN p{i} ON p{i}.a = s.{a}")
        logs.append(f"ln((coalesce(e{i}.n, 0) + 1.0::DOUBLE) / (coalesce(p{i}.n, 0) + (SELECT count(DISTINCT b) FROM e{i})))")
    return f"""WITH r AS {real}, s AS {syn}, {", ".join(ctes)} SELECT count(*) AS n_rows,
        round(avg({" + ".join(logs)}), 6) AS log_likelihood FROM s {" ".join(joins)}"""


@query("bn_log_likelihood", _bn_sql())
def _(t):
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
    syn = t.lineitem.select(
        F.when(F.col("l_suppkey") % 7 == 0, "N").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_linenumber",
        (51 - F.col("l_quantity")).alias("l_quantity"),
    )
    out = Q.bn_log_likelihood(t.lineitem.select(*names), syn, names, TREE)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 6))


# --- privacy ---------------------------------------------------------------------------------------------

THREE = f"r AS {REAL}, s AS {NOISY}, c AS {SHIFTED}"
_RISK_TAIL = """rate AS (SELECT attempts, CASE WHEN attempts > 0 THEN hits / attempts ELSE 0 END AS attack,
    CASE WHEN attempts > 0 THEN control_hits / attempts ELSE 0 END AS control FROM total)
    SELECT CAST(attempts AS BIGINT) AS attempts, round(attack, 4) AS attack_rate, round(control, 4) AS control_rate,
    round(greatest(0, CASE WHEN control < 1 THEN (attack - control) / (1 - control) ELSE 0 END), 4) AS risk FROM rate"""


def _three(t):
    return t.derived(ORDERS_REAL, "orders"), t.derived(ORDERS_NOISY, "orders"), t.derived(ORDERS_SHIFTED, "orders")


def _univariate_sql() -> str:
    parts = []
    for col in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"):
        once = lambda x: f"(SELECT {col} AS v FROM {x} GROUP BY 1 HAVING count(*) = 1)"
        parts.append(
            f"""SELECT count(*) AS attempts, count_if(v IN {once('r')}) AS hits, count_if(v IN {once('c')}) AS control_hits FROM {once('s')} u"""
        )
    for col in ("o_custkey", "o_totalprice"):
        for op, agg in (("<=", "min"), (">=", "max")):
            test = lambda x: f"((SELECT count(*) FROM {x} WHERE {col} {op} (SELECT {agg}({col}) FROM s)) = 1)::INT"
            parts.append(f"SELECT 1, {test('r')}, {test('c')}")
    return f"""WITH {THREE}, parts AS ({" UNION ALL ".join(parts)}), total AS (SELECT sum(attempts) AS attempts, sum(hits) AS hits,
        sum(control_hits) AS control_hits FROM parts), {_RISK_TAIL}"""


@query("singling_out_risk", _univariate_sql())
def _(t):
    return V.singling_out_univariate(*_three(t), ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


_MULTI = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _multivariate_sql() -> str:
    def cells(x: str) -> str:
        place = lambda c: f"""floor(({c} - (SELECT min({c}) FROM s))::DOUBLE /
            ((SELECT max({c}) FROM s) - (SELECT min({c}) FROM s))::DOUBLE * 50)"""  # noqa: E731
        return f"""(SELECT concat_ws('|', {place('o_custkey')}, o_orderstatus, {place('o_totalprice')}, o_orderpriority) AS v
            FROM {x} GROUP BY 1 HAVING count(*) = 1)"""

    return f"""WITH {THREE}, ru AS {cells('r')}, su AS {cells('s')}, cu AS {cells('c')}, total AS (SELECT count(*) AS attempts,
        count_if(v IN (SELECT v FROM ru)) AS hits, count_if(v IN (SELECT v FROM cu)) AS control_hits FROM su), {_RISK_TAIL}"""


@query("singling_out_multivariate", _multivariate_sql())
def _(t):
    return V.singling_out_multivariate(*_three(t), _MULTI)


def _links_sql(x: str) -> str:
    """Nearest synthetic row of every row of ``x`` by price and by customer, over all pairs of distinct vectors."""
    def best(names: list[str], cats: list[str]) -> str:
        dist = " + ".join(
            [f"abs(q.{n}::DOUBLE - d.{n}::DOUBLE) / (SELECT (max({n}) - min({n}))::DOUBLE FROM s)" for n in names]
            + [f"(q.{n} <> d.{n})::INT" for n in cats]
        )
        cols = ", ".join(f"q.{n}" for n in names + cats)
        pick = ", ".join(names + cats)
        return f"""(SELECT {pick}, arg_min(o_orderkey, (dist, o_orderkey)) AS d FROM (SELECT {cols}, d.o_orderkey, {dist} AS dist
            FROM (SELECT DISTINCT {pick} FROM {x}) q CROSS JOIN s d) GROUP BY {pick})"""
    return f"""(SELECT count(*) AS n, count_if(a.d = b.d) AS h FROM {x} t
        JOIN {best(['o_totalprice'], [])} a ON a.o_totalprice = t.o_totalprice
        JOIN {best(['o_custkey'], ['o_orderstatus'])} b ON b.o_custkey = t.o_custkey AND b.o_orderstatus = t.o_orderstatus)"""


@query(
    "linkability_risk",
    f"""WITH {THREE}, ra AS {_links_sql('r')}, ca AS {_links_sql('c')}, rate AS (SELECT ra.n AS attempts, ra.h / ra.n AS attack,
        ca.h / ca.n AS control FROM ra, ca)
        SELECT attempts, round(attack, 4) AS attack_rate, round(control, 4) AS control_rate,
        round(greatest(0, (attack - control) / (1 - control)), 4) AS risk FROM rate""",
)
def _(t):
    return V.linkability_risk(*_three(t), "o_orderkey", ["o_totalprice"], ["o_custkey", "o_orderstatus"])


def _risk_only(sql: str) -> str:
    return f"(SELECT risk FROM ({sql}))"


@query("privacy_score", f"SELECT round(1 - greatest({_risk_only(_univariate_sql())}, {_risk_only(_multivariate_sql())}), 4) AS privacy_score")
def _(t):
    three = _three(t)
    return V.privacy_score([V.singling_out_univariate(*three, _MULTI), V.singling_out_multivariate(*three, _MULTI)])


POINT_TABLE = as_select(POINTS_SQL, "orders")


@query(
    "quality_gate",
    f"""SELECT run_id, fidelity_score, privacy_score, fidelity_score >= 0.75 AS fidelity_passed, privacy_score >= 0.5 AS privacy_passed,
        fidelity_score >= 0.75 AND privacy_score >= 0.5 AS passed, concat_ws('; ',
          CASE WHEN fidelity_score < 0.75 THEN printf('too far from the real table: %.3f, at least 0.75 is asked for', fidelity_score) END,
          CASE WHEN privacy_score < 0.5 THEN printf('discloses too much: %.3f, at least 0.5 is asked for', privacy_score) END) AS violations
        FROM {POINT_TABLE} p""",
)
def _(t):
    return V.quality_gate(t.derived(POINTS, "orders").select("run_id", "fidelity_score", "privacy_score"))


# --- run comparison ----------------------------------------------------------------------------------------

COMPOSITE = "(fidelity_score * 0.5 + privacy_score * 0.5 + utility_score * 0.0)"


def _points(t):
    return t.derived(POINTS, "orders")


@query(
    "composite_score",
    f"""SELECT run_id, round(fidelity_score * (2.0::DOUBLE / 4) + privacy_score * (1.0::DOUBLE / 4) + utility_score * (1.0::DOUBLE / 4), 6) AS composite_score
        FROM {POINT_TABLE} p""",
)
def _(t):
    out = E.composite_score(_points(t), fidelity=2, privacy=1, utility=1)
    return out.select("run_id", F.round("composite_score", 6).alias("composite_score"))


def _front_sql(names: list[str], table: str) -> str:
    no_worse = " AND ".join(f"o.{n} >= p.{n}" for n in names)
    better = " OR ".join(f"o.{n} > p.{n}" for n in names)
    return f"(SELECT * FROM {table} p WHERE NOT EXISTS (SELECT 1 FROM {table} o WHERE {no_worse} AND ({better})))"


THREE_SCORES = ["fidelity_score", "privacy_score", "utility_score"]


@query(
    "pareto_frontier",
    f"""WITH t AS {POINT_TABLE} SELECT run_id, epsilon, fidelity_score, privacy_score, utility_score FROM {_front_sql(THREE_SCORES, "t")} x""",
)
def _(t):
    return E.pareto_frontier(_points(t)).select("run_id", "epsilon", *THREE_SCORES)


CURVE_IN = "o_orderkey; (o_custkey % 100 + 1) / 10.0D AS epsilon; (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0D AS fidelity"
CURVE = f"(SELECT *, 1.0::DOUBLE / (1.0 + epsilon) AS privacy FROM {as_select(CURVE_IN.replace('0D', '0::DOUBLE'), 'orders')} x)"


def _curve(t):
    return E.tradeoff_curve(t.derived(CURVE_IN, "orders"))


@query("pareto_tradeoff", f"WITH t AS {CURVE} SELECT o_orderkey, epsilon, fidelity, round(privacy, 8) AS privacy FROM {_front_sql(['fidelity', 'privacy'], 't')} x")
def _(t):
    return E.pareto_tradeoff(_curve(t)).withColumn("privacy", F.round("privacy", 8))


@query("production_ready", f"SELECT run_id, fidelity_score, privacy_score FROM {POINT_TABLE} p WHERE fidelity_score >= 0.7 AND privacy_score >= 0.5")
def _(t):
    return E.production_ready(_points(t)).select("run_id", "fidelity_score", "privacy_score")


_READY = "fidelity_score >= 0.7 AND privacy_score >= 0.5"
_BEST = f"""SELECT run_id, generator_type, epsilon, round({COMPOSITE}, 4) AS composite_score FROM t WHERE {_READY}
    ORDER BY {COMPOSITE} DESC, num_rows LIMIT 1"""


@query(
    "recommend_config",
    f"""WITH t AS {POINT_TABLE}, b AS ({_BEST}) SELECT b.*, 'largest weighted score among the runs that pass both gates' AS reason,
        (SELECT count(*) FROM t) AS candidate_count, (SELECT count(*) FROM t WHERE {_READY}) AS production_ready_count,
        0.5::DOUBLE AS weight_fidelity, 0.5::DOUBLE AS weight_privacy, 0.0::DOUBLE AS weight_utility FROM b""",
)
def _(t):
    return E.recommend_config(_points(t), order=["num_rows"])


_SUMMARY = f"""SELECT generator_type, count(*) AS evaluation_count, count_if({_READY}) AS production_ready_count,
    round(avg(fidelity_score), 4) AS mean_fidelity, round(max(fidelity_score), 4) AS max_fidelity, round(min(fidelity_score), 4) AS min_fidelity,
    round(avg(privacy_score), 4) AS mean_privacy, round(max(privacy_score), 4) AS max_privacy, round(min(privacy_score), 4) AS min_privacy,
    round(avg({COMPOSITE}), 4) AS mean_composite_score, round(max({COMPOSITE}), 4) AS max_composite_score,
    round(avg(training_time_s), 2) AS mean_training_time_s, round(min(epsilon), 4) AS min_epsilon, round(max(epsilon), 4) AS max_epsilon
    FROM {POINT_TABLE} p GROUP BY generator_type"""


@query("generator_summary", _SUMMARY)
def _(t):
    return E.generator_summary(_points(t))


@query(
    "generator_ranking",
    f"""SELECT row_number() OVER (ORDER BY mean_composite_score DESC, generator_type) AS rank, generator_type, mean_composite_score
        FROM ({_SUMMARY})""",
)
def _(t):
    return E.generator_ranking(_points(t))


@query("tradeoff_curve", f"SELECT o_orderkey, epsilon, fidelity, round(privacy, 8) AS privacy FROM {CURVE} x")
def _(t):
    return _curve(t).withColumn("privacy", F.round("privacy", 8))


@query(
    "tradeoff_summary",
    f"""SELECT min(epsilon) AS min_epsilon, max(epsilon) AS max_epsilon, count(*) AS points,
        (SELECT count(*) FROM orders) AS real_rows, (SELECT count(*) FROM lineitem) AS synthetic_rows,
        round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders), 4) AS dataset_size_ratio FROM {CURVE} x""",
)
def _(t):
    return E.tradeoff_summary(_curve(t), t.orders, t.lineitem)


@query(
    "recommend_epsilon",
    f"""WITH t AS {CURVE} SELECT epsilon, fidelity, round(privacy, 8) AS privacy, 'best harmonic mean on the frontier' AS reason
        FROM t ORDER BY 2 * t.fidelity * t.privacy / (t.fidelity + t.privacy + 1e-10) DESC, epsilon LIMIT 1""",
)
def _(t):
    return E.recommend_epsilon(_curve(t)).withColumn("privacy", F.round("privacy", 8))


@query(
    "tradeoff_axes",
    f"""WITH t AS {POINT_TABLE} SELECT round(min(fidelity_score), 3) AS x_min, round(max(fidelity_score), 3) AS x_max,
        round(min(privacy_score), 3) AS y_min, round(max(privacy_score), 3) AS y_max, count(*) AS total_points,
        (SELECT count(*) FROM {_front_sql(THREE_SCORES, "t")} x) AS pareto_point_count, 0.7::DOUBLE AS min_fidelity, 0.5::DOUBLE AS min_privacy FROM t""",
)
def _(t):
    return E.tradeoff_axes(_points(t))


@query(
    "tradeoff_series",
    f"""WITH t AS {POINT_TABLE}, f AS {_front_sql(THREE_SCORES, "t")} SELECT run_id, epsilon, fidelity_score, privacy_score,
        run_id IN (SELECT run_id FROM f) AS on_frontier FROM t""",
)
def _(t):
    return E.tradeoff_series(_points(t)).select("run_id", "epsilon", "fidelity_score", "privacy_score", "on_frontier")


@query(
    "dataset_comparison",
    f"""WITH r AS (SELECT * FROM orders), s AS {as_select("o_orderkey; CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice; o_custkey AS extra", "orders")}
        SELECT (SELECT count(*) FROM r) AS real_row_count, 6::BIGINT AS real_column_count, 0.0::DOUBLE AS real_null_rate,
        count(*) AS synthetic_row_count, 3::BIGINT AS synthetic_column_count, round(count_if(o_totalprice IS NULL) / (3 * count(*)), 4) AS synthetic_null_rate,
        round(count(*) / (SELECT count(*) FROM r), 4) AS size_ratio, 2::BIGINT AS column_overlap FROM s""",
)
def _(t):
    syn = t.derived("o_orderkey; CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice; o_custkey AS extra", "orders")
    return E.dataset_comparison(t.orders, syn)


@query(
    "evaluation_report",
    f"""WITH t AS {POINT_TABLE}, rk AS (SELECT generator_type, row_number() OVER (ORDER BY mean_composite_score DESC, generator_type) AS rank FROM ({_SUMMARY}))
        SELECT 'evaluation_summary' AS section, 'total_points' AS item, count(*)::DOUBLE AS value FROM t
        UNION ALL SELECT 'evaluation_summary', 'generator_types', count(DISTINCT generator_type) FROM t
        UNION ALL SELECT 'evaluation_summary', 'pareto_points', count(*) FROM {_front_sql(THREE_SCORES, "t")} x
        UNION ALL SELECT 'ranking', generator_type, rank FROM rk
        UNION ALL SELECT 'recommendation', 'composite_score', composite_score FROM ({_BEST})
        UNION ALL SELECT 'recommendation', 'production_ready_count', count(*) FROM t WHERE {_READY}
        UNION ALL SELECT 'dataset', 'size_ratio', 1.0
        UNION ALL SELECT 'dataset', 'column_overlap', 5.0""",
)
def _(t):
    return E.evaluation_report(_points(t), *_pair(t))


@query(
    "evaluation_history",
    f"""SELECT generator_type, 2 * count(*) AS n, round(2 * sum(round(fidelity_score, 4)), 4) AS fidelity_sum FROM {POINT_TABLE} p GROUP BY generator_type""",
)
def _(t):
    path = scratch_path(t.spark, "evaluation-history")
    E.record_evaluation(_points(t), path)
    history = E.record_evaluation(_points(t), path)
    return history.groupBy("generator_type").agg(F.count("*").alias("n"), F.round(F.sum("fidelity_score"), 4).alias("fidelity_sum"))


# --- budget ------------------------------------------------------------------------------------------------

# Grants come from customers, allocations from orders and consumptions from finished orders; a nation is a tenant.
_LEDGER = """(SELECT c_nationkey AS tenant_id, 'grant' AS entry, concat('g', c_custkey) AS allocation_id,
      CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS epsilon FROM customer
    UNION ALL SELECT c_nationkey, 'allocation', concat('a', o_orderkey), CAST(floor(o_totalprice * 2) AS BIGINT)
      FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT c_nationkey, 'consumption', concat('a', o_orderkey), CAST(floor(o_totalprice) AS BIGINT)
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F')"""
_STATUS = f"""(SELECT tenant_id, CAST(sum(g) AS BIGINT) AS total_budget, CAST(sum(coalesce(s, h, 0)) AS BIGINT) AS consumed_budget,
    CAST(sum(g) - sum(coalesce(s, h, 0)) AS BIGINT) AS remaining_budget, count(h) AS allocation_count FROM (
      SELECT tenant_id, allocation_id, sum(CASE WHEN entry = 'grant' THEN epsilon ELSE 0 END) AS g,
        max(CASE WHEN entry = 'allocation' THEN epsilon END) AS h, max(CASE WHEN entry = 'consumption' THEN epsilon END) AS s
      FROM {_LEDGER} l GROUP BY ALL) GROUP BY tenant_id)"""


def _ledger(t):
    owner = t.customer.select("c_custkey", "c_nationkey")
    held = t.orders.join(owner, F.col("c_custkey") == F.col("o_custkey"))
    key = F.concat(F.lit("a"), F.col("o_orderkey"))
    whole = lambda x: F.floor(x).cast("long")
    row = lambda entry, k, eps: [
        F.col("c_nationkey").alias("tenant_id"), F.lit(entry).alias("entry"), k.alias("allocation_id"), eps.alias("epsilon")
    ]
    grants = t.customer.select(*row("grant", F.concat(F.lit("g"), F.col("c_custkey")), whole(F.abs("c_acctbal") * 1000)))
    allocations = held.select(*row("allocation", key, whole(F.col("o_totalprice") * 2)))
    spent = held.filter("o_orderstatus = 'F'").select(*row("consumption", key, whole(F.col("o_totalprice"))))
    return grants.unionByName(allocations).unionByName(spent)


@query("budget_status", f"SELECT * FROM {_STATUS} s")
def _(t):
    return B.budget_status(_ledger(t))


_CHECKS = """o_orderkey AS request_id; o_custkey % 30 AS tenant_id;
CASE WHEN o_orderpriority = '1-URGENT' THEN 'strict' WHEN o_orderpriority = '2-HIGH' THEN 'moderate' WHEN o_orderpriority = '3-MEDIUM' THEN 'lenient' END AS level;
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN NULL ELSE CAST(floor(o_totalprice * 100) AS BIGINT) END AS epsilon"""


@query(
    "budget_check",
    f"""WITH q AS (SELECT request_id, tenant_id, coalesce(epsilon, CASE level WHEN 'strict' THEN 100000 WHEN 'moderate' THEN 1000000
          ELSE 5000000 END) AS e FROM {as_select(_CHECKS, "orders")} x)
        SELECT request_id, q.tenant_id, e AS requested_epsilon, coalesce(remaining_budget, 0) AS remaining_budget,
          coalesce(remaining_budget, 0) >= e AS sufficient, greatest(0, e - coalesce(remaining_budget, 0)) AS shortfall
        FROM q LEFT JOIN {_STATUS} s ON s.tenant_id = q.tenant_id""",
)
def _(t):
    return B.budget_check(B.budget_status(_ledger(t)), t.derived(_CHECKS, "orders"))


@query(
    "budget_allocate",
    """WITH RECURSIVE req AS (SELECT o_orderkey AS request_id, c_nationkey AS tenant_id, CAST(floor(o_totalprice * 10) AS BIGINT) AS epsilon,
          row_number() OVER (PARTITION BY c_nationkey ORDER BY epoch_us(o_orderdate), o_orderkey) AS i
          FROM orders JOIN customer ON c_custkey = o_custkey),
        bud AS (SELECT c_nationkey AS tenant_id, CAST(sum(floor(abs(c_acctbal) * 1000)) AS BIGINT) AS budget FROM customer GROUP BY 1),
        run AS (SELECT tenant_id, 0::BIGINT AS i, budget AS rest, NULL::BIGINT AS request_id, 0::BIGINT AS epsilon, false AS yes FROM bud
          UNION ALL SELECT run.tenant_id, run.i + 1, CASE WHEN req.epsilon <= rest THEN rest - req.epsilon ELSE rest END,
            req.request_id, req.epsilon, req.epsilon <= rest FROM run JOIN req ON req.tenant_id = run.tenant_id AND req.i = run.i + 1)
        SELECT request_id, tenant_id, epsilon, CASE WHEN yes THEN 'approved' ELSE 'rejected' END AS allocation_status,
          rest AS remaining_budget, yes AND rest < 1000000 AS low_budget FROM run WHERE i > 0""",
)
def _(t):
    owner = t.customer.select("c_custkey", F.col("c_nationkey").alias("tenant_id"))
    requests = t.orders.join(owner, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("request_id"), "tenant_id", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seq"),
        F.floor(F.col("o_totalprice") * 10).cast("long").alias("epsilon"),
    )
    budgets = t.customer.groupBy(F.col("c_nationkey").alias("tenant_id")).agg(
        F.sum(F.floor(F.abs("c_acctbal") * 1000).cast("long")).alias("budget")
    )
    return B.budget_allocate(requests, budgets)


@query(
    "budget_consume",
    """WITH alloc AS (SELECT o_orderkey AS allocation_id, CAST(floor(o_totalprice) AS BIGINT) AS held FROM orders),
        att AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS attempt_id,
          CASE WHEN l_linenumber = 7 THEN l_orderkey + 10000000 ELSE l_orderkey END AS allocation_id,
          CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(floor(l_extendedprice * 4) AS BIGINT) END AS actual FROM lineitem),
        j AS (SELECT att.*, held, coalesce(actual, held) AS spent, held IS NOT NULL AND coalesce(actual, held) <= held AS valid
          FROM att LEFT JOIN alloc USING (allocation_id)),
        f AS (SELECT allocation_id, min(attempt_id) AS first FROM j WHERE valid GROUP BY 1),
        o AS (SELECT j.*, CASE WHEN held IS NULL THEN 'unknown_allocation' WHEN attempt_id > first THEN 'already_consumed'
          WHEN NOT valid THEN 'exceeds_allocation' ELSE 'consumed' END AS outcome FROM j LEFT JOIN f USING (allocation_id))
        SELECT outcome, count(*) AS n, CAST(coalesce(sum(CASE WHEN outcome = 'consumed' THEN spent END), 0) AS BIGINT) AS epsilon_spent FROM o GROUP BY outcome""",
)
def _(t):
    allocations = t.orders.select(F.col("o_orderkey").alias("allocation_id"), F.floor("o_totalprice").cast("long").alias("epsilon"))
    # A struct orders attempts without numbering them.
    attempt = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    attempts = t.lineitem.select(
        attempt.alias("attempt_id"),
        F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 10_000_000).otherwise(F.col("l_orderkey")).alias("allocation_id"),
        F.when(F.col("l_linenumber") != 3, F.floor(F.col("l_extendedprice") * 4).cast("long")).alias("actual_epsilon"),
    )
    done = B.budget_consume(allocations, attempts)
    return done.groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("epsilon_spent"), F.lit(0)).alias("epsilon_spent"))


@query(
    "budget_per_sequence",
    """SELECT count(*) AS sequences, CAST(sum(n) AS BIGINT) AS rows, max(n) AS longest, count(*) * 500000 AS epsilon_by_sequence,
       CAST(sum(n) * 500000 AS BIGINT) AS epsilon_by_row FROM (SELECT least(count(*), 60) AS n FROM events GROUP BY user_id)""",
)
def _(t):
    return B.budget_per_sequence(B.bound_contributions(t.events, "user_id", ["ts", "event_id"], 60), "user_id", 500_000)


# --- run history -------------------------------------------------------------------------------------------

# A user is a job; kinds of events stand for states.
_STATES = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'training' WHEN 'click' THEN 'generating'
    WHEN 'purchase' THEN 'validating' WHEN 'error' THEN 'failed' ELSE 'complete' END"""
JOB_EVENTS = f"event_id; user_id AS job_id; user_id % 7 AS tenant_id; {_STATES} AS status; ts"
_JOBS = as_select(JOB_EVENTS, "events")


def _events(t):
    return t.derived(JOB_EVENTS, "events")


@query("job_events", f"SELECT status, 2 * count(*) AS n, count(DISTINCT job_id) AS jobs FROM {_JOBS} e GROUP BY status")
def _(t):
    path = scratch_path(t.spark, "job-events")
    H.job_events(_events(t), path)
    table = H.job_events(_events(t), path)
    return table.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


@query("job_status", f"SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM {_JOBS} e GROUP BY job_id")
def _(t):
    return H.job_status(_events(t))


TRANSITIONS_SQL = f"""SELECT event_id, job_id, previous_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous_status
          FROM {_JOBS} e) WHERE NOT coalesce(CASE previous_status WHEN 'queued' THEN status IN ('training', 'failed')
            WHEN 'training' THEN status IN ('generating', 'failed') WHEN 'generating' THEN status IN ('validating', 'failed')
            WHEN 'validating' THEN status IN ('complete', 'failed') WHEN 'complete' THEN false WHEN 'failed' THEN false
            ELSE status = 'queued' END, false)"""


@query("invalid_transitions", TRANSITIONS_SQL)
def _(t):
    return H.invalid_transitions(_events(t))


@query(
    "list_jobs",
    """SELECT o_orderkey AS job_id, o_orderstatus AS status, (SELECT count(*) FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F') AS total
       FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25""",
)
def _(t):
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 10).alias("tenant_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return H.list_jobs(jobs, 3, "F", page=2, page_size=25).select("job_id", "status", "total")
