"""Run comparison, budget, history and privacy against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from synthspark.operators import budget as B
from synthspark.operators import evaluate as E
from synthspark.operators import history as H
from synthspark.operators import privacy as V
from synthspark.plans.generation import RunConfig, run_job
from tests.conftest import rows


def points(spark, n, seed):
    rng = random.Random(seed)
    data = [(str(i), f"g{i % 3}", float(i % 5), rng.randint(0, 12) / 12, rng.randint(0, 12) / 12, rng.randint(0, 3) / 3) for i in range(n)]
    data += [(str(n + i), "hot", 1.0, 0.25, 0.5, 0.0) for i in range(n // 2)]  # a third share one vector
    return data, spark.createDataFrame(data, "run_id string, generator_type string, epsilon double, fidelity_score double, privacy_score double, utility_score double")


@pytest.mark.parametrize("k", [2, 3])
def test_frontier(spark, k):
    data, df = points(spark, 400, k)
    names = E.OBJECTIVES[:k]
    score = {r[0]: r[3 : 3 + k] for r in data}
    want = {
        i for i, s in score.items()
        if not any(all(a >= b for a, b in zip(o, s)) and o != s for o in score.values())
    }
    assert {r["run_id"] for r in E.pareto_frontier(df, names).collect()} == want


def test_recommendation_without_candidates(spark):
    _, df = points(spark, 9, 1)
    none = E.recommend_config(df.withColumn("fidelity_score", F.lit(0.1)))
    row = none.first()
    assert row["run_id"] is None and row["reason"].startswith("no run passes both gates") and row["production_ready_count"] == 0
    assert E.recommend_config(df.limit(0)).first()["reason"] == "there are no runs to compare"
    with pytest.raises(ValueError):
        E.composite(0, 0, 0)


def test_curve_lists(spark):
    curve = E.tradeoff_from_lists(spark, [0.5, 1.0, float("inf")], [0.4, 0.9, 0.95])
    assert E.recommend_epsilon(curve).first()["epsilon"] == 1.0
    assert E.recommend_epsilon(curve.limit(0)).first()["epsilon"] == 1.0
    with pytest.raises(ValueError):
        E.tradeoff_from_lists(spark, [1.0], [])


def test_greedy_admission(spark):
    rng = random.Random(5)
    # Tenant 0 holds most requests.
    asked = [(i, 0 if i % 3 else i % 7, i // 2, rng.choice([1, 5, 40, 300, 2000])) for i in range(900)]
    budgets = {t: 3000 + 500 * t for t in range(6)}
    left, want = dict(budgets), {}
    for rid, tenant, seq, eps in sorted(asked, key=lambda r: (r[2], r[0])):
        fits = eps <= left.get(tenant, 0)
        if fits:
            left[tenant] -= eps
        want[rid] = ("approved" if fits else "rejected", left.get(tenant, 0))
    df = spark.createDataFrame(asked, "request_id long, tenant_id long, seq long, epsilon long").repartition(6)
    out = B.budget_allocate(df, spark.createDataFrame(list(budgets.items()), "tenant_id long, budget long"), chunks=8)
    assert {r["request_id"]: (r["allocation_status"], r["remaining_budget"]) for r in out.collect()} == want


def test_consumption(spark):
    held = spark.createDataFrame([("a", 10), ("b", 5)], "allocation_id string, epsilon long")
    tries = spark.createDataFrame([(1, "a", 11), (2, "a", 4), (3, "a", 1), (4, "b", None), (5, "x", 1)], "attempt_id int, allocation_id string, actual_epsilon long")
    assert [(r[2], r[3]) for r in rows(B.budget_consume(held, tries), "attempt_id")] == [
        ("exceeds_allocation", None), ("consumed", 4), ("already_consumed", None), ("consumed", 5), ("unknown_allocation", None),
    ]


def test_levels(spark):
    status = spark.createDataFrame([(1, 2_000_000)], "tenant_id int, remaining_budget long")
    asks = spark.createDataFrame([(1, 1, "moderate", None), (2, 1, "disabled", None), (3, 2, None, 1)], "request_id int, tenant_id int, level string, epsilon long")
    got = {r["request_id"]: (r["sufficient"], r["shortfall"] > 0) for r in B.budget_check(status, asks).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True)}


def test_previous_row_across_chunks(spark):
    data = [(i, i % 2 if i % 3 else 0, float(i), chr(97 + i % 26)) for i in range(300)]
    df = spark.createDataFrame(data, "event_id int, k int, ts double, v string").repartition(5)
    got = {r["event_id"]: r["p"] for r in H.previous(df, "k", ["ts", "event_id"], "v", F.floor(F.col("ts") / 7), "p").collect()}
    last: dict = {}
    for i, k, _, v in data:
        assert got[i] == last.get(k)
        last[k] = v


def test_copy_is_risky_and_noise_is_not(spark):
    df = spark.range(300).selectExpr("id", "id * 1.5 as x", "id % 3 as g")
    far = df.selectExpr("id", "x + 10000.25 as x", "g")
    copied = V.singling_out_univariate(df, df, far, ["x"]).first()
    assert copied["risk"] == 1.0
    assert V.singling_out_univariate(df, far, df.limit(0), ["x"]).first()["attack_rate"] < 0.01
    assert V.singling_out_multivariate(df, df, far, ["x", "g"]).first()["risk"] > 0.5


def test_links(spark):
    df = spark.range(200).selectExpr("id", "(id * 37 % 211) * 1.0 as x", "(id * 53 % 223) * 1.0 as y")
    out = V.linkability_risk(df, df, df.selectExpr("id", "y as x", "x as y"), "id", ["x"], ["y"]).first()
    assert out["attack_rate"] == 1.0 and out["control_rate"] < 0.2


def test_links_search_both_sides_at_once(spark, monkeypatch):
    """Real and control rows with the same ids, repeated vectors and empty cells against all pairs; two searches in all."""
    rng = random.Random(4)
    made = lambda step: [(i, rng.randrange(60) + step, rng.choice([None, "a", "b"]), rng.choice([None, *range(40)])) for i in range(150)]
    tables = [made(0), made(0), made(3)]

    def best(row, c, others):
        span = max(s[c] for s in tables[1] if s[c] is not None) - min(s[c] for s in tables[1] if s[c] is not None)
        near = [(round(abs(row[c] - s[c]) / span + sum(row[o] != s[o] for o in others), 9), s[0]) for s in tables[1] if s[c] is not None]
        return min(near)[1]

    def rate(targets):
        hits = [r[3] is not None and best(r, 1, [2]) == best(r, 3, []) for r in targets]
        return round(sum(hits) / len(hits), 4)

    searches = []
    nearest = V.nearest
    monkeypatch.setattr(V, "nearest", lambda *a, **o: searches.append(1) or nearest(*a, **o))
    frames = [spark.createDataFrame(t, "id long, x long, g string, y long") for t in tables]
    out = V.linkability_risk(*frames, "id", ["x", "g"], ["y"]).first()
    assert (out["attempts"], out["attack_rate"], out["control_rate"]) == (150, rate(tables[0]), rate(tables[2]))
    assert len(searches) == 2


def test_job_scores_are_worked_out_once(spark):
    df = spark.range(400).selectExpr("id % 7 as g", "(hash(id) % 1000) / 10.0D as x")
    result = run_job(df, RunConfig(num_rows=400, sdtypes={"g": "categorical", "x": "numerical"}))
    spark.sparkContext.setJobGroup("scores", "")
    row = result.scores.first()
    spark.sparkContext.setJobGroup("others", "")
    assert row["passed"] == (result.status == "complete")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("scores")) <= 1


def test_allocation_rounds_do_not_grow_with_requests(spark, monkeypatch):
    """Large and small requests in turn: the rounds follow the budget's digits, the result plain admission."""
    import random

    def plain(requests, budgets):
        left, out = dict(budgets), {}
        for key, tenant, _, epsilon in sorted(requests, key=lambda r: (r[2], r[0])):
            fits = epsilon <= left.get(tenant, 0)
            left[tenant] = left.get(tenant, 0) - (epsilon if fits else 0)
            out[key] = (fits, left[tenant])
        return out

    rounds = []
    cut = B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    rng = random.Random(3)
    budgets = {0: 4000, 1: 1000, 2: 0, 3: (1 << 62) - 1, 5: 7}
    requests = [(k, 0, k, 1 if k % 2 else 5000 - 2 * k) for k in range(1500)]
    requests += [(2000 + k, 1, k // 3, rng.choice([0, 1, 3, 40, 400, 5000])) for k in range(400)]
    requests += [(3000 + k, 2, k, k % 3) for k in range(9)] + [(4000 + k, 3, k, 1 << 60) for k in range(12)]
    requests += [(5000, 4, 0, 1), (5001, 4, 1, 0), *[(6000 + k, 5, k, 4 >> (k % 4)) for k in range(12)]]
    df = spark.createDataFrame(requests, "request_id long, tenant_id long, seq long, epsilon long")
    out = B.budget_allocate(df, spark.createDataFrame(list(budgets.items()), "tenant_id long, budget long"), chunks=8)
    got = {r["request_id"]: (r["allocation_status"] == "approved", r["remaining_budget"]) for r in out.collect()}
    assert got == plain(requests, budgets)
    assert len(rounds) <= 1 + 14
