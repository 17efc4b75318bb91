"""Scans of block maps, seasons and vector autoregressions against loops over whole sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthspark.generators import recurrence as R
from synthspark.generators.sequence import long_sequence_fit, par_fit
from synthspark.session import stored


def frame(spark, rows, schema):
    return stored(spark.createDataFrame(rows, schema).repartition(5))


@pytest.mark.parametrize("n_blocks", [1, 3, 4, 11, 70])
def test_affine_scan_equals_a_loop(spark, n_blocks):
    rng = np.random.default_rng(1)
    matrix = np.array([[0.9, 0.2], [-0.1, 0.7]])
    summaries = rng.normal(size=(3, n_blocks, 2))
    starts = rng.normal(size=(3, 2))
    blocks = frame(spark, [(k, b, summaries[k, b].tolist()) for k in range(3) for b in range(n_blocks)], "k long, _b long, _summary array<double>")
    first = frame(spark, [(k, starts[k].tolist()) for k in range(3)], "k long, _state array<double>")
    got = {(r["k"], r["_b"]): r["_state"] for r in R.scan(blocks, first, R.AffineMaps(matrix), n_blocks, "k", fan=4).collect()}
    assert len(got) == 3 * n_blocks
    for k in range(3):
        state = starts[k]
        for b in range(n_blocks):
            assert got[k, b] == pytest.approx(state.tolist())
            state = matrix @ state + summaries[k, b]


def test_finite_scan_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    sizes, n_blocks = (3, 2), 23
    tables = [np.concatenate([rng.integers(0, n, n) for n in sizes]).astype(float) for _ in range(n_blocks)]
    blocks = frame(spark, [(1, b, tables[b].tolist()) for b in range(n_blocks)], "k long, _b long, _summary array<double>")
    first = frame(spark, [(1, [2.0, 1.0])], "k long, _state array<double>")
    got = {r["_b"]: r["_state"] for r in R.scan(blocks, first, R.FiniteMaps(sizes), n_blocks, "k", fan=3).collect()}
    state = [2, 1]
    for b in range(n_blocks):
        assert got[b] == state
        state = [int(tables[b][state[0]]), int(tables[b][3 + state[1]])]


def test_stationary_covariance_solves_its_equation():
    weights = np.array([[[0.5, 0.1], [0.0, 0.3]], [[0.3, 0.0], [0.1, 0.2]]])
    matrix, noise = R.companion(weights), np.zeros((4, 4))
    noise[:2, :2] = [[1.0, 0.4], [0.4, 0.8]]
    p = R.stationary(matrix, noise)
    assert p == pytest.approx(matrix @ p @ matrix.T + noise, abs=1e-9)
    root = R.root_of(p)
    assert root @ root.T == pytest.approx(p, abs=1e-9)


def test_weights_that_explode_are_shrunk():
    weights = np.array([[[1.4]], [[0.2]]])
    calm = R.stabilised(weights)
    assert np.abs(np.linalg.eigvals(R.companion(calm))).max() == pytest.approx(0.999, abs=1e-6)
    assert R.stabilised(np.array([[[0.5]]]))[0, 0, 0] == 0.5


def process(rng, steps, season=12):
    """Two measures with a season, cross effects and correlated noise."""
    weights = np.array([[0.6, 0.2], [-0.1, 0.5]])
    y, out = np.zeros(2), []
    for t in range(steps):
        e = rng.normal(size=2)
        y = weights @ y + [e[0], 0.7 * e[0] + 0.7 * e[1]]
        out.append(y + 2.0 * np.sin(2 * np.pi * t / season) * np.array([1.0, -0.5]))
    return np.array(out), weights


def test_blocks_give_the_sums_of_whole_sequences(spark):
    rng = np.random.default_rng(3)
    values = {k: process(rng, steps)[0] for k, steps in ((1, 700), (2, 55), (3, 4), (4, 1))}
    numbered = frame(spark, [(k, t + 1, v.tolist()) for k, x in values.items() for t, v in enumerate(x)], "k long, _n long, s array<double>")
    blocks = stored(R.blocks_of(numbered, 60, 30))
    assert blocks.agg(F.max(F.size("values"))).first()[0] <= 2 * 90
    correlations, steps = R.autocorrelations(blocks, 2, 30)
    assert steps == 760
    every = np.concatenate(list(values.values()))
    for lag in (1, 12, 30):
        pairs = np.concatenate([x[lag:] * x[: len(x) - lag] for x in values.values() if len(x) > lag])
        want = (pairs.mean(axis=0) - every.mean(axis=0) ** 2) / every.var(axis=0)
        assert correlations[lag] == pytest.approx(want.mean(), abs=1e-9)
    weights, covariance = R.regress(blocks, 2, 2, np.zeros((1, 2)))
    past = np.concatenate([np.concatenate([x[1:-1], x[:-2]], axis=1) for x in values.values() if len(x) > 2])
    now = np.concatenate([x[2:] for x in values.values() if len(x) > 2])
    want, *_ = np.linalg.lstsq(past, now, rcond=None)
    assert weights.transpose(1, 0, 2).reshape(2, 4) == pytest.approx(want.T, abs=1e-5)
    rest = now - past @ want
    assert covariance == pytest.approx(rest.T @ rest / len(rest), abs=1e-6)


def test_season_needs_a_peak():
    decay = 0.9 ** np.arange(60)
    assert R.season_of(decay, 10_000) == 0
    wave = 0.8 * np.cos(2 * np.pi * np.arange(60) / 12) * 0.995 ** np.arange(60)
    assert R.season_of(wave, 10_000) == 12
    assert R.season_of(wave, 20) == 0
    noisy = 0.4 * np.cos(2 * np.pi * np.arange(200) / 24) + np.where(np.arange(200) == 25, 0.02, 0.0)
    assert R.season_of(noisy, 10_000) == 24
    assert R.season_of(np.zeros(60), 0) == 0


def test_long_sequences_keep_season_and_cross_effects(spark):
    rng = np.random.default_rng(5)
    rows, weights = [], None
    for k in range(2):
        values, weights = process(rng, 6000)
        rows += [(k, t, float(a), float(b)) for t, (a, b) in enumerate(values)]
    df = frame(spark, rows, "k long, t long, a double, b double")
    model = long_sequence_fit(df, "k", "t", ["a", "b"], lags=2, max_season=40)
    assert len(model.season) == 12 and model.length == 6000
    made = stored(model.sample(1, 30_000, seed=1)).orderBy("t").toPandas()
    assert list(made.t) == list(range(30_000))
    real = df.where("k = 0").orderBy("t").toPandas()
    for x, y, lag in (("a", "b", 0), ("a", "a", 1), ("b", "a", 1), ("a", "b", 1), ("a", "a", 12)):
        got, want = (f[x][lag:].corr(f[y].shift(lag)[lag:]) for f in (made, real))
        assert got == pytest.approx(want, abs=0.06), (x, y, lag)
    # The first steps are as spread as the later ones.
    begun = model.sample(400, 3, seed=2).where("t = 0").agg(F.stddev("a")).first()[0]
    assert begun == pytest.approx(np.std(real.a[::12]), rel=0.2)


def test_skewed_residuals_stay_in_their_phase(spark):
    """Rare large values lie far out in a trough's scores; drawn into a peak they would be far too large."""
    df = stored(spark.range(20_000).selectExpr("1 as k", "id as t", "-2.5D * ln((pmod(xxhash64(id), 100000) + 1) / 100001.0D) + 3 * sin(2 * pi() * (id % 24) / 24) as v"))
    made = stored(long_sequence_fit(df, "k", "t", "v").sample(1, seed=3))

    def facts(rows):
        before = rows.selectExpr("t + 1 as t", "v as last")
        return rows.join(before, "t").agg(F.corr("v", "last").alias("lag"), F.stddev("v").alias("spread")).first()

    want, got = facts(df), facts(made)
    assert got["lag"] == pytest.approx(want["lag"], abs=0.04)
    assert got["spread"] == pytest.approx(want["spread"], rel=0.08)


def test_short_segments_are_filled_in_phase(spark):
    """Without noise the residuals repeat with the season, whatever segments and sequence lengths are."""
    df = stored(spark.range(1130).selectExpr("id % 5 as k", "id div 5 as t", "cast((id div 5) % 6 as double) as v"))
    model = long_sequence_fit(df, "k", "t", "v", segment_size=15, lags=2, season=6)
    assert sum(model.n_blocks.values()) == model.blocks.count() and all(0 <= p < 6 for p in model.n_blocks)
    indices = model.blocks.groupBy("_phase").agg(F.count("*").alias("n"), F.count_distinct("_index").alias("d"), F.max("_index").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 == model.n_blocks[r["_phase"]] for r in indices)
    assert model.sample(3, 40).count() == 120


def test_a_million_steps_are_many_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id", F.sin(F.col("id") / 3).alias("v"))
    model = long_sequence_fit(df, "k", "id", "v", max_season=50)
    made = model.sample(1, 1_000_000)
    row = made.select("id", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("id").alias("m"), F.count_distinct("id").alias("d"), F.count_distinct("p").alias("p")).first()
    assert (row["n"], row["m"], row["d"]) == (1_000_000, 999_999, 1_000_000) and row["p"] >= 4


def test_same_seed_same_steps_whatever_the_layout(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("k"), "id", F.rand(1).alias("v"), F.when(F.col("id") % 7 > 0, F.rand(2)).alias("w"))
    model = long_sequence_fit(stored(df), "k", "id", ["v", "w"], segment_size=7, max_season=20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        made = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made.append([tuple(r) for r in model.sample(5, 50, seed=9).orderBy("k", "id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] and len(made[0]) == 250
    assert any(r[3] is None for r in made[0]) and not any(r[2] is None for r in made[0])


def test_unusable_input_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "k long, t long, v double")
    with pytest.raises(ValueError, match="more than"):
        long_sequence_fit(df, "k", "t", "v")
    with pytest.raises(ValueError, match="missing"):
        long_sequence_fit(df, "k", "none", "v")


def test_chains_move_like_their_counts():
    counts = np.array([[[90.0, 10.0, 0.0], [5.0, 90.0, 5.0], [0.0, 20.0, 80.0]], np.zeros((3, 3))])
    chain = R.Chain.of_counts(counts, prior=1.0)
    rng = np.random.default_rng(0)
    draws = rng.random(60_000)
    for before in range(3):
        after = chain.step(np.zeros(60_000, int), np.full(60_000, before), draws)
        assert np.bincount(after, minlength=3) / 60_000 == pytest.approx(counts[0, before] / 100, abs=0.02)
    # A context without moves goes by all of them.
    assert chain.moves[1] == pytest.approx(np.cumsum((counts[0] + chain_prior(counts)) / 101, axis=1), abs=1e-6)
    assert chain.begin(np.array([0, 1]), np.array([0.0, 1.0])).tolist() == [0, 2]


def chain_prior(counts):
    pooled = counts.sum(axis=0)
    return (pooled.sum(axis=0) + pooled.sum(axis=1)) / (2 * pooled.sum())


def test_gram_is_the_sum_of_products(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, 4))
    rows = frame(spark, [(v.tolist(),) for v in values], "v array<double>")
    assert R.gram_of(rows, 4) == pytest.approx(values.T @ values)
    assert not R.gram_of(rows.limit(0), 4).any()


def test_steps_follow_context_and_other_measures(spark):
    """Long sequences, so that several pieces are joined by their states."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(30):
        side = ("east", "west", None)[k % 3]
        y, mode = np.zeros(2), 0
        for t in range(1200):
            y = np.array([[0.8, 0.0], [0.5, 0.3]]) @ y + rng.normal(size=2)
            mode = mode if rng.random() < (0.9 if side == "east" else 0.3) else int(rng.integers(3))
            rows.append((k, t, side, float(y[0] + 3 * (side == "east")), float(y[1]), [None, "red", "blue"][mode]))
    df = frame(spark, rows, "k long, t long, side string, a double, b double, mode string")
    model = par_fit(df, "k", "t", ["side"], {"k": "id", "t": "numerical", "side": "categorical", "a": "numerical", "b": "numerical", "mode": "categorical"})
    made = stored(model.sample(60, seed=3))
    assert made.columns == df.columns

    def facts(frame):
        pdf = frame.toPandas().sort_values(["k", "t"])
        pdf["mode"] = pdf["mode"].fillna("none")
        last = pdf.groupby("k")[["a", "b", "mode"]].shift(1)
        held = (pdf["mode"] == last["mode"])[last["mode"].notna()]
        east = (pdf.side == "east")[last["mode"].notna()]
        out = {f"{x}{y}": pdf[x].corr(last[y]) for x in "ab" for y in "ab"}
        return out | {"now": pdf.a.corr(pdf.b), "east": held[east].mean() - held[~east].mean(), "held": held[~east].mean(), "none": (pdf["mode"] == "none").mean()}

    want, got = facts(df), facts(made)
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=0.09), name
    lift = {n: f.groupBy("side").agg(F.avg("a").alias("a")).toPandas().set_index("side").a for n, f in (("real", df), ("made", made))}
    assert lift["made"]["east"] - lift["made"]["west"] == pytest.approx(lift["real"]["east"] - lift["real"]["west"], abs=0.6)
    assert made.groupBy("k").agg(F.count_distinct("side").alias("d"), F.count("*").alias("n")).agg(F.max("d"), F.min("n")).first() == (1, 1200)


def test_long_tails_and_context_levels_keep_their_spread(spark):
    """Few values lie far out, and one context lies higher: neither may widen what is made."""
    far = "-30 * ln((pmod(xxhash64(id), 1000000) + 1) / 1000001.0D)"
    df = stored(spark.range(20_000).selectExpr("id % 400 as k", "id div 400 as t", "if(id % 400 < 100, 'hi', 'lo') as side", f"{far} + if(id % 400 < 100, 40, 0) + if(id = 7, 3000, 0) as v"))
    kinds = {"k": "id", "t": "numerical", "side": "categorical", "v": "numerical"}
    made = stored(par_fit(df, "k", "t", ["side"], kinds).sample(2000, seed=1))
    facts = [F.avg("v").alias("mean"), F.percentile_approx("v", 0.99).alias("far"), F.avg(F.when(F.col("side") == "hi", F.col("v"))).alias("hi")]
    want, got = df.agg(*facts, F.stddev("v").alias("spread")).first(), made.agg(*facts, F.stddev("v").alias("spread")).first()
    assert got["spread"] == pytest.approx(want["spread"], rel=0.25)
    for c in ("mean", "far", "hi"):
        assert got[c] == pytest.approx(want[c], rel=0.12)


def test_categories_alone_and_single_steps(spark):
    df = frame(spark, [(k, t, "x" if (k + t) % 2 else "y") for k in range(20) for t in range(1 + k % 4)], "k long, t long, c string")
    made = stored(par_fit(df, "k", "t", sdtypes={"k": "id", "t": "numerical", "c": "categorical"}).sample(200, seed=1))
    steps = made.orderBy("k", "t").toPandas()
    changed = (steps.c != steps.groupby("k").c.shift(1))[steps.groupby("k").cumcount() > 0]
    assert changed.mean() > 0.75 and set(steps.c) == {"x", "y"}
    alone = frame(spark, [(k, 1, float(k), "z") for k in range(5)], "k long, t long, v double, c string")
    assert par_fit(alone, "k", "t", sdtypes={"k": "id", "t": "numerical", "v": "numerical", "c": "categorical"}).sample(7).count() == 7
