"""Inputs beyond former limits: repeated and null keys, several parent keys, tiny numbers, long and slow sequences."""

import csv
import glob
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from synthspark.functions.rng import md5_index
from synthspark.generators import linked
from synthspark.generators.copula import copula_fit
from synthspark.generators.private import gaussian_scale
from synthspark.generators.sequence import long_sequence_fit, par_fit
from synthspark.session import stored
from synthspark.sources import writers
from synthspark.spec import Relationship
from synthspark.streaming import jobs as J


def test_index_export_keeps_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (None, "e")], "k int, v string").repartition(3)
    writers.export_csv(df, str(tmp_path / "out"), include_index=True, index_key="k")
    made = [r for f in glob.glob(f"{tmp_path}/out/part*") for r in list(csv.reader(open(f)))[1:]]
    assert sorted(r[2] for r in made) == list("abcde") and sorted(int(r[0]) for r in made) == list(range(5))
    assert {int(r[0]) for r in made if r[1] == ""} == {3, 4}
    ones = sorted(int(r[0]) for r in made if r[1] == "1")
    assert ones[1] == ones[0] + 1


def test_two_parent_keys(spark):
    parent = spark.range(200).select(F.col("id").alias("a"), F.concat(F.lit("p"), F.col("id")).alias("b"), (F.col("id") % 7).cast("double").alias("x"))
    one = spark.range(500).select((F.col("id") % 200).alias("a"), F.rand(1).alias("y"))
    two = spark.range(500).select(F.concat(F.lit("p"), F.col("id") % 200).alias("pb"), F.rand(2).alias("z"))
    links = [Relationship("parent", "a", "one", "a", "1:N"), Relationship("parent", "b", "two", "pb", "1:N")]
    model = linked.hma_fit({"parent": parent, "one": one, "two": two}, links)
    made = model.sample({"parent": 200, "one": 500, "two": 500})
    for rel in links:
        keys = made["parent"].select(F.col(rel.parent_key).alias("k")).distinct()
        assert keys.count() == 200
        assert made[rel.child_table].join(keys, F.col(rel.child_key) == F.col("k"), "left_anti").count() == 0


def test_gaussian_scale_meets_its_promise():
    tail = lambda x: math.erfc(x / math.sqrt(2)) / 2
    for epsilon in (0.01, 0.5, 1.0, 5.0, 20.0, 100.0):
        for delta in (1e-3, 1e-6, 1e-9):
            s = gaussian_scale(epsilon, delta)
            lost = lambda s: tail(epsilon * s - 1 / (2 * s)) - math.exp(epsilon) * tail(epsilon * s + 1 / (2 * s))  # noqa: B023, E731
            assert lost(s) <= delta * 1.0001 and lost(s * 0.99) > delta
    # The usual formula promises too much above epsilon 1.
    assert gaussian_scale(20.0, 1e-6) > math.sqrt(2 * math.log(1.25e6)) / 20


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e25])
def test_stream_moments_at_any_scale(spark, scale):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000) * scale + 3 * scale
    y = x * 0.5 + rng.normal(size=3000) * scale
    df = spark.createDataFrame([(int(k % 5), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    parts = df.groupBy("g").agg(*J.moment_columns(["x", "y"])).drop("g")
    merged = J.merge_moments(parts, ["x", "y"]).cache()
    got = {r["column"]: r for r in J.moments_summary(merged, ["x", "y"]).collect()}
    assert got["x"]["mean"] == pytest.approx(x.mean()) and got["x"]["std"] == pytest.approx(x.std(ddof=1))
    assert J.moments_correlation(merged, ["x", "y"])[0, 1] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_long_sequences_are_read_whole(spark):
    # The second half behaves differently from the first, which a prefix would not show.
    rng = np.random.default_rng(0)
    rows = []
    for key in range(3):
        y = 0.0
        for t in range(3000):
            y = (0.0 if t < 500 else 0.9) * y + rng.normal()
            rows.append((key, t, float(y)))
    df = spark.createDataFrame(rows, "k long, t long, v double")
    model = long_sequence_fit(df, "k", "t", "v", segment_size=25, lags=(1,))
    assert model.length == 3000 and model.weights[0, 0, 0] > 0.8
    assert model.sample(2, 700).groupBy("k").count().agg(F.min("count")).first()[0] == 700


def test_slow_sequences_have_full_spread_everywhere(spark):
    """Steps of later pieces follow from the state carried to them: as spread as the first, and close to the step before."""
    rng = np.random.default_rng(4)
    rows = []
    for key in range(6):
        y = rng.normal() * 3
        for t in range(1100):
            y = 0.98 * y + rng.normal() * 0.6
            rows.append((key, t, float(y)))
    df = spark.createDataFrame(rows, "k long, t long, v double")
    model = par_fit(df, "k", "t", sdtypes={"k": "id", "t": "numerical", "v": "numerical"})
    made = stored(model.sample(400, seed=2)).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    wide = made.where("n IN (1, 500, 501, 1001)").groupBy("k").pivot("n", [1, 500, 501, 1001]).agg(F.first("v")).toPandas()
    spread = wide[["1", "500", "501", "1001"]].std()
    assert spread.max() < 1.25 * spread.min()
    assert wide["500"].corr(wide["501"]) > 0.9 and abs(wide["1"].corr(wide["1001"])) < 0.25


def test_picks_reach_beyond_32_bits(spark):
    size = 1 << 40
    picks = [r[0] for r in spark.range(200).select(md5_index(F.col("id"), "x", size)).collect()]
    assert max(picks) > 1 << 38 and min(picks) >= 0 and len(set(picks)) == 200


def test_long_categories_stay_in_the_joint_model(spark):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 200, size=8000)
    data = [(f"c{k:03d}", float(k) + float(rng.normal()), float(rng.normal())) for k in codes]
    df = spark.createDataFrame(data, "g string, x double, y double")
    model = copula_fit(df, {"g": "categorical", "x": "numerical", "y": "numerical"}, "empirical")
    assert model.marginals[0].table is not None
    short = copula_fit(df.filter("g < 'c090'"), {"g": "categorical", "x": "numerical", "y": "numerical"}, "empirical")
    assert short.marginals[0].table is None

    def dependence(frame):
        pdf = frame.toPandas()
        return abs(np.corrcoef(pdf.groupby("g").x.transform("mean"), pdf.x)[0, 1])

    made = stored(model.sample(8000))
    assert made.count() == 8000 and made.select("g").distinct().count() > 190
    # Categories lie in the order of their counts; what dependence that order carries is kept, as in short lists.
    assert abs(model.correlation[0, 1]) == pytest.approx(abs(short.correlation[0, 1]), abs=0.15)
    held = stored(model.sample(300, {"g": "c007"}))
    assert {r[0] for r in held.select("g").distinct().collect()} == {"c007"}
    with pytest.raises(ValueError, match="never seen"):
        model.sample(5, {"g": "none"})
    # With counts that fall along the number, the order is that of the number.
    ordered = [(f"c{k:03d}", float(k)) for k in range(200) for _ in range(60 - k // 4)]
    frame = spark.createDataFrame(ordered, "g string, x double")
    fit = copula_fit(frame, {"g": "categorical", "x": "numerical"}, "empirical")
    assert dependence(stored(fit.sample(6000))) > 0.9
