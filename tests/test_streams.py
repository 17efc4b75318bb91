"""Stateful and merged streams against their batch forms."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthspark.generators.copula import copula_fit
from synthspark.operators.history import invalid_transitions
from synthspark.streaming.copula import stream_fit_copula
from synthspark.streaming.transitions import Moves, _allowed, stream_transitions
from tests.conftest import rows

EVENTS = "event_id long, job_id string, status string, ts timestamp"


def _appended(spark, folder, events):
    frame = spark.createDataFrame(events, "event_id long, job_id string, status string, s long")
    frame.select("event_id", "job_id", "status", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_transitions_late_and_repeated_across_restarts(spark, tmp_path):
    rng = random.Random(7)
    states = ["queued", "training", "generating", "validating", "complete", "failed"]
    # Pairs of events share a second, so that ties go by id.
    events = [(i, f"j{rng.randrange(12)}", rng.choice(states), 1_700_000_000 + i // 2 * 60) for i in range(600)]
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, 600, 100):
        part = events[at : at + 100] + rng.sample(events[max(0, at - 10) : at + 100], 10)
        rng.shuffle(part)
        _appended(spark, folder, part)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        stream_transitions(stream, root, "1 hour")
    # Far behind the watermark: left out. Far ahead, of no job: lets the watermark pass all others.
    _appended(spark, folder, [(9000, "j0", "queued", 1_600_000_000)])
    _appended(spark, folder, [(None, None, None, 1_800_000_000)])
    got = stream_transitions(spark.readStream.schema(EVENTS).parquet(folder), root, "1 hour")
    whole = spark.createDataFrame(events, "event_id long, job_id string, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(got) == rows(invalid_transitions(whole))


class Kept:
    """State of one job in memory, which counts the calls that it gets."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, *schemas):  # noqa: N802
        return Cell(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.discard(ms)


class Cell:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def _do(self, call, key, *value):
        self.kept.calls += 1
        return getattr(self.kept.values, call)((self.name, key), *value)

    def exists(self):
        return self._do("get", None) is not None

    def get(self):
        return self._do("get", None)

    def update(self, value):
        self._do("__setitem__", None, value)

    def clear(self):
        self._do("pop", None, None)

    def containsKey(self, key):  # noqa: N802
        return self._do("get", key) is not None

    def getValue(self, key):  # noqa: N802
        return self._do("get", key)

    def updateValue(self, key, value):  # noqa: N802
        self._do("__setitem__", key, value)

    def removeKey(self, key):  # noqa: N802
        self._do("pop", key, None)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def _played(batches, idle_ms=None):
    """Moves of one job: ``batches`` are (watermark, events of id, status, microsecond)."""
    kept, moves, out = Kept(), Moves(idle_ms), []
    moves.init(kept)
    for watermark, events in batches:
        frame = pd.DataFrame(events, columns=["event_id", "status", "at"])
        for made in moves.handleInputRows(("j",), iter([frame]), At(watermark)):
            out += made.values.tolist()
        for ms in sorted(t for t in kept.timers if t <= watermark):
            for made in moves.handleExpiredTimer(("j",), At(watermark), At(ms)):
                out += made.values.tolist()
            kept.timers.discard(ms)
    return out, kept


def _plain(events, idle_ms=None):
    out, before, last = [], None, None
    for at, number, after in sorted({(at, number, status) for number, status, at in events}):
        if idle_ms is not None and last is not None and at // 1000 - last // 1000 > idle_ms:
            before = None
        if not _allowed(before, after):
            out.append([number, "j", before, after])
        before, last = after, at
    return out


def test_state_is_called_by_batch_and_not_by_event():
    states = ["queued", "training", "generating", "validating", "complete", "failed"]
    events = [(i, states[i % 5], (5_000 + i) * 1000) for i in range(3000)]
    out, kept = _played([(0, events), (2_500, []), (10_000, [])])
    assert out == _plain(events) and kept.calls < 30


@pytest.mark.parametrize("idle_ms", [None, 40])
def test_waiting_pieces_pass_in_order(monkeypatch, idle_ms):
    """Late and repeated events in pieces that overlap, with watermarks that cut them anywhere."""
    monkeypatch.setattr("synthspark.streaming.transitions.PIECE", 7)
    rng = random.Random(11)
    states = ["queued", "training", "generating", "validating", "complete", "failed"]
    events = [(i, rng.choice(states), 1_000_000 + rng.randrange(0, 4_000) * 500) for i in range(300)]
    by_time = sorted(events, key=lambda e: e[2])
    batches = []
    for at in range(0, 300, 20):
        part = by_time[at : at + 20] + rng.sample(by_time[max(0, at - 8) : at + 20], 6)
        rng.shuffle(part)
        batches.append((by_time[max(0, at - 8)][2] // 1000, part))
    out, kept = _played([*batches, (10**9, [])], idle_ms)
    assert out == _plain(events, idle_ms)
    # A job that is forgotten leaves nothing behind.
    assert not kept.timers or idle_ms and not any(v for v in kept.values.values())


def test_copula_of_a_stream_that_drifts(spark, tmp_path):
    """Each file has values of its own range, so no batch knows the whole distribution."""
    df = spark.range(6000).selectExpr(
        "id", "id div 1000 * 10 + (hash(id) % 1000) / 100.0D as x", "case when id % 50 = 0 then null else (id div 1000 * 10 + (hash(id) % 1000) / 100.0D) * -2 + (hash(id, 5) % 1000) / 100.0D end as y",
        "case when id < 2400 then 'low' when id < 5000 then 'mid' else 'high' end as g",
        # Goes with the part of x that does not drift: seen inside a batch only.
        "(hash(id) % 1000) / 100.0D + (hash(id, 9) % 1000) / 200.0D as z",
    )
    folder = str(tmp_path / "in")
    for at in range(0, 6000, 1000):
        df.where(f"id between {at} and {at + 999}").drop("id").coalesce(1).write.mode("append").parquet(folder)
    kinds = {"x": "numerical", "y": "numerical", "g": "categorical", "z": "numerical"}
    schema = df.drop("id").schema
    root = str(tmp_path / "out")
    model = stream_fit_copula(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), kinds, root)
    batch = copula_fit(df.drop("id"), kinds, "empirical")
    assert abs(model.correlation - batch.correlation).max() < 0.03
    assert batch.correlation[0, 3] > 0.2
    for got, want in zip(model.marginals, batch.marginals):
        assert (got.kind, got.categories, got.low, got.high, got.decimals) == (want.kind, want.categories, want.low, want.high, want.decimals)
        assert got.null_share == pytest.approx(want.null_share) and got.shares == pytest.approx(want.shares)
    ranks = df.agg(*[F.avg((F.col("x") <= model.marginals[0].grid[q]).cast("int")).alias(f"q{q}") for q in (8, 32, 56)]).first()
    assert all(abs(ranks[f"q{q}"] - q / 64) < 0.01 for q in (8, 32, 56))
    assert model.sample(100).count() == 100
    # Called again without new files: a model from what was kept. Sketches merge with random bits, so only ranks are near.
    again = stream_fit_copula(spark.readStream.schema(schema).parquet(folder), kinds, root)
    assert again.marginals[2] == model.marginals[2] and abs(again.correlation - model.correlation).max() < 0.01
    for a, b in zip(again.marginals[:2], model.marginals[:2]):
        assert (a.low, a.high, a.decimals, a.null_share) == (b.low, b.high, b.decimals, b.null_share)
        assert max(abs(p - q) for p, q in zip(a.grid, b.grid)) < 0.03 * (a.high - a.low)
    with pytest.raises(ValueError):
        stream_fit_copula(spark.readStream.schema(schema).parquet(folder), {"x": "numerical"}, root)
