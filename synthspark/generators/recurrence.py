"""Recurrences over sequences of any length, as scans over the maps of their blocks.

What a block of steps does to the state it enters with is a map that composes: an affine map for autoregressions, a
table for chains of categories. So blocks are summarised each on their own, summaries are composed in groups of
``FAN``, level by level, and the states go back down. No task sees a whole sequence, and work is linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

# Blocks composed at once.
FAN = 256


@dataclass(frozen=True)
class AffineMaps:
    """Blocks that map a state x to ``matrix`` x + summary."""

    matrix: np.ndarray

    def raised(self, fan: int) -> AffineMaps:
        return AffineMaps(np.linalg.matrix_power(self.matrix, fan))

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return self.matrix @ state + summary

    def composed(self, summaries: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(self.matrix))
        for summary in summaries:
            total = self.after(total, summary)
        return total


@dataclass(frozen=True)
class FiniteMaps:
    """Blocks that map the state of each chain by a table; ``sizes`` are the chains' numbers of states.

    A summary is the chains' tables one after the other.
    """

    sizes: tuple[int, ...]

    def raised(self, fan: int) -> FiniteMaps:
        return self

    def _bases(self) -> np.ndarray:
        return np.cumsum((0, *self.sizes[:-1]))

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return summary[self._bases() + state.astype(np.int64)]

    def composed(self, summaries: list[np.ndarray]) -> np.ndarray:
        bases = np.repeat(self._bases(), self.sizes)
        total = np.concatenate([np.arange(n, dtype=float) for n in self.sizes])
        for summary in summaries:
            total = summary[bases + total.astype(np.int64)]
        return total


def scan(blocks: DataFrame, starts: DataFrame, maps: AffineMaps | FiniteMaps, n_blocks: int, key: str, fan: int = FAN) -> DataFrame:
    """``(key, _b, _state)``: the state each block is entered with.

    ``blocks`` has ``(key, _b, _summary)`` with blocks numbered from 0, at most ``n_blocks`` of a key; ``starts`` has
    ``(key, _state)``. All but the last block of a key are equally long.
    """
    kind = blocks.schema[key].dataType.simpleString()
    chunked = blocks.select(key, "_b", "_summary", F.floor(F.col("_b") / fan).alias("_c"))
    if n_blocks <= fan:
        entering = starts.select(key, F.lit(0).cast("long").alias("_c"), "_state")
    else:

        def compose(group: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("_b")
            total = maps.composed([np.array(s) for s in table.column("_summary").to_pylist()])
            return pa.table({key: table.column(key)[:1], "_b": table.column("_c")[:1], "_summary": pa.array([total], pa.list_(pa.float64()))})

        totals = chunked.groupBy(key, "_c").applyInArrow(compose, f"`{key}` {kind}, _b bigint, _summary array<double>")
        entering = scan(stored(totals, "scan"), starts, maps.raised(fan), -(-n_blocks // fan), key, fan).withColumnRenamed("_b", "_c")

    def walk(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_b")
        state, states = np.array(table.column("_state")[0].as_py()), []
        for summary in table.column("_summary").to_pylist():
            states.append(state)
            state = maps.after(state, np.array(summary))
        return pa.table({key: table.column(key), "_b": table.column("_b"), "_state": pa.array(states, pa.list_(pa.float64()))})

    joined = chunked.join(entering, [key, "_c"])
    return joined.groupBy(key, "_c").applyInArrow(walk, f"`{key}` {kind}, _b bigint, _state array<double>")


# --- vector autoregressions ----------------------------------------------------------------------------------


def companion(weights: np.ndarray) -> np.ndarray:
    """Matrix of the state (last step first) of an autoregression with ``weights`` (lags, d, d)."""
    lags, d, _ = weights.shape
    matrix = np.zeros((lags * d, lags * d))
    matrix[:d] = np.concatenate(list(weights), axis=1)
    matrix[d:, : (lags - 1) * d] = np.eye((lags - 1) * d)
    return matrix


def stabilised(weights: np.ndarray, most: float = 0.999) -> np.ndarray:
    """Weights whose recurrence forgets: lag k is shrunk by a k-th power until no root exceeds ``most``."""
    radius = float(np.abs(np.linalg.eigvals(companion(weights))).max(initial=0.0))
    if radius <= most:
        return weights
    return weights * (most / radius) ** np.arange(1, len(weights) + 1)[:, None, None]


def stationary(matrix: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Covariance P = matrix P matrix' + noise of the state, by doubling the steps summed up."""
    total, power = noise.astype(float), matrix.astype(float)
    for _ in range(64):
        step = power @ total @ power.T
        total = total + step
        power = power @ power
        if np.abs(step).max(initial=0.0) <= 1e-14 * max(1.0, np.abs(total).max(initial=0.0)):
            break
    return (total + total.T) / 2


def root_of(covariance: np.ndarray) -> np.ndarray:
    """A square root of a covariance that may be singular."""
    values, vectors = np.linalg.eigh(covariance)
    return vectors * np.sqrt(np.clip(values, 0.0, None))


def respond(weights: np.ndarray, state: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps ``(rows, steps, d)`` and the last state of rows that enter with ``state`` (rows, lags * d)."""
    lags, d, _ = weights.shape
    steps = noise.shape[1]
    past = state.reshape(len(state), lags, d)[:, ::-1]
    made = np.concatenate([past, np.zeros_like(noise)], axis=1)
    for t in range(steps):
        made[:, lags + t] = noise[:, t] + sum(made[:, lags + t - k - 1] @ weights[k].T for k in range(lags))
    return made[:, lags:], made[:, ::-1][:, :lags].reshape(len(state), lags * d)


# --- sums over blocks of steps -------------------------------------------------------------------------------


def blocks_of(numbered: DataFrame, size: int, reach: int) -> DataFrame:
    """``(k, _block, first, home, values)`` from steps ``(k, _n, s)``: each block with up to ``reach`` steps before it.

    Places ``_n`` count from 1 in each sequence, ``s`` is an array; ``first`` is the place of the first step held and
    ``home`` the first that is the block's own. A block is at most ``size + reach`` steps.
    """
    own = F.floor((F.col("_n") - 1) / size)
    homes = F.array_distinct(F.array(own, F.floor((F.col("_n") - 1 + reach) / size)))
    spread = numbered.select("k", "_n", "s", own.alias("_own"), F.explode(homes).alias("_block"))
    held = F.sort_array(F.collect_list(F.struct("_n", "s")))
    # Steps beyond the end of a sequence would open a block of their own without a step at home.
    grouped = spread.groupBy("k", "_block").agg(held.alias("rows"), F.max("_own").alias("_own")).where("_own = _block")
    return grouped.select("k", "_block", F.col("rows")[0]["_n"].alias("first"), (F.col("_block") * size + 1).alias("home"), F.flatten(F.col("rows.s")).alias("values"))


def summed(blocks: DataFrame, d: int, of: Callable[[np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the numbers ``of(values (steps, d), steps before home, place of home)`` gives.

    How many numbers there are must not hang on the block; they are added up by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for first, home, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = of(values.values.to_numpy().reshape(-1, d), home - first, home)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    parts = blocks.select("first", "home", "values").mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part"))
    return np.array([r["part"] for r in parts.orderBy("at").collect()], float)


def autocorrelations(blocks: DataFrame, d: int, longest: int) -> tuple[np.ndarray, int]:
    """Mean autocorrelation over the columns at lags 0 to ``longest``, and the number of steps."""

    def of(values: np.ndarray, before: int, home: int) -> np.ndarray:
        own = values[before:]
        products, pairs = np.zeros((longest + 1, d)), np.zeros(longest + 1)
        for lag in range(longest + 1):
            start = max(0, lag - before)
            if start < len(own):
                products[lag] = (own[start:] * values[before + start - lag : len(values) - lag]).sum(axis=0)
                pairs[lag] = len(own) - start
        return np.concatenate([products.ravel(), own.sum(axis=0), pairs])

    total = summed(blocks, d, of)
    if not len(total):
        return np.zeros(longest + 1), 0
    products, sums, pairs = total[: (longest + 1) * d].reshape(-1, d), total[(longest + 1) * d : -longest - 1], total[-longest - 1 :]
    means = sums / max(pairs[0], 1.0)
    moments = products / np.maximum(pairs, 1.0)[:, None] - means**2
    spread = np.where(moments[0] > 1e-12, moments[0], np.inf)
    return (moments / spread).mean(axis=1) * (pairs > 0), int(pairs[0])


def season_of(correlations: np.ndarray, steps: int, least: float = 0.1) -> int:
    """The shortest lag at a clear peak of the autocorrelation, 0 if there is none.

    A peak stands above its surroundings by ``least`` and by the noise of that many steps, and reaches nine tenths of
    the highest one, so that a season is preferred to its multiples.
    """
    floor = max(least, 5 / np.sqrt(max(steps, 1)))
    peaks = []
    for lag in range(2, len(correlations) - 1):
        here = correlations[lag]
        if here >= floor and here >= correlations[lag - 1 : lag + 2].max() and here - correlations[1:lag].min() >= floor:
            peaks.append(lag)
    if not peaks:
        return 0
    highest = max(correlations[p] for p in peaks)
    first = next(p for p in peaks if correlations[p] >= 0.9 * highest)
    # Noise may move a flat peak by a step or two, but not all its multiples along with it.
    return max(range(max(2, first - 2), first + 3), key=lambda p: correlations[p::p].mean() if p < len(correlations) else -1.0)


def regress(blocks: DataFrame, d: int, lags: int, season: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (lags, d, d) and residual covariance of a vector autoregression around ``season`` (phases, d)."""
    width = (lags + 1) * d

    def of(values: np.ndarray, before: int, home: int) -> np.ndarray:
        rows = lagged(values, before, home, lags, season)
        return np.append((rows.T @ rows).ravel(), len(rows))

    total = summed(blocks, d, of)
    if not len(total) or total[-1] == 0:
        return np.zeros((lags, d, d)), np.eye(d)
    gram = total[:-1].reshape(width, width)
    past, cross = gram[d:, d:], gram[d:, :d]
    weights = np.linalg.solve(past + 1e-9 * total[-1] * np.eye(len(past)), cross)
    covariance = (gram[:d, :d] - cross.T @ weights - weights.T @ cross + weights.T @ past @ weights) / total[-1]
    return weights.T.reshape(d, lags, d).transpose(1, 0, 2), (covariance + covariance.T) / 2


def lagged(values: np.ndarray, before: int, home: int, lags: int, season: np.ndarray) -> np.ndarray:
    """Rows (step, last step, …) of the own steps that have all their lags, with the season taken off."""
    first = home - before
    around = values - season[(np.arange(len(values)) + first - 1) % len(season)]
    start = max(before, lags)
    if start >= len(values):
        return np.zeros((0, (lags + 1) * values.shape[1]))
    return np.concatenate([around[start - k : len(values) - k] for k in range(lags + 1)], axis=1)


def gram_of(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of v v' over the arrays ``v`` of ``width`` numbers, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(-1, width)
            total += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "part"])

    parts = rows.select("v").mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    total = np.zeros(width * width)
    for r in parts:
        total[r["at"]] = r["part"]
    return total.reshape(width, width)


# --- chains of categories ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """A Markov chain per context: cumulative first shares (contexts, states) and moves (contexts, states, states)."""

    first: np.ndarray
    moves: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, prior: float = 5.0) -> Chain:
        """From counts (contexts, before, after); a context with few moves leans on all of them."""
        pooled = counts.sum(axis=0)
        shares = (pooled.sum(axis=0) + pooled.sum(axis=1) + 1e-9) / (2 * pooled.sum() + 1e-9 * len(pooled))
        usual = (pooled + prior * shares) / (pooled.sum(axis=1, keepdims=True) + prior)
        moves = (counts + prior * usual) / (counts.sum(axis=2, keepdims=True) + prior)
        first = (counts.sum(axis=2) + prior * shares) / (counts.sum(axis=(1, 2))[:, None] + prior)
        return cls(np.cumsum(first, axis=1), np.cumsum(moves, axis=2))

    @property
    def states(self) -> int:
        return self.first.shape[1]

    def begin(self, context: np.ndarray, draw: np.ndarray) -> np.ndarray:
        return np.minimum((self.first[context] < draw[..., None]).sum(axis=-1), self.states - 1)

    def step(self, context: np.ndarray, state: np.ndarray, draw: np.ndarray) -> np.ndarray:
        return np.minimum((self.moves[context, state] < draw[..., None]).sum(axis=-1), self.states - 1)
