"""Sequence generators: static context per sequence, autoregressive steps.

Fitting needs the previous row of a sequence; it is found inside time chunks, so a sequence that holds most
of the rows is many tasks. Sampling is free of windows: draws are a function of sequence and piece, and the state a
piece is entered with comes from a scan over the maps of the pieces before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.functions import columns as C
from synthspark.functions.rng import md5_index, normal_cdf, uniform
from synthspark.generators.copula import ROW, CopulaModel, copula_fit
from synthspark.generators.marginals import KNOTS, Marginal, fit_marginals, normal_scores
from synthspark.generators.recurrence import (
    AffineMaps,
    Chain,
    FiniteMaps,
    autocorrelations,
    blocks_of,
    companion,
    gram_of,
    lagged,
    regress,
    respond,
    root_of,
    scan,
    season_of,
    stabilised,
    stationary,
)
from synthspark.operators.constraints import indexed_keys
from synthspark.operators.history import previous
from synthspark.operators.profile import sdtypes as detect
from synthspark.session import stored

# Steps of a sequence made in one piece.
PIECE = 500
# Context categories told apart by the chains.
BUCKETS = 32
# Steps per time chunk aimed at when sequences are numbered.
CHUNK_STEPS = 1_000_000
# Steps a task makes.
PART_STEPS = 100_000


def _check(df: DataFrame, key: str | None, index: str | None) -> None:
    if not key or not index:
        raise ValueError("sequence generation needs a sequence key and a sequence index")
    for c in (key, index):
        if c not in df.columns:
            raise ValueError(f"column '{c}' is missing from the table")


def _index_number(df: DataFrame, index: str) -> Column:
    return C.as_double(df, index)


def _chunk(df: DataFrame, index: str, parts: int = 64) -> Column:
    """Time chunk of a row from the range of the index."""
    x = _index_number(df, index)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    span = (row["hi"] - row["lo"]) or 1.0
    return F.least(F.lit(parts - 1), F.floor((x - row["lo"]) / span * parts))


def _featured(df: DataFrame, marginals: list[Marginal]) -> DataFrame:
    """Input with what steps know of their context: ``_x``, a constant with scores and category marks, and ``_bucket``."""
    scored = [m for m in marginals if m.kind == "number" or m.table is not None]
    listed = [m for m in marginals if m.kind == "category" and m.table is None]
    made = df
    if scored:
        made = normal_scores(df, scored, [C.quoted(c) for c in df.columns])
        made = made.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(f"s{i}").alias(f"_s{i}") for i in range(len(scored))])
    marks = [C.as_text(made, m.name) == c for m in listed for c in m.categories[1:]]
    marks += [C.quoted(m.name).isNull() for m in marginals if m.null_share > 0]
    known = [*[F.col(f"_s{i}") for i in range(len(scored))], *[m.cast("double") for m in marks]]
    x = F.array(F.lit(1.0), *[F.coalesce(c, F.lit(0.0)) for c in known])
    bucket = F.lit(0)
    if listed:
        places = F.array(*[F.lit(c) for c in listed[0].categories[:BUCKETS]])
        bucket = F.coalesce(F.array_position(places, C.as_text(made, listed[0].name)), F.lit(0)).cast("int")
    return made.select(*[C.quoted(c) for c in df.columns], x.alias("_x"), bucket.alias("_bucket"))


def _width(marginals: list[Marginal]) -> int:
    return 1 + sum((len(m.categories) - 1 if m.kind == "category" and m.table is None else 1) + (m.null_share > 0) for m in marginals)


@dataclass
class SequenceModel:
    """Context copula (with length and start), gap grid, and what drives the steps.

    Scores of the measures ``vector`` follow a vector autoregression around a level set by the context, the categories
    ``chained`` follow Markov chains of the context. Scores become ranks by the distribution that they have over all
    contexts, so that the values are spread like the real ones.
    """

    spark: SparkSession
    key: str
    key_type: T.DataType
    index: str
    index_type: T.DataType
    context: CopulaModel
    gaps: tuple[float, ...]
    vector: list[Marginal]
    # Autoregression (d, d), effect of the context (d, features), residual covariance (d, d).
    carry: np.ndarray
    effect: np.ndarray
    covariance: np.ndarray
    # Levels of the measures over the steps' contexts (d, KNOTS), ascending, each for an equal share of the steps.
    levels: np.ndarray
    chained: list[Marginal]
    chains: list[Chain]
    columns: list[str]

    @property
    def static(self) -> list[Marginal]:
        return [m for m in self.context.marginals if m.name not in ("__length", "__start")]

    def sample(self, sequences: int, seed: int = 0, max_len: int | None = None) -> DataFrame:
        """Rows of ``sequences`` new sequences, ordered by the index within each."""
        base = self.spark.range(0, sequences).withColumnRenamed("id", ROW)
        context = self.context.decode(self.context.latent(base, None, seed), None, seed, keep=[ROW])
        length = F.greatest(F.lit(1), F.round("__length").cast("int"))
        if max_len is not None:
            length = F.least(F.lit(max_len), length)
        context = stored(_featured(context.withColumn("__length", length), self.static), "contexts")
        rows = self._steps(context, seed)
        out = {self.key: self._key_value(), self.index: self._index_value(seed)}
        for m in self.static:
            out[m.name] = C.quoted(m.name)
        for i, m in enumerate(self.vector):
            value = m.value(F.col(f"_p{i}"))
            if m.null_share > 0:
                value = F.when(uniform(self._cell(), f"n:{m.name}", seed) >= m.null_share, value)
            out[m.name] = value
        for j, m in enumerate(self.chained):
            out[m.name] = F.when(F.col(f"_q{j}").isNotNull(), m.value(F.col(f"_q{j}")))
        return rows.select(*[out[c].alias(c) for c in self.columns])

    @staticmethod
    def _cell() -> Column:
        return F.xxhash64(ROW, "_t")

    def _key_value(self) -> Column:
        if C.is_numeric(self.key_type):
            return (F.col(ROW) + 1).cast(self.key_type)
        return F.concat(F.lit(f"{self.key}-"), F.lpad((F.col(ROW) + 1).cast("string"), 12, "0"))

    def _index_value(self, seed: int) -> Column:
        """Start plus evenly paced gaps with a bounded shift, which keeps the order without a running sum."""
        pace = F.get(C.doubles(self.gaps), F.floor(uniform(F.col(ROW), "pace", seed) * len(self.gaps)).cast("int"))
        x = F.col("__start") + pace * (F.col("_t") + 0.9 * uniform(self._cell(), "shift", seed))
        if C.is_datetime(self.index_type):
            stamp = F.timestamp_micros(F.floor(x * 1e6))
            return stamp.cast("timestamp_ntz").cast(self.index_type) if isinstance(self.index_type, T.TimestampNTZType) else stamp.cast(self.index_type)
        return x.cast(self.index_type)

    def _steps(self, context: DataFrame, seed: int) -> DataFrame:
        """One row per step: the context with ``_t``, ranks ``_p{i}`` of scores and middles of category intervals ``_q{j}``.

        A piece of a sequence is made from the state that the pieces before it lead to; its draws hang on the sequence
        and the piece alone.
        """
        d, chains, widest = len(self.vector), self.chains, PIECE
        weights, level = self.carry[None], np.linalg.solve(np.eye(d) - self.carry, self.effect)
        shock = root_of(self.covariance)
        around_level = stationary(self.carry, self.covariance)
        start = root_of(around_level)
        ranks = [ranks_of(self.levels[i], math.sqrt(max(around_level[i, i], 0.0))) for i in range(d)]
        middles = []
        for m, chain in zip(self.chained, chains):
            edges = np.array([0.0, *m.shares])
            middles.append(np.append((edges[1:] + edges[:-1]) / 2, [np.nan] * (chain.states - len(m.categories))))
        sizes = tuple(c.states for c in chains)
        pieces = steps_of(context, "__length")
        kept = pieces.columns

        def draws(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """Shocks (rows, steps, d), nothing behind a piece's end, and unit draws (rows, steps, chains)."""
            steps = (batch.column("_end").to_numpy() - batch.column("_start").to_numpy() + 1).tolist()
            noise, units = np.zeros((len(steps), max(steps), d)), np.ones((len(steps), max(steps), len(chains)))
            for k, (row, piece, n) in enumerate(zip(batch.column(ROW).to_pylist(), batch.column("_g").to_pylist(), steps)):
                made = np.random.Generator(np.random.Philox(key=[seed & (1 << 63) - 1, row], counter=[0, 0, 0, piece + 1]))
                noise[k, :n] = made.standard_normal((n, d)) @ shock.T
                units[k, :n] = made.random((n, len(chains)))
            return noise, units

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    yield batch.slice(at, 1_000)

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, states = [], []
                for row, bucket in zip(batch.column(ROW).to_pylist(), batch.column("_bucket").to_pylist()):
                    made = np.random.Generator(np.random.Philox(key=[seed & (1 << 63) - 1, row]))
                    vectors.append(start @ made.standard_normal(d))
                    units = made.random(len(chains))
                    states.append([float(c.begin(np.array(bucket), units[j])) for j, c in enumerate(chains)])
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(vectors, kind), pa.array(states, kind)], [ROW, "_vector", "_states"])

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                noise, units = draws(batch)
                _, last = respond(weights, np.zeros((batch.num_rows, d)), noise)
                bucket = batch.column("_bucket").to_numpy()[:, None]
                tables = []
                for j, chain in enumerate(chains):
                    table = np.tile(np.arange(chain.states), (batch.num_rows, 1))
                    for t in range(noise.shape[1]):
                        table = chain.step(bucket, table, units[:, t, j][:, None])
                    tables.append(table.astype(float))
                whole = np.concatenate(tables, axis=1) if tables else np.zeros((batch.num_rows, 0))
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("_g"), pa.array(list(last), kind), pa.array(list(whole), kind)], [ROW, "_b", "_affine", "_finite"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                noise, units = draws(batch)
                count = batch.num_rows
                features = batch.column("_x").flatten().to_numpy().reshape(count, -1)
                state = batch.column("_vector").flatten().to_numpy().reshape(count, d)
                around, _ = respond(weights, state, noise)
                scores = around + (features @ level.T)[:, None]
                steps = batch.column("_end").to_numpy() - batch.column("_start").to_numpy() + 1
                inside = np.arange(noise.shape[1]) < steps[:, None]
                owner, at = np.nonzero(inside)
                made = [pa.array(np.interp(scores[inside][:, i], *ranks[i])) for i in range(d)]
                bucket, states = batch.column("_bucket").to_numpy(), batch.column("_states").flatten().to_numpy().reshape(count, len(chains)).astype(np.int64)
                for j, chain in enumerate(chains):
                    current, path = states[:, j], np.zeros(inside.shape, np.int64)
                    for t in range(noise.shape[1]):
                        current = chain.step(bucket, current, units[:, t, j])
                        path[:, t] = current
                    made.append(pa.array(middles[j][path[inside]], from_pandas=True))
                places = pa.array(owner)
                held = [batch.column(c).take(places) for c in kept]
                yield pa.RecordBatch.from_arrays([*held, pa.array(at + batch.column("_start").to_numpy()[owner]), *made], names)

        names = [*kept, "_t", *[f"_p{i}" for i in range(d)], *[f"_q{j}" for j in range(len(chains))]]
        starts = context.mapInArrow(begin, f"`{ROW}` bigint, _vector array<double>, _states array<double>")
        longest = context.agg(F.max("__length")).first()[0] or 1
        n_pieces = -(-int(longest) // widest)
        if n_pieces == 1:
            entering = starts.withColumn("_g", F.lit(0).cast("long"))
        else:
            summaries = stored(pieces.mapInArrow(summarise, f"`{ROW}` bigint, _b bigint, _affine array<double>, _finite array<double>"), "pieces")
            entering = None
            for name, state, maps in (("_affine", "_vector", AffineMaps(np.linalg.matrix_power(self.carry, widest))), ("_finite", "_states", FiniteMaps(sizes))):
                if (d if name == "_affine" else len(sizes)) == 0:
                    found = summaries.select(ROW, F.col("_b").alias("_g"), F.array().cast("array<double>").alias(state))
                else:
                    found = scan(summaries.select(ROW, "_b", F.col(name).alias("_summary")), starts.select(ROW, F.col(state).alias("_state")), maps, n_pieces, ROW)
                    found = found.select(ROW, F.col("_b").alias("_g"), F.col("_state").alias(state))
                entering = found if entering is None else entering.join(found, [ROW, "_g"])
        joined = pieces.join(entering, [ROW, "_g"])
        double = T.DoubleType()
        fields = [*[pieces.schema[c] for c in kept], T.StructField("_t", T.LongType()), *[T.StructField(n, double) for n in names[len(kept) + 1 :]]]
        return joined.mapInArrow(walk, T.StructType(fields))


def ranks_of(levels: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores and their ranks, 0 to 1, in an equal mixture of normal distributions around ``levels``."""
    middles, shares = np.unique(levels, return_counts=True)
    spread = max(spread, 1e-6)
    scores = np.unique(np.add.outer(middles, spread * np.linspace(-6, 6, 97)))
    below = np.frompyfunc(lambda x: math.erfc(-x / math.sqrt(2)) / 2, 1, 1)
    return scores, below((scores[:, None] - middles) / spread).astype(float) @ (shares / shares.sum())


def steps_of(sequences: DataFrame, length: str) -> DataFrame:
    """One row per piece ``_g`` of a sequence with its first and last step."""
    last = F.floor((F.col(length) - 1) / PIECE)
    pieces = sequences.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_g"))
    start = F.col("_g") * PIECE
    return pieces.select(
        *[C.quoted(c) for c in pieces.columns], start.alias("_start"), (F.least(start + PIECE, F.col(length)) - 1).cast("long").alias("_end")
    )


def par_fit(
    df: DataFrame, key: str, index: str, context: list[str] | None = None, sdtypes: dict[str, str] | None = None
) -> SequenceModel:
    """Fit lengths, context, gaps, a pooled vector autoregression of normal scores and chains of categories.

    Category lists of up to 100 values are chains, per value of the first such context column (32 at most tell contexts
    apart there); longer ones take part in the autoregression by their scores. A missing number counts as its median, a
    missing category is a state of its own.
    """
    _check(df, key, index)
    context = context or []
    measures = [c for c in df.columns if c not in (key, index, *context)]
    kinds = sdtypes or detect(df)
    x = _index_number(df, index)
    per_key = df.groupBy(C.quoted(key)).agg(
        F.count("*").cast("double").alias("__length"),
        F.min(x).alias("__start"),
        *[F.min_by(C.quoted(c), x).alias(c) for c in context],
    )
    per_key = stored(per_key.withColumnRenamed(key, "__key"), "contexts")
    static_kinds = {"__length": "numerical", "__start": "numerical", **{c: kinds[c] for c in context}}
    context_model = copula_fit(per_key.drop("__key"), static_kinds, "empirical")
    static = [m for m in context_model.marginals if m.name not in ("__length", "__start")]
    fitted = fit_marginals(df.select(*[C.quoted(c) for c in measures]), {c: kinds[c] for c in measures}, "empirical", tails=True)
    if any(not m.modelled for m in fitted):
        raise ValueError(f"columns {[m.name for m in fitted if not m.modelled]} cannot follow an autoregression")
    chained = [m for m in fitted if m.kind == "category" and m.table is None]
    vector = [m for m in fitted if m not in chained]
    d = len(vector)
    texts = [C.as_text(df, m.name) for m in chained]
    scores = normal_scores(df, vector, [C.quoted(key), x, _chunk(df, index), *texts])
    now = F.struct(
        F.col("_keep1").alias("x"),
        F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(d)]).cast("array<double>").alias("s"),
        *[F.col(f"_keep{3 + j}").alias(f"c{j}") for j in range(len(chained))],
    )
    named = scores.select(F.col("_keep0").alias("k"), F.col("_keep1").alias("x"), F.col("_keep2").alias("c"), now.alias("now"))
    lagged_rows = previous(named.withColumn("tie", F.xxhash64("now")), "k", ["x", "tie"], "now", F.col("c"), "before").filter("before is not null")
    features = _featured(per_key.select("__key", *[C.quoted(c) for c in context]), static).select(F.col("__key").alias("k"), "_x", "_bucket")
    moves = stored(lagged_rows.join(features, "k").select("now", "before", "_x", "_bucket"), "moves")
    gaps = moves.agg(F.percentile_approx(F.col("now.x") - F.col("before.x"), C.doubles(i / KNOTS for i in range(1, KNOTS)), 10_000).alias("gaps")).first()["gaps"]

    width = _width(static)
    gram = gram_of(moves.select(F.concat("_x", "before.s", "now.s").alias("v")), width + 2 * d)
    past, cross = gram[: width + d, : width + d], gram[: width + d, width + d :]
    steps = max(float(gram[0, 0]), 1.0)
    # Scores have a spread of one, so a ridge of one step in a thousand only matters where nothing is known.
    solved = np.linalg.solve(past + (1e-3 + 1e-9 * steps) * np.eye(len(past)), cross)
    covariance = (gram[width + d :, width + d :] - cross.T @ solved - solved.T @ cross + solved.T @ past @ solved) / steps
    if gram[0, 0] == 0:
        covariance = np.eye(d)
    carry = stabilised(solved[width:].T[None])[0] if d else np.zeros((0, 0))
    levels = np.zeros((d, KNOTS))
    if d and gram[0, 0] > 0:
        # The levels that the contexts of the steps lead to, as middles of equal shares.
        weights = np.linalg.solve(np.eye(d) - carry, solved[:width].T)
        shares = C.doubles((k + 0.5) / KNOTS for k in range(KNOTS))
        level = [F.aggregate(F.zip_with("_x", C.doubles(w), lambda x, v: x * v), F.lit(0.0), lambda a, b: a + b) for w in weights.tolist()]
        row = moves.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"l{i}") for i, c in enumerate(level)]).first()
        levels = np.array([row[f"l{i}"] for i in range(d)])

    chains = []
    for j, m in enumerate(chained):
        states = len(m.categories) + (m.null_share > 0)
        places = F.array(*[F.lit(c) for c in m.categories])
        state = lambda c: F.coalesce(F.array_position(places, c), F.lit(states)).cast("int") - 1
        counts = np.zeros((BUCKETS + 1, states, states))
        grouped = moves.groupBy("_bucket", state(F.col(f"before.c{j}")).alias("a"), state(F.col(f"now.c{j}")).alias("b")).agg(F.count("*").alias("n"))
        # At most contexts times states times states rows.
        for r in grouped.collect():
            counts[r["_bucket"], r["a"], r["b"]] = r["n"]
        if not counts.any():
            counts[0] += np.diff([0.0, *m.shares, *([1.0] * (states - len(m.categories)))])[None, :]
        chains.append(Chain.of_counts(counts))
    return SequenceModel(
        df.sparkSession, key, df.schema[key].dataType, index, df.schema[index].dataType, context_model, tuple(float(g) for g in (gaps or [1.0])), vector,
        carry, solved[:width].T, (covariance + covariance.T) / 2, levels, chained, chains, df.columns,
    )


def par_synth(
    df: DataFrame, key: str, index: str, sequences: int, context: list[str] | None = None, seed: int = 0
) -> DataFrame:
    return par_fit(df, key, index, context).sample(sequences, seed)


# --- long sequences ----------------------------------------------------------------------------------------


@dataclass
class LongSequenceModel:
    """A season, a vector autoregression around it and a table of residual blocks."""

    spark: SparkSession
    key: str
    index: str
    measures: list[Marginal]
    # Mean scores per phase (one phase without a season).
    season: np.ndarray
    weights: np.ndarray
    covariance: np.ndarray
    # Residual blocks ``(_phase, _index, residuals)`` and how many there are per phase of their first step.
    blocks: DataFrame
    n_blocks: dict[int, int]
    segment: int
    length: int

    def sample(self, sequences: int, length: int | None = None, seed: int = 0) -> DataFrame:
        """``(key, index, measures)``: steps are numbered from 0; residuals come in whole blocks.

        A segment takes a block that started in its own phase of the season, or in the nearest one that any block
        started in: residuals of a peak are not those of a trough. Every segment is made by a task of its own, from the state that the segments before it lead to.
        """
        length = length or self.length
        lags, d, _ = self.weights.shape
        n_segments = math.ceil(length / self.segment)
        base = self.spark.range(0, sequences).withColumnRenamed("id", ROW)
        wanted = base.select(ROW, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_segments - 1).cast("long"))).alias("_b"))
        phases = len(self.season)
        apart = lambda p, q: min((p - q) % phases, (q - p) % phases)
        sources = [min(self.n_blocks, key=lambda q: (apart(p, q), q)) for p in range(phases)]
        at = F.pmod(F.col("_b") * self.segment, F.lit(phases)).cast("int")
        wanted = wanted.withColumn("_phase", F.get(F.array(*[F.lit(q) for q in sources]), at))
        choice = F.get(F.array(*[F.lit(self.n_blocks[q]).cast("long") for q in sources]), at)
        pick = md5_index(F.concat_ws(":", F.col(ROW), F.col("_b")), f"block:{seed}", choice)
        # Tasks by steps, however few sequences there are.
        parts = math.ceil(sequences * n_segments * self.segment / PART_STEPS)
        drawn = stored(wanted.withColumn("_index", pick).join(self.blocks, ["_phase", "_index"]).select(ROW, "_b", "residuals"), "segments")
        weights, segment, season = self.weights, self.segment, self.season
        matrix = companion(weights)
        noise = np.zeros_like(matrix)
        noise[:d, :d] = self.covariance
        root = root_of(stationary(matrix, noise))

        def noise_of(batch: pa.RecordBatch) -> np.ndarray:
            return batch.column("residuals").flatten().to_numpy().reshape(batch.num_rows, segment, d)

        def respond_to_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, last = respond(weights, np.zeros((batch.num_rows, lags * d)), noise_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("_b"), pa.array(list(last), pa.list_(pa.float64()))], [ROW, "_b", "_summary"])

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drawn = [np.random.Generator(np.random.Philox(key=[seed & (1 << 63) - 1, row])).standard_normal(len(root)) for row in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([root @ x for x in drawn], pa.list_(pa.float64()))], [ROW, "_state"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                state = batch.column("_state").flatten().to_numpy().reshape(batch.num_rows, lags * d)
                steps, _ = respond(weights, state, noise_of(batch))
                at = (batch.column("_b").to_numpy()[:, None] * segment + np.arange(segment)).ravel()
                values = steps.reshape(-1, d) + season[at % len(season)]
                inside = at < length
                owner = np.repeat(batch.column(ROW).to_numpy(), segment)[inside]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(at[inside]), *[pa.array(values[inside, i]) for i in range(d)]], [ROW, "_t", *[f"_z{i}" for i in range(d)]])

        starts = base.mapInArrow(begin, f"`{ROW}` bigint, _state array<double>")
        summaries = drawn.mapInArrow(respond_to_nothing, f"`{ROW}` bigint, _b bigint, _summary array<double>")
        states = scan(summaries, starts, AffineMaps(np.linalg.matrix_power(matrix, segment)), n_segments, ROW)
        fields = f"`{ROW}` bigint, _t bigint, " + ", ".join(f"_z{i} double" for i in range(d))
        rows = drawn.repartition(parts, ROW, "_b").join(states.repartition(parts, ROW, "_b"), [ROW, "_b"]).mapInArrow(walk, fields)
        bounded = [normal_cdf(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col(f"_z{i}")))).alias(f"_p{i}") for i in range(d)]
        made = rows.select(ROW, "_t", *bounded)
        cell = F.xxhash64(ROW, "_t")
        values = []
        for i, m in enumerate(self.measures):
            value = m.value(F.col(f"_p{i}"))
            values.append((F.when(uniform(cell, f"n:{m.name}", seed) >= m.null_share, value) if m.null_share > 0 else value).alias(m.name))
        return made.select((F.col(ROW) + 1).alias(self.key), F.col("_t").alias(self.index), *values)


def _numbered_steps(named: DataFrame) -> DataFrame:
    """``(k, x, s, _n)`` with 1-based places ``_n`` in each sequence, from counts per time chunk."""
    ends = named.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    parts = max(64, math.ceil((ends["n"] or 0) / CHUNK_STEPS))
    span = ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) or 1.0
    chunked = named.withColumn("_c", F.least(F.lit(parts - 1), F.floor((F.col("x") - (ends["lo"] or 0.0)) / span * parts)))
    counts = chunked.groupBy("k", "_c").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("k", "_c", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("k", "_c").orderBy("x", "s")
    placed = chunked.withColumn("_i", F.row_number().over(inside)).join(offsets, ["k", "_c"])
    return placed.select("k", "x", "s", (F.col("_o") + F.col("_i")).alias("_n"))


def long_sequence_fit(
    df: DataFrame,
    key: str,
    index: str,
    measure: str | list[str],
    segment_size: int = 50,
    lags: int | tuple[int, ...] = 3,
    max_season: int = 200,
    season: int | None = None,
) -> LongSequenceModel:
    """Season and vector autoregression of normal scores over all steps of each sequence, all measures at once.

    Steps are numbered in time chunks and looked at in blocks that hold the last steps of the block before, so no task
    needs a whole sequence. The season is the clearest peak of the autocorrelation up to lag ``max_season``, unless it
    is given (0: none); its phase is counted from the first step of a sequence. All lags up to the longest take part.
    A missing measure counts as its median.
    """
    _check(df, key, index)
    names = [measure] if isinstance(measure, str) else list(measure)
    lags = lags if isinstance(lags, int) else max(lags)
    marginals = fit_marginals(df.select(*[C.quoted(c) for c in names]), {c: "numerical" for c in names}, "empirical")
    unusable = [m.name for m in marginals if not m.modelled]
    if unusable:
        raise ValueError(f"columns {unusable} cannot follow an autoregression")
    d = len(marginals)
    scores = normal_scores(df, marginals, [C.quoted(key), _index_number(df, index)])
    vector = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(d)])
    numbered = stored(_numbered_steps(scores.select(F.col("_keep0").alias("k"), F.col("_keep1").alias("x"), vector.alias("s"))), "steps")
    reach = max(lags, max_season if season is None else 0)
    size = segment_size * max(10, math.ceil(4 * reach / segment_size))
    blocks = stored(blocks_of(numbered, size, reach), "step-blocks")
    if season is None:
        season = season_of(*autocorrelations(blocks, d, max_season))
    phases = np.zeros((max(1, season), d))
    if season:
        phase = F.pmod(F.col("_n") - 1, F.lit(season))
        for r in numbered.groupBy(phase.alias("phase")).agg(*[F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(d)]).collect():
            phases[r["phase"]] = [r[f"m{i}"] for i in range(d)]
    weights, covariance = regress(blocks, d, lags, phases)
    weights = stabilised(weights)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = weights.transpose(1, 0, 2).reshape(d, lags * d)
        for batch in batches:
            keys, starts, found = [], [], []
            for name, block, first, home, values in zip(*(batch.column(c).to_pylist() for c in ("name", "_block", "first", "home")), batch.column("values")):
                rows = lagged(values.values.to_numpy().reshape(-1, d), home - first, home, lags, phases)
                rest = rows[:, :d] - rows[:, d:] @ flat.T
                for at in range(0, len(rest), segment_size):
                    part = rest[at : at + segment_size]
                    # A short last segment is filled up by its own steps, in phase if it holds a season, so that all
                    # have the same size.
                    places, n = np.arange(segment_size), len(part)
                    own = places % n if len(phases) == 1 or n < len(phases) else np.where(places < n, places, n - len(phases) + (places - n) % len(phases))
                    found.append(part[own].ravel())
                    keys.append(f"{name}:{block}:{at}")
                    starts.append((first - 1 + max(home - first, lags) + at) % len(phases))
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((keys, starts, found), kinds)], ["_key", "_phase", "residuals"])

    named = blocks.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("name"), "_block", "first", "home", "values")
    whole = stored(named.mapInArrow(residuals, "_key string, _phase int, residuals array<double>"), "residuals")
    counts = {r["_phase"]: r["n"] for r in whole.groupBy("_phase").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError(f"no sequence has more than {lags} steps")
    numbered_blocks = indexed_keys(whole.select("_key", "_phase"), within=["_phase"])
    drawable = stored(numbered_blocks.join(whole.drop("_phase"), "_key").select("_phase", "_index", "residuals"), "residuals")
    longest = numbered.agg(F.max("_n").alias("m")).first()["m"]
    return LongSequenceModel(df.sparkSession, key, index, marginals, phases, weights, covariance, drawable, counts, segment_size, longest)
