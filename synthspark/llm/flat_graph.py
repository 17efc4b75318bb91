"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors become one point; centres are fitted on a bounded sample, and every point joins its ``overlap``
   nearest clusters. A cluster above ``PIECE`` points is dealt into pieces. Vectors of each length have centres, and so
   clusters, of their own.
2. Each piece builds a navigable graph of its points: nearest candidates, pruned robustly so that the kept neighbours
   point in different directions, made two-way, and linked to the piece's medoid. The adjacency lists of a point from
   all its pieces are united.
3. In each piece all points of the cluster search: a greedy beam from the medoid finds the closest points, and from
   those in range the search expands along the graph as long as it meets points in range. What is found is verified
   with double-precision cosines. A pair that shares several clusters is counted in the first one only.
4. A task gives one count and one link to a root per point, never pairs. Roots are joined to components.
5. Recall is audited against brute force for a bounded set of query points, as the mean over those that have links;
   below ``LEAST_RECALL`` the points join twice as many clusters and the search is done again, until each point is in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.llm.components import components
from synthspark.session import stored

THRESHOLD = 0.95
# Vectors that centres are fitted on, and queries of the audit: both bounded.
SAMPLE = 8_192
AUDIT = 1_024
LEAST_RECALL = 0.98
# Points per cluster aimed at, most centres, and most points of one graph.
CLUSTER = 1_024
CENTRES = 4_096
PIECE = 2_048
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 32
# Expansion passes through points this much below the threshold, but only those at or above it count.
SLACK = 0.03
_QUERY_BLOCK = 256


def usable(vector) -> bool:
    """Whether a vector can link at all: present, finite, not zero."""
    return vector is not None and len(vector) > 0 and all(v is not None for v in vector) and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # The largest component is scaled to one first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over unit vectors; deterministic."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), size=min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def robust_prune(point: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of ``point`` among ``candidates`` (nearest first): one is kept unless a kept one is ``alpha`` times nearer to it."""
    own = 2 - 2 * vectors[candidates] @ point
    among = 2 - 2 * vectors[candidates] @ vectors[candidates].T
    alive, kept = np.ones(len(candidates), bool), []
    for at in range(len(candidates)):
        if alive[at]:
            kept.append(int(candidates[at]))
            if len(kept) == degree:
                break
            alive &= alpha * among[at] > own
    return kept


def build_graph(vectors: np.ndarray) -> tuple[list[list[int]], int]:
    """Two-way adjacency lists over unit vectors, and the medoid, from which every point can be reached."""
    n = len(vectors)
    medoid = int((vectors @ vectors.mean(axis=0)).argmax())
    lists: list[set[int]] = [set() for _ in range(n)]
    reach = min(CANDIDATES, n - 1)
    for at in range(0, n, _QUERY_BLOCK) if reach else ():
        near = vectors[at : at + _QUERY_BLOCK] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        best = np.argpartition(-near, reach - 1, axis=1)[:, :reach]
        order = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)
        for row, candidates in enumerate(order):
            for other in robust_prune(vectors[at + row], candidates, vectors):
                lists[at + row].add(other)
                lists[other].add(at + row)
    # Islands are tied to the medoid, one link each.
    seen = np.zeros(n, bool)
    for start in [medoid, *range(n)]:
        if seen[start]:
            continue
        if start != medoid:
            lists[medoid].add(start)
            lists[start].add(medoid)
        stack = [start]
        seen[start] = True
        while stack:
            for other in lists[stack.pop()]:
                if not seen[other]:
                    seen[other] = True
                    stack.append(other)
    return [sorted(x) for x in lists], medoid


def range_search(queries: np.ndarray, vectors: np.ndarray, starts: np.ndarray, flat: np.ndarray, medoid: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) with cosine at or above ``least`` that the graph leads to, a block of queries at a time.

    ``flat[starts[p]:starts[p + 1]]`` are the neighbours of point ``p``.
    """
    n = len(vectors)
    degrees = np.diff(starts)
    for at in range(0, len(queries), _QUERY_BLOCK):
        asked = queries[at : at + _QUERY_BLOCK]
        rows = np.arange(len(asked))
        known = np.full((len(asked), n), -2.0)
        opened = np.zeros((len(asked), n), bool)
        known[:, medoid] = asked @ vectors[medoid]
        while True:
            # Greedy part: every query opens its best point that is not open yet, as long as that is in its beam.
            waiting = np.where(opened, -2.0, known)
            best = waiting.argmax(axis=1)
            value = waiting[rows, best]
            if n > BEAM:
                edge = -np.partition(-known, BEAM - 1, axis=1)[:, BEAM - 1]
            else:
                edge = np.full(len(asked), -2.0)
            going = rows[(value > -2.0) & (value >= edge)]
            if not len(going):
                break
            opened[going, best[going]] = True
            _meet(going, best[going], asked, vectors, starts, flat, degrees, known)
        while True:
            # Expanding part: everything in range is opened.
            who, what = np.nonzero((known >= least - SLACK) & ~opened)
            if not len(who):
                break
            opened[who, what] = True
            for part in range(0, len(who), 1 << 16):
                _meet(who[part : part + (1 << 16)], what[part : part + (1 << 16)], asked, vectors, starts, flat, degrees, known)
        who, what = np.nonzero(known >= least)
        yield who + at, what


def _meet(who, what, asked, vectors, starts, flat, degrees, known) -> None:
    """Cosines of the neighbours of ``what`` for the queries ``who``, where they are not known yet."""
    counts = degrees[what]
    where = np.repeat(who, counts)
    first = np.repeat(starts[what] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    others = flat[first + np.arange(len(where))]
    new = known[where, others] == -2.0
    where, others = where[new], others[new]
    known[where, others] = np.einsum("ij,ij->i", asked[where], vectors[others])


def _roots(count: int, left: np.ndarray, right: np.ndarray, root: np.ndarray) -> None:
    """Unite ``left`` and ``right`` in ``root`` (smallest member leads)."""
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _points(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Stored ``(point, vector, n, low)``: distinct usable vectors, how many rows have each and their smallest id."""
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), values.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    # A number for each class is fixed when the table is written.
    classes = rows.groupBy(F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector")).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    return stored(classes.select(F.monotonically_increasing_id().alias("point"), "vector", "n", "low"), "points")


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1).astype(np.float64)


def _centres(points: DataFrame) -> list[tuple[int, np.ndarray]]:
    """``(first cluster, centres)`` per vector length.

    A length of up to ``CLUSTER`` points is one cluster around nothing; there is at most one fit per ``CLUSTER`` points.
    """
    lengths = points.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()
    out, first = [], 0
    for length, n in lengths:
        centres = np.zeros((1, length))
        if n > CLUSTER:
            own = points.where(F.size("vector") == length)
            reach = min(1.0, 2.0 * SAMPLE / n)
            drawn = own.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(reach * (1 << 30))).limit(SAMPLE).select("vector").toArrow()
            sample = drawn if drawn.num_rows else own.limit(SAMPLE).select("vector").toArrow()
            centres = fit_centres(_unit(_matrix(sample.column("vector"))), min(CENTRES, -(-n // CLUSTER)))
        out.append((first, centres))
        first += len(centres)
    return out


def _by_length(batch: pa.RecordBatch, place: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows whose vectors in column ``place`` have one length."""
    lengths = np.asarray(pc.list_value_length(batch.column(place)))
    for length in np.unique(lengths):
        own = batch.take(pa.array(np.nonzero(lengths == length)[0]))
        yield from (own.slice(at, rows) for at in range(0, own.num_rows, rows))


def _assigned(points: DataFrame, centres: list[tuple[int, np.ndarray]], overlap: int) -> DataFrame:
    """``(cluster, point, vector, n, clusters)``: a row for each of the ``overlap`` nearest centres of a point."""
    shared = points.sparkSession.sparkContext.broadcast({c.shape[1]: (first, c) for first, c in centres})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch, 1, 4096):
                own = _matrix(part.column(1))
                first, theirs = shared.value[own.shape[1]]
                near = _unit(own) @ theirs.T
                nearest = first + np.sort(np.argsort(-near, axis=1, kind="stable")[:, :overlap], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(nearest), pa.list_(pa.int32()))], ["point", "vector", "n", "clusters"])

    rows = points.select("point", "vector", "n").mapInArrow(run, "point bigint, vector array<double>, n bigint, clusters array<int>")
    return rows.select("*", F.explode("clusters").alias("cluster"))


def _build(table: pa.Table) -> pa.Table:
    ids = table.column("point").to_numpy()
    lists, medoid = build_graph(_unit(_matrix(table.column("vector"))))
    neighbours = [ids[x] for x in lists]
    return pa.table({"point": ids, "neighbours": pa.array(neighbours, pa.list_(pa.int64()))})


def _search(least: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["point", "links", "root"]
        if not index.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, own = index.column("point").to_numpy(), queries.column("point").to_numpy()
        vectors, asked = _unit(_matrix(index.column("vector"))), _unit(_matrix(queries.column("vector")))
        times = index.column("n").to_numpy()
        place = {p: k for k, p in enumerate(ids.tolist())}
        # Neighbours of the united lists that lie in another piece are not in this index.
        lists = [[place[p] for p in x if p in place] for x in index.column("neighbours").to_pylist()]
        flat = np.fromiter((p for x in lists for p in x), np.int64)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        medoid = int((vectors @ vectors.mean(axis=0)).argmax())
        here = int(index.column("cluster")[0].as_py())
        theirs, mine = _matrix(queries.column("clusters")).astype(np.int64), _matrix(index.column("clusters")).astype(np.int64)
        links = np.zeros(len(own), np.int64)
        root = np.arange(len(ids) + len(own))
        for who, what in range_search(asked, vectors, starts, flat, medoid, least):
            other = own[who] != ids[what]
            who, what = who[other], what[other]
            # The first cluster that both points are in counts the pair; lists of clusters are ascending.
            first = np.full(len(who), np.iinfo(np.int64).max)
            for k in range(theirs.shape[1]):
                mine_too = (mine[what] == theirs[who][:, k : k + 1]).any(axis=1)
                first = np.where(mine_too, np.minimum(first, theirs[who][:, k]), first)
            links += np.bincount(who, weights=times[what] * (first == here), minlength=len(own)).astype(np.int64)
            _roots(len(root), who + len(ids), what, root)
        names_of = np.concatenate([ids, own])
        lead = names_of[root]
        return pa.table({"point": names_of, "links": np.concatenate([np.zeros(len(ids), np.int64), links]), "root": lead})

    return run


def _linked(points: DataFrame, centres: list[tuple[int, np.ndarray]], overlap: int, least: float) -> DataFrame:
    """Stored ``(point, links, root)`` rows of all pieces: counts add up, roots link."""
    members = stored(_assigned(points, centres, overlap), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias("pieces"))
    dealt = members.join(F.broadcast(sizes), "cluster")  # One row per centre, at most CENTRES of each length.
    piece = F.pmod(F.xxhash64("point"), F.col("pieces").cast("bigint")).cast("int")
    index = dealt.select("cluster", piece.alias("piece"), "point", "vector", "n", "clusters")
    built = index.groupBy("cluster", "piece").applyInArrow(_build, "point bigint, neighbours array<bigint>")
    united = built.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    index = index.join(united, "point")
    # Queries come in lots of bounded size; each lot of a piece is a group of its own with a copy of the piece.
    lots = F.ceil(F.col("pieces") / F.lit(2)).cast("int")
    lot = F.pmod(F.xxhash64("point", F.lit("lot")), lots.cast("bigint")).cast("int")
    own = ["cluster", "point", "vector", "clusters"]
    asked = dealt.select(*[F.col(c).alias(c) for c in own], lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    copies = index.join(F.broadcast(sizes), "cluster").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("pieces")
    keys = ["cluster", "piece", "lot"]
    found = copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(least), "point bigint, links bigint, root bigint")
    return stored(found, "graph-links")


def _audit(points: DataFrame, counted: DataFrame, least: float) -> float | None:
    """Share of the true links that were found, as the mean over the linked ones of up to ``AUDIT`` points; None if none is linked.

    The points are drawn by a hash among those whose smallest id is divisible by 20, and compared with all points.
    """
    asked = points.where(F.xxhash64("low") % 20 == 0) if not isinstance(points.schema["low"].dataType, T.IntegralType) else points.where("low % 20 = 0")
    chosen = asked.orderBy(F.xxhash64("point", F.lit("audit"))).limit(AUDIT).select("point", "vector").toArrow()
    if not chosen.num_rows:
        return None
    queries = {}
    for part in chosen.combine_chunks().to_batches():
        for own in _by_length(part, 1, AUDIT):
            vectors = _unit(_matrix(own.column(1)))
            queries.setdefault(vectors.shape[1], []).append((own.column(0).to_numpy(), vectors))
    shared = points.sparkSession.sparkContext.broadcast({k: tuple(np.concatenate(x) for x in zip(*v)) for k, v in queries.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(ids), np.int64) for k, (ids, _) in shared.value.items()}
        for batch in batches:
            for part in _by_length(batch, 1, 1024):
                own = _matrix(part.column(1))
                if own.shape[1] in totals:
                    ids, vectors = shared.value[own.shape[1]]
                    close = vectors @ _unit(own).T >= least
                    totals[own.shape[1]] += (close & (part.column(0).to_numpy()[None, :] != ids[:, None])) @ part.column(2).to_numpy()
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[k][0]), pa.array(total)], ["point", "truth"])

    truth = points.select("point", "vector", "n").mapInArrow(run, "point bigint, truth bigint").groupBy("point").agg(F.sum("truth").alias("truth"))
    found = F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")
    return truth.where("truth > 0").join(counted, "point", "left").agg(F.avg(found)).first()[0]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = THRESHOLD, overlap: int = 3) -> DataFrame:
    """Input ids with ``n_links``, ``component``, ``kept`` and ``recall`` (that of the audit), one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component, and so does a vector whose id is null (its component is null and it is not kept). Equal vectors link
    with each other, and vectors of different lengths do not. Rows that repeat an id count as vectors of their own.
    ``recall`` is null if no audited vector has links to others. An empty table gives an empty result.
    """
    points = _points(vectors, id_col, vector_col)
    centres = _centres(points)
    most = max((len(c) for _, c in centres), default=0)
    recall, result = None, None
    while centres:
        found = _linked(points, centres, overlap, least)
        counted = found.groupBy("point").agg(F.sum("links").alias("links"))
        recall, result = _audit(points, counted, least), (found, counted)
        if recall is None or recall >= LEAST_RECALL or overlap >= most:
            break
        overlap *= 2
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.select("id", F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector"))
    if result is None:
        named = points.select("vector", (F.col("n") - 1).alias("n_links"), F.col("low").alias("component"))
    else:
        roots = components(result[0].where("point != root"), "point", "root")
        lows = roots.join(points.select(F.col("point").alias("node"), "low"), "node")
        least_id = lows.groupBy("root").agg(F.min("low").alias("component"))
        linked = lows.join(least_id, "root").select(F.col("node").alias("point"), "component")
        named = points.join(result[1], "point", "left").join(linked, "point", "left").select(
            "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component")
        )
    joined = rows.join(named.withColumnRenamed("vector", "_same"), (F.col("vector") == F.col("_same")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("recall")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", F.round("recall", 4).alias("audited_recall"))
