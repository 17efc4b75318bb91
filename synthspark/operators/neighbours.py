"""Exact nearest-neighbour join on a grid that coarsens until every query is settled.

A round puts both sides on a grid of width ``w`` and equi-joins the own and the adjoining cells. Donors outside those
cells differ by more than ``w`` in some coordinate, so a query whose k-th distance is no larger than that is final.
Open queries go on with a wider grid. Dense regions settle on fine grids, which keeps the number of compared pairs
small, and no query ever loses a neighbour.

Where cells are missing, rows are split into classes by the columns that a query and a donor share. A class searches in
these columns alone: all of them can carry its grid, and of rows that agree in them one query and k donors are enough.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthspark.functions import columns as C
from synthspark.session import stored

GRID_COLUMNS = 3
GROWTH = 4.0
# Most classes of shared columns in one search, and most patterns of missing cells that come to the driver.
CLASSES = 32
PATTERNS = 4096

Distance = Callable[[str, str], Column]


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    row_id: str,
    k: int,
    complete: list[str],
    distance: Distance,
    partial: list[str] | None = None,
    payload: list[str] | None = None,
    reach: Callable[[float], float] = lambda w: w * w,
    scales: dict[str, float] | None = None,
) -> DataFrame:
    """``(query_id, donor_id, distance, rank, payload…)``: the k nearest donors of every query.

    ``distance(q, d)`` builds the distance of two struct columns and is null when they cannot be compared. A
    ``partial`` column that one of the two lacks must not change it. It must be at least ``reach(|scaled difference|)``
    in every grid column. ``complete`` columns hold no nulls on either side.
    """
    payload, partial, scales = payload or [], partial or [], scales or {}
    if not complete and not partial:
        raise ValueError("a neighbour search needs at least one number column")
    traits = [c for c in donors.columns if c != row_id and c not in payload]
    split, classes, by_query, by_donor = _shared(queries, donors, partial, bool(complete))
    if not split:
        if complete:
            parts = [(queries, donors, complete)]
        else:
            parts = list(_classes(queries, donors, [], partial))
        found = []
        for q, d, dims in parts:
            d = stored(_few_copies(d.withColumn("_class", F.lit(0)), traits, row_id, k), "donors")
            q = stored(q.withColumn("_class", F.lit(0)), "targets")
            found.append(_search(q, d, row_id, row_id, k, [dims], distance, payload, reach, scales))
        pairs = C.union_all(found)
        return _top(pairs.drop("rank"), ["query_id"], k) if len(found) > 1 else pairs
    dims = [[*complete, *[c for c, here in zip(split, shared) if here == "1"]] for _, shared in classes]

    def spread(df: DataFrame, places: dict[str, list[int]]) -> DataFrame:
        """Rows once per class, without the cells that the class does not share."""
        where = F.create_map(*[x for p, js in places.items() for x in (F.lit(p), F.array(*[F.lit(j) for j in js]))])
        out = df.withColumn("_class", F.explode(where[_pattern(split)]))
        for c in split:
            held = [j for j, names in enumerate(dims) if c in names]
            out = out.withColumn(c, F.when(F.col("_class").isin(held), C.quoted(c)))
        return out

    d = stored(_few_copies(spread(donors, by_donor), traits, row_id, k), "donors")
    own = [c for c in queries.columns if c != row_id]
    members = stored(spread(queries, by_query), "targets")
    vectors = members.select("_class", *[C.quoted(c) for c in own]).distinct()
    vectors = stored(vectors.withColumn("_vector", F.monotonically_increasing_id()), "vectors")
    pairs = _search(vectors, d, "_vector", row_id, k, dims, distance, payload, reach, scales)
    entry = F.struct("distance", "donor_id", *[C.quoted(p) for p in payload])
    lists = pairs.groupBy(F.col("query_id").alias("_vector")).agg(F.collect_list(entry).alias("_near"))
    keyed = vectors.select("_vector", *[C.quoted(c).alias(f"_k{i}") for i, c in enumerate(["_class", *own])])
    same = F.col("_class") == F.col("_k0")
    for i, c in enumerate(own, 1):
        same = same & C.quoted(c).eqNullSafe(F.col(f"_k{i}"))
    near = members.join(keyed.join(lists, "_vector"), same).groupBy(F.col(row_id).alias("query_id"))
    best = near.agg(F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
    return best.select("query_id", F.posexplode("_near").alias("_at", "_one")).select(
        "query_id", "_one.donor_id", "_one.distance", *[F.col("_one")[p].alias(p) for p in payload], (F.col("_at") + 1).alias("rank")
    )


def _pattern(names: list[str]) -> Column:
    return F.concat(*[F.when(C.quoted(c).isNotNull(), "1").otherwise("0") for c in names])


def _shared(queries: DataFrame, donors: DataFrame, partial: list[str], anchored: bool):
    """Columns to split by, ``(donor pattern, shared columns)`` of every class, and the classes of each side's patterns.

    As many of ``partial`` as ``CLASSES`` allows. No columns when classes cannot be had: without any complete column
    (``anchored``) they would have to go by all of ``partial``.
    """
    none: tuple = ([], [], {}, {})
    if not partial:
        return none
    seen = [[r[0] for r in df.select(_pattern(partial)).distinct().limit(PATTERNS + 1).collect()] for df in (queries, donors)]
    most = len(partial)
    if max(len(s) for s in seen) > PATTERNS:
        most = 3
        seen = [["".join(p) for p in itertools.product("01", repeat=most)]] * 2
    for size in range(most, 0, -1):
        if size < len(partial) and not anchored:
            return none
        asked, held = ({p[:size] for p in side} for side in seen)
        pairs = {(q, d): "".join(min(a, b) for a, b in zip(q, d)) for q in asked for d in held}
        classes = sorted({(d, both) for (_, d), both in pairs.items() if anchored or "1" in both})
        if 0 < len(classes) <= CLASSES:
            place = {c: j for j, c in enumerate(classes)}
            by_query: dict[str, list[int]] = {}
            by_donor: dict[str, list[int]] = {}
            for (d, _), j in place.items():
                by_donor.setdefault(d, []).append(j)
            for (q, d), both in pairs.items():
                if (d, both) in place:
                    by_query.setdefault(q, []).append(place[(d, both)])
            return partial[:size], classes, by_query, by_donor
    return none


def _classes(queries: DataFrame, donors: DataFrame, complete: list[str], partial: list[str]):
    """Split both sides by presence so that each part has a column both of its sides hold."""
    if complete:
        yield queries, donors, complete
        return
    if not partial:
        return
    name, rest = partial[0], partial[1:]
    here = C.quoted(name).isNotNull()
    yield queries.filter(here), donors.filter(here), [name]
    yield from _classes(queries.filter(here), donors.filter(~here), [], rest)
    yield from _classes(queries.filter(~here), donors, [], rest)


def _few_copies(donors: DataFrame, traits: list[str], row_id: str, k: int) -> DataFrame:
    """Of identical donors only the k lowest ids can ever be chosen, so a hot value stays small."""
    copies = Window.partitionBy("_class", *[C.quoted(c) for c in traits]).orderBy(row_id)
    return donors.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")


def _top(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("distance", "donor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _per_class(values: dict[int, Column]) -> Column:
    """The value of a row's class."""
    if len(values) == 1:
        return next(iter(values.values()))
    (first, value), *rest = values.items()
    out = F.when(F.col("_class") == first, value)
    for j, v in rest:
        out = out.when(F.col("_class") == j, v)
    return out


def _search(queries, donors, query_key, row_id, k, dims, distance, payload, reach, scales) -> DataFrame:
    """Neighbours within each class; both sides are stored and hold their class, ``dims`` names its columns."""
    names = list(dict.fromkeys(c for d in dims for c in d))
    coord = {c: C.quoted(c).cast("double") * float(scales.get(c, 1.0)) for c in names}
    stats = donors.groupBy("_class").agg(
        F.count("*").alias("n"),
        *[F.min(coord[c]).alias(f"lo{i}") for i, c in enumerate(names)],
        *[F.max(coord[c]).alias(f"hi{i}") for i, c in enumerate(names)],
    )
    grids = {}
    for row in stats.collect():
        ends = {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(names)}
        grids[row["_class"]] = _Grid(row["n"], k, dims[row["_class"]], ends)
    open_queries = queries.filter(F.col("_class").isin(list(grids)))
    results: list[DataFrame] = []
    while grids and (left := open_queries.count()):
        pairs = stored(_round(open_queries, donors, left, query_key, row_id, k, grids, coord, distance, payload, reach), "pairs")
        results.append(pairs.filter("_final").drop("_final", "_class"))
        grids = {j: g.wider() for j, g in grids.items() if not g.last}
        if not grids:
            break
        settled = pairs.filter("_final and rank = 1").select(F.col("query_id").alias(query_key))
        still = open_queries.filter(F.col("_class").isin(list(grids)))
        open_queries = stored(still.join(settled, query_key, "left_anti"), "targets")
    if results:
        return C.union_all(results)
    types = {"query_id": queries.schema[query_key].dataType, "donor_id": donors.schema[row_id].dataType}
    types |= {"distance": "double"} | {p: donors.schema[p].dataType for p in payload} | {"rank": "int"}
    return donors.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()])


class _Grid:
    """Cells of one class: columns, where they start and end, and the width of this round."""

    def __init__(self, n: int, k: int, dims: list[str], ends: dict[str, tuple[float, float]]):
        self.n, self.low = n, {c: ends[c][0] for c in dims}
        self.span = {c: ends[c][1] - ends[c][0] for c in dims}
        self.columns = sorted([c for c in dims if self.span[c] > 0], key=lambda c: -self.span[c])[:GRID_COLUMNS] or dims[:1]
        self.widest = max(self.span[c] for c in self.columns)
        volume = math.prod(self.span[c] for c in self.columns if self.span[c] > 0)
        self.width = (volume * k / max(n, 1)) ** (1.0 / len(self.columns)) if self.widest > 0 else 1.0

    @property
    def last(self) -> bool:
        return self.width >= self.widest

    def wider(self) -> _Grid:
        self.width *= GROWTH
        return self

    def cell(self, i: int, coord: dict[str, Column]) -> Column:
        if i >= len(self.columns):
            return F.lit(0).cast("long")
        c = self.columns[i]
        top = math.floor(self.span[c] / self.width)
        raw = F.floor((coord[c] - self.low[c]) / self.width).cast("long")
        return F.greatest(F.lit(0), F.least(F.lit(top), raw)).cast("long")

    def steps(self, keys: int) -> Column:
        moves = [(-1, 0, 1) if i < len(self.columns) else (0,) for i in range(keys)]
        return F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"_s{i}") for i, s in enumerate(m)]) for m in itertools.product(*moves)])


def _round(queries, donors, left, query_key, row_id, k, grids, coord, distance, payload, reach) -> DataFrame:
    keys = [f"_c{i}" for i in range(max(len(g.columns) for g in grids.values()))]
    cells = [_per_class({j: g.cell(i, coord) for j, g in grids.items()}).alias(key) for i, key in enumerate(keys)]
    steps = _per_class({j: g.steps(len(keys)) for j, g in grids.items()})

    def placed(df: DataFrame, side: str, everywhere: bool) -> DataFrame:
        out = df.select("_class", F.struct("*").alias(side), *cells, *([F.inline(steps)] if everywhere else []))
        moved = [(F.col(key) + F.col(f"_s{i}")).alias(key) for i, key in enumerate(keys)] if everywhere else keys
        return out.select("_class", side, *moved)

    # The side that is copied to the adjoining cells is the one that leaves fewer rows to move. With the donors copied
    # all candidates of a query meet in one cell and need no second shuffle.
    around = 3 ** len(keys)
    copy_donors = sum(g.n for g in grids.values()) * around + left < left * around * (1 + k)
    d = donors.filter(F.col("_class").isin(list(grids)))
    pairs = placed(queries, "q", not copy_donors).join(placed(d, "d", copy_donors), ["_class", *keys]).select(
        "_class", *keys,
        F.col(f"q.{query_key}").alias("query_id"),
        F.col(f"d.{row_id}").alias("donor_id"),
        distance("q", "d").alias("distance"),
        *[F.col(f"d.{p}").alias(p) for p in payload],
    ).filter("distance is not null")
    group = ["_class", *keys, "query_id"] if copy_donors else ["query_id"]
    kth = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy(*group))
    bound = _per_class({j: F.lit(math.inf if g.last else float(reach(g.width))) for j, g in grids.items()})
    lasting = F.col("_class").isin([j for j, g in grids.items() if g.last])
    return _top(pairs, group, k).withColumn("_final", lasting | F.coalesce(kth <= bound, F.lit(False))).drop(*keys)
