"""Sharding by a k-d tree over document metadata, with leaves of equal bytes.

Every node is cut at the weighted median (bytes are the weights) of its widest metadata dimension, all nodes of a
level together; a node for an odd number of leaves is cut in that proportion. The median comes from grouped histograms
that narrow around it: each round reads the points, counts bytes per bucket and keeps the bucket with the median.
Points with equal coordinates are told apart by a hash, so a source that holds a third of all documents is cut like
anything else.

Equal texts are one point, so they share a shard: it weighs as much as all of them and lies where its first document
does. Only the documents of a text that outweighs a leaf are points of their own. Points above ``LARGE`` of a leaf, at
most ``leaves / LARGE`` of them, are dealt to the sides of each cut by the driver, in the order of the cut's dimension
where that fits; the cut among all others then evens the bytes out. The driver sees those, bucket sums and the tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthspark.llm.numbering import numbered
from synthspark.session import stored

SHARDS = 40
# Bytes a document takes besides its text.
OVERHEAD = 16
BUCKETS = 512
# A cut may be off by this share of a leaf.
TOLERANCE = 0.001
# A point above this share of a leaf is dealt on its own.
LARGE = 0.01
_COORDINATE_BITS = 30
_TIE_BITS = 32


@dataclass
class Node:
    """Leaves ``first`` to ``first + leaves - 1``; an inner node sends ``key <= cut`` of its dimension left."""

    first: int
    leaves: int
    dimension: int = 0
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None
    # Rows of large points that lie here.
    large: list = field(default_factory=list)


def _coordinates(rows: DataFrame, dimensions: list[str]) -> list[Column]:
    """``k0, k1, …``: coordinates scaled to 30 bits over ``rows``, then 32 bits of the hash ``_tie``.

    Numbers keep their order, everything else goes by a hash; nulls come first.
    """
    numeric = [isinstance(rows.schema[d].dataType, T.NumericType) for d in dimensions]
    values = [F.col(d).cast("double") if n else F.pmod(F.xxhash64(d), F.lit(1 << _COORDINATE_BITS)).cast("double") for d, n in zip(dimensions, numeric)]
    values = [F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for v in values]
    ends = rows.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("low", F.min), ("high", F.max))]).first()
    keys = []
    for i, v in enumerate(values):
        low, high = ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0
        scale = ((1 << _COORDINATE_BITS) - 2) / (high - low) if high > low else 0.0
        coordinate = F.coalesce(F.floor((v - low) * scale).cast("long") + 1, F.lit(0).cast("long"))
        tie = F.pmod(F.xxhash64("_tie", F.lit(i)), F.lit(1 << _TIE_BITS))
        keys.append(F.shiftleft(coordinate, _TIE_BITS).bitwiseOR(tie).alias(f"k{i}"))
    return keys


def _route(node: Node, leaf) -> Column:
    """Nested conditions from the root down; ``leaf`` names a node that is not cut (yet)."""
    if node.cut is None:
        return F.lit(leaf(node))
    return F.when(F.col(f"k{node.dimension}") <= node.cut, _route(node.left, leaf)).otherwise(_route(node.right, leaf))


def _open(node: Node) -> list[Node]:
    if node.cut is None:
        return [node] if node.leaves > 1 else []
    return _open(node.left) + _open(node.right)


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def _deal(node: Node, small: int) -> float:
    """Deal the node's large points to its two sides; returns the bytes of small points that the left side lacks.

    They go in the order of the cut's dimension; if that fills a side beyond its share, the heaviest goes first to
    the side that lacks most.
    """
    total = small + sum(p["size"] for p in node.large)
    goal = total * (node.leaves // 2) / node.leaves
    left, right, taken = [], [], 0
    for point in sorted(node.large, key=lambda p: (p[f"k{node.dimension}"], p["_text"])):
        if taken + point["size"] <= goal:
            left.append(point)
            taken += point["size"]
        else:
            right.append(point)
    if sum(p["size"] for p in right) > total - goal:
        left, right, lacks = [], [], [goal, total - goal]
        for point in sorted(node.large, key=lambda p: (-p["size"], p["_text"])):
            side = int(lacks[1] > lacks[0])
            (left, right)[side].append(point)
            lacks[side] -= point["size"]
        taken = sum(p["size"] for p in left)
    half = node.leaves // 2
    node.left, node.right = Node(node.first, half, large=left), Node(node.first + half, node.leaves - half, large=right)
    return min(max(goal - taken, 0), small)


def _cut_level(points: DataFrame, root: Node, nodes: list[Node], dimensions: int, tolerance: float) -> None:
    """Cut all ``nodes``; each keeps its place in the list as its number."""
    number = {id(n): i for i, n in enumerate(nodes)}
    rows = points.withColumn("_node", _route(root, lambda n: number.get(id(n), -1))).where("_node >= 0")
    ends = [f(f"k{d}").alias(f"{n}{d}") for d in range(dimensions) for n, f in (("low", F.min), ("high", F.max))]
    stats = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("bytes"), *ends).collect()}
    low, high, below, goal = {}, {}, {}, {}
    for i, node in enumerate(nodes):
        here = [stats[i]] if i in stats else []
        lows = [[r[f"low{d}"] for r in here] + [p[f"k{d}"] for p in node.large] for d in range(dimensions)]
        highs = [[r[f"high{d}"] for r in here] + [p[f"k{d}"] for p in node.large] for d in range(dimensions)]
        spans = [(max(highs[d], default=0) >> _TIE_BITS) - (min(lows[d], default=0) >> _TIE_BITS) for d in range(dimensions)]
        node.dimension = max(range(dimensions), key=lambda d: (spans[d], -d))
        lacking = _deal(node, here[0]["bytes"] if here else 0)
        # Where no small point lies, any cut does.
        node.cut = 0
        if here:
            low[i], high[i] = here[0][f"low{node.dimension}"], here[0][f"high{node.dimension}"]
            below[i], goal[i] = 0, lacking
    sought = list(low)
    dims = [n.dimension for n in nodes]
    while sought:
        width = {i: (high[i] - low[i]) // BUCKETS + 1 for i in sought}
        key = F.get(F.array(*[F.col(f"k{d}") for d in range(dimensions)]), _pick(dims, F.col("_node")).cast("int"))
        inside = rows.select("_node", "size", key.alias("key")).where(F.col("_node").isin(sought))
        lows = _pick([low.get(i, 0) for i in range(len(nodes))], F.col("_node"))
        highs = _pick([high.get(i, 0) for i in range(len(nodes))], F.col("_node"))
        widths = _pick([width.get(i, 1) for i in range(len(nodes))], F.col("_node"))
        inside = inside.where((F.col("key") >= lows) & (F.col("key") <= highs))
        inside = inside.withColumn("bucket", F.floor((F.col("key") - lows) / widths).cast("int"))
        grouped = inside.groupBy("_node", "bucket").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        # At most nodes times BUCKETS rows come to the driver.
        sums: dict[int, list] = {i: [] for i in sought}
        for r in grouped.collect():
            sums[r["_node"]].append((r["low"], r["high"], r["bytes"]))
        for i in list(sought):
            total = below[i]
            for first, last, size in sorted(sums[i]):
                if total + size >= goal[i] or (first, last, size) == max(sums[i]):
                    break
                total += size
            if size <= tolerance or first == last:
                after = abs(total + size - goal[i]) <= abs(total - goal[i])
                nodes[i].cut = last if after else first - 1
                sought.remove(i)
            else:
                low[i], high[i], below[i] = first, last, total


def _leaf_of_large(node: Node) -> list[tuple[int, int]]:
    if node.left is None:
        return [(p["_text"], node.first) for p in node.large]
    return _leaf_of_large(node.left) + _leaf_of_large(node.right)


def kd_shards(
    docs: DataFrame,
    dimensions: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """``(id, size, crc, shard, slot)`` per document, in ``shards`` leaves or as many as ``target_bytes`` asks for.

    ``size`` is the text's UTF-8 bytes (null: none) and ``OVERHEAD``. ``dimensions`` name columns of ``docs`` or
    ``size``. Equal texts share a shard, null and empty ones too, unless together they outweigh a leaf; their place is
    that of the document with the smallest hash of id and text. Slots run from 0 in each shard without gaps, in no
    particular order. Fewer texts than shards leave shards empty; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    own = [d for d in dimensions if d != "size"]
    rows = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("_text"), F.xxhash64(id_col, text).alias("_tie"), *[F.col(d).alias(f"d_{d}") for d in own],
    )
    rows = stored(rows, "kd-documents")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards or max(1, -(-total // target_bytes))
    keys = _coordinates(rows, ["size" if d == "size" else f"d_{d}" for d in dimensions])
    names = [f"k{i}" for i in range(len(keys))]
    # One point per text; its coordinates are those of one document, its tie the text's hash.
    place = F.min_by(F.struct("id", "size", "crc", *[f"d_{d}" for d in own]), "_tie").alias("_place")
    texts = rows.groupBy("_text").agg(F.sum("size").alias("_weight"), place)
    texts = texts.select("_text", "_weight", F.col("_text").alias("_tie"), "_place.*").select("_text", F.col("_weight").alias("size"), *keys)
    texts = stored(texts, "kd-texts")
    # At most as many rows as there are leaves, and as many as fit LARGE times into all leaves.
    broken = F.broadcast(texts.where(F.col("size") * leaves > total).select("_text"))
    large = texts.where((F.col("size") * leaves <= total) & (F.col("size") * leaves > LARGE * total)).collect()
    single = stored(rows.join(broken, "_text").select("id", "crc", "size", *keys), "kd-single")
    small = texts.where(F.col("size") * leaves <= LARGE * total)
    points = stored(small.select("size", *names).unionByName(single.select("size", *names)), "kd-points")
    root = Node(0, leaves, large=large)
    while nodes := _open(root):
        _cut_level(points, root, nodes, len(dimensions), TOLERANCE * total / leaves)
    shard = _route(root, lambda n: n.first).cast("int").alias("shard")
    dealt = spark.createDataFrame(_leaf_of_large(root), "_text long, shard int")
    out = ["id", "size", "crc", "shard"]
    # A text of the last join has at most LARGE of a leaf; heavier ones meet a bounded table.
    heavy = F.broadcast(texts.where(F.col("size") * leaves > LARGE * total).select("_text"))
    rest = rows.join(heavy, "_text", "left_anti").join(small.select("_text", shard), "_text")
    placed = single.select("id", "size", "crc", shard).unionByName(rows.join(F.broadcast(dealt), "_text").select(*out)).unionByName(rest.select(*out))
    return numbered(placed, "shard", "slot", "kd-shards")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal bytes, cut along size, source, language and id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = kd_shards(docs, ["size", "source", "lang", "doc_id"], shards=SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
