"""Near copies by the Jaccard similarity of word shingles: MinHash bands find the pairs, the shingles themselves decide.

Texts whose SimHash fingerprints, those of ``simhash``, differ by two bits at most are held against each other first.
These miss most pairs at the threshold, so every set of shingles also has 32 band keys over six minima each. Two sets of similarity 0.8 share no band about once in
16,000 pairs, more similar ones less often still. Every pair that shares a band is decided, unless both are in one
group already, and in a way that keeps bands with very many members cheap:

1. Each member of a band is held against the band's head, drawn anew for each band and round, and the pairs that reach
   the threshold make groups. So a group comes together through some head of its own.
2. Members of one band that are still in different groups meet in blocks. The bits that the sets' sketches differ in are
   no more than the shingles they differ in, so most pairs are refuted in the join by a few words; the rest is held
   against its exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.llm import simhash
from synthspark.llm.components import components
from synthspark.session import stored

LEAST = 0.8
BANDS = 32
ROWS = 6
# Words of a shingle of the fingerprints, as in op2.
FINGER_WIDTH = 3
# Rounds of heads.
ROUNDS = 2
# Words of a sketch.
WORDS = 8
# Members of a block.
BLOCK = 256
# Shingles mixed at once, which bounds a task's memory for texts of any length.
_SLICE = 1 << 12
# Fixed values of the hash functions.
_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles, over the words that ``simhash.fingerprint`` takes."""
    words = text.encode("utf-8", "surrogatepass").translate(simhash._LOWER).split() if text else []
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + width]), 42) for k in range(len(words) - width + 1)] if words else [], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band, none for an empty set."""
    if not len(shingles):
        return np.array([], np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        np.minimum(least, ((shingles[at : at + _SLICE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    parts = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """A sketch: per bit whether an odd number of shingles falls on it."""
    odd = np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _digest(shingles: np.ndarray) -> int:
    return simhash._signed(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 42)) if len(shingles) else 0


def _sketches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            fingers = np.fromiter((simhash.fingerprint(t.as_py(), FINGER_WIDTH) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width)
                sizes.append(len(own))
                digests.append(_digest(own))
                keys.append(band_keys(own))
                sketches.append(parities(own))
            made = [pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(fingers)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["id", "print", "bits", "size", "keys", "sketch", "finger"])

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["bits", "shingles"])

    return run


def _close(pairs: DataFrame, source: DataFrame, distinct: DataFrame, width: int, least: float) -> DataFrame:
    """Stored pairs ``(a, b)`` whose sets reach ``least``; the texts of ``source`` are read again for the sets in ``pairs``."""
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("bits")).distinct().join(distinct.select("bits", "print"), "bits"), "near-asked")
    texts = source.select("print", "text").join(asked, "print").dropDuplicates(["bits"]).select("bits", "text")
    sets = stored(texts.mapInArrow(_sets(width), "bits bigint, shingles array<bigint>"), "near-sets")
    left, right = sets.toDF("a", "own"), sets.toDF("b", "other")
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("own", "other")))
    return stored(both.where(F.col("shared") >= least * (F.size("own") + F.size("other") - F.col("shared")) - 1e-9).select("a", "b"), "near-links")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """One row per document like ``simhash.simhash_groups``, over links of Jaccard similarity ``least`` or more.

    ``bits`` is a hash of the set of shingles. Fewer words than ``width`` are one shingle; wordless texts are one group.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    fields = f"id {kind}, print bigint, bits bigint, size bigint, keys array<bigint>, sketch array<bigint>, finger bigint"
    rows = stored(source.mapInArrow(_sketches(width), fields), "near-sketches")
    own = [F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    distinct = stored(rows.groupBy("bits").agg(F.min("id").alias("low"), F.min("print").alias("print"), *own), "near-distinct")

    keyed = distinct.select("bits", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    placed = stored(keyed.join(shared, "key").withColumn("root", F.col("bits")), "near-bands")
    members = placed.drop("root")
    # The smaller set must hold this share of the larger one's size.
    fits = F.least("x", "y") >= least * F.greatest("x", "y") - 1e-9
    found: DataFrame | None = None
    tried: DataFrame | None = None

    def verify(pairs: DataFrame) -> None:
        """Take in the links among the pairs that were not tried before."""
        nonlocal found, tried
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = _close(pairs, source, distinct, width, least)
        found = links if found is None else found.union(links)

    def located() -> DataFrame:
        """Members of the bands that still hold several groups."""
        roots = components(found, "a", "b").select(F.col("node").alias("bits"), "root")
        every = members.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
        mixed = every.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
        return stored(every.join(mixed.select("key", "n"), "key"), "near-mixed")

    # Sets with equal fingerprints meet at the smallest one, those with close fingerprints through these.
    owned = stored(rows.select("finger", "bits", "size").distinct(), "near-fingers")
    ends = owned.groupBy("finger").agg(F.min_by(F.struct("bits", "size"), "bits").alias("head"))
    equal = owned.join(ends, "finger").select(F.struct("bits", "size").alias("p"), F.col("head").alias("q"))
    linked = simhash.links(ends.select(F.col("finger").alias("bits")))
    nearby = linked.join(ends.toDF("a", "p"), "a").join(ends.toDF("b", "q"), "b").select("p", "q")
    first = equal.union(nearby).where("p.bits != q.bits").select(
        F.least("p.bits", "q.bits").alias("a"), F.greatest("p.bits", "q.bits").alias("b"), F.col("p.size").alias("x"), F.col("q.size").alias("y")
    )
    verify(first.where(fits).select("a", "b").distinct())

    for turn in range(ROUNDS):
        if turn and placed.isEmpty():
            break
        drawn = F.min_by(F.struct("bits", "size", "root"), F.xxhash64("bits", "key", F.lit(turn)))
        heads = placed.groupBy("key").agg(drawn.alias("head"))
        met = placed.join(heads, "key").where(F.col("root") != F.col("head.root"))
        met = met.select(F.least("bits", "head.bits").alias("a"), F.greatest("bits", "head.bits").alias("b"), F.col("size").alias("x"), F.col("head.size").alias("y"))
        verify(met.where(fits).select("a", "b").distinct())
        placed = located()

    if placed.isEmpty():
        return simhash.grouped(rows.select("id", "print", "bits"), distinct.select("bits", "low"), found)
    # Blocks of a band meet two by two; a band of up to BLOCK members is one block.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sketched = placed.join(distinct.select("bits", "sketch"), "bits").withColumn("at", F.pmod(F.xxhash64("bits", F.lit("block")), blocks).cast("int"))
    left = sketched.select("key", F.col("at").alias("i"), F.explode(F.sequence("at", blocks - 1)).alias("j"), F.col("bits").alias("a"), F.col("size").alias("x"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    right = sketched.select("key", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.col("bits").alias("b"), F.col("size").alias("y"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    apart = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(WORDS)), F.lit(0))
    close = apart <= (1 - least) / (1 + least) * (F.col("x") + F.col("y")) + 1e-9
    # Within a block each pair comes twice and is taken once.
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    rest = left.join(right, ["key", "i", "j"]).where(once & (F.col("ra") != F.col("rb")) & fits & close)
    verify(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return simhash.grouped(rows.select("id", "print", "bits"), distinct.select("bits", "low"), found)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """Input rows without near copies, chosen like ``simhash.keep_one`` does."""
    return simhash.keep_first(docs, near_copy_groups(docs, id_col, text_col, width, least), id_col, text_col)
