"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into four 16-bit blocks. Two fingerprints that differ in at most two bits agree on at least two
whole blocks, so each fingerprint is put under its six block pairs (32-bit keys), fingerprints that share a key are
compared, and the Hamming distance decides.

A key under which very many different fingerprints lie (variants of one page by the thousand) is not compared pair by
pair: its members meet at the fingerprints one bit away. Two values within two bits always share such a meeting point
and two that share one are within two bits, so the links are the same and their number stays linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.llm.components import components
from synthspark.session import stored

BLOCK_BITS = 16
BLOCKS = 4
RADIUS = 2
# Keys with more fingerprints than this link through meeting points. It only chooses between two exact ways.
PAIRED_BUCKET = 24
# Shingles hashed at once, which bounds a task's memory for texts of any length.
_SLICE = 1 << 16


# Only A-Z are lower-cased.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash over word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), _SLICE):
        hashes = [digest(joined[a:b], 42) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], ["id", "print", "bits"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, print, bits)`` per row: whole texts, words split at ASCII white space, A-Z lower-cased, XXH64 with seed 42.

    A bit is set if more than half of the shingles (repeats included) have it set. Fewer words than ``width`` are one
    shingle; null, empty and wordless texts get 0. ``print`` is a hash that tells texts under one id apart.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(width), f"id {kind}, print bigint, bits bigint")


def _block(bits: Column, index: int) -> Column:
    return F.shiftrightunsigned(bits, BLOCK_BITS * index).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _keys(bits: Column) -> Column:
    keys = []
    for number, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        pair = F.shiftleft(_block(bits, i), BLOCK_BITS).bitwiseOR(_block(bits, j))
        keys.append(F.shiftleft(F.lit(number).cast("long"), 2 * BLOCK_BITS).bitwiseOR(pair))
    return F.array(*keys)


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def links(distinct: DataFrame, paired_bucket: int = PAIRED_BUCKET) -> DataFrame:
    """Links ``(a, b)`` that join every two fingerprints within two bits, from a table of distinct ``bits``.

    Small buckets give their pairs, large ones a link from each member to the smallest one at a meeting point; every
    link is verified and two fingerprints are connected through links if and only if they are through close pairs.
    """
    keyed = distinct.select("bits", F.explode(_keys(F.col("bits"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(sizes, "key"), "simhash-buckets")
    small = members.where(F.col("n") <= paired_bucket)
    left = small.select("key", F.col("bits").alias("a"))
    right = small.select("key", F.col("bits").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b")
    crowd = members.where(F.col("n") > paired_bucket).select("bits").distinct()
    spots = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    spread = crowd.select(F.col("bits").alias("b"), F.explode(spots).alias("spot"))
    meeting = spread.groupBy("spot").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    through = spread.join(meeting.select("spot", "a"), "spot").select("a", "b")
    return pairs.union(through).where((F.col("a") != F.col("b")) & (hamming(F.col("a"), F.col("b")) <= RADIUS))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per document: ``id``, ``print``, ``bits``, ``group``, ``component`` (the smallest id reachable through close fingerprints).

    ``group`` is the group's smallest fingerprint, which tells groups apart that share an id.

    Rows that share an id keep their own rows. A null id never names a component, unless all ids of it are null, and
    then the component is null. Wordless texts share fingerprint 0 and are linked like any others. An empty table
    gives an empty result; columns other than id and text are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = stored(rows.groupBy("bits").agg(F.min("id").alias("low")), "simhash-distinct")
    return grouped(rows, distinct, links(distinct.select("bits")))


def grouped(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` ``(id, print, bits)`` with their group over the links ``found``; ``distinct`` has the smallest id of each of ``bits``."""
    roots = components(found, "a", "b")
    joined = roots.join(distinct, roots["node"] == distinct["bits"]).select("bits", "root", "low")
    lows = joined.groupBy("root").agg(F.min("low").alias("component"))
    linked = joined.join(lows, "root").select("bits", "root", "component")
    named = distinct.join(linked, "bits", "left").select(
        "bits", F.coalesce("root", "bits").alias("group"), F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("low")).alias("component")
    )
    return rows.join(named, "bits").select("id", "print", "bits", "group", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Input rows without near copies: of each group the row with the smallest id stays, with all its columns.

    If several texts of a group have its smallest id, the one with the smallest hash stays; of rows equal in id and
    text any one stays. Rows with a null id are in no group and all stay. Wordless texts are one group.
    """
    return keep_first(docs, simhash_groups(docs, id_col, text_col, width), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` for the groups ``found``, as ``simhash_groups`` gives them."""
    groups = stored(found.where("id IS NOT NULL"), "simhash-groups")
    # Rows equal in id and text have the same fingerprint, and so the same group.
    texts = groups.groupBy("id", "print", "group", "component").agg(F.count("*").alias("n"))
    leaders = groups.where("id = component").groupBy("group").agg(F.min("print").alias("leader"))
    stays = (F.col("id") == F.col("component")) & (F.col("print") == F.col("leader"))
    marked = texts.join(leaders, "group").select(F.struct("id", "print").alias("__key"), (~stays).alias("__gone"), "n")
    marked = marked.where("__gone OR n > 1").select("__key", "__gone")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("print"))
    joined = docs.select(F.struct("*").alias("row"), key.alias("__key")).join(marked, "__key", "left")
    once = joined.where("__gone = false").dropDuplicates(["__key"])
    return joined.where("__gone IS NULL").unionByName(once).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Digest of near-duplicate groups over three-word shingles of all documents."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
