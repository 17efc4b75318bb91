"""Harmonic packing of tokenised documents into sequences of fixed length.

Lengths fall into reciprocal-capacity classes: class k takes pieces of about a k-th of the capacity, and each of its
bins holds k of them. Documents are cut into the fewest pieces of lengths that fill their class almost exactly: with
the default waste of 1/256 a bin of 2,048 tokens stays at most eight short, and a document is cut into 2.7 pieces on
average. Without waste all lengths are divisors of the capacity.

Because a bin's content is known from its class alone, bins fill without any coordination:

1. Every tokenising task fills bins of its own and emits each one that is full. What it holds back is bounded by the
   classes, not by the data.
2. Pieces left over in the tasks are numbered per length by a table of (task, length) counts and fill bins together.
3. What is left then, fewer than k pieces of each length, is packed best-fit from the longest down.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthspark.llm.byte_bpe import byte_bpe
from synthspark.session import stored

CAPACITY = 2048
END_ID = 1
# Share of a full bin that may stay empty.
WASTE = 1 / 256
_FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_NAMES = ["start", "length", "ids_crc32", "doc_tokens"]


def class_lengths(capacity: int, waste: float = WASTE) -> list[int]:
    """Piece lengths, ascending, of which a bin holds ``capacity // length`` and leaves at most ``waste`` of itself empty."""
    return [length for length in range(1, capacity + 1) if capacity % length <= waste * capacity]


def cut_table(capacity: int, waste: float = WASTE) -> list[list[int]]:
    """For each length from 0 to ``capacity`` the fewest class lengths that add up to it, the longest first."""
    allowed = class_lengths(capacity, waste)
    pieces, last = [0], [0]
    for length in range(1, capacity + 1):
        fewest, piece = min((pieces[length - a] + 1, -a) for a in allowed[: bisect_left(allowed, length + 1)])
        pieces.append(fewest)
        last.append(-piece)
    table: list[list[int]] = [[]]
    for length in range(1, capacity + 1):
        table.append(sorted([last[length], *table[length - last[length]]], reverse=True))
    return table


def _token_bytes(text: str | None, path: str | None, end: bytes) -> bytes:
    return (byte_bpe(path).special(text).astype("<u4").tobytes() if text else b"") + end


def _spans(length: int, capacity: int, table: list[list[int]]) -> list[int]:
    return [capacity] * (length // capacity) + table[length % capacity]


def _fill(capacity: int, waste: float, end_id: int, path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", *_NAMES, "sequence_id", "offset", "_task"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = cut_table(capacity, waste), TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}
        bins, kind = 0, pa.null()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            types = [kind, *[pa.int64()] * 6, pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

        for batch in batches:
            rows: list[tuple] = []
            kind = batch.schema.field(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(_token_bytes(text.as_py(), path, end))
                tokens, start = len(ids) // 4, 0
                for length in _spans(tokens, capacity, table):
                    piece = (id_, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens)
                    start += length
                    held = waiting.setdefault(length, [])
                    held.append(piece)
                    if len(held) == capacity // length:
                        rows += [(*p, task << 32 | bins, k * length, task) for k, p in enumerate(held)]
                        bins += 1
                        held.clear()
            yield batch_of(rows)
        # ``offset`` numbers what is left over in this task.
        if waiting:
            yield batch_of([(*p, None, k, task) for held in waiting.values() for k, p in enumerate(held)])

    return run


def plan_rest(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset), sorted, that place all pieces of ``{length: count}``.

    Full bins hold one length only; the rest goes to the smallest gap that takes it, from the longest down.
    """
    rows, bins = [], 0
    rest: dict[int, tuple[int, int]] = {}
    for length, n in sorted(histogram.items()):
        each = capacity // length
        if n >= each:
            rows.append((length, 0, bins, each, 0))
            bins += n // each
        if n % each:
            rest[length] = (n - n % each, n % each)
    gaps: list[tuple[int, int]] = []
    for length in sorted(rest, reverse=True):
        rank, n = rest[length]
        while n:
            at = bisect_left(gaps, (length, -1))
            if at < len(gaps):
                gap, into = gaps.pop(at)
            else:
                gap, into = capacity, bins
                bins += 1
            taken = min(n, gap // length)
            rows.append((length, rank, into, taken, capacity - gap))
            rank, n = rank + taken, n - taken
            if gap > taken * length:
                insort(gaps, (gap - taken * length, into))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, bins, each, offsets = shared.value.T
        # Ranks are below 2^40.
        keys = (lengths << 40) + firsts
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            into = rank - firsts[at]
            # Negative, so that they differ from the numbers the tasks gave.
            sequence = -1 - bins[at] - into // each[at]
            made = [pa.array(sequence), pa.array(offsets[at] + into % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", *_NAMES)), *made], ["id", *_NAMES, "sequence_id", "offset"])

    return run


def harmonic_pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    waste: float = WASTE,
    tokenizer: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Pieces cover a document
    without gap or overlap, and a sequence's pieces lie in it without gap from 0. Rows are packed as they are: equal
    rows and null ids keep their own pieces. An empty table gives an empty result; other columns are not read.
    ``tokenizer`` is a file of ranks. Which bin a piece meets hangs on the input's partitions; the cuts do not.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fill = _fill(capacity, waste, end_id, tokenizer)
    made = stored(rows.mapInArrow(fill, f"id {kind}, {_FIELDS}, sequence_id bigint, offset bigint, _task int"), "harmonic")
    full = made.where("sequence_id IS NOT NULL").drop("_task")
    left = made.where("sequence_id IS NULL")
    counts = left.groupBy("_task", "length").agg(F.count("*").alias("n"))
    # At most one row per class length comes to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan_rest(histogram, capacity))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = left.join(offsets, ["_task", "length"]).select("id", *_NAMES, (F.col("_before") + F.col("offset")).alias("_rank"))
    return full.unionByName(ranked.mapInArrow(_place(shared), f"id {kind}, {_FIELDS}, sequence_id bigint, offset bigint"))


def harmonic_sequences(docs: DataFrame, layout: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, waste: float = WASTE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids)``: the packed token ids, for documents whose ids are distinct and not null.

    A sequence is at most ``capacity`` tokens, so grouping by it is bounded.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cut_table(capacity, waste)
        for batch in batches:
            at, starts, parts = [], [], []
            for k, text in enumerate(batch.column(1)):
                ids, start = np.frombuffer(_token_bytes(text.as_py(), tokenizer, end), "<u4").astype(np.int32), 0
                for length in _spans(len(ids), capacity, table):
                    at.append(k)
                    starts.append(start)
                    parts.append(ids[start : start + length])
                    start += length
            owners = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([owners, pa.array(starts, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["id", "start", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, start bigint, ids array<int>")
    parts = encoded.join(layout.select("id", "start", "sequence_id", "offset"), ["id", "start"])
    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return harmonic_pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
