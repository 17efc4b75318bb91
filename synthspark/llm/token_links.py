"""Links between the tokens of two tokenizers, weighed by how many documents hold them.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a document into groups, and the tokens of a
group are linked. A pair's weight is the number of documents that hold it linked, and every document is told how well
its links agree with the corpus. Counting is external:

1. **Runs.** A task aligns documents until it holds ``RUN_TOKENS`` of them, sorts the (pair, document) records and
   spills them: per radix partition of the A id a zstd run of (pair, documents) in side-major order, A id first, and
   beside it the run's records.
2. **Up.** Groups of ``FAN_IN`` runs of one partition are merged through a heap of A ids, level by level, until one
   run per partition is left. A frequent pair is one entry of each run, never a group of documents.
3. **Down.** The last merge sees all partners of an A id together and so knows the highest weight. Weights and maxima
   go back down the same groups to the runs, each keeping the pairs it asked for, and in the end to the documents.

What a task holds is bounded by ``RUN_TOKENS`` (or one document), or by ``FAN_IN`` times the pairs that the two
vocabularies have in a partition; no group grows with the number of documents.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.llm.byte_bpe import byte_bpe
from synthspark.session import stored

PIECES = "piece_bpe_32k.model"
# Tokens of A after which a run is spilled, and the most documents of a run.
RUN_TOKENS = 1 << 20
RUN_DOCS = 1 << 16
# Radix partitions of the A ids.
RADIX = 64
# Runs merged at once.
FAN_IN = 64
# Bits of a B id; an A id has 16.
_SIDE = 15
_V = 1 << 16


class Pieces:
    """The piece tokenizer with the bytes of its ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(k) for k in range(self._model.vocab_size())]
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self._model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@cache
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path or public_tokenizers.path(PIECES))


@cache
def _byte_lengths(path: str | None) -> np.ndarray:
    known = byte_bpe(path).token_bytes
    lengths = np.zeros(max(known) + 1, np.int64)
    lengths[list(known)] = [len(b) for b in known.values()]
    return lengths


@cache
def _decimals() -> list[bytes]:
    """Ids as they stand in a digest: followed by a comma, a bar or a semicolon."""
    return [b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(_V)]


@dataclass
class Aligned:
    """Ids of both sides and the number of the group each token is in."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int

    def links(self) -> int:
        return int((np.bincount(self.a_group, minlength=self.groups) * np.bincount(self.b_group, minlength=self.groups)).sum())

    def sha256(self) -> str:
        """Digest of ``a1,a2|b1;a3|b2,b3``: decimal ids in order, groups parted by semicolons."""
        a_place = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")
        b_place = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[a_place] = self.a + _V * np.append(self.a_group[1:] != self.a_group[:-1], True)
        codes[b_place] = self.b + 2 * _V * np.append(self.b_group[1:] != self.b_group[:-1], True)
        return hashlib.sha256(b"".join(map(_decimals().__getitem__, codes.tolist()))[:-1]).hexdigest()


def align(text: str, b_ids: list[int], a_path: str | None = None, b_path: str | None = None) -> Aligned | None:
    """The groups of ``text``, or None if a side's bytes are not those of a space and the text."""
    spaced = " " + text
    data = spaced.encode("utf-8", "surrogatepass")
    known = pieces(b_path)
    if b"".join(map(known.token_bytes.__getitem__, b_ids)) != data:
        return None
    a, b = byte_bpe(a_path).plain(spaced).astype(np.int64), np.array(b_ids, np.int64)
    a_ends, b_ends = np.cumsum(_byte_lengths(a_path)[a]), np.cumsum(known.lengths[b])
    if a_ends[-1] != len(data):
        return None
    both = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
    return Aligned(a, b, np.searchsorted(both, a_ends), np.searchsorted(both, b_ends), len(both))


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of non-negative numbers as one zstd frame, byte planes apart."""
    head = np.array([len(columns), *map(len, columns)], "<i8").tobytes()
    planes = [np.ascontiguousarray(np.asarray(c, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.compress(head + b"".join(planes), 3)


def unpack_numbers(frame: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(frame)
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, columns = np.frombuffer(data, "<i8", count, 8), 8 + 8 * count, []
    for size in sizes.tolist():
        planes = np.frombuffer(data, np.uint8, 8 * size, at).reshape(8, size)
        columns.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += 8 * size
    return columns


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def _tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def run_records(found: list[Aligned | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pair keys of a run with their number of documents, and per record its document and occurrences.

    A key is radix, A id and B id. Records go by key, then document; a document is its place in ``found``.
    """
    a_codes, b_codes, owners, base = [], [], [], 0
    for k, doc in enumerate(found):
        if doc is not None:
            a_codes.append((doc.a_group + base) << 16 | doc.a)
            b_codes.append((doc.b_group + base) << 16 | doc.b)
            owners.append(np.full(doc.groups, k, np.int64))
            base += doc.groups
    if not owners:
        return (np.zeros(0, np.int64),) * 4
    owner = np.concatenate(owners)
    # Different ids of a group with their occurrences, so that a group of repeats stays small.
    (a_code, a_times), (b_code, b_times) = _tallied(np.concatenate(a_codes)), _tallied(np.concatenate(b_codes))
    b_first = np.searchsorted(b_code, np.arange(base + 1) << 16)
    a_group = a_code >> 16
    partners = (b_first[1:] - b_first[:-1])[a_group]
    left = np.repeat(np.arange(len(a_code)), partners)
    right = np.repeat(b_first[a_group] - (np.cumsum(partners) - partners), partners) + np.arange(len(left))
    a, b = a_code[left] & 0xFFFF, b_code[right] & 0xFFFF
    key = (a % RADIX) << 31 | a << _SIDE | b
    record = key << 16 | owner[a_group[left]]
    order = np.argsort(record, kind="stable")
    record, times = record[order], (a_times[left] * b_times[right])[order]
    first = np.flatnonzero(np.append(True, record[1:] != record[:-1]))
    record, times = record[first], np.add.reduceat(times, first)
    key = record >> 16
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.diff(np.append(starts, len(key))), record & 0xFFFF, times


_DOC = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"


def _spill(a_path: str | None, b_path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs = TaskContext.get().partitionId(), 0
        ids: list = []
        found: list[Aligned | None] = []
        facts: list[tuple] = []
        held, kind = 0, pa.null()

        def flush() -> pa.RecordBatch:
            number = task << 24 | runs
            keys, counts, docs, times = run_records(found)
            rows = [(-1, number, pack_numbers(counts, docs, times), [(i, *f) for i, f in zip(ids, facts)])]
            at = np.searchsorted(keys, np.arange(RADIX + 1) << 31)
            for r in range(RADIX):
                part = slice(at[r], at[r + 1])
                if at[r] < at[r + 1]:
                    rows.append((r, number, pack_numbers(_gaps(keys[part] - (r << 31)), counts[part]), None))
            radix, numbers, payloads, owned = zip(*rows)
            doc_type = pa.struct([("id", kind), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
            docs_column = pa.array([None if d is None else [dict(zip(doc_type.names, x)) for x in d] for d in owned], pa.list_(doc_type))
            return pa.RecordBatch.from_arrays(
                [pa.array(radix, pa.int32()), pa.array(numbers, pa.int64()), pa.array(payloads, pa.binary()), docs_column], ["radix", "run", "payload", "docs"]
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                b_ids = pieces(b_path).encode([text])[0] if text else []
                doc = align(text, b_ids, a_path, b_path) if text else None
                ids.append(id_)
                found.append(doc)
                facts.append((len(doc.a), len(doc.b), doc.groups, doc.links(), doc.sha256()) if doc else (0, 0, 0, 0, ""))
                held += len(doc.a) if doc else 0
                if held >= RUN_TOKENS or len(ids) == RUN_DOCS:
                    yield flush()
                    runs += 1
                    held = 0
                    ids, found, facts = [], [], []
        if ids:
            yield flush()

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One side-major run from several: keys and the sums of their counts, merged through a heap of A ids."""
    slices, heap = [], []
    for k, (keys, counts) in enumerate(runs):
        if len(keys):
            a = keys >> _SIDE
            starts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)).tolist()
            slices.append((a[starts[:-1]].tolist(), starts, keys, counts))
            heap.append((slices[-1][0][0], len(slices) - 1, 0))
    heapq.heapify(heap)
    out_keys, out_counts = [], []
    while heap:
        least = heap[0][0]
        parts = []
        while heap and heap[0][0] == least:
            _, k, at = heap[0]
            sides, starts, keys, counts = slices[k]
            parts.append((keys[starts[at] : starts[at + 1]], counts[starts[at] : starts[at + 1]]))
            if at + 1 < len(sides):
                heapq.heapreplace(heap, (sides[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            keys, counts = parts[0]
        else:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.concatenate([p[1] for p in parts]))
        out_keys.append(keys)
        out_counts.append(counts)
    if not out_keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_counts)


def best_of_side(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; ties all are."""
    if not len(keys):
        return np.zeros(0, bool)
    a = keys >> _SIDE
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(a))))


def _run_of(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = unpack_numbers(frame)
    return np.cumsum(gaps), counts


def _up(key: tuple, table: pa.Table) -> pa.Table:
    keys, counts = merge_runs([_run_of(p) for p in table.column("payload").to_pylist()])
    return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int64()), "payload": pa.array([pack_numbers(_gaps(keys), counts)], pa.binary())})


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for frame in batch.column(2).to_pylist():
            keys, counts = _run_of(frame)
            made.append(pack_numbers(_gaps(keys), counts, best_of_side(keys, counts)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["radix", "run", "payload"])


def _down(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """The known weights for the pairs of each run that asked."""
    gaps, counts, best = unpack_numbers(known.column("payload")[0].as_py())
    keys = np.cumsum(gaps)
    made = []
    for frame in asked.column("payload").to_pylist():
        own, _ = _run_of(frame)
        at = np.searchsorted(keys, own)
        made.append(pack_numbers(_gaps(own), counts[at], best[at]))
    return pa.table({"radix": asked.column("radix"), "run": asked.column("run"), "payload": pa.array(made, pa.binary())})


def _settle(key: tuple, own: pa.Table, weights: pa.Table) -> pa.Table:
    """Results of a run's documents from its records and the weights of its pairs, radix by radix."""
    parts = sorted(zip(weights.column("radix").to_pylist(), weights.column("payload").to_pylist()))
    shares = [unpack_numbers(p)[1:] for _, p in parts]
    weight = np.concatenate([s[0] for s in shares]) if shares else np.zeros(0, np.int64)
    best = np.concatenate([s[1] for s in shares]) if shares else np.zeros(0, np.int64)
    docs = own.column("docs").chunk(0).flatten()
    counts, doc, times = unpack_numbers(own.column("payload")[0].as_py())
    pair = np.repeat(np.arange(len(counts)), counts)
    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(n_best, doc, times * best[pair])
    np.add.at(total, doc, times * weight[pair])
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    columns = [docs.field(n) for n in names]
    return pa.table([*columns[:-1], pa.array(n_best), pa.array(total), columns[-1]], names=[*names[:-1], "n_best", "count_sum", names[-1]])


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_ranks: str | None = None, piece_model: str | None = None) -> DataFrame:
    """One row per document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose weight is the highest of their A id (ties included), ``count_sum`` adds up the
    weights of all links, ``groups_sha256`` is a digest of the groups. Every row is a document of its own, also equal
    rows and null ids. Null and empty texts, and those whose bytes a tokenizer does not keep, have zeros and an empty
    digest. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    doc = f"struct<id: {kind.simpleString()}, {_DOC}>"
    spilled = stored(rows.mapInArrow(_spill(byte_ranks, piece_model), f"radix int, run bigint, payload binary, docs array<{doc}>"), "link-runs")
    own = spilled.where("radix < 0").select("run", "payload", "docs")
    levels = [spilled.where("radix >= 0").select("radix", "run", "payload")]
    fields, runs = "radix int, run bigint, payload binary", own.count()
    while True:
        runs = max(1, -(-runs // FAN_IN))
        # A level's runs are dealt to the next one's by a hash that keeps groups near FAN_IN.
        levels[-1] = levels[-1].withColumn("into", F.pmod(F.xxhash64("run", F.lit(len(levels))), F.lit(runs)))
        levels.append(stored(levels[-1].groupBy("radix", "into").applyInArrow(_up, fields), "link-merges"))
        if runs == 1:
            break
    known = levels.pop().mapInArrow(_top, fields)
    while levels:
        asked = levels.pop()
        known = asked.groupBy("radix", "into").cogroup(known.withColumnRenamed("run", "into").groupBy("radix", "into")).applyInArrow(_down, fields)
    result = f"id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return own.groupBy("run").cogroup(known.groupBy("run")).applyInArrow(_settle, result)


def pair_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_ranks: str | None = None, piece_model: str | None = None) -> DataFrame:
    """``(a, b, n, best)``: linked id pairs, how many documents hold them, and whether that is the highest of ``a``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spill = _spill(byte_ranks, piece_model)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spill(batches):
            for radix, frame in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if radix >= 0:
                    keys, counts = _run_of(frame)
                    columns = [pa.array(x, pa.int64()) for x in (keys >> _SIDE, keys & ((1 << _SIDE) - 1), counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    counted = rows.mapInArrow(explode, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def query(spark, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers over all documents."""
    return token_links(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
