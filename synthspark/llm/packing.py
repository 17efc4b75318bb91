"""Best-fit packing of tokenised documents into fixed-length sequences, large items first.

What fits where depends on lengths alone, and there are at most ``capacity`` of them. So the plan is made on the
histogram of lengths: bins that look alike are one class with a count, whatever the number of documents.

1. Pieces above a third of the capacity go at most two to a bin: from the longest down, each meets the longest partner
   that still fits.
2. Shorter ones, from the longest down, go to the smallest gap that holds them; new bins open when none does.

The plan gives each class the ranks of the pieces it holds, per length. Ranks are dealt to documents without a sort:
every tokenising task numbers its pieces per length, and a table of (task, length) counts gives the offsets.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthspark.session import stored

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Words whose ids a task remembers, and the longest of them.
_REMEMBERED = 150_000
_LONGEST = 64
# Bytes of text encoded at once.
_SLICE = 1 << 23
# Latin letters that all versions of the character tables agree on, and ASCII marks but the apostrophe,
# which a tokenizer's pattern may take together with the letters behind it.
_PLAIN = r"^(?P<core>[a-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_PIECE_FIELDS = "piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _nth bigint"


@dataclass(frozen=True)
class Merges:
    """A vocabulary with word ends, as byte strings: a word ends with a zero byte, ``ids`` are its ids by rank."""

    ranks: dict[bytes, int]
    ids: np.ndarray


# Fixed value: the byte-level alphabet, printable Latin-1 as itself and other bytes behind it.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_WORD_END = "</w>"


@cache
def merges(path: str) -> Merges | None:
    """Merges of a vocabulary file if merging by the merged bytes is the same as merging by pairs, else None.

    It is the same if each token, merged by pairs from its own bytes, comes out whole: wherever two neighbours make up
    its bytes, they then are the pair that its merge names.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _WORD_END or model.get("byte_fallback") or model.get("dropout"):
        return None
    letters = {b: c for c, b in _ALPHABET.items()}
    singles = {bytes([b]): model["vocab"].get(letters[b], -1) for b in range(256)}
    singles |= {bytes([b, 0]): model["vocab"].get(letters[b] + _WORD_END, -1) for b in range(1, 256)}
    known, by_pair = dict(singles), {}
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        parts = tuple(bytes(_ALPHABET[c] for c in x.removesuffix(_WORD_END)) + b"\0" * x.endswith(_WORD_END) for x in (left, right))
        if b"".join(parts) in known:
            return None
        known[b"".join(parts)] = model["vocab"][left + right]
        by_pair[parts] = len(by_pair)
    for token in known:
        body = token.removesuffix(b"\0")
        parts = [bytes([b]) for b in body]
        if body != token and body:
            parts[-1] += b"\0"
        while len(parts) > 1:
            rank, at = min((by_pair.get((parts[k], parts[k + 1]), len(by_pair)), k) for k in range(len(parts) - 1))
            if rank == len(by_pair):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return Merges({token: rank for rank, token in enumerate(known)}, np.array(list(known.values()), "<u4"))


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


class WordEncoder:
    """Token ids of texts by way of their different words.

    The tokenizer lower-cases, drops white space, and none of its patterns looks across it, so the ids of a text are
    those of its words one after the other. Words of Latin letters, with or without marks behind them, are merged all
    in one go; a run of marks is a pre-token of its own. Other words go through the tokenizer, which is remembered for
    a while.
    """

    def __init__(self, path: str, known: Merges | None) -> None:
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode
        self._met: dict[str, list[int]] = {}
        self._known = known
        if known:
            import tiktoken

            self._merge = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=known.ranks, special_tokens={}).encode_to_numpy
            self._final = np.zeros(len(known.ids), bool)
            self._final[[rank for token, rank in known.ranks.items() if token.endswith(b"\0")]] = True

    def _ids(self, word: str) -> list[int]:
        ids = self._met.get(word)
        if ids is None:
            ids = self._encode(word, add_special_tokens=False).ids
            if len(self._met) >= _REMEMBERED:
                self._met.clear()
            if len(word) <= _LONGEST:
                self._met[word] = ids
        return ids

    def _listed(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has, by the tokenizer."""
        found = [self._ids(word) for word in words.to_pylist()]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, and how many each has, by merges."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ranks = self._merge("\0".join(words.to_pylist()) + "\0", disallowed_special=())
        stops = np.flatnonzero(self._final[ranks]) + 1
        return self._known.ids[ranks], np.diff(stops, prepend=0)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and how many each has."""
        if not self._known:
            return self._listed(words)
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(plain))
        tails = parts.field("marks").dictionary_encode()
        pools, sizes = zip(self._merged(pc.utf8_lower(parts.field("core"))), self._listed(tails.dictionary), self._listed(words.filter(pa.array(~plain))))
        starts = np.split(np.cumsum(np.concatenate(sizes)) - np.concatenate(sizes), np.cumsum([len(s) for s in sizes])[:-1])
        # A word is two stretches of the pool: its letters (or all of it) and its marks.
        at, length = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        tail = tails.indices.to_numpy()
        for values, (core, mark, other) in ((at, starts), (length, sizes)):
            values[plain, 0], values[plain, 1], values[~plain, 0] = core, mark[tail], other
        return _gathered(np.concatenate(pools), at.ravel(), length.ravel()), length.sum(axis=1)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null has none."""
        # Special tokens are matched before anything else; a text with one is encoded word by word as it is.
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", pc.fill_null(texts, ""))))
        coded = split.flatten().dictionary_encode()
        pool, counts = self._word_ids(coded.dictionary)
        chosen = coded.indices.to_numpy()
        lengths = counts[chosen]
        ids = _gathered(pool, (np.cumsum(counts) - counts)[chosen], lengths).astype("<u4").tobytes()
        stops = 4 * np.append(0, np.cumsum(lengths))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        found = [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            words = texts[k].as_py().encode().split()
            found[k] = np.fromiter(chain.from_iterable(self._ids(w.decode()) for w in words), "<u4").tobytes()
        return found


_encoders: dict[str, WordEncoder] = {}


def _encoded(path: str, known: Merges | None, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text, a few megabytes of texts at a time, by one encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, known)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _SLICE)))
        yield from _encoders[path].encode(texts.slice(first, last - first))
        first = last


def _cut(capacity: int, end_id: int, path: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, dealt = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for at, found in enumerate(_encoded(path, shared.value, batch.column(1))):
                ids = memoryview(found + end)
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((at, piece, start, length, zlib.crc32(part), task, int(dealt[length])))
                    dealt[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            names = ["id", *[f.split()[0] for f in _PIECE_FIELDS.split(", ")]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *arrays], names)

    return run


@dataclass
class BinClass:
    """``count`` bins that hold the same: ``held`` is a list of (length, how many of it)."""

    count: int
    held: list[tuple[int, int]]


def plan_bins(histogram: dict[int, int], capacity: int) -> list[BinClass]:
    """Bin classes that hold every item of ``{length: count}``."""
    left = {length: n for length, n in histogram.items() if n}
    closed: list[BinClass] = []
    gaps: dict[int, list[BinClass]] = {}
    sizes: list[int] = []

    def put(gap: int, made: BinClass) -> None:
        if gap == 0:
            closed.append(made)
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append(made)

    def take(gap: int) -> BinClass:
        made = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            sizes.remove(gap)
        return made

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        partner = large[at] if at >= 0 else None
        if partner is None or (partner == longest and left[longest] == 1):
            # One of its own kind left over takes the next shorter partner.
            partner = large[at - 1] if partner == longest and at > 0 else None
        if partner is None:
            put(capacity - longest, BinClass(left.pop(longest), [(longest, 1)]))
            large.pop()
            continue
        if partner == longest:
            pairs = left[longest] // 2
            put(capacity - 2 * longest, BinClass(pairs, [(longest, 2)]))
            left[longest] -= 2 * pairs
        else:
            pairs = min(left[longest], left[partner])
            put(capacity - longest - partner, BinClass(pairs, [(longest, 1), (partner, 1)]))
            left[longest] -= pairs
            left[partner] -= pairs
        for length in {longest, partner}:
            if not left[length]:
                del left[length]
                large.remove(length)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            each = gap // length
            made = take(gap) if at < len(sizes) else BinClass(-(-n // each), [])
            full = min(made.count, n // each)
            rest = min(n - full * each, each) if full < made.count else 0
            if full:
                put(gap - each * length, BinClass(full, [*made.held, (length, each)]))
            if rest:
                put(gap - rest * length, BinClass(1, [*made.held, (length, rest)]))
            if made.held and made.count - full - bool(rest):
                put(gap, BinClass(made.count - full - bool(rest), made.held))
            n -= full * each + rest
    return closed + [made for group in gaps.values() for made in group]


def _slots(classes: list[BinClass]) -> dict[str, np.ndarray]:
    """Rank ranges per length, sorted by (length, first rank): where the pieces of these ranks go."""
    rows, dealt, base = [], {}, 0
    for made in classes:
        offset = 0
        for length, each in made.held:
            first = dealt.get(length, 0)
            rows.append((length, first, base, each, offset))
            dealt[length] = first + made.count * each
            offset += length * each
        base += made.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "each", "offset"), table.T))


def _place(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        # Lengths are below 2^15, ranks below 2^48.
        keys = (slots["length"] << 48) + slots["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            into, each = rank - slots["first"][at], slots["each"][at]
            sequence = slots["base"][at] + into // each
            offset = slots["offset"][at] + into % each * length
            kept = [batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Each document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer
    than ``capacity`` (below 32,768) are cut. Rows are packed as they are: equal rows and null ids keep their own
    pieces. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    known = spark.sparkContext.broadcast(merges(path))
    pieces = stored(rows.mapInArrow(_cut(capacity, end_id, path, known), f"id {kind}, {_PIECE_FIELDS}"), "pieces")
    counts = pieces.groupBy("_task", "length").agg(F.count("*").alias("n"))
    # At most one row per possible length comes to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_slots(plan_bins(histogram, capacity)))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["_task", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    fields = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_place(shared), fields)


def sequences(docs: DataFrame, layout: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids)``: the packed token ids, for documents whose ids are distinct and not null.

    A sequence is at most ``capacity`` tokens, so grouping by it is bounded.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], "<u4").tobytes()
    known = docs.sparkSession.sparkContext.broadcast(merges(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, encoded in enumerate(_encoded(path, known.value, batch.column(1))):
                ids = np.frombuffer(encoded + end, "<u4").astype(np.int32)
                found += [(at, k, ids[s : s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
            at, piece, ids = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["id", "piece", "ids"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, piece int, ids array<int>")
    parts = encoded.join(layout.select("id", "piece", "sequence_id", "offset"), ["id", "piece"])
    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
