"""Edit-aware token counts.

A document's pre-tokens lie in a segment tree, grouped by words with the white space before them, across which no
pre-token reaches. A leaf holds a run of such words as (characters, tokens), every inner node the sums of its children.
An edit finds its leaf by character offset, the text is split into words again from the start of the leaf that holds
the character before the edit, and the split stops at the first old leaf boundary behind the edit that is a boundary
again. A word hangs on the text from its start to one character behind its end only, so from there on, and before the
first leaf touched, nothing can have changed. Only the new words are encoded; the touched leaves and their ancestors
are updated.

Trees are kept as a table of leaf arrays beside the documents, so a later batch of edits reads the edited documents
alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

TOKENIZER = "byte_bpe_50k.tiktoken"
# Words per leaf when a tree is built; a leaf that outgrows it eightfold has its tree built anew.
LEAF = 64
_REMEMBERED = 150_000
_LONGEST = 64
# Personal data that the registered query's edits mask.
MASKS = {"<EMAIL>": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<IP>": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<NUMBER>": r"\b\d{5,}\b"}
# Every masked string matches this cheaper pattern.
MASKABLE = r"@|[0-9]{5}|[0-9]\.[0-9]"
# Bits of the marks that tell which documents may have edits.
MARKS = 1 << 23
EDITS = "seq int, start int, length int, replacement string"


# White space as the tokenizer sees it: without the four separators of ASCII that Python counts in.
_BLANK, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# ASCII marks.
_MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


class PieceCounts(dict):
    """Tokens of a word with its white space, encoded when first met. There are no special tokens.

    Words that were not met for a while are forgotten.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = re.compile(f"{_BLANK}*{_SOLID}+|{_BLANK}+")
        self._older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        count = self._older.get(piece)
        if count is None:
            core = piece.rstrip(_MARKS)
            # Marks behind an ASCII letter or digit are pre-tokens of their own.
            parted = len(core) < len(piece) and core[-1:].isascii() and core[-1:].isalnum()
            count = self[core] + self[piece[len(core) :]] if parted else len(self.encode(piece))
        if len(piece) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self._older = dict(self)
                self.clear()
            self[piece] = count
        return count


_piece_counts: dict[str, PieceCounts] = {}


def piece_counts(path: str) -> PieceCounts:
    """One memory of words per worker process, kept from task to task."""
    if path not in _piece_counts:
        _piece_counts[path] = PieceCounts(path)
    return _piece_counts[path]


class TokenTree:
    """Segment tree over leaves; node 1 is the root, node k has children 2k and 2k + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves = max(1, len(chars))
        self.base = 1 << (self.leaves - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        for sums, values in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.base : self.base + len(values)] = values
            width = self.base
            while width > 1:
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
                width //= 2

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> TokenTree:
        pieces = counts.split.findall(text)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))
        at = np.arange(0, len(pieces), LEAF)
        return cls(np.add.reduceat(chars, at) if len(at) else chars, np.add.reduceat(tokens, at) if len(at) else tokens)

    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds character ``offset`` (the last one behind the end) and where it starts."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if offset >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.base, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.base + leaf
        for sums, value in ((self.chars, chars), (self.tokens, tokens)):
            change, at = value - sums[node], node
            while at and change:
                sums[at] += change
                at //= 2

    def edit(self, text: str, start: int, length: int, replacement: str, counts: PieceCounts) -> tuple[str, int, bool]:
        """New text, words encoded, and whether a leaf has outgrown its size. Offsets beyond the text are cut to it."""
        start = min(max(start, 0), len(text))
        stop = min(start + max(length, 0), len(text))
        new = text[:start] + replacement + text[stop:]
        shift = len(new) - len(text)
        leaf, begin = self.find(max(0, start - 1))
        # Boundaries of old leaves at or behind the edit, as places in the new text.
        end_leaf, end = leaf, begin + int(self.chars[self.base + leaf])
        while end < stop and end_leaf + 1 < self.base:
            end_leaf += 1
            end += int(self.chars[self.base + end_leaf])
        chars, tokens, at = [], [], begin
        if at != end + shift or start < stop or replacement:
            for found in counts.split.finditer(new, begin):
                chars.append(found.end() - at)
                tokens.append(counts[found.group()])
                at = found.end()
                while end + shift < at and end_leaf + 1 < self.base:
                    end_leaf += 1
                    end += int(self.chars[self.base + end_leaf])
                if at == end + shift and end >= stop:
                    break
        slots = end_leaf - leaf + 1
        cuts = np.linspace(0, len(chars), slots + 1).astype(int)
        for k in range(slots):
            part = slice(cuts[k], cuts[k + 1])
            self.put(leaf + k, sum(chars[part]), sum(tokens[part]))
        return new, len(chars), len(chars) > 8 * LEAF * slots

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.base, self.base + self.leaves)
        return self.chars[part].astype(np.int32), self.tokens[part].astype(np.int32)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("print")).alias("doc"), text.alias("text"))


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc, tokens, leaf_chars, leaf_tokens)``; ``doc`` is id and text hash. Null and empty texts have no tokens."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for batch in batches:
            trees = [TokenTree.of(value.as_py() or "", counts) for value in batch.column(1)]
            leaves = [t.arrays() for t in trees]
            kind = pa.list_(pa.int32())
            columns = [pa.array([t.total() for t in trees], pa.int64()), pa.array([x[0] for x in leaves], kind), pa.array([x[1] for x in leaves], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "tokens", "leaf_chars", "leaf_tokens"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")


def _likely(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key may be in ``wanted``: all that are, and of the others those that fall on a marked bit.

    The marks are a table of 1 MB at most, whatever there is to find.
    """
    place = F.pmod(F.xxhash64(*[F.col(c).cast(rows.schema[c].dataType) for c in key]), F.lit(MARKS))
    placed = wanted.where("id IS NOT NULL").select(place.alias("place"))
    marks = placed.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    asked = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(marks), "bucket")
    bit = F.bitmap_bit_position("place")
    octet = F.conv(F.hex(F.substring("marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return asked.where(F.getbit(octet, (bit % 8).cast("int")) == 1).select(*rows.columns)


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Edited documents: ``(doc, text, tokens, leaf_chars, leaf_tokens, edits, reencoded)``, keyed as before the edits.

    ``edits`` has (id, seq, start, length, replacement): applied by ``seq``, each to the text its predecessors left,
    with offsets in characters. Equal ``seq`` go by start, length and replacement. Null replacements delete. Edits of
    an id apply to all its rows, or, if there is a column ``print``, to those with this hash of the text; those of
    unknown or null ids and of null texts do nothing. ``reencoded`` counts words that were encoded again.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    key = [c for c in ("id", "print") if c in edits.columns]
    # A document's edits are one log, as long as its history.
    logs = edits.where("id IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("log"))
    known = _keyed(docs, id_col, text_col).where("text IS NOT NULL")
    # Texts without edits stay where they are but for a few, and equal rows are looked for among the rest only.
    known = _likely(known.select("doc", "text", *[F.col(f"doc.{c}").alias(c) for c in key]), edits, key)
    rows = known.join(logs, key).drop(*key).dropDuplicates(["doc"])
    rows = rows.join(trees.dropDuplicates(["doc"]), "doc").select("doc", "text", "leaf_chars", "leaf_tokens", "log")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for batch in batches:
            out = []
            for text, chars, tokens, log in zip(*(c.to_pylist() for c in batch.columns[1:])):
                tree, encoded = TokenTree(np.array(chars, np.int64), np.array(tokens, np.int64)), 0
                for e in log:
                    text, again, grown = tree.edit(text, e["start"] or 0, e["length"] or 0, e["replacement"] or "", counts)
                    encoded += again
                    if grown:
                        tree = TokenTree.of(text, counts)
                out.append((text, tree.total(), *tree.arrays(), len(log), encoded))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            names = ["doc", "text", "tokens", "leaf_chars", "leaf_tokens", "edits", "reencoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, text string, tokens bigint, leaf_chars array<int>, leaf_tokens array<int>, edits bigint, reencoded bigint")


def masking_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masks: dict[str, str] | None = None) -> DataFrame:
    """Edit log that masks personal data, from the end of a text to its start, so that offsets hold as they are.

    The log goes by id and text hash, so different texts under one id each have their own; equal rows share one.
    """
    rows = _keyed(docs, id_col, text_col).where("doc.id IS NOT NULL AND text IS NOT NULL")
    if masks is None:
        masks = MASKS
        rows = rows.where(F.col("text").rlike(MASKABLE))
    kind = rows.schema["doc"].dataType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = re.compile("|".join(f"(?P<m{k}>{p})" for k, p in enumerate(masks.values())), re.ASCII)
        names = list(masks)
        for batch in batches:
            out = []
            for at, value in enumerate(batch.column(1)):
                hits = list(known.finditer(value.as_py()))
                out += [(at, k, m.start(), m.end() - m.start(), names[int(m.lastgroup[1:])]) for k, m in enumerate(reversed(hits))]
            at, *columns = zip(*out) if out else [()] * 5
            doc = batch.column(0).take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([doc.field("id"), doc.field("print"), *arrays], ["id", "print", "seq", "start", "length", "replacement"])

    # Equal rows would give their edits twice.
    return rows.dropDuplicates(["doc"]).mapInArrow(run, f"id {kind}, print bigint, {EDITS}")


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after personal data is masked in place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = stored(build_trees(docs), "token-trees")
    after = apply_edits(docs, trees, stored(masking_edits(docs), "edits"))
    after = after.select("doc", F.col("tokens").alias("after"), "edits", "reencoded", F.md5("text").alias("edited"))
    joined = trees.select("doc", "tokens").join(after, "doc", "left")
    return joined.select(
        F.col("doc.id").alias("doc_id"),
        "tokens",
        F.coalesce("after", "tokens").alias("tokens_after"),
        F.coalesce("edits", F.lit(0)).alias("edits"),
        F.coalesce("reencoded", F.lit(0)).alias("reencoded"),
        F.col("edited").alias("edited_md5"),
    )
