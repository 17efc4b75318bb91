"""Spelling variants: words one edit apart, grouped under the most frequent one.

Two words one edit apart agree on everything before the edit and everything behind it. So the places an edit can have in
a word of length l are parted into windows; words that agree outside a window meet in its list, and each pair one edit
apart meets in the list of the window that holds its edit. A list that is too long has its window halved, which parts
its words further; a window of one place holds no more words than there are letters, so every list ends up bounded.

Within a list the words' cores (what lies in the window) are sorted and scanned once per query word, as in a trie:
rows of the banded edit matrix (three cells, as more than one edit is of no interest) are kept for the prefix that
neighbouring cores share, and when a row exceeds one edit all cores that share its prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
# A form is this many times as frequent as its variant.
DOMINANCE = 2
# Runs whose hash this number divides lose a code point (planted typing errors).
TYPO_EVERY = 97
# Longest list that is scanned as it is.
LIST = 512
_FLUSH = 200_000

# Letters of a run, and the lower case of A-Z.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def with_typos(run: str, hash_value: int, typo_every: int = TYPO_EVERY) -> str:
    """``run`` without one code point if ``typo_every`` divides the hash; 0 leaves all runs as they are."""
    if typo_every and hash_value % typo_every == 0:
        at = hash_value % len(run)
        return run[:at] + run[at + 1 :]
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters in whole texts, long and frequent enough.

    Tasks count their own words first. Null texts have none; a null id takes part in the hash as an empty one.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = zlib.crc32(f"{id_}:".encode())
                for found, n in Counter(_RUN.findall(text)).items() if text else ():
                    low = _lower(found)
                    if len(low) >= least_length:
                        word = with_typos(low, zlib.crc32(low.encode(), before), typo_every)
                        if len(word) >= least_length:
                            counts[word] += n
                if len(counts) >= _FLUSH:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _windowed(rows: DataFrame, windows: Column) -> DataFrame:
    """``rows`` (word, n, size) once per window ``(lo, hi)``, with the key of its list; ``size`` is the shorter word's length."""
    spread = rows.withColumn("window", F.explode(windows)).select("word", "n", "size", F.col("window.lo").alias("lo"), F.col("window.hi").alias("hi"))
    behind = F.col("size") - F.col("hi")
    before = F.substr("word", F.lit(1), F.col("lo"))
    after = F.substr("word", F.length("word") - behind + 1, behind)
    key = F.concat_ws("\t", F.col("size").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), before, after)
    return spread.withColumn("key", key)


def _windows(lo: Column, mid: Column, hi: Column) -> Column:
    return F.array(F.struct(lo.cast("int").alias("lo"), mid.cast("int").alias("hi")), F.struct(mid.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def lists(words: DataFrame, longest: int = LIST) -> DataFrame:
    """``(key, word, n, size, lo, hi)``: the lists in which words one edit apart meet; none is longer than ``longest`` unless its window is one place."""
    shorter = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", shorter.alias("size"))
    rows = _windowed(rows, _windows(F.lit(0), F.floor(F.col("size") / 2), F.col("size")))
    done: DataFrame | None = None
    while True:
        rows = stored(rows, "spelling-lists")
        # Only words of the shorter length ask, so a list without one is of no use.
        sizes = rows.groupBy("key").agg(F.count("*").alias("n_words"), F.count_if(F.length("word") == F.col("size")).alias("n_asking"), F.first(F.col("hi") - F.col("lo")).alias("places"))
        sizes = stored(sizes.where("n_words > 1 AND n_asking > 0"), "spelling-sizes")
        long = (F.col("n_words") > longest) & (F.col("places") > 1)
        kept = rows.join(sizes.where(~long).select("key"), "key")
        done = kept if done is None else done.unionByName(kept)
        if sizes.where(long).isEmpty():
            return done
        again = rows.join(sizes.where(long).select("key"), "key").drop("key")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        halves = _windows(F.col("lo"), middle, F.col("hi"))
        rows = _windowed(again.withColumn("halves", halves).drop("lo", "hi"), F.col("halves")).select(*rows.columns)


def scan(cores: list[str], width: int, last: bool) -> list[tuple[int, int]]:
    """Places ``(asking, near)`` in the sorted ``cores`` that are one edit apart.

    Cores of length ``width`` ask; those that are a character longer only answer. ``last`` says that the window
    reaches the words' end. A longer core that differs by its last character only is left to the next window
    otherwise, where the insertion is found as well.
    """
    size = len(cores)
    shared = [0] * size
    for k in range(1, size):
        a, b = cores[k - 1], cores[k]
        d, most = 0, min(len(a), len(b))
        while d < most and a[d] == b[d]:
            d += 1
        shared[k] = d
    # Per depth the next core that shares less than it with its predecessor, worked out when first asked for.
    behind: dict[int, list[int]] = {}

    def skip(at: int, depth: int) -> int:
        if depth not in behind:
            nexts, place = [size] * (size + 1), size
            for k in range(size - 1, -1, -1):
                nexts[k] = place
                if shared[k] < depth:
                    place = k
            behind[depth] = nexts
        return behind[depth][at]

    found = []
    low, mid, high = [0] * (width + 3), [0] * (width + 3), [0] * (width + 3)
    # Row 0: nothing of the core is read; the query may have 0 or 1 characters more.
    low[0], mid[0], high[0] = 2, 0, 1
    for asking in range(size):
        query = cores[asking]
        if len(query) != width:
            continue
        at = keep = 0
        while at < size:
            core = cores[at]
            length, depth = len(core), keep
            a, b, c = low[depth], mid[depth], high[depth]
            alive = True
            while depth < length:
                char = core[depth]
                # Cells for one character less, as many, and one more of the query than of the core.
                x = b + 1
                if depth and a < x and a + (char != query[depth - 1]) < x:
                    x = a + (char != query[depth - 1])
                y = c + 1
                if depth < width and b + (char != query[depth]) < y:
                    y = b + (char != query[depth])
                if x + 1 < y:
                    y = x + 1
                z = y + 1
                if depth + 1 < width and c + (char != query[depth + 1]) < z:
                    z = c + (char != query[depth + 1])
                a, b, c = x, y, z
                depth += 1
                low[depth], mid[depth], high[depth] = a, b, c
                if a > 1 and b > 1 and c > 1:
                    alive = False
                    break
            if not alive:
                at = skip(at, depth)
                keep = shared[at] if at < size else 0
                continue
            if length == width:
                if b == 1:
                    found.append((asking, at))
            elif a == 1 and (last or core[:width] != query):
                found.append((asking, at))
            at += 1
            keep = shared[at] if at < size else 0
    return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple[str, str, int]] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    # Rows come sorted by list and core.
    for _, members in groupby(rows(), key=lambda r: r[0]):
        _, cores, words, counts, sizes, lows, highs = zip(*members)
        size, lo, hi = sizes[0], lows[0], highs[0]
        for asking, near in scan(list(cores), hi - lo, hi == size):
            out.append((words[asking], words[near], counts[near]))
            if len(words[near]) > size:
                out.append((words[near], words[asking], counts[asking]))
        if len(out) >= 50_000:
            yield batch_of()
            out.clear()
    yield batch_of()


def near_words(words: DataFrame, longest: int = LIST) -> DataFrame:
    """``(word, near, near_n)``: each ordered pair of ``words`` ``(word, n)`` that is one edit apart, once."""
    members = lists(words, longest)
    core = F.substr("word", F.col("lo") + 1, F.length("word") - F.col("size") + F.col("hi") - F.col("lo"))
    members = members.select("key", core.alias("core"), "word", "n", "size", "lo", "hi")
    return members.repartition("key").sortWithinPartitions("key", "core").mapInArrow(_near, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of all words ``(word, form)`` that have a form: the last of the chain of forms.

    Counts double along a chain, so it ends; each round doubles the steps taken.
    """
    steps = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY, dominance: float = DOMINANCE, longest: int = LIST) -> DataFrame:
    """One row per word of the vocabulary: ``word, form, root, n, n_near, form_n``.

    ``form`` is the most frequent word one edit away (ties: the first in code-point order) if it is ``dominance``
    times as frequent, ``root`` the last of the chain of forms, the word itself without one. Repeated rows count as
    often as they are there. An empty table gives an empty result; other columns are not read.
    """
    words = stored(vocabulary(docs, id_col, text_col, least_length, least_count, typo_every), "spelling-words")
    near = near_words(words, longest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("top"))
    joined = words.join(near, "word", "left")
    strong = -F.col("top.n") >= dominance * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("top.near")).alias("form"), F.when(strong, -F.col("top.n")).alias("form_n"))
    forms = stored(forms, "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """Spelling variants over the vocabulary of all documents."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
