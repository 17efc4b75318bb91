"""Benchmark decontamination with SimHash windows.

Texts become lower-case words and five-word shingles. A document can only reach the threshold for an item if enough of
its shingles are the item's; around those shingles every window as long as the item is fingerprinted (two 60-bit
words, one majority bit per position). A document shorter than the item is one window. Fingerprints are cut into twelve 10-bit blocks. Each item lies under every
value within two bits of each of its blocks, so a window whose fingerprint differs in at most ``RADIUS`` bits has a
block that leads to the item: twelve blocks with three differences each would be more. The pairs found are held
against the radius and then against the exact similarity of their bags of shingles.

Everything is built-in functions. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BITS = 10
BLOCKS_PER_WORD = 6
FLIPS = 2
RADIUS = 2 * BLOCKS_PER_WORD * (FLIPS + 1) - 1
# Tables of item shingles up to this many rows (about 100 MB) are sent to every task; larger ones are shuffled.
BROADCAST_ROWS = 2_000_000
# Counters: four lanes of 15 bits in a long, which hold items of up to 32,767 shingles.
_LANES = sum(1 << (15 * k) for k in range(4))
MAX_WORDS = 32_767
_WORD_BITS = 60


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null for a null text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingled(rows: DataFrame, text: Column, width: int) -> DataFrame:
    """Input with ``_shingles``: a 64-bit hash per run of ``width`` words, in order; empty for shorter texts."""
    rows = rows.withColumn("_words", F.coalesce(words_of(text), F.array().cast("array<string>")))
    every = F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, width)]))
    rows = rows.withColumn("_every", every).withColumn("_count", F.greatest(F.size("_words") - (width - 1), F.lit(0)))
    return rows.withColumn("_shingles", F.slice("_every", F.lit(1), F.col("_count"))).drop("_words", "_every", "_count")


def _second(shingle: Column) -> Column:
    return F.xxhash64(shingle, F.lit(1))


def _majority(keys: list[str], rows: DataFrame) -> DataFrame:
    """Fingerprint words ``hi`` and ``lo`` per group of ``keys``, from rows with ``shingle`` and ``count``."""
    sums = []
    for name, value in (("hi", F.col("shingle")), ("lo", _second(F.col("shingle")))):
        sums += [F.sum(F.shiftrightunsigned(value, j).bitwiseAND(F.lit(_LANES))).alias(f"{name}{j}") for j in range(15)]
    counted = rows.groupBy(*keys).agg(F.first("count").alias("_size"), *sums)
    # Adding 2^14 - 1 - size/2 to each lane carries into its top bit exactly where more than half have the bit.
    bias = (F.lit((1 << 14) - 1).cast("long") - F.shiftright("_size", 1)) * F.lit(_LANES)

    def word(name: str) -> Column:
        bits = F.lit(0).cast("long")
        for j in range(15):
            lane = F.shiftrightunsigned(F.col(f"{name}{j}") + bias, 14).bitwiseAND(F.lit(_LANES))
            bits = bits.bitwiseOR(F.shiftleft(lane, j))
        return bits

    return counted.select(*keys, word("hi").alias("hi"), word("lo").alias("lo"))


def _blocks() -> list[Column]:
    out = []
    for name in ("hi", "lo"):
        out += [F.shiftrightunsigned(name, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for k in range(BLOCKS_PER_WORD)]
    return out


def _flips() -> list[int]:
    return [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _item_keys(items: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("block"), b.alias("value")) for k, b in enumerate(_blocks())])
    rows = items.select("item", "size", "hi", "lo", F.explode(entries).alias("entry"))
    rows = rows.select("item", "size", "hi", "lo", "entry.*", F.explode(F.array(*map(F.lit, _flips()))).alias("flip"))
    return rows.select(F.col("item"), "size", F.col("hi").alias("item_hi"), F.col("lo").alias("item_lo"), "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))


def _matches(docs: DataFrame, items: DataFrame, width: int, least: float) -> DataFrame:
    """Windows ``(_doc, item, start, size, count, similarity)`` that reach ``least``.

    ``size`` counts the item's shingles and ``count`` the window's: as many, or all of a shorter document.
    """
    shingled = stored(_shingled(items, F.col("_text"), width).select(F.col("_item").alias("item"), F.col("_shingles").alias("shingles")), "items")
    shingled = shingled.withColumn("size", F.size("shingles"))
    bags = stored(shingled.select("item", "size", F.explode("shingles").alias("shingle")).groupBy("item", "size", "shingle").agg(F.count("*").alias("times")), "item-bags")
    wanted = bags.select("item", "size", "shingle")
    if bags.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    spots = _shingled(docs, F.col("_text"), width).select("_doc", F.size("_shingles").alias("length"), F.posexplode_outer("_shingles").alias("at", "shingle"))
    hits = stored(spots.join(wanted, "shingle").select("_doc", "length", "at", "item", "size"), "benchmark-hits")
    # Bags of a and b shingles that share s have similarity s / (a + b - s).
    needed = F.ceil(F.lit(least / (1 + least)) * (F.col("size") + F.least("size", "length")) - F.lit(1e-9))
    enough = hits.groupBy("_doc", "item", "size", "length").agg(F.count("*").alias("n")).where(F.col("n") >= needed).select("_doc", "item")
    first = F.greatest(F.col("at") - F.col("size") + 1, F.lit(0))
    last = F.least(F.col("at"), F.greatest(F.col("length") - F.col("size"), F.lit(0)))
    near = hits.join(enough, ["_doc", "item"]).select("_doc", "size", first.alias("first"), last.alias("last")).where("first <= last").distinct()
    starts = near.select("_doc", "size", F.explode(F.sequence("first", "last")).alias("start")).distinct()
    asked = starts.groupBy("_doc").agg(F.collect_list(F.struct("size", "start")).alias("_asked"))
    texts = _shingled(docs.join(asked, "_doc").dropDuplicates(["_doc"]), F.col("_text"), width)
    # The generator keeps the formula of the array out of the lambda below, where it would be computed per element.
    texts = texts.select("_doc", "_asked", F.inline(F.array(F.struct("_shingles"))))

    def window(w: Column) -> Column:
        count = F.least(w["size"], F.size("_shingles"))
        shingles = F.transform(F.sequence(w["start"], w["start"] + count - 1), lambda i: F.get("_shingles", i))
        return F.struct(w["size"].alias("size"), w["start"].alias("start"), count.alias("count"), shingles.alias("shingles"))

    cut = texts.select("_doc", F.transform("_asked", window).alias("_windows"))
    windows = stored(cut.select("_doc", F.explode_outer("_windows").alias("w")).select("_doc", "w.*"), "windows")
    keys = ["_doc", "size", "start"]
    prints = _majority(keys, windows.select(*keys, "count", F.explode("shingles").alias("shingle")))
    item_prints = _majority(["item", "size"], shingled.select("item", "size", F.col("size").alias("count"), F.explode("shingles").alias("shingle")))

    entries = F.array(*[F.struct(F.lit(k).alias("block"), b.alias("value")) for k, b in enumerate(_blocks())])
    led = prints.select(*keys, "hi", "lo", F.explode(entries).alias("entry")).select(*keys, "hi", "lo", "entry.*")
    led = led.join(_item_keys(item_prints), ["size", "block", "value"])
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("item_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("item_lo")))
    pairs = led.where(distance <= RADIUS).select(*keys, "item").distinct()

    held = pairs.join(windows, keys).select(*keys, "count", "item", F.explode("shingles").alias("shingle"))
    held = held.groupBy(*keys, "count", "item", "shingle").agg(F.count("*").alias("here"))
    shared = held.join(bags.select("item", "shingle", "times"), ["item", "shingle"])
    shared = shared.groupBy(*keys, "count", "item").agg(F.sum(F.least("here", "times")).alias("s"))
    return shared.withColumn("similarity", F.col("s") / (F.col("size") + F.col("count") - F.col("s"))).where(F.col("similarity") >= least)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Id and text hash. Structs with equal null fields are equal, so null ids need no care in joins."""
    return F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("print"))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    least: float = THRESHOLD,
) -> DataFrame:
    """``(id, print, item, similarity, start, words)``: the best window of each document for each item it holds.

    ``start`` and ``words`` count words; ties go to the earlier window. ``print`` is a hash of the text: a document is
    its id and its text, rows equal in both are one, null ids included. Items of fewer than ``width`` words are one
    shingle and must occur whole; wordless and null items match nothing, wordless and null texts hold nothing. Items
    above 32,767 words are refused. Items of equal id and text are one. Other columns are not read.
    """
    own = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")).distinct()
    # Item rows get numbers of their own, so that equal or null ids stay apart.
    own = own.withColumn("_size", F.size(words_of(F.col("_text")))).where("_size > 0")
    own = stored(own.withColumn("_number", F.xxhash64("_item", "_text")), "benchmark")
    sizes = own.agg(F.max("_size").alias("most"), F.collect_set(F.least("_size", F.lit(width))).alias("widths")).first()
    if (sizes["most"] or 0) > MAX_WORDS:
        raise ValueError(f"benchmark items are limited to {MAX_WORDS} words; cut longer ones into several")
    rows = docs.select(_identity(docs, id_col, text_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    found = None
    for own_width in sorted(sizes["widths"] or [width]):
        part = own.where(F.least("_size", F.lit(width)) == own_width)
        hit = _matches(rows, part.select(F.col("_number").alias("_item"), "_text"), own_width, least)
        hit = hit.withColumn("words", F.col("count") + (own_width - 1))
        found = hit if found is None else found.unionByName(hit)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "words")).alias("best")
    top = found.groupBy("_doc", "item").agg(best)
    named = own.select(F.col("_number").alias("item"), F.col("_item").alias("name"))
    return top.join(named, "item").select(
        "_doc.id", "_doc.print", F.col("name").alias("item"), "best.similarity", (-F.col("best.back")).alias("start"), "best.words"
    )


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Input rows whose text holds no benchmark item; all columns are kept as they are."""
    leaks = find_leaks(docs, items, id_col, text_col, **options).select(F.struct("id", "print").alias("__document")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _identity(docs, id_col, text_col).alias("__document"))
    return rows.join(leaks, "__document", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the item, the place and the similarity."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "start", "words")
