"""The pipeline's near copies against the plain Jaccard similarity of all pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from synthspark.llm import near_copies
from tests.conftest import SMALL
from tests.llm import brute


def plain(docs, least=0.8):
    sets = {}
    for i, text in docs:
        words = text.lower().split()
        width = min(5, len(words))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return brute.groups(sets, links)


def variants():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    docs = []
    for size in (40, 60, 150, 300) * 5:
        base = rng.choices(words, k=size)
        for changes in (0, 1, 1, 2, 4, 8, 16):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(size)] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_stage_removes_what_jaccard_links(spark):
    docs = variants()
    roots = plain(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, frame, SMALL).collect()}
    assert kept == {i for i in roots if roots[i] == i}
    assert 20 <= len(kept) < len(docs) - 40


def test_chains_and_crowds(spark):
    words = [f"v{k}" for k in range(2000)]
    # Neighbours of the chain are alike, its ends are not; the crowd differs in its last word.
    docs = [(k, " ".join(words[10 * k : 10 * k + 150])) for k in range(40)]
    docs += [(100 + k, " ".join([*words[1000:1100], f"end{k}"])) for k in range(150)]
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["id"]: r["component"] for r in got} == plain(docs)


def test_crowds_below_the_threshold_meet_in_blocks(spark, monkeypatch):
    """Variants that share bands and are mostly no copies, with pairs of copies among them, in blocks of three."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(45)]
    docs = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(45), 2):
            copy[at] = f"x{k}-{at}"
        docs.append((2 * k, " ".join(copy)))
        if k % 3 == 0:
            docs.append((2 * k + 1, " ".join([*copy, f"end{k}"])))
    docs += [(500, None), (501, ""), (502, "one"), (503, "one")]
    roots = plain([(i, t or "") for i, t in docs])
    got = near_copies.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {i: 500 if not t else roots[i] for i, t in docs}
    assert {r["id"]: r["component"] for r in got.collect()} == want


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = random.Random(8)
    for size in (0, 1, 40, 3000):
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(rng.sample(sorted(a), size // 2)) | {rng.getrandbits(64) for _ in range(size // 3)}
        x, y = (near_copies.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_null_ids_ties_and_clashing_columns(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(None, text), (7, text), (7, text), (3, text + " x"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "bits", "key", "root", "size", "sketch")})
    got = [(r["id"], r["component"]) for r in near_copies.near_copy_groups(df).collect()]
    # A null id names no component unless it is alone; rows keep their own result.
    assert sorted(got, key=str) == sorted([(None, 3), (7, 3), (7, 3), (3, 3), (3, 3), (None, 3)], key=str)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert near_copies.near_copy_groups(df.limit(0)).count() == 0


def test_fingerprints_of_op2_link_first(spark, monkeypatch):
    """The stage takes the pairs that op2's fingerprints link; the bands alone are not its method."""
    from synthspark.llm import simhash

    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct: seen.append({r["bits"] % (1 << 64) for r in distinct.collect()}) or links(distinct))
    # Case and order of repeats: one set of five-word shingles may come from texts of different fingerprints.
    docs = [*variants()[:30], (1000, ""), (1001, None), (1002, "One two THREE"), (1003, "one two three")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, frame, SMALL).collect()}
    assert seen == [{brute.fingerprint(text, 3) for _, text in docs}]
    roots = plain([(i, t or "") for i, t in docs])
    assert kept - {1000, 1001} == {i for i in roots if roots[i] == i} - {1000, 1001} and len(kept & {1000, 1001}) == 1
