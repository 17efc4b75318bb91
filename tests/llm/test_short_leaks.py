"""Documents that are a benchmark item less some words."""

import random

from synthspark.llm import decontaminate


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, rng.sample(words, 30)) for k in range(8)]
    docs = []
    for k, item in items:
        # Of 26 shingles a text less n words at one end shares 26 - n, and has no others.
        docs += [(100 * k + n, item[n:] if k % 2 else item[: 30 - n]) for n in (0, 1, 3, 5, 6, 20, 26)]
        # A shorter text with a foreign word at its end: 23 of 24 shingles are the item's.
        docs.append((100 * k + 50, [*item[:27], "foreign"]))
        docs.append((100 * k + 60, [*item[:10], *rng.sample(words, 17)]))
    frames = [spark.createDataFrame([(i, " ".join(x)) for i, x in rows], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    got = {(r["id"], r["item"]): (round(r["similarity"], 9), r["start"], r["words"]) for r in decontaminate.find_leaks(*frames).collect()}
    want = {(100 * k + n, k): (round((26 - n) / 26, 9), 0, 30 - n) for k, _ in items for n in (0, 1, 3, 5)}
    want |= {(100 * k + 50, k): (round(23 / 27, 9), 0, 28) for k, _ in items}
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(*frames).collect()}
    assert kept == {100 * k + n for k, _ in items for n in (6, 20, 26, 60)}
