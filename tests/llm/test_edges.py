"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from synthspark.llm import (
    decontaminate,
    flat_graph,
    kd_shards,
    language_codes,
    licenses,
    line_chunks,
    packing,
    simhash,
    token_counts,
    weak_quality,
)
from synthspark.session import stored
from tests.conftest import SMALL

# Columns named like those the operators use.
CLASHES = "_id _row _text _print _gone _chunks __key __gone __document _doc _task _nth id print bits row component shard size tokens lang_pred score ambiguous removed_chunks dice item".split()
NOTICE = "Released under the MIT License."
PASSAGE = "The quick brown fox jumps over the lazy dog near the old river. Then it sleeps under a tall green tree for hours. "


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{k % 977} and more, so." for k in range(40_000))
    rows = [
        (1, "A plain text with words. And a second line of it.", "en"),
        (1, "A plain text with words. And a second line of it.", "en"),
        (1, "Another text under the same id, of other words.", None),
        (2, None, "en"),
        (None, None, None),
        (None, "A row without an id. " + NOTICE, "en"),
        (3, "", "de"),
        (4, " \n\t ", "de"),
        (5, "1234 5678 !!! ...", None),
        (6, long, "en"),
        (7, long, "en"),
        (8, PASSAGE * 2, "en"),
        (9, "Before it. " + PASSAGE * 2 + "After it.", "en"),
        (10, "x", "en"),
        (11, "x", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return stored(df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]))


@pytest.fixture(scope="module")
def empty(messy):
    return stored(messy.limit(0))


def own(df):
    """Whether the clashing columns that came through still hold what they held."""
    kept = [c for c in CLASHES if c in df.columns]
    return df.select(F.bool_and(F.concat_ws("|", *kept) == "|".join(f"own {c}" for c in kept))).first()[0] is not False


def test_token_counts(messy, empty):
    trees = token_counts.build_trees(messy)
    assert trees.count() == 15 and trees.where("doc.id = 2 OR doc.id = 3").agg(F.sum("tokens")).first()[0] == 0
    edits = messy.sparkSession.createDataFrame(
        [(6, 1, 5, 3, "x"), (6, 0, 10**9, 5, " end"), (99, 0, 0, 1, "y"), (2, 0, 0, 0, "z"), (3, 0, 0, 0, "new"), (1, 0, -3, 2, None), (None, 0, 0, 1, "n")],
        "id long, seq int, start int, length int, replacement string",
    )
    after = {(r["doc"]["id"], r["doc"]["print"]): r for r in token_counts.apply_edits(messy, trees, edits).collect()}
    assert sorted(k[0] for k in after) == [1, 1, 3, 6]
    assert next(r["text"] for k, r in after.items() if k[0] == 3) == "new"
    assert token_counts.build_trees(empty).count() == 0 and token_counts.apply_edits(empty, token_counts.build_trees(empty), edits).count() == 0
    assert token_counts.masking_edits(empty).count() == 0 and token_counts.masking_edits(messy).where("id IS NULL").count() == 0


def test_simhash(messy, empty):
    got = simhash.simhash_groups(messy, width=3).collect()
    assert len(got) == 15
    wordless = {r["id"]: r["component"] for r in got if r["bits"] == 0}
    assert wordless == {2: 2, None: 2, 3: 2, 4: 2}
    assert {r["component"] for r in got if r["id"] in (6, 7)} == {6}
    assert {r["component"] for r in got if r["id"] in (10, 11)} == {10}
    kept = simhash.keep_one(messy)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for null, i in ids if not null] == [1, 1, 2, 5, 6, 8, 9, 10]
    assert sum(null for null, _ in ids) == 2 and kept.columns == messy.columns and own(kept)
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_quality(messy, empty):
    model = weak_quality.learn(messy)
    got = {r["id"]: r for r in weak_quality.score(messy, model).where("id IS NOT NULL").collect()}
    assert not got[2]["kept"] and not got[3]["kept"] and not got[4]["kept"] and 0 <= got[6]["quality"] <= 1
    nothing = weak_quality.learn(empty)
    assert weak_quality.score(empty, nothing).count() == 0
    assert weak_quality.score(messy, nothing).agg(F.max("quality")).first()[0] == 0.5


def test_graph(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 0.99, 0.01]), (11, [1.0, 0.0]), (12, [-0.0, 1e-300, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(0).alias("id"), F.lit(0).alias("vector"), F.lit(0).alias("n_links"))
    got = flat_graph.near_vectors(df).collect()
    assert len(got) == len(rows)
    found = sorted((r["id"], r["n_links"], r["component"], r["kept"]) for r in got if r["id"] is not None)
    assert found == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 2, 3, False), (11, 0, 11, True), (12, 2, 3, False)]
    )
    assert [(r["n_links"], r["component"], r["kept"]) for r in got if r["id"] is None] == [(0, None, False)]
    assert flat_graph.near_vectors(df.limit(0)).count() == 0


def test_decontamination(spark, messy, empty):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (None, "A plain text, with words"), (4, "")], "item_id long, text string")
    got = sorted((r["id"], r["item"]) for r in decontaminate.find_leaks(messy, items).where("id IS NOT NULL").collect() if r["item"])
    assert got == [(8, 1), (9, 1)]
    kept = decontaminate.drop_leaks(messy, items)
    assert kept.columns == messy.columns and own(kept) and kept.count() == 15 - 4
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(messy, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(messy, items.limit(0)).count() == 15


def test_languages(messy, empty):
    model = language_codes.train(messy, "lang", "text", "doc_id")
    assert set(model.languages) <= {"de", "en"}
    got = language_codes.identify(messy, model)
    assert got.count() == 15 and {r["lang_pred"] for r in got.where("doc_id IN (2, 3, 4, 5)").collect()} == {"und"}
    assert own(got.drop("lang_pred", "score", "ambiguous"))
    nothing = language_codes.train(empty, "lang", "text", "doc_id")
    assert nothing.languages == () and language_codes.identify(messy, nothing).where("lang_pred <> 'und'").count() == 0
    assert language_codes.identify(empty, model).count() == 0


def test_packing(messy, empty):
    got = packing.pack(messy).toPandas()
    assert len(got[got.piece == 0]) == 15 and got[got.id.isin([2, 3, 4])].length.tolist() == [1, 1, 1]
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    assert packing.pack(empty).count() == 0


def test_line_chunks(messy, empty):
    got = line_chunks.dedup_line_chunks(messy)
    assert got.count() == 15 and own(got.drop("removed_chunks", "removed_chars"))
    rows = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert {(2, None), (3, ""), (1, "A plain text with words. And a second line of it.")} <= rows
    assert next(r["text"] for r in got.collect() if r["doc_id"] == 7) in ("", "word919 and more, so.") or got.where("doc_id = 7").first()["removed_chunks"] > 100
    assert line_chunks.dedup_line_chunks(empty).count() == 0


def test_licenses(messy, empty):
    got = licenses.scan_licenses(messy).collect()
    assert [(r["id"], r["license"], r["dice"]) for r in got] == [(None, "MIT notice", 1.0)]
    assert licenses.scan_licenses(empty).count() == 0


def test_shards(messy, empty):
    got = kd_shards.kd_shards(messy, ["size", "lang", "doc_id"], shards=4).toPandas()
    assert len(got) == 15 and got[got.id.isin([2, 3])]["size"].tolist() == [16, 16]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert kd_shards.kd_shards(empty, ["size"], shards=4).count() == 0
    assert kd_shards.kd_shards(messy, ["size"], target_bytes=10**9).agg(F.max("shard")).first()[0] == 0


def test_stages_keep_columns(spark, messy, empty):
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SMALL))
            assert docs.columns == messy.columns, name
            assert own(docs), name
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_texts_without_edits_are_shuffled_once_at_most(spark):
    """Equal rows are looked for behind the join with the edits only."""
    from synthspark.llm import token_counts

    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e"), (3, None), (None, "x y")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 0, 1, "zz")], "id long, seq int, start int, length int, replacement string")
    out = token_counts.apply_edits(docs, token_counts.build_trees(docs), edits)
    assert [(r["doc"]["id"], r["text"], r["edits"]) for r in out.collect()] == [(1, "zz b c", 1)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    known = next(k for k, line in enumerate(lines) if "LogicalRDD" in line or "LocalRelation" in line)
    above, at = [], depth(lines[known])
    for line in reversed(lines[:known]):
        if depth(line) < at:
            at = depth(line)
            above.append(line.lstrip(" :+-").split(" ")[0])
    assert above.index("Join") < above.index("Aggregate")


def test_marks_lose_no_key(spark):
    from synthspark.llm import token_counts

    rows = spark.range(30_000).selectExpr("id", "hash(id) * 7L as print")
    wanted = rows.where("id % 50 = 0").withColumn("id", F.col("id").cast("int"))
    got = {r["id"] for r in token_counts._likely(rows, wanted, ["id", "print"]).collect()}
    assert set(range(0, 30_000, 50)) <= got and len(got) < 700
