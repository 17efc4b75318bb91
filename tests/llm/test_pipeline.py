"""The pipeline against plain versions of its stages on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from synthspark.llm import language_codes, packing
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_near_copies import plain


def test_pipeline_against_plain_stages(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_codes.document_model(table)
    docs = []
    for i, text in table.select("doc_id", "text").collect():
        if language_codes.has_letter(text) and not model.decode(language_codes.features(text))[2]:
            docs.append((i, text))
    cleaned = brute.without_repeated_chunks(docs)
    docs = [(i, cleaned[i]) for i, text in docs if cleaned[i] == text or cleaned[i].strip()]
    roots = plain(docs)
    docs = [(i, t) for i, t in docs if roots[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in brute.leaks(docs, items)}
    assert bad
    encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode
    want = {}
    for i, text in docs:
        if i not in bad:
            ids = [*encode(text or "", add_special_tokens=False).ids, 1]
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = ids[start : start + 4096]
                want[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
