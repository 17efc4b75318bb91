"""Language identification with error-correcting output codes.

Every language gets a codeword of plus and minus ones. For each bit one logistic scorer over hashed byte n-grams is
trained to tell the languages whose bit is plus from the others. A text goes to the language whose codeword has the
smallest weighted logistic loss against the scorers' outputs; a bit weighs more for a language on which its scorer
erred less. If two codewords are about as near, or the signs are further from the best one than the code can repair,
the text is flagged as ambiguous.

The scorers are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``); every text is predicted whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
# Most labelled rows that are learned from, over all languages together: the documented bound of the fit.
SAMPLE_ROWS = 2400
# Hashed n-grams of one, two and three bytes.
BUCKETS = 1 << 12
# Probability by which the best language must lead the second.
MARGIN = 0.1
_FOLDS = 4
_STEPS = 120
_RIDGE = 1e-4
_SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
# Everything in ASCII that is no letter reads as a space.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares: a unit vector of ``BUCKETS`` numbers."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(data), _SLICE):
        # Slices overlap by two bytes, so that each n-gram is counted once.
        one = np.frombuffer(data[max(0, at - 2) : at + _SLICE], np.uint8).astype(np.uint32)
        own = one[min(at, 2) :]
        two = (one[:-1] << np.uint32(8) | one[1:])[min(at, 1) :] if at else one[:-1] << np.uint32(8) | one[1:]
        three = one[:-2] << np.uint32(16) | one[1:-1] << np.uint32(8) | one[2:]
        for salt, grams in ((0x9E3779B1, own), (0x85EBCA6B, two), (0xC2B2AE35, three)):
            counts += np.bincount(grams * np.uint32(salt) + np.uint32(salt >> 7) >> shift, minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """``classes`` rows of plus and minus ones with distinct, non-constant columns and far-apart rows.

    Up to five languages get all columns there are; more get the best of several drawn codes of about ten times
    the logarithm of their number.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    bits = math.ceil(10 * math.log2(classes))
    best, widest = np.empty(0), -1
    rng = np.random.default_rng(classes)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), size=(classes, bits))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        near = (bits - code.astype(np.int64) @ code.T + 2 * bits * np.eye(classes)).min() / 2
        if near > widest:
            best, widest = code, near
    return best


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, the scorers (one column each, last row the constant) and the bits' weights."""

    languages: tuple[str, ...]
    code: np.ndarray
    scorers: np.ndarray
    weights: np.ndarray
    repairable: int

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, its probability and whether the choice is ambiguous."""
        outputs = x @ self.scorers[:-1] + self.scorers[-1]
        loss = (self.weights * np.logaddexp(0.0, -self.code * outputs)).sum(axis=1) * self.code.shape[1]
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        best = int(order[0])
        lead = chance[best] - (chance[order[1]] if len(order) > 1 else 0.0)
        wrong = int(((self.code[best] * outputs) < 0).sum())
        return self.languages[best], float(chance[best]), bool(lead < MARGIN or wrong > self.repairable)


def _logistic(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Logistic scorers for all bits at once by accelerated gradient steps; each bit's two sides weigh the same."""
    rows, width = x.shape
    weights = np.zeros((width + 1, signs.shape[1]))
    ahead = weights.copy()
    plus = (signs > 0).sum(axis=0)
    share = np.where(signs > 0, 0.5 / np.maximum(plus, 1), 0.5 / np.maximum(rows - plus, 1))
    # Rows are unit vectors beside a constant one, so the curvature is at most half of the weight sum.
    step = 1 / (0.5 + _RIDGE)
    for k in range(_STEPS):
        out = x @ ahead[:-1].astype(np.float32) + ahead[-1]
        pull = -signs * share / (1 + np.exp(np.clip(signs * out, -50, 50)))
        grad = np.vstack([x.T @ pull.astype(np.float32), pull.sum(axis=0, keepdims=True)]) + _RIDGE * ahead
        new = ahead - step * grad
        ahead = new + (new - weights) * (k / (k + 3))
        weights = new
    return weights


def fit_codes(x: np.ndarray, labels: list[str]) -> LanguageModel:
    """Model from feature rows and their languages; row order does not matter beyond rounding."""
    languages = tuple(sorted(set(labels)))
    place = {name: k for k, name in enumerate(languages)}
    y = np.array([place[v] for v in labels], np.int64)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((BUCKETS + 1, 1)), np.ones_like(code, float), 0)
    signs = code[y].astype(np.float64)
    # Weights come from rows a scorer was not fitted on.
    right = np.full((len(languages), code.shape[1]), 0.5)
    seen = np.ones((len(languages), 1))
    for fold in range(_FOLDS):
        test = np.arange(len(y)) % _FOLDS == fold
        if test.all() or not test.any():
            continue
        part = _logistic(x[~test], signs[~test])
        hit = (x[test] @ part[:-1] + part[-1]) * signs[test] > 0
        np.add.at(right, y[test], hit)
        np.add.at(seen, y[test], 1.0)
    weights = right / seen
    scale = 10.0  # Unit feature vectors give small outputs; the scale sharpens the loss and leaves every sign.
    scorers = _logistic(x, signs) * scale
    gaps = (code.shape[1] - code.astype(np.int64) @ code.T) // 2
    nearest = int(gaps[~np.eye(len(languages), dtype=bool)].min())
    return LanguageModel(languages, code, scorers, weights / weights.sum(axis=1, keepdims=True), max(0, (nearest - 1) // 2))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(rows, at)], pa.binary())],
            ["lang", "places", "shares"],
        )


def train(labelled: DataFrame, lang_col: str, text_col: str, key_col: str, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``sample_rows`` rows, spread evenly over the languages and picked by a hash of ``key_col``.

    Rows without a language or without letters teach nothing. The sample bounds the languages too: each needs
    ``_FOLDS`` rows, and only if there are more languages than that allows the rarest are not learned. An empty table
    gives a model without languages.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(key_col).cast("string"), F.lit("languages")).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # One row per language: bounded by sample_rows below, so it goes to every task and the texts are not shuffled.
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, sample_rows // _FOLDS)).collect()
    if not counted:
        return fit_codes(np.zeros((0, BUCKETS), np.float32), [])
    share = sample_rows // len(counted)
    sizes = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counted], "lang string, n bigint"))
    # Twice the wanted share passes the hash test, so that the ranking sees a bounded number of rows per language.
    reach = F.least(F.lit(1.0), F.lit(2.0 * share) / F.col("n"))
    passed = rows.join(sizes, "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.ceil(reach * (1 << 20)))
    ranked = passed.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))).where(F.col("nth") <= share)
    taken = ranked.select("lang", "text").mapInArrow(_sparse, "lang string, places binary, shares binary").toArrow()
    order = sorted(zip(*(taken.column(c).to_pylist() for c in ("lang", "places", "shares"))))
    x = np.zeros((len(order), BUCKETS), np.float32)
    for row, (_, places, shares) in zip(x, order):
        row[np.frombuffer(places, np.int32)] = np.frombuffer(shares, np.float32)
    return fit_codes(x, [lang for lang, _, _ in order])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Input rows with ``lang_pred``, ``score`` and ``ambiguous`` behind them (names after ``prefix``).

    Null, empty and letterless texts, and all texts under a model without languages, are ``und`` with score 0 and
    not ambiguous. Input columns of the three names are replaced. Very long texts are read in slices.
    """
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}ambiguous"]
    rows = docs.drop(*names)
    place = rows.columns.index(text_col)
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for value in batch.column(place):
                text = value.as_py()
                usable = bool(known.languages) and has_letter(text)
                found.append(known.decode(features(text)) if usable else (UNKNOWN, 0.0, False))
            added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def fold(key) -> F.Column:
    """Remainder that keeps a fifth of the documents out of learning; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def document_model(docs: DataFrame) -> LanguageModel:
    """Model from the documents that are not held out."""
    return train(docs.where(fold("doc_id") != 0), "lang", "text", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a fifth is held out of learning. A null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), document_model(docs))
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
