"""Line dedup over content-defined chunks of lines.

A line ends at a line break or at the end of a sentence and keeps its delimiters, so the lines of a text joined again
are the text. Each line is hashed, a rolling hash covers a line and the one before it, and a chunk ends after each
line whose rolling hash is a strict minimum against the one before and none above the next one. A boundary hangs on
four lines around it only, so an insertion elsewhere does not move it, and two boundaries are never neighbours: all
chunks but a text's last have two lines or more.

Chunks of several lines are grouped by their bytes over the whole corpus. Every occurrence of a repeated chunk but the
first (smallest id, then position) is removed from its text. All steps are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

# A line, with its delimiters, in the syntax Java and RE2 share.
LINE = r"[^.!?\n]+[.!?\n ]*|[.!?\n ]+"
# Repeated chunks shorter than this are left alone.
MIN_CHARS = 40
OUTPUT = ("removed_chunks", "removed_chars")


def _lines(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), F.array().cast("array<string>"))


def _chunked(docs: DataFrame, text: str) -> DataFrame:
    """Input with ``_chunks``: an array of (text, number of lines) per document, empty for null and empty texts.

    Each array is a projection of its own, so that none is computed more than once per row.
    """
    rows = docs.withColumn("_lines", _lines(F.col(text)))
    rows = rows.withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x)))
    rows = rows.withColumn("_rolls", F.transform("_hashes", lambda h, i: F.md5(F.concat(F.coalesce(F.get("_hashes", i - 1), F.lit("")), h))))

    def starts(i: Column) -> Column:
        before, here, after = F.get("_rolls", i - 2), F.get("_rolls", i - 1), F.get("_rolls", i)
        return (i == 0) | ((i >= 2) & (here < before) & (here <= after))

    places = F.when(F.size("_rolls") > 0, F.sequence(F.lit(0), F.size("_rolls") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_places", places).withColumn("_starts", F.filter("_places", starts))

    def chunk(start: Column, k: Column) -> Column:
        count = F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - start
        return F.struct(F.array_join(F.slice("_lines", start + 1, count), "").alias("text"), count.alias("lines"))

    rows = rows.withColumn("_chunks", F.transform("_starts", chunk))
    return rows.drop("_lines", "_hashes", "_rolls", "_places", "_starts")


def dedup_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, prefix: str = "") -> DataFrame:
    """Input rows with repeated chunks taken out of ``text_col``, and ``removed_chunks`` and ``removed_chars`` (after ``prefix``).

    A document is its id and its text: rows equal in both are treated alike and do not count as each other's copies.
    Null ids come last when the first occurrence is chosen. A null text stays null, an empty one empty. Input columns
    named like the two added ones are replaced; all others are kept. An empty table gives an empty result.
    """
    added = [f"{prefix}{name}" for name in OUTPUT]
    docs = docs.drop(*added)
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    # The outer form: for the inner one Spark infers a filter on the array and pushes copies of its formula down.
    chunks = _chunked(keyed, "_text").select("_id", "_print", F.posexplode_outer("_chunks").alias("_at", "_chunk"))
    chunks = chunks.where((F.col("_chunk.lines") > 1) & (F.length("_chunk.text") >= min_chars))
    places = chunks.select("_id", "_print", "_at", F.unhex(F.md5("_chunk.text")).alias("_digest"))
    # Equal bytes make a group here; texts are not looked at again, so the groups are known by 128-bit digests below.
    same = chunks.select("_id", "_print", "_at", F.col("_chunk.text").alias("_bytes")).groupBy("_bytes").agg(F.count("*").alias("n"))
    repeated = same.where("n > 1").select(F.unhex(F.md5("_bytes")).alias("_digest"), F.lit(1).alias("one"))
    repeated = repeated.groupBy("_digest").agg(F.count("one").alias("texts")).where("texts = 1").select("_digest")
    found = stored(places.join(repeated, "_digest"), "line-chunks")
    rank = F.struct(F.col("_id").isNull().alias("last"), "_id", "_print", "_at")
    first = found.groupBy("_digest").agg(F.min(rank).alias("first"))
    again = found.join(first, "_digest").where(~rank.eqNullSafe(F.col("first")))
    gone = again.groupBy("_id", "_print").agg(F.collect_set("_at").alias("_gone"))
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_print").alias("_gone_print"), "_gone")

    # The input row travels as one struct, so that its column names cannot clash with those used here.
    prints = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_print"))
    joined = prints.join(gone, (prints["_print"] == gone["_gone_print"]) & prints["_id"].eqNullSafe(gone["_gone_id"]), "left")
    # Taken out of the row behind the join, so that a text travels once.
    joined = joined.select("_row", "_gone", F.col("_row")[text_col].alias("_text"))
    # Only texts that lose something are cut again.
    joined = joined.withColumn("_cut", F.when(F.col("_gone").isNotNull(), F.col("_text")))
    rows = _chunked(joined, "_cut")
    every = F.sequence(F.lit(0), F.size("_chunks") - 1)
    rows = rows.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.array_sort(F.array_except(every, F.col("_gone")))))
    rest = F.array_join(F.transform("_kept", lambda k: F.get("_chunks", k)["text"]), "")
    rows = rows.withColumn("_rest", F.when(F.col("_gone").isNotNull(), rest).otherwise(F.col("_text")))
    lost = F.coalesce(F.length("_text") - F.length("_rest"), F.lit(0))
    made = F.struct(F.col("_rest").alias("_rest"), F.coalesce(F.size("_gone"), F.lit(0)).alias("_count"), lost.alias("_lost"))
    # The generator keeps later filters on the result from being pushed down as copies of these formulas.
    rows = rows.select("_row", F.inline(F.array(made)))
    return rows.select(*[F.col("_rest").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns], F.col("_count").alias(added[0]), F.col("_lost").alias(added[1]))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that earlier documents have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_line_chunks(docs)


SQL = f"""
WITH lines AS (
  SELECT d, doc_id, text, u.i AS i, u.line AS line FROM (
    SELECT row_number() OVER () AS d, doc_id, text, regexp_extract_all(text, '{LINE.replace(chr(92) + "n", chr(10))}') AS ls FROM documents
  ), LATERAL (SELECT generate_subscripts(ls, 1) AS i, unnest(ls) AS line) u
), rolls AS (
  SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS r FROM lines WINDOW w AS (PARTITION BY d ORDER BY i)
), starts AS (
  SELECT *, CASE WHEN i = 1 OR (lag(r, 1) OVER w < lag(r, 2) OVER w AND lag(r, 1) OVER w <= r) THEN 1 ELSE 0 END AS s
  FROM rolls WINDOW w AS (PARTITION BY d ORDER BY i)
), numbered AS (
  SELECT *, sum(s) OVER (PARTITION BY d ORDER BY i) AS k FROM starts
), chunks AS (
  SELECT d, doc_id, k, string_agg(line, '' ORDER BY i) AS chunk, count(*) AS n FROM numbered GROUP BY d, doc_id, k
), marked AS (
  SELECT *, n > 1 AND length(chunk) >= {MIN_CHARS} AS candidate,
    row_number() OVER (PARTITION BY chunk, n > 1 AND length(chunk) >= {MIN_CHARS} ORDER BY doc_id, k) AS nth
  FROM chunks
), kept AS (
  SELECT d, string_agg(chunk, '' ORDER BY k) FILTER (NOT candidate OR nth = 1) AS rest,
    count(*) FILTER (candidate AND nth > 1) AS gone
  FROM marked GROUP BY d
), docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text,
  CAST(coalesce(gone, 0) AS INT) AS removed_chunks,
  CAST(coalesce(length(text) - length(coalesce(rest, '')), 0) AS INT) AS removed_chars
FROM docs LEFT JOIN kept USING (d)
"""
