"""Line dedup: lines that many documents share go from all but the first of these."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, key_to_id, materialize

WHITE = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line stripped of ASCII white space with A-Z lower-cased; None for a key that is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (key, tie, line): the different line keys of each row of ``docs``; ``tie`` tells texts of one doc_id apart."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, ties, lines = [], [], []
            for key, tie, text in zip(pdf["key"], pdf["tie"], pdf["text"]):
                own = {line_key(x, min_chars) for x in (text or "").encode().split(b"\n")} - {None}
                keys += [key] * len(own)
                ties += [tie] * len(own)
                lines += own
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "tie": pd.Series(ties, dtype="int64"), "line": pd.Series(lines, dtype=object)})

    return _texts(docs).mapInPandas(explode, "key long, tie long, line binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("key"), F.xxhash64("text").alias("tie"), "text")


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (key, tie, lines): for each text that loses lines, the keys of these lines.

    Lines are exploded and written once. Counts are of different documents. A hot line is counted by partial aggregates, and the join that brings
    the counts back splits its rows, since the other side has one row for each line. The array of a text has no more
    lines than the text; the document of least doc_id (the null one, if there is any) keeps its lines.
    """
    pairs = materialize(line_keys(docs, min_chars).distinct(), "lines")
    held = pairs.select("line", "key").distinct()
    shared = held.groupBy("line").agg(F.count("*").alias("n"), F.min("key").alias("first")).where(F.col("n") >= min_docs).select("line", "first")
    return pairs.join(shared, "line").where("key != first").groupBy("key", "tie").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (key, n_lines, n_dropped, kept) for every row of ``docs`` (doc_id, text).

    A line is stripped of ASCII white space and A-Z lower-cased for comparison; if its key has at least
    ``min_chars`` code points and at least ``min_docs`` documents have it, it goes from all documents but the
    one of smallest doc_id, which keeps every such line. Others stay in place, joined by newlines. Null and
    empty texts have one empty line, which is too short to go. Rows that repeat a doc_id are one document:
    a line that only they share stays.
    """

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, gone in zip(pdf["text"], pdf["lines"]):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if gone is not None:
                    gone = set(map(bytes, gone))
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            n, dropped, kept = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"key": pdf["key"], "n_lines": pd.Series(n, dtype="int64"), "n_dropped": pd.Series(dropped, dtype="int64"), "kept": pd.Series(kept, dtype=object)})

    joined = _texts(docs).join(shared_lines(docs, min_chars, min_docs), ["key", "tie"], "left")
    return joined.mapInPandas(drop, "key long, n_lines long, n_dropped long, kept string")


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(key_to_id("key").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM docs),
keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.nth, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
