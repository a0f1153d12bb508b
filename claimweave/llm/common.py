"""Pieces that several operators share: the shared workspace, document keys, byte-level word tables.

Rules that hold for every operator of this subpackage unless its docstring says otherwise:

* a null text is an empty text;
* a null ``doc_id`` is one document that sorts before all others (its key is the smallest long);
* only the named input columns are read, so extra columns cannot clash with internal ones; operators that return
  all columns take internal names that the table does not have;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of a document without an id.
NULL_KEY = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables of this session that :func:`materialize` has written and :func:`release` has not deleted.
_written: list[DataFrame] = []


def workspace(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, the checkpoint folder of the Spark context is used; a local master, which has no other
    machines, gets one. Elsewhere that is an error: a folder of one machine would lose tables.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="claimweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, which cuts the lineage.

    Later reads survive the loss of any executor, and non-deterministic row orders are fixed. The table stays
    until :func:`release`, the end of a :func:`scratch` block around it, or the end of the session.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimweave_path = path
    _written.append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no plan reads any more."""
    path = getattr(df, "_claimweave_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written[:] = [t for t in _written if t is not df]


@atexit.register
def _release_all() -> None:
    """What a session's queries have left behind goes with the session."""
    for table in list(_written):
        with suppress(Exception):  # the session or its store may be gone already
            release(table)


@contextmanager
def scratch(*keep: DataFrame):
    """Delete the tables written within the block at its end, but those put into the list that it yields."""
    before, kept = list(_written), list(keep)
    yield kept
    for table in [t for t in _written if not any(t is k for k in [*before, *kept])]:
        release(table)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key(name: str = "doc_id") -> Column:
    """The id as a long, null as NULL_KEY (an id that is NULL_KEY itself counts as null)."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def text_tie(name: str = "text") -> Column:
    """MD5 of a text (null like empty): tells rows of one doc_id apart."""
    return F.md5(whole_text(name))


def distinct_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each different (key, tie, text) of ``docs`` once. ``rows`` has key and tie of all rows, so only repeated ones are grouped."""
    texts = docs.select(doc_key().alias("key"), text_tie().alias("tie"), whole_text().alias("text"))
    repeated = rows.groupBy("key", "tie").agg(F.count("*").alias("n")).where("n > 1").select("key", "tie")
    if repeated.isEmpty():
        return texts
    once = texts.join(repeated, ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.min("text").alias("text"))
    return texts.join(repeated, ["key", "tie"], "left_anti").unionByName(once)


def key_to_id(key: str) -> Column:
    return F.when(F.col(key) != NULL_KEY, F.col(key))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# --- words of many texts at once, without a Python object per word ------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of ``x`` over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class WordTable:
    """Words of a block of texts as arrays: 64-bit hash, text number and position in the text.

    ``word_bytes[b]`` says if byte b belongs to words. Words are the maximal runs of such bytes; their
    hash depends on their bytes alone. Texts are worked on in blocks of at most ``BLOCK`` bytes (or one
    text), so memory is bounded by the longest text.
    """

    BLOCK = 1 << 20

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, dtype=np.uint8)
        inside = word_bytes[raw]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_MULT, len(raw)), out=sums[1:])
            self.hash = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        limits = np.cumsum(lengths)
        self.text = np.searchsorted(limits, starts, side="right")
        self.counts = np.bincount(self.text, minlength=len(texts)) if len(starts) else np.zeros(len(texts), dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.position = np.arange(len(starts)) - self.first[self.text] if len(starts) else np.zeros(0, dtype=np.int64)


def text_blocks(texts: list[bytes], limit: int = WordTable.BLOCK):
    """Yield (first, last) so that texts[first:last] hold at most ``limit`` bytes, or are one text."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if k > first and held + len(t) > limit:
            yield first, k
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def char_blocks(texts: list[str | None], limit: int = WordTable.BLOCK):
    """Yield (first, last) so that texts[first:last] have at most ``limit`` code points, or are one text."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > first and held + n > limit:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each run of n word hashes; fewer words give one of all."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * np.uint64(0x100000001B3) + words[k : len(words) - n + 1 + k]
    return mix64(out)


#: ASCII letters, digits and every byte of a non-ASCII character are word bytes.
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Every byte but ASCII white space.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[0x20, *range(0x09, 0x0E)]] = False
