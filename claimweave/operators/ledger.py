"""Stored tables: commits over several tables at once, appends that may be replayed, and the reports that they keep.

A commit writes each table's new rows into a staged folder and then one manifest that names them all; readers see the tables of the last manifest
only. A commit that breaks, or that finds that another has come first, leaves everything as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answers, store

#: Days that a session is kept, and most characters of its texts (fixed values).
KEPT_DAYS, LONGEST_QUESTION, LONGEST_TITLE, LONGEST_SNIPPET, LONGEST_EVIDENCE = 90, 1_000, 400, 500, 600
#: Most characters of an error's message, detail and context (fixed values).
ERROR_LIMITS = {"message": 1_000, "detail": 2_000, "context": 1_000}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder of the context.

    A local master without either gets one of its own; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="claimweave-")


def _files(spark: SparkSession, path: str):
    """(path, file system) of a path of any store that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Conflict(Exception):
    """Another commit came first: read the tables anew and try again."""


class Ledger:
    """Tables under one folder that change together. Manifests are numbered; the last one holds the folder of each table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """Number of the last commit, 0 before any."""
        where, files = _files(self.spark, f"{self.root}/manifests")
        if not files.exists(where):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        where, files = _files(self.spark, f"{self.root}/manifests/{version:012d}.json")
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema, version: int | None = None) -> DataFrame:
        """A table as of a commit (the last one); empty where it has none yet."""
        path = self._manifest(self.version() if version is None else version).get(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], based_on: int | None = None) -> int:
        """Write whole new contents of some tables as one commit; the others stay. Returns its number.

        ``based_on`` is the commit that the contents were worked out from (the last one).
        """
        base = self.version() if based_on is None else based_on
        staged, held = f"{self.root}/data/{uuid.uuid4().hex}", self._manifest(base)
        try:
            for name, df in tables.items():
                df.write.parquet(f"{staged}/{name}")
                held[name] = f"{staged}/{name}"
            self._publish(base + 1, held)
        except BaseException:
            where, files = _files(self.spark, staged)
            files.delete(where, True)
            raise
        return base + 1

    def _publish(self, version: int, manifest: dict[str, str]) -> None:
        """Create a manifest if there is none of its number: the file is made in full elsewhere and then renamed."""
        draft, files = _files(self.spark, f"{self.root}/drafts/{uuid.uuid4().hex}")
        target, _ = _files(self.spark, f"{self.root}/manifests/{version:012d}.json")
        files.mkdirs(target.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise Conflict(f"commit {version} exists")


# --- reports -------------------------------------------------------------------------------------

SESSION = "cache_key string, question string, normalized string, intent string, verdict string, score int, level string, report string, user_id string, duration_ms long, cost_usd double, expires_at timestamp"
SOURCE = "cache_key string, url string, domain string, title string, snippet string, tier int, quality double, fetched boolean"
CLAIM = "cache_key string, source_url string, claim string, evidence_text string, strength double, ordinal int"
SEARCH = "cache_key string, user_id string, query string, normalized string, intent string, run_id string"


def _cut(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    return df.withColumns({name: F.substring(name, 1, most) for name, most in limits.items() if name in df.columns})


def persist_reports(ledger: Ledger, sessions: DataFrame, sources: DataFrame, claims: DataFrame, now: Column) -> int:
    """Store a batch of reports as one commit over sessions, sources, claims and searches.

    ``sessions`` has the columns of SESSION without expires_at and run_id, one row a cache_key; ``sources`` and ``claims`` have ``ordinal`` besides. A new session expires
    90 days after ``now``, a stored one keeps what it was asked and when it expires. Of a report 25 sources and 60 claims are kept; claims only where the
    session has none. Each run adds a search, once however often its ``run_id`` is given.
    """
    base = ledger.version()
    held = {name: ledger.read(name, schema, base) for name, schema in (("sessions", SESSION), ("sources", SOURCE), ("claims", CLAIM), ("searches", SEARCH))}
    new = _cut(sessions, {"question": LONGEST_QUESTION, "normalized": LONGEST_QUESTION}).withColumn("expires_at", now.cast("timestamp") + F.expr(f"INTERVAL {KEPT_DAYS} DAYS"))
    rows = new.select(*held["sessions"].columns)
    pages = _cut(sources, {"title": LONGEST_TITLE, "snippet": LONGEST_SNIPPET}).select(*held["sources"].columns, "ordinal")
    merged = answers.merge_reports((held["sessions"], held["sources"].withColumn("ordinal", F.lit(None).cast("int")), held["claims"]), (rows, pages, _cut(claims, {"evidence_text": LONGEST_EVIDENCE}).select(*held["claims"].columns)))
    searches = new.select("cache_key", "user_id", F.col("question").alias("query"), "normalized", "intent", "run_id")
    return ledger.commit(
        {"sessions": merged[0], "sources": merged[1].drop("ordinal"), "claims": merged[2], "searches": store.insert_if_absent(held["searches"], searches.dropDuplicates(["run_id"]), ["run_id"])},
        base,
    )


# --- appends -------------------------------------------------------------------------------------


def error_records(failures: DataFrame) -> DataFrame:
    """Failures of providers as they are stored: texts cut, and not retryable unless said so."""
    return _cut(failures, ERROR_LIMITS).withColumn("retryable", F.coalesce("retryable", F.lit(False)))


def append_batches(path: str):
    """A ``foreachBatch`` function that stores each batch in a folder of its number, so that a batch given again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that :func:`append_batches` has stored; none where nothing has been."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(path).drop("batch")


def run_stream(stream: DataFrame, path: str, schema: str) -> DataFrame:
    """Store all that a stream holds now by :func:`append_batches`, and read it back. A second call goes on where the first ended."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(append_batches(f"{path}/rows")).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return appended(spark, f"{path}/rows", schema)
