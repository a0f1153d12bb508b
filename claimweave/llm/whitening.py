"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations on the driver, and a broadcast whitening matrix."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, key_to_id, materialize

SCALE, COMPONENTS = 256, 4
#: The driver holds one matrix of dimension by dimension; embeddings of more entries are refused.
MAX_DIMENSION = 4096
#: Rows that are centred and multiplied at once have so many entries together.
BLOCK = 1 << 20
LONG_MAX = 2**63 - 1


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric positive semidefinite matrix by cyclic Jacobi rotations.

    A sweep meets each pair of rows once, in the order of a round-robin tournament, whose rounds are rotations of disjoint pairs. A pair is
    rotated while its off-diagonal entry is larger than the rounding error of *its own* diagonal entries, so that small
    eigenvalues are as accurate, relatively, as large ones; it ends when a sweep rotates none.
    """
    n = len(matrix)
    a, v = np.array(matrix, dtype=np.float64), np.eye(n)
    ring = np.arange(n + n % 2)
    tiny, least = np.finfo(np.float64).eps, np.finfo(np.float64).tiny
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = np.maximum(p, q) < n
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            off, x, y = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > np.maximum(tiny * np.sqrt(np.abs(x * y)), least)
            p, q, off, x, y = p[go], q[go], off[go], x[go], y[go]
            if len(p):
                turned = True
                half = (y - x) / (2 * off)
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                columns_p, columns_q = a[:, p], a[:, q]
                a[:, p], a[:, q] = c * columns_p - s * columns_q, s * columns_p + c * columns_q
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = x - t * off, y + t * off
                vectors_p, vectors_q = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vectors_p - s * vectors_q, s * vectors_p + c * vectors_q
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def grid_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (key, x): entries as longs floor(scale * c). Vectors that are null or hold null or non-finite entries go.

    Entries beyond a long become its nearest end.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return embeddings.where(fine).select(doc_key("vec_id").alias("key"), F.transform(vector, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in vectors])


def _totals(fit: DataFrame, dimension: int) -> list[int]:
    """The number of vectors, then their exact sums: one row of a task for each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, [0] * dimension
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["x"])
                n += len(x)
                fits = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0**62
                part = x.sum(axis=0).tolist() if fits else x.astype(object).sum(axis=0).tolist()
                sums = [s + p for s, p in zip(sums, part)]
        yield pd.DataFrame({"i": range(dimension + 1), "s": [Decimal(k) for k in (n, *sums)]})

    rows = fit.mapInPandas(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    return [int(r.s) for r in sorted(rows, key=lambda r: r.i)]


def _scatter(rows: DataFrame, width: int, centred) -> np.ndarray:
    """Sum of y y' over all rows, where ``centred`` makes the rows y of a block; a task gives each entry of its sum once."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            step = max(1, BLOCK // len(pdf["x"].iloc[0])) if len(pdf) else 1
            for k in range(0, len(pdf), step):
                y = centred(_matrix(pdf["x"].iloc[k : k + step]))
                total += y.T @ y
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    found = rows.mapInPandas(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((width, width))
    out[found["i"], found["j"]] = found["s"]
    return out + np.triu(out, 1).T


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; None where it is beyond a long."""
    reach = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + float(max(map(abs, sums), default=0))
    if reach * reach * x.shape[1] < 2.0**62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1).tolist()
    return [d if d <= LONG_MAX else None for d in found]


_SCHEMA = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for every vector that is fit for it and each component.

    Each distinct vector of the grid counts once for the fit, whose mean and scatter are sums over all of them; only these, as many numbers
    as the dimension and its square, reach the driver. Components go by falling eigenvalue. Vectors of another length than the most common
    one (of equals the longest) go, as they have no covariance with the others. A component without variance cannot
    be whitened and has no rows; so there are fewer than ``components`` where the dimension or the number of distinct vectors is small, and none for an empty table.
    Repeated rows are returned as often. A ``deviation`` beyond a long is null.
    """
    spark = embeddings.sparkSession
    grid = grid_vectors(embeddings, scale)
    common = grid.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    if common is None or not common["size"]:
        return spark.createDataFrame([], _SCHEMA)
    dimension = common["size"]
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of {dimension} entries; the driver holds a matrix of {MAX_DIMENSION} by {MAX_DIMENSION} at most")
    grid = grid.where(F.size("x") == dimension)
    fit = materialize(grid.select("x").distinct(), "fit")
    n, *sums = _totals(fit, dimension)
    # x - S/n as one division of exact integers where they fit a double, so a mean of many equal vectors leaves no dust
    mean = np.array([s / n for s in sums])
    values, vectors = jacobi(_scatter(fit, dimension, lambda x: x - mean) / n)
    trace = float(values.sum())
    real = int((values[:components] > trace * dimension * np.finfo(np.float64).eps).sum()) if trace > 0 else 0
    if not real:
        return spark.createDataFrame([], _SCHEMA)
    matrix = vectors[:, :real] / np.sqrt(values[:real])
    # the covariance of what is returned, over the fit list: a column of ones gives its means
    moments = _scatter(fit, real + 1, lambda x: np.hstack([(x - mean) @ matrix, np.ones((len(x), 1))])) / n
    covariance = moments[:real, :real] - np.outer(moments[:real, real], moments[:real, real])
    error = float(np.abs(covariance - np.eye(real)).max())
    explained = (values[:real] / trace).tolist()
    shared = spark.sparkContext.broadcast((mean, matrix))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, matrix = shared.value
        for pdf in batches:
            step = max(1, BLOCK // dimension)
            for k in range(0, len(pdf), step):
                part = pdf.iloc[k : k + step]
                x = _matrix(part["x"])
                out = pd.DataFrame({"key": part["key"].repeat(real).reset_index(drop=True)})
                out["component"] = np.tile(np.arange(1, real + 1, dtype=np.int32), len(x))
                out["n"] = n
                out["deviation"] = pd.Series(deviations(x, n, sums), dtype="Int64").repeat(real).reset_index(drop=True)
                out["whitened"] = ((x - mean) @ matrix).ravel()
                out["explained"] = np.tile(explained, len(x))
                out["identity_error"] = error
                yield out

    return grid.mapInPandas(project, _SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all of ``embeddings``."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(key_to_id("key").alias("vec_id"), *found.columns[1:])
