"""Columns that are worked out once for each row, and rows that are dealt out before work on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that no later filter, lambda or projection works out again.

    The optimiser writes a column's expression into each filter that it pushes below the projection, and from there into lambdas, which read it for every element.
    Nothing is pushed below a generator, and a generator of one row costs next to nothing.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def bind(x: Column, f) -> Column:
    """``f(x)`` with x worked out once, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys for work on each row: rows of one file would else be one task, and small rows that cost much time would be put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows with an equal key are so many groups at most.
GROUPS = 64


def with_shared(df: DataFrame, key: str, apart: list[str], **columns: Column) -> DataFrame:
    """``df`` with columns that ``key`` alone decides, worked out for one row of a group and taken over by the others.

    Pages repeat many sentences, and a shuffle of a text costs a fraction of patterns over it. Rows of a key are parted into groups by ``apart``, so that a frequent
    key is not one task: it is worked out for each of its groups.
    """
    rows = dealt(df.withColumn("_group", F.pmod(F.xxhash64(*apart), F.lit(GROUPS))), key, "_group")
    group = Window.partitionBy(key, "_group")
    # a lambda keeps the work out of generated code, whose methods would be too long to be compiled
    worked = F.get(F.transform(F.array(F.lit(0)), lambda _: F.struct(*[v.alias(k) for k, v in columns.items()])), F.lit(0))
    first = rows.withColumn("_nth", F.row_number().over(group.orderBy(*apart))).withColumn("_first", F.when(F.col("_nth") == 1, worked))
    return first.withColumn("_shared", F.first("_first", ignorenulls=True).over(group)).select(*df.columns, "_shared.*")
