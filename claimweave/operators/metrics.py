"""Usage metrics over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Count and share of the total by value."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.join(total).withColumn("percent", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("long")).drop("total")


def popular(df: DataFrame, by: str, k: int = 15) -> DataFrame:
    """The ``k`` most frequent values; empty ones are dropped after the cut."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k).where(F.col(by).cast("string") != "")


def latest_errors(df: DataFrame, key: Column, ts: str, tie: str, latest: int = 500, k: int = 10) -> DataFrame:
    """The most frequent keys among the latest rows, with the time last seen."""
    recent = df.orderBy(F.desc(ts), F.desc(tie)).limit(latest)
    return recent.groupBy(key.alias("error_key")).agg(F.count("*").alias("n"), F.max(ts).alias("last_seen")).orderBy(F.desc("n"), "error_key").limit(k)


def filtered_sums(df: DataFrame, by: str, area: str, value: str, areas: tuple[str, ...]) -> DataFrame:
    """Count and sum for each area in one pass."""
    aggregates = []
    for a in areas:
        aggregates += [F.count_if(F.col(area) == a).alias(f"n_{a}"), F.coalesce(F.sum(F.when(F.col(area) == a, F.col(value))), F.lit(0.0)).alias(f"sum_{a}")]
    return df.groupBy(by).agg(*aggregates)


def page(df: DataFrame, by: list[str], take: int, skip: int, *order: Column) -> DataFrame:
    """One page of each group's rows."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(window)).where(F.col("nth").between(skip + 1, skip + take))
