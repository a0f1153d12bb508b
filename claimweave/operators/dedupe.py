"""Keep-best deduplication, first appearances and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by ``order``; the order must be total within a group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def fold_best(df: DataFrame, keys: list[str], ordinal: str, fields: list[str], replaces) -> DataFrame:
    """One row for each key: rows in order of ``ordinal``, the held one gives way where ``replaces(held, new)``.

    For rules that no sort key expresses. A group is one url's results, so it is small.
    """
    row = F.struct(ordinal, *fields)
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    best = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))), F.get("_rows", F.lit(0)), lambda held, new: F.when(replaces(held, new), new).otherwise(held))
    return rows.select(*keys, best.alias("_best")).select(*keys, "_best.*")


def better_result(held: Column, new: Column) -> Column:
    """A result with content beats one without; else the higher score, or a longer snippet than a short one."""
    higher = (F.coalesce(new["score"], F.lit(0.0)) > F.coalesce(held["score"], F.lit(0.0))) & (new["full"] == held["full"])
    longer = (held["said"] < 60) & (new["said"] > held["said"])
    return (new["full"] & ~held["full"]) | higher | longer


def dedupe_results(results: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Search results (question_id, canonical, ordinal, score, snippet, content and ``more``): the best of each address, with the best score.

    The fold sees lengths only; the winner's contents are joined to it, so an address never gathers the contents of all its results. Ordinals
    are different within a question and address.
    """
    key = ["question_id", "canonical"]
    small = results.select(*key, "ordinal", "score", F.length("snippet").alias("said"), (F.coalesce(F.length("content"), F.lit(0)) > 0).alias("full"))
    best = fold_best(small, key, "ordinal", ["score", "said", "full"], better_result).select(*key, "ordinal")
    top = results.groupBy(*key).agg(F.max("score").alias("_top"))
    won = results.select(*key, "ordinal", "snippet", "content", *more).join(best.join(top, key), [*key, "ordinal"])
    return won.withColumn("score", F.nullif(F.col("_top"), F.lit(0.0))).select(*key, "ordinal", "score", "snippet", "content", *more)


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """The strongest claim for each (question, domain, kind, device, part, set of model numbers)."""
    keyed = claims.withColumn("_skus", F.array_join(F.array_sort("model_numbers"), ","))
    return first_by(keyed, ["question_id", "source_domain", "claim", "device_canonical", "part_canonical", "_skus"], F.desc("strength"), F.asc("ordinal")).drop("_skus")


def independence(df: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """The first page of each domain scores 1.0, later ones 0.35."""
    window = Window.partitionBy(*by).orderBy(ordinal)
    return df.withColumn("independence", F.when(F.row_number().over(window) == 1, 1.0).otherwise(0.35))


def citation_numbers(df: DataFrame, by: list[str], item: str, ordinal: str) -> DataFrame:
    """Items numbered by first appearance."""
    first = F.min(ordinal).over(Window.partitionBy(*by, item))
    return df.withColumn("_first", first).withColumn("ref", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_first")


def with_neighbours(df: DataFrame, by: list[str], ordinal: str, hit: Column, reach: int = 1) -> DataFrame:
    """Rows that are hits or stand within ``reach`` rows of one."""
    window = Window.partitionBy(*by).orderBy(ordinal).rowsBetween(-reach, reach)
    return df.withColumn("_near", F.max(hit.cast("int")).over(window)).where("_near = 1").drop("_near")


def top_per_group(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ordered_distinct(df: DataFrame, by: list[str], value: str, *ordinal: str) -> DataFrame:
    """The different values of each group in order of first appearance, as an array named like the column; null and empty ones do not count.

    Equal values are one row before anything is gathered, so an array has no more entries than the group has different values.
    """
    some = df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    firsts = some.groupBy(*by, value).agg(F.min(F.struct(*ordinal)).alias("_first"))
    gathered = firsts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_first", value))).alias("_all"))
    return gathered.select(*by, F.col("_all")[value].alias(value))


def with_queries(sources: DataFrame, results: DataFrame) -> DataFrame:
    """``sources`` (question_id, canonical) with ``queries``: those that gave the address, as ``results`` (question_id, canonical, query, ordinal) have them."""
    found = ordered_distinct(results, ["question_id", "canonical"], "query", "ordinal").withColumnRenamed("query", "queries")
    return sources.join(found, ["question_id", "canonical"], "left").withColumn("queries", F.coalesce("queries", F.array().cast("array<string>")))
