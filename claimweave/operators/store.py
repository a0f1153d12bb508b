"""Merges, caches and pruning of keyed tables as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once, for plans that read it several times.

    It is a checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``; without one it is held by the executors and
    worked out again for those that are lost.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``old`` with the ``update`` columns of matching rows of ``new``, and the other rows of ``new`` added."""
    other = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_hit"))
    joined = old.withColumn("_had", F.lit(True)).join(other, keys, "full")
    column = lambda c: F.when(F.col("_hit").isNotNull() & (F.lit(c in update) | F.col("_had").isNull()), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*keys, *[column(c) for c in old.columns if c not in keys])


def latest_by_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row last written for each key: one partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("_at"), F.col(tie).alias("_tie"), *[F.col(c).alias(c) for c in rest])).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def delete_by_key(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def prune(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that have not expired."""
    return df.where(F.col(expires) >= as_of)


def split_by_cache(results: DataFrame, cache: DataFrame, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Results that a live cache row answers, and the others."""
    live = cache.where(F.col("expires_at") >= as_of).select(key).distinct()
    return results.join(live, key, "left_semi"), results.join(live, key, "left_anti")


def cache_first(results: DataFrame, cache: DataFrame, key: str, as_of: Column, read) -> DataFrame:
    """Sources of results: from live cache rows where there are such, else what ``read`` makes of the results.

    ``results`` have ``key``, ordinal, snippet and raw_content; those with contents bypass the cache. ``cache`` has ``key``, title, text, fetched,
    n_words and expires_at; of several rows for a key the one that expires last counts. ``read`` takes results and gives
    title, text, fetched and n_words besides their columns. Adds ``cached``.
    """
    page = ["title", "text", "fetched", "n_words"]
    live = latest_by_key(cache.where(F.col("expires_at") >= as_of).select(key, *page, "expires_at"), [key], "expires_at", "text")
    inline = F.coalesce(F.col("raw_content"), F.lit("")) != ""
    bare = results.drop(*page)
    held = bare.where(~inline).join(live.drop("expires_at"), key).withColumn("cached", F.lit(True))
    rest = results.where(inline).unionByName(results.where(~inline).join(live.select(key), key, "left_anti"))
    return held.unionByName(read(rest).withColumn("cached", F.lit(False)).select(*held.columns))


def worth_caching(sources: DataFrame) -> DataFrame:
    """Sources that a cache should keep: pages that were fetched and have more than 80 words."""
    return sources.where(F.col("fetched") & (F.col("n_words") > 80))


def bounded(df: DataFrame, first_insert: str, tie: str, size: int = 300) -> DataFrame:
    """The ``size`` entries first inserted last (first in, first out)."""
    return df.orderBy(F.desc(first_insert), F.desc(tie)).limit(size)


def count_hits(df: DataFrame, by: str, hit: str) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(F.col(hit)).alias("hits"), F.count("*").alias("n"), (F.count_if(F.col(hit)) / F.count("*")).alias("hit_rate"))


def nth_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


# --- a cache whose values answer several keys ----------------------------------------------------


def put_aliased(values: DataFrame, index: DataFrame, new: DataFrame, now: Column, ttl: str) -> tuple[DataFrame, DataFrame]:
    """``values`` (key, value, hits, expires_at) and ``index`` (alias, key) with the rows of ``new`` (key, report_id, value) put in.

    A value is stored once under its key; the index has the key itself and ``id:<report_id>``, so either finds it. A value that is
    put again renews value and expiry, keeps its hits, and gives up the ids of the report before.
    """
    fresh = new.select("key", "value", F.lit(0).cast("long").alias("hits"), (now.cast("timestamp") + F.expr(f"INTERVAL {ttl}")).alias("expires_at"))
    names = F.explode(F.array(F.col("key"), F.concat(F.lit("id:"), F.col("report_id"))))
    kept = index.join(new.select("key"), "key", "left_anti").select("alias", "key")
    return upsert(values, fresh, ["key"], ["value", "expires_at"]), latest_alias(kept, new.select(names.alias("alias"), "key"))


def latest_alias(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases of both; one that ``new`` has leads to the key it has there."""
    return old.join(new, "alias", "left_anti").unionByName(new.distinct())


def get_aliased(asked: DataFrame, values: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """``asked`` (alias) with key and value; both null where nothing live is stored under the alias."""
    live = values.where(F.col("expires_at") >= as_of).select("key", "value")
    return asked.join(index.join(live, "key"), "alias", "left")


def drop_aliased(values: DataFrame, index: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what the aliases of ``gone`` (alias) lead to: the values and all their aliases."""
    keys = index.join(gone, "alias", "left_semi").select("key").distinct()
    return delete_by_key(values, keys, ["key"]), delete_by_key(index, keys, ["key"]).select("alias", "key")


def prune_aliased(values: DataFrame, index: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without expired values and aliases that lead nowhere."""
    live = prune(values, "expires_at", as_of)
    return live, index.join(live.select("key"), "key", "left_semi").select("alias", "key")


def cache_stats(values: DataFrame, most: int = 1_000) -> DataFrame:
    """One row (entries, hits) of the first ``most`` rows by key."""
    return values.orderBy("key").limit(most).agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
