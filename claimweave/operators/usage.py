"""What runs cost, appended records, and the totals of an admin's page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import half_up

#: US dollars a call of a search provider (fixed values).
SEARCH_COSTS = {"tavily": 0.008, "exa": 0.005, "serper": 0.001, "brave": 0.005, "fixture": 0.0}
#: US dollars a million tokens read and written, by how a model's name begins (fixed values).
TOKEN_PRICES = (
    ("gemini-3-pro", 1.25, 10.0),
    ("gemini-3-flash", 0.1, 0.4),
    ("gemini-2.5-pro", 1.25, 10.0),
    ("gemini-2.5-flash", 0.3, 2.5),
    ("gpt-5-mini", 0.25, 2.0),
    ("gpt-5", 1.25, 10.0),
    ("gpt-4.1-mini", 0.4, 1.6),
    ("claude-haiku", 1.0, 5.0),
    ("claude-sonnet", 3.0, 15.0),
    ("claude-opus", 15.0, 75.0),
)
MOST_CALLS = 20


def lookup(values: dict, key: Column, default) -> Column:
    """The value of a key, or the default."""
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def token_cost(model: Column, read: Column, written: Column) -> Column:
    """Cost of a call by the longest prefix that the model's name has; 0 for unknown models."""
    out = F.lit(0.0)
    for prefix, a, b in sorted(TOKEN_PRICES, key=lambda p: len(p[0])):
        out = F.when(F.startswith(F.lower(model), F.lit(prefix)), read / 1_000_000 * a + written / 1_000_000 * b).otherwise(out)
    return out


def run_usage(calls: DataFrame) -> DataFrame:
    """One row a run of its calls (run_id, area of search, fetch or ai, provider, model, prompt_tokens, completion_tokens, n)."""
    c = F.col
    of = lambda area, v: F.coalesce(F.sum(F.when(c("area") == area, v)), F.lit(0))
    cost = F.when(c("area") == "search", lookup(SEARCH_COSTS, c("provider"), 0.0) * c("n")).when(c("area") == "ai", token_cost(c("model"), c("prompt_tokens"), c("completion_tokens"))).otherwise(0.0)
    return calls.groupBy("run_id").agg(
        of("search", c("n")).alias("search_calls"), of("fetch", c("n")).alias("pages_fetched"), of("ai", F.lit(1)).alias("ai_calls"), of("ai", c("prompt_tokens")).alias("prompt_tokens"), of("ai", c("completion_tokens")).alias("completion_tokens"),
        half_up(F.sum(cost), 6).alias("cost_usd"),
    )


def usage_records(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Records of runs (of :func:`run_usage`) to append: one for searches, one for pages, and one for each of the first calls of a model (calls with ``nth``)."""
    c = F.col
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    record = lambda area, provider, label, model=none, read=zero, written=zero, cost=F.lit(0.0): F.struct(F.lit(area).alias("area"), provider.alias("provider"), label.alias("label"), model.alias("model"), read.cast("long").alias("prompt_tokens"), written.cast("long").alias("completion_tokens"), cost.alias("cost_usd"))
    named = calls.where("area = 'search'").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("_providers"))
    rows = runs.join(named, "run_id", "left")
    two = F.array_compact(F.array(F.when(c("search_calls") > 0, record("search", F.coalesce("_providers", F.lit("unknown")), F.lit("search_queries"), cost=c("cost_usd"))), F.when(c("pages_fetched") > 0, record("fetch", F.lit("page-fetch"), F.lit("page_fetches")))))
    own = rows.select("run_id", F.explode(two).alias("r")).select("run_id", "r.*")
    ai = calls.where((c("area") == "ai") & (c("nth") <= MOST_CALLS)).select("run_id", record("ai", c("provider"), c("label"), c("model"), c("prompt_tokens"), c("completion_tokens")).alias("r")).select("run_id", "r.*")
    return own.unionByName(ai)


def feedback_records(given: DataFrame) -> DataFrame:
    """Feedback as it is stored: reasons of 120 and comments of 1,000 characters at most."""
    return given.withColumn("reason", F.substring("reason", 1, 120)).withColumn("comment", F.substring("comment", 1, 1_000))


def identification_records(given: DataFrame) -> DataFrame:
    """Identified parts as they are stored: identifiers of 200 characters at most."""
    return given.withColumn("identifier", F.substring("identifier", 1, 200))


def saved_search_rows(given: DataFrame) -> DataFrame:
    """Saved searches with label and query cut, keyed by user_id, query and mode; ``store.upsert`` merges them."""
    return given.withColumn("query", F.substring("query", 1, 500)).withColumn("label", F.substring("label", 1, 200))


def delete_saved(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """Saved searches without those of ``gone`` (id, user_id); a search of another user stays."""
    return saved.join(gone.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def history(sessions: DataFrame, search: str | None = None) -> DataFrame:
    """A user's sessions whose question, device or part number contains a text, in any case; all without one."""
    if not search:
        return sessions
    has = lambda name: F.coalesce(F.contains(F.lower(name), F.lit(search.lower())), F.lit(False))
    return sessions.where(has("question") | has("device") | has("part_number"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row (name, n) for each table; a table without rows counts 0."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def error_groups(errors: DataFrame, area: str, latest: int = 500, k: int = 10) -> DataFrame:
    """The most frequent errors of an area among the latest rows of all areas (area, provider, message, created_at, id), by provider and start of the message."""
    recent = errors.orderBy(F.desc("created_at"), F.desc("id")).limit(latest).where(F.col("area") == area)
    named = recent.select(F.coalesce("provider", F.lit("unknown")).alias("provider"), F.substring("message", 1, 140).alias("_key"), F.struct("created_at", "id").alias("_at"), F.substring("message", 1, 200).alias("message"))
    grouped = named.groupBy("provider", "_key").agg(F.max_by("message", "_at").alias("message"), F.count("*").alias("n"), F.max("_at.created_at").alias("last_seen"))
    return grouped.orderBy(F.desc("n"), "provider", "_key").limit(k).drop("_key")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row (helpful, not_helpful)."""
    return feedback.agg(F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("not_helpful"))


def top_reasons(feedback: DataFrame, k: int = 6) -> DataFrame:
    """The most frequent reasons; empty ones do not count."""
    return feedback.where("reason is not null and reason != ''").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def session_totals(sessions: DataFrame) -> DataFrame:
    """One row: sessions, those without a result, those that failed, the mean duration in whole milliseconds, and the cost, where sessions have one."""
    cost = half_up(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4) if "cost_usd" in sessions.columns else F.lit(0.0)
    return sessions.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "insufficient_evidence").alias("no_result"), F.count_if(F.col("verdict") == "research_failed").alias("failed"), cost.alias("cost_usd"), F.floor(F.coalesce(F.avg("duration_ms"), F.lit(0.0)) + 0.5).cast("long").alias("average_ms"))


def cache_rate(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """One row (hits, hit_rate): hits of the cache by hits and sessions together; 0 without any."""
    counted = cache.select(F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(0).alias("n")).unionByName(sessions.select(F.lit(0).cast(cache.schema["hits"].dataType).alias("hits"), F.lit(1).alias("n")))
    both = counted.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return both.select("hits", F.when(F.col("hits") + F.col("n") == 0, 0.0).otherwise(F.col("hits") / (F.col("hits") + F.col("n"))).alias("hit_rate"))


def provider_usage(records: DataFrame) -> DataFrame:
    """Records and cost by provider."""
    return records.groupBy("provider").agg(F.count("*").alias("n"), half_up(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"))
