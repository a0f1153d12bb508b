"""Readers of search results: which there are, what a deployment's settings allow, and the union of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators.dedupe import dedupe_results
from .search import normalise_results

#: Readers: name, setting that makes it ready, whether results hold page contents, most results of a query (fixed values).
READERS = (
    ("tavily", "TAVILY_API_KEY", True, 20),
    ("exa", "EXA_API_KEY", True, 25),
    ("serper", "SERPER_API_KEY", False, 20),
    ("brave", "BRAVE_SEARCH_API_KEY", False, 20),
    ("fixture", "ALLOW_FIXTURES", True, 10),
)
#: Settings of models (fixed values).
MODELS = (("openai", "OPENAI_API_KEY"), ("gemini", "GEMINI_API_KEY"), ("anthropic", "ANTHROPIC_API_KEY"))
#: Limits: default and ceiling; None is no ceiling (fixed values).
LIMITS = {
    "MAX_QUERIES_PER_RESEARCH": (6, 10),
    "MAX_RESULTS_PER_QUERY": (8, 20),
    "MAX_PAGES_TO_FETCH": (10, 25),
    "MAX_FETCH_BYTES": (1_500_000, 8_000_000),
    "MAX_PAGE_TEXT_CHARS": (14_000, 60_000),
    "MAX_AI_INPUT_CHARS": (24_000, 120_000),
    "MAX_AI_OUTPUT_TOKENS": (2_000, 8_000),
    "RESEARCH_TIMEOUT_MS": (75_000, 240_000),
    "PAGE_FETCH_TIMEOUT_MS": (9_000, 30_000),
    "MAX_RESEARCHES_PER_HOUR_PER_IP": (20, None),
    "MAX_IDENTIFICATIONS_PER_HOUR_PER_IP": (10, None),
    "MAX_UPLOAD_BYTES": (6_000_000, 12_000_000),
}


def _setting(name: str) -> Column:
    """Value of a setting among a deployment's rows, trimmed; of several the greatest."""
    return F.max(F.when(F.col("name") == name, F.trim("value")))


def number_of(value: Column, default: float, most: float | None = None) -> Column:
    """A setting as a number: the default where it is none, never over ``most``."""
    number = F.when(value.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), value.try_cast("double"))
    kept = F.coalesce(number, F.lit(float(default)))
    return kept if most is None else F.least(kept, F.lit(float(most)))


def flag_of(value: Column, default: bool = False) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.lower(value).isin("1", "true", "yes", "on"))


def limits(settings: DataFrame) -> DataFrame:
    """One row a deployment with its limits, in lower case, of rows (deployment, name, value)."""
    return settings.groupBy("deployment").agg(*[number_of(_setting(k), *v).alias(k.lower()) for k, v in LIMITS.items()])


def reader_setup(settings: DataFrame) -> DataFrame:
    """Rows (deployment, reader, ready, returns_content, max_results, missing): the catalogue of readers for each deployment, and the setting that one still needs."""
    c = F.col
    held = settings.groupBy("deployment").agg(*[F.coalesce(_setting(s), F.lit("")).alias(s) for s in dict.fromkeys(r[1] for r in READERS)])
    row = lambda reader, setting, content, most: F.struct(F.lit(reader).alias("reader"), (flag_of(c(setting)) if reader == "fixture" else c(setting) != "").alias("ready"), F.lit(content).alias("returns_content"), F.lit(most).alias("max_results"), F.lit(setting).alias("_setting"))
    rows = held.select("deployment", F.inline(F.array(*[row(*r) for r in READERS])))
    return rows.select("deployment", "reader", "ready", "returns_content", "max_results", F.when(~c("ready"), c("_setting")).alias("missing"))


def capabilities(settings: DataFrame) -> DataFrame:
    """What each deployment can do: readers in use, search_ready, model_ready, store_ready, and the settings that have to be mended.

    The reader is SEARCH_PROVIDER (default tavily), joined by SEARCH_FALLBACK_PROVIDER if that is another one that is ready. The model is
    AI_PROVIDER (default none).
    """
    c = F.col
    known = [r[0] for r in READERS]
    names = ["SEARCH_PROVIDER", "SEARCH_FALLBACK_PROVIDER", "AI_PROVIDER", "DATABASE_URL", *[r[1] for r in READERS], *[m[1] for m in MODELS]]
    held = settings.groupBy("deployment").agg(*[F.coalesce(_setting(n), F.lit("")).alias(n) for n in names])
    ready = F.map_from_arrays(F.array(*[F.lit(r) for r in known]), F.array(*[flag_of(c(s)) if r == "fixture" else c(s) != "" for r, s, _, _ in READERS]))
    models = F.map_from_arrays(F.array(*[F.lit(m) for m, _ in MODELS]), F.array(*[c(s) != "" for _, s in MODELS]))
    asked = F.lower(F.when(c("SEARCH_PROVIDER") == "", F.lit("tavily")).otherwise(c("SEARCH_PROVIDER")))
    told = held.select(
        "deployment", F.when(asked.isin(*known), asked).alias("reader"), F.lower("SEARCH_FALLBACK_PROVIDER").alias("_second"), F.when(F.lower("AI_PROVIDER").isin(*[m for m, _ in MODELS]), F.lower("AI_PROVIDER")).alias("model"),
        ready.alias("_ready"), models.alias("_models"), (c("DATABASE_URL") != "").alias("store_ready"),
    )
    on = lambda table, key: F.coalesce(F.try_element_at(c(table), key), F.lit(False))
    first, second = on("_ready", c("reader")), on("_ready", c("_second")) & (c("_second") != c("reader"))
    issues = (
        F.when(c("reader").isNull(), "SEARCH_PROVIDER").when(~first, "reader key"),
        F.when(c("model").isNotNull() & ~on("_models", c("model")), "model key"),
        F.when(~c("store_ready"), "DATABASE_URL"),
    )
    used = F.array_compact(F.array(F.when(first, c("reader")), F.when(first & second, c("_second"))))
    return told.select("deployment", "reader", used.alias("readers"), first.alias("search_ready"), on("_models", c("model")).alias("model_ready"), "store_ready", F.array_compact(F.array(*issues)).alias("issues"))


def search_all(results: list[DataFrame], limit: int) -> DataFrame:
    """Results of several readers as one table: the best of each address and question, ``nth`` by score.

    Each table has question_id, query, provider, ordinal, url, title, snippet, raw_content and score; an earlier table goes before a later one. At
    most ``limit`` results of each query and reader. A missing score counts as 0.
    """
    united = None
    for position, raw in enumerate(results):
        kept = normalise_results(raw, limit).withColumn("ordinal", F.struct(F.lit(position).alias("reader"), "query", "rank"))
        united = kept if united is None else united.unionByName(kept)
    keyed = united.withColumns({"canonical": canonical_url(F.col("url")), "content": F.col("raw_content")})
    best = dedupe_results(keyed, ["url", "title", "provider", "query"])
    order = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "ordinal")
    return best.withColumn("nth", F.row_number().over(order))
