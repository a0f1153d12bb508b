"""Registered queries on stored tables: streams into sinks, commits, cascades, aliases and ordered lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedupe, ledger, relations, store
from .registry import SQL, query
from .sources.search import table
from .streaming import limits


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern fits one file as well as a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{ledger.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(SQL["rate_limit_allowed"])
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with a day's limit, whose states go by timers, stored by batch."""
    with limits.rocks_states(spark):
        allowed = limits.rate_limited_stream(_events(spark, sf_dir), "user_id", "ts", "event_id", 2, limits.DAY_MS)
        return ledger.run_stream(allowed, _own_folder(spark, "limited"), "id long, allowed boolean").select(F.col("id").alias("event_id"), "allowed")


@query("""
SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'p' || user_id % 3 END AS provider, 'failed ' || repeat('x', user_id % 2000)[1:993] AS message, user_id % 2 = 0 AS retryable FROM events WHERE event_type = 'error'""")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a stream of events as records; a batch that is given again replaces itself."""
    u = F.col("user_id")
    failures = _events(spark, sf_dir).where("event_type = 'error'").select(
        "event_id", F.col("event_type").alias("area"), F.when(u % 3 > 0, F.concat(F.lit("p"), (u % 3).cast("string"))).alias("provider"), F.concat(F.lit("failed "), F.expr("repeat('x', cast(user_id % 2000 as int))")).alias("message"),
        F.lit(None).cast("string").alias("detail"), F.when(u % 2 == 0, True).alias("retryable"), F.lit(None).cast("string").alias("context"),
    )
    path, schema = _own_folder(spark, "errors"), "event_id long, area string, provider string, message string, detail string, retryable boolean, context string"
    stored = ledger.run_stream(ledger.error_records(failures), path, schema)
    return stored.select("event_id", "provider", "message", "retryable")


def _run(spark: SparkSession, sf_dir: str, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run over customers: the second has every other of them, and other pages and verdicts."""
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").where(key % 3 < 2 if number == 1 else key % 2 == 0)
    text = lambda name, value: F.lit(value).cast("string").alias(name)
    sessions = own.select(
        F.concat(F.lit("c"), key.cast("string")).alias("cache_key"), F.expr("repeat(c_name, 80)").alias("question"), F.lower("c_name").alias("normalized"), text("intent", "identify"), F.col("c_mktsegment").alias("verdict") if number == 1 else text("verdict", "compatible"),
        F.lit(number * 10).alias("score"), text("level", "LIKELY"), text("report", f"r{number}"), text("user_id", None), F.lit(number).cast("long").alias("duration_ms"), F.lit(0.5).alias("cost_usd"), F.concat(F.lit(f"run{number}-"), key.cast("string")).alias("run_id"),
    )
    orders = table(spark, sf_dir, "orders").join(own.select(key.alias("o_custkey")), "o_custkey").withColumn("cache_key", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    o = F.col("o_orderkey")
    pages = orders.where((o + number) % 3 > 0).select("cache_key", F.concat(F.lit("https://e.com/"), o.cast("string")).alias("url"), text("domain", "e.com"), text("title", "t"), text("snippet", "s"), F.lit(4).alias("tier"), (F.col("o_totalprice") * number).alias("quality"), F.lit(True).alias("fetched"), o.cast("int").alias("ordinal"))
    claims = orders.where(o % 2 == number % 2).select("cache_key", F.concat(F.lit("https://e.com/"), o.cast("string")).alias("source_url"), F.col("o_orderstatus").alias("claim"), text("evidence_text", "e"), F.lit(0.5).alias("strength"), o.cast("int").alias("ordinal"))
    return sessions, pages, claims


_PERSISTED = """
WITH runs(r) AS (VALUES (1), (2)),
own AS (SELECT r, c_custkey AS k, c_name, c_mktsegment FROM customer, runs WHERE CASE r WHEN 1 THEN c_custkey % 3 < 2 ELSE c_custkey % 2 = 0 END),
pages AS (SELECT r, k, o_orderkey AS o, o_totalprice * r AS quality FROM own JOIN orders ON o_custkey = k WHERE (o_orderkey + r) % 3 > 0 QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY o_orderkey) <= 25),
kept AS (SELECT k, o, arg_max(quality, r) AS quality FROM pages GROUP BY k, o),
claims AS (SELECT r, k, o_orderkey AS o FROM own JOIN orders ON o_custkey = k WHERE o_orderkey % 2 = r % 2 QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY o_orderkey) <= 60),
first_claims AS (SELECT k, r, count(*) AS n, min(o) AS first FROM claims GROUP BY k, r QUALIFY row_number() OVER (PARTITION BY k ORDER BY r) = 1)
SELECT 'c' || s.k AS cache_key, length(repeat(any_value(c_name), 80)[1:1000])::INT AS n_question, CASE WHEN max(s.r) = 2 THEN 'compatible' ELSE any_value(c_mktsegment) END AS verdict, (max(s.r) * 10)::INT AS score,
  CASE WHEN min(s.r) = 1 THEN '2024-03-31' ELSE '2024-05-01' END AS expires, count(*) AS n_searches,
  coalesce((SELECT count(*) FROM kept p WHERE p.k = s.k), 0) AS n_sources, coalesce((SELECT sum(round(quality * 100)::BIGINT)::BIGINT FROM kept p WHERE p.k = s.k), 0) AS cents,
  coalesce((SELECT n FROM first_claims f WHERE f.k = s.k), 0) AS n_claims, coalesce((SELECT first FROM first_claims f WHERE f.k = s.k), -1)::INT AS first_claim
FROM own s GROUP BY s.k"""


@query(_PERSISTED)
def persisted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over customers stored as two commits, the second run twice; the tables are read from the last manifest."""
    book = ledger.Ledger(spark, _own_folder(spark, "reports"))
    for number, day in ((1, "2024-01-01"), (2, "2024-02-01"), (2, "2024-02-01")):
        ledger.persist_reports(book, *_run(spark, sf_dir, number), F.lit(day).cast("timestamp"))
    count = lambda name, schema, *more: book.read(name, schema).groupBy("cache_key").agg(*more)
    sources = count("sources", ledger.SOURCE, F.count("*").alias("n_sources"), F.sum(F.round(F.col("quality") * 100).cast("long")).alias("cents"))
    claims = count("claims", ledger.CLAIM, F.count("*").alias("n_claims"), F.min("ordinal").alias("first_claim"))
    searches = count("searches", ledger.SEARCH, F.count("*").alias("n_searches"))
    sessions = book.read("sessions", ledger.SESSION).select("cache_key", F.length("question").alias("n_question"), "verdict", "score", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))
    joined = sessions.join(searches, "cache_key").join(sources, "cache_key", "left").join(claims, "cache_key", "left")
    return joined.fillna(0, ["n_sources", "cents", "n_claims"]).fillna(-1, ["first_claim"])


@query("""
WITH dead_nations AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey = 7), dead_customers AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM dead_nations) OR c_custkey % 11 = 3),
dead_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM dead_customers) OR o_orderkey % 13 = 5), live_suppliers AS (SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (FROM dead_nations) THEN s_nationkey END AS n FROM supplier)
SELECT 'region' AS name, count(*) AS n, sum(r_regionkey)::BIGINT AS total FROM region WHERE r_regionkey <> 1
UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::BIGINT FROM nation WHERE n_nationkey NOT IN (FROM dead_nations)
UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey NOT IN (FROM dead_customers)
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey NOT IN (FROM dead_orders)
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (FROM dead_orders)
UNION ALL SELECT 'supplier', count(*), coalesce(sum(n), 0)::BIGINT FROM live_suppliers""")
def cascading_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region, a nation, some customers and some orders are deleted with all that hangs on them; suppliers stay without a nation."""
    R = relations.Relation
    links = (R("nation", "n_regionkey", "region"), R("customer", "c_nationkey", "nation"), R("orders", "o_custkey", "customer"), R("lineitem", "l_orderkey", "orders"), R("supplier", "s_nationkey", "nation", keep=True))
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
    tables = {name: table(spark, sf_dir, name) for name in keys}
    gone = {"region": tables["region"].where("r_regionkey = 1"), "nation": tables["nation"].where("n_nationkey = 7"), "customer": tables["customer"].where("c_custkey % 11 = 3"), "orders": tables["orders"].where("o_orderkey % 13 = 5")}
    left = relations.delete_rows(tables, keys, gone, links)
    summed = keys | {"supplier": "s_nationkey"}
    rows = [left[name].agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(summed[name]).cast("long")), F.lit(0)).alias("total")).select(F.lit(name).alias("name"), "n", "total") for name in keys]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query("""
WITH v AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'b' ELSE 'a' END AS r, p_name || CASE WHEN p_size % 5 = 0 THEN ' again' ELSE '' END AS value, p_partkey % 7 = 2 OR p_partkey % 11 = 4 AND p_size % 5 > 0 AS gone, p_size % 5 = 0 OR p_partkey % 2 = 0 AS live FROM part)
SELECT 'k' || k AS alias, CASE WHEN live AND NOT gone THEN value END AS value FROM v
UNION ALL SELECT 'id:a' || k, CASE WHEN live AND NOT gone AND r = 'a' THEN value END FROM v UNION ALL SELECT 'id:b' || k, CASE WHEN live AND NOT gone AND r = 'b' THEN value END FROM v""")
def aliased_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reports in a cache, asked for by key and by id: a fifth is put again, half of the others has expired, and some are dropped by key or by id."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    report = lambda df, run, tail: df.select(F.concat(F.lit("k"), k).alias("key"), F.concat(F.lit(run), k).alias("report_id"), F.concat("p_name", F.lit(tail)).alias("value"))
    values, index = spark.createDataFrame([], "key string, value string, hits long, expires_at timestamp"), spark.createDataFrame([], "alias string, key string")
    day = lambda d: F.lit(d).cast("timestamp")
    values, index = store.put_aliased(values, index, report(p.where("p_partkey % 2 = 0"), "a", ""), day("2024-01-10"), "5 DAYS")
    values, index = store.put_aliased(values, index, report(p.where("p_partkey % 2 = 1"), "a", ""), day("2024-01-01"), "5 DAYS")
    values, index = store.put_aliased(values, index, report(p.where("p_size % 5 = 0"), "b", " again"), day("2024-01-11"), "5 DAYS")
    gone = p.select(F.when(F.col("p_partkey") % 7 == 2, F.concat(F.lit("k"), k)).when(F.col("p_partkey") % 11 == 4, F.concat(F.lit("id:a"), k)).alias("alias")).where("alias is not null")
    values, index = store.drop_aliased(values, index, gone)
    asked = p.select(F.explode(F.array(F.concat(F.lit("k"), k), F.concat(F.lit("id:a"), k), F.concat(F.lit("id:b"), k))).alias("alias"))
    return store.get_aliased(asked, values, index, day("2024-01-12")).select("alias", "value")


@query("""
WITH r AS (SELECT l_suppkey AS q, l_partkey % 40 AS a, l_returnflag || ' ' || l_linenumber AS query, l_orderkey * 10 + l_linenumber AS o FROM lineitem),
f AS (SELECT q, a, query, min(o) AS o FROM r GROUP BY ALL), s AS (SELECT s_suppkey AS q, unnest(range(0, 40, 3)) AS a FROM supplier)
SELECT s.q AS question_id, 'https://e.com/' || s.a AS canonical, coalesce(string_agg(query, '|' ORDER BY o, query), '') AS queries FROM s LEFT JOIN f ON f.q = s.q AND f.a = s.a GROUP BY s.q, s.a""")
def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results: the queries that gave each address of a supplier, in order of first appearance."""
    address = lambda c: F.concat(F.lit("https://e.com/"), c.cast("string")).alias("canonical")
    results = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("question_id"), address(F.col("l_partkey") % 40), F.concat_ws(" ", "l_returnflag", F.col("l_linenumber").cast("string")).alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(3))).alias("a")).select("question_id", address(F.col("a")))
    return dedupe.with_queries(sources, results).select("question_id", "canonical", F.array_join("queries", "|").alias("queries"))
