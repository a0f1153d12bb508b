"""Registered queries on what a model adds, on cache keys, and on the written pages."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evidence_queries import code, lit, norm, segments
from .functions import idents
from .functions.urls import canonical_url
from .operators import modelling
from .operators.store import cut
from .plans import questions
from .registry import query
from .sources import fixtures
from .sources.search import read_results, table

# --- claims of a model ---------------------------------------------------------------------------

GROUPS, BUDGET = 40, 9_000
_TERMS = ("thor", "einb", "ement", "la ci")


def stand_in(prompts: list[str]) -> list[str]:
    """A model's part for tests and measurements: it quotes the first line of each block, adds a quote that no page has, and fails on three blocks."""
    out = []
    for prompt in prompts:
        blocks = re.findall(r"=====BEGIN EVIDENCE ref=(S\d)=====\n(.*)", prompt)
        claims = [{"sourceRef": ref, "evidenceText": line, "claim": "fits" if len(line) % 2 else "incompatible", "modelNumbers": ["SM-A155F", line.split(" ")[0]]} for ref, line in blocks]
        claims.append({"sourceRef": "S1", "evidenceText": "No page has ever said anything like this.", "claim": "fits"})
        out.append("I am sorry." if len(blocks) == 3 else "Here it is:\n```json\n" + json.dumps({"claims": claims}) + "\n```")
    return out


@query(rf"""
WITH pages AS (SELECT doc_id, doc_id % {GROUPS} AS q, coalesce(text, '') AS text, doc_id % 17 / 16.0 AS quality FROM documents),
best AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY quality DESC, doc_id::VARCHAR) AS nth FROM pages WHERE doc_id % 5 > 0 AND quality >= 0.45 AND length(text) > 220 QUALIFY nth <= 6),
cut AS (SELECT doc_id, {segments("text")} AS segs FROM best),
segs AS (SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM cut),
hits AS (SELECT *, list_bool_or(list_transform({"[" + ", ".join(lit(t) for t in _TERMS) + "]"}, lambda t: contains({norm("seg")}, t))) AS hit FROM segs),
near AS (SELECT doc_id, seg, min(pos) AS pos FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM hits) WHERE near GROUP BY doc_id, seg),
said AS (SELECT doc_id, string_agg(seg, chr(10) ORDER BY pos) AS said FROM near GROUP BY doc_id),
digests AS (
  SELECT b.*, CASE WHEN length(d) > 3500 THEN rtrim(d[1:3499]) || '…' ELSE d END AS digest FROM (SELECT b.*, coalesce(s.said, b.text) AS d FROM best b LEFT JOIN said s ON b.doc_id = s.doc_id) b),
budget AS (
  SELECT q, list_reduce(list_prepend([{BUDGET}::BIGINT], list(CASE WHEN digest = '' THEN [] ELSE [nth, length(digest)] END ORDER BY nth)), lambda held, x: CASE WHEN len(x) > 0 AND x[2] <= held[1] THEN list_append(list_prepend(held[1] - x[2], held[2:]), x[1]) ELSE held END)[2:] AS taken
  FROM digests GROUP BY q),
quotes AS (
  SELECT d.*, regexp_replace(string_split(digest, chr(10))[1], '', '') AS quote FROM digests d JOIN budget b ON d.q = b.q WHERE list_contains(taken, nth) AND len(taken) <> 3)
SELECT q AS question_id, doc_id, CASE WHEN length(quote) % 2 = 1 THEN 'compatible' ELSE 'not_compatible' END AS claim, (CASE WHEN length(quote) > 320 THEN length(rtrim(quote[1:319])) + 1 ELSE length(quote) END)::INT AS n_chars,
  (CASE WHEN contains(upper(text), 'SM-A155F') THEN 1 ELSE 0 END + CASE WHEN length(regexp_replace(upper(replace(trim(string_split(quote, ' ')[1]), 'ß', 'ss')), '[^A-Z0-9-]', '', 'g')) >= 3 AND contains(upper(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'ss')), regexp_replace(upper(replace(trim(string_split(quote, ' ')[1]), 'ß', 'ss')), '[^A-Z0-9-]', '', 'g')) THEN 1 ELSE 0 END)::INT AS n_models
FROM quotes WHERE length(quote) >= 15""")
def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a stand-in for a model finds on documents without claims, within a question's budget."""
    d = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select((d % GROUPS).alias("question_id"), d.cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), (d % 17 / 16.0).alias("quality"))
    claimed = pages.where(F.col("source_id").cast("long") % 5 == 0).select("question_id", "source_id")
    understood = spark.range(GROUPS).select(F.col("id").alias("question_id"), F.lit("Thor").alias("device"), F.array(F.lit("Einb"), F.lit("ement")).alias("model_numbers"), F.lit("La  ci!").alias("part"), F.lit(None).cast("string").alias("part_number"), F.lit("unknown").alias("part_category"))
    found = modelling.propose_claims(stand_in, pages, claimed, understood, BUDGET)[0]
    return found.select("question_id", F.col("source_id").cast("long").alias("doc_id"), "claim", F.length("evidence_text").alias("n_chars"), F.size("model_numbers").alias("n_models"))


# --- answers of a model --------------------------------------------------------------------------

_ANSWERS = ("Evidence agrees that it fits {}.", "It fits the SM-A155F and the iPhone 12 pro max, as {} says.", "There is not enough evidence on {}, so be careful with it.", "RMX3363 and rmx3363 are named by {}, and A1234 too.")


@query(rf"""
WITH a AS (
  SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'compatible' ELSE 'uncertain' END AS verdict, replace(([{", ".join(lit(x) for x in _ANSWERS)}])[1 + p_partkey % 4], '{{}}', p_name) AS said, ([['SM-A155F'], ['SM-A155F', 'RMX3363', 'A1234'], ['iPhone 12 pro max', 'SM-A155F']])[1 + p_size % 3] AS codes, p_name, p_size FROM part),
c AS (SELECT *, trim(regexp_replace(said, '\s+', ' ', 'g')) AS answer, list_transform(codes, lambda m: {code("m")}) AS known, list_distinct(list_transform(regexp_extract_all(said, {lit(idents.MODELS_IN_PROSE)}), lambda m: {code("m")})) AS named FROM a),
r AS (SELECT *, CASE WHEN length(answer) < 40 THEN 'too short' WHEN len(list_filter(named, lambda m: NOT list_contains(known, m))) > 0 THEN 'names' WHEN regexp_matches(answer, '(?i)no evidence|not enough|insufficient') AND verdict = 'compatible' THEN 'against the verdict' END AS refused FROM c)
SELECT k AS question_id, CASE WHEN k % 10 = 9 THEN NULL ELSE refused END AS refused, CASE WHEN k % 10 = 9 OR refused IS NOT NULL THEN 'own answer' ELSE answer END AS answer, CASE WHEN k % 10 = 9 OR refused IS NOT NULL THEN 1 WHEN k % 4 = 0 THEN 1 ELSE CASE WHEN length(p_name) > 12 THEN least(p_size, 6) ELSE 0 END END::INT AS n_bullets FROM r""")
def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a model might give on parts, against the codes that the evidence bears out."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    pick = lambda n, by, *values: F.get(F.array(*values), (by % n).cast("int"))
    codes = pick(3, F.col("p_size"), *[F.array(*[F.lit(x) for x in row]) for row in (["SM-A155F"], ["SM-A155F", "RMX3363", "A1234"], ["iPhone 12 pro max", "SM-A155F"])])
    one = F.array(F.lit("one bullet of its own"))
    reports = p.select(k.alias("question_id"), F.when(k % 3 == 0, "compatible").otherwise("uncertain").alias("verdict"), F.lit("own answer").alias("answer"), one.alias("bullets"), one.alias("verify"), codes.alias("codes"))
    said = pick(4, k, *[F.replace(F.lit(a), F.lit("{}"), F.col("p_name")) for a in _ANSWERS])
    bullets = F.when(k % 4 != 0, F.array_repeat("p_name", F.col("p_size").cast("int")))
    proposed = p.where(k % 10 != 9).select(k.alias("question_id"), said.alias("answer"), bullets.alias("bullets"), F.array().cast("array<string>").alias("verify"))
    found = modelling.accept_answers(proposed, reports)
    return found.select("question_id", F.when(F.col("refused").startswith("names "), "names").otherwise(F.col("refused")).alias("refused"), "answer", F.size("bullets").alias("n_bullets"))


# --- cache keys ----------------------------------------------------------------------------------

_PHRASES = ("Can I use the {} in my phone?", "  can i  USE {}: in my phone", "Please help me, will a {} fit?", "Hi! Is it possible to fit the {}...", "{}")


@query(rf"""
WITH asked AS (SELECT p_partkey AS k, replace(([{", ".join(lit(x) for x in _PHRASES)}])[1 + p_partkey % 5], '{{}}', ([p_brand, p_type])[1 + p_size % 2]) AS question, p_size % 3 AS m FROM (SELECT p_partkey, p_size, coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type FROM part)),
bare AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({norm("question")}, '{questions.FILLER_PHRASES}', ' ', 'g'), '{questions.FILLER_WORDS}', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM asked)
SELECT sha256('{{"intent":"identify","m":"' || (['default', 'check', 'parts'])[1 + m] || '","p":["brave","tavily"],"q":"' || q || '","v":"{questions.RULES_VERSION}"}}') AS cache_key, count(*) AS n, min(k) AS first FROM bare GROUP BY 1""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on parts by the key of their cached reports."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.lit(""))
    said = F.get(F.array(*[F.replace(F.lit(x), F.lit("{}"), name) for x in _PHRASES]), (k % 5).cast("int"))
    mode = F.get(F.array(F.lit(None).cast("string"), F.lit("check"), F.lit("parts")), (F.col("p_size") % 3).cast("int"))
    asked = part.select(k.alias("question_id"), said.alias("question"), F.lit("identify").alias("intent"), mode.alias("mode"))
    keyed = questions.with_cache_keys(asked, F.array(F.lit("tavily"), F.lit("brave")))
    return keyed.groupBy("cache_key").agg(F.count("*").alias("n"), F.min("question_id").alias("first"))


# --- which pages are read ------------------------------------------------------------------------


def _reading_sql() -> str:
    from .catalogue import _CANONICAL, _DOMAIN

    return f"""
WITH r AS (SELECT page_id, page_id % 15 AS q, url, {_DOMAIN} AS d, page_id % 10 / 10.0 AS score, page_id * 37 % 240 AS said, page_id % 7 = 0 AS inline, bool_or(page_id % 3 > 0) OVER (PARTITION BY {_CANONICAL}) AS held FROM pages),
p AS (
  SELECT *, score * 10 + CASE WHEN regexp_matches(d, '(?i)manufacturer|samsung|apple|support\\.') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d, '(?i)repair|parts|supplier|spare|mobile|gsm|fix') THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(d, '(?i)forum|reddit|stackexchange|quora') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(url, '(?i)\\.(pdf|zip|jpg|png)$') THEN 5 ELSE 0 END + CASE WHEN said > 120 THEN 1 ELSE 0 END AS priority FROM r),
n AS (SELECT *, greatest(0, 6 - count(*) FILTER (inline) OVER (PARTITION BY q)) AS budget, row_number() OVER (PARTITION BY q, inline ORDER BY priority DESC, page_id) AS nth FROM p),
h AS (SELECT *, CASE WHEN inline THEN 'inline' WHEN nth <= budget THEN 'fetch' ELSE 'snippet' END AS how FROM n)
SELECT page_id, how, how = 'fetch' AND held AS fetched, CASE WHEN how = 'snippet' THEN 'beyond the budget of pages' WHEN how = 'fetch' AND NOT held THEN 'status 404' END AS failure FROM h"""


@query(_reading_sql())
def reading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of 15 questions: which are read, within a budget of six, and why the others are not."""
    k = F.col("page_id")
    results = table(spark, sf_dir, "pages").select(k.alias("ordinal"), (k % 15).alias("question_id"), "url", F.expr("repeat('x', cast(page_id * 37 % 240 as int))").alias("snippet"), F.when(k % 7 == 0, "inline").alias("raw_content"), (k % 10 / 10.0).alias("score"))
    pages = results.select(canonical_url(F.col("url")).alias("canonical"), F.when(F.col("ordinal") % 3 > 0, "text").alias("content"), F.when(F.col("ordinal") % 3 == 0, "status 404").alias("failure"))
    read = read_results(results, pages, 6)
    return read.select(F.col("ordinal").alias("page_id"), "how", "fetched", "failure")


# --- the written pages ---------------------------------------------------------------------------

_ASKS = ("battery of the Galaxy A15", "A15 SCREEN", "bn5a", "a15 side key", "dock of an a15", "a155f battery", "ps-fixture:none a15 battery", "galaxy s9 battery", "a15 nfc")


@query(f"""
WITH q AS (SELECT c_custkey AS question_id, ([{", ".join(lit(a) for a in _ASKS)}])[1 + c_custkey % 9] AS query FROM customer),
s AS (
  SELECT *, lower(query) AS t, contains(t, 'a15') AS a15 FROM q),
c AS (
  SELECT *, CASE WHEN contains(t, 'ps-fixture:none') THEN 'none' WHEN regexp_matches(t, '\\bbn5a\\b') THEN 'injection' WHEN a15 AND regexp_matches(t, 'power|volume|side ?key|button') THEN 'power_flex' WHEN a15 AND regexp_matches(t, 'battery|cell') THEN 'battery'
    WHEN a15 AND regexp_matches(t, 'screen|display|lcd|oled|digitizer') THEN 'conflict' WHEN a15 AND regexp_matches(t, 'charging|dock|port|flex') THEN 'compatible' END AS scenario FROM s),
pages(scenario, rank, url, n) AS (VALUES {", ".join(f"('{name}', {k + 1}, '{url}', {len(text)})" for name, rows in fixtures.PAGES.items() for k, (url, _, text) in enumerate(rows))})
SELECT question_id, query, url, rank::INT AS rank, n::INT AS n_chars FROM c JOIN pages USING (scenario)""")
def fixture_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' queries answered by the written pages."""
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(key.alias("question_id"), F.get(F.array(*[F.lit(a) for a in _ASKS]), (key % 9).cast("int")).alias("query"))
    return fixtures.search(asked, allowed=True).select("question_id", "query", "url", "rank", F.length("raw_content").alias("n_chars"))


# --- searches of all intents ---------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS form, 'GH82-' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'A' AS n, 'BN' || p_partkey % 10 || 'A' AS m, 'Samsung Galaxy A' || p_size AS d, 'SM-A' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || 'B' AS t FROM part),
q AS (
  SELECT k, CASE form WHEN 0 THEN ['Battery ' || n || ' compatible phones', 'Battery ' || n || ' compatible models list', '"' || n || '" compatible devices', '"' || n || '" replacement battery', 'which phones use Battery ' || n, 'Battery ' || n || ' cross reference']
    WHEN 1 THEN ['"' || m || '" compatible phones', '"' || m || '" replacement battery', '"' || m || '" battery compatibility', '"' || m || '" specifications']
    WHEN 2 THEN [d || ' phone part compatibility', d || ' phone part replacement', d || ' phone part compatible models list', d || ' phone part forum technician', d || ' phone part part number OEM']
    ELSE [d || ' 5G screen compatibility', '"' || t || '" screen compatible', t || ' LCD replacement compatible models', d || ' screen compatible models list', d || ' 5G screen forum technician', d || ' screen part number OEM'] END AS qs,
    CASE form WHEN 0 THEN 'part_to_phones' WHEN 1 THEN 'identify' WHEN 2 THEN 'phone_to_parts' ELSE 'compatibility_check' END AS intent FROM p)
SELECT k AS p_partkey, intent, unnest(qs) AS query, (generate_subscripts(qs, 1) - 1)::INT AS priority FROM q""")
def query_plan_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of four intents, made of the parts' numbers, with their search queries."""
    k = F.col("p_partkey")
    forms = F.array(F.format_string("Which phones use the GH82-%05dA battery?", k % 100000), F.format_string("BN%dA", k % 10), F.format_string("Samsung Galaxy A%d", "p_size"), F.format_string("Is the screen compatible with Samsung Galaxy A%d 5G (SM-A%03dB)?", "p_size", k % 1000))
    # both sides of the join read what is understood, so it is worked out once; it has a row a question and is not broadcast
    understood = cut(questions.understand(table(spark, sf_dir, "part").select(k.alias("question_id"), F.get(forms, (k % 4).cast("int")).alias("question"))))
    found = questions.search_queries(understood).join(understood.select("question_id", "intent").hint("merge"), "question_id")
    return found.select(F.col("question_id").alias("p_partkey"), "intent", "query", "priority")
