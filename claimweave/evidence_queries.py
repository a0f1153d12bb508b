"""Registered queries on claims, checklists, families and stores, over pages whose texts are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import claims, devices, idents, parts, scores, text
from .functions.once import dealt
from .operators import extraction
from .operators.store import cut
from .registry import query
from .sources.search import table

#: What the pages of customers say; a customer's page has seven of these sentences.
SENTENCES = (
    "This battery is compatible with Samsung Galaxy A15 4G phones.",
    "SM-A155F, SM-A155M/DSN, SM-A156B",
    "Also fits SM-A155F and the redmi note 12!",
    "It does not fit the Samsung Galaxy A15 5G (SM-A156B).",
    "Part number: EB-BA155ABY, rated 3.85 V and 5000 mAh.",
    "The Galaxy A15 has a display of 6.5 inch; it is AMOLED.",
    "Our shop has many garden tools and chairs for the summer.",
    "Some users say this battery pack works with Galaxy A15, reports vary.",
    "The battery GH82-33638A replaces the old one of your Samsung.",
    "Interchangeable with the cell of the Galaxy A15.",
    "Please ask us about applesauce and http404 pages.",
    "SM-A155F/DS;  RMX3363",
    "Short.",
    "Charging flex for Galaxy A15 with USB-C connector, 12 pin, rev 2.",
    "A screen is different from a battery on the a15, do not swap them.",
    "Xiaomi phones use BN5J batteries.",
    "[REDACTED-INSTRUCTION-LIKE-TEXT] the battery fits the Galaxy A15.",
    "The A15 battery is said to be suitable for A155F boards and 821-01234-A cables.",
    "Nothing more is known about this one, sorry.",
)
N_SENTENCES = 7
#: So many customers' pages answer one question.
PAGES = 2


def _picked(k: str) -> list[str]:
    """SQL of the numbers, from 0, of the sentences on page ``k``."""
    return [f"({k} * {3 + 2 * j} + {k} // {1 + j} + {j * j}) % {len(SENTENCES)}" for j in range(N_SENTENCES)]


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (question_id, source_id, text): pages of customers, two on a question."""
    said = F.array(*[F.lit(s) for s in SENTENCES])
    picked = [F.get(said, F.expr(p.replace("//", "div")).cast("int")) for p in _picked("c_custkey")]
    gap = F.when(F.col("c_custkey") % 3 == 0, "\n").otherwise(" ")
    return table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / PAGES).alias("question_id"), F.col("c_custkey").cast("string").alias("source_id"), F.array_join(F.array(*picked), "\u0001").alias("t"), gap.alias("gap")).select("question_id", "source_id", F.replace("t", F.lit("\u0001"), "gap").alias("text"))


_TARGET = {"device": "Galaxy A15 4G", "device_brand": "Samsung", "part": "Battery", "part_number": "EB-BA155ABY", "part_category": "battery", "model_numbers": ["SM-A155F"]}


def customer_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' pages and the claims that they make on a battery of a Galaxy A15 4G."""
    from .operators.research import targets

    fields = [F.array(*[F.lit(m) for m in v]).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in _TARGET.items()]
    pages = customer_pages(spark, sf_dir)
    asked = dealt(pages.select("question_id"), "question_id").distinct()
    return pages, extraction.extract_claims(pages, targets(asked.select("question_id", *fields)))


# --- SQL of the fold, segment by segment ---------------------------------------------------------


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def norm(c: str) -> str:
    """SQL of ``text.normalize_match``."""
    return rf"trim(regexp_replace(regexp_replace(translate(lower(translate({c}, '{text.MARKED}', '{text.PLAIN}')), '‘’', ''''''), '[^a-z0-9+\-.''/ ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def segments(c: str) -> str:
    """SQL of ``text.split_segments``."""
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '([.!?;•|])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(regexp_replace(s, '[\t\n\f\r\v ]+', ' ', 'g'), ' ')), lambda s: s <> '')"


def code(c: str) -> str:
    return f"regexp_replace(upper(trim({c})), '[^A-Z0-9-]', '', 'g')"


def distinct_codes(listed: str) -> str:
    return f"list_filter({listed}, lambda x, i: list_position(list_transform({listed}, lambda y: replace(y, '-', '')), replace(x, '-', '')) = i)"


def _shaped(c: str) -> str:
    return " || ".join(f"regexp_extract_all({c}, {lit(p)})" for _, p in idents.SKUS)


def _words(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


_BATTERY = next(names for name, _, names, _ in parts.CATEGORIES if name == "battery")
_BY_LENGTH = sorted(_BATTERY, key=len, reverse=True)
_SAID = sorted(claims.CLAIM_PATTERNS, key=lambda c: -c[1])
_CATEGORIES = sorted(((a, c) for c, _, names, _ in parts.CATEGORIES for a in names if len(a) >= 4), key=lambda n: -len(n[0]))
_PICKED_SQL = ", ".join(f"({_words(SENTENCES)})[1 + {p}]" for p in _picked("c_custkey"))
_PAGES_SQL = f"SELECT k, CASE WHEN k % 3 = 0 THEN array_to_string(s, chr(10)) ELSE array_to_string(s, ' ') END AS text FROM (SELECT c_custkey AS k, [{_PICKED_SQL}] AS s FROM customer)"
_CLAIMS_SQL = rf"""
WITH RECURSIVE pages AS ({_PAGES_SQL}),
numbers(k, i, next, value, place) AS (
  SELECT k, 0, 1::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM pages
  UNION ALL
  SELECT k, i + 1, next - 1 + instr(substr(text, next), v) + length(v), upper(v), next - 1 + instr(substr(text, next), v)
  FROM (SELECT n.k, n.i, n.next, p.text, regexp_extract_all(text, {lit(idents.NEAR_NUMBER)})[i + 1] AS v FROM numbers n JOIN pages p ON n.k = p.k) WHERE v IS NOT NULL),
cut AS (SELECT k, list_filter({segments("text")}, lambda s: length(s) BETWEEN 12 AND 1200 AND NOT contains(s, '[REDACTED-INSTRUCTION-LIKE-TEXT]') AND NOT contains(s, '[TAG-REMOVED]')) AS segs FROM pages),
segs AS (SELECT k, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM cut),
coded AS (
  SELECT k, pos, seg, {norm("seg")} AS n,
    list_filter(list_transform({_shaped("seg")}, lambda m: {code("m")}), lambda m: length(m) >= 4) || list_filter(list_transform(regexp_extract_all(seg, {lit(idents.ANY_SKU)}), lambda m: {code("m")}), lambda m: regexp_matches(m, {lit(idents.ANY_SKU_PREFIX)}))
    || list_transform(regexp_extract_all(seg, {lit(idents.SEGMENT_MODELS)}), lambda m: {code("m")}) AS codes
  FROM segs),
models AS (
  SELECT k, pos, seg, n, list_filter(codes, lambda m: length(m) >= 4 AND NOT regexp_matches(m, {lit(idents.NO_MODEL)}) AND NOT (regexp_matches(m, '{idents.NO_MODEL_NUMBER}') AND NOT regexp_matches(m, '{idents.MODEL_NUMBER}'))) AS codes FROM coded),
told AS (
  SELECT k, pos, seg, n, {distinct_codes("codes")}[1:8] AS m,
    list_bool_or(list_transform(['galaxy a15 4g', 'samsung', 'sm-a155f', 'a15', '4g'], lambda t: contains(n, t))) AS dev, list_bool_or(list_transform({_words([*(a for a in _BATTERY if len(a) > 2), "eb-ba155aby"])}, lambda t: contains(n, t))) AS part, contains(n, 'eb-ba155aby') AS num,
    CASE {" ".join(f"WHEN regexp_matches(seg, {lit(p)}) THEN '{kind}'" for kind, _, p in _SAID)} END AS said, CASE {" ".join(f"WHEN regexp_matches(seg, {lit(p)}) THEN {w}::DOUBLE" for _, w, p in _SAID)} END AS weight,
    CASE {" ".join(f"WHEN contains(n, {lit(a)}) THEN '{c}'" for a, c in _CATEGORIES)} END AS category, list_filter({_words(_BY_LENGTH)}, lambda a: contains(n, a))[1] AS phrase,
    string_split(trim(regexp_replace(regexp_extract(seg, '(?i)\b((?:{devices._MAKERS})[a-z0-9+.\- ]{{0,32}})', 1), '\s+', ' ', 'g')), ' ') AS words
  FROM models),
named AS (
  SELECT *, dev OR list_bool_or(list_transform(m, lambda x: list_bool_or(list_transform(['galaxy a15 4g', 'sm-a155f', 'a15', '4g'], lambda t: contains(lower(x), t))))) AS side, len(m) > 0 AND length(regexp_replace(n, '[a-z0-9-]', '', 'g')) < length(seg) * 0.35 AS listed,
    list_position(list_transform(words, lambda w, i: i > 1 AND list_contains({_words(devices.PHRASE_ENDS)}, regexp_replace(lower(w), '[^a-z0-9+]', '', 'g'))), true) AS stop
  FROM told),
phrased AS (
  SELECT * REPLACE (coalesce(side, dev) AS side), nullif(regexp_replace(array_to_string(words[1:CASE WHEN stop > 0 THEN least(stop - 1, 5) ELSE 5 END], ' '), '[,.;:]+$', ''), '') AS device FROM named),
fold AS (
  SELECT k, 0::BIGINT AS pos, 1::BIGINT AS next, 0::BIGINT AS place, NULL::VARCHAR AS seg, NULL::VARCHAR[] AS m, false AS own, false AS follows, NULL::VARCHAR AS kind, NULL::VARCHAR AS cat, NULL::VARCHAR AS praw, NULL::VARCHAR AS draw, NULL::DOUBLE AS w, false AS hit FROM pages
  UNION ALL
  SELECT k, pos, CASE WHEN found > 0 THEN next - 1 + found + length(seg) ELSE next END, CASE WHEN found > 0 THEN next - 1 + found ELSE 0 END, seg, m, own, follows,
    CASE WHEN own THEN coalesce(said, CASE WHEN dev AND part THEN 'unclear' ELSE 'spec_only' END) ELSE kind END, CASE WHEN own THEN coalesce(category, cat, 'battery') ELSE cat END, CASE WHEN own THEN coalesce(phrase, praw, 'Battery') ELSE praw END,
    CASE WHEN own THEN CASE WHEN regexp_matches(device, '\d') OR len(m) > 0 THEN device END ELSE draw END, CASE WHEN own THEN coalesce(weight, 0.35) ELSE 0.7 END, part OR num
  FROM (
    SELECT *, kind IS NOT NULL AND listed AND said IS NULL AND NOT own AS follows
    FROM (
      SELECT f.k, t.pos, f.next, instr(substr(p.text, f.next), t.seg) AS found, t.seg, t.m, t.dev, t.part, t.num, t.said, t.category, t.phrase, t.device, t.weight, t.listed, f.kind, f.cat, f.praw, f.draw,
        t.side AND (t.part OR t.num OR f.praw IS NOT NULL) AND (t.said IS NOT NULL OR t.part OR t.num) AS own
      FROM fold f JOIN phrased t ON t.k = f.k AND t.pos = f.pos + 1 JOIN pages p ON p.k = f.k))),
claim AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS ordinal, kind AS claim, seg, cat AS category, praw AS part_raw, draw AS device_raw, m, follows,
    CASE WHEN own THEN {{attributes}} ELSE '' END AS attributes,
    coalesce({", ".join(f"nullif({code(f'regexp_extract(seg, {lit(p)})')}, '')" for p in idents.OWN_NUMBERS)}, (SELECT arg_min(value, x.place) FROM numbers x WHERE x.k = fold.k AND fold.place > 0 AND x.place BETWEEN fold.place - 360 AND fold.place + length(seg) + 360), 'EB-BA155ABY') AS part_number,
    0.42 * w + CASE WHEN follows OR list_contains(m, 'SM-A155F') THEN 0.22 WHEN len(m) > 0 THEN 0.12 ELSE 0 END + CASE WHEN own AND regexp_matches(seg, {lit(idents.HAS_NUMBER)}) THEN 0.16 ELSE 0 END + 0.10 + CASE WHEN follows OR hit THEN 0.08 ELSE 0 END AS s
  FROM fold WHERE own OR follows),
claims AS (
  SELECT *, least(1.0, greatest(0.05, (s + CASE WHEN attributes <> '' THEN 0.05 ELSE 0 END) * CASE claim WHEN 'spec_only' THEN 0.8 WHEN 'unclear' THEN 0.85 ELSE 1 END)) AS strength FROM claim)
"""


def _attributes_sql() -> str:
    found = [f"nullif('{k}=' || left(trim(regexp_replace(regexp_extract(seg, {lit(p)}, 1), '\\s+', ' ', 'g')), 60), '{k}=')" for k, p in claims.ATTRIBUTES]
    return f"concat_ws(';', {', '.join(found)})"


CLAIMS_SQL = _CLAIMS_SQL.replace("{attributes}", _attributes_sql())


@query(f"""{CLAIMS_SQL}
SELECT k::VARCHAR AS source_id, ordinal::INT AS ordinal, claim, length(seg)::INT AS n_chars, category, part_raw, device_raw, array_to_string(m, ',') AS models, part_number, attributes, follows AS inherited, floor(strength * 1000 + 0.5)::INT AS permille FROM claims""")
def claim_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of customers' pages, with what is carried over from segment to segment."""
    found = customer_claims(spark, sf_dir)[1]
    stated = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(
        "source_id", "ordinal", "claim", F.length("evidence_text").alias("n_chars"), "category", "part_raw", "device_raw", F.array_join("model_numbers", ",").alias("models"), "part_number", stated.alias("attributes"), "inherited",
        F.floor(F.col("strength") * 1000 + 0.5).cast("int").alias("permille"),
    )


#: Checks of a battery: (check, indicators).
CHECKS = (("voltage", ("voltage", "3.85 v", "v")), ("capacity", ("mah",)), ("connector", ("connector", "pin_count")), ("size", ("inch",)), ("panel_technology", ("no such words",)), ("revision", ("rev 2",)), ("device_model", ()))


@query(f"""{CLAIMS_SQL},
around AS (SELECT c.*, p.text, instr(p.text, left(seg, 60)) AS place, string_split(attributes, ';') AS stated FROM claims c JOIN pages p ON p.k = c.k),
contexts AS (
  SELECT *, {norm("concat_ws(' ', CASE WHEN place > 0 THEN substr(text, greatest(1, place - 400), place - greatest(1, place - 400) + 800) ELSE '' END, seg, array_to_string(list_transform(stated, lambda x: split_part(x, '=', 1)), ' '), array_to_string(list_transform(stated, lambda x: split_part(x, '=', 2)), ' '))")} AS context FROM around),
items(check_id, words) AS (VALUES {", ".join(f"('{c}', {_words(w for w in words if len(w) > 2)}::VARCHAR[])" for c, words in CHECKS)}),
questions AS (SELECT DISTINCT c_custkey // {PAGES} AS q FROM customer),
hits AS (
  SELECT k // {PAGES} AS q, check_id, claim, k, CASE WHEN check_id = 'device_model' THEN len(m) > 0 ELSE coalesce(list_bool_or(list_transform(words, lambda w: contains(context, w))), false) END AS hit FROM contexts, items),
counted AS (
  SELECT q, check_id, count(*) FILTER (hit) AS n_claims, count(DISTINCT k) FILTER (hit) AS n_domains, bool_or(hit AND claim = 'compatible') AS yes, bool_or(hit AND claim = 'not_compatible') AS no FROM hits GROUP BY q, check_id),
stated AS (
  SELECT q, check_id, count(DISTINCT a) AS n FROM (SELECT k // {PAGES} AS q, split_part(unnest(stated), '=', 1) AS a FROM contexts)
  JOIN (VALUES {", ".join(f"('{a}', '{c}')" for a, checks in extraction.ATTRIBUTE_CHECKS for c in checks)}) t(attribute, check_id) ON a = attribute GROUP BY q, check_id)
SELECT s.q AS question_id, i.check_id, CASE WHEN i.check_id = 'device_model' THEN CASE WHEN n_claims > 0 THEN 'supported' ELSE 'unknown' END WHEN yes AND no THEN 'conflicting' WHEN no THEN 'contradicted' WHEN yes THEN 'supported' ELSE 'unknown' END AS status,
  coalesce(n_claims, 0) AS n_claims, coalesce(n_domains, 0) AS n_domains, coalesce(t.n, 0) AS n_attributes
FROM questions s CROSS JOIN items i LEFT JOIN counted c ON c.q = s.q AND c.check_id = i.check_id LEFT JOIN stated t ON t.q = s.q AND t.check_id = i.check_id""")
def checklist_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a battery for each question, from the claims of its pages, their surroundings and their attributes."""
    pages, found = customer_claims(spark, sf_dir)
    items = spark.createDataFrame([("battery", check, list(words)) for check, words in CHECKS], "category string, check_id string, indicators array<string>")
    questions = pages.select("question_id").distinct().select("question_id", F.lit("battery").alias("category"))
    # claims are read for their heads and their contexts, and these for checks and attributes: each is worked out once
    return extraction.run_checklists(questions, items, cut(extraction.claim_context(cut(found), pages)))


# --- families of clusters ------------------------------------------------------------------------

_NAMED = sorted(((a.strip(), b, len(a)) for b, _, names in devices.BRANDS for a in names), key=lambda n: -n[2])
_KEYS_SQL = rf"""{CLAIMS_SQL},
lead AS (
  SELECT *, coalesce(device_raw, 'Galaxy A15 4G') AS device, CASE {" ".join(f"WHEN regexp_matches(upper(m[1]), '{shape}') THEN '{b}'" for b, shape in devices.MODEL_BRANDS)} END AS first_brand FROM claims),
branded AS (
  SELECT *, CASE WHEN device_raw IS NOT NULL THEN coalesce(list_filter([{", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b, _ in _NAMED)}], lambda n: contains(' ' || {norm("device_raw")}, ' ' || n.a))[1].b, first_brand, 'samsung') ELSE coalesce(first_brand, 'samsung') END AS maker,
    trim(regexp_replace(regexp_replace({norm("device")}, '\b(galaxy|phone|smartphone|mobile)\b', ' ', 'g'), ' +', ' ', 'g')) AS name FROM lead),
families AS (SELECT *, CASE WHEN name <> '' AND NOT starts_with(name, maker) THEN maker || ' ' || name ELSE name END AS family FROM branded),
keyed AS (
  SELECT *, array_to_string(list_filter(string_split(family, ' '), lambda t: t <> '' AND NOT list_contains({_words([*devices.GENERATIONS, *devices.REGIONS])}, t)), ' ') AS base,
    [{", ".join(f"CASE WHEN regexp_matches(seg, {lit(p)}) THEN '{g}' END" for g, _, p in idents.VARIANTS if g in devices.GENERATIONS)}] AS gens FROM families),
marked AS (SELECT *, list_sort(list_filter(gens, lambda g: g IS NOT NULL)) AS gen FROM keyed),
clusters AS (
  SELECT k // {PAGES} AS q, base || '|' || array_to_string(gen, ',') AS cluster_key, any_value(base) AS base, any_value(gen) AS gen, count(*) FILTER (claim = 'compatible') AS n_support, count(*) FILTER (claim = 'not_compatible') AS n_oppose, count(DISTINCT k) AS n_domains,
    list_sort(list_distinct(flatten(list(m)))) AS models
  FROM marked GROUP BY 1, 2)
"""


@query(f"""{_KEYS_SQL}
SELECT q AS question_id, cluster_key, n_support, n_oppose, n_domains, array_to_string(models, ',') AS models,
  CASE WHEN base = 'samsung a15' THEN 'target' WHEN base <> '' AND (contains(base, 'samsung a15') OR contains('samsung a15', base)) THEN 'sibling' ELSE 'other' END AS side,
  coalesce(base <> '' AND (contains(base, 'samsung a15') OR contains('samsung a15', base)) AND len(gen) > 0 AND NOT list_contains(gen, '4g'), false) AS risk
FROM clusters""")
def sibling_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the claims of customers' pages, by what is asked for: on target, of a sibling or another family, and whether they are a risk."""
    from .operators import evidence, research

    pages, found = customer_claims(spark, sf_dir)
    understood = pages.select("question_id").distinct().select("question_id", F.lit("Galaxy A15 4G").alias("device"), F.lit("Samsung").alias("device_brand"), F.array(F.lit("4g")).alias("markers"))
    k = F.col("source_id")
    sources = pages.select("question_id", "source_id", F.concat(F.lit("https://c"), k, F.lit(".com/")).alias("canonical"), F.concat(F.lit("c"), k, F.lit(".com")).alias("domain"), F.lit("t").alias("title"), F.lit(False).alias("snippet_only"), F.lit(0.5).alias("quality"), k.cast("int").alias("ordinal"))
    clusters = evidence.clusters(cut(research.normalise_claims(found, sources, understood)))
    asked = research.target_keys(understood).select("question_id", "target_base", "markers")
    risks = evidence.variant_risks(clusters, asked, most=None).select("question_id", "cluster_key", F.lit(True).alias("_risk"))
    sided = evidence.siblings(clusters, asked.select("question_id", "target_base")).join(risks, ["question_id", "cluster_key"], "left")
    return sided.select("question_id", "cluster_key", "n_support", "n_oppose", "n_domains", F.array_join("model_numbers", ",").alias("models"), "side", F.coalesce("_risk", F.lit(False)).alias("risk"))


# --- judged questions ----------------------------------------------------------------------------

_ASKED = {"intent": "compatibility_check", "device": "Galaxy A15 4G", "device_brand": "Samsung", "part": "Battery", "part_category": "battery", "part_number": "EB-BA155ABY"}
_JUDGED_SQL = f"""{_KEYS_SQL},
normal AS (
  SELECT *, k // {PAGES} AS q, k % 11 / 10.0 AS quality, row_number() OVER (PARTITION BY k // {PAGES} ORDER BY k, ordinal) AS nth, list_sort(m) AS skus, list_contains(m, 'SM-A155F') AS model,
    base <> '' AND (contains(base, 'samsung a15') OR contains('samsung a15', base)) AS shared, {code("part_number")} = 'EB-BA155ABY' AS numbered FROM marked),
once AS (SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY q, k, claim, device, skus ORDER BY strength DESC, nth) = 1),
placed AS (
  SELECT *, model OR CASE WHEN family = '' THEN true ELSE shared AND (len(gen) = 0 OR list_contains(gen, '4g')) END AS exact, floor(strength * 1000 + 0.5) / 1000 AS st FROM once
  WHERE shared OR model OR list_bool_or(list_transform(m, lambda x: contains({norm("x")}, 'a15') OR contains({norm("x")}, '4g')))),
totals AS (
  SELECT q, count(*) FILTER (exact AND claim = 'compatible') AS s, count(*) FILTER (exact AND claim = 'not_compatible') AS o, count(*) FILTER (exact AND claim IN ('unclear', 'spec_only')) AS other, count(*) FILTER (NOT exact AND claim = 'compatible') AS sib,
    count(*) FILTER (NOT exact AND claim = 'not_compatible') AS against, coalesce(sum(st * (0.5 + 0.5 * quality)) FILTER (exact AND claim = 'compatible'), 0) AS ws, coalesce(sum(st * (0.5 + 0.5 * quality)) FILTER (exact AND claim = 'not_compatible'), 0) AS wo,
    coalesce(sum(st) FILTER (exact AND claim = 'compatible'), 0) AS ss, coalesce(sum(st) FILTER (exact AND claim = 'not_compatible'), 0) AS so, count(DISTINCT k) FILTER (exact AND claim = 'compatible') AS ds, count(DISTINCT k) FILTER (exact AND claim = 'not_compatible') AS d_o,
    coalesce(max(st) FILTER (exact AND claim = 'compatible'), 0) AS bs, coalesce(max(st) FILTER (exact AND claim = 'not_compatible'), 0) AS bo, coalesce(avg(quality) FILTER (exact AND claim = 'compatible'), 0) AS qual,
    count(DISTINCT k) FILTER (quality >= 0.6) AS good, bool_or(numbered) AS num, bool_or(exact) AS ex
  FROM placed GROUP BY q),
groups AS (SELECT q, base || '|' || array_to_string(gen, ',') AS key, any_value(base) AS base, any_value(gen) AS gen, count(*) FILTER (claim = 'compatible') AS s, count(*) FILTER (claim = 'not_compatible') AS o, bool_or(shared) AS shared FROM placed GROUP BY ALL),
split AS (SELECT q, count(*) FILTER (s > 0 AND o > 0) AS conflicts, least(3, count(*) FILTER (shared AND len(gen) > 0 AND NOT list_contains(gen, '4g'))) AS risks FROM (SELECT q, key, base, gen, sum(s) AS s, sum(o) AS o, bool_or(shared) AS shared FROM groups GROUP BY ALL) GROUP BY q),
filled AS (
  SELECT a.q, coalesce(s, 0) AS s, coalesce(o, 0) AS o, coalesce(other, 0) AS other, coalesce(sib, 0) AS sib, coalesce(against, 0) AS against, coalesce(ws, 0) AS ws, coalesce(wo, 0) AS wo, coalesce(ss, 0) AS ss, coalesce(so, 0) AS so, coalesce(ds, 0) AS ds, coalesce(d_o, 0) AS d_o,
    coalesce(bs, 0) AS bs, coalesce(bo, 0) AS bo, coalesce(qual, 0) AS qual, coalesce(good, 0) AS good, coalesce(num, false) AS num, coalesce(ex, false) AS ex, coalesce(conflicts, 0) AS conflicts, coalesce(risks, 0) AS risks, a.q % 5 / 4.0 AS coverage
  FROM (SELECT DISTINCT c_custkey // {PAGES} AS q FROM customer) a LEFT JOIN totals t ON a.q = t.q LEFT JOIN split p ON a.q = p.q),
ruled AS (
  SELECT *, CASE WHEN s + o + other + sib = 0 THEN 'insufficient_evidence' WHEN wo > 1.15 * ws AND d_o >= 1 AND bo >= 0.55 AND ds = 0 THEN 'not_compatible' WHEN s > 0 AND o > 0 THEN 'uncertain' WHEN o > 0 THEN CASE WHEN bo >= 0.55 THEN 'not_compatible' ELSE 'uncertain' END
    WHEN s = 0 AND sib > 0 THEN 'uncertain' WHEN s = 0 THEN CASE WHEN other > 0 THEN 'uncertain' ELSE 'insufficient_evidence' END WHEN ds >= 3 AND qual >= 0.6 AND bs >= 0.6 THEN 'compatible' WHEN ds >= 2 AND qual >= 0.5 THEN 'likely_compatible' WHEN bs >= 0.6 THEN 'likely_compatible' ELSE 'uncertain' END AS rule,
    least(1, greatest(0, qual)) * 0.24 + least(1, ds / 3.0) * 0.22 + CASE WHEN ss + so > 0 THEN ss / (ss + so) ELSE 0 END * 0.2 + least(1, coverage * 0.8 + CASE WHEN num THEN 0.2 ELSE 0 END) * 0.12 + CASE WHEN num THEN 0.12 ELSE 0 END + CASE WHEN good >= 2 THEN 0.06 ELSE 0 END + CASE WHEN ex THEN 0.04 ELSE 0 END
    - (least(0.25, conflicts * 0.12) + least(0.12, risks * 0.06) + CASE s + o WHEN 0 THEN 0.35 WHEN 1 THEN 0.12 ELSE 0 END + CASE WHEN ds = 1 THEN 0.08 ELSE 0 END + CASE WHEN NOT ex AND s + o > 0 THEN 0.12 ELSE 0 END) AS share
  FROM filled),
scored AS (SELECT *, CASE WHEN rule = 'compatible' AND NOT ex AND against > 0 THEN 'uncertain' ELSE rule END AS verdict, floor(least(1, greatest(0, share)) * 100 + 0.5)::INT AS raw FROM ruled),
levels AS (
  SELECT *, verdict IN ('compatible', 'likely_compatible') AS strong, verdict IN ('insufficient_evidence', 'research_failed', 'not_configured') AS none,
    CASE WHEN verdict = 'not_compatible' THEN greatest(raw, 60) WHEN verdict = 'insufficient_evidence' THEN least(raw, 18) WHEN s > 0 AND o > 0 THEN least(raw, 58) WHEN s = 0 THEN least(raw, 40) ELSE raw END AS held FROM scored),
named AS (
  SELECT *, CASE WHEN verdict = 'not_compatible' THEN 'NOT_COMPATIBLE' WHEN none THEN 'UNKNOWN' WHEN s > 0 AND o > 0 THEN CASE WHEN raw >= 55 THEN 'POSSIBLE' ELSE 'UNKNOWN' END WHEN s = 0 THEN CASE WHEN raw >= 35 THEN 'POSSIBLE' ELSE 'UNKNOWN' END
    WHEN strong AND ds >= 4 AND raw >= 85 AND good >= 2 AND o = 0 THEN 'CONFIRMED' WHEN strong AND ds >= 3 AND raw >= 72 THEN 'HIGH_CONFIDENCE' WHEN raw >= 55 THEN 'LIKELY' WHEN raw >= 35 THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS first_level FROM levels),
rails AS (SELECT *, CASE WHEN strong AND s > 0 AND o = 0 AND first_level = 'UNKNOWN' THEN 'POSSIBLE' ELSE first_level END AS rail FROM named)
"""


@query(_JUDGED_SQL.replace("named AS (\n  SELECT *, dev OR", "named_segments AS (\n  SELECT *, dev OR").replace("AS device FROM named)", "AS device FROM named_segments)") + """
SELECT q AS question_id, verdict, CASE WHEN strong AND s > 0 AND o = 0 AND rail = 'LIKELY' THEN greatest(held, 55) WHEN strong AND s > 0 AND o = 0 AND rail = 'POSSIBLE' THEN greatest(held, 35) ELSE held END AS score,
  CASE WHEN rail IN ('CONFIRMED', 'HIGH_CONFIDENCE') AND NOT ex THEN 'LIKELY' ELSE rail END AS level, s AS n_support, o AS n_oppose, sib AS n_sibling, ds AS d_support, conflicts AS n_conflicts, risks AS n_risks FROM rails""")
def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions judged by the claims of their two customers' pages: verdict, score and level, with what they follow from."""
    from .operators import research
    from .operators.dedupe import dedupe_claims

    pages, found = customer_claims(spark, sf_dir)
    k, q = F.col("source_id").cast("long"), F.col("question_id")
    asked = pages.select("question_id").distinct()
    understood = asked.select("question_id", *[F.lit(v).alias(n) for n, v in _ASKED.items()], F.array(F.lit("SM-A155F")).alias("model_numbers"), F.array(F.lit("4g")).alias("markers"))
    domain = F.concat(F.lit("c"), "source_id", F.lit(".com"))
    sources = pages.select("question_id", "source_id", F.concat(F.lit("https://"), domain, F.lit("/")).alias("canonical"), domain.alias("domain"), F.lit("t").alias("title"), F.lit(False).alias("snippet_only"), (k % 11 / 10.0).alias("quality"), k.cast("int").alias("ordinal"), F.lit(0).alias("n_findings"))
    checks = asked.select("question_id", F.posexplode(F.sequence(F.lit(1), F.lit(4))).alias("n", "x")).select("question_id", F.col("n").cast("string").alias("check_id"), F.when(F.col("n") < q % 5, "supported").otherwise("unknown").alias("status"))
    placed = cut(research.place_claims(dedupe_claims(research.normalise_claims(found, sources, understood)), understood))
    judged = research.judge_questions(understood, placed, checks, sources)
    return judged.select("question_id", "verdict", "score", "level", "n_support", "n_oppose", "n_sibling", "d_support", "n_conflicts", "n_risks")
