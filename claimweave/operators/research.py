"""From questions and pages to verdicts and answers: sources, claims, clusters, findings, judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import devices, parts, urls
from ..functions.claims import canonical_part
from ..functions.hashing import source_key, stable_hash
from ..functions.idents import normalize_identifier
from ..functions.once import dealt
from ..functions.safety import neutralise
from ..functions.scores import half_up
from ..functions.text import collapse_whitespace, normalize_match, truncate, word_count
from ..plans.questions import understand
from ..sources.search import page_text, read_results
from . import evidence
from .answers import with_answers
from .dedupe import dedupe_claims, first_by
from .extraction import claim_context, extract_claims, run_checklists
from .modelling import Model, propose_claims
from .reporting import conflict_sides
from .sourcing import score_sources
from .store import cut

#: Characters of a page that count (fixed value).
MOST_TEXT = 14_000


def build_sources(results: DataFrame) -> DataFrame:
    """Sources of search results (question_id, ordinal, url, title, snippet, published_at, raw_content, fetched).

    With content the text is that of the page, neutralised and cut; without, the snippet stands for it. ``fetched`` tells if the
    page itself was read, ``failure`` (if there is one) why it was not. Adds source_id, canonical, domain, site, text, n_words, n_findings and snippet_only.
    """
    c = F.col
    has = F.coalesce(c("raw_content"), F.lit("")) != ""
    # results of one file would be scanned by one task
    scanned = dealt(results, "question_id", "url").withColumn("_scan", F.when(has, neutralise(page_text(c("raw_content"), MOST_TEXT))))
    text = F.when(c("_scan").isNotNull(), truncate(c("_scan.clean"), MOST_TEXT)).otherwise(collapse_whitespace(F.coalesce("snippet", F.lit(""))))
    domain = urls.domain_of(c("url"))
    title = collapse_whitespace(F.coalesce("title", F.lit("")))
    rows = scanned.withColumn("text", text).withColumn("canonical", urls.canonical_url(c("url"))).withColumn("domain", domain)
    return rows.select(
        "question_id", "ordinal", F.substring(source_key(c("canonical")), 1, 16).alias("source_id"), "url", "canonical", "domain", urls.site_name(c("domain")).alias("site"),
        F.when(title == "", c("domain")).otherwise(title).alias("title"), collapse_whitespace(F.coalesce("snippet", F.lit(""))).alias("snippet"), "published_at", "text", "fetched", word_count(c("text")).alias("n_words"),
        F.coalesce(F.size("_scan.findings"), F.lit(0)).alias("n_findings"), (~has & ~c("fetched")).alias("snippet_only"), (c("failure") if "failure" in results.columns else F.lit(None).cast("string")).alias("failure"),
    )


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One source for each address, then one of the short pages that a domain has under one title.

    Of an address a page that was fetched beats one that was not, then the longer one. Pages of 80 words or more are never duplicates.
    """
    best = first_by(sources, ["question_id", "canonical"], F.desc("fetched"), F.desc("n_words"), F.asc("ordinal"))
    title = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    short = F.when(F.col("n_words") < 80, F.lit("")).otherwise(F.col("source_id"))
    return first_by(best.withColumn("_title", title).withColumn("_short", short), ["question_id", "domain", "_title", "_short"], F.asc("ordinal")).drop("_title", "_short")


def target_keys(understood: DataFrame) -> DataFrame:
    """``understood`` with target_base and target_variant, the keys of the device that is asked for; null without one."""
    base = devices.base_key(devices.family_key(F.col("device"), F.lower("device_brand")))
    return understood.withColumn("target_base", F.when(F.col("device").isNotNull(), base)).withColumn("target_variant", F.when(F.col("device").isNotNull(), devices.variant_key(F.col("target_base"), F.col("markers"))))


def targets(understood: DataFrame) -> DataFrame:
    """What claims are looked for, in the form that ``extract_claims`` takes."""
    c = F.col
    none = F.array().cast("array<string>")
    terms = lambda least, *given: F.array_distinct(F.filter(F.transform(F.concat(*given), lambda w: normalize_match(F.coalesce(w, F.lit("")))), lambda w: F.length(w) >= least))
    numbered = F.when(c("device").isNotNull(), F.filter(F.split(normalize_match(c("device")), " "), lambda w: w.rlike(r"\d"))).otherwise(none)
    device = terms(2, F.array("device", "device_brand"), c("model_numbers"), numbered)
    names = parts.aliases(c("part_category"))
    return understood.select(
        "question_id", device.alias("device_terms"), F.filter(device, lambda w: w.rlike(r"\d")).alias("device_cores"), terms(3, names, F.array("part", "part_number")).alias("part_terms"), F.transform(names, normalize_match).alias("aliases"),
        "part", "part_number", c("part_category").alias("category"), "model_numbers",
    )


def normalise_claims(claims: DataFrame, sources: DataFrame, understood: DataFrame) -> DataFrame:
    """Claims of ``extract_claims`` with their source, device, keys and quality, so that they can be compared.

    A device that a segment does not name is found by the shape of the model codes beside it; ``device_raw`` is the one that it names, or a list's claim before it. Adds claim_id, source_url, source_domain, snippet_only,
    device_raw, device_canonical, part_canonical, device_family_key, variant_key, source_quality and ordinal over all sources.
    """
    c = F.col
    held = sources.select("question_id", "source_id", F.col("canonical").alias("source_url"), F.col("domain").alias("source_domain"), F.col("title").alias("source_title"), "snippet_only", F.col("quality").alias("source_quality"), F.col("ordinal").alias("_source"))
    asked = understood.select("question_id", F.col("device").alias("_device"), F.lower("device_brand").alias("_brand"))
    joined = claims.join(held, ["question_id", "source_id"]).join(asked, "question_id")
    maker = F.coalesce(devices.brand_of(c("device_raw"))["brand"], devices.brand_of_models(c("model_numbers")), c("_brand"))
    family = F.when(c("device_raw").isNotNull(), devices.family_key(c("device_raw"), maker)).otherwise(devices.family_key(c("_device"), F.coalesce(devices.brand_of_models(c("model_numbers")), c("_brand"))))
    keyed = joined.withColumn("device_canonical", F.coalesce("device_raw", "_device", F.get("model_numbers", F.lit(0)))).withColumn("device_family_key", F.nullif(family, F.lit("")))
    ordered = F.row_number().over(Window.partitionBy("question_id").orderBy("_source", "ordinal"))
    return keyed.select(
        "question_id", stable_hash(source=c("source_id"), text=c("evidence_text"), claim=c("claim")).alias("claim_id"), "source_id", "source_url", "source_title", "source_domain", "snippet_only", "claim", "evidence_text",
        "device_raw", "device_canonical", "device_family_key", devices.variant_key(c("device_family_key"), c("variant_markers")).alias("variant_key"), "model_numbers", "variant_markers", "attributes",
        "part_raw", canonical_part(F.coalesce("part_raw", "category", F.lit("")))["canonical"].alias("part_canonical"), F.col("category").alias("part_category"), "part_number", "strength", "evidence_strength",
        F.coalesce("source_quality", F.lit(0.4)).alias("source_quality"), ordered.alias("ordinal"),
    )


def _overlap(a: Column, b: Column) -> Column:
    plain = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), normalize_identifier)
    return F.arrays_overlap(plain(a), plain(b))


def place_claims(claims: DataFrame, understood: DataFrame) -> DataFrame:
    """Normalised claims about what is asked for, with ``exact`` (the very configuration) and ``part_number_matched``.

    A reverse lookup takes claims on the part: its number, category or name. Else a claim must be on the device's
    family: a base key that contains the other, the same model code, or a code with the number of the device. It is exact with the same model code. Else, where no
    device is asked for, if it names none; where one is, if it names none, or one of the family unless both sides name generations and share none.
    """
    c = F.col
    asked = target_keys(understood).select("question_id", "intent", F.col("device").alias("_device"), F.col("part").alias("_part"), F.col("part_category").alias("_category"), F.col("part_number").alias("_number"), F.col("model_numbers").alias("_models"), F.col("markers").alias("_markers"), "target_base", "target_variant")
    rows = claims.join(asked, "question_id")
    number = F.coalesce(normalize_identifier(c("part_number")) == normalize_identifier(c("_number")), F.lit(False))
    on_part = number | F.coalesce(c("part_category") == c("_category"), F.lit(False)) | F.coalesce(normalize_match(c("part_raw")).contains(normalize_match(c("_part"))), F.lit(False))
    base = devices.base_key(c("device_family_key"))
    family = F.coalesce((base != "") & (base.contains(c("target_base")) | c("target_base").contains(base)), F.lit(False))
    model = _overlap(c("model_numbers"), c("_models"))
    cores = F.exists("model_numbers", lambda m: F.exists(devices.core_tokens(c("_device")), lambda k: normalize_match(m).contains(k)))
    same = family | model | F.coalesce(cores, F.lit(False))
    about = F.when(c("intent") == "part_to_phones", on_part).when(c("target_base").isNull(), F.coalesce(c("part_category") == c("_category"), F.lit(False))).otherwise(same)
    like = c("variant_key").isNull() | (family & evidence.same_generation(c("variant_markers"), c("_markers")))
    exact = model | F.when(c("target_variant").isNull(), c("variant_key").isNull()).otherwise(like)
    kept = rows.withColumn("exact", exact).withColumn("part_number_matched", number).where(about)
    return kept.select(*claims.columns, "exact", "part_number_matched", "intent", "_device", "_part")


def model_findings(placed: DataFrame, understood: DataFrame, side: str = "compatible") -> DataFrame:
    """Devices that claims of one side name, by cluster, best first: domains times mean quality.

    A cluster whose label is just the name of the part is left out. A question with a device but without any such cluster gets one
    finding of all its supporting claims.
    """
    c = F.col
    key = F.coalesce("variant_key", "device_family_key", F.concat(F.lit("target|"), F.coalesce("part_category", F.lit("other"))))
    sided = placed.where(c("claim") == side)
    label = F.min_by(F.coalesce("device_canonical", F.get("model_numbers", F.lit(0)), F.lit("Unspecified device")), "ordinal")
    totals = lambda by: (
        F.count_distinct("source_domain").alias("independent_sources"), half_up(F.avg("source_quality"), 3).alias("average_quality"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("model_numbers")))).alias("model_numbers"),
        F.array_sort(F.collect_set("claim_id")).alias("claim_ids"), F.bool_or(by).alias("part_number_matched"),
    )
    found = sided.groupBy("question_id", key.alias("cluster_key")).agg(label.alias("device"), F.first("_part", ignorenulls=True).alias("_part"), *totals(c("part_number_matched")))
    found = found.where(c("_part").isNull() | (normalize_match(c("device")) != normalize_match(c("_part")))).drop("_part")
    if side == "compatible":
        rest = sided.where(c("_device").isNotNull()).join(found.select("question_id").distinct(), "question_id", "left_anti")
        spare = rest.groupBy("question_id").agg(F.lit("target").alias("cluster_key"), F.first("_device").alias("device"), *totals(F.coalesce(c("part_number"), F.lit("")) != ""))
        found = found.unionByName(spare)
    order = Window.partitionBy("question_id").orderBy(F.desc(c("independent_sources") * c("average_quality")), "cluster_key")
    return found.withColumn("nth", F.row_number().over(order))


def part_findings(placed: DataFrame, understood: DataFrame) -> DataFrame:
    """Parts that supporting claims name, by number or else by name, with attributes: of each the value of the first claim that has it."""
    c = F.col
    key = F.when(F.coalesce("part_number", F.lit("")) != "", F.concat(F.lit("pn:"), normalize_identifier(c("part_number")))).otherwise(F.concat(F.lit("name:"), normalize_match(F.coalesce("part_canonical", "part_raw", "part_category", F.lit("part")))))
    keyed = placed.where("claim = 'compatible'").withColumn("part_key", key)
    totals = keyed.groupBy("question_id", "part_key").agg(F.min_by("part_canonical", "ordinal").alias("part_name"), F.min_by("part_number", "ordinal").alias("part_number"), F.count_distinct("source_domain").alias("independent_sources"), half_up(F.avg("source_quality"), 3).alias("average_quality"))
    values = keyed.select("question_id", "part_key", "ordinal", F.explode("attributes").alias("k", "v")).groupBy("question_id", "part_key", "k").agg(F.min_by("v", "ordinal").alias("v"))
    maps = values.groupBy("question_id", "part_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    order = Window.partitionBy("question_id").orderBy(F.desc("independent_sources"), "part_key")
    return totals.join(maps, ["question_id", "part_key"], "left").withColumn("nth", F.row_number().over(order))


def judge_questions(understood: DataFrame, placed: DataFrame, checks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a question with totals, verdict, score and level.

    A reverse lookup counts the domains of the devices found: two make it compatible, one likely. A verdict from siblings alone is never better than
    uncertain. Questions without claims on what they ask for are judged as having no evidence.
    """
    c = F.col
    totals = evidence.side_totals(placed)
    clusters = evidence.clusters(placed)
    split = evidence.conflicts(clusters).groupBy("question_id").agg(F.count("*").alias("n_conflicts"))
    asked = target_keys(understood)
    found = evidence.variant_risks(clusters, asked.select("question_id", "target_base", "markers"))
    risks = found.groupBy("question_id").agg(F.count("*").alias("n_risks"), F.sort_array(F.collect_list(F.struct("nth", F.concat(F.lit("Evidence on "), F.coalesce("label", F.lit("another device")), F.lit(" is on another variant.")).alias("said"))))["said"].alias("risks"))
    sibling = placed.groupBy("question_id").agg(
        F.count_distinct(F.when(c("claim") == "compatible", c("source_domain"))).alias("_found"), F.count_if(~c("exact") & (c("claim") == "not_compatible")).alias("_against"), F.count_if(c("snippet_only") & c("exact") & (c("claim") == "compatible")).alias("n_snippet_only"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("model_numbers")))).alias("_codes"), F.array_sort(F.collect_set("part_number")).alias("_numbers"),
    )
    done = checks.groupBy("question_id").agg((F.count_if(c("status") == "supported") / F.count("*")).alias("coverage"), F.array_sort(F.collect_list(F.struct(c("check_id").alias("label"), "status"))).alias("checks"))
    read = sources.groupBy("question_id").agg(F.count("*").alias("n_sources"), F.count_if(c("n_findings") > 0).alias("n_injected"))
    base = asked.select("question_id", "intent", "device", "part", F.col("part_category").alias("category"))
    for part in (totals, split, risks, sibling, done, read):
        base = base.join(part, "question_id", "left")
    zero = [f.name for f in totals.schema.fields if f.dataType.simpleString() in ("bigint", "double")]
    filled = base.fillna(0, [*zero, "n_conflicts", "n_risks", "n_sources", "n_injected", "n_snippet_only", "_found", "_against"]).fillna(0.0, ["coverage"]).fillna(False, ["number", "has_exact"])
    return evidence.judge(filled, reverse=(c("intent") == "part_to_phones"), found=c("_found"), demoted=c("device").isNotNull() & ~c("has_exact") & (c("_against") > 0)).withColumn("model_numbers", c("_codes")).withColumn("part_numbers", c("_numbers")).drop("_found", "_against", "_codes", "_numbers")


def as_extracted(accepted: DataFrame) -> DataFrame:
    """Accepted claims of a model (of ``accept_claims``) in the form of ``extract_claims``, after those of the page itself."""
    order = Window.partitionBy("question_id", "source_id").orderBy("claim_id")
    return accepted.select(
        "question_id", "source_id", (F.row_number().over(order) + AFTER_PAGE).alias("ordinal"), "claim", "evidence_text", F.col("part_category").alias("category"), "part_raw", F.col("device_canonical").alias("device_raw"), "model_numbers",
        "variant_markers", "attributes", F.lit(False).alias("inherited"), "part_number", "strength", "evidence_strength",
    )


#: Places of a model's claims come after all segments of a page.
AFTER_PAGE, MOST_PAGES = 1_000_000, 10


def research(questions: DataFrame, results: DataFrame, checklist: DataFrame, as_of: Column, pages: DataFrame | None = None, max_pages: int = MOST_PAGES, model: Model | None = None) -> dict[str, DataFrame]:
    """The whole run over a batch of questions: tables ``understood``, ``sources``, ``claims``, ``models``, ``parts``, ``checks``, ``clusters``, ``conflicts`` and ``reports``.

    ``questions``: question_id, question (and mode). ``results``: what searches gave, as :func:`build_sources` takes them; with ``pages`` (canonical, content, failure) the
    most promising ``max_pages`` of each question are read from there, as ``read_results`` does. ``checklist``:
    category, check_id, indicators. A ``model`` adds claims on good pages without any, and ``refused`` has its replies that did not hold. Every table carries
    question_id, so a batch of any size is joins and groups by it. Tables that several others read are worked out once.
    """
    understood = cut(understand(questions))
    found = results if pages is None else read_results(results, pages, max_pages)
    sources = cut(dedupe_sources(build_sources(found)))
    scored = cut(score_sources(sources, understood.select("question_id", "device", "part", "part_number", "part_category", "model_numbers"), as_of))
    raw = cut(extract_claims(scored.select("question_id", "source_id", "text"), targets(understood)))
    out = {}
    if model is not None:
        accepted, out["refused"] = propose_claims(model, scored.select("question_id", "source_id", "text", "quality"), raw, understood)
        raw = cut(raw.unionByName(as_extracted(accepted)))
    claims = dedupe_claims(normalise_claims(raw, scored, understood))
    placed = cut(place_claims(claims, understood))
    context = claim_context(placed, scored)
    checks = cut(run_checklists(understood.select("question_id", F.col("part_category").alias("category")), checklist, context))
    judged = judge_questions(understood, placed, checks, scored)
    clusters = evidence.clusters(placed)
    return out | {
        "understood": understood, "sources": scored, "claims": placed, "models": model_findings(placed, understood), "against": model_findings(placed, understood, "not_compatible"), "parts": part_findings(placed, understood), "checks": checks,
        "clusters": clusters, "conflicts": conflict_sides(evidence.conflicts(clusters), placed), "reports": with_answers(judged),
    }
