"""Claims from page texts, and checklists over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import BRAND_MENTION, any_in, attributes, claim_match
from ..functions.devices import device_phrase
from ..functions.idents import HAS_NUMBER, number_near, own_number, placed_numbers, segment_models, variant_markers
from ..functions.once import bind, dealt, with_once, with_shared
from ..functions.parts import category_within
from ..functions.safety import MARKER, TAG_MARKER
from ..functions.scores import claim_strength, half_up, strength_level
from ..functions.text import admissible, normalize_match, split_segments, truncate

#: Attributes by the checks that they speak for (fixed values).
ATTRIBUTE_CHECKS = (
    ("connector", ("connector", "charging_port", "connector_type")),
    ("pin_count", ("connector", "charging_port")),
    ("revision", ("board_design", "display_revision", "battery_revision", "revision")),
    ("voltage", ("voltage",)),
    ("capacity", ("capacity",)),
    ("dimensions", ("dimensions", "device_dimensions")),
    ("size", ("size",)),
    ("resolution", ("resolution",)),
    ("panel", ("panel_technology",)),
    ("frame", ("frame",)),
    ("megapixels", ("sensor",)),
)


def _places(text: Column, segments: Column) -> Column:
    """Where each segment begins in its text, from 1, looked for after the one before; 0 for one that cleaning changed."""

    def step(held: Column, segment: Column) -> Column:
        at = F.position(segment, text, held["next"])
        return F.struct(F.when(at > 0, at + F.length(segment)).otherwise(held["next"]).alias("next"), F.array_append(held["places"], at).alias("places"))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("places"))
    return F.aggregate(segments, start, step, lambda held: held["places"])


def segments_of(pages: DataFrame) -> DataFrame:
    """Rows (question_id, source_id, page, pos, segment, nearby) of pages (question_id, source_id, text): the segments that can be evidence.

    ``nearby`` is the first part number of the page within 360 characters. ``page`` tells rows of equal keys apart. Segments with text that the defence against
    instructions has changed are left out. Places are worked out only for pages that have a part number at all. Pages are dealt out first, so that one
    file of them is not one task.
    """
    c = F.col
    rows = dealt(pages.select("question_id", "source_id", F.coalesce("text", F.lit("")).alias("text")), "question_id", "source_id")
    told = with_once(rows, _segments=F.filter(split_segments(c("text")), lambda s: admissible(s) & ~s.contains(MARKER) & ~s.contains(TAG_MARKER)), _numbers=placed_numbers(c("text")))
    places = F.when(F.size("_numbers") > 0, _places(c("text"), c("_segments")))
    held = told.select("question_id", "source_id", F.monotonically_increasing_id().alias("page"), "_segments", "_numbers", places.alias("_places"))
    rows = held.select("question_id", "source_id", "page", "_numbers", "_places", F.posexplode("_segments").alias("pos", "segment"))
    near = F.when(c("_places").isNotNull(), number_near(c("_numbers"), F.get("_places", c("pos")), F.length("segment")))
    return rows.select("question_id", "source_id", "page", "pos", "segment", near.alias("nearby"))


def extract_claims(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims of pages (question_id, source_id, text) on what questions ask for.

    ``targets``: question_id, device_terms, device_cores, part_terms, aliases (arrays, normalised; aliases of the category longest first), part, part_number,
    category, model_numbers. A segment with the device and the part (or a part carried over from an earlier claim of the page) and a wording or the
    part itself is a claim; a bare list of models after a claim repeats it. What is carried over is the last of earlier claims' values, so the segments that
    name a device or a model are sorted by page and read by windows; all others are left out before. What a segment tells by itself is worked out once for
    those that are equal. Null and empty texts give no claims.
    """
    c = F.col
    asked = targets.withColumn("_asked", F.transform("model_numbers", normalize_match)).withColumn("_asked_number", normalize_match(c("part_number")))
    apart = ["question_id", "source_id", "pos"]
    segments = segments_of(pages)
    models = segment_models(c("segment"))
    read = with_shared(segments, "segment", apart, _norm=normalize_match(c("segment")), _told=bind(models, lambda m: F.struct(m.alias("models"), F.transform(m, normalize_match).alias("plain"))), _brand=c("segment").rlike(BRAND_MENTION))
    # neither questions nor segments are few: by the size of their files they pass for a broadcast
    rows = read.select(*segments.columns, "_norm", c("_told.models").alias("_models"), c("_told.plain").alias("_plain"), "_brand").join(asked.hint("merge"), "question_id")
    device = any_in(c("_norm"), c("device_terms"))
    family = F.exists("_models", lambda m: any_in(F.lower(m), c("device_cores")))
    unasked = (F.size("device_terms") == 0) & ((F.size("_models") > 0) | c("_brand"))
    sided = with_once(rows, _device=device, _side=device | family | unasked).where(c("_side") | (F.size("_models") > 0))
    number = F.coalesce(c("_norm").contains(c("_asked_number")), F.lit(False))
    named = with_once(
        sided, _part=any_in(c("_norm"), c("part_terms")) & c("_side"), _number=number & c("_side"), _phrase=F.when(c("_side"), F.get(F.filter("aliases", lambda a: c("_norm").contains(a)), F.lit(0))),
        _exact=F.coalesce(F.arrays_overlap("_plain", "_asked"), F.lit(False)),
    ).withColumn("_named", c("_part") | c("_number"))
    # the lists of the question have done their part, and are not carried on with each segment
    named = named.select(*segments.columns, "_norm", "_models", "_device", "_side", "_part", "_named", "_phrase", "_exact", "part", "part_number", "category")
    told = with_shared(
        named, "segment", apart, _said=claim_match(c("segment")), _within=category_within(c("_norm")), _listed=(F.size("_models") > 0) & (F.length(F.regexp_replace("_norm", "[a-z0-9-]", "")) < F.length("segment") * 0.35),
        _device_phrase=device_phrase(c("segment")), _attributes=attributes(c("segment")), _own_number=own_number(c("segment")), _numbered=c("segment").rlike(HAS_NUMBER), variant_markers=variant_markers(c("segment")),
    ).drop("_norm").withColumn("_category", F.when(c("_side"), c("_within")))
    part = F.nullif(c("part"), F.lit(""))
    page = Window.partitionBy("question_id", "source_id", "page").orderBy("pos")
    before, so_far = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(Window.unboundedPreceding, 0)
    # a part is carried from the first segment on that names one: the question's part stands in for a segment's own
    opens = c("_side") & F.when(part.isNotNull(), c("_named")).otherwise(c("_phrase").isNotNull())
    carried = dealt(told, "question_id", "source_id").withColumn("_carried", F.coalesce(F.max(opens).over(before), F.lit(False)))
    own = c("_side") & (c("_named") | c("_carried")) & (c("_said").isNotNull() | c("_named"))
    kind = F.coalesce(c("_said.kind"), F.when(c("_device") & c("_part"), "unclear").otherwise("spec_only"))
    context = F.struct(kind.alias("kind"), F.when(c("_device_phrase").rlike(r"\d") | (F.size("_models") > 0), c("_device_phrase")).alias("device_raw"))
    marked = carried.withColumn("_own", own).withColumn("_context", F.when(c("_own"), context))
    read = marked.select(
        "*", F.last("_context", ignorenulls=True).over(so_far).alias("_last"),
        F.coalesce(F.last(F.when(c("_own"), c("_category")), ignorenulls=True).over(so_far), c("category")).alias("_category_raw"), F.coalesce(F.last(F.when(c("_own"), c("_phrase")), ignorenulls=True).over(so_far), part).alias("part_raw"),
    )
    follows = ~c("_own") & c("_last").isNotNull() & c("_listed") & c("_said").isNull()
    found = read.withColumn("inherited", follows).where(c("_own") | c("inherited"))
    found = found.withColumn("ordinal", F.row_number().over(page) - 1).withColumn("claim", c("_last.kind"))
    found = found.withColumn("attributes", F.when(c("inherited"), F.create_map().cast("map<string,string>")).otherwise(c("_attributes")))
    exact = c("inherited") | c("_exact")
    weight = F.when(c("inherited"), 0.7).otherwise(F.coalesce(c("_said.weight"), F.lit(0.35)))
    strength = claim_strength(weight, exact, F.size("_models") > 0, ~c("inherited") & c("_numbered"), F.lit(True), c("inherited") | c("_named"), F.size("attributes") > 0, c("claim"))
    return with_once(found, _strength=strength).select(
        "question_id", "source_id", "ordinal", "claim", truncate(c("segment"), 320).alias("evidence_text"), c("_category_raw").alias("category"), "part_raw", c("_last.device_raw").alias("device_raw"), c("_models").alias("model_numbers"),
        "variant_markers", "attributes", "inherited", F.coalesce("_own_number", "nearby", "part_number").alias("part_number"),
        half_up(c("_strength"), 3).alias("strength"), strength_level(c("_strength")).alias("evidence_strength"),
    )


def claim_context(claims: DataFrame, sources: DataFrame, before: int = 400, after: int = 800) -> DataFrame:
    """``claims`` with ``context``: normalised text around the claim in its source, the claim and its attributes.

    Claims are gathered by page (a page has no more claims than segments), so a page's text is read once however many claims it has.
    """
    key = ["question_id", "source_id"]
    texts = sources.select(*key, F.col("text").alias("_text"))
    heads = claims.select(*key, F.substring("evidence_text", 1, 60).alias("_head")).distinct().groupBy(*key).agg(F.collect_list("_head").alias("_heads"))

    def around(head: Column) -> Column:
        at = F.position(head, F.col("_text"))
        first = F.greatest(F.lit(1), at - before)
        return F.when(at > 0, F.substring(F.col("_text"), first, at - first + after)).otherwise(F.lit(""))

    near = heads.join(texts, key).select(*key, F.inline(F.transform("_heads", lambda h: F.struct(h.alias("_head"), around(h).alias("_near")))))
    joined = claims.withColumn("_head", F.substring("evidence_text", 1, 60)).join(near, [*key, "_head"], "left")
    words = F.concat_ws(" ", F.coalesce("_near", F.lit("")), "evidence_text", F.array_join(F.map_keys("attributes"), " "), F.array_join(F.map_values("attributes"), " "))
    return joined.withColumn("context", normalize_match(words)).select(*claims.columns, "context")


def attribute_checks(claims: DataFrame) -> DataFrame:
    """Rows (question_id, check_id, attribute) of the checks that some claim's attributes speak for."""
    table = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in ATTRIBUTE_CHECKS]), F.array(*[F.array(*[F.lit(x) for x in checks]) for _, checks in ATTRIBUTE_CHECKS]))
    stated = claims.select("question_id", F.explode(F.map_keys("attributes")).alias("attribute")).distinct()
    return stated.select("question_id", "attribute", F.explode(F.try_element_at(table, F.col("attribute"))).alias("check_id"))


def run_checklists(questions: DataFrame, items: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows (question_id, check_id, status, n_claims, n_domains, n_attributes) for each item of the checklist of a question's category.

    ``questions``: question_id, category. ``items``: category, check_id, indicators; a check is mentioned where a
    claim's context has an indicator of three letters or more. Checks that are mentioned are decided by the kinds of the claims; one that only attributes
    speak for (``n_attributes``) or that is mentioned without a side is unknown like one that nothing speaks for, but not unmentioned.
    ``device_model`` is supported as soon as a claim names a model. Questions without claims have each item once, as unknown.
    """
    wanted = questions.select("question_id", "category").join(items, "category")
    asked = wanted.withColumn("_in", F.filter(F.transform("indicators", normalize_match), lambda i: F.length(i) >= 3))
    domain = F.col("source_domain") if "source_domain" in claims.columns else F.col("source_id")
    own = claims.select("question_id", "claim", "context", domain.alias("_domain"), (F.size("model_numbers") > 0).alias("_models"))
    joined = asked.join(own, "question_id", "left")
    model = F.col("check_id") == "device_model"
    hit = F.coalesce(F.when(model, F.col("_models")).otherwise(any_in(F.col("context"), F.col("_in"))), F.lit(False))
    marked = joined.withColumn("_hit", hit)
    side = lambda kind: F.bool_or(F.col("_hit") & ~model & F.coalesce(F.col("claim") == kind, F.lit(False)))
    totals = marked.groupBy("question_id", "check_id").agg(
        side("compatible").alias("_for"), side("not_compatible").alias("_against"), F.bool_or(F.col("_hit") & model).alias("_named"), F.count_if("_hit").alias("n_claims"), F.count_distinct(F.when(F.col("_hit"), F.col("_domain"))).alias("n_domains")
    )
    stated = attribute_checks(claims).groupBy("question_id", "check_id").agg(F.count("*").alias("n_attributes"))
    status = F.when(F.col("_named"), "supported").when(F.col("_for") & F.col("_against"), "conflicting").when(F.col("_against"), "contradicted").when(F.col("_for"), "supported").otherwise("unknown")
    both = totals.join(stated, ["question_id", "check_id"], "left")
    return both.select("question_id", "check_id", status.alias("status"), "n_claims", "n_domains", F.coalesce("n_attributes", F.lit(0).cast("long")).alias("n_attributes"))
