"""Claims that a model proposes: what it says is only kept where a page says it too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parts
from ..functions.claims import claim_kind
from ..functions.hashing import stable_hash
from ..functions.idents import normalize_identifier
from ..functions.scores import claim_strength, half_up, strength_level
from ..functions.text import collapse_whitespace, normalize_match, truncate

#: Characters that a quote has at least, and how many of it must stand in the page (fixed values).
SHORTEST_QUOTE, QUOTED = 15, 120
#: Part numbers in a quote (fixed value).
QUOTED_NUMBER = r"(?i)gh\d{2}-|eb-|bn\d{2}[a-z]?|821-"

#: The form in which :func:`accept_claims` takes proposals.
PROPOSAL = (
    "question_id long, ref string, claim string, evidenceText string, deviceRaw string, partRaw string, partCategory string, partNumber string, modelNumbers array<string>, variantMarkers array<string>, attributes map<string,string>"
)


def loose_json(text: Column) -> Column:
    """The JSON object in a model's reply: the whole of it, else from the first brace to the last; null if neither is one."""
    whole = F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(whole), valid(inner))


def accept_claims(proposed: DataFrame, sources: DataFrame, understood: DataFrame) -> DataFrame:
    """The proposals (PROPOSAL) that their source bears out, as claims.

    ``sources``: question_id, ref, source_id, text. A proposal needs a known ref and a quote of 15 characters that stands in the page; a
    made-up quote never does. Of model codes those stay that the quote or the page has. Categories must be known ones, else the question's
    counts. Proposals of other questions' sources are left out.
    """
    c = F.col
    held = sources.select("question_id", "ref", "source_id", collapse_whitespace(c("text")).alias("_page"))
    asked = understood.select("question_id", F.col("part").alias("_part"), F.col("part_category").alias("_category"), F.col("device").alias("_device"), F.col("model_numbers").alias("_models"))
    rows = proposed.join(held, ["question_id", "ref"]).join(asked, "question_id").withColumn("_quote", collapse_whitespace(F.coalesce("evidenceText", F.lit(""))))
    rows = rows.where((F.length("_quote") >= SHORTEST_QUOTE) & c("_page").contains(F.substring("_quote", 1, QUOTED)))
    listed = F.transform(F.coalesce("modelNumbers", F.array().cast("array<string>")), normalize_identifier)
    rows = rows.withColumn("model_numbers", F.filter(listed, lambda m: (F.length(m) >= 3) & (F.upper("_quote").contains(m) | F.upper("_page").contains(m)))).withColumn("kind", claim_kind(c("claim")))
    known = [name for name, _, _, _ in parts.CATEGORIES]
    exact = F.exists("model_numbers", lambda m: F.exists("_models", lambda a: normalize_match(a) == normalize_match(m)))
    own = F.map_from_entries(F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.substring(e["key"], 1, 40).alias("key"), F.substring(e["value"], 1, 60).alias("value"))))
    weight = F.when(c("kind").isin("compatible", "not_compatible"), 0.9).otherwise(0.5)
    given = lambda name: F.coalesce(c(name), F.lit("")) != ""
    strength = claim_strength(weight, exact, F.size("model_numbers") > 0, c("_quote").rlike(QUOTED_NUMBER), given("deviceRaw"), given("partRaw"), F.size(F.coalesce("attributes", F.create_map().cast("map<string,string>"))) > 0, c("kind"))
    return rows.select(
        "question_id", "source_id", F.substring(stable_hash(ref=c("ref"), text=c("_quote"), claim=c("kind")), 1, 20).alias("claim_id"), c("kind").alias("claim"), truncate(c("_quote"), 320).alias("evidence_text"),
        F.coalesce(F.substring("deviceRaw", 1, 120), "_device").alias("device_canonical"), F.coalesce(F.substring("partRaw", 1, 120), "_part").alias("part_raw"), F.when(c("partCategory").isin(*known), c("partCategory")).otherwise(c("_category")).alias("part_category"),
        F.substring(normalize_identifier(c("partNumber")), 1, 40).alias("part_number"), "model_numbers", F.slice(F.coalesce("variantMarkers", F.array().cast("array<string>")), 1, 6).alias("variant_markers"), own.alias("attributes"),
        half_up(strength, 3).alias("strength"), strength_level(strength).alias("evidence_strength"), F.lit("ai").alias("extraction_method"),
    )
