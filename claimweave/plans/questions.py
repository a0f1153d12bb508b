"""Questions to intents and search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import devices, parts
from ..functions.hashing import research_key
from ..functions.idents import model_numbers, part_numbers, variant_label, variant_markers
from ..functions.once import bind, dealt, with_once
from ..functions.text import collapse_whitespace, normalize_match

#: (intent, weight, pattern) on the question; of equal sums the intent whose pattern fits first wins (fixed values).
INTENTS = (
    ("part_to_phones", 3, r"(?i)\b(what|which|any)\b[^?]*\b(phones?|models?|devices?|handsets?)\b[^?]*\b(use|uses|take|takes|fit|fits|work|works|compatible)\b"),
    ("part_to_phones", 2, r"(?i)\b(this|these|my)\b[^?]*\b(flex|part|battery|screen|display|board|coil|module|cable)\b[^?]*\b(fits?|go(es)? in|belongs to|used (in|on))\b"),
    ("part_to_phones", 3, r"(?i)\b(flex|part|battery|screen|display|board|coil|camera|speaker)\b[^?]*\bcompatible (phones|models|devices)\b"),
    ("identify", 3, r"(?i)\b(identify|what (is|'s) this|which part is this|decode|what part number|identify this part)\b"),
    ("phone_to_parts", 3, r"(?i)\bwhat\b[^?]*\b(screens?|batteries|battery|displays?|flex(es)?|cams?|cameras?|speakers?|parts?)\b[^?]*\b(work|works|fit|fits|are compatible|can i use|do i need)\b"),
    ("phone_to_parts", 2, r"(?i)\b(find|looking for|need|source|which|where (can|to) (i|buy))\b[^?]*\b(replacement )?(screens?|batteries|battery|charging flex|flex(es)?|display|part|parts)\b"),
    ("compatibility_check", 3, r"(?i)\b(can i|can you|could i|is it possible to|will it|does it|would it)\b[^?]*\b(use|fit|work|swap|install|replace)\b"),
    ("compatibility_check", 3, r"(?i)\bcompatible with\b|\binterchangeable\b|\bwill (this|it) work\b|\bfit (my|a|an|the)\b"),
)
#: Intents that a request can ask for, by mode (fixed values).
MODES = {
    "phone": "phone_to_parts", "phone_to_parts": "phone_to_parts", "part": "part_to_phones", "part_to_phones": "part_to_phones",
    "compatibility": "compatibility_check", "check": "compatibility_check", "identify": "identify",
}
#: Regions by the words that name them, in order of precedence (fixed values).
REGIONS = (
    ("US", r"(?i)\b(us|usa|united states|american)\b"),
    ("EU", r"(?i)\b(eu|europe|european|uk|britain)\b"),
    ("IN", r"(?i)\b(india|indian)\b"),
    ("CN", r"(?i)\b(china|chinese|cn)\b"),
    ("KR", r"(?i)\b(korea|korean)\b"),
    ("LATAM", r"(?i)\b(latam|latin america|brazil|mexico)\b"),
    ("MEA", r"(?i)\b(middle east|africa|uae|nigeria|kenya)\b"),
    ("GLOBAL", r"(?i)\b(global|international|worldwide)\b"),
)
#: Makers that count even where no device is named, in order of precedence (fixed values).
MAKERS = (
    "samsung", "apple", "xiaomi", "huawei", "oppo", "vivo", "oneplus", "realme", "motorola", "nokia", "sony", "lg", "google", "tecno", "infinix", "itel", "tcl", "alcatel", "asus", "lenovo", "zte",
    "nothing", "meizu", "fairphone", "sharp", "blackview",
)
#: Categories of parts by how their numbers begin (fixed values).
NUMBER_CATEGORIES = (("battery", r"(?i)^(EB-|BN\d)"), ("screen", r"(?i)^GH\d{2}-"), ("screen", "(?i)^821-"))
MOST_QUERIES, SHORTEST_QUERY = 6, 6


#: Phrases, and then words, that do not tell questions apart (fixed values).
FILLER_PHRASES = r"\b(can i|can you|please|pls|hi|hello|hey|do i need|is it possible to|i want to|i need to|help me)\b"
FILLER_WORDS = r"\b(what|which|does|do|is|are|will|would|the|a|an)\b"


def normalize_question(c: Column) -> Column:
    """The form under which equal questions are one: normalised, without filler phrases and words."""
    bare = F.regexp_replace(F.regexp_replace(normalize_match(F.coalesce(c, F.lit(""))), FILLER_PHRASES, " "), FILLER_WORDS, " ")
    return collapse_whitespace(bare)


def compose_question(free_text: Column, device: Column, model: Column, part: Column, number: Column) -> Column:
    """A question from the fields of a form: the first that is not blank leads, the others stand in brackets. Empty without any."""
    given = F.filter(F.array(*[F.trim(F.coalesce(f, F.lit(""))) for f in (free_text, device, model, part, number)]), lambda f: f != "")
    rest = F.slice(given, 2, 5)
    extra = F.when(F.size(rest) > 0, F.concat(F.lit(" ("), F.array_join(rest, ", "), F.lit(")"))).otherwise("")
    return F.when(F.size(given) == 0, "").otherwise(F.concat(F.lit("Is "), F.get(given, F.lit(0)), extra, F.lit(" compatible and which devices does it fit?")))


def requested_intent(mode: Column) -> Column:
    """The intent that a mode asks for; null for other modes."""
    out = F.lit(None).cast("string")
    for name, intent_ in MODES.items():
        out = F.when(mode == name, intent_).otherwise(out)
    return out


def scored_intent(question: Column) -> Column:
    """The intent of the largest sum of weights of the patterns that fit; null if none fits."""


    def best(hits: Column) -> Column:
        entries = []
        for name in dict.fromkeys(i for i, _, _ in INTENTS):
            own = [k for k, (i, _, _) in enumerate(INTENTS) if i == name]
            first = F.least(*[F.when(F.get(hits, F.lit(k)) > 0, k).otherwise(99) for k in own], F.lit(99))
            entries.append(F.struct((-sum((F.get(hits, F.lit(k)) for k in own), F.lit(0))).alias("minus"), first.alias("first"), F.lit(name).alias("intent")))
        return F.array_min(F.array(*entries))

    hits = F.array(*[F.when(question.rlike(p), w).otherwise(0) for _, w, p in INTENTS])
    return bind(bind(hits, best), lambda b: F.when(b["minus"] < 0, b["intent"]))


def _first_that(pairs, text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(pairs):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def understand(questions: DataFrame) -> DataFrame:
    """``questions`` (question_id, question, and mode if there is one) with what each asks for.

    Adds normalized, intent, device, device_brand, family_key, model_numbers, markers, part, part_category, part_numbers,
    part_number, manufacturer, region and bare (the question is just an identifier). A mode decides the intent. Else the patterns do,
    then what is named: a device and a part ask for a check, a device for parts, a part for phones.
    """
    c = F.col
    asked = with_once(dealt(questions, "question_id"), _q=F.trim(F.coalesce("question", F.lit(""))))
    asked = with_once(asked, normalized=normalize_match(c("_q")))
    asked = with_once(asked, _brand=devices.brand_of(c("_q"), c("normalized")))
    read = with_once(asked, model_numbers=model_numbers(c("_q"), c("_brand.brand")), part_numbers=part_numbers(c("_q")), markers=variant_markers(c("_q")))
    read = with_once(read, _device=devices.device_mention(c("_q"), c("model_numbers"), c("normalized"), c("_brand")), _part=parts.part_mention(c("_q"), c("normalized")), _scored=scored_intent(c("_q")))
    read = read.withColumn("bare", c("_part").isNull() & (F.size(F.split("_q", r"\s+")) <= 3) & ((F.size("part_numbers") > 0) | (F.size("model_numbers") > 0)))
    device, part, number = c("_device.family").isNotNull(), c("_part").isNotNull(), F.size("part_numbers") > 0
    named = F.when(device & part, "compatibility_check").when(device, "phone_to_parts").when(part | number, "part_to_phones").when(c("bare"), "identify").otherwise("unknown")
    guess = F.coalesce(c("_scored"), named)
    guess = F.when(c("bare") & number, "identify").when((guess == "compatibility_check") & part & ~device & ~number, "part_to_phones").otherwise(guess)
    intent_ = F.coalesce(requested_intent(c("mode")), guess) if "mode" in questions.columns else guess
    by_number = F.array_compact(F.transform("part_numbers", lambda n: _first_that(NUMBER_CATEGORIES, n)))
    maker = bind(F.lower("_q"), lambda q: F.get(F.filter(F.array(*[F.lit(m) for m in MAKERS]), lambda m: q.contains(m)), F.lit(0)))
    return read.select(
        *questions.columns, "normalized", intent_.alias("intent"), c("_device.family").alias("device"), F.coalesce("_device.label", "_brand.label").alias("device_brand"), c("_device.family_key").alias("family_key"),
        "model_numbers", "markers", F.when(part, parts.label(c("_part.category"))).alias("part"), F.coalesce("_part.category", F.get(by_number, F.lit(0)), F.lit("other")).alias("part_category"),
        "part_numbers", F.get("part_numbers", F.lit(0)).alias("part_number"), F.coalesce("_device.label", maker).alias("manufacturer"), _first_that(REGIONS, c("_q")).alias("region"), "bare", c("_part.alias").alias("part_alias"),
    )


#: Changes of the rules change the keys under which reports are cached.
RULES_VERSION = "3"


def with_cache_keys(understood: DataFrame, readers: Column, version: str = RULES_VERSION) -> DataFrame:
    """``understood`` with ``cache_key``, which questions share that differ in filler words only and ask for the same with the same readers (an array)."""
    mode = F.col("mode") if "mode" in understood.columns else F.lit(None).cast("string")
    return understood.withColumn("cache_key", research_key(normalize_question(F.col("question")), F.col("intent"), F.lit(version), readers, mode))


def merge_enrichment(understood: DataFrame, proposed: DataFrame) -> DataFrame:
    """``understood`` with what a model proposes (question_id, intent, device, part, part_category, manufacturer, region) where the question leaves it open.

    Model and part numbers are never taken from it, and categories only if they are known. A mode still decides the intent.
    """
    c = F.col
    fields = {"device": 120, "part": 120, "manufacturer": 60, "region": 20}
    known = [name for name, _, _, _ in parts.CATEGORIES]
    intents = ["phone_to_parts", "part_to_phones", "compatibility_check", "identify", "unknown"]
    other = proposed.select("question_id", *[c(n).alias(f"_{n}") for n in ("intent", "part_category", *fields)])
    joined = understood.join(other, "question_id", "left")
    fixed = requested_intent(c("mode")) if "mode" in understood.columns else F.lit(None).cast("string")
    merged = {n: F.coalesce(c(n), F.nullif(F.substring(F.trim(c(f"_{n}")), 1, most), F.lit(""))) for n, most in fields.items()}
    merged["device_brand"] = F.coalesce(c("device_brand"), F.nullif(F.substring(F.trim(c("_manufacturer")), 1, 60), F.lit("")))
    merged["part_category"] = F.when((c("part_category") == "other") & c("_part_category").isin(*known), c("_part_category")).otherwise(c("part_category"))
    merged["intent"] = F.coalesce(fixed, F.when(c("_intent").isin(*intents), c("_intent")), c("intent"))
    merged["method"] = F.when(c("_intent").isNotNull() | c("_device").isNotNull() | c("_part").isNotNull(), "hybrid").otherwise("deterministic")
    return joined.withColumns(merged).drop(*[f"_{n}" for n in ("intent", "part_category", *fields)])


def _words() -> Column:
    """Struct of what many queries of a question say: label, the two angles, device, and device with marks (full)."""
    category, variant = F.col("part_category"), F.array_join(F.transform("markers", variant_label), " ")
    device = F.nullif(F.trim(F.coalesce("device", F.lit(""))), F.lit(""))
    full = F.nullif(F.trim(F.concat_ws(" ", device, variant)), F.lit(""))
    return F.struct(F.lower(parts.label(category)).alias("label"), parts.angle(category, 0).alias("first"), parts.angle(category, 1).alias("second"), device.alias("device"), full.alias("full"))


def _queries() -> Column:
    """Array of structs (query, kind) by facet: the identifier, the reverse lookup, or device and part; reads ``_words``. The words of the queries are fixed values."""
    c, quoted = F.col, lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    label, device, full, lead = c("_words.label"), c("_words.device"), c("_words.full"), F.coalesce("_words.full", "_words.device")
    model, second, number = F.get("model_numbers", F.lit(0)), F.get("model_numbers", F.lit(1)), c("part_number")
    some = lambda *rows: F.array(*[F.struct(collapse_whitespace(q).alias("query"), F.lit(kind).alias("kind")) for q, kind in rows])
    say = lambda *bits: F.concat(*[b if isinstance(b, Column) else F.lit(b) for b in bits])
    mark = quoted(F.coalesce(number, F.trim("question")))
    identify = some(
        (say(mark, " compatible phones"), "part_number"), (say(mark, " replacement ", label), "part_number"), (say(mark, " ", F.coalesce("_words.first", F.lit("compatible models"))), "part_number"), (say(mark, " specifications"), "spec"),
    )
    phrase = F.concat_ws(" ", F.coalesce(F.col("part"), label), number)
    reverse = some(
        (say(phrase, " compatible phones"), "part_to_phone"), (say(phrase, " compatible models list"), "part_to_phone"), (say(quoted(number), " compatible devices"), "part_number"),
        (say(quoted(number), " replacement ", label), "part_number"), (say("which phones use ", phrase), "forum"), (say(phrase, " cross reference"), "part_to_phone"),
    )
    fallback = say(label, " replacement")
    check = some(
        (say(lead, " ", label, " compatibility"), "device_part_compat"), (say(lead, " ", F.coalesce(c("_words.first"), fallback)), "device_part_compat"),
        (say(quoted(model), " ", label, " compatible"), "model_number"), (say(model, " ", F.coalesce(c("_words.second"), fallback)), "model_number"),
        (say(quoted(number), " compatible models"), "part_number"), (say(F.coalesce(device, full), " ", label, " compatible models list"), "device_part_compat"),
        (say(quoted(second), " ", label, " replacement"), "model_number"), (say(lead, " ", label, " forum technician"), "forum"), (say(F.coalesce(device, F.lit("")), " ", label, " part number OEM"), "spec"),
    )
    return F.when((c("intent") == "identify") & device.isNull(), identify).when(c("intent") == "part_to_phones", reverse).otherwise(check)


def search_queries(understood: DataFrame, most: int = MOST_QUERIES, proposed: DataFrame | None = None) -> DataFrame:
    """Rows (question_id, priority, query, kind): at most ``most`` queries a question, without repeats.

    ``proposed`` (question_id, query) may add queries of a model at the end: those of eight characters or more that have all words of
    the device, the part or a number asked for, and no words of instructions.
    """
    c = F.col
    rows = with_once(understood, _words=_words()).withColumn("_queries", F.filter(_queries(), lambda q: F.length(F.coalesce(q["query"], F.lit(""))) >= SHORTEST_QUERY))
    if proposed is not None:
        offered = proposed.groupBy("question_id").agg(F.array_sort(F.collect_set(F.substring(collapse_whitespace(c("query")), 1, 160))).alias("_offered"))
        wanted = F.transform(F.filter(F.concat(F.array("device", "part", "part_number"), "model_numbers"), lambda w: F.coalesce(w, F.lit("")) != ""), normalize_match)
        about = lambda q: F.exists(wanted, lambda w: F.forall(F.split(w, " "), lambda x: normalize_match(q).contains(x)))
        fits = lambda q: (F.length(q) >= 8) & about(q) & ~normalize_match(q).rlike(r"\b(ignore|instruction|prompt|system)\b")
        extra = F.transform(F.filter(F.coalesce("_offered", F.array().cast("array<string>")), fits), lambda q: F.struct(q.alias("query"), F.lit("generic").alias("kind")))
        rows = rows.join(offered, "question_id", "left").withColumn("_queries", F.concat("_queries", extra))
    keyed = rows.withColumn("_queries", F.transform("_queries", lambda q: F.struct(q["query"].alias("query"), q["kind"].alias("kind"), normalize_match(q["query"]).alias("key"))))
    none = F.array().cast("array<struct<query:string,kind:string,key:string>>")
    once = F.aggregate("_queries", none, lambda held, q: F.when(F.exists(held, lambda h: h["key"] == q["key"]), held).otherwise(F.array_append(held, q)))
    return keyed.select("question_id", F.posexplode(F.slice(once, 1, most)).alias("priority", "_q")).select("question_id", "priority", "_q.query", "_q.kind")
