"""Brands, device names and the keys by which devices are compared, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import bind
from .text import collapse_whitespace, normalize_match

#: Brands with the names they go by, in order of precedence (fixed values).
BRANDS = (
    ("samsung", "Samsung", ("samsung", "galaxy", "sm-", "samsung galaxy")),
    ("apple", "Apple", ("apple", "iphone", "ipad", "ipod", "macbook")),
    ("google", "Google", ("google", "pixel", "pixel fold")),
    ("xiaomi", "Xiaomi", ("xiaomi", "mi ", "miui", "redmi", "poco")),
    ("huawei", "Huawei", ("huawei", "honor")),
    ("oppo", "OPPO", ("oppo", "cph")),
    ("vivo", "Vivo", ("vivo", "iqoo")),
    ("oneplus", "OnePlus", ("oneplus", "one plus")),
    ("realme", "Realme", ("realme", "rmx")),
    ("motorola", "Motorola", ("motorola", "moto", "xt")),
    ("nokia", "Nokia", ("nokia", "ta-")),
    ("sony", "Sony", ("sony", "xperia")),
    ("lg", "LG", ("lg ", "lg-", "lg electronics")),
    ("nothing", "Nothing", ("nothing phone", "cmf by nothing")),
    ("asus", "Asus", ("asus", "zenfone", "rog phone")),
    ("lenovo", "Lenovo", ("lenovo", "motorola lenovo")),
    ("zte", "ZTE", ("zte", "axon", "blade")),
    ("tecno", "Tecno", ("tecno", "camon", "spark")),
    ("infinix", "Infinix", ("infinix", "hot ", "note ")),
    ("itel", "Itel", ("itel",)),
    ("meizu", "Meizu", ("meizu",)),
    ("tcl", "TCL", ("tcl", "alcatel")),
    ("fairphone", "Fairphone", ("fairphone",)),
    ("blackview", "Blackview", ("blackview", "doogee", "oukitel", "umidigi", "cubot")),
    ("sharp", "Sharp", ("sharp", "aquos")),
)
#: Shapes of model numbers that tell the brand (fixed values).
MODEL_BRANDS = (("samsung", "^SM-|^GT-"), ("realme", "^RMX"), ("oppo", "^CPH"), ("motorola", r"^XT\d"), ("nokia", "^TA-"), ("xiaomi", r"^M\d{4}[A-Z]|^\d{8,9}[A-Z]{2,4}$"), ("apple", r"^A[123]\d{3}$"))
#: Words that end a device's name in a question (fixed values).
NAME_ENDS = (
    "can", "could", "will", "would", "does", "do", "is", "are", "the", "a", "an", "my", "this", "that", "these", "those", "screen", "screens",
    "display", "battery", "flex", "cable", "camera", "speaker", "microphone", "housing", "cover", "glass", "button", "buttons", "sensor", "antenna",
    "nfc", "charging", "charge", "port", "board", "lcd", "oled", "replacement", "compatible", "compatibility", "work", "works", "working", "fit",
    "fits", "use", "used", "using", "phone", "phones", "model", "models", "number", "part", "parts", "for", "with", "on", "in", "from", "and", "or",
    "what", "which", "where", "how", "why", "when", "find", "need", "looking", "another", "other", "other's", "same", "new", "old", "original", "oem",
    "aftermarket", "bought", "buy", "sell", "please", "help", "tell", "me", "about", "version", "variant", "edition", "series", "gen", "4g", "5g",
    "3g", "lte", "ds", "duos",
)
#: Words that end a device's name on a page (fixed values).
PHRASE_ENDS = (
    "models", "model", "modelnumbers", "fits", "fit", "fitsfor", "compatible", "compatibility", "replacement", "for", "and", "or", "the", "with",
    "is", "are", "also", "only", "works", "work", "used", "use", "screen", "display", "battery", "flex", "cable", "camera", "speaker", "housing",
    "cover", "glass", "button", "sensor", "antenna", "charging", "port", "board", "lcd", "oled", "assembly", "part", "parts", "series", "edition",
)
#: Words before a bare number that make it a device's name (fixed values).
PREFIXES = (
    "galaxy", "note", "redmi", "poco", "pixel", "xperia", "zenfone", "mate", "nova", "mi", "oneplus", "iphone", "ipad", "moto", "realme", "camon",
    "spark", "hot", "blade", "axon", "aquos", "rog", "find", "reno", "f",
)
GENERATIONS = ("3g", "4g", "5g", "lte")
#: Marks of regions and configurations, which do not change the device (fixed values).
REGIONS = (
    "us", "eu", "cn", "india", "korea", "global", "international", "dual-sim", "single-sim", "ds", "duos", "snapdragon", "exynos", "mediatek", "nfc",
    "japan", "brazil", "latam", "middle-east", "africa",
)
_MAKERS = "samsung|apple|iphone|galaxy|redmi|xiaomi|poco|huawei|honor|oppo|vivo|oneplus|realme|motorola|moto|nokia|sony|google|pixel|tecno|infinix|itel|tcl|asus|lenovo|nothing"
LONGEST_NAME = 5


def _names() -> list[tuple[str, str, str]]:
    """(name, brand, label): longer names first (a space at the end counts), of equal ones the first brand's."""
    named = [(a, b, label) for b, label, aliases in BRANDS for a in aliases]
    return [(a.strip(), b, label) for a, b, label in sorted(named, key=lambda n: -len(n[0]))]


def brand_of(text: Column, norm: Column | None = None) -> Column:
    """Struct (brand, label) of the longest brand name that a word of the text (``norm``: its normalised form, where it is a column already) begins with; else null."""
    padded = F.concat(F.lit(" "), normalize_match(text) if norm is None else norm)
    known = F.array(*[F.struct(F.lit(f" {a}").alias("name"), F.lit(b).alias("brand"), F.lit(label).alias("label")) for a, b, label in _names()])
    hit = bind(padded, lambda t: F.get(F.filter(known, lambda n: t.contains(n["name"])), F.lit(0)))
    return bind(hit, lambda h: F.when(h.isNotNull(), F.struct(h["brand"].alias("brand"), h["label"].alias("label"))))


def brand_of_models(models: Column) -> Column:
    """Brand of the first model number whose shape tells one."""
    def one(model: Column) -> Column:
        out = None
        for brand, shape in MODEL_BRANDS:
            out = F.when(F.upper(model).rlike(shape), brand) if out is None else out.when(F.upper(model).rlike(shape), brand)
        return out

    return F.get(F.filter(F.transform(models, one), lambda b: b.isNotNull()), F.lit(0))


def _until(tokens: Column, ends: tuple[str, ...], bare: str = "") -> Column:
    """The first five tokens at most, up to a word (not the first) that ends a name."""
    word = lambda t: F.regexp_replace(F.lower(t), bare, "") if bare else t
    end = F.array_position(F.transform(tokens, lambda t, k: (k > 0) & word(t).isin(*ends)), F.lit(True))
    return bind(end, lambda e: F.slice(tokens, F.lit(1), F.when(e > 0, F.least(e - 1, F.lit(LONGEST_NAME))).otherwise(F.lit(LONGEST_NAME)).cast("int")))


def device_phrase(segment: Column) -> Column:
    """The device that a segment of a page names, as written: a maker's name and what follows it; null if none."""
    found = collapse_whitespace(F.regexp_extract(segment, r"(?i)\b((?:" + _MAKERS + r")[a-z0-9+.\- ]{0,32})", 1))
    name = lambda words: F.nullif(F.substring(F.regexp_replace(F.array_join(_until(words, PHRASE_ENDS, "[^a-z0-9+]"), " "), "[,.;:]+$", ""), 1, 60), F.lit(""))
    return bind(F.split(found, " "), name)


def family_key(name: Column, brand: Column) -> Column:
    """Normalised name without words that all devices of a maker have, led by the brand."""
    key = F.trim(F.regexp_replace(F.regexp_replace(normalize_match(name), r"\b(galaxy|phone|smartphone|mobile)\b", " "), " +", " "))
    maker = F.coalesce(brand, brand_of(name)["brand"])
    led = lambda b: F.when(b["maker"].isNotNull() & (b["key"] != "") & ~b["key"].startswith(b["maker"]), F.concat_ws(" ", b["maker"], b["key"])).otherwise(b["key"])
    return bind(F.struct(key.alias("key"), maker.alias("maker")), led)


def base_key(key: Column) -> Column:
    """A family key without generations and regions."""
    return F.array_join(F.filter(F.split(key, " "), lambda t: (t != "") & ~t.isin(*GENERATIONS, *REGIONS)), " ")


def variant_key(key: Column, markers: Column) -> Column:
    """Base key and sorted generations, as ``samsung a15|4g``."""
    return F.concat(base_key(key), F.lit("|"), F.array_join(F.array_sort(F.filter(markers, lambda m: m.isin(*GENERATIONS))), ","))


def core_tokens(device: Column) -> Column:
    """Words of a device's name that carry its number."""
    return F.filter(F.split(normalize_match(F.coalesce(device, F.lit(""))), " "), lambda t: (F.length(t) >= 2) & t.rlike(r"\d"))


def _title(name: Column, label: Column) -> Column:
    sized = F.regexp_replace(F.regexp_replace(name, r"\b(\d+) ?gb\b", "$1GB"), r"\b(\d+) ?g\b", "$1G")
    title = F.array_join(F.transform(F.split(sized, " "), lambda t: F.when(t.rlike("^[a-z]{1,2}$"), F.upper(t)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 100)))), " ")
    return F.when(label.isNull() | F.contains(F.lower(title), F.lower(label)), title).otherwise(F.concat_ws(" ", label, title))


def device_mention(text: Column, models: Column, norm: Column | None = None, brand: Column | None = None) -> Column:
    """Struct (brand, label, raw, family, family_key) of the device a question names; null if it names none.

    ``norm`` and ``brand`` are the normalised text and its brand, where these are columns already.

    The name starts at the longest name of the brand, or, without one, at the first word that looks like a model
    (a bare number only after a product line's name); without a name the first model number stands for it.
    """
    norm = normalize_match(text) if norm is None else norm
    brand = brand_of(text) if brand is None else brand
    words, padded = F.split(norm, " "), F.concat(F.lit(" "), norm, F.lit(" "))
    names = F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(a).alias("name")) for b, _, aliases in BRANDS for a in dict.fromkeys((b, *(x.strip() for x in aliases)))])
    own = F.filter(names, lambda n: (n["brand"] == brand["brand"]) & padded.contains(F.concat(F.lit(" "), n["name"], F.lit(" "))))
    word_at = lambda n: F.length(F.regexp_replace(F.substring(padded, F.lit(1), F.position(F.concat(F.lit(" "), n, F.lit(" ")), padded).cast("int")), "[^ ]", ""))
    start = F.array_min(F.transform(own, lambda n: F.struct((-F.length(n["name"])).alias("n"), word_at(n["name"]).alias("at"))))["at"]
    after = lambda k: (k > 0) & F.get(words, k - 1).isin(*PREFIXES)
    number = r"^(?:bn|eb|gh|bp|bs)-?\d|^\d{3}-\d{4}"
    like = F.transform(words, lambda t, k: ~t.rlike(number) & (t.rlike(r"^[a-z]{1,3}\d{1,4}[a-z]{0,2}$") | (t.rlike(r"^\d{1,2}$") & after(k))))
    modelled = F.array_position(like, F.lit(True)).cast("int")
    led = lambda m: F.when(m > 1, F.when(F.get(words, m - 2).isin(*PREFIXES), m - 1).otherwise(m)).when(m == 1, F.lit(1))
    first = F.get(models, F.lit(0))

    def made(name: Column) -> Column:
        found = F.when(name != "", name)
        return F.when(
            found.isNotNull() | first.isNotNull() | brand.isNotNull(),
            F.struct(
                brand["brand"].alias("brand"), brand["label"].alias("label"), F.coalesce(found, first, F.lit("")).alias("raw"),
                F.when(found.isNotNull(), _title(found, brand["label"])).otherwise(first).alias("family"), family_key(F.coalesce(found, first), brand["brand"]).alias("family_key"),
            ),
        )

    named = lambda at: F.when(at.isNotNull(), F.array_join(_until(F.slice(words, at, F.size(words)), NAME_ENDS), " "))
    return bind(bind(F.coalesce(start, bind(modelled, led)), named), made)
