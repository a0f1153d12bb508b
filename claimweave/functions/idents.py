"""Identifiers and device names in text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import bind
from .text import normalize_match

#: Model codes (SKU) as makers write them: (brand, pattern), most specific first (fixed values).
SKUS = (
    ("samsung", r"(?i)\bSM-[A-Z]\d{2,4}[A-Z0-9]{0,7}\b"),
    ("samsung", r"(?i)\bGT-[A-Z]\d{3,4}[A-Z0-9]{0,4}\b"),
    ("apple", r"\bA(?:1[0-9]{3}|2[0-9]{3}|3[0-9]{3})\b"),
    ("xiaomi", r"\b(?:M|2)\d{7,9}[A-Z]{1,4}\b"),
    ("realme", r"(?i)\bRMX\d{4,6}\b"),
    ("oppo", r"(?i)\bCPH\d{3,5}\b"),
    ("vivo", r"\bV(?:19|20|21|22|23|24|25|27|29)\d{2}[A-Z]?\b"),
    ("oneplus", r"\b(?:NE|IN|LE|AC|KB|GM)\d{4}\b"),
    ("motorola", r"(?i)\bXT\d{4,5}(?:-\d{1,2})?\b"),
    ("nokia", r"(?i)\bTA-\d{3,4}\b"),
    ("huawei", r"\b(?:ANE|MAR|VOG|ELE|JNY|CLT|EVA|LON|WAS|FIG|PCT|DUB|PAR|YAL|CET|NOH|ANA|LYA)[A-Z0-9-]{1,8}\b"),
    ("google", r"\b(?:G|GL|GU|GA|GV|GD|GH|GK|GR)\d{3,4}[A-Z]{0,3}\b"),
)
#: Model codes of any brand, and the prefixes they must have (fixed values).
ANY_SKU, ANY_SKU_PREFIX = r"(?i)\b[a-z]{2}-[a-z]\d{3}[a-z0-9]{0,6}\b", r"(?i)^(sm|gt|xt|ta|rmx|cph)-"
#: Shapes of numbers that are printed on parts (fixed values).
PART_NUMBERS = (
    r"(?i)\bGH\d{2}-\d{4,6}[A-Z]\b",
    r"(?i)\bEB-[A-Z]{1,3}\d{2,4}[A-Z0-9]{0,8}\b",
    r"\b(?:BN|BP|BM)\d{1,2}[A-Z0-9]?\b",
    r"(?i)\bB[PS]-[A-Z0-9]{4,12}\b",
    r"(?i)\b821-\d{4,5}-[A-Z0-9]{1,3}\b",
    r"\b\d{3}-\d{4,5}-[A-Z]\b",
    r"\b[A-Z]{3}\d{3,4}[A-Z]?\b",
    r"\b\d{4}-\d{4}-[A-Z0-9]\b",
)
#: Beginnings by which such numbers are device codes instead (fixed value).
DEVICE_PREFIX = r"(?i)^(SM|GT|RMX|CPH|XT|TA|NE|IN|LE|AC|KB|GM)[-\d]"
#: Marks that set variants of a device apart: (key, label, pattern) (fixed values).
VARIANTS = (
    ("5g", "5G", r"(?i)\b5\s?g\b|5g\b"),
    ("4g", "4G", r"(?i)\b4\s?g\b|lte\b"),
    ("3g", "3G", r"(?i)\b3\s?g\b|hspa\b"),
    ("pro", "Pro", r"(?i)\bpro\b"),
    ("pro-max", "Pro Max", r"(?i)\bpro\s?max\b"),
    ("max", "Max", r"(?i)\bmax\b"),
    ("ultra", "Ultra", r"(?i)\bultra\b"),
    ("plus", "Plus", r"(?i)\bplus\b|\+"),
    ("mini", "mini", r"(?i)\bmini\b"),
    ("se", "SE", r"(?i)\bse\b"),
    ("fe", "FE", r"(?i)\bfe\b"),
    ("neo", "Neo", r"(?i)\bneo\b"),
    ("lite", "Lite", r"(?i)\blite\b"),
    ("xr", "XR", r"(?i)\bxr\b"),
    ("xs", "XS", r"(?i)\bxs\b"),
    ("dual-sim", "Dual SIM", r"(?i)\bdual\s?sim\b|\bds\b|\bdual\b"),
    ("single-sim", "Single SIM", r"(?i)\bsingle\s?sim\b|\bss\b"),
    ("global", "Global", r"(?i)\bglobal\b|\binternational\b|\bintl\b"),
    ("us", "US", r"(?i)\bus\s(?:version|model)\b|\busa\b"),
    ("eu", "EU", r"(?i)\beu\s(?:version|model)\b|\beuropean\b"),
    ("cn", "China", r"(?i)\b(china|chinese)\s(?:version|model|variant)\b|\bcn\b"),
    ("india", "India", r"(?i)\bindia\b|\bindian\b|\bins\b"),
    ("korea", "Korea", r"(?i)\bkorea\b|\bkorean\b"),
    ("snapdragon", "Snapdragon", r"(?i)\bsnapdragon\b|\bsd\d{3}\b"),
    ("exynos", "Exynos", r"(?i)\bexynos\b"),
    ("mediatek", "MediaTek", r"(?i)\bmediatek\b|\bdimensity\b|\bhelio\b"),
    ("nfc", "NFC variant", r"(?i)\bnfc\b"),
    ("amoled", "AMOLED", r"(?i)\bamoled\b|\bsuper amoled\b"),
    ("lcd", "LCD", r"(?i)\blcd\b|\bips\b|\btft\b|\bincell\b"),
)
#: Letters of which a text has some (in lower case) wherever a mark's pattern fits; a look for them costs a fraction of the pattern.
VARIANT_LETTERS = {
    "5g": ("5",), "4g": ("4", "lte"), "3g": ("3", "hspa"), "pro-max": ("pro",), "plus": ("plus", "+"), "dual-sim": ("dual", "ds"), "single-sim": ("single", "ss"), "global": ("global", "int"), "cn": ("chin", "cn"), "india": ("ind", "ins"),
    "snapdragon": ("snapdragon", "sd"), "mediatek": ("mediatek", "dimensity", "helio"), "lcd": ("lcd", "ips", "tft", "incell"),
}
GENERATIONS = ("3g", "4g", "5g", "lte")


def normalize_identifier(c: Column) -> Column:
    """Capitals, digits and hyphens only."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9-]", "")


def variant_label(key: Column) -> Column:
    out = F.upper(key)
    for k, label, _ in VARIANTS:
        out = F.when(key == k, label).otherwise(out)
    return out


def _distinct_codes(codes: Column) -> Column:
    """The codes in order; of those that differ by hyphens only the first stays."""
    plain = lambda c: F.translate(c, "-", "")
    step = lambda held, c: F.when(F.exists(held, lambda h: plain(h) == plain(c)), held).otherwise(F.array_append(held, c))
    return F.aggregate(codes, F.array().cast("array<string>"), step)


def _all(text: Column, patterns) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def model_numbers(text: Column, brand: Column | None = None) -> Column:
    """Distinct model codes, by pattern and then by place; with ``brand`` (null: any) only that maker's, and codes of any maker's shape."""
    given = F.coalesce(text, F.lit(""))
    shaped = F.filter(F.transform(_all(given, [p for _, p in SKUS]), normalize_identifier), lambda c: F.length(c) >= 4)
    if brand is not None:
        own = [F.when(brand.isNull() | (brand == b), F.regexp_extract_all(given, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for b, p in SKUS]
        shaped = F.filter(F.transform(F.concat(*own), normalize_identifier), lambda c: F.length(c) >= 4)
    generic = F.filter(F.transform(_all(given, [ANY_SKU]), normalize_identifier), lambda c: c.rlike(ANY_SKU_PREFIX))
    # most texts hold no code at all; one look tells
    return F.when(given.rlike(r"[A-Za-z]-[A-Za-z]\d{2}|[A-Za-z]-?\d{3}|2\d{7}|\b(?:ANE|MAR|VOG|ELE|JNY|CLT|EVA|LON|WAS|FIG|PCT|DUB|PAR|YAL|CET|NOH|ANA|LYA)[A-Z0-9-]"), _distinct_codes(F.concat(shaped, generic))).otherwise(F.array().cast("array<string>"))


def part_numbers(text: Column) -> Column:
    """Distinct part numbers, by pattern and then by place, without device codes."""
    given = F.coalesce(text, F.lit(""))
    found = F.filter(_all(given, PART_NUMBERS), lambda c: ~c.rlike(DEVICE_PREFIX))
    return F.when(given.rlike(r"\d"), _distinct_codes(F.transform(found, normalize_identifier))).otherwise(F.array().cast("array<string>"))


#: Model codes as segments of pages write them, and codes that are none (fixed values).
SEGMENT_MODELS = r"(?i)\b(sm-[a-z]\d{2,4}[a-z0-9]*|gt-[a-z0-9]{4,10}|rmx\d{4,6}|cph\d{3,5}|xt\d{4,5}|ta-\d{3,4}|a\d{4}|m\d{4}[a-z0-9]{2,5}|[a-z]{2}\d{3,4}[a-z]?)\b"
NO_MODEL = r"(?i)^(PS|GB|MB|MS|PDF|VID|IMG|HTTP|WWW)\d*$"
NO_MODEL_NUMBER, MODEL_NUMBER = r"^M\d{6,}$", r"^M2\d"
MOST_MODELS = 8


def segment_models(segment: Column) -> Column:
    """The first eight distinct model codes of a segment: those of :func:`model_numbers`, then looser ones by place."""
    plain = F.regexp_replace(segment, "<[^>]+>", " ")
    looser = F.transform(F.when(segment.rlike(r"\d{3}"), F.regexp_extract_all(plain, F.lit(SEGMENT_MODELS), F.lit(0))).otherwise(F.array().cast("array<string>")), normalize_identifier)
    real = lambda m: (F.length(m) >= 4) & ~m.rlike(NO_MODEL) & ~(m.rlike(NO_MODEL_NUMBER) & ~m.rlike(MODEL_NUMBER))
    return F.slice(_distinct_codes(F.filter(F.concat(model_numbers(segment), looser), real)), 1, MOST_MODELS)


#: Part numbers of which a segment's own is the first shape that it has (fixed values).
OWN_NUMBERS = (r"(?i)\bGH\d{2}-\d{4,6}[A-Z]\b", r"(?i)\bEB-[A-Z0-9-]{4,14}\b", r"\bBN\d{2}[A-Z]?\b", r"(?i)\b821-\d{4,5}-[A-Z0-9]{1,3}\b")
#: What shows that a text has a part number (fixed value).
HAS_NUMBER = r"(?i)gh\d{2}-|eb-|bn\d{2}[a-z]?|821-"


def own_number(segment: Column) -> Column:
    """The part number of a segment; null if it has none."""
    return F.coalesce(*[F.when(segment.rlike(p), normalize_identifier(F.regexp_extract(segment, p, 0))) for p in OWN_NUMBERS])


#: Model codes and names as prose writes them (fixed value).
MODELS_IN_PROSE = r"(?i)\b(sm-[a-z]\d{2,4}[a-z0-9]*|gt-[a-z0-9]{4,10}|rmx\d{4,6}|cph\d{3,5}|xt\d{4,5}|ta-\d{3,4}|a\d{4}|iphone\s?\d{1,2}[a-z ]{0,8})\b"


def model_like(text: Column) -> Column:
    """Different words of a text that look like models, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MODELS_IN_PROSE), F.lit(0)), F.trim))


#: Part numbers as they are looked for around a claim (fixed values).
NEAR_NUMBER = r"(?i:\bGH\d{2}-\d{4,6}[A-Z]\b)|(?i:\bEB-[A-Z0-9-]{4,14}\b)|\b(?:BN|BP|BM)\d{1,2}[A-Z0-9]?\b|(?i:\b821-\d{4,5}-[A-Z0-9]{1,3}\b)"


def placed_numbers(text: Column) -> Column:
    """Array of structs (value, at): part numbers in capitals with the place, from 1, of their first character."""
    found = F.regexp_extract_all(text, F.lit(NEAR_NUMBER), F.lit(0))

    def step(held: Column, v: Column) -> Column:
        at = F.position(v, text, held["next"])
        return F.struct((at + F.length(v)).alias("next"), F.array_append(held["all"], F.struct(F.upper(v).alias("value"), at.alias("at"))).alias("all"))

    none = F.array().cast("array<struct<value:string,at:int>>")
    placed = F.aggregate(found, F.struct(F.lit(1).alias("next"), none.alias("all")), step, lambda held: held["all"])
    return F.when(F.size(found) > 0, placed).otherwise(none)


def number_near(numbers: Column, at: Column, length: Column, reach: int = 360) -> Column:
    """First of ``placed_numbers`` that begins within ``reach`` characters of a passage; null if none or no place."""
    near = F.filter(numbers, lambda n: (n["at"] >= at - reach) & (n["at"] <= at + length + reach))
    return F.when(at > 0, F.get(near, F.lit(0))["value"])


def variant_markers(text: Column) -> Column:
    """Keys of the variant marks of a text; ``pro-max`` stands for ``pro`` and ``max``, and ``max`` leaves out ``plus``."""
    given = F.coalesce(text, F.lit(""))
    looks = lambda low, key: reduce(or_, [low.contains(x) for x in VARIANT_LETTERS.get(key, (key,))])
    marks = bind(F.struct(given.alias("s"), F.lower(given).alias("low")), lambda t: F.array_compact(F.array(*[F.when(looks(t["low"], key) & t["s"].rlike(p), key) for key, _, p in VARIANTS])))
    both = lambda found: F.array_contains(found, "pro-max")
    return bind(marks, lambda found: F.when(both(found), F.array_except(found, F.array(F.lit("pro"), F.lit("max")))).when(F.array_contains(found, "max"), F.array_remove(found, "plus")).otherwise(found))


def same_generation(a: Column, b: Column) -> Column:
    """True unless both name generations and share none."""
    named = F.array(*[F.lit(g) for g in GENERATIONS])
    left, right = F.array_intersect(a, named), F.array_intersect(b, named)
    return (F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(left, right)


def same_family(a: Column, b: Column, strict: bool = False) -> Column:
    """One family name contains the other; with ``strict`` word by word."""
    if strict:
        left, right = F.split(a, " "), F.split(b, " ")
        return (F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0)
    return a.contains(b) | b.contains(a)


def longest_alias(text: Column, aliases: tuple[str, ...]) -> Column:
    """The longest alias that the text contains (of equal ones the first); null if none."""
    ordered = F.array(*[F.lit(a) for a in sorted(aliases, key=len, reverse=True)])
    return F.get(F.filter(ordered, lambda a: text.contains(a)), F.lit(0))
