"""Claims in a segment of text: their kind, attributes and part, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parts
from .text import collapse_whitespace

#: Wordings by which pages state that a part fits: (kind, weight, pattern) (fixed values).
CLAIM_PATTERNS = (
    ("not_compatible", 0.95, r"(?i)\b(not compatible|incompatible|will not fit|won't fit|does not fit|doesn't fit|not interchangeable|cannot be used|can't be used|may damage)\b"),
    ("not_compatible", 0.6, r"(?i)\b(only fits|for the .{0,20} only|exclusively for)\b"),
    ("compatible", 0.95, r"(?i)\bcompatible (with|for)\b|\bcompatibility list\b"),
    ("compatible", 0.8, r"(?i)\b(fits|fit for|fits for|fitting)\b"),
    ("compatible", 0.7, r"(?i)\b(replacement for|replaces|replace part for)\b"),
    ("compatible", 0.65, r"(?i)\b(works? (with|for|on)|will work|working on)\b"),
    ("compatible", 0.6, r"(?i)\b(suitable for|designed for|for use (with|in|on)|used (in|on|with))\b"),
    ("compatible", 0.8, r"(?i)\b(interchangeable|same as original|oem equivalent)\b"),
    ("compatible", 0.6, r"(?i)\b(shared (across|between|with)|same (part|assembly) as|swap(ped)? (between|with)|can be (used|swapped))\b"),
    ("unclear", 0.78, r"(?i)\b(mixed reports?|reports? vary|inconsistent|some (users|people|technicians) say|unclear|uncertain|not sure)\b"),
    ("not_compatible", 0.7, r"(?i)\b(is different|are different|differs? from|not the same (part|assembly)|do not swap|don't swap)\b"),
    ("spec_only", 0.4, r"(?i)\b(\d+(\.\d+)?\s?(v|volt|volts|mah|ah|w|a)\b|capacity|voltage|impedance|resolution|refresh rate)\b"),
)
#: Attributes of parts: (key, pattern whose first group is the value) (fixed values).
ATTRIBUTES = (
    ("voltage", r"(?i)\b(\d\.\d{1,2}\s?(?:v|volt|volts))\b"),
    ("capacity", r"\b(\d{3,5}\s?(?:mah|mAh))\b"),
    ("connector", r"(?i)\b(usb[\s-]?c|type[\s-]?c|micro[\s-]?usb|lightning|30[\s-]?pin|fpc|zif|btb)\b"),
    ("pin_count", r"(?i)\b(\d{1,2})[\s-]?pin\b"),
    ("revision", r"(?i)\b(rev(?:ision)?\.?\s?[a-z0-9]{1,3}|v[1-9]\b|version\s?\d)\b"),
    ("size", r'(?i)\b(\d(?:\.\d{1,2})?\s?(?:inch|"|inches))\b'),
    ("resolution", r"(?i)\b(\d{3,4}\s?[x×]\s?\d{3,4})\b"),
    ("panel", r"(?i)\b(amoled|super amoled|oled|lcd|ips|tft|incell)\b"),
    ("frame", r"(?i)\b(with frame|without frame|no frame|service pack)\b"),
    ("dimensions", r"(?i)\b(\d{1,3}(?:\.\d)?\s?x\s?\d{1,3}(?:\.\d)?\s?x?\s?\d{0,3}(?:\.\d)?\s?mm)\b"),
    ("megapixels", r"(?i)\b(\d{1,3}\s?(?:mp|megapixel)s?)\b"),
)
#: Names of parts in order of precedence: (pattern, canonical name, category) (fixed values).
PART_NAMES = (
    (r"(?i)\blcd\b", "LCD display assembly", "screen"),
    (r"(?i)\boled\b|\bamoled\b", "OLED display assembly", "screen"),
    (r"(?i)\bdisplay\b", "display assembly", "screen"),
    (r"(?i)\bscreen\b|\bdigitizer\b|\btouch ?screen\b", "screen assembly", "screen"),
    (r"(?i)\bbattery\b|\bcell\b", "battery", "battery"),
    (r"(?i)\bcharging (flex|port flex|connector flex|ribbon)\b|\bdock flex\b", "charging flex", "charging_flex"),
    (r"(?i)\bcharging (board|pcb)\b|\busb board\b|\bdaughter ?board\b|\bsub ?board\b", "charging board", "charging_board"),
    (r"(?i)\bpower (flex|button flex|switch)\b", "power flex", "power_flex"),
    (r"(?i)\bvolume (flex|button flex|key flex)\b", "volume flex", "volume_flex"),
    (r"(?i)\bback (cover|glass|panel)\b|\brear (cover|glass|panel)\b", "back cover", "back_cover"),
    (r"(?i)\b(mid ?frame|chassis|housing|frame)\b", "housing / frame", "housing"),
    (r"(?i)\bcamera\b", "camera module", "camera"),
    (r"(?i)\b(loud ?speaker|speaker|buzzer|ringer)\b", "speaker", "speaker"),
    (r"(?i)\bearpiece\b", "earpiece speaker", "speaker"),
    (r"(?i)\bmicrophone\b|\bmic\b", "microphone", "microphone"),
    (r"(?i)\bfingerprint\b|\btouch id\b|\bbiometric\b", "fingerprint sensor", "fingerprint"),
    (r"(?i)\bantenna\b", "antenna", "antenna"),
    (r"(?i)\bnfc\b", "NFC component", "nfc"),
    (r"(?i)\bwireless charging\b|\bqi coil\b|\bcharging coil\b", "wireless charging coil", "wireless_charging"),
)
#: Names that show that a text is about a device (fixed values).
BRAND_MENTION = (
    r"(?i)\b(samsung|galaxy|iphone|apple|redmi|xiaomi|poco|huawei|honor|oppo|vivo|oneplus|realme|motorola|moto|nokia|sony|pixel|tecno|infinix|itel|tcl|asus|lenovo|nothing phone)\b"
)


def claim_match(segment: Column) -> Column:
    """Struct (kind, weight) of the wording of largest weight that the segment has (of equal ones the first); else null."""
    out = None
    for kind, weight, pattern in sorted(CLAIM_PATTERNS, key=lambda c: -c[1]):
        found = F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
        out = F.when(segment.rlike(pattern), found) if out is None else out.when(segment.rlike(pattern), found)
    return out


def attributes(segment: Column) -> Column:
    """Map of the attributes that the segment states."""
    value = lambda p: F.substring(collapse_whitespace(F.regexp_extract(segment, p, 1)), 1, 60)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), value(p).alias("value")) for k, p in ATTRIBUTES])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))


def canonical_part(term: Column) -> Column:
    """Struct (canonical, category) of the first part name that fits; else the trimmed term without a category."""
    out = None
    for pattern, name, category in PART_NAMES:
        named = F.struct(F.lit(name).alias("canonical"), F.lit(category).alias("category"))
        out = F.when(term.rlike(pattern), named) if out is None else out.when(term.rlike(pattern), named)
    named = parts.part_mention(term)
    own = F.struct(F.lower(parts.label(named["category"])).alias("canonical"), named["category"].alias("category"))
    return out.when(named.isNotNull(), own).otherwise(F.struct(F.trim(term).alias("canonical"), F.lit(None).cast("string").alias("category")))


def claim_kind(value: Column) -> Column:
    """The kind that a model's wording means."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v.contains("not") | (v == "incompatible"), "not_compatible").when(v.isin("compatible", "fits"), "compatible").when(v.isin("spec_only", "specification"), "spec_only").otherwise("unclear")


def any_in(text: Column, terms: Column) -> Column:
    """Does the text contain one of the terms? Null and empty terms do not count."""
    return F.coalesce(F.exists(terms, lambda t: (t != "") & text.contains(t)), F.lit(False))
