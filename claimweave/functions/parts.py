"""Categories of parts and the names they go by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_match

#: Categories: (category, label, names, first two search angles) (fixed values).
CATEGORIES = (
    ("screen", "Screen", ("screen", "screens", "display", "lcd", "oled", "amoled", "touch screen", "touchscreen", "digitizer", "lcd assembly", "display assembly", "lcd screen", "screen replacement", "panel", "glass digitizer", "service pack", "screen assembly"), ("screen compatibility", "LCD replacement compatible models")),
    ("battery", "Battery", ("battery", "batteries", "cell", "battery pack", "li-ion battery", "accumulator"), ("battery compatibility", "replacement battery compatible models")),
    ("charging_flex", "Charging flex", ("charging flex", "charge flex", "charging port flex", "charging connector flex", "usb flex", "dock flex", "charging ribbon", "charging port", "charging board flex", "type-c flex"), ("charging flex compatibility", "charging port flex compatible models")),
    ("charging_board", "Charging board", ("charging board", "charge board", "charging pcb", "usb board", "dock board", "daughter board", "sub board", "charging port board"), ("charging board compatibility", "charging board replacement compatible models")),
    ("power_flex", "Power flex", ("power flex", "power button flex", "on/off flex", "power volume flex", "power switch flex", "side button flex"), ("power flex compatibility", "power volume flex compatible models")),
    ("volume_flex", "Volume flex", ("volume flex", "volume button flex", "volume key flex", "volume switch flex"), ("volume flex compatibility", "volume button flex compatible models")),
    ("back_cover", "Back cover", ("back cover", "back glass", "rear cover", "back housing", "rear glass", "back panel", "battery cover"), ("back cover compatibility", "back glass replacement compatible models")),
    ("back_glass", "Back glass", ("back glass", "rear glass", "rear panel glass", "back glass panel"), ("back glass compatibility", "back glass replacement compatible models")),
    ("housing", "Housing", ("housing", "frame", "midframe", "mid frame", "chassis", "back housing", "full housing", "bezel"), ("housing compatibility", "midframe compatible models")),
    ("camera", "Camera", ("camera", "rear camera", "front camera", "camera module", "main camera", "ultrawide", "telephoto", "camera lens", "selfie camera", "camera glass", "lens cover"), ("camera module compatibility", "camera replacement compatible models")),
    ("speaker", "Speaker", ("speaker", "loudspeaker", "buzzer", "ringer", "earpiece", "ear speaker", "loud speaker", "bottom speaker"), ("speaker compatibility", "loudspeaker replacement compatible models")),
    ("microphone", "Microphone", ("microphone", "mic", "mic flex", "microphone flex", "mic module"), ("microphone compatibility", "mic flex compatible models")),
    ("fingerprint", "Fingerprint component", ("fingerprint", "fingerprint sensor", "fingerprint flex", "home button", "biometric sensor", "touch id"), ("fingerprint sensor compatibility", "fingerprint flex compatible models")),
    ("buttons", "Buttons", ("button", "buttons", "power button", "volume button", "home button", "side key"), ("button replacement compatibility", "power button compatible models")),
    ("sensors", "Sensors", ("sensor", "proximity sensor", "light sensor", "ambient sensor", "gyroscope", "accelerometer", "face id", "iris scanner", "hall sensor"), ("sensor compatibility", "proximity sensor compatible models")),
    ("antenna", "Antenna", ("antenna", "antenna flex", "signal flex", "wifi antenna", "cellular antenna", "gps antenna"), ("antenna flex compatibility", "antenna replacement compatible models")),
    ("nfc", "NFC component", ("nfc", "nfc antenna", "nfc flex", "nfc module", "wireless payment coil"), ("nfc antenna compatibility", "nfc flex compatible models")),
    ("wireless_charging", "Wireless charging component", ("wireless charging", "wireless charging coil", "qi coil", "charging coil", "wireless charging flex", "induction coil"), ("wireless charging coil compatibility", "qi coil compatible models")),
    ("other", "Phone part", (), ()),
)
OTHER_LABEL = "Phone part"


def label(category: Column) -> Column:
    """Label of a category; unknown ones and null have the one of ``other``."""
    out = F.lit(OTHER_LABEL)
    for name, text, _, _ in CATEGORIES:
        out = F.when(category == name, text).otherwise(out)
    return out


def angle(category: Column, n: int) -> Column:
    """The n-th search angle of a category; null if it has none."""
    out = F.lit(None).cast("string")
    for name, _, _, angles in CATEGORIES:
        if len(angles) > n:
            out = F.when(category == name, angles[n]).otherwise(out)
    return out


def part_mention(text: Column, norm: Column | None = None) -> Column:
    """Struct (alias, category) of the longest part name that a word of the text (``norm``: its normalised form, where it is a column already) begins with (of equal ones the first category's); else null."""
    padded = F.concat(F.lit(" "), normalize_match(text) if norm is None else norm, F.lit(" "))
    named = sorted(((a, c) for c, _, aliases, _ in CATEGORIES for a in aliases), key=lambda n: -len(n[0]))
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("category"), F.lit(f" {a}").alias("begins")) for a, c in named])
    # the text is normalised before the names are looked for, not once for each of them
    return F.get(F.transform(F.array(padded), lambda t: F.get(F.filter(known, lambda n: t.contains(n["begins"])), F.lit(0))), F.lit(0))


def named(category: Column, by_length: bool = False) -> Column:
    """The names of a category, as they are listed or longest first; empty for unknown ones."""
    out = F.array().cast("array<string>")
    for name, _, names, _ in CATEGORIES:
        if names:
            out = F.when(category == name, F.array(*[F.lit(a) for a in (sorted(names, key=len, reverse=True) if by_length else names)])).otherwise(out)
    return out


def aliases(category: Column) -> Column:
    """The names of a category, longest first; empty for unknown ones."""
    return named(category, by_length=True)


def category_within(norm: Column) -> Column:
    """The category of the longest name of four letters or more that stands anywhere in a normalised text (of equal ones the first); else null."""
    named = sorted(((a, c) for c, _, names, _ in CATEGORIES for a in names if len(a) >= 4), key=lambda n: -len(n[0]))
    out = F.lit(None).cast("string")
    for name, category in reversed(named):
        out = F.when(norm.contains(name), category).otherwise(out)
    return out
