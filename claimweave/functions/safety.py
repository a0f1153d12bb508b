"""Neutralising instruction-like passages of untrusted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_page_text, collapse_whitespace

#: What stands for a passage, for a tag, and for a boundary or reference of a block (fixed values).
MARKER, TAG_MARKER, BOUNDARY_MARKER, REF_MARKER = "[REDACTED-INSTRUCTION-LIKE-TEXT]", "[TAG-REMOVED]", "[BOUNDARY-REMOVED]", "[REF-REMOVED]"
#: (id, severity, pattern) in the order they are applied (fixed values).
INSTRUCTIONS = (
    ("ignore_previous", "high", r"(?i)\b(ignore|disregard|forget)\s+(all\s+|any\s+)?(previous|prior|earlier|above)\s+(instructions?|prompts?|rules?|messages?)"),
    ("new_instructions", "high", r"(?i)\b(new|updated|revised)\s+instructions?\s*[:\-]"),
    ("system_prompt", "medium", r"(?i)\b(system|assistant|developer)\s*(prompt|message|role)\b"),
    ("you_must_say", "high", r"(?i)\byou\s+(must|should|have to|need to|are required to)\s+(say|answer|reply|respond|output|write|confirm)"),
    ("always_say", "high", r"(?i)\balways\s+(say|answer|reply|respond|report|confirm)\b"),
    ("say_compatible", "high", r"(?i)\b(say|state|claim|report|conclude|mark|declare)\s+(that\s+)?(it|this|the part|the product|everything)\s+(is|are)\s+(fully\s+)?compatible"),
    ("do_not_check", "high", r"(?i)\b(do not|don't|never)\s+(verify|check|validate|question|doubt)\b"),
    ("tool_call", "medium", r"(?i)\b(call|invoke|execute|run)\s+(the\s+)?(tool|function|command|code|shell|plugin)\b"),
    ("exfiltrate", "high", r"(?i)\b(reveal|print|output|show|leak|send)\s+(your\s+)?(system\s+)?(prompt|instructions|api\s*key|token|secret|environment)"),
    ("roleplay", "medium", r"(?i)\byou\s+are\s+now\b|\bact\s+as\s+(a|an)\b|\bpretend\s+(to\s+be|you\s+are)\b"),
    ("chat_markers", "high", r"(?i)<\|?(im_start|im_end|system|user|assistant|endoftext)\|?>"),
    ("override_verdict", "high", r"(?i)\b(override|bypass|skip)\s+(the\s+)?(verdict|analysis|safety|check|rules?|verification)"),
)
#: Tags that could end a block of evidence (fixed value).
TAGS = r"(?i)</?\s*(system|instructions?|evidence|document|context|assistant|user)\s*>"
_ANY = "|".join(f"(?:{p})" for _, _, p in INSTRUCTIONS)
_FINDING = "array<struct<id:string,severity:string,sample:string,count:int>>"


def neutralise(text: Column) -> Column:
    """Struct (clean, findings array<struct<id, severity, sample, count>>, risk): patterns are applied one after the other.

    Tags that could end a block go, fences are turned into quotes, and the rest is cleaned like a page. One alternation of
    all patterns tells the texts that need the steps; few do.
    """
    given = F.coalesce(text, F.lit(""))
    patterns = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(p).alias("pattern")) for i, s, p in INSTRUCTIONS])

    def step(held: Column, p: Column) -> Column:
        n = F.regexp_count(held["clean"], p["pattern"])
        sample = F.substring(collapse_whitespace(F.regexp_substr(held["clean"], p["pattern"])), 1, 160)
        finding = F.array(F.struct(p["id"].alias("id"), p["severity"].alias("severity"), sample.alias("sample"), n.alias("count"))).cast(_FINDING)
        found = F.struct(F.regexp_replace(held["clean"], p["pattern"], F.lit(MARKER)).alias("clean"), F.concat(held["findings"], finding).alias("findings"), (held["risk"] + n * F.when(p["severity"] == "high", 2).otherwise(1)).alias("risk"))
        return F.when(n > 0, found).otherwise(held)

    plain = F.struct(given.alias("clean"), F.array().cast(_FINDING).alias("findings"), F.lit(0).alias("risk"))
    scanned = F.when(given.rlike(_ANY), F.aggregate(patterns, plain, step)).otherwise(plain)
    finish = lambda s: F.struct(clean_page_text(F.replace(F.regexp_replace(s["clean"], TAGS, TAG_MARKER), F.lit("```"), F.lit("'''"))).alias("clean"), s["findings"].alias("findings"), s["risk"].alias("risk"))
    # the fold binds the scan to a variable, so that it is worked out once
    return F.aggregate(F.array(scanned), plain, lambda _, s: s, finish)


def risk_of(text: Column) -> Column:
    return neutralise(text)["risk"]


def allowed_content_type(c: Column) -> Column:
    return c.isNull() | F.lower(c).rlike(r"^\s*(?:text/|application/(?:xhtml\+xml|xml|json))")


def evidence_block(ref: Column, text: Column, boundary: str = "EVIDENCE") -> Column:
    """Text between lines that begin and end it; what could pass for such a line or for the reference is taken out."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)={{3,}}\s*(begin|end|stop|start)?\s*{boundary}", BOUNDARY_MARKER)
    safe = F.regexp_replace(safe, F.concat(F.lit(r"(?i)ref=\s*\Q"), ref, F.lit(r"\E\b")), F.lit(REF_MARKER))
    line = lambda word: F.concat(F.lit(f"====={word} {boundary} ref="), ref, F.lit("====="))
    return F.concat_ws("\n", line("BEGIN"), safe, line("END"))
