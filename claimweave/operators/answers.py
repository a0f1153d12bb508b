"""Answers, warnings and reports on judged questions, as columns and JSON; one row for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Headlines by verdict (fixed values).
HEADLINES = {
    "compatible": "Compatible — evidence supports this part",
    "likely_compatible": "Likely compatible",
    "uncertain": "Compatibility uncertain",
    "not_compatible": "Not compatible",
    "insufficient_evidence": "Not enough evidence",
    "research_failed": "Research could not be completed",
    "not_configured": "Web research is not configured",
}
#: What to look at before a part of a category is fitted.
ADVICE = {
    "screen": ("Compare the connector and its pins with the old panel.", "See whether the frame is included.", "OLED and LCD panels must not be mixed."),
    "battery": ("Compare voltage, capacity and connector with the old battery.", "Measure the cell: a thicker one can be damaged by the cover."),
    "charging_flex": ("Compare the board revision and the microphone's place.", "See whether connector and routing suit the frame."),
    "charging_board": ("Compare revision and mounting points.", "Count the connectors and compare their places."),
    "power_flex": ("See whether it has the volume keys as well.", "Compare the distance between the keys with the frame."),
    "volume_flex": ("Count the keys and compare their distance.", "See which way the connector points."),
    "back_cover": ("Compare the camera cutout and the openings for buttons.", "See whether the variant is the right one."),
    "back_glass": ("Compare the camera cutout and the adhesive.", "See whether variant and finish are right."),
    "housing": ("Compare the cutouts and the places of the buttons.", "See which small parts are included."),
    "camera": ("Compare the height of the module and its connector.", "It may have to be calibrated after the exchange."),
    "speaker": ("Compare impedance and contacts.", "See whether the chamber seals."),
    "microphone": ("Compare the place and the contacts.", "Compare the connector."),
    "fingerprint": ("It may have to be paired with the board.", "Compare the connector and the mounting."),
    "buttons": ("Compare material and travel with the old ones.", "See whether the gasket is included."),
    "sensors": ("They may have to be calibrated or paired.", "Compare the connector and the mounting."),
    "antenna": ("Compare contacts and routing.", "See where the connector is."),
    "nfc": ("Compare the coil's place and the connector.", "See whether the variant has it at all."),
    "wireless_charging": ("Compare the coil's place and the connector.", "See whether the variant charges without a cable."),
    "other": ("Compare connector and mounting with the old part.",),
}
LAST_ADVICE = "Read the exact model number that is printed on the device."
MOST_BULLETS, MOST_ADVICE, MOST_RISKS = 6, 5, 3
#: HTTP status by error code; others are 500 (fixed values).
STATUS = {"invalid_input": 422, "unauthorized": 401, "forbidden": 403, "not_found": 404, "rate_limited": 429, "provider_not_configured": 503, "timeout": 504}


def _table(values: dict, key: Column, other: Column) -> Column:
    out = None
    for name, value in values.items():
        v = F.array(*[F.lit(x) for x in value]) if isinstance(value, tuple) else F.lit(value)
        out = F.when(key == name, v) if out is None else out.when(key == name, v)
    return out.otherwise(other)


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def _said(parts: list[Column]) -> Column:
    return F.array_compact(F.array(*parts))


def confidence_summary(level: Column, d_support: Column, n_models: Column) -> Column:
    """One sentence on why the evidence has its level."""
    by = F.when(d_support == 0, "no supporting sources").otherwise(_counted(d_support, "independent source", "independent sources"))
    return (
        F.when(level == "CONFIRMED", F.concat(_counted(n_models, "device", "devices"), F.lit(" confirmed by "), by, F.lit(" that agree in detail.")))
        .when(level == "HIGH_CONFIDENCE", F.concat(F.lit("Direct evidence that agrees, from "), by, F.lit(".")))
        .when(level == "LIKELY", F.concat(F.lit("Evidence from "), by, F.lit(", none of it unambiguous.")))
        .when(level == "POSSIBLE", F.concat(F.lit("Some evidence ("), by, F.lit("), too little to rely on.")))
        .when(level == "NOT_COMPATIBLE", "Sources say that this part does not fit the device.")
        .otherwise("There is not enough reliable evidence.")
    )


def warnings(sibling_variants: Column, n_conflicts: Column, risks: Column, n_snippet_only: Column, n_injected: Column) -> Column:
    """What a reader should know besides the verdict, in this order; empty if nothing."""
    first = _said([
        F.when(F.size(sibling_variants) > 0, F.concat(F.lit("Some evidence is on sibling variants ("), F.array_join(sibling_variants, ", "), F.lit("), whose parts often differ."))),
        F.when(n_conflicts > 0, F.concat(_counted(n_conflicts, "group", "groups"), F.lit(" of conflicting evidence."))),
    ])
    last = _said([
        F.when(n_snippet_only > 0, F.concat(_counted(n_snippet_only, "supporting claim comes", "supporting claims come"), F.lit(" from search snippets only."))),
        F.when(n_injected > 0, F.concat(_counted(n_injected, "source", "sources"), F.lit(" had instruction-like text, which was neutralised."))),
    ])
    return F.concat(first, F.slice(risks, 1, MOST_RISKS), last)


def with_answers(judged: DataFrame) -> DataFrame:
    """``judged`` with headline, summary, answer, bullets and verify.

    Read are question_id, verdict, score, level, d_support, n_sources, n_conflicts, device, part, category, and the
    arrays model_numbers, part_numbers, risks, checks (structs of label, status). Null texts and arrays count as
    absent; a null count is none.
    """
    c = F.col
    some = lambda n, kind="array<string>": F.coalesce(c(n), F.array().cast(kind))
    n = lambda name: F.coalesce(c(name), F.lit(0))
    device, part = F.coalesce("device", F.get(some("model_numbers"), F.lit(0)), F.lit("this device")), F.coalesce("part", "category", F.lit("part"))
    checks = some("checks", "array<struct<label:string,status:string>>")
    labels = lambda states, k: F.slice(F.transform(F.filter(checks, lambda x: x["status"].isin(*states)), lambda x: x["label"]), 1, k)
    summary = confidence_summary(c("level"), n("d_support"), F.size(some("model_numbers")))
    found = F.concat(_counted(n("n_sources"), "source", "sources"), F.lit(" ("), _counted(n("d_support"), "independent publisher", "independent publishers"), F.lit(" in support)"))
    pair = F.concat(F.lit("this "), F.lower(part), F.lit(" and the "), device)
    sure = F.concat(F.lit(" The confidence is "), n("score").cast("string"), F.lit("%. "))
    answer = (
        F.when(c("verdict") == "compatible", F.concat(found, F.lit(" agree that it fits: "), pair, F.lit("."), sure, summary))
        .when(c("verdict") == "likely_compatible", F.concat(found, F.lit(" speak for a fit, not all of them or not fully: "), pair, F.lit("."), sure, summary))
        .when(c("verdict") == "uncertain", F.concat(found, F.lit(" are mixed or incomplete on "), pair, F.lit("."), sure, summary))
        .when(c("verdict") == "not_compatible", F.concat(found, F.lit(" were read, and it does not fit: "), pair, F.lit("."), sure, summary))
        .when(c("verdict") == "insufficient_evidence", F.concat(found, F.lit(" make no clear statement on "), pair, F.lit(". "), summary))
        .when(c("verdict") == "not_configured", "No search is configured, so nothing was looked for.")
        .otherwise(F.concat(F.lit("The run did not end, so there is no conclusion. "), summary))
    )
    listed = lambda lead, name, k: F.when(F.size(some(name)) > 0, F.concat(F.lit(lead), F.array_join(F.slice(F.array_distinct(some(name)), 1, k), ", "), F.lit(".")))
    supported = n("d_support") > 0
    bullets = F.concat(
        _said([
            F.when(c("verdict") == "insufficient_evidence", F.concat(_counted(n("n_sources"), "source was", "sources were"), F.lit(" read without a statement on this."))).when(supported, F.concat(_counted(n("d_support"), "independent source describes", "independent sources describe"), F.lit(" a fit."))),
            F.when((c("verdict") != "insufficient_evidence") & supported, listed("Part numbers in evidence: ", "part_numbers", 4)),
            F.when((c("verdict") != "insufficient_evidence") & supported, listed("Model numbers in evidence: ", "model_numbers", 6)),
        ]),
        F.transform(labels(("supported",), 2), lambda x: F.concat(x, F.lit(": supported."))),
        _said([
            F.when(n("n_conflicts") > 0, F.concat(_counted(n("n_conflicts"), "group", "groups"), F.lit(" of sources disagree."))), F.get(some("risks"), F.lit(0)),
            F.when(c("verdict") == "not_compatible", F.lit("Evidence says that it does not fit: do not install it without further checks.")),
        ]),
    )
    verify = F.concat(F.transform(labels(("unknown", "conflicting"), 3), lambda x: F.concat(F.lit("Confirm "), F.lower(x), F.lit("."))), F.slice(some("risks"), 1, 1), _table(ADVICE, c("category"), F.array(*[F.lit(x) for x in ADVICE["other"]])), F.array(F.lit(LAST_ADVICE)))
    return judged.select("*", _table(HEADLINES, c("verdict"), F.lit(HEADLINES["research_failed"])).alias("headline"), summary.alias("summary"), answer.alias("answer"), F.slice(bullets, 1, MOST_BULLETS).alias("bullets"), F.slice(F.array_distinct(verify), 1, MOST_ADVICE).alias("verify"))


def ok_envelope(data: Column) -> Column:
    """JSON ``{"ok":true,"data":…}``; nulls inside stay."""
    return F.to_json(F.struct(F.lit(True).alias("ok"), data.alias("data")), {"ignoreNullFields": "false"})


def error_envelope(code: Column, message: Column) -> Column:
    """Struct (status, body) with the HTTP status of an error and JSON ``{"ok":false,"error":…}``."""
    body = F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(code.alias("code"), message.alias("message")).alias("error")))
    return F.struct(_table(STATUS, code, F.lit(500)).alias("status"), body.alias("body"))


def merge_reports(stored: tuple[DataFrame, DataFrame, DataFrame], run: tuple[DataFrame, DataFrame, DataFrame], max_sources: int = 25, max_claims: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (sessions, sources, claims) with those of a run merged in.

    Sessions are keyed by cache_key: verdict, score, level, report, user_id, duration and cost are renewed, expires_at only set with
    a new one. Sources are keyed by cache_key and url (the first ``max_sources`` by ordinal); only their quality is
    renewed. Claims (the first ``max_claims``) are added only to sessions that have none. Rows with a null key
    match no stored row.
    """
    sessions, sources, claims = stored
    new_sessions, new_sources, new_claims = run
    first = lambda df, most: store.nth_of(df, ["cache_key"], F.asc("ordinal")).where(F.col("nth") <= most).drop("nth")
    renewed = [name for name in ("verdict", "score", "level", "report", "user_id", "duration_ms", "cost_usd") if name in sessions.columns]
    return (
        store.upsert(sessions, new_sessions, ["cache_key"], renewed),
        store.upsert(sources, first(new_sources, max_sources), ["cache_key", "url"], ["quality"]),
        claims.unionByName(first(new_claims, max_claims).join(claims.select("cache_key").distinct(), "cache_key", "left_anti")),
    )


#: What to do about runs that could not be made, by the code of their failure.
REMEDIES = {
    "provider_not_configured": ("Set SEARCH_PROVIDER to a reader.", "Set the key that the reader needs.", "Start again with the new settings."),
    "no_results": ("Name the device and the part.", "Give the number that is printed on the part."),
    "no_evidence": ("Ask for the exact model number.", "Look for the number of the part.", "Compare the old part by hand."),
    "timeout": ("Try again later.", "Ask for less at once."),
}


def empty_reports(runs: DataFrame) -> DataFrame:
    """Reports on runs without a conclusion: question_id, n_sources and ``failure``, a code of REMEDIES or another error's.

    Without a reader the verdict is not_configured, where nothing speaks for or against a fit insufficient_evidence, else research_failed. Score 0, level UNKNOWN; no claims,
    findings or checks.
    """
    c = F.col
    verdict = F.when(c("failure") == "provider_not_configured", "not_configured").when(c("failure").isin("no_results", "no_evidence"), "insufficient_evidence").otherwise("research_failed")
    read = F.coalesce("n_sources", F.lit(0))
    answer = (
        F.when(verdict == "not_configured", "No search is configured, so nothing was looked for.")
        .when(read > 0, F.concat(_counted(read, "page was", "pages were"), F.lit(" read, and none says which devices the part fits.")))
        .otherwise("No page could be read, so there is no conclusion.")
    )
    none = F.array().cast("array<string>")
    advice = F.coalesce(_table(REMEDIES, c("failure"), none), none)
    return runs.select(*runs.columns, verdict.alias("verdict"), F.lit(0).alias("score"), F.lit("UNKNOWN").alias("level"), _table(HEADLINES, verdict, F.lit(HEADLINES["research_failed"])).alias("headline"), answer.alias("answer"), F.slice(advice, 1, 3).alias("bullets"), advice.alias("verify"))
