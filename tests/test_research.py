"""Whole runs on written scenarios, and the records and totals around them."""

import pytest
from pyspark.sql import functions as F

from claimweave import catalogue
from claimweave.operators import reporting, research, usage

RESULT = "question_id int, ordinal int, url string, title string, snippet string, published_at date, raw_content string, fetched boolean"


@pytest.fixture(scope="module")
def run(spark):
    asked = spark.createDataFrame([(k, k) for k in range(8)], "question_id int, scenario int")
    questions, results, checklist = catalogue.flow_tables(asked)
    reverse = spark.createDataFrame([(20, "which phones use the EB-BA155ABY battery?"), (21, "which phones use the EB-BA155ABY battery?")], questions.schema)
    more = spark.createDataFrame([(20, n, f"https://shop{n}.example.com/x", f"t{n}", "s", None, catalogue._FLOW_TEXTS["yes"], False) for n in (0, 1)], RESULT)
    snippet = spark.createDataFrame([(8, 0, "https://parts.example.com/b", "t", catalogue._FLOW_TEXTS["yes"], None, None, False)], RESULT)
    eighth = spark.createDataFrame([(8, catalogue._FLOW_QUESTION)], questions.schema)
    tables = research.research(questions.unionByName(reverse).unionByName(eighth), results.unionByName(more).unionByName(snippet), checklist, F.lit("2025-01-01").cast("date"))
    tables["events"] = reporting.stage_events(tables["understood"], tables["sources"], tables["claims"], tables["reports"])
    tables["notes"] = reporting.source_notes(tables["sources"])
    tables["evidence"] = reporting.evidence_list(tables["claims"], 3)
    return {name: df.collect() for name, df in tables.items()}


def test_stages_notes_and_references(run):
    events = {(e.question_id, e.stage): e.detail for e in run["events"]}
    assert len(events) == len(run["events"]) == 5 * len(run["understood"]) and all(events.values())
    assert events[0, "reading"] == "0 sources, 0 of them fetched" and events[1, "claims"] == "4 claims of 4 sites" and events[3, "verdict"].startswith("not_compatible")
    notes = {(s.question_id, s.domain): s.notes for s in run["notes"]}
    assert notes[1, "samsung.com"][0].startswith("Tier 1") and "Only the snippet was read." in notes[8, "parts.example.com"] and any("neutralised" in n for n in notes[7, "samsung.com"])
    shown = [e for e in run["evidence"] if e.question_id == 1]
    assert sorted(e.nth for e in shown) == [1, 2, 3] and {e.ref for e in shown} == {1, 2, 3} and all(e.source_url and e.evidence for e in shown)


def test_verdicts_of_scenarios(run):
    found = {r.question_id: r for r in run["reports"]}
    assert [found[k].verdict for k in range(9)] == ["insufficient_evidence", "compatible", "uncertain", "not_compatible", "uncertain", "likely_compatible", "insufficient_evidence", "compatible", "likely_compatible"]
    assert found[1].level in ("HIGH_CONFIDENCE", "CONFIRMED") and found[1].score >= 72 and found[1].n_sources == 4
    assert found[2].n_conflicts == 1 and found[2].score <= 58 and found[0].score <= 18 and found[0].n_sources == 0
    assert found[20].verdict == "compatible" and found[21].verdict == "insufficient_evidence"
    assert found[8].n_snippet_only == 1 and found[1].n_snippet_only == 0
    assert found[1].headline.startswith("Compatible") and found[1].bullets and found[1].verify


def test_injected_text_never_reaches_a_report(run):
    attacked = [s for s in run["sources"] if s.question_id == 7 and s.n_findings]
    assert len(attacked) == 1 and "gnore all previous" not in attacked[0].text
    assert all("gnore all" not in c.evidence_text for c in run["claims"]) and next(r for r in run["reports"] if r.question_id == 7).n_injected == 1


def test_findings_name_devices_and_parts(run):
    models = [m for m in run["models"] if m.question_id == 1]
    assert models[0].independent_sources == 4 and "SM-A155F" in models[0].model_numbers and models[0].nth == 1
    assert all("SM-A156B" not in m.model_numbers for m in run["models"] if m.question_id in (1, 2, 5, 7))
    parts = [p for p in run["parts"] if p.question_id == 1]
    assert parts[0].part_number == "EB-BA155ABY" and parts[0].attributes["voltage"].startswith("3.85")
    assert {m.question_id for m in run["against"]} == {2, 3}
    status = {c.check_id: c.status for c in run["checks"] if c.question_id == 1}
    assert status == {"voltage": "supported", "capacity": "supported", "device_model": "supported"}
    assert all(c.source_domain for c in run["claims"]) and len({(c.question_id, c.claim_id) for c in run["claims"]}) == len(run["claims"])


def test_sources_are_deduplicated(spark):
    rows = [(1, 0, "https://a.com/x?utm_source=y", "Title one", "s", None, "short text", False), (1, 1, "http://www.a.com/x", "Title one", "s", None, "a longer text it is", False), (1, 2, "https://a.com/z", "TITLE  one!", "s", None, "third", False), (1, 3, "https://a.com/w", "Title one", "s", None, "word " * 90, False), (1, 4, "https://b.com/", "", None, None, None, True)]
    found = {r.ordinal: r for r in research.dedupe_sources(research.build_sources(spark.createDataFrame(rows, RESULT))).collect()}
    assert set(found) == {1, 3, 4} and found[4].title == "b.com" and found[3].n_words == 90


def test_usage_and_records(spark):
    calls = spark.createDataFrame([("r", "search", "tavily", None, 0, 0, 3, "q", 1), ("r", "fetch", "x", None, 0, 0, 2, "f", 2), *[("r", "ai", "p", "gpt-5-mini-2025", 1000, 100, 1, "u", k) for k in range(1, 26)]], "run_id string, area string, provider string, model string, prompt_tokens long, completion_tokens long, n int, label string, nth int")
    runs = usage.run_usage(calls)
    row = runs.first()
    assert (row.search_calls, row.pages_fetched, row.ai_calls, row.prompt_tokens) == (3, 2, 25, 25_000) and row.cost_usd == pytest.approx(0.024 + 25 * (0.00025 + 0.0002))
    records = usage.usage_records(runs, calls).collect()
    assert sorted(r.area for r in records) == ["ai"] * 20 + ["fetch", "search"] and next(r for r in records if r.area == "search").provider == "tavily"
    saved = spark.createDataFrame([(1, "u"), (2, "u"), (2, "v")], "id int, user_id string")
    assert sorted(map(tuple, usage.delete_saved(saved, spark.createDataFrame([(2, "v"), (1, "x")], "id int, user_id string")).collect())) == [(1, "u"), (2, "u")]
    cut = usage.feedback_records(spark.createDataFrame([("r" * 200, "c" * 2000)], "reason string, comment string")).first()
    assert (len(cut.reason), len(cut.comment)) == (120, 1000)
    none = spark.createDataFrame([], "hits long")
    assert usage.cache_rate(none, none).first().hit_rate == 0.0
