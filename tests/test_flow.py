"""Rules that decide what counts: exact variants, families, reading within a budget, reports, requests and records."""

import pytest
from pyspark.sql import functions as F

from claimweave import catalogue
from claimweave.functions import claims as wording
from claimweave.functions import display, idents
from claimweave.operators import answers, evidence, extraction, reporting, research, usage
from claimweave.plans import questions
from claimweave.sources import search

FIT = catalogue._FLOW_TEXTS["yes"]


def placed(spark, device, models, rows, intent="compatibility_check"):
    """Which claims (variant key, markers, models) are kept and exact, for a question on a device."""
    schema = "question_id int, claim_id string, claim string, device_family_key string, variant_key string, variant_markers array<string>, model_numbers array<string>, part_category string, part_raw string, part_number string"
    found = spark.createDataFrame([(1, str(k), "compatible", key, variant, markers, codes, "battery", "battery", None) for k, (key, variant, markers, codes) in enumerate(rows)], schema)
    asked = spark.createDataFrame([(1, intent, device, "Samsung", "Battery", "battery", None, models, ["4g"] if device and "4G" in device else [])], "question_id int, intent string, device string, device_brand string, part string, part_category string, part_number string, model_numbers array<string>, markers array<string>")
    return {int(r.claim_id): r.exact for r in research.place_claims(found, asked).collect()}


def test_exact_variants(spark):
    rows = [("samsung a15", "samsung a15|4g", ["4g"], []), ("samsung a15", "samsung a15|5g", ["5g"], []), ("samsung a15", "samsung a15|", [], []), ("samsung a15", None, [], []), ("nokia 3", "nokia 3|4g", ["4g"], ["SM-A155F"]), ("nokia 3", "nokia 3|", [], [])]
    assert placed(spark, "Galaxy A15 4G", ["SM-A155F"], rows) == {0: True, 1: False, 2: True, 3: True, 4: True}
    # without a device only claims that name none are exact, or those with the very code
    assert placed(spark, None, ["SM-A155F"], rows, "part_to_phones") == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_risks_need_a_shared_family_and_generations(spark):
    schema = "question_id int, cluster_key string, base string, label string, variant_markers array<string>, nth int"
    clusters = spark.createDataFrame([(1, "a", "samsung a15", "A15 5G", ["5g"], 1), (1, "b", "samsung a15 plus", "A15 plus", ["5g", "plus"], 2), (1, "c", "nokia 3", "N3", ["5g"], 3), (1, "d", "samsung a15", "A15", [], 4), (1, "e", "samsung a15", "A15 4G", ["4g", "5g"], 5), (1, "f", None, "?", ["5g"], 6), (2, "a", "samsung a15", "A15 5G", ["5g"], 1)], schema)
    targets = spark.createDataFrame([(1, "samsung a15", ["4g"]), (2, None, ["4g"])], "question_id int, target_base string, markers array<string>")
    assert sorted((r.question_id, r.cluster_key, r.nth) for r in evidence.variant_risks(clusters, targets).collect()) == [(1, "a", 1), (1, "b", 2)]
    sides = {(r.question_id, r.cluster_key): r.side for r in evidence.siblings(clusters, targets.drop("markers")).collect()}
    assert sides == {(1, "a"): "target", (1, "b"): "sibling", (1, "c"): "other", (1, "d"): "target", (1, "e"): "target", (1, "f"): "other", (2, "a"): "target"}
    assert {r.side for r in evidence.siblings(clusters, targets.drop("markers"), F.lit(True)).collect()} == {"target"}


def test_words_within_words_are_no_brands_or_codes(spark):
    df = spark.createDataFrame([("applesauce and googled",), ("an Apple a day",), ("http404 GB128 M1234567 M2101K6G SM-A155F sm a155f RMX3363 rmx-3363",)], "x string")
    rows = df.select(F.col("x").rlike(wording.BRAND_MENTION).alias("b"), idents.segment_models(F.col("x")).alias("m")).collect()
    assert [r.b for r in rows] == [False, True, False] and rows[0].m == []
    assert "SM-A155F" in rows[2].m and "RMX3363" in rows[2].m and not {"HTTP404", "GB128", "M1234567"} & set(rows[2].m) and len(rows[2].m) <= 8
    keys = spark.createDataFrame([("Can I use the X battery?",), ("use X battery",)], "q string").select(questions.normalize_question(F.col("q")).alias("k")).distinct()
    assert [r.k for r in keys.collect()] == ["use x battery"]


def test_attributes_speak_for_checks(spark):
    claims = spark.createDataFrame([(1, {"connector": "USB-C", "voltage": "3.85 V"}), (1, {"connector": "FPC", "unknown": "x"}), (2, {})], "question_id int, attributes map<string,string>")
    assert sorted(map(tuple, extraction.attribute_checks(claims).select("question_id", "check_id").collect())) == [(1, "charging_port"), (1, "connector"), (1, "connector_type"), (1, "voltage")]


def test_pages_are_read_within_the_budget(spark):
    schema = "question_id int, ordinal int, url string, title string, snippet string, published_at date, raw_content string, score double"
    rows = [(1, 0, "https://a.com/inline", "t", "s", None, "inline text", 0.1), (1, 1, "https://parts.com/x", "t", "s", None, None, 0.5), (1, 2, "https://b.com/y.pdf", "t", "s", None, None, 0.9), (1, 3, "https://c.com/gone", "t", "s", None, None, 0.6), (1, 4, "https://d.com/", "t", "s", None, None, 0.0)]
    pages = spark.createDataFrame([("https://parts.com/x", "page text", None), ("https://c.com/gone", None, "status 410")], "canonical string, content string, failure string")
    read = {r.ordinal: r for r in search.read_results(spark.createDataFrame(rows, schema), pages, 3).collect()}
    assert {k: r.how for k, r in read.items()} == {0: "inline", 1: "fetch", 2: "snippet", 3: "fetch", 4: "snippet"}
    assert read[1].raw_content == "page text" and read[1].fetched and read[1].failure is None
    assert not read[3].fetched and read[3].failure == "status 410" and read[4].failure == search.NO_BUDGET and read[2].raw_content is None and read[0].raw_content == "inline text"


def test_a_whole_run_with_pages_and_a_model(spark):
    asked = spark.createDataFrame([(1, 0)], "question_id int, scenario int")
    questions_, _, checklist = catalogue.flow_tables(asked)
    schema = "question_id int, ordinal int, url string, title string, snippet string, published_at date, raw_content string"
    results = spark.createDataFrame([(1, 0, "https://www.ifixit.com/a", "A15 battery", "s", None, None), (1, 1, "https://mobilesentrix.com/b", "A15 battery SM-A155F", "s", None, None), (1, 2, "https://c.example.com/c", "t", "no page", None, None)], schema)
    silent = "Galaxy A15 news of the repair trade, SM-A155F and others. " + "Words without any claim stand here. " * 8 + "Our bench says: goes in nicely, EB-BA155ABY into the SM-A155F."
    pages = spark.createDataFrame([("https://ifixit.com/a", FIT, None), ("https://mobilesentrix.com/b", silent, None)], "canonical string, content string, failure string")

    def model(prompts):
        return ['{"claims": [{"sourceRef": "S1", "evidenceText": "Our bench says: goes in nicely, EB-BA155ABY into the SM-A155F.", "claim": "fits", "deviceRaw": "Galaxy A15 4G", "partRaw": "battery", "modelNumbers": ["SM-A155F"]}]}' for _ in prompts]

    as_of = F.lit("2025-01-01").cast("date")
    plain = research.research(questions_, results, checklist, as_of, pages, 2)
    helped = research.research(questions_, results, checklist, as_of, pages, 2, model)
    domains = lambda run: {c.source_domain for c in run["claims"].where("claim = 'compatible'").collect()}
    failures = {s.domain: s.failure for s in plain["sources"].collect()}
    assert failures["c.example.com"] == search.NO_BUDGET and failures["ifixit.com"] is None
    assert domains(plain) == {"ifixit.com"} and domains(helped) == {"ifixit.com", "mobilesentrix.com"} and helped["refused"].count() == 0
    best = reporting.report_sources(helped["sources"], helped["claims"], 2).orderBy("nth").collect()
    assert [r.nth for r in best] == [1, 2] and best[0].quality >= best[1].quality and {r.n_claims for r in best} == {1}
    assert reporting.sources_of_authority(helped["sources"], True).count() == 2 and reporting.sources_of_authority(helped["sources"], False).count() == 1
    assert [r.nth for r in reporting.report_claims(helped["claims"], 1, ("compatible",)).collect()] == [1] and reporting.report_claims(helped["claims"], 9, ("not_compatible",)).count() == 0


def test_conflicts_show_both_sides(spark):
    schema = "question_id int, cluster string, claim string, claim_id string, source_domain string, evidence_text string, ordinal int, variant_key string, device_family_key string, part_category string"
    rows = [(1, "v", "compatible", f"c{k}", f"d{k}", "t", k, "v", "f", "battery") for k in range(6)] + [(1, "v", "not_compatible", "n", "e", "t", 9, "v", "f", "battery"), (1, "w", "compatible", "x", "e", "t", 9, "w", "f", "battery")]
    clusters = spark.createDataFrame([(1, "v", 6, 1, ["A", "B"], ["4g"])], "question_id int, cluster_key string, n_support long, n_oppose long, model_numbers array<string>, variant_markers array<string>")
    row = reporting.conflict_sides(clusters, spark.createDataFrame(rows, schema)).collect()
    assert len(row) == 1 and [x.claim_id for x in row[0].supporting] == ["c0", "c1", "c2", "c3"] and [x.claim_id for x in row[0].opposing] == ["n"] and len(row[0].causes) == 4


def test_requests_and_images(spark):
    bodies = ['{"question": " Fits it? "}', '{"question": "ab"}', '{"device": "A15", "mode": "check"}', '{"device": "A15"}', '{"modelNumber": "SM-A155F"}', "[1]", "nonsense", None, '{"part": "%s"}' % ("x" * 121)]
    good, bad = search.parse_requests(spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string"), "b")
    assert {r.k: (r.request.question, r.request.mode) for r in good.collect()} == {0: ("Fits it?", "auto"), 3: (None, "auto")}
    assert {r.k: r.fault for r in bad.collect()} == {1: "the question is too short", 2: "no such mode", 4: "nothing is asked", 5: "no JSON object", 6: "no JSON object", 7: "no JSON object", 8: "too long: part"}
    jpeg = bytes.fromhex("FFD8FFE000104A46") * 4
    uploads = spark.createDataFrame([(0, jpeg, "image/jpg"), (1, jpeg, "image/png"), (2, b"text", "image/png"), (3, b"", None), (4, jpeg * 100, "image/jpeg; x=y"), (5, jpeg, None)], "k int, c binary, t string")
    assert {r.k: r.fault for r in search.accept_images(uploads, "c", "t", 100).collect()} == {0: None, 1: "not of the declared type", 2: "no image", 3: "empty", 4: "too large", 5: None}


def test_runs_without_a_conclusion(spark):
    runs = spark.createDataFrame([(1, 0, "provider_not_configured"), (2, 3, "no_evidence"), (3, 0, "timeout"), (4, None, "boom")], "question_id int, n_sources int, failure string")
    found = {r.question_id: r for r in answers.empty_reports(runs).collect()}
    assert [found[k].verdict for k in (1, 2, 3, 4)] == ["not_configured", "insufficient_evidence", "research_failed", "research_failed"] and found[2].answer.startswith("3 pages were read")
    assert len(found[1].verify) == 3 and found[4].verify == [] and all(r.score == 0 and r.level == "UNKNOWN" for r in found.values())
    assert set(answers.ADVICE) == {c for c, _, _, _ in research.parts.CATEGORIES}


def test_records_and_plans(spark):
    sessions = spark.createDataFrame([("compatible", 10, 0.25), ("research_failed", 20, 0.5), ("insufficient_evidence", None, None)], "verdict string, duration_ms long, cost_usd double")
    row = usage.session_totals(sessions).first()
    assert (row.n, row.no_result, row.failed, row.average_ms) == (3, 1, 1, 15) and row.cost_usd == pytest.approx(0.75)
    assert {tuple(r) for r in usage.provider_usage(spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", None)], "provider string, cost_usd double")).collect()} == {("a", 2, 0.3), ("b", 1, 0.0)}
    plans = spark.createDataFrame([("PRO",), ("x",), (None,)], "p string").select(display.plan_of(F.col("p")).alias("x"), display.make_id(F.lit("rs")).alias("id")).collect()
    assert [tuple(r.x) for r in plans] == [("PRO", 150, 8), ("FREE", 10, 5), ("FREE", 10, 5)] and len({r.id for r in plans}) == 3 and all(r.id.startswith("rs_") for r in plans)
    cut = usage.identification_records(spark.createDataFrame([("i" * 300,)], "identifier string")).first()
    saved = usage.saved_search_rows(spark.createDataFrame([("q" * 600, "l" * 300)], "query string, label string")).first()
    assert len(cut.identifier) == 200 and (len(saved["query"]), len(saved.label)) == (500, 200)
