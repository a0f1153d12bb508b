"""What a model adds: pages within a budget, replies against a schema, answers against the evidence; the written pages."""

import json

import pytest
from pyspark.sql import functions as F

from claimweave.functions import idents
from claimweave.operators import modelling
from claimweave.sources import fixtures

UNDERSTOOD = "question_id long, device string, model_numbers array<string>, part string, part_number string, part_category string"
PAGE = "The EB-BA155ABY battery is compatible with Samsung Galaxy A15 4G SM-A155F phones. " + "Other words stand here without a meaning. " * 6


@pytest.fixture(scope="module")
def tables(spark):
    pages = [(1, f"s{k}", f"Page {k}. " + PAGE, 0.5 + k / 100) for k in range(9)] + [(1, "poor", PAGE, 0.44), (1, "short", "too short", 0.9), (2, "only", PAGE, 0.9)]
    sources = spark.createDataFrame(pages, "question_id long, source_id string, text string, quality double")
    claims = spark.createDataFrame([(1, "s8"), (2, "only")], "question_id long, source_id string")
    understood = spark.createDataFrame([(q, "Samsung Galaxy A15", ["SM-A155F"], "Battery", None, "battery") for q in (1, 2)], UNDERSTOOD)
    return sources, claims, understood


def test_the_best_pages_without_claims_are_read(tables):
    sources, claims, understood = tables
    found = modelling.candidates(sources, claims).orderBy("nth").collect()
    assert [r.source_id for r in found] == ["s7", "s6", "s5", "s4", "s3", "s2"]
    digested = modelling.digests(modelling.candidates(sources, claims), modelling.wanted_terms(understood))
    one = digested.where("source_id = 's7'").first().digest
    assert one.split("\n") == ["Page 7.", PAGE.split(". ")[0] + ".", "Other words stand here without a meaning."]
    assert digested.count() == 6
    size = len(one)
    assert [r.ref for r in modelling.prompts(digested, 2 * size + 5).orderBy("ref").collect()] == ["S1", "S2"]


def test_claims_need_a_page_that_bears_them_out(spark, tables):
    def model(prompts):
        quote = "The EB-BA155ABY battery is compatible with Samsung Galaxy A15 4G SM-A155F phones."
        good = {"sourceRef": "S1", "evidenceText": quote, "claim": "fits", "modelNumbers": ["sm-a155f", "SM-X999"], "attributes": {"voltage": "3.85 V"}}
        return ["Sure: " + json.dumps({"claims": [good, good | {"sourceRef": "S9"}, good | {"evidenceText": "A quote that nobody wrote anywhere."}]}) for _ in prompts]

    accepted, refused = modelling.propose_claims(model, *tables)
    row = accepted.collect()
    assert len(row) == 1 and row[0].source_id == "s7" and row[0].claim == "compatible" and row[0].model_numbers == ["SM-A155F"] and row[0].extraction_method == "ai" and refused.count() == 0
    for broken, reason in ((lambda p: ["nothing"] * len(p), "no JSON"), (lambda p: [json.dumps({"other": 1})], "not of the schema: claims"), (lambda p: [], "no reply"), (lambda p: 1 / 0, "no reply")):
        accepted, refused = modelling.propose_claims(broken, *tables)
        assert accepted.count() == 0 and [r.reason for r in refused.collect()] == [reason]


def test_answers_go_no_further_than_the_evidence(spark):
    reports = spark.createDataFrame([(k, "compatible", "own", ["own bullet"], ["own advice"], ["SM-A155F"]) for k in range(6)], "question_id int, verdict string, answer string, bullets array<string>, verify array<string>, codes array<string>")
    said = "The battery fits the Galaxy A15 as three shops say"
    proposed = spark.createDataFrame([(0, said, ["too short", "a bullet of  good length"], []), (1, "Yes.", [], []), (2, f"{said}: sm-a155f and SM-A999X.", [], []), (3, f"{said}, but not enough is known.", [], []), (4, f"{said}: SM-A155F.", ["x"], ["see the connector"])], "question_id int, answer string, bullets array<string>, verify array<string>")
    found = {r.question_id: r for r in modelling.accept_answers(proposed, reports).collect()}
    assert [found[k].refused for k in range(6)] == [None, "too short", "names SM-A999X", "against the verdict", None, None]
    assert [found[k].method for k in range(6)] == ["ai_synthesis", *["deterministic"] * 3, "ai_synthesis", "deterministic"]
    assert found[0].bullets == ["a bullet of good length"] and found[0].verify == ["own advice"] and found[4].bullets == [] and found[4].verify == ["see the connector"] and found[3].answer == found[5].answer == "own"


def test_models_in_prose(spark):
    row = spark.range(1).select(idents.model_like(F.lit("SM-A155F, sm-a155f and A1234; iPhone 12 pro, not a15")).alias("x"), idents.model_like(F.lit(None).cast("string")).alias("none")).first()
    assert row.x == ["SM-A155F", "sm-a155f", "A1234", "iPhone 12 pro"] and row.none == []


def test_scenarios_of_queries(spark):
    asks = {"A15 battery": "battery", "a15 power battery": "power_flex", "the BN5A": "injection", "bn5ax": None, "a15 flex": "compatible", "a15 lcd": "conflict", "ps-fixture:none a15 lcd": "none", "ps-fixture:conflict": "conflict", "s9 lcd": None}
    df = spark.createDataFrame([(k,) for k in asks], "query string")
    assert {r["query"]: r.s for r in df.select("query", fixtures.scenario_of(F.col("query")).alias("s")).collect()} == asks
    assert sum(map(len, fixtures.PAGES.values())) == 13


def test_filters_reach_the_reader(spark):
    fixtures.register(spark)
    pages = spark.read.format(fixtures.FORMAT).load()
    assert pages.count() == 13 and pages.rdd.getNumPartitions() == 5
    assert pages.where("scenario = 'battery'").rdd.getNumPartitions() == 1 and pages.where("scenario = 'battery'").count() == 3
    some = pages.where("scenario in ('battery', 'conflict') and ordinal = 0")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    assert pages.where("scenario = 'unknown'").count() == 0
    asked = spark.createDataFrame([(1, "x"), (2, "a15 battery")], "question_id int, query string")
    assert {(r.question_id, r["rank"]) for r in fixtures.search(asked, True).collect()} == {(2, 1), (2, 2), (2, 3)}
    assert fixtures.search(asked, True, limit=1, pinned="conflict").count() == 2
    with pytest.raises(fixtures.NotConfigured):
        fixtures.search(asked, False)
