import pytest
from pyspark.sql import functions as F

from claimweave.functions import claims as wording
from claimweave.operators import extraction
from claimweave.sources import search

TARGET = "question_id int, device_terms array<string>, device_cores array<string>, part_terms array<string>, aliases array<string>, part string, part_number string, category string, model_numbers array<string>"


def claims_of(spark, texts, devices=("samsung galaxy a15", "a15"), cores=("a15",)):
    pages = spark.createDataFrame([(1, f"s{k}", t) for k, t in enumerate(texts)], "question_id int, source_id string, text string")
    targets = spark.createDataFrame([(1, list(devices), list(cores), ["battery", "phone battery"], ["phone battery", "battery"], "battery", None, "battery", ["SM-A155F"])], TARGET)
    return pages, extraction.extract_claims(pages, targets).orderBy("source_id", "ordinal")


def test_claims_and_carried_context(spark):
    page = "This battery is compatible with Galaxy A15 phones.\nSM-A155F, SM-A156B\nIt does not fit the Galaxy A15 5G at all.\nNothing of interest here today."
    _, found = claims_of(spark, [page, "SM-A155F, SM-A156B", None, ""])
    rows = found.collect()
    assert [(r.source_id, r.claim, r.inherited) for r in rows] == [("s0", "compatible", False), ("s0", "compatible", True), ("s0", "not_compatible", False)]
    assert rows[1].model_numbers == ["SM-A155F", "SM-A156B"] and {r.part_raw for r in rows} == {"battery"} and {r.category for r in rows} == {"battery"}
    assert rows[2].strength == pytest.approx(0.42 * 0.95 + 0.10)  # the part is carried over
    assert rows[0].strength == pytest.approx(0.42 * 0.95 + 0.18) and rows[1].strength == pytest.approx(0.42 * 0.7 + 0.22 + 0.18)


def test_redacted_segments_and_questions_without_a_device(spark):
    _, found = claims_of(spark, ["[REDACTED-INSTRUCTION-LIKE-TEXT] this battery fits the Samsung phone.", "A phone battery that fits Samsung A155 phones."], (), ())
    assert [(r.source_id, r.claim, r.part_raw) for r in found.collect()] == [("s1", "compatible", "phone battery")]


def test_checklist(spark):
    page = "This battery is compatible with Galaxy A15 phones. It has 3.85 V and a 10 pin connector."
    other = "The battery of the Galaxy A15 does not fit as its connector differs."
    pages, found = claims_of(spark, [page, other])
    contexts = extraction.claim_context(found, pages)
    items = spark.createDataFrame([("battery", "connector", ["connector", "v"]), ("battery", "voltage", ["3.85 v"]), ("battery", "dimensions", ["mm", "dimensions"]), ("battery", "device_model", [])], "category string, check_id string, indicators array<string>")
    questions = spark.createDataFrame([(1, "battery"), (2, "battery"), (3, "screen")], "question_id int, category string")
    status = {(r.question_id, r.check_id): r.status for r in extraction.run_checklists(questions, items, contexts).collect()}
    assert status == {
        (1, "connector"): "conflicting", (1, "voltage"): "supported", (1, "dimensions"): "unknown", (1, "device_model"): "unknown",
        **{(2, c): "unknown" for c in ("connector", "voltage", "dimensions", "device_model")},
    }


def test_wordings(spark):
    df = spark.createDataFrame([("It fits but is not compatible with it",), ("3000 mAh, 3.85V, 10-pin LCD",), ("plain",)], "x string")
    rows = df.select(wording.claim_match(F.col("x")).alias("m"), wording.attributes(F.col("x")).alias("a"), wording.canonical_part(F.col("x")).alias("p")).collect()
    assert rows[0].m == ("not_compatible", 0.95) and rows[2].m is None and rows[2].a == {} and rows[2].p == ("plain", None)
    assert rows[1].a == {"voltage": "3.85V", "capacity": "3000 mAh", "pin_count": "10", "panel": "LCD"} and rows[1].p == ("LCD display assembly", "screen")
    row = spark.range(1).select(search.fetch_priority(F.lit("fixit.com"), F.lit("https://fixit.com/a.pdf"), F.lit(0.5), F.lit("x" * 121)).alias("y")).first()
    assert row.y == 4.0
