"""Proposals of a model: replies that hold JSON, and claims that pages bear out."""

from pyspark.sql import functions as F

from claimweave.operators import proposals


def test_loose_json(spark):
    given = ['{"a":1}', 'Sure: {"a":{"b":2}} done', '```json\n{"a":3}\n```', "no json", '{"a":', None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").select("k", proposals.loose_json(F.col("t")).alias("j")).collect()
    assert {r.k: r.j for r in rows} == {0: '{"a":1}', 1: '{"a":{"b":2}}', 2: '{"a":3}', 3: None, 4: None, 5: None}


def test_only_quoted_claims_are_accepted(spark):
    page = "The EB-BA155ABY  battery fits the SM-A155F and is sold here."
    sources = spark.createDataFrame([(1, "S1", "s1", page)], "question_id long, ref string, source_id string, text string")
    understood = spark.createDataFrame([(1, "Battery", "battery", "Samsung A15", ["SM-A155F"])], "question_id long, part string, part_category string, device string, model_numbers array<string>")
    quote = "EB-BA155ABY battery fits the SM-A155F"
    rows = [
        (1, "S1", "fits", quote, "A15", "battery", "no such", "eb-ba155aby", ["sm-a155f", "SM-X999"], None, {"voltage": "3.85 V"}), (1, "S1", "compatible", "This quote is made up and nowhere", None, None, None, None, None, None, None),
        (1, "S9", "compatible", quote, None, None, None, None, None, None, None), (1, "S1", "compatible", "battery fits", None, None, None, None, None, None, None), (2, "S1", "compatible", quote, None, None, None, None, None, None, None),
        (1, "S1", "NOT compatible", quote, None, None, "screen", None, [], ["5g"] * 9, None),
    ]
    found = {r.claim: r for r in proposals.accept_claims(spark.createDataFrame(rows, proposals.PROPOSAL), sources, understood).collect()}
    assert set(found) == {"compatible", "not_compatible"}
    yes, no = found["compatible"], found["not_compatible"]
    assert (yes.model_numbers, yes.part_category, yes.part_number, yes.device_canonical) == (["SM-A155F"], "battery", "EB-BA155ABY", "A15")
    assert yes.strength == 0.988 and yes.evidence_strength == "high" and yes.attributes == {"voltage": "3.85 V"}
    assert (no.part_category, no.device_canonical, no.part_raw, len(no.variant_markers)) == ("screen", "Samsung A15", "Battery", 6)
