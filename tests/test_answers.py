import json

from pyspark.sql import functions as F

from claimweave.operators import answers

JUDGED = (
    "question_id int, verdict string, score int, level string, d_support long, n_sources long, n_conflicts long, device string, part string, category string, "
    "model_numbers array<string>, part_numbers array<string>, risks array<string>, checks array<struct<label:string,status:string>>"
)


def test_answers(spark):
    rows = [
        (1, "compatible", 80, "HIGH_CONFIDENCE", 3, 5, 0, "Galaxy A15", "battery", "battery", ["SM-A155F", "SM-A155F"], ["EB-BA155ABY"], [], [("Voltage", "supported"), ("Size", "unknown")]),
        (2, "insufficient_evidence", 0, "UNKNOWN", 0, 1, 0, None, None, None, [], [], [], []),
        (3, "uncertain", 40, "POSSIBLE", 1, 2, 1, None, "Screen", "screen", None, None, ["Another variant.", "More."], None),
        (4, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = {r.question_id: r for r in answers.with_answers(spark.createDataFrame(rows, JUDGED)).collect()}
    assert out[1].headline.startswith("Compatible") and out[1].answer.startswith("5 sources (3 independent publishers in support) agree") and "80%" in out[1].answer
    assert out[1].bullets == ["3 independent sources describe a fit.", "Part numbers in evidence: EB-BA155ABY.", "Model numbers in evidence: SM-A155F.", "Voltage: supported."]
    assert out[1].verify == ["Confirm size.", *answers.ADVICE["battery"], answers.LAST_ADVICE]
    assert out[2].bullets == ["1 source was read without a statement on this."] and out[2].verify == [*answers.ADVICE["other"], answers.LAST_ADVICE]
    assert out[3].bullets == ["1 independent source describes a fit.", "1 group of sources disagree.", "Another variant."] and len(out[3].verify) == 5
    assert out[4].headline == answers.HEADLINES["research_failed"] and out[4].answer.startswith("The run did not end")


def test_warnings_and_envelopes(spark):
    strings = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    row = spark.range(1).select(
        answers.warnings(strings("5G"), F.lit(1), strings("a", "b", "c", "d"), F.lit(2), F.lit(1)).alias("all"), answers.warnings(strings(), F.lit(0), strings(), F.lit(0), F.lit(0)).alias("none"),
        answers.ok_envelope(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))).alias("ok"),
        answers.error_envelope(F.lit("not_found"), F.lit("gone")).alias("e"), answers.error_envelope(F.lit("odd"), F.lit(None).cast("string")).alias("o"),
    ).first()
    assert len(row["all"]) == 7 and row["all"][2:5] == ["a", "b", "c"] and row.none == []
    assert json.loads(row.ok) == {"ok": True, "data": {"a": 1, "b": None}}
    assert row.e.status == 404 and json.loads(row.e.body) == {"ok": False, "error": {"code": "not_found", "message": "gone"}} and row.o.status == 500


def test_merge_reports(spark):
    make = spark.createDataFrame
    session, source, claim = "cache_key string, verdict string, expires_at int", "cache_key string, url string, quality double, ordinal int", "cache_key string, claim string, ordinal int"
    stored = (make([("k1", "uncertain", 1)], session), make([("k1", "u1", 0.1, 0)], source), make([("k1", "old", 0)], claim))
    run = (
        make([("k1", "compatible", 9), ("k2", "uncertain", 9)], session), make([("k1", "u1", 0.7, 5), ("k2", "u2", 0.2, 1), ("k2", "u3", 0.3, 2)], source),
        make([("k1", "new", 0), ("k2", "b", 1), ("k2", "a", 0), ("k2", "c", 2)], claim),
    )
    sessions, sources, claims = answers.merge_reports(stored, run, 1, 2)
    assert sorted(map(tuple, sessions.collect())) == [("k1", "compatible", 1), ("k2", "uncertain", 9)]
    assert sorted(map(tuple, sources.collect())) == [("k1", "u1", 0.7, 0), ("k2", "u2", 0.2, 1)]
    assert sorted(map(tuple, claims.collect())) == [("k1", "old", 0), ("k2", "a", 0), ("k2", "b", 1)]
