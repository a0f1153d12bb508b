from pyspark.sql import functions as F

from claimweave.functions import devices, idents, quality
from claimweave.operators import sourcing

TEXTS = [
    "Can I use a Samsung A15 screen on another phone?", "which battery fits the galaxy a15 5g", "is Note 12 ok", "A15 5G flex", "BN46 for what", "the microphone", None, "apple iPhone 11 Pro Max screen",
    "one plus 9 screen",
]


def test_device_mention(spark):
    df = spark.createDataFrame([(k, t, []) for k, t in enumerate(TEXTS)] + [(9, "charging flex", ["SM-A155F"])], "k int, t string, m array<string>")
    rows = {r.k: r.d for r in df.select("k", devices.device_mention(F.col("t"), F.col("m")).alias("d")).collect()}
    assert rows[0][:] == ("samsung", "Samsung", "samsung a15", "Samsung A15", "samsung a15")
    assert rows[1].raw == "galaxy a15" and rows[1].family == "Samsung Galaxy A15" and rows[1].family_key == "samsung a15"
    assert rows[2].brand == "infinix" and rows[2].raw == "note 12 ok"  # "note " is a name of that brand
    assert rows[3].brand is None and rows[3].raw == "a15" and rows[3].family == "A15"
    assert rows[4] is None and rows[6] is None
    assert rows[5].brand == "xiaomi" and rows[5].raw == ""  # the beginning of a word counts as a brand
    assert rows[7].raw == "iphone 11 pro max"  # the longest name of the brand, though another comes first
    assert rows[8].brand == "oneplus" and rows[8].raw == "one plus 9"
    assert rows[9].raw == "SM-A155F" and rows[9].family_key == "samsung sm-a155f"


def test_keys_and_phrases(spark):
    row = spark.range(1).select(
        devices.base_key(F.lit("samsung a15 5g eu")).alias("base"), devices.variant_key(F.lit("samsung a15 5g"), F.array(F.lit("pro"), F.lit("lte"), F.lit("5g"))).alias("variant"),
        devices.core_tokens(F.lit("Galaxy A15 5G")).alias("cores"), devices.brand_of_models(F.array(F.lit("x1"), F.lit("rmx3000"))).alias("brand"),
        devices.device_phrase(F.lit("Battery for Samsung Galaxy A15, 5G models.")).alias("phrase"), devices.device_phrase(F.lit("no maker")).alias("none"),
        devices.device_phrase(F.lit("Galaxy S21 Ultra Plus Mini Lite Max")).alias("long"),
    ).first()
    assert row.base == "samsung a15" and row.variant == "samsung a15|5g,lte" and row.cores == ["a15", "5g"] and row.brand == "realme"
    assert row.phrase == "Samsung Galaxy A15" and row.none is None and row.long == "Galaxy S21 Ultra Plus Mini"


def test_numbers_near(spark):
    text = "GH82-12345A first. " + "x" * 500 + " claim here " + "y" * 300 + " eb-ba155aby BN46"
    at = text.index("claim") + 1
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(idents.placed_numbers(F.col("t")).alias("n"), idents.number_near(idents.placed_numbers(F.col("t")), F.lit(at), F.lit(10)).alias("near")).collect()
    assert [(n.value, n["at"]) for n in rows[0].n] == [("GH82-12345A", 1), ("EB-BA155ABY", text.index("eb-") + 1), ("BN46", text.index("BN46") + 1)]
    assert [r.near for r in rows] == ["EB-BA155ABY", None, None] and rows[1].n == []


def test_source_scores(spark):
    sources = spark.createDataFrame(
        [
            (1, 0, "a.com", "Parts", "", "The A15 battery is compatible with the Galaxy A15 phone. GH82-1 in stock.", None),
            (1, 1, "a.com", None, None, "A battery not for the galaxy at all, it says so here.", None),
            (1, 2, "b.com", "", "", "", None), (1, 3, None, None, None, None, None), (2, 4, "c.com", "", "", "anything at all about it", None), (9, 5, "c.com", "", "", "no question", None),
        ],
        "question_id int, ordinal int, domain string, title string, snippet string, text string, published_at timestamp",
    )
    questions = spark.createDataFrame(
        [(1, "Galaxy A15", "battery", "GH82-1", "battery", ["SM-A155F"]), (2, None, None, None, None, None)],
        "question_id int, device string, part string, part_number string, part_category string, model_numbers array<string>",
    )
    rows = {r.ordinal: r for r in sourcing.score_sources(sources, questions, F.to_timestamp(F.lit("2024-01-01"))).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    best = rows[0]
    assert (best.relevance, best.directness, best.explicit, best.opposed, best.model, best.part, best.independence, best.recency) == (1.0, 1.0, True, False, 0.65, 1.0, 1.0, 0.5)
    assert best.quality == 0.8  # 0.07 + 0.18 + 0.18 + 0.078 + 0.12 + 0.1 + 0.025 + 0.05
    assert (rows[1].directness, rows[1].explicit, rows[1].opposed, rows[1].model, rows[1].part, rows[1].independence) == (0.6, False, True, 0.4, 0.75, 0.35)
    assert (rows[2].directness, rows[2].model, rows[2].part) == (0.1, 0.0, 0.1) == (rows[3].directness, rows[3].model, rows[3].part)
    assert rows[4].relevance == 0.4


def test_sentences(spark):
    row = spark.createDataFrame([("Short. This one is long enough; so is this one here:\nand a third line\n\n" + "z" * 401,)], "t string").select(quality.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["This one is long enough;", "so is this one here:", "and a third line"]
