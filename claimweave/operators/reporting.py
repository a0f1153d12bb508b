"""What a run can show besides its verdict: its stages, why sources scored as they did, and the evidence by numbered references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate
from .dedupe import citation_numbers

TIER_NAMES = {1: "maker or official source", 2: "specialist on parts or devices", 3: "shop or marketplace", 4: "forum or other site"}
MOST_EVIDENCE = 60


def _percent(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("string")


def stage_events(understood: DataFrame, sources: DataFrame, claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (question_id, nth, stage, detail): what each stage of a run gave, from the tables of ``research``.

    Each question has every stage once, also where a stage gave nothing.
    """
    c = F.col
    per = sources.groupBy("question_id").agg(F.count("*").alias("n_sources"), F.count_if("fetched").alias("n_fetched"), F.count_if(c("tier") <= 2).alias("n_high"), F.avg("quality").alias("mean"))
    told = claims.groupBy("question_id").agg(F.count("*").alias("n_claims"), F.count_distinct("source_domain").alias("n_domains"))
    all_ = understood.select("question_id", "intent").join(per, "question_id", "left").join(told, "question_id", "left").join(reports.select("question_id", "verdict", "score"), "question_id", "left")
    filled = all_.fillna(0, ["n_sources", "n_fetched", "n_high", "n_claims", "n_domains"]).fillna(0.0, ["mean"])
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    details = (
        ("understanding", c("intent")),
        ("reading", say(c("n_sources"), " sources, ", c("n_fetched"), " of them fetched")),
        ("evaluating", say(c("n_high"), " of high authority, mean quality ", _percent(c("mean")), "%")),
        ("claims", say(c("n_claims"), " claims of ", c("n_domains"), " sites")),
        ("verdict", F.when(c("verdict").isNotNull(), say(c("verdict"), ", ", c("score"), "%"))),
    )
    rows = [F.struct(F.lit(n).alias("nth"), F.lit(stage).alias("stage"), detail.alias("detail")) for n, (stage, detail) in enumerate(details)]
    return filled.select("question_id", F.inline(F.array(*rows)))


def first_of_stage(events: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """A stream of stage events, each (question_id, stage) once at most; state is dropped ``late`` after the event time."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["question_id", "stage"])


def source_notes(scored: DataFrame) -> DataFrame:
    """Sources of ``score_sources`` with ``notes``, an array of sentences on their scores."""
    c = F.col
    tier = F.concat(F.lit("Tier "), c("tier").cast("string"), F.lit(": "), F.element_at(F.create_map(*[F.lit(x) for kv in TIER_NAMES.items() for x in kv]), c("tier")), F.lit("."))
    notes = (
        tier,
        F.when(c("model") >= 1, "Names the exact model code.").when(c("model") == 0, "Does not name the device."),
        F.when(c("part") >= 1, "Names the exact part number."),
        F.when(c("recency") <= 0.4, "Published more than two years ago.").when(c("published_at").isNull(), "Has no date."),
        F.when(c("explicit"), "Says directly whether the part fits."),
        F.when(c("opposed"), "Speaks of another part or of no fit."),
        F.when(c("independence") < 1, "Another page of this site came before."),
        F.when(c("n_findings") > 0, F.concat(c("n_findings").cast("string"), F.lit(" instruction-like passages were neutralised."))),
        F.when(c("snippet_only"), "Only the snippet was read."),
    )
    return scored.withColumn("notes", F.array_compact(F.array(*notes)))


def evidence_list(placed: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """Rows (question_id, nth, ref, claim, source_url, evidence): the strongest claims of each question, and sources numbered by first mention."""
    order = Window.partitionBy("question_id").orderBy(F.desc("strength"), F.asc("ordinal"))
    kept = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return citation_numbers(kept, ["question_id"], "source_url", "nth").select("question_id", "nth", "ref", "claim", "source_url", truncate(F.col("evidence_text"), 300).alias("evidence"))


#: Most sources and claims of a report, and most claims of a side of a conflict (fixed values).
MOST_SOURCES, MOST_CLAIMS, MOST_OF_SIDE = 40, 60, 4


def report_sources(scored: DataFrame, placed: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """The best ``most`` sources of each question by quality (of equals by place), with ``nth`` and ``n_claims``."""
    counts = placed.groupBy("question_id", "source_id").agg(F.count("*").alias("n_claims"))
    order = Window.partitionBy("question_id").orderBy(F.desc("quality"), "ordinal")
    joined = scored.join(counts, ["question_id", "source_id"], "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0).cast("long")))
    return joined.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def report_claims(placed: DataFrame, most: int = MOST_CLAIMS, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The strongest ``most`` claims of each question, of some kinds only where ``kinds`` are given, with ``nth``."""
    some = placed.where(F.col("claim").isin(*kinds)) if kinds else placed
    order = Window.partitionBy("question_id").orderBy(F.desc("strength"), "ordinal")
    return some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def sources_of_authority(scored: DataFrame, high: bool) -> DataFrame:
    """The sources of tiers 1 and 2, or the others."""
    return scored.where(F.col("tier") <= 2 if high else F.col("tier") >= 3)


def conflict_sides(conflicts: DataFrame, placed: DataFrame, most: int = MOST_OF_SIDE) -> DataFrame:
    """Rows (question_id, cluster_key, n_support, n_oppose, supporting, opposing, causes) of clusters with claims on both sides.

    Each side is an array of structs (nth, claim_id, domain, text) of its first ``most`` claims, cut before they are gathered.
    """
    c = F.col
    key = F.coalesce("variant_key", "device_family_key", F.concat(F.lit("target|"), F.coalesce("part_category", F.lit("other"))))
    sided = placed.withColumn("cluster_key", key).where(c("claim").isin("compatible", "not_compatible")).join(conflicts.select("question_id", "cluster_key"), ["question_id", "cluster_key"], "left_semi")
    order = Window.partitionBy("question_id", "cluster_key", "claim").orderBy("ordinal")
    first = sided.withColumn("nth", F.row_number().over(order)).where(c("nth") <= most)
    item = F.struct("nth", "claim_id", c("source_domain").alias("domain"), c("evidence_text").alias("text"))
    side = lambda kind: F.sort_array(F.collect_list(F.when(c("claim") == kind, item)))
    gathered = first.groupBy("question_id", "cluster_key").agg(side("compatible").alias("supporting"), side("not_compatible").alias("opposing"))
    listed = lambda lead, name: F.concat(F.lit(lead), F.array_join(name, ", "), F.lit("."))
    causes = F.array_compact(F.array(
        F.lit("Sources may mean other regions or revisions of the model."), F.lit("Sellers may offer different assemblies under one name."),
        F.when(F.size("model_numbers") > 1, listed("Several codes are named: ", "model_numbers")), F.when(F.size("variant_markers") > 0, listed("Variants are named: ", "variant_markers")),
    ))
    return conflicts.select("question_id", "cluster_key", "n_support", "n_oppose", causes.alias("causes")).join(gathered, ["question_id", "cluster_key"])
