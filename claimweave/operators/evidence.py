"""Claims to clusters, conflicts, findings, verdicts and confidence; every table carries question_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.devices import base_key
from ..functions.idents import same_generation
from ..functions.scores import confidence_level, confidence_score, verdict


def with_quality(claims: DataFrame, sources: DataFrame, default: float = 0.4) -> DataFrame:
    """Claims with ``source_quality`` (default for unknown sources)."""
    known = sources.select("question_id", "source_id", F.col("quality").alias("_q"))
    return claims.join(known, ["question_id", "source_id"], "left").withColumn("source_quality", F.coalesce("_q", F.lit(default))).drop("_q")


def uncovered(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """The sources (question_id, source_id) that no claim comes from."""
    return sources.join(claims.select("question_id", "source_id").distinct(), ["question_id", "source_id"], "left_anti")


def clusters(claims: DataFrame) -> DataFrame:
    """Claims by variant, else family, else part: counts by kind, domains, quality, the label of the first claim and ``nth``.

    Clusters go by mean quality times domains (of equals by key). ``base`` is the family without generations, null without a family. Codes and marks are
    exploded and counted as sets of different values, so a cluster of many claims is partial aggregates and never a list of all their lists.
    """
    c = F.col
    key = F.coalesce("variant_key", "device_family_key", F.concat(F.lit("target|"), F.coalesce("part_category", F.lit("other"))))
    kind = lambda k: F.count_if(c("claim") == k)
    keyed = claims.withColumn("cluster_key", key)
    by = ["question_id", "cluster_key"]
    totals = keyed.groupBy(*by).agg(
        kind("compatible").alias("n_support"), kind("not_compatible").alias("n_oppose"), kind("unclear").alias("n_unclear"), kind("spec_only").alias("n_spec"),
        F.count_distinct("source_domain").alias("n_domains"), F.avg("source_quality").alias("avg_quality"), F.max("strength").alias("max_strength"), F.min_by("device_canonical", "ordinal").alias("label"), F.first("device_family_key", ignorenulls=True).alias("_family"),
    )
    named = keyed.select(*by, F.explode(F.concat(F.transform("model_numbers", lambda m: F.struct(F.lit(True).alias("code"), m.alias("x"))), F.transform("variant_markers", lambda m: F.struct(F.lit(False).alias("code"), m.alias("x"))))).alias("n"))
    sets = named.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(c("n.code"), c("n.x")))).alias("model_numbers"), F.array_sort(F.collect_set(F.when(~c("n.code"), c("n.x")))).alias("variant_markers"))
    none = F.array().cast("array<string>")
    both = totals.join(sets, by, "left").withColumn("model_numbers", F.coalesce("model_numbers", none)).withColumn("variant_markers", F.coalesce("variant_markers", none))
    order = Window.partitionBy("question_id").orderBy(F.desc(c("avg_quality") * c("n_domains")), "cluster_key")
    return both.withColumn("base", F.nullif(base_key(c("_family")), F.lit(""))).drop("_family").withColumn("nth", F.row_number().over(order))


def conflicts(clusters: DataFrame) -> DataFrame:
    """Clusters with claims on both sides."""
    return clusters.where("n_support > 0 and n_oppose > 0")


MOST_RISKS = 3


def shared_base(a: Column, b: Column) -> Column:
    """Do two base keys name one family: one contains the other?"""
    return a.contains(b) | b.contains(a)


def siblings(clusters: DataFrame, targets: DataFrame, reverse: Column | None = None) -> DataFrame:
    """``clusters`` with ``side``: target, sibling or other, by the base key of the device that is asked for (question_id, target_base).

    A cluster of that very base is on target, one whose base contains it or is contained in it is a sibling. Without a device, or where
    ``reverse`` holds, each cluster with a family (each at all, with ``reverse``) is on target.
    """
    c = F.col
    joined = clusters.join(targets, "question_id")
    asked = c("target_base")
    target = F.when(asked.isNull(), c("base").isNotNull()).otherwise(F.coalesce(c("base") == asked, F.lit(False)))
    target = target if reverse is None else reverse | target
    return joined.withColumn("side", F.when(target, "target").when(F.coalesce(shared_base(c("base"), asked), F.lit(False)), "sibling").otherwise("other"))


def variant_risks(clusters: DataFrame, targets: DataFrame, most: int | None = MOST_RISKS) -> DataFrame:
    """The first ``most`` clusters (all with None) of the family asked for (question_id, target_base, markers) that name other generations than the question does.

    There is no risk without a device, nor where the cluster or the question names no generation.
    """
    joined = clusters.join(targets, "question_id").where(F.coalesce(shared_base(F.col("base"), F.col("target_base")), F.lit(False)))
    order = Window.partitionBy("question_id").orderBy("nth")
    apart = joined.where(~same_generation(F.col("variant_markers"), F.col("markers")))
    ranked = apart.withColumn("nth", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("nth") <= most)


def side_totals(claims: DataFrame) -> DataFrame:
    """One row for each question with all that the verdict and the confidence need; ``exact`` marks the claims on target."""
    weight = F.col("strength") * (0.5 + 0.5 * F.col("source_quality"))
    on = lambda k: F.col("exact") & (F.col("claim") == k)
    s, o = on("compatible"), on("not_compatible")
    return claims.groupBy("question_id").agg(
        F.count_if(s).alias("n_support"), F.count_if(o).alias("n_oppose"), F.count_if(F.col("exact") & F.col("claim").isin("unclear", "spec_only")).alias("n_other"),
        F.count_if(~F.col("exact") & (F.col("claim") == "compatible")).alias("n_sibling"),
        F.coalesce(F.sum(F.when(s, weight)), F.lit(0.0)).alias("w_support"), F.coalesce(F.sum(F.when(o, weight)), F.lit(0.0)).alias("w_oppose"),
        F.coalesce(F.sum(F.when(s, F.col("strength"))), F.lit(0.0)).alias("s_support"), F.coalesce(F.sum(F.when(o, F.col("strength"))), F.lit(0.0)).alias("s_oppose"),
        F.count_distinct(F.when(s, F.col("source_domain"))).alias("d_support"), F.count_distinct(F.when(o, F.col("source_domain"))).alias("d_oppose"),
        F.coalesce(F.max(F.when(s, F.col("strength"))), F.lit(0.0)).alias("best_support"), F.coalesce(F.max(F.when(o, F.col("strength"))), F.lit(0.0)).alias("best_oppose"),
        F.coalesce(F.avg(F.when(s, F.col("source_quality"))), F.lit(0.0)).alias("quality"),
        F.count_distinct(F.when(F.col("source_quality") >= 0.6, F.col("source_domain"))).alias("good_domains"),
        F.coalesce(F.bool_or("part_number_matched"), F.lit(False)).alias("number"), F.coalesce(F.bool_or("exact"), F.lit(False)).alias("has_exact"),
    )


def judge(totals: DataFrame, reverse: Column | None = None, found: Column | None = None, demoted: Column | None = None) -> DataFrame:
    """``totals`` (of :func:`side_totals`, with coverage, n_conflicts and n_risks) with verdict, score and level.

    Where ``reverse`` holds, the verdict follows from ``found``, the domains of the devices found. Where ``demoted`` holds, a verdict of
    compatible becomes uncertain.
    """
    c = F.col
    rule = verdict(c("n_support"), c("n_oppose"), c("w_support"), c("w_oppose"), c("d_support"), c("d_oppose"), c("best_support"), c("best_oppose"), c("quality"), c("n_other"), c("n_sibling"))
    if reverse is not None:
        some = c("n_support") + c("n_oppose") + c("n_other") + c("n_sibling") > 0
        rule = F.when(reverse, F.when(found >= 2, "compatible").when(found == 1, "likely_compatible").when(some, "uncertain").otherwise("insufficient_evidence")).otherwise(rule)
    if demoted is not None:
        rule = F.when(demoted & (rule == "compatible"), "uncertain").otherwise(rule)
    decided = totals.withColumn("verdict", rule)
    scored = decided.withColumn("raw", confidence_score(c("quality"), c("d_support"), c("s_support"), c("s_oppose"), c("coverage"), c("number"), c("good_domains"), c("has_exact"), c("n_conflicts"), c("n_risks"), c("n_support") + c("n_oppose")))
    level = confidence_level(c("raw"), c("verdict"), c("n_support") > 0, c("n_oppose") > 0, c("d_support"), c("good_domains"), c("has_exact"))
    return scored.withColumn("_level", level).select("*", "_level.*").drop("_level", "raw")
