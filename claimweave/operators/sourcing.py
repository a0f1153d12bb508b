"""Sources of a question scored by quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality, urls
from ..functions.scores import clamp01, half_up, recency, total_quality
from .dedupe import independence


def text_scores(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Each source (question_id, title, snippet, text) with what its text alone says about its question.

    ``questions``: question_id, device, part, part_number, part_category, model_numbers; all but the id may be
    null. Adds relevance, directness, explicit, opposed, model and part. A source without a question is left out.
    """
    c = F.col
    wanted = quality.wanted_terms(c("device"), c("part"), c("model_numbers"), c("part_number"))
    asked = questions.select("question_id", c("part_category").alias("_category"), wanted.alias("_asked"))
    told = sources.join(asked, "question_id").withColumn("_direct", quality.directness(c("title"), c("text"), c("_asked"))).withColumn("_page", quality.page_of(c("title"), c("text")))
    return told.select(
        *[s for s in sources.columns], quality.relevance(c("title"), c("snippet"), c("text"), c("_asked")).alias("relevance"),
        c("_direct.score").alias("directness"), c("_direct.explicit").alias("explicit"), c("_direct.opposed").alias("opposed"),
        quality.model_specificity(c("_page"), c("_asked")).alias("model"), quality.part_specificity(c("_page"), c("_asked"), c("_category")).alias("part"),
    )


def score_sources(sources: DataFrame, questions: DataFrame, as_of: Column) -> DataFrame:
    """``text_scores`` of sources that also have domain, published_at and ordinal, with tier, authority, independence,
    recency and the total, all rounded to two digits after the total is made."""
    c = F.col
    known = independence(text_scores(sources, questions), ["question_id", "domain"], "ordinal").withColumn("tier", urls.domain_tier(F.coalesce("domain", F.lit(""))))
    parts = {"authority": urls.authority(c("tier")), "relevance": c("relevance"), "directness": c("directness"), "model": c("model"), "part": c("part"), "independence": c("independence"), "recency": recency(c("published_at"), as_of), "depth": c("explicit").cast("double")}
    rounded = {name: half_up(p) for name, p in parts.items() if name != "depth"}
    return known.withColumns({"quality": half_up(clamp01(total_quality(**parts))), **rounded})
