"""What a language model may add to a run: which pages it reads, its replies against a schema, and answers that go no further than the evidence.

The model is a Python function over lists of prompts that the caller gives (none by default: a run needs no model). It is called in tasks, by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parts
from ..functions.idents import model_like, normalize_identifier
from ..functions.safety import evidence_block
from ..functions.text import collapse_whitespace, normalize_match, split_segments, truncate
from .evidence import uncovered
from .proposals import PROPOSAL, accept_claims, loose_json

#: Pages that a model reads: how many of a question, least quality and length, and most characters of a page and of a question (fixed values).
MOST_PAGES, LEAST_QUALITY, LEAST_TEXT, DIGEST, BUDGET = 6, 0.45, 220, 3_500, 24_000
#: Aliases of a category by which a page's segments are chosen (fixed value).
MOST_ALIASES = 8
#: Shortest answer, bullet and advice, and most of them (fixed values).
SHORTEST_ANSWER, SHORTEST_BULLET, SHORTEST_ADVICE, MOST_BULLETS, MOST_ADVICE = 40, 12, 8, 6, 5
#: Words by which an answer says that there is no evidence (fixed value).
NO_EVIDENCE = r"(?i)no evidence|not enough|insufficient"

Model = Callable[[list[str]], list[str]]


def candidates(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """The sources (question_id, source_id, text, quality) that have no claim yet and are worth a model's time, with ``nth`` by quality.

    They are of quality 0.45 or more, longer than 220 characters, and the best six of a question (of equals by source_id).
    """
    worth = uncovered(sources, claims).where((F.col("quality") >= LEAST_QUALITY) & (F.length("text") > LEAST_TEXT))
    order = Window.partitionBy("question_id").orderBy(F.desc("quality"), "source_id")
    return worth.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MOST_PAGES)


def wanted_terms(understood: DataFrame) -> DataFrame:
    """Rows (question_id, terms): what a page's segments are chosen by, normalised."""
    given = F.concat(F.array("device"), F.col("model_numbers"), F.array("part", "part_number"), F.slice(parts.named(F.col("part_category")), 1, MOST_ALIASES))
    return understood.select("question_id", F.filter(F.transform(given, lambda t: normalize_match(F.coalesce(t, F.lit("")))), lambda t: t != "").alias("terms"))


def digests(pages: DataFrame, terms: DataFrame, most: int = DIGEST) -> DataFrame:
    """``pages`` (question_id, source_id, text and more) with ``digest``: the segments that name a term, each with its neighbours, in order and once.

    A page without any is its own digest. It is cut to ``most`` characters.
    """
    c = F.col
    key = ["question_id", "source_id"]
    rows = pages.join(terms, "question_id").select(*key, "terms", F.posexplode(split_segments(F.coalesce("text", F.lit("")))).alias("pos", "segment"))
    norm = rows.withColumn("_norm", normalize_match(c("segment"))).withColumn("_hit", F.exists("terms", lambda t: c("_norm").contains(t)))
    page = Window.partitionBy(*key).orderBy("pos")
    near = norm.withColumn("_near", F.max("_hit").over(page.rowsBetween(-1, 1))).where("_near")
    once = near.groupBy(*key, "segment").agg(F.min("pos").alias("pos"))
    said = once.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "segment")))["segment"], "\n").alias("_said"))
    return pages.join(said, key, "left").withColumn("digest", truncate(F.coalesce("_said", "text", F.lit("")), most)).drop("_said")


def prompts(digested: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows (question_id, ref, source_id, text, block) of the pages whose digests fit a question's budget, taken in order of ``nth``.

    A digest that no longer fits is left out, a shorter one after it may still fit. Refs are S1, S2 by ``nth``.
    """
    page = F.struct("nth", "source_id", "text", "digest")
    held = digested.where("digest != ''").groupBy("question_id").agg(F.sort_array(F.collect_list(page)).alias("_pages"))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("taken"))

    def step(held: Column, page: Column) -> Column:
        fits = F.length(page["digest"]) <= held["left"]
        return F.struct(F.when(fits, held["left"] - F.length(page["digest"])).otherwise(held["left"]).alias("left"), F.when(fits, F.array_append(held["taken"], page["nth"])).otherwise(held["taken"]).alias("taken"))

    taken = held.withColumn("_taken", F.aggregate("_pages", start, step, lambda held: held["taken"])).select("question_id", "_taken", F.inline("_pages")).where(F.array_contains("_taken", F.col("nth")))
    ref = F.concat(F.lit("S"), F.col("nth").cast("string"))
    return taken.select("question_id", ref.alias("ref"), "source_id", "text", evidence_block(ref, F.col("digest")).alias("block"))


def ask(asked: DataFrame, model: Model, *keys: str) -> DataFrame:
    """Rows (keys, reply): what ``model`` replies to the column ``prompt``. A reply that is missing is null; a batch whose call fails has none."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                replies = list(model(pdf["prompt"].tolist()))
            except Exception:  # noqa: BLE001  a run goes on without the model
                replies = []
            replies += [None] * (len(pdf) - len(replies))
            yield pdf[list(keys)].assign(reply=pd.Series(replies[: len(pdf)], dtype=object, index=pdf.index))

    rows = asked.select(*keys, "prompt")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "prompt")
    return rows.mapInPandas(call, f"{schema}, reply string")


def checked(replies: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replies that are JSON of a schema, as ``data``, and the others with a ``reason``.

    Accepted are objects, perhaps within other text, whose ``required`` fields are there and have the types of ``schema``.
    """
    c = F.col
    read = replies.withColumn("_json", loose_json(c("reply")))
    read = read.withColumn("data", F.from_json("_json", schema, {"mode": "PERMISSIVE"}))
    missing = F.array_compact(F.array(*[F.when(c(f"data.{name}").isNull(), F.lit(name)) for name in required]))
    reason = F.when(c("reply").isNull(), "no reply").when(c("_json").isNull(), "no JSON").when(F.size(missing) > 0, F.concat(F.lit("not of the schema: "), F.array_join(missing, ", ")))
    told = read.withColumn("reason", reason).drop("_json")
    return told.where("reason is null").drop("reason", "reply"), told.where("reason is not null").drop("data")


#: What a model is asked to reply about claims.
CLAIM_REPLY = f"claims array<struct<{', '.join(f.replace(' ', ':', 1) for f in PROPOSAL.split(', ') if not f.startswith(('question_id', 'ref ')))}, sourceRef:string>>"


def propose_claims(model: Model, sources: DataFrame, claims: DataFrame, understood: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Claims that a model finds on pages without any, as far as the pages bear them out, and the replies that were refused.

    One prompt a question holds the blocks of its pages. Claims are those of :func:`accept_claims`.
    """
    held = prompts(digests(candidates(sources, claims), wanted_terms(understood)), budget)
    asked = held.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ref", "block")))["block"], "\n\n").alias("prompt"))
    replies = ask(asked, model, "question_id")
    good, bad = checked(replies, CLAIM_REPLY, ["claims"])
    rows = good.select("question_id", F.explode("data.claims").alias("c")).select("question_id", F.col("c.sourceRef").alias("ref"), "c.*").drop("sourceRef")
    return accept_claims(rows, held.select("question_id", "ref", "source_id", "text"), understood), bad


def accept_answers(proposed: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` (question_id, verdict, answer, bullets, verify, codes) with the answers of a model where they hold, ``method`` and ``refused``.

    ``proposed``: question_id, answer, bullets, verify. An answer of fewer than 40 characters is refused, one that names a model that is not among ``codes``,
    and one that finds no evidence where the verdict is compatible. Of an accepted one bullets and advice that are too short go, and missing ones are the report's own.
    """
    c = F.col
    # no list or an empty one is null, for which the report's own stands; a list of which nothing is long enough is empty
    listed = lambda name, least, most: F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) > 0, F.slice(F.filter(F.transform(name, collapse_whitespace), lambda x: F.length(x) > least), 1, most)).alias(f"_{name}")
    other = proposed.select("question_id", collapse_whitespace(F.coalesce("answer", F.lit(""))).alias("_answer"), listed("bullets", SHORTEST_BULLET, MOST_BULLETS), listed("verify", SHORTEST_ADVICE, MOST_ADVICE), F.lit(True).alias("_given"))
    # both sides have a row a question; lists are far larger than the files that Spark judges them by, so neither is broadcast
    joined = reports.join(other.hint("merge"), "question_id", "left")
    known = F.transform(F.coalesce("codes", F.array().cast("array<string>")), normalize_identifier)
    foreign = F.array_except(F.transform(model_like(c("_answer")), normalize_identifier), known)
    refused = F.when(c("_given").isNull(), F.lit(None)).when(F.length("_answer") < SHORTEST_ANSWER, "too short").when(F.size(foreign) > 0, F.concat(F.lit("names "), F.array_join(F.slice(foreign, 1, 5), ", "))).when(c("_answer").rlike(NO_EVIDENCE) & (c("verdict") == "compatible"), "against the verdict")
    told = joined.withColumn("refused", refused).withColumn("_ok", c("_given").isNotNull() & c("refused").isNull())
    held = lambda name: F.when(c("_ok"), F.coalesce(f"_{name}", name)).otherwise(c(name))
    return told.withColumns({
        "answer": F.when(c("_ok"), c("_answer")).otherwise(c("answer")), "bullets": held("bullets"), "verify": held("verify"), "method": F.when(c("_ok"), "ai_synthesis").otherwise("deterministic"),
    }).select(*reports.columns, "method", "refused")
