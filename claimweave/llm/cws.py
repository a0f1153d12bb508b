"""Document fingerprints by consistent weighted sampling. DataFrame operations only: no Python on the main path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, key_to_id, materialize, whole_text

#: Samples of a fingerprint. The likeness of two has a standard error of at most 1 / (2 sqrt(SAMPLES)) = 0.0625.
SAMPLES = 64
#: Terms that could be the sample of a document with probability exp(-SURE) at most are skipped before any logarithm:
#: 4e-18, far below the chance that two of its words share a 64-bit hash. One term of a text is never skipped.
SURE = 40
#: Ids whose order one task works out.
RUN_IDS = 1 << 19
WHITE = " \t\n\x0b\f\r"
_TEXT, _EDITED, _BOTH = 1, 2, 3


def _part(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def sample_key(x: Column, weight: Column, limit: Column) -> Column:
    """A sample of a weighted term as a long; the least one of a document's terms is the document's sample.

    x is a hash of the term and of the sample's number. r and c are Gamma(2, 1) numbers and b a uniform one,
    all drawn from x. With t = floor(ln w / r + b), the term of least a = c exp(-r (t - b + 1)) is sampled,
    and (term, t) is the sample. The upper half of the long orders by ln a in steps of 2^-24, the lower half
    is a hash of (term, t).

    As r (t - b + 1) is at most ln w + r, a is at least (2 - u3 - u4) u1 u2 / w, where c = -ln(u3 u4) and
    r = -ln(u1 u2). Where that is over ``limit`` (2^48 w SURE / the document's sum of weights; null: none), the key is null:
    the document's least a is exponential with that sum as its rate, so it lies above but once in exp(SURE).
    """
    more = F.xxhash64(x)
    s = [_part(x, 16 * k, 16) for k in range(4)]
    hopeful = limit.isNull() | ((F.lit(131_070) - s[0] - s[1]) * (s[2] * s[3]) <= limit)
    u = [(s[k].cast("double") * 8192.0 + _part(more, 13 * k, 13).cast("double") + 0.5) * F.lit(2.0**-29) for k in range(4)]
    b = (_part(more, 52, 12).cast("double") + 0.5) * F.lit(2.0**-12)
    c, r = -F.ln(u[0] * u[1]), -F.ln(u[2] * u[3])
    t = F.when(weight == 1, F.lit(0.0)).otherwise(F.floor(F.ln(weight.cast("double")) / r + b).cast("double"))
    order = ((F.ln(c) - r * (t - b + 1) + 64.0) * F.lit(2.0**24)).cast("long")
    order = F.greatest(F.lit(0).cast("long"), F.least(F.lit(2**31 - 1).cast("long"), order))
    return F.when(hopeful, F.shiftleft(order, 32).bitwiseOR(F.xxhash64(x, t).bitwiseAND(F.lit(0xFFFFFFFF))))


def _hashes(text: Column, side: int) -> Column:
    """Hash of each word; its lowest bit is the side."""
    words = F.split(F.trim(ascii_lower(text), F.lit(WHITE)), r"[\x20\x09-\x0D]+")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side)))


def weighted_terms(pairs: DataFrame, by: list[str], text: str, edited: str) -> DataFrame:
    """Rows (*by, term, weight, role, limit): the terms of two texts with how often they occur.

    A term that occurs as often in both is one row of role _BOTH. Words are hashed, sorted and run-length
    counted within their row. The first row of a text has no limit.
    """
    hashed = pairs.select(*by, _hashes(F.col(text), 0).alias("_x"), _hashes(F.col(edited), 1).alias("_y"))
    limit = F.lit(SURE * 2.0**48) / F.least(F.size("_x"), F.size("_y"))
    sorted_ = hashed.select(*by, limit.alias("_limit"), F.sort_array(F.concat("_x", "_y")).alias("_h"))
    begins = sorted_.withColumn("_b", F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1))))
    begin = lambda j: F.coalesce(F.get("_b", j), F.size("_h"))
    term = lambda p: F.get("_h", p).bitwiseAND(F.lit(-2))

    def run(p: Column, j: Column) -> Column:
        """A run of one word of one side, with the length of the other side's run if that follows or precedes."""
        edited_side = F.get("_h", p).bitwiseAND(F.lit(1)) == 1
        after = F.when(term(begin(j + 1)) == term(p), begin(j + 2) - begin(j + 1))
        before = F.when((j > 0) & (term(F.get("_b", j - 1)) == term(p)), p - F.get("_b", j - 1))
        weight = begin(j + 1) - p
        same = F.when(edited_side, before).otherwise(after) == weight
        role = F.when(F.coalesce(same, F.lit(False)), F.when(edited_side, F.lit(0)).otherwise(F.lit(_BOTH))).when(edited_side, F.lit(_EDITED)).otherwise(F.lit(_TEXT))
        return F.struct(term(p).alias("term"), weight.alias("weight"), role.alias("role"))

    runs = begins.select(*by, "_limit", F.filter(F.transform("_b", run), lambda s: s["role"] != 0).alias("_runs"))
    first = lambda other: F.array_position(F.transform("_runs", lambda s: s["role"] != other), F.lit(True)) - 1
    rows = runs.withColumns({"_first": first(_EDITED), "_second": first(_TEXT)}).select(*by, "_limit", "_first", "_second", F.posexplode_outer("_runs").alias("_nth", "_run"))
    limited = (F.col("_nth") != F.col("_first")) & (F.col("_nth") != F.col("_second"))
    return rows.select(*by, "_run.term", "_run.weight", "_run.role", F.when(limited, (F.col("_limit") * F.col("_run.weight")).cast("long")).alias("limit"))


def fingerprint_pairs(pairs: DataFrame, by: list[str], text: str, edited: str, samples: int = SAMPLES) -> DataFrame:
    """One row for each different ``by`` with ``fp`` and ``edited_fp``, the arrays of samples of the row's two texts.

    Terms are the words of a text with A-Z lower-cased, weighted by how often they occur; a text without words
    has the empty term once. Terms that both texts have draw their numbers once. The only grouping is by
    ``by``; it needs no shuffle if the rows are partitioned by some of these columns.
    """
    terms = weighted_terms(pairs, by, text, edited)
    hashes = terms.select(*by, "weight", "role", "limit", *[F.xxhash64("term", F.lit(k)).alias(f"x{k}") for k in range(samples)])
    least = hashes.groupBy(*by, "role").agg(*[F.min(sample_key(F.col(f"x{k}"), F.col("weight"), F.col("limit"))).alias(f"m{k}") for k in range(samples)])
    sides = (("m", _EDITED), ("e", _TEXT))
    both = least.groupBy(*by).agg(*[F.min(F.when(F.col("role") != other, F.col(f"m{k}"))).alias(f"{name}{k}") for name, other in sides for k in range(samples)])
    array = lambda name: F.array(*[(F.col(f"{name}{k}").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int") for k in range(samples)])
    return both.select(*by, array("m").alias("fp"), array("e").alias("edited_fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that are equal: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def fingerprint_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (key, tie, copies, n_chars, next_key, next_tie): each different (doc_id, text) with the next one, the first after the last.

    ``tie`` is the MD5 of the text; rows that repeat a doc_id follow each other by it. Only ids, hashes and lengths are
    sorted, in runs of about RUN_IDS by range, whatever the ids are like; the ends of the runs are one row each.
    """
    ids = docs.select(doc_key().alias("key"), F.md5(whole_text()).alias("tie"), F.length(whole_text()).cast("long").alias("n_chars"))
    once = ids.groupBy("key", "tie").agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"))
    runs = max(1, -(-docs.count() // RUN_IDS))
    ranged = materialize(once.repartitionByRange(runs, "key", "tie").withColumn("run", F.spark_partition_id()), "order")
    ends = ranged.groupBy("run").agg(F.min(F.struct("key", "tie")).alias("first"))
    over = Window.orderBy("run")  # one row for each RUN_IDS documents
    ends = ends.select("run", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("after"))
    inside = F.lead(F.struct("key", "tie")).over(Window.partitionBy("run").orderBy("key", "tie"))
    placed = ranged.withColumn("next", inside).join(ends, "run").withColumn("next", F.coalesce("next", "after"))
    return materialize(placed.select("key", "tie", "copies", "n_chars", F.col("next.key").alias("next_key"), F.col("next.tie").alias("next_tie")), "next")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Rows (key, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for every row of ``docs`` (doc_id, text).

    The edited text replaces the last quarter (rounded down) of the code points by the first as many, or all,
    of the next document by doc_id; after the last comes the first. Rows that repeat a doc_id follow each other
    by the MD5 of the text; equal rows are worked on once and counted. Null texts are empty; two empty texts are alike, an empty and
    another one are not. A null doc_id sorts before all others. Texts are shuffled once, and the part that goes to the document before once more.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "key long, n_chars long, edited_sha256 string, fp array<int>, edited_fp array<int>, near_edited double, near_next double")
    order = in_order(docs)
    texts = docs.select(doc_key().alias("key"), F.md5(whole_text()).alias("tie"), whole_text().alias("text")).repartition("key", "tie")
    repeated = order.where("copies > 1").select("key", "tie")
    if not repeated.isEmpty():
        texts = texts.join(repeated, ["key", "tie"], "left_anti").unionByName(texts.join(repeated, ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.min("text").alias("text")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    asked = order.select(F.col("key").alias("to_key"), F.col("tie").alias("to_tie"), "copies", quarter.alias("m"), F.col("next_key").alias("key"), F.col("next_tie").alias("tie"))
    heads = texts.join(asked, ["key", "tie"]).select(F.col("to_key").alias("key"), F.col("to_tie").alias("tie"), "copies", "m", F.col("key").alias("next_key"), F.col("tie").alias("next_tie"), F.substring("text", F.lit(1), F.col("m")).alias("head"))
    pairs = texts.join(heads, ["key", "tie"])
    # of equal rows all but the last are followed by their equal
    last = F.struct(F.lit(True).alias("last"), F.lit(1).cast("long").alias("times"), "head", "next_key", "next_tie")
    before = F.struct(F.lit(False).alias("last"), (F.col("copies") - 1).alias("times"), F.substring("text", F.lit(1), F.col("m")).alias("head"), F.col("key").alias("next_key"), F.col("tie").alias("next_tie"))
    cases = pairs.select("key", "tie", "m", "text", F.inline_outer(F.when(F.col("copies") > 1, F.array(last, before)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("m")), "head")
    by = ["key", "tie", "last", "times", "next_key", "next_tie", "n_chars", "edited_sha256"]
    made = cases.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = fingerprint_pairs(made, by, "text", "edited", samples)
    # a row meets the fingerprint of its next document where that one's key is
    row = F.struct("key", "times", "n_chars", "edited_sha256", "edited_fp")
    asks = F.struct(F.col("next_key").alias("at_key"), F.col("next_tie").alias("at_tie"), row.alias("row"), F.col("fp"))
    holds = F.struct(F.col("key").alias("at_key"), F.col("tie").alias("at_tie"), F.when(F.lit(False), row).alias("row"), F.col("fp"))
    sent = prints.select(F.inline_outer(F.when(F.col("last"), F.array(asks, holds)).otherwise(F.array(asks))))
    held = F.first(F.when(F.col("row").isNull(), F.col("fp")), ignorenulls=True).over(Window.partitionBy("at_key", "at_tie"))
    met = sent.withColumn("next_fp", held).where("row is not null").select("row.*", "fp", "next_fp")
    if not repeated.isEmpty():
        met = met.withColumn("times", F.explode_outer(F.sequence(F.lit(1).cast("long"), "times")))
    return met.select("key", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(key_to_id("key").alias("doc_id"), "n_chars", "edited_sha256", fingerprint_text(F.col("fp")).alias("fingerprint"), fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
