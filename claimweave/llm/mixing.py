"""Mixing sources to target weights by nested hash thresholds, without a sort of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: A hash has 60 bits; each pass looks at STEP of them.
HASH_BITS, STEP = 60, 10
#: Steps by which the part of a source that is taken once more is filled up. No size is over NO_CAP.
ROUNDS, NO_CAP = 3, 1 << 62
STEPS_TYPE = "array<struct<least:long,below:long,most:long>>"
#: A plan of so many sources at most is broadcast: about 20 MB.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on the doc_id alone; without one on the text, so rows without ids are not taken or left all together."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> dict:
    """Target of each source: sources by code point, null last, weigh ``weights`` in turn.

    Targets share the sum of all sizes by weight. None exceeds ``most`` times its source's size; what is
    over goes to the others by weight, again and again until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, share, target = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] * share < rest * weight[s]:
            target[s] = float(most * sizes[s])
            rest, share = rest - most * sizes[s], share - weight[s]
    for s in order:
        if s not in target:
            target[s] = rest * weight[s] / share
    return target


def _thresholds(base: DataFrame, need: dict) -> dict:
    """For each source (the hash up to which (not with it) documents are taken, what is still needed then).

    ``base`` has source, size and h; ``need`` has positive numbers. Documents are taken as long as their sum is
    within the need. A pass sums sizes by source and the next STEP bits of the hash, within the boundary bucket of the pass before; it returns one row
    per source. Ends when each boundary bucket is a single hash.
    """
    spark = base.sparkSession
    limit: dict = {}
    state = {s: (0, n) for s, n in need.items()}  # prefix of the boundary bucket, what is still needed
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        if not state:
            break
        at = F.broadcast(spark.createDataFrame([(s, p, float(n)) for s, (p, n) in state.items()], "source string, prefix long, need double"))
        within = base.withColumn("prefix", F.shiftright("h", shift + STEP)).join(at, base.source.eqNullSafe(at.source) & (F.shiftright("h", shift + STEP) == at.prefix)).select(base.source, "h", "size", "need")
        sums = within.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("need").alias("need"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = F.col("upto") > F.col("need")
        found = sums.withColumn("upto", upto).groupBy("source").agg(F.min_by(F.when(over, F.struct("bucket", "size", "lo", "hi", "upto", "need")), F.when(over, F.col("bucket"))).alias("e"), F.max("upto").alias("all")).select("source", "all", "e.*").collect()
        left = {}
        for r in found:
            if r.bucket is None:
                limit[r.source] = (1 << HASH_BITS, state[r.source][1] - r["all"])
                continue
            need_now = r.need - (r.upto - r.size)
            if r.lo == r.hi:
                limit[r.source] = (r.lo, need_now)
            else:
                left[r.source] = (r.bucket, need_now)
        for s in state:
            if s not in left and s not in limit:
                limit[s] = (1 << HASH_BITS, state[s][1])
        state = left
    return limit


def plan_mix(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size, target, repeats, steps) that say how often a document is taken.

    Each document is taken ``repeats`` times, and once more if one of the ``steps`` (structs of least, below, most)
    holds: its hash is at least ``least`` and under ``below`` and its size at most ``most``. A step ends at the
    first document that would take more than is needed; the next step passes over it and over all others that are too
    large, and goes on with the following hashes. After ROUNDS such steps the one document left over that brings the sum
    nearest is taken, if any does.
    ``base`` has source, size and h. One row per source and step passes through the driver; documents do not.
    """
    sizes = {r.source: r.size for r in base.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = source_targets(sizes, weights, most)
    repeats = {s: int(targets[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    need = {s: targets[s] - repeats[s] * sizes[s] for s in sizes}
    least, steps = {s: 0 for s in sizes}, {s: [] for s in sizes}
    open_ = [s for s in sizes if need[s] > 0]
    for nth in range(ROUNDS):
        if not open_:
            break
        caps = {s: int(need[s]) if nth else NO_CAP for s in open_}
        at = F.broadcast(base.sparkSession.createDataFrame([(s, least[s], caps[s]) for s in open_], "source string, least long, most long"))
        fits = base.alias("b").join(at.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")) & (F.col("b.h") >= F.col("a.least")) & (F.col("b.size") <= F.col("a.most"))).select("b.source", "b.size", "b.h")
        for s, (below, left) in _thresholds(fits, {s: need[s] for s in open_}).items():
            steps[s].append((least[s], below, caps[s]))
            least[s], need[s] = below, left
        open_ = [s for s in open_ if need[s] > 0 and least[s] < 1 << HASH_BITS]
    short = {s: n for s, n in need.items() if n > 0}
    if short:
        at = F.broadcast(base.sparkSession.createDataFrame([(s, float(n), steps[s]) for s, n in short.items()], f"source string, need double, steps {STEPS_TYPE}"))
        rest = base.alias("b").join(at.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).where(times_taken(F.col("b.h"), F.col("b.size"), F.lit(0), F.col("a.steps")) == 0)
        single = rest.groupBy("b.source", "b.h").agg(F.sum("b.size").alias("size"), F.max("b.size").alias("most"), F.first("a.need").alias("need")).where("size < 2 * need and size > 0")
        for r in single.groupBy("source").agg(F.min_by(F.struct("h", "most"), F.struct(F.abs(F.col("size") - F.col("need")), "h")).alias("one")).collect():
            steps[r.source].append((r.one.h, r.one.h + 1, r.one.most))
    rows = [(s, sizes[s], targets[s], repeats[s], steps[s]) for s in sizes]
    return base.sparkSession.createDataFrame(rows, f"source string, source_size long, target double, repeats long, steps {STEPS_TYPE}")


def times_taken(h: Column, size: Column, repeats: Column, steps: Column) -> Column:
    more = F.exists(steps, lambda s: (h >= s["least"]) & (h < s["below"]) & (size <= s["most"]))
    return repeats + F.coalesce(more, F.lit(False)).cast("long")


def _with_plan(rows: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``plan``, which is broadcast: it has one row for each source, and at most BROADCAST_SOURCES.

    Of more sources, which are then no hot keys all together, the plan is joined by a shuffle.
    """
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, F.col(source).cast("string").eqNullSafe(F.col("_cw_source")))


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, source, text).

    Each document of a source is taken floor(target / source size) times, and those with the smallest hashes
    once more, as :func:`plan_mix` tells: a document that is too large for what is left is passed over.
    Texts without words have size 0. Rows that repeat a doc_id share a hash and are taken alike, and so do rows without one of equal texts. Reruns agree,
    whatever the order or partitioning of the rows.
    """
    base = materialize(_with_hash(docs), "mix")
    plan = plan_mix(base, weights, most).withColumnRenamed("source", "_cw_source")
    taken = F.col("size") * times_taken(F.col("h"), F.col("size"), F.col("repeats"), F.col("steps"))
    return _with_plan(base, "source", plan).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken; texts are not shuffled."""
    base = materialize(_with_hash(docs), "mix")
    plan = plan_mix(base, weights, most).select(F.col("source").alias("_cw_source"), "repeats", "steps")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_cw_row"), F.col("source").alias("_cw_from"), mix_hash(F.col("doc_id"), F.col("text")).alias("_cw_hash"), word_count(F.col("text")).alias("_cw_size"))
    times = times_taken(F.col("_cw_hash"), F.col("_cw_size"), F.col("repeats"), F.col("steps"))
    joined = _with_plan(rows, "_cw_from", plan).select("_cw_row", times.alias("times")).where("times > 0")
    return joined.select("_cw_row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth")).select("_cw_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM base GROUP BY source),
weighed AS (SELECT *, (nth - 1) % 3 + 1 AS w FROM src),
filled AS (
  SELECT *, sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         sum(s) OVER () AS total
  FROM weighed WINDOW o AS (ORDER BY 3 * s / w, nth)),
capped AS (SELECT *, 3 * s * share < (total - coalesce(before, 0)) * w AS capped FROM filled),
rest AS (
  SELECT max(total) - coalesce(sum(3 * s) FILTER (capped), 0) AS rest, sum(w) FILTER (NOT capped) AS share FROM capped),
targets AS (
  SELECT source, s, CASE WHEN capped THEN (3 * s)::DOUBLE ELSE (rest.rest * w)::DOUBLE / rest.share::DOUBLE END AS target
  FROM capped, rest),
needs AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s::DOUBLE) ELSE 0 END AS repeats,
         target - CASE WHEN s > 0 THEN floor(target / s::DOUBLE) ELSE 0 END * s::DOUBLE AS need FROM targets),
open0 AS (
  SELECT b.*, n.s, n.target, n.repeats, n.need AS left_, 0::BIGINT AS least, false AS more
  FROM base b JOIN needs n ON b.source IS NOT DISTINCT FROM n.source),
"""
for _k in range(1, ROUNDS + 1):
    _cap = NO_CAP if _k == 1 else "floor(left_)"
    OP7_SQL += f"""fit{_k} AS (
  SELECT source, h, any_value(left_) AS left_, sum(size) AS sz, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM open{_k - 1}
  WHERE left_ > 0 AND h >= least AND size <= {_cap} GROUP BY source, h),
cut{_k} AS (
  SELECT source, coalesce(min(h) FILTER (upto > left_), 1152921504606846976) AS below, coalesce(max(upto) FILTER (upto <= left_), 0) AS used, true AS hit
  FROM fit{_k} GROUP BY source),
open{_k} AS (
  SELECT o.* REPLACE (o.more OR (coalesce(c.hit, false) AND o.left_ > 0 AND o.h >= o.least AND o.h < c.below AND o.size <= {str(_cap).replace("left_", "o.left_")}) AS more,
                      o.left_ - coalesce(c.used, 0) AS left_, coalesce(c.below, o.least) AS least)
  FROM open{_k - 1} o LEFT JOIN cut{_k} c ON o.source IS NOT DISTINCT FROM c.source),
"""
OP7_SQL += f"""single AS (
  SELECT source, h, any_value(left_) AS left_, sum(size) AS sz FROM open{ROUNDS} WHERE NOT more AND left_ > 0 GROUP BY source, h),
pick AS (SELECT source, min_by(h, (abs(sz - left_), h)) AS h FROM single WHERE sz < 2 * left_ AND sz > 0 GROUP BY source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
       (size * (repeats + CASE WHEN more OR p.h IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM open{ROUNDS} o LEFT JOIN pick p ON o.source IS NOT DISTINCT FROM p.source AND o.h = p.h
"""
