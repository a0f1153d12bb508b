"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_blocks, mix64, unused

#: Lengths of the n-grams, in code points of the lower-cased text; their hashes have BITS bits.
GRAMS, BITS = (3, 4, 5), 20
#: Code points of one block of texts (or one text).
BLOCK = 1 << 19
#: The fit takes at most so many labelled documents of each class (those of the smallest hashes).
SAMPLE_PER_CLASS = 1_500
#: An n-gram of the fit occurs in at least MIN_DF of these documents; the FEATURES of largest weight of evidence stay.
MIN_DF, FEATURES = 4, 2_000
#: Penalties and steps of the logistic regression.
L1, L2, STEPS = 2e-4, 1e-6, 200
THRESHOLD = 0.7
#: Characters that count as a boundary of words: everything ASCII but letters and digits.
_SPACED = np.arange(128, dtype=np.uint32)
_SPACED[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _present(texts: list[str | None], of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text number, hashed n-gram) without repeats, of whole texts; only n-grams marked in ``of``.

    Texts are encoded and read in blocks, so that memory is that of the pairs and of one block.
    """
    owners, grams = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
    for first, last in char_blocks(texts, BLOCK):
        encoded = [f" {(t or '').lower()} ".encode("utf-32-le") for t in texts[first:last]]
        raw = np.frombuffer(b"".join(encoded), dtype=np.uint32)
        raw = np.where(raw < 128, _SPACED[np.minimum(raw, 127)], raw).astype(np.uint64)
        limits = np.cumsum([len(t) // 4 for t in encoded])
        gram, pairs = raw + np.uint64(1), []
        for n in range(2, max(GRAMS) + 1):
            with np.errstate(over="ignore"):
                gram = gram[: len(raw) - n + 1] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                bucket = (mix64(gram) >> np.uint64(64 - BITS)).astype(np.int64)
                at = np.arange(len(bucket)) if of is None else np.flatnonzero(of[bucket])
                owner = np.searchsorted(limits, at, side="right")
                whole = at + n <= limits[owner]
                pairs.append((owner[whole] << BITS) | bucket[at[whole]])
        found = np.unique(np.concatenate(pairs))
        owners.append(((found >> BITS) + first).astype(np.int32))
        grams.append((found & ((1 << BITS) - 1)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(grams)


def fit_classifier(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-grams, weights, intercept): logistic regression on the presence of n-grams times their log-count ratio.

    Classes weigh alike, so the score does not depend on their shares in the sample. Without both classes the
    score is one half for every text.
    """
    toxic = np.asarray(toxic, dtype=np.float64)
    n_pos, n_neg = toxic.sum(), len(toxic) - toxic.sum()
    if not n_pos or not n_neg:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    owner, gram = _present(texts)
    pos = np.bincount(gram[(toxic > 0)[owner]], minlength=1 << BITS).astype(np.float64)
    both = np.bincount(gram, minlength=1 << BITS)
    neg = both - pos
    ratio = np.log((pos + 0.5) / (n_pos + 1.0)) - np.log((neg + 0.5) / (n_neg + 1.0))
    evidence = np.abs((pos + 0.5) / (n_pos + 1.0) - (neg + 0.5) / (n_neg + 1.0)) * np.abs(ratio)
    evidence[both < min(MIN_DF, len(texts))] = 0
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    chosen = chosen[evidence[chosen] > 0]
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    kept = column[gram] >= 0
    owner, col = owner[kept], column[gram[kept]]
    scale = ratio[chosen]
    value = scale[col]
    each = np.where(toxic > 0, 0.5 / n_pos, 0.5 / n_neg)
    w, b, back, back_b, pace = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0, 1.0
    norm = np.bincount(owner, weights=value**2, minlength=len(texts))
    step = 4.0 / (float((each * (norm + 1)).sum()) + 1e-12)
    for _ in range(STEPS):
        z = np.bincount(owner, weights=value * back[col], minlength=len(texts)) + back_b
        error = each * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - toxic)
        grad = np.bincount(col, weights=error[owner] * value, minlength=len(chosen)) + L2 * back
        moved = back - step * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
        new_b = back_b - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        back, back_b = new + (pace - 1) / after * (new - w), new_b + (pace - 1) / after * (new_b - b)
        w, b, pace = new, new_b, after
    used = np.flatnonzero(w)
    return chosen[used], (w * scale)[used], float(b)


def score_texts(texts: list[str | None], grams: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    table, mark = np.zeros(1 << BITS), np.zeros(1 << BITS, dtype=bool)
    table[grams], mark[grams] = weights, True
    owner, gram = _present(texts, mark)
    z = np.bincount(owner, weights=table[gram], minlength=len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


# --- the operator --------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the doc_id as text leaves 1 modulo 3. A null id is never in a fit either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Rows (doc_id, text, toxic): for each class the ``per_class`` labelled documents of the smallest id hashes.

    Labels that are null or not 0 or 1 are left out; a document with different labels counts once for each. Of rows
    that repeat a doc_id one of the least text counts, so the sample is bounded whatever repeats.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    usable = usable.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for c in (0, 1):
        some = usable.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(per_class).drop("h")
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier of :func:`fit_classifier`, fitted in one task on the bounded sample; only weights come back."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic", "text"])
        grams, weights, intercept = fit_classifier(pdf["text"].tolist(), pdf["toxic"].to_numpy())
        return pd.DataFrame({"gram": np.append(grams, -1), "weight": np.append(weights, intercept)})

    sample = training_sample(docs, labels, per_class).withColumn("one", F.lit(1))
    model = sample.groupBy("one").applyInPandas(fit, "gram long, weight double").toPandas().sort_values("gram")
    if model.empty:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    return model["gram"].to_numpy()[1:], model["weight"].to_numpy()[1:], float(model["weight"].iloc[0])


def toxicity_score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """Score from 0 to 1 of a whole text, from an Arrow-batched UDF; the model has at most FEATURES weights."""
    grams, weights, intercept = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), grams, weights, intercept))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the columns held_out, score and predicted, which replace columns of these names.

    The score depends on the text alone (null and empty texts have the intercept's score). Rows that repeat
    have equal scores.
    """
    scored = docs.withColumn("score", toxicity_score(F.col("text"), train(docs, labels)))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns."""
    score = unused(docs, "_cw_score")
    return docs.withColumn(score, toxicity_score(F.col("text"), train(docs, labels))).where(F.col(score) < THRESHOLD).drop(score)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
