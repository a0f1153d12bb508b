"""Near copies by the exact Jaccard similarity of five-word shingles: MinHash bands and SimHash trees retrieve, sets verify."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, WordTable, char_blocks, materialize, mix64, shingle_hashes, text_blocks

SHINGLE = 5
#: Two sets of Jaccard similarity J share a band of ROWS minima with probability J^ROWS, whatever the edit is, so
#: a pair of J = 0.8 is missed by all BANDS with probability (1 - 0.8^3)^12 < 0.0002.
BANDS, ROWS = 12, 3
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
#: A task holds about so many shingles of one slice of a bucket, and twice as many of two slices or of one very long text.
SLICE = 1 << 17


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of ASCII-lower-cased texts; fewer words give one of all."""
    encoded = [(t or "").encode().lower() for t in texts]
    out = []
    for first, last in text_blocks(encoded):
        table = WordTable(encoded[first:last], UNSPACED)
        out += [np.unique(shingle_hashes(table.hash[table.first[k] : table.first[k + 1]], SHINGLE)) for k in range(last - first)]
    return out


def band_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each band of a set; an empty set has none."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(SEEDS), 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(h), 1 << 12):
        np.minimum(least, mix64(h[None, k : k + (1 << 12)] ^ SEEDS[:, None]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(BANDS, ROWS).T:
            out = mix64(out * np.uint64(0x100000001B3) + column)
    return out.view(np.int64)


def set_column(text: Column) -> Column:
    """Struct (print, n, bands): a hash of the shingle set, its size and its bands."""

    @F.pandas_udf("print long, n long, bands array<long>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        listed, marks, sizes, bands = texts.tolist(), [], [], []
        # sets are made and forgotten by blocks of texts
        for a, b in char_blocks(listed):
            for h in shingle_sets(listed[a:b]):
                with np.errstate(over="ignore"):
                    marks.append(int(mix64(np.array([mix64(h).sum(dtype=np.uint64) ^ np.uint64(len(h))]))[0]))
                sizes.append(len(h))
                bands.append(band_hashes(h))
        return pd.DataFrame({"print": np.array(marks, dtype=np.uint64).view(np.int64), "n": sizes, "bands": bands})

    return prints(text)


def link_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (pairs of numbers) that span all links, which are the pairs of that exact Jaccard similarity or more.

    Each set found asks only those not found yet: a group of n near copies costs about n comparisons.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    inside = np.zeros(len(term) + 1, dtype=bool)
    left, edges, asked, owner = np.ones(len(sets), dtype=bool), [], term, np.repeat(np.arange(len(sets)), sizes)
    for k in range(len(sets)):
        queue = [k] if left[k] else []
        left[k] = False
        while queue:
            x = queue.pop()
            own = term[begins[x] : begins[x + 1]]
            inside[own] = True
            both = np.bincount(owner[inside[asked]], minlength=len(sets))
            inside[own] = False
            near = np.flatnonzero(left & (both >= similarity * (sizes[x] + sizes - both) - 1e-9))
            left[near] = False
            edges += [(x, int(y)) for y in near]
            queue += near.tolist()
            if left[owner].sum() * 2 < len(owner):
                asked, owner = asked[left[owner]], owner[left[owner]]
    return edges


def any_link(asking: list[np.ndarray], held: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """For each asking set that is similar to one of the held sets, its number and that of one of these."""
    if not asking or not held:
        return []
    sizes = np.array([len(s) for s in held], dtype=np.int64)
    terms = np.concatenate(held)
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], np.repeat(np.arange(len(held)), sizes)[order]
    out = []
    for k, own in enumerate(asking):
        low, high = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(held))
        near = np.flatnonzero(both >= similarity * (sizes + len(own) - both) - 1e-9)
        if len(near):
            out.append((k, int(near[0])))
    return out


def distances(sets: list[np.ndarray], to: np.ndarray) -> np.ndarray:
    """Jaccard distances of sets to one set."""
    both = np.array([len(np.intersect1d(s, to, assume_unique=True)) for s in sets], dtype=np.float64)
    union = np.array([len(s) + len(to) for s in sets], dtype=np.float64) - both
    return 1 - both / np.maximum(1, union)


def banded(classes: DataFrame) -> DataFrame:
    """Rows (bucket, id, n, leader, slices) of classes (id, print, n, bands) that share a band; a large bucket has several slices and its least id as leader."""
    rows = classes.select("id", "print", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id", "print")).alias("members"), F.sum("n").alias("weight"), F.min("id").alias("leader")).where("m > 1")
    # bands that hold the same classes are one group
    groups = shared.groupBy("m", "members").agg(F.min("bucket").alias("bucket"), F.first("weight").alias("weight"), F.first("leader").alias("leader"))
    return rows.select("bucket", "id", "n").join(groups.select("bucket", "leader", F.ceil(F.col("weight") / SLICE).cast("int").alias("slices")), "bucket")


def _slice(slices: Column) -> Column:
    return F.pmod(F.xxhash64("id"), slices).cast("int")


def link_groups(groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that span the links within each group of :func:`banded`, by the exact sets of ``texts`` (id, text).

    A bucket of one slice is linked in one task. Of a larger one each member is first measured against its leader, slice by slice, and those that are similar to it are one
    component. By the triangle inequality of the Jaccard distance only members just beyond can be similar to one of these, and one such link is enough; members beyond
    are compared with each other in pairs of slices. So a bucket of copies of one page sends each text once, and all links are found.
    """
    reach = 1 - similarity + 1e-9
    own = groups.select("bucket", "id", "leader", "slices", _slice(F.col("slices")).alias("part"), F.lit(False).alias("lead"))
    leaders = groups.where("slices > 1").select("bucket", "leader", "slices").distinct()
    copies = leaders.select("bucket", F.col("leader").alias("id"), "leader", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.lit(True).alias("lead"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, ids, sets = pdf["bucket"].iloc[0], pdf["id"].to_numpy(), shingle_sets(pdf["text"].tolist())
        if pdf["slices"].iloc[0] == 1:
            a, b = np.array(link_sets(sets, similarity), dtype=np.int64).reshape(-1, 2).T
            return pd.DataFrame({"bucket": bucket, "a": ids[a], "b": ids[b], "apart": 0.0, "hot": False})
        lead = np.flatnonzero(pdf["lead"].to_numpy(dtype=bool))
        rest = np.setdiff1d(np.flatnonzero(ids != ids[lead[0]]), lead)
        return pd.DataFrame({"bucket": bucket, "a": ids[rest], "b": ids[lead[0]], "apart": distances([sets[k] for k in rest], sets[lead[0]]), "hot": True})

    measured = materialize(own.unionByName(copies).join(texts, "id").groupBy("bucket", "part").applyInPandas(first, "bucket long, a long, b long, apart double, hot boolean"), "measured")
    links = measured.where(~F.col("hot") | (F.col("apart") <= reach)).select("a", "b")
    hot = measured.where("hot").select("bucket", F.col("a").alias("id"), "apart").join(groups.select("bucket", "id", "n"), ["bucket", "id"])
    outer = hot.where(F.col("apart") > reach)
    if outer.isEmpty():
        return links
    edge = outer.where(F.col("apart") <= 2 * reach)
    near = edge.groupBy("bucket").agg(F.ceil(F.sum("n") / SLICE).cast("int").alias("others"), (F.min("apart") - reach).alias("least"))
    inner = hot.where(F.col("apart") <= reach).join(near, "bucket").where(F.col("apart") >= F.col("least"))
    inner_parts = inner.groupBy("bucket").agg(F.ceil(F.sum("n") / SLICE).cast("int").alias("slices"))
    all_parts = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row = lambda kind, i, j, asks: [F.lit(kind).alias("kind"), "bucket", i.alias("i"), j.alias("j"), "id", F.lit(asks).alias("asks")]
    sided = inner.join(inner_parts, "bucket").withColumn("i", _slice(F.col("slices"))).select("bucket", "id", "i", all_parts("others").alias("j")).select(*row(0, F.col("i"), F.col("j"), False))
    edged = edge.join(near.select("bucket", "others"), "bucket").join(inner_parts, "bucket").withColumn("j", _slice(F.col("others"))).select("bucket", "id", "j", all_parts("slices").alias("i")).select(*row(0, F.col("i"), F.col("j"), True))
    parts = outer.groupBy("bucket").agg(F.ceil(F.sum("n") / SLICE).cast("int").alias("slices"))
    beyond = outer.join(parts, "bucket").withColumn("own", _slice(F.col("slices")))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: (F.col("slices") == 1) | (s != F.col("own"))))
    paired = beyond.select("bucket", "id", "own", other.alias("other")).select(*row(1, F.least("own", "other"), F.greatest("own", "other"), True))

    def then(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets, asks = pdf["id"].to_numpy(), shingle_sets(pdf["text"].tolist()), pdf["asks"].to_numpy(dtype=bool)
        if pdf["kind"].iloc[0] == 1:
            a, b = np.array(link_sets(sets, similarity), dtype=np.int64).reshape(-1, 2).T
            return pd.DataFrame({"a": ids[a], "b": ids[b]})
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = np.array(any_link([sets[k] for k in left], [sets[k] for k in right], similarity), dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": ids[left[a]], "b": ids[right[b]]})

    rest = sided.unionByName(edged).unionByName(paired).join(texts, "id").groupBy("kind", "bucket", "i", "j").applyInPandas(then, "a long, b long")
    return links.unionByName(rest)


def verified_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``texts`` (id, text) have this exact similarity."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(link_sets(s, similarity)) for s in zip(shingle_sets(x.tolist()), shingle_sets(y.tolist()))], dtype=bool)

    one, other = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(other, "b").where(similar("x", "y")).select("a", "b")
