"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, linked exactly by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNSPACED, WordTable, char_blocks, distinct_texts, doc_key, key_to_id, materialize, mix64, shingle_hashes, text_blocks, text_tie, unused
from .components import connected_components
from .nearcopies import banded, link_groups, set_column, verified_pairs

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: A shard of the distributed tree holds about so many fingerprints at most; their own tree is in its task.
SHARD_ROWS = 65_536
#: Depth of the distributed tree, at least: one shard for small tables, and 32 from SPREAD_FROM fingerprints on.
SPREAD_FROM, SPREAD_DEPTH = 8_192, 5
#: The distributed tree is fitted on a bounded sample (never more than SAMPLE fingerprints); all are indexed.
SAMPLE, SAMPLE_PER_SHARD = 1 << 20, 256
LEAF = 256
#: Sketches of the check that can follow: one byte for each of BINS bins of the hashes of CHECK_WORDS-word shingles.
BINS, CHECK_WORDS = 256, 5


def simhash64(text: str | None, n: int = SHINGLE_WORDS, seed: int = SEED, distinct: bool = False) -> tuple[int, int]:
    """(unsigned fingerprint, number of shingles) of the word n-grams of an ASCII-lower-cased text.

    Shingles count as often as they occur, or once with ``distinct``. No words: (0, 0).
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0, 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[n - 1 :] if len(words) > n else ends[-1:]
    first = np.concatenate([[0], ends[: len(last) - 1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(last))
    h = np.unique(h) if distinct else h
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big"), len(h)


def fingerprint_column(text: Column, n: int = SHINGLE_WORDS, distinct: bool = False) -> Column:
    """Struct of the fingerprint as a signed long and the number of shingles, from an Arrow-batched UDF."""

    @F.pandas_udf("fp long, shingles long")
    def prints(texts: pd.Series) -> pd.DataFrame:
        found = [simhash64(t, n, SEED, distinct) for t in texts]
        return pd.DataFrame({"fp": np.array([x for x, _ in found], dtype=np.uint64).view(np.int64), "shingles": np.array([y for _, y in found], dtype=np.int64)})

    return prints(text)


def sketch_texts(texts: list[str | None], n: int = CHECK_WORDS) -> np.ndarray:
    """One-permutation MinHash sketches (a row of BINS bytes each) of the word n-grams of ASCII-lower-cased texts.

    A bin has the least hash that falls into it, as a byte from 1 on, or 0 if none does.
    """
    encoded = [(t or "").encode().lower() for t in texts]
    out = np.zeros((len(texts), BINS), dtype=np.uint8)
    none = np.uint64(2**64 - 1)
    for first, last in text_blocks(encoded):
        table = WordTable(encoded[first:last], UNSPACED)
        grams, owner = [], []
        if len(table.hash) >= n:
            h = shingle_hashes(table.hash, n)
            inside = table.text[: len(h)] == table.text[n - 1 :]
            grams.append(h[inside]), owner.append(table.text[: len(h)][inside])
        for k in np.flatnonzero((table.counts > 0) & (table.counts < n)):
            grams.append(shingle_hashes(table.hash[table.first[k] : table.first[k + 1]], n)), owner.append(np.array([k]))
        least = np.full((last - first) * BINS, none)
        for h, k in zip(grams, owner):
            np.minimum.at(least, k * BINS + (h % np.uint64(BINS)).astype(np.int64), h)
        marks = np.where(least == none, 0, 1 + (mix64(least) >> np.uint64(32)) % np.uint64(255))
        out[first:last] = marks.reshape(-1, BINS)
    return out


def sketch_column(text: Column) -> Column:
    @F.pandas_udf("binary")
    def sketches(texts: pd.Series) -> pd.Series:
        listed = texts.tolist()
        return pd.Series([s.tobytes() for a, b in char_blocks(listed) for s in sketch_texts(listed[a:b])], dtype=object)

    return sketches(text)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, row by row: equal bins by bins that either fills; two empty ones: 1."""
    empty = np.count_nonzero((x | y) == 0, axis=1)
    return np.where(empty == BINS, 1.0, (np.count_nonzero(x == y, axis=1) - empty) / np.maximum(1, BINS - empty))


# --- the tree ------------------------------------------------------------------------------------


def _distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _cut(points: np.ndarray, sizes: np.ndarray, radius: int, slack: float | None) -> tuple[int, float] | None:
    """(vantage point, distance of the cut) or (-1, size of the cut); None if no cut leaves a quarter on each side.

    With ``slack`` a cut by size comes first, as long as it leaves most points on one side only. Else it is the
    vantage point and distance that leave fewest points in the overlap.
    """
    if slack is not None and len(sizes):
        at = float(np.median(sizes))
        inside, both = int((sizes <= at).sum()), int((np.abs(sizes - at) <= slack).sum())
        if min(inside, len(sizes) - inside) * 4 >= len(sizes) and both * 2 <= len(sizes):
            return -1, at
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = _distances(points, v)
        middle = int(np.median(d))
        for c in (middle - 1, middle):
            inside = int((d <= c).sum())
            if min(inside, len(points) - inside) * 4 >= len(points):
                near = int((np.abs(d.astype(np.int16) - c) <= radius).sum())
                if best is None or near < best[0]:
                    best = (near, int(v), c)
    return best and best[1:]


def _sides(points: np.ndarray, sizes: np.ndarray, cut: tuple[int, float], radius: int, slack: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point: is it inside, and may neighbours of it be inside or outside (by the triangle inequality)?"""
    v, c = cut
    at, reach = (sizes, slack) if v < 0 else (_distances(points, np.uint64(v)).astype(np.int16), radius)
    return at <= c, at - reach <= c, at + reach > c


def fit_tree(sample: np.ndarray, sizes: np.ndarray, depth: int, radius: int, slack: float | None = None) -> list[tuple]:
    """Nodes (cut, inner, outer), children before parents; a negative child -1-s is shard s.

    Shards are numbered from left to right. The last node is the root; no node means one shard.
    """
    nodes: list[tuple] = []
    shards = 0

    def grow(points: np.ndarray, sizes: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _cut(points, sizes, radius, slack) if left and len(points) >= 8 else None
        if not cut:
            shards += 1
            return -shards
        own, _, _ = _sides(points, sizes, cut, radius, slack)
        inner, outer = grow(points[own], sizes[own], left - 1), grow(points[~own], sizes[~own], left - 1)
        nodes.append((cut, inner, outer))
        return len(nodes) - 1

    grow(sample, sizes, depth)
    return nodes


def route(points: np.ndarray, sizes: np.ndarray, nodes: list[tuple], radius: int, slack: float | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard: the numbers of the points to send there and if it is their home.

    A point lies in one home. It also queries each shard that the triangle inequality leaves possible for
    its neighbours; only shards after its home, since the other of a pair visits the earlier.
    """
    stack = [(len(nodes) - 1 if nodes else -1, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        at, rows, home = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, home
            continue
        cut, inner, outer = nodes[at]
        own, may_in, may_out = _sides(points[rows], sizes[rows], cut, radius, slack)
        goes_in = np.where(home, own, may_in)
        stack.append((inner, rows[goes_in], home[goes_in]))
        stack.append((outer, rows[may_out], (home & ~own)[may_out]))


class Forest:
    """Union-find over 0..n-1 that keeps only joining edges."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for x, y in pairs.tolist():
            a, b = self.find(x), self.find(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((x, y))


def _leaf_classes(near: np.ndarray) -> np.ndarray:
    """A label for each point of a leaf, given who is near whom; points that are linked within the leaf share it."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def link_shard(points: np.ndarray, sizes: np.ndarray, homes: int, radius: int = RADIUS, slack: float | None = None, sketches: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Edges (pairs of row numbers) that span all links of the first ``homes`` points with all points.

    A tree over the home points prunes branches by the triangle inequality. In a leaf a query gets one edge for
    each class of linked home points, so a dense group gives no edge for each of its pairs. With ``sketches``
    points are linked only if these are alike by ``least``.
    """

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius
        if slack is not None:
            close &= np.abs(sizes[a][:, None] - sizes[b][None, :]) <= slack
        if sketches is not None:
            rows, columns = np.nonzero(close)
            for k in range(0, len(rows), 1 << 13):
                r, c = rows[k : k + (1 << 13)], columns[k : k + (1 << 13)]
                apart = alike(sketches[a[r]], sketches[b[c]]) < least
                close[r[apart], c[apart]] = False
        return close

    forest = Forest(len(points))
    stack = [(np.arange(homes), np.arange(len(points)))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        few = own[:: max(1, len(own) // 512)]
        cut = _cut(points[few], sizes[few], radius, slack) if len(own) > LEAF else None
        if cut:
            inside, _, _ = _sides(points[own], sizes[own], cut, radius, slack)
            _, may_in, may_out = _sides(points[ask], sizes[ask], cut, radius, slack)
            if cut[0] < 0 or 8 * (may_in.sum() + may_out.sum()) <= 15 * len(ask) or len(own) > 4 * LEAF:
                stack += [(own[inside], ask[may_in]), (own[~inside], ask[may_out])]
                continue
        for k in range(0, len(own), 4 * LEAF):
            part = own[k : k + 4 * LEAF]
            label = _leaf_classes(near(part, part))
            order = np.argsort(label, kind="stable")
            part, label = part[order], label[order]
            begins = np.flatnonzero(np.diff(label, prepend=-1))
            leader = np.repeat(part[begins], np.diff([*begins, len(part)]))
            forest.join(np.stack([leader, part], axis=1)[leader != part])
            for j in range(0, len(ask), 1024):
                some = ask[j : j + 1024]
                rows, columns = np.nonzero(near(some, part))
                if len(rows):
                    classes = np.searchsorted(begins, columns, side="right") - 1
                    pair = np.unique(np.stack([some[rows], part[begins[classes]]], axis=1), axis=0)
                    forest.join(pair[pair[:, 0] != pair[:, 1]])
    return forest.edges


# --- the operator --------------------------------------------------------------------------------


def link_classes(classes: DataFrame, radius: int = RADIUS, slack: float | None = None, least: float = 0.0) -> DataFrame:
    """Edges (a, b) between ids whose classes (id, fp, size, sketch) have fingerprints within ``radius`` bits.

    With ``slack`` their sizes must differ by it at most, with ``least`` over 0 their sketches must be as much
    alike. The edges span every component of such links; no
    link is lost and copies give none.
    """
    n = classes.count()
    depth = 0 if n < SPREAD_FROM else max(SPREAD_DEPTH, int(np.ceil(np.log2(n / SHARD_ROWS))))
    wanted = min(SAMPLE, SAMPLE_PER_SHARD << depth) if depth else 0
    some = F.pmod(F.xxhash64("fp"), F.lit(max(1, n // max(1, wanted)))) == 0
    sample = classes.where(some).select("fp", "size").limit(2 * wanted).toPandas().sort_values(["fp", "size"])
    nodes = fit_tree(sample["fp"].to_numpy(dtype=np.int64).view(np.uint64), sample["size"].to_numpy(dtype=np.float64), depth, radius, slack)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, fps, sizes, sketches = pdf["id"].to_numpy(), pdf["fp"].to_numpy(), pdf["size"].to_numpy(), pdf["sketch"].to_numpy()
            for shard, rows, home in route(fps.view(np.uint64), sizes, nodes, radius, slack):
                yield pd.DataFrame({"shard": shard, "id": ids[rows], "fp": fps[rows], "size": sizes[rows], "sketch": sketches[rows], "home": home})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "fp"], ascending=[False, True])
        ids = pdf["id"].to_numpy()
        sketches = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(-1, BINS) if least else None
        edges = link_shard(pdf["fp"].to_numpy().view(np.uint64), pdf["size"].to_numpy(), int(pdf["home"].sum()), radius, slack, sketches, least)
        a, b = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    sent = classes.mapInPandas(send, "shard int, id long, fp long, size double, sketch binary, home boolean")
    return sent.groupBy("shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE_WORDS, distinct: bool = False, similarity: float | None = None, least: float = 0.0) -> DataFrame:
    """Rows (key, fp, component) for every row of ``docs`` (doc_id, text).

    Fingerprints within ``radius`` bits are linked; ``component`` is the smallest key reachable. Equal
    fingerprints are grouped first, so a group of copies of any size is one point of the tree, and a table
    of ids is all that is shuffled. Texts without words have fingerprint zero and are linked like others.
    Rows that repeat a doc_id keep their own fingerprint each; such rows may tie their components together.

    With ``similarity`` texts whose numbers of shingles lie further apart than this ratio are not linked:
    sets of such sizes cannot have that Jaccard similarity, and the tree prunes by size too. With ``least`` texts
    are linked only if the sketches of their five-word shingles are alike by it.
    """
    slack = None if similarity is None else float(np.log(1 / similarity)) + 1e-9
    size = F.lit(0.0) if slack is None else F.log(F.greatest("p.shingles", F.lit(1)).cast("double"))
    sketch = sketch_column(F.col("text")) if least else F.lit(b"")
    texts = docs.select(doc_key().alias("key"), fingerprint_column(F.col("text"), n, distinct).alias("p"), sketch.alias("sketch"))
    prints = materialize(texts.select("key", "p.fp", size.alias("size"), "sketch", F.xxhash64("sketch").alias("print")), "simhash")
    # a row of a class goes by the hash of its sketch; only one sketch of the class is shuffled on
    same = ["fp", "size", "print"]
    classes = materialize(prints.groupBy(*same).agg(F.min("key").alias("id"), F.min("sketch").alias("sketch")), "classes")
    found = connected_components(link_classes(classes.drop("print"), radius, slack, least), "a", "b")
    owned = classes.join(found, classes.id == found.node, "left").select(*same, F.coalesce("component", "id").alias("component"))
    return prints.join(owned, same).select("key", "fp", "component")


def hex_fingerprint(c: str) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


#: Near copies have a Jaccard similarity of five-word shingles of COPY_SIMILARITY or more. The trees search the
#: fingerprints of the sets of word pairs within COPY_RADIUS bits, which misses many such pairs; the MinHash bands of
#: ``nearcopies`` miss one in 5,000 at most. Every link is verified by the exact sets.
COPY_WORDS, COPY_RADIUS, COPY_SIMILARITY = 2, 8, 0.8
#: Pairs of the trees go to the exact check only if their sketches are alike by this. Their standard error at a
#: similarity of 0.8 is at most 0.025 (less for texts of few shingles), so the bound stands a little below.
COPY_ALIKE = 0.77


def near_copies(docs: DataFrame, radius: int = COPY_RADIUS, n: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """Rows (key, tie, component, keeper) for every row of ``docs`` (doc_id, text).

    Links are the pairs of texts whose five-word shingles have this exact Jaccard similarity, as far as bands or
    trees retrieve them. A text's component follows from the text alone, so rows that repeat a doc_id, or have none, are
    told apart by ``tie``, the MD5 of the text. Texts of equal shingle sets are one class, and texts without words are
    alike. ``component`` is the smallest key of all texts reachable, ``keeper`` marks the row of least (key, tie).
    """
    text = F.col("text")
    found = docs.select(doc_key().alias("key"), text_tie().alias("tie"), fingerprint_column(text, n, True).alias("p"), sketch_column(text).alias("sketch"), set_column(text).alias("s"))
    prints = materialize(found.select("key", "tie", "p.fp", "sketch", "s.print", "s.n", "s.bands"), "copies")
    same = ["print", "n"]
    grouped = prints.groupBy(*same).agg(F.min(F.struct("key", "tie")).alias("rep"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands"))
    classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    sized = classes.select("id", "fp", F.log(F.greatest("n", F.lit(1)).cast("double")).alias("size"), "sketch")
    pairs = materialize(link_classes(sized, radius, float(np.log(1 / similarity)) + 1e-9, COPY_ALIKE).where("a != b"), "pairs")
    groups = materialize(banded(classes), "groups")
    # only texts that have a candidate are read on
    asked = groups.select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = classes.join(asked, "id", "left_semi").select("id", "rep.key", "rep.tie")
    texts = materialize(distinct_texts(docs, prints).join(wanted, ["key", "tie"]).select("id", "text"), "texts")
    links = link_groups(groups, texts, similarity).unionByName(verified_pairs(pairs, texts, similarity))
    joined = connected_components(links, "a", "b")
    placed = classes.join(joined, classes.id == joined.node, "left").select(*same, "rep", F.coalesce("component", "id").alias("_component"))
    best = placed.groupBy("_component").agg(F.min("rep").alias("best"))
    owned = placed.join(best, "_component").select(*same, "best")
    return prints.select("key", "tie", *same).join(owned, same).select("key", "tie", F.col("best.key").alias("component"), (F.struct("key", "tie") == F.col("best")).alias("keeper"))


def keep_one_of_each(docs: DataFrame, radius: int = COPY_RADIUS, n: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of the smallest doc_id.

    Of rows of this doc_id it is the one of the least MD5 of the text. Rows are told apart by doc_id and text, so
    different texts under one doc_id or without any are documents of their own; only of rows with equal doc_id and equal
    text the least one, by the JSON of all columns, stays. All columns are kept.
    """
    key, tie = unused(docs, "_cw_key"), unused(docs, "_cw_tie")
    found = materialize(near_copies(docs, radius, n, similarity), "kept")
    gone = found.where("not keeper").select(F.col("key").alias(key), F.col("tie").alias(tie)).distinct()
    rest = docs.withColumns({key: doc_key(), tie: text_tie()}).join(gone, [key, tie], "left_anti")
    repeated = found.where("keeper").groupBy(F.col("key").alias(key), F.col("tie").alias(tie)).agg(F.count("*").alias("n")).where("n > 1").select(key, tie)
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = rest.join(repeated, [key, tie], "left_semi").groupBy(key, tie).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_row")).select("_row.*")
        return rest.join(repeated, [key, tie], "left_anti").drop(key, tie).unionByName(one)
    return rest.drop(key, tie)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for all of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(key_to_id("key").alias("doc_id"), hex_fingerprint("fp").alias("fingerprint"), key_to_id("component").alias("component_id"))
