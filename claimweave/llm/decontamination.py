"""Benchmark decontamination: BM25 with block-max WAND finds candidate items, then question and answer are compared."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORDS, WordTable, doc_key, key_to_id, materialize, shingle_hashes, text_blocks, unused

K1, B = 1.2, 0.75
#: Items are indexed in segments of SEGMENT words. A passage has 2 x SEGMENT words and starts every SEGMENT words,
#: so each segment that a document holds lies whole in one of its passages.
SEGMENT = 32
#: A passage retrieves the segments whose BM25 score is at least THRESHOLD of the segment's score by itself.
THRESHOLD = 0.6
#: Verification: shares of the question's shingles of SHINGLE words, and of the answer's words.
SHINGLE, QUESTION_SHARE, ANSWER_SHARE = 5, 0.8, 0.8
#: Segments of a block of the postings. Bytes of item text in a part of the index, and of index in one pass over the documents.
BLOCK, PART_BYTES, PASS_BYTES = 4, 1 << 20, 128 << 20
#: Score bounds (of a passage on a block) that are held at a time.
CELLS = 1 << 22


def _hashes(text: str | None) -> np.ndarray:
    return WordTable([(text or "").lower().encode()], PLAIN_WORDS).hash


@dataclass
class Item:
    """A test item as hashes: its words, the different shingles of its question and the different words of its answer."""

    item_id: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


def split_item(item_id: int, text: str | None) -> Item:
    """The last quarter of the words (one at least) is the answer, the rest the question."""
    h = _hashes(text)
    cut = len(h) - max(1, len(h) // 4) if len(h) > 1 else len(h)
    return Item(item_id, h, np.unique(shingle_hashes(h[:cut], SHINGLE)), np.unique(h[cut:]))


def segments(h: np.ndarray) -> list[np.ndarray]:
    """Runs of SEGMENT words; a short rest at an item's end is found with the segment before it."""
    parts = [h[s : s + SEGMENT] for s in range(0, len(h), SEGMENT)]
    return [p for k, p in enumerate(parts) if k == 0 or len(p) * 4 >= SEGMENT]


def shares(item: Item, region: np.ndarray) -> tuple[float, float]:
    """Shares of the item's question (by shingles, or whole if it is shorter) and answer (by words) in a run of words."""
    n = min(SHINGLE, len(item.words) - len(item.answer)) if len(item.question) == 1 else SHINGLE
    grams = shingle_hashes(region, max(1, n)) if len(region) >= n else region[:0]
    question = np.isin(item.question, grams).mean() if len(item.question) else 1.0
    return float(question), float(np.isin(item.answer, region).mean()) if len(item.answer) else 1.0


class BlockMaxIndex:
    """Inverted index of item segments: postings (segment, impact) by term, and the largest impact by term and block.

    ``frequency`` (term, number of segments) and ``n`` and ``average`` (number and mean length of segments) are those
    of the whole benchmark. Impacts are shares of the segment's score by itself. All arrays are linear in the words of the items.
    """

    def __init__(self, items: list[Item], terms: np.ndarray, frequency: np.ndarray, n: int, average: float):
        self.items = items
        parts = [(k, p) for k, it in enumerate(items) for p in segments(it.words)]
        self.owner = np.array([k for k, _ in parts], dtype=np.int64)
        order = np.argsort(terms)
        self.terms, frequency = terms[order], frequency[order]
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        posts = []
        for s, (_, p) in enumerate(parts):
            t, tf = np.unique(p, return_counts=True)
            at = np.searchsorted(self.terms, t)
            score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / average))
            posts.append((at, np.full(len(at), s), score / score.sum()))
        at, segment, impact = (np.concatenate([x[k] for x in posts]) if posts else np.zeros(0) for k in range(3))
        order = np.lexsort((segment, at))
        self.segment, self.impact, at = segment[order].astype(np.int32), impact[order].astype(np.float32), at[order].astype(np.int64)
        self.first = np.searchsorted(at, np.arange(len(self.terms) + 1))
        self.blocks = -(-len(parts) // BLOCK)
        cell = at * self.blocks + self.segment // BLOCK
        begins = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.zeros(0, dtype=np.int64)
        self.cell, self.cell_first = cell[begins], np.append(begins, len(cell))
        self.block, self.block_max = (self.segment[begins] // BLOCK).astype(np.int32), np.maximum.reduceat(self.impact, begins) if len(begins) else self.impact
        self.block_first = np.searchsorted(at[begins], np.arange(len(self.terms) + 1))
        # terms of many segments weigh little, and a passage repeats them: their share of a bound is capped by the most that a segment of the block has of them
        self.frequent = frequency > max(4, n // 12)
        common = np.zeros(len(parts))
        held = self.frequent[at] if len(at) else np.zeros(0, dtype=bool)
        np.add.at(common, self.segment[held], self.impact[held])
        self.slack = np.maximum.reduceat(common, np.arange(0, len(parts), BLOCK)) if len(parts) else common
        # a table by the hash's leading bits says which term a word can be
        self.bits = max(8, int(np.ceil(np.log2(len(self.terms) + 1))) + 4)
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[(self.terms >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def term_numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of the term of each word hash, -1 for none."""
        out = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        found = np.searchsorted(self.terms, h[at])
        same = self.terms[np.minimum(found, len(self.terms) - 1)] == h[at]
        out[at[same]] = found[same]
        return out

    def wand(self, terms: np.ndarray, block: int) -> list[int]:
        """Segments of a block whose score for a passage of these terms is at least THRESHOLD.

        Cursors are kept in order of their next segment. The pivot is the first cursor up to which the maxima reach the
        threshold; no segment before its own can. If the first cursor stands there too, the segment is scored in full,
        else the cursors before the pivot move up to it.
        """
        wanted = terms * self.blocks + block
        at = np.searchsorted(self.cell, wanted)
        at = at[self.cell[np.minimum(at, len(self.cell) - 1)] == wanted]
        cursors = []
        for lo, hi, most in zip(self.cell_first[at].tolist(), self.cell_first[at + 1].tolist(), self.block_max[at].tolist()):
            own = self.segment[lo:hi].tolist()
            cursors.append([own[0], 0, own, self.impact[lo:hi].tolist(), most])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[4]
                if bound >= THRESHOLD - 1e-5:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(c[3][c[1]] for c in cursors if c[0] == pivot)
                if score >= THRESHOLD - 1e-5:
                    out.append(pivot)
                pivot += 1
            for c in cursors:
                while c[1] < len(c[2]) and c[2][c[1]] < pivot:
                    c[1] += 1
                c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def candidates(self, table: WordTable) -> set[tuple[int, int, int]]:
        """Triples (text number, passage of the text, item number) for which the passage scores THRESHOLD on a segment of the item.

        A block of segments is opened for a passage if the sum of its terms' block maxima can reach the threshold.
        """
        if not len(self.terms) or not len(table.hash):
            return set()
        term = self.term_numbers(table.hash)
        chunks = -(-np.maximum(table.counts, 1) // SEGMENT) + 1  # one empty chunk parts the texts
        base = np.concatenate([[0], np.cumsum(chunks)])
        chunk = base[table.text] + table.position // SEGMENT
        known = np.flatnonzero(term >= 0)
        pair = np.unique(chunk[known] * len(self.terms) + term[known])
        at_chunk, t = pair // len(self.terms), pair % len(self.terms)
        fan = self.block_first[t + 1] - self.block_first[t]
        post = np.repeat(self.block_first[t] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum()) if len(t) else np.zeros(0, dtype=np.int64)
        at_chunk, common = np.repeat(at_chunk, fan), np.repeat(self.frequent[t], fan)
        # bounds of runs of passages at a time, so that they take CELLS numbers at most (or those of one passage)
        slab, opened = max(1, CELLS // self.blocks), []
        for low in range(0, int(base[-1]), slab):
            some = slice(*np.searchsorted(at_chunk, [low, low + slab + 1]))
            cell = (at_chunk[some] - low) * self.blocks + self.block[post[some]]
            most, size = self.block_max[post[some]], (min(slab, int(base[-1]) - low) + 1) * self.blocks
            rare, often = (np.bincount(cell[c], weights=most[c], minlength=size).reshape(-1, self.blocks) for c in (~common[some], common[some]))
            rows, columns = np.nonzero(rare[:-1] + rare[1:] + np.minimum(often[:-1] + often[1:], self.slack) >= THRESHOLD - 1e-5)
            opened.append((rows + low) * self.blocks + columns)
        opened = np.concatenate(opened)
        out = set()
        starts = np.searchsorted(chunk, np.arange(base[-1] + 3))
        text_of = np.repeat(np.arange(len(chunks)), chunks)
        last, terms = -1, None
        for c in opened.tolist():
            p, b = divmod(c, self.blocks)
            if p != last:
                terms, last = np.unique(term[starts[p] : starts[min(p + 2, base[-1])]]), p
                terms = terms[terms >= 0]
            for s in self.wand(terms, b):
                out.add((int(text_of[p]), p - int(base[text_of[p]]), int(self.owner[s])))
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(text number, item_id, question share, answer share) of the items that a passage and its surroundings hold."""
        encoded = [(t or "").lower().encode() for t in texts]
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for first, last in text_blocks(encoded):
            table = WordTable(encoded[first:last], PLAIN_WORDS)
            for text, passage, k in self.candidates(table):
                item, begin, end = self.items[k], table.first[text], table.first[text + 1]
                at = begin + passage * SEGMENT
                found = shares(item, table.hash[max(begin, at - len(item.words)) : min(end, at + 2 * SEGMENT + len(item.words))])
                if found[0] >= QUESTION_SHARE and found[1] >= ANSWER_SHARE:
                    best[first + text, k] = max(best.get((first + text, k), (0.0, 0.0)), found)
        return [(text, self.items[k].item_id, *found) for (text, k), found in sorted(best.items())]


def build_indexes(benchmark: DataFrame) -> DataFrame:
    """Rows (part, size, index): pickled indexes of about PART_BYTES of item text each, built in tasks and written to the shared folder.

    Word frequencies are counted over all items. Null ids and items without words are left out.
    """
    usable = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = usable.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // PART_BYTES)))))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(part, np.unique(s).view(np.int64), len(s)) for part, text in zip(pdf["part"], pdf["text"]) for s in segments(_hashes(text)) if len(s)]
            yield pd.DataFrame(rows, columns=["part", "terms", "words"])

    split = materialize(items.mapInPandas(words, "part long, terms array<long>, words long"), "segments")
    n, average = split.agg(F.count("*"), F.avg("words")).first()
    each = split.select("part", F.explode("terms").alias("term"))
    frequency = each.groupBy("term").agg(F.count("*").alias("frequency"))
    counted = each.distinct().join(frequency, "term")

    def build(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        held = [split_item(i, t) for i, t in sorted(zip(pdf["item_id"].tolist(), pdf["text"].tolist()))]
        held = [it for it in held if len(it.words)]
        if not held:
            return pd.DataFrame({"part": [], "size": [], "index": []})
        index = pickle.dumps(BlockMaxIndex(held, known["term"].to_numpy().view(np.uint64), known["frequency"].to_numpy().astype(np.float64), n, average))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "size": [len(index)], "index": [index]})

    return materialize(items.groupBy("part").cogroup(counted.groupBy("part")).applyInPandas(build, "part long, size long, index binary"), "index")


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """Broadcast parts of the index; those of one pass over the documents have PASS_BYTES at most (or are one part)."""
    context, held, size = benchmark.sparkSession.sparkContext, [], 0
    for row in build_indexes(benchmark).orderBy("part").toLocalIterator():
        if held and size + row["size"] > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append(context.broadcast(bytes(row["index"])))
        size += row["size"]
    if held:
        yield held


def _loaded(parts: list) -> list[BlockMaxIndex]:
    return [pickle.loads(p.value) for p in parts]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (key, item_id, question, answer): the test items that documents hold, with the shares found.

    Every passage of every whole text is a query. Items are searched for by BM25 in segments; an item counts
    if QUESTION_SHARE of its question's five-word shingles and ANSWER_SHARE of its answer's words are in a passage found and
    as many words as the item has on either side. Case and ASCII punctuation do not matter. Null and empty texts hold none. A pass over the documents
    searches PASS_BYTES of index; only a benchmark of some 20 MB or more needs a second one.
    """
    spark, out = docs.sparkSession, None
    schema = "key long, item_id long, question double, answer double"
    for parts in _passes(benchmark):

        def search(batches: Iterator[pd.DataFrame], parts=parts) -> Iterator[pd.DataFrame]:
            indexes = _loaded(parts)
            for pdf in batches:
                found = [f for index in indexes for f in index.search(pdf["text"].tolist())]
                rows = [f[0] for f in found]
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[rows] if rows else [], "item_id": [f[1] for f in found], "question": [f[2] for f in found], "answer": [f[3] for f in found]})

        found = docs.select(doc_key().alias("key"), "text").mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out.groupBy("key", "item_id").agg(F.max("question").alias("question"), F.max("answer").alias("answer"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns, in one step for each pass of the index."""
    for parts in _passes(benchmark):
        name = unused(docs, "_cw_clean")
        docs = docs.withColumn(name, _clean_udf(parts)(F.col("text"))).where(F.col(name)).drop(name)
    return docs


def _clean_udf(parts: list):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = _loaded(parts)
        for texts in batches:
            ok = np.ones(len(texts), dtype=bool)
            for index in indexes:
                ok[[f[0] for f in index.search(texts.tolist())]] = False
            yield pd.Series(ok)

    return clean


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that it holds."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_items(docs, benchmark).select(key_to_id("key").alias("doc_id"), "item_id", F.round("question", 6).alias("question_share"), F.round("answer", 6).alias("answer_share"))
