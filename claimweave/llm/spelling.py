"""Spelling variants: automata over the halves of words retrieve words one edit apart, and forms follow the more frequent ones."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, _INVERSE, _MULT, _powers, materialize, mix64, release, whole_text

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: A task passes on its counts of words once it holds so many.
COUNTED = 1 << 18
#: A shard's automaton holds the segments of words of so many code points together; it scans slices of such a size.
SHARD_CHARS = 1 << 20
#: Shards of small vocabularies: enough for the tasks of a cluster.
LEAST_SHARDS = 16
#: Words up to this length are compared in one array; longer ones one by one.
WIDE = 48
#: So many candidates are compared at once.
COMPARED = 1 << 17

_FOLD = str.maketrans(UPPER, LOWER)


def slipped(word: str, crc: int, slip: int = SLIP) -> str:
    """``word`` without its code point crc % length where ``slip`` divides ``crc``."""
    if crc % slip:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """Rows (word, n): how often each word of ``min_chars`` code points or more occurs in all texts, from ``min_count`` on.

    Words are counted within tasks first, so a word of a third of all texts is a few rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"]):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(RUN.findall(text.translate(_FOLD))).items():
                    word = slipped(run, zlib.crc32(run.encode(), start), slip)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= COUNTED:
                    yield rows()
                    held.clear()
        yield rows()

    ids = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    found = docs.select(ids.alias("id"), whole_text().alias("text")).mapInPandas(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Words:
    """Latin-1 words as one array of code points with running sums, so that any part of a word has a hash."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1] if len(words) else self.size
        raw = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.inverse = _powers(_INVERSE, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_MULT, len(raw)), out=self.sums[1:])
        width = int(min(WIDE, self.size.max(initial=0))) + 1
        self.table = np.zeros((len(words), width), dtype=np.uint8)
        places = np.arange(len(raw)) - np.repeat(self.begin, self.size)
        inside = places < width
        self.table[np.repeat(np.arange(len(words)), self.size)[inside], places[inside]] = raw[inside]

    def part(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of word[first:last] of each row."""
        a, b = self.begin[rows] + first, self.begin[rows] + last
        with np.errstate(over="ignore"):
            return mix64((self.sums[b] - self.sums[a]) * self.inverse[a] + (last - first).astype(np.uint64))


def first_difference(words: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differ by exactly one edit, length of the common prefix) for pairs of rows of ``words``; b is as long as a, or one longer or shorter."""
    exact, prefix = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    small = np.maximum(words.size[a], words.size[b]) <= words.table.shape[1] - 1
    for k in np.flatnonzero(~small):
        x, y = words.words[a[k]], words.words[b[k]]
        d = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        prefix[k] = d
        exact[k] = x != y and (x[d + (len(x) >= len(y)) :] == y[d + (len(y) >= len(x)) :])
    rows = np.flatnonzero(small)
    for k in range(0, len(rows), COMPARED):
        r = rows[k : k + COMPARED]
        longer = words.size[a[r]] >= words.size[b[r]]
        x, y = words.table[np.where(longer, a[r], b[r])], words.table[np.where(longer, b[r], a[r])]
        sizes = np.maximum(words.size[a[r]], words.size[b[r]])
        apart = x != y
        d = np.where(apart.any(axis=1), apart.argmax(axis=1), sizes)
        same_size = words.size[a[r]] == words.size[b[r]]
        shifted = (x[:, 1:] != y[:, :-1]) & (np.arange(x.shape[1] - 1)[None, :] >= d[:, None])
        exact[r] = np.where(same_size, apart.sum(axis=1) == 1, ~shifted.any(axis=1))
        prefix[r] = np.minimum(d, np.minimum(words.size[a[r]], words.size[b[r]]))
    return exact, prefix


def _meet(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all (i, j) with left[i] == right[j]."""
    order = np.argsort(right, kind="stable")
    low, high = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
    counts = high - low
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(left):
        until = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COMPARED, "right")))
        n = counts[begin:until]
        i = np.repeat(np.arange(begin, until), n)
        yield i, order[np.repeat(low[begin:until] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(i))]
        begin = until


def near_words(words: list[str], patterns: np.ndarray, asks: np.ndarray, suffix: bool, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking row, pattern row) of words one edit apart, where the pattern's one half stands in the asking word.

    One edit leaves a half of a word whole: the first half at the start of the other word, or the second half at its end. An
    automaton of the patterns' halves (the second ones with ``suffix``) scans the asking words; an occurrence counts at
    that place alone, for words whose lengths differ by one at most. The rest has a whole half in turn, by
    which candidates are met; then the distance is verified. Pairs whose first half fits are left to the run without ``suffix``.
    """
    table = Words(words)
    half = table.size // 2
    own = np.flatnonzero(patterns)
    cut = half[own]
    segments: dict[str, int] = {}
    of = np.array([segments.setdefault(words[p][h:] if suffix else words[p][:h], len(segments)) for p, h in zip(own.tolist(), cut.tolist())], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not segments:
        return none, none
    automaton = ahocorasick.Automaton()
    for segment, k in segments.items():
        automaton.add_word(segment, (k, len(segment)))
    automaton.make_automaton()
    ask, hit, length = [], [], []
    for q in np.flatnonzero(asks).tolist():
        word = words[q]
        end = len(word) - 1
        for at, (k, n) in automaton.iter(word):
            if at == end if suffix else at == n - 1:
                ask.append(q), hit.append(k), length.append(n)
    ask, hit, length = np.array(ask, dtype=np.int64), np.array(hit, dtype=np.int64), np.array(length, dtype=np.int64)
    found_a, found_b = [none], [none]
    size = table.size[own]
    for step in (-1, 0, 1):
        # the patterns' length, and the length of their segment for it
        wanted = table.size[ask] + step
        fits = (length == (wanted - wanted // 2 if suffix else wanted // 2)) & (wanted >= min_chars)
        a, k, n, whole = ask[fits], hit[fits], length[fits], wanted[fits]
        rest = whole - n
        first_a, first_p = (0 * n, 0 * cut) if suffix else (n, cut)
        last_a, last_p = (table.size[a] - n, cut) if suffix else (table.size[a], size)
        cut_a, cut_p = rest // 2, (last_p - first_p) // 2
        tags_a, tags_p = mix64((k << 32 | whole).astype(np.uint64)), mix64((of << 32 | size).astype(np.uint64))
        with np.errstate(over="ignore"):
            head_a = table.part(a, first_a, np.minimum(first_a + cut_a, last_a)) + tags_a
            head_p = table.part(own, first_p, first_p + cut_p) + tags_p
            tail_a = table.part(a, np.maximum(last_a - (rest - cut_a), 0), last_a) + tags_a
            tail_p = table.part(own, first_p + cut_p, last_p) + tags_p
        for left, right, again in ((head_a, head_p, False), (tail_a, tail_p, True)):
            for i, j in _meet(left, right):
                if again:
                    new = head_a[i] != head_p[j]
                    i, j = i[new], j[new]
                x, y = a[i], own[j]
                exact, prefix = first_difference(table, x, y)
                if suffix:
                    exact &= prefix < half[y]
                found_a.append(x[exact]), found_b.append(y[exact])
    return np.concatenate(found_a), np.concatenate(found_b)


def _placed(words: DataFrame, shards: int, chars: int, min_chars: int) -> DataFrame:
    """Rows (suffix, bucket, i, j, word, n, pattern, asks): groups of bounded size in which all words one edit apart meet.

    Halves have ``min_chars // 2`` code points at least, so a word and a pattern whose half it has share so many at the start or end;
    these choose the bucket. A bucket of more than ``chars`` code points is cut into slices, and each of its
    slices of words is scanned by each of its slices' automata.
    """
    short = min_chars // 2
    sides = F.explode(F.array(F.struct(F.lit(False).alias("suffix"), F.substring("word", 1, short).alias("end")), F.struct(F.lit(True).alias("suffix"), F.substring("word", -short, short).alias("end"))))
    rows = words.select("word", "n", sides.alias("s")).select("word", "n", "s.suffix", F.pmod(F.xxhash64("s.end"), F.lit(shards)).alias("bucket"))
    sizes = rows.groupBy("suffix", "bucket").agg(F.ceil(F.sum(F.length("word")) / F.lit(chars)).cast("int").alias("slices"))
    own = rows.join(sizes, ["suffix", "bucket"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit("slice")), F.col("slices")).cast("int"))
    roles = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("slices") - 1),
            lambda k: F.when(k == F.col("own"), F.array(_role(k, k, True, True))).otherwise(F.array(_role(F.col("own"), k, True, False), _role(k, F.col("own"), False, True))),
        )
    )
    return own.select("suffix", "bucket", "word", "n", F.explode(roles).alias("r")).select("suffix", "bucket", "r.*", "word", "n")


def _role(i, j, pattern: bool, asks: bool):
    return F.struct(i.alias("i"), j.alias("j"), F.lit(pattern).alias("pattern"), F.lit(asks).alias("asks"))


def variant_links(words: DataFrame, min_chars: int = MIN_CHARS, chars: int = SHARD_CHARS) -> DataFrame:
    """Rows (word, n_near, form_n, form) of the words that have a near word; the form is the near word of largest n, of equals the smallest.

    ``words`` is (word, n) with different Latin-1 words. No pair leaves its task: a group gives one row for each asking word.
    """
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-2 * total // chars))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["word"].tolist()
        a, b = near_words(names, pdf["pattern"].to_numpy(dtype=bool), pdf["asks"].to_numpy(dtype=bool), bool(pdf["suffix"].iloc[0]), min_chars)
        n = pdf["n"].to_numpy()
        order = np.argsort(np.array(names, dtype=object), kind="stable")
        by_name = np.empty(len(names), dtype=np.int64)
        by_name[order] = np.arange(len(names))
        best = np.lexsort((by_name[b], -n[b], a))
        a, b = a[best], b[best]
        begin = np.flatnonzero(np.diff(a, prepend=-1))
        asking, form = a[begin], b[begin]
        word, best = (pd.Series([names[k] for k in rows], dtype=object) for rows in (asking, form))
        return pd.DataFrame({"word": word, "near": np.diff([*begin, len(a)]), "less": -n[form], "form": best})

    groups = _placed(words, shards, chars, min_chars).groupBy("suffix", "bucket", "i", "j")
    found = groups.applyInPandas(link, "word string, near long, less long, form string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for a table (word, form) without cycles: each pass doubles how far forms are followed."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after


def group_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP, chars: int = SHARD_CHARS) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) for every word of the texts of ``docs`` (doc_id, text).

    Words are runs of Latin letters with A-Z lower-cased, each counted with the slips that ``slip`` deals to its document. A word's form
    is its most frequent word one edit apart, of equals the smallest in code-point order, if it is ``ratio`` times as frequent; the root is where forms lead.
    Null and empty texts have no words, a null doc_id counts as an empty one, repeated rows count again, and an empty table gives no
    rows. ``min_chars`` is two at least.
    """
    words = materialize(word_counts(docs, min_chars, min_count, slip), "words")
    near = materialize(words.join(variant_links(words, min_chars, chars), "word", "left").withColumn("up", F.col("form_n") >= F.col("n") * ratio), "near")
    release(words)
    root = roots(near.where("up").select("word", "form"))
    form = [F.when(F.col("up"), F.col(c)).alias(c) for c in ("form", "form_n")]
    return near.join(root, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *form, F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n for all of ``documents``."""
    found = group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM range(256) r(b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS code FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 1 + 2 * i, 2))::BIGINT),
         lambda c, b: xor(c >> 8, bytes.crc[1 + xor(c & 255, b)]), 4294967295::BIGINT)) AS h
  FROM counted, bytes),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM gaps),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
path(word, stop, step) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT p.word, f.form, step + 1 FROM path p JOIN formed f ON p.stop = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM formed f JOIN (SELECT word, arg_max(stop, step) AS root FROM path GROUP BY word) r ON f.word = r.word
"""
