"""BPE encoding and decoding: adjacent ranks in one contiguous array for each short word, merged by repeated scans for the least."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import doc_key, key_to_id, whole_text

#: The vocabulary file of the registered query.
VOCABULARY = "word_bpe_49k.json"
#: Words of more bytes are merged with a heap, whose time is not quadratic; the result is the same.
SHORT = 96
#: A worker remembers the ids of so many words of SHORT bytes at most, then starts anew.
REMEMBERED = 1 << 18
#: A worker returns rows once their texts have so many characters together.
BLOCK = 1 << 22
NO_RANK = sys.maxsize

# White space of the pattern; U+001C to U+001F do not count.
_SPACE = "\t-\r \x85\xa0  -     　"
_CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"


def _code_points(kind: str, limit: int = sys.maxunicode + 1) -> list[int]:
    """The code points below ``limit`` whose general category starts with ``kind``."""
    return [c for c in range(limit) if unicodedata.category(chr(c)).startswith(kind)]


@lru_cache(3)
def _pattern(limit: int) -> re.Pattern:
    """The words of texts whose code points are all below ``limit``: a small class is tested several times faster."""

    def inside(kind: str) -> str:
        found = _code_points(kind, limit)
        first = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
        last = [c for c, after in zip(found, [*found[1:], -2]) if c != after - 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))

    letters, numbers = inside("L"), inside("N")
    return re.compile(f"{_CLITICS}|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on for bytes that do not print."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder of a vocabulary file (its JSON text) of byte-level BPE with word ends.

    Texts are cut at special tokens, brought to NFC, lower-cased code point by code point and split into words. A
    word's bytes are its first parts; of all adjacent parts the pair of least rank is merged, the leftmost of
    equals first, until no pair has a rank.
    """

    def __init__(self, spec: str):
        told = json.loads(spec)
        model, self.spec = told["model"], spec
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        for token, k in vocab.items():
            self.tokens[k] = token
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        for token, k in self.special.items():
            self.tokens[k] = token
        self.cuts = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        #: (left id, right id) to (rank, id of both together); ids fit 32 bits, so a pair is one integer
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.known: dict[str, bytes] = {}
        self._library = None

    def merge_short(self, parts: list[int]) -> list[int]:
        """Merge by scanning the contiguous array of the ranks of adjacent parts; ``ranks[i]`` is that of parts i and i + 1."""
        rank_of = self.ranks.get
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same result from a heap of (rank, place) over linked parts, for words without bound."""
        n = len(parts)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j == n or self.ranks.get(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], dead[j], after[i] = self.merged[rank], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self.ranks.get(parts[x] << 32 | parts[after[x]])) is not None:
                    heapq.heappush(heap, (r, x))
        return [p for p, gone in zip(parts, dead) if not gone]

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        out = pack(self.merge_short(parts) if len(raw) <= SHORT else self.merge_long(parts))
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        A text with code points that this Python's tables do not know is cut with the tables of the installed library.
        """
        if text.isascii():
            return _pattern(0x80).findall(text.lower())
        # str.lower() has a rule of its own for a sigma at the end of a word
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        used = set(lower)
        highest = ord(max(used))
        if highest < 0x250:
            return _pattern(0x250).findall(lower)
        if all(unicodedata.category(c) != "Cn" for c in used):
            return _pattern(0x10000 if highest < 0x10000 else sys.maxunicode + 1).findall(lower)
        if self._library is None:
            self._library = Tokenizer.from_str(self.spec)
        code = {s: b for b, s in enumerate(byte_symbols())}
        cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(code[s] for s in word).decode() for word, _ in cut]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers, special tokens in it included."""
        out, known = [], self.known
        for piece in self.cuts.split(text) if self.cuts else [text]:
            if piece in self.special:
                out.append(pack([self.special[piece]]))
            elif piece:
                out += [known.get(w) or self.word(w) for w in self.words(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones included, with a space between any two."""
        return " ".join(map(self.tokens.__getitem__, unpack(ids)))


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@lru_cache(2)
def _bpe(spec: str) -> Bpe:
    """One encoder for each worker, so that words of earlier tasks are remembered."""
    return Bpe(spec)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (key, n_tokens, ids, decoded) for every row of ``docs`` (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit integers in a binary, ``decoded`` is what they decode to. A null text is an empty one, which has no ids and
    decodes to an empty string; repeated rows are encoded alike; an empty table gives no rows. ``path`` is a vocabulary file of the driver; its text
    (1.7 MB for the default) is the one thing that is broadcast. No row is shuffled.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(spec.value)

        def rows(keys: list, out: list) -> pd.DataFrame:
            return pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "n_tokens": pd.Series([len(x) // 4 for x in out], dtype="int64"), "ids": pd.Series(out, dtype=object), "decoded": pd.Series([bpe.decode(x) for x in out], dtype=object)})

        for pdf in batches:
            keys, out, held = [], [], 0
            for key, text in zip(pdf["key"], pdf["text"]):
                keys.append(key)
                out.append(bpe.encode(text))
                held += len(text)
                if held >= BLOCK:
                    yield rows(keys, out)
                    keys, out, held = [], [], 0
            if keys:
                yield rows(keys, out)

    return docs.select(doc_key().alias("key"), whole_text().alias("text")).mapInPandas(encode, "key long, n_tokens long, ids binary, decoded string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for all of ``documents``."""
    found = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(key_to_id("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
