"""Spelling variants, whitening and BPE against brute force and the installed library, and their edge cases."""

import array
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import bpe, spelling, whitening
from claimweave.llm.common import NULL_KEY

DOCS = "doc_id long, text string, word string, n int, key int, form string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS).repartition(3)


# --- spelling variants ---------------------------------------------------------------------------


def brute_words(rows):
    found = Counter()
    for key, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in form.items() if words[v] >= 5 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


def variants(spark, rows, **given):
    found = spelling.group_variants(docs_of(spark, rows), **given).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abén÷z") for _ in range(rng.randint(5, 12))) for _ in range(60)]
    rows = []
    for k in range(300):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * rng.random() ** 3)]
            if rng.random() < 0.5:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", rng.choice("abén")]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k if k % 50 else None, rng.choice([" ", ", ", "1"]).join(words)))
    long = "q" * 3000 + "xyz" * 20
    rows += [(900 + k, f"{long} {long[1:]} {'b' * 70}") for k in range(6)] + [(950, " ".join(["b" * 69] * 40))]
    return [*rows, *rows[:20], (1, None), (2, ""), (3, "\n\t 12 ×÷× ×÷×÷×÷ ")]


@pytest.mark.parametrize("chars", [spelling.SHARD_CHARS, 400])
def test_variants_equal_brute_force(spark, misspelt, chars):
    want = brute_variants(brute_words(misspelt))
    assert sum(v[2] is not None for v in want.values()) > 20 and max(v[1] for v in want.values()) > 5
    assert variants(spark, misspelt, chars=chars) == want


def test_forms_are_followed_and_ties_go_by_code_point(spark):
    counts = {"abcdefgh": 5, "abcdefghi": 25, "abcdefghij": 125, "zzzzzzy": 5, "zzzzzzé": 25, "zzzzzzb": 25, "alone-": 9, "loneword": 4}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    found = variants(spark, rows, slip=2**40)
    assert found["abcdefgh"] == (5, 1, "abcdefghi", 25, "abcdefghij") and found["abcdefghij"][2] is None and found["abcdefghij"][4] == "abcdefghij"
    assert found["zzzzzzy"] == (5, 2, "zzzzzzb", 25, "zzzzzzb") and "loneword" not in found


def test_no_words(spark):
    assert variants(spark, []) == {} and variants(spark, [(None, None), (1, "few")]) == {}


# --- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x int, n int, component int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS).repartition(3)


def test_jacobi_is_accurate_for_small_eigenvalues():
    rng = np.random.default_rng(2)
    d = np.logspace(0, -8, 9)
    near = np.eye(9) + 0.2 * np.tril(rng.normal(size=(9, 9)), -1) / 9
    values, vectors = whitening.jacobi(d[:, None] * (near @ near.T) * d)
    # the determinant is exact by its factors
    assert abs(np.log(values).sum() - 2 * np.log(d).sum()) < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(9)).max() < 1e-13 and (np.diff(values) < 0).all()
    for n in (1, 2, 40):
        m = rng.normal(size=(n, 2 * n))
        m = m @ m.T
        values, vectors = whitening.jacobi(m)
        assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_whitening_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    grid = {r.vec_id: tuple(int(np.floor(256 * float(c))) for c in r.embedding) for r in table.collect()}
    fit = np.array(sorted(set(grid.values())))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = whitening.whiten(table).toPandas()
    assert len(rows) == 4 * len(grid) and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-10 and rows["identity_error"].nunique() == 1
    for k in range(4):
        own = rows[rows["component"] == k + 1].set_index("key")
        assert np.allclose(own["explained"], values[k] / values.sum(), rtol=1e-10)
        want = np.array([(np.array(grid[v]) - sums / n) @ vectors[:, k] / np.sqrt(values[k]) for v in own.index])
        got = own["whitened"].to_numpy()
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-8
        assert all(d == sum((n * x - int(s)) ** 2 for x, s in zip(grid[v], sums)) for v, d in own["deviation"].items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    plain = [(k, [float(k % 5), float(k % 3) - 1, 0.5]) for k in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [1.0, -inf, 1.0]), (105, []), (106, [1.0]), (None, [-0.0, 0.0, 0.5]), (7, plain[7][1])]
    rows = whitening.whiten(vectors_of(spark, plain + odd)).toPandas()
    # the third dimension is constant: two components
    assert Counter(rows["component"]) == {1: 32, 2: 32} and (rows["key"] == NULL_KEY).sum() == 2 and set(rows["n"]) == {15}
    assert abs(rows.drop_duplicates("component")["explained"].sum() - 1) < 1e-12 and rows["identity_error"].max() < 1e-12
    for none in ([], [(1, None)], [(1, []), (2, [])], [(1, [2.0, 3.0])], [(k, [1.0]) for k in range(9)]):
        assert whitening.whiten(vectors_of(spark, none)).count() == 0
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2e17])])).collect()
    assert {r.component for r in huge} == {1, 2} and all(r.deviation is None for r in huge)
    with pytest.raises(ValueError):
        whitening.whiten(vectors_of(spark, [(k, [float(k)] * 5000) for k in range(2)]))


def test_deviations_beyond_a_long_are_null():
    assert whitening.deviations(np.array([[2**33], [1]]), 1, [0]) == [None, 1]
    assert whitening.deviations(np.array([[3, 4]]), 2, [1, 2]) == [61]


# --- byte pairs ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def agree(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    found = own.encode(text)
    return array.array("I", ids).tobytes() == found and library.decode(ids, skip_special_tokens=False) == own.decode(found)


def test_bpe_equals_the_library(own, library):
    rng = random.Random(1)
    alphabet = "aAbBzZ'sStT're've'll'd ΣσςİIıéÉÄßẞǅK Åé 　\x1c\x1d\x85​日本한글ᄀ각١٢Ⅷ½😀🏽‍͸Ꟛ\n\t\x00.,!!-_"
    for k in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        if k % 7 == 0:
            text = "".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20))
        if k % 10 == 0:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>x", "<|endoftext|><|endoftext|>", "<|endoftext|"]) + text[:5]
        assert agree(own, library, text), repr(text)
    for text in ("", "a" * 50_000, "".join(rng.choice("abcdefghij") for _ in range(50_000)), "é" * 20_000, "LONG " * 60_000, "!?" * 30_000):
        assert agree(own, library, text)


def test_short_and_long_words_merge_alike(own):
    rng = random.Random(2)
    for n in range(1, 200):
        parts = [own.inner[b] for b in rng.choices(b"aabcehinorst", k=n)]
        assert own.merge_short(parts[:]) == own.merge_long(parts[:])


def test_a_full_memory_starts_anew(own, monkeypatch):
    want = own.encode("the words of this text are the words of this text")
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    own.known.clear()
    assert own.encode("the words of this text are the words of this text") == want and len(own.known) <= 2


def test_registered_bpe_query_equals_the_library(spark, sf, library):
    from claimweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(spark, monkeypatch):
    rows = [(1, None), (1, ""), (None, "ab ab"), (None, "ab ab"), (5, "x" * 300_000)]
    found = bpe.encode_documents(docs_of(spark, rows)).select("key", "n_tokens", "decoded", F.length("ids").alias("b")).collect()
    assert len(found) == 5 and all(r.b == 4 * r.n_tokens for r in found)
    assert sorted((r.n_tokens, r.decoded) for r in found)[:2] == [(0, ""), (0, "")]
    assert sum(r.decoded == "ab</w> ab</w>" for r in found) == 2
    assert bpe.encode_documents(docs_of(spark, [])).count() == 0
