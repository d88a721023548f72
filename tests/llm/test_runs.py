"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from contourlake.llm import queries, runs


def text(t):
    return (t or "").encode()


def brute(words, least=24):
    """start, end and smallest period of all runs, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, 3 * q):
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def of(words, least=24):
    number = runs.Numbers()
    return runs.runs_of(np.array([*(number[w] for w in words), 1 << 32]), least)


def examples(rng):
    for n in (0, 1, 2, 3, 8, 40):
        yield ["a"] * n
    for _ in range(400):
        yield [rng.choice("ab") for _ in range(rng.randrange(90))]
    for _ in range(300):
        words = []
        while len(words) < 150:
            piece = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 14))]
            words += piece * rng.choice((1, 1, 2, 3, 5, 9)) + piece[: rng.randrange(len(piece))]
            if rng.random() < 0.4:
                lo = rng.randrange(len(words))
                words += words[lo : lo + rng.randrange(80)]  # a long block with runs inside
        yield words
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    yield b  # a Fibonacci word has runs of little more than three periods at all scales
    yield (["x", "y"] * 20 + ["z"]) * 7
    yield ((["x"] * 9 + ["y"]) * 5 + ["z"]) * 6


@pytest.mark.parametrize("least", (24, 3))
def test_runs_of_symbols(least):
    rng = random.Random(3)
    for words in examples(rng):
        assert of(words, least) == brute(words, least), words


def test_nearest_smaller_without_jumps(monkeypatch):
    rng = np.random.default_rng(1)
    for values in (rng.permutation(3000), np.r_[np.arange(1, 3000), 0], np.arange(3000)[::-1], np.r_[np.arange(9, 3000), 3, 2, 1, 0]):
        want, stack = [], []
        for k, v in enumerate(values.tolist()):
            while stack and values[stack[-1]] > v:
                stack.pop()
            want.append(stack[-1] if stack else -1)
            stack.append(k)
        for jumps in (24, 0, 2):
            monkeypatch.setattr(runs, "JUMPS", jumps)
            assert runs.smaller_before(values).tolist() == want


def expected(doc_id, body):
    words = body.split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *four, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found).encode()), sha(kept))


COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_documents(docs, rows, empty):
    def found(df):
        return Counter(tuple(r) for r in runs.digests(runs.find(df, rewrite=queries.planted_run)).select(*COLS).collect())

    want = Counter(expected(r[0], text(r[1])) for r in rows)
    assert sum(w[1] > 0 for w in want) > 1
    assert found(docs) == want
    assert runs.digests(runs.find(empty)).count() == 0
    same = runs.find(docs.where("text is null or text = ''")).select("n_words", "runs", "collapsed").distinct().collect()
    assert [tuple(r) for r in same] == [(0, [], "")]
    assert {c: t for c, t in runs.digests(runs.find(docs)).dtypes if c in COLS[1:6]} == dict.fromkeys(COLS[1:6], "bigint")


def test_query_over_the_whole_table(spark, data):
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if len(text(r["text"]).split()) < 2500]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, data).select(*COLS).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in docs:
        assert got[r["doc_id"]] == expected(r["doc_id"], text(r["text"]))
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_many_and_long_documents_at_once(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join([rng.choice("pqr")] * rng.randrange(200)) for _ in range(3000)] + ["tick tock " * 120_000]
    got = runs.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    for r in got[:-1]:
        n = len(texts[r["doc_id"]].split())
        assert [tuple(x) for x in r["runs"]] == ([(0, n, 1)] if n >= 24 else [])
    assert [tuple(x) for x in got[-1]["runs"]] == [(0, 240_000, 2)] and got[-1]["collapsed"] == "tick tock"
