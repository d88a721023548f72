"""Texts longer than what any operator handles at once, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from contourlake.llm import decontamination, language_id, line_dedup, lm_scoring, packing, quality_rules, simhash, substring_dedup, token_output, url_filters

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ITEM = "a planted benchmark question, found at the far end of a long text?"


@pytest.fixture(scope="module")
def rows():
    """One text of over 2 MB, 250,000 words and 120,000 lines, one that has most of it, one that has a passage, and ten that share its first line."""
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 12))) for _ in range(5000)]
    words = rng.choices(vocab, k=260_000)
    lines = [" ".join(words[k : k + 2]) for k in range(0, len(words), 2)]
    long = "the shared line\n" + "\n".join(lines) + "\n" + ITEM.upper()
    assert len(long) > decontamination.SLICE > 1 << 20 and len(lines) > line_dedup.CHUNK and len(words) > 3 * substring_dedup.SLICE > simhash.SLICE
    half = "\n".join(lines[60_000:]) + "\nand an end of its own"
    rows = [(5, long), (9, half), (12, "begin " + " ".join(words[200_000:200_080]) + " end")]
    return rows + [(20 + k, f"The Shared  line\nthe SHARED line \ntext {k}") for k in range(10)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_simhash(docs, rows):
    def fp(t):
        w = t.lower().encode().split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)).to_bytes(8, "big")

    assert {r["doc_id"]: bytes(r["fp"]) for r in simhash.near_duplicates(docs).collect()} == {i: fp(t) for i, t in rows}
    assert simhash.keep_representatives(docs).where("doc_id IN (5, 12)").count() == 2


def test_lines(docs, rows):
    key = lambda x: x.strip().lower()
    often = Counter(k for k, _ in {(key(x), i) for i, t in rows for x in t.split("\n")})
    want = set()
    for i, t in rows:
        kept = [x for x in t.split("\n") if often[key(x)] < 10]
        want.add((i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), sha("\n".join(kept))))
    assert {tuple(r) for r in line_dedup.line_digests(docs).collect()} == want and {w[2] for w in want if w[0] >= 20} == {2}


def test_substrings(docs, rows):
    first, want = {}, set()
    split = [(i, t.split()) for i, t in sorted(rows)]
    for i, w in split:
        for k in range(len(w) - 49):
            first.setdefault(hashlib.md5(" ".join(w[k : k + 50]).encode()).digest(), i)
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[hashlib.md5(" ".join(w[k : k + 50]).encode()).digest()] < i:
                gone[k : k + 50] = True
        want.add((i, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    assert {tuple(r) for r in substring_dedup.remove_repeats(docs).drop("text").collect()} == want
    assert {n for i, _, n, _ in want if i in (9, 12)} == {140_000, 80}


def test_tokens(docs, rows, spark):
    model, want, start = Tokenizer.from_file(BPE), set(), 0
    sizes = {}
    for i, t in sorted(rows):
        ids = [*model.encode(t, add_special_tokens=False).ids, 0]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        sizes[i] = len(ids)
    assert {tuple(r) for r in token_output.token_digests(docs, BPE).collect()} == want
    by_doc = Counter()
    for r in packing.pack(docs, BPE).collect():
        by_doc[r["doc_id"]] += r["length"]
    assert by_doc == sizes


def test_leaks(docs, spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "not in any of these texts, I should think")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.leaks(docs, bench).collect()] == [(5, 1, 0)]
    assert decontamination.drop_leaks(docs, bench).where("doc_id = 5").count() == 0


def test_language_and_scores(docs, rows):
    out = {r["doc_id"]: r for r in language_id.predict(docs, PIECES).collect()}
    assert {r["lang_pred"] for r in out.values()} == {"en"} and out[5]["score"] == 1.0
    a, b = ({r["doc_id"]: r for r in lm_scoring.score(docs, shards=n, block_bytes=size).collect()} for n, size in ((3, 12 << 20), (7, 1 << 20)))
    for i, t in rows:
        assert a[i]["n_tokens"] == len(t.split()) + 1 and 0 < a[i]["bits_per_byte"] < 8
        assert a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-9) and a[i]["base_score"] == pytest.approx(b[i]["base_score"], rel=1e-9)


def test_quality(docs, rows):
    for r in quality_rules.judge_quality(docs).collect():
        w = dict(rows)[r["doc_id"]].split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))


def test_url(spark):
    url = "http://x.example.org/es/" + "a/" * 600_000 + "?b.gif"
    r = url_filters.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["rule"], r["verdict"], len(r["path"])) == ("org/es/", "block", 1_200_004)
