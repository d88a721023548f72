"""Phrase collocations against plain counting and against SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from contourlake.llm import collocations, queries
from contourlake.llm.oracles import ORACLE_SQL
from contourlake.storage import Tables

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(rows, least, most, longest=4):
    f = {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault("und" if lang is None else lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        kept = []
        found = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        for p, a in found.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        total = sum(n for p, n in c.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def corpus(rng):
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "漢字", "a\x00b", "x-y", "\x1c", "(a)", "ü　ö", "tone", "pitch"]
    texts = []
    for _ in range(500):
        t = ""
        for _ in range(rng.randrange(60)):
            t += rng.choice(words) if rng.random() < 0.6 else rng.choice(("new york city hall", "tone and pitch", "the the the the the", "NEW york. City"))
            t += rng.choice((" ", " ", " ", "  ", "\t", ", ", ".", "\n", "?! ", "\r\n", "\x0b", " "))
        texts.append((t, rng.choice(("en", "en", "en", "de", None, "und", ""))))
    return texts + [(None, "en"), ("", "fr"), ("...", "fr"), (None, None), texts[0], texts[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(6))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "s", 1, None) for r in rows], "text string, lang string, phrase string, f string, _part int, _salt string").repartition(7)


def found(df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, **more).select(*COLS).collect())


@pytest.mark.parametrize("least, most, shard_words", ((30, 2000, 1 << 20), (5, 40, 700), (1, 10**6, 3)))
def test_collocations(spark, rows, least, most, shard_words):
    some = rows if least > 1 else rows[:25]
    want = plain(some, least, most)
    assert len(want) > 30
    assert found(frame(spark, some), least=least, most=most, shard_words=shard_words) == want


def test_longest_and_empty(spark, rows):
    for longest in (2, 3, 5):
        assert found(frame(spark, rows[:200]), longest=longest, least=8) == plain(rows[:200], 8, 2000, longest)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, [(None, None), ("", "en"), ("one", "en")])) == []
    with pytest.raises(ValueError):
        collocations.collocations(frame(spark, rows), least=300)


def test_a_sketch_too_small_changes_nothing(spark, rows, monkeypatch):
    want = plain(rows, 30, 2000)
    monkeypatch.setattr(collocations.Shape, "__init__", lambda self, n: self.__dict__.update(cells=8, within=2))
    assert found(frame(spark, rows)) == want


def test_the_sketch_holds_back_rare_phrases(spark):
    rng = random.Random(1)
    rows = [(" ".join([f"w{rng.randrange(3000)}" for _ in range(400)] + ["salt and pepper"]), "en") for _ in range(100)]
    tables = Tables(spark, "test")
    df = frame(spark, rows).coalesce(1)
    made = tables.put("shards", collocations.shards(df, "text", "lang", 2000))
    shape = collocations.Shape(made.agg({"n_words": "sum"}).first()[0])
    none = collocations.F.lit(None).cast("array<struct<segment: long, cells: binary>>")
    cells = tables.put("cells", collocations.filled(made.withColumn("let2", none), (1, 2), shape))
    full = tables.put("full", collocations.bounds(cells, shape, 30, 4))
    let = collocations.replies(cells, full, shape, 4)
    n_let = sum(len(collocations._of([x.asDict() for x in r["let"]], shape)) for r in let.collect())
    n_all = sum(len(collocations._places(r["cells"])) for r in cells.collect())
    assert made.count() > 10 and n_let < n_all / 50
    assert found(df, shard_words=2000) == plain(rows, 30, 2000) and [r[2] for r in found(df)] == ["salt and pepper"]


def test_packing_numbers():
    rng = np.random.default_rng(3)
    for x in (np.empty(0, np.int64), np.array([0]), np.array([(1 << 32) - 1]), rng.integers(0, 1 << 32, 999)):
        assert collocations.unpacked(collocations.packed(x)).tolist() == x.tolist()
        x = np.sort(x)
        assert collocations._places(collocations._steps(x)).tolist() == x.tolist()


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 62) - 3
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 2), ("en", "a b", 2, big - 5)], "lang string, phrase string, size int, f long")
    (r,) = collocations.scored(Tables(spark, "test"), counts).collect()
    assert r["score"] == 2000000 * (big - 5) // (2 * big - 2)


def test_hot_parts(spark):
    rows = [(f"the w{k} " * 6, "en") for k in range(40)] * 6
    assert found(frame(spark, rows), most=100) == plain(rows, 30, 100)


def test_query(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op12_collocations"]).fetchall())
    got = queries.op12_collocations(spark, data)
    assert got.columns == list(COLS) and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
