"""Cases that the fixture tables lack."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from contourlake.functions import stats as S
from contourlake.functions import text as X
from contourlake.operators import metrics, pilot, running, selection
from contourlake.sources import readers, writers


def test_kappa_leaves_out_pairs_outside_the_classes(spark):
    rows = [("H", "H"), ("H", "X"), ("X", "H")]
    assert metrics.pair_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"] == pytest.approx(0.25)
    rows += [("X", "X"), (None, "H"), ("L", "M"), ("M", "M")]
    n, idx = len(rows), "HML"
    known = [(a, b) for a, b in rows if a in set(idx) and b in set(idx)]
    po, pe = sum(a == b for a, b in known) / n, sum(sum(a == c for a, _ in known) * sum(b == c for _, b in known) for c in idx) / n**2
    r = metrics.pair_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (r["n"], r["kappa"]) == (n, pytest.approx((po - pe) / (1 - pe)))


def test_norm_key_composes(spark):
    texts = [("\u1ecd\u0300j\u00f2",), ("o\u0323\u0300jo\u0300",), ("O\u0300\u0323JO\u0300  ",), (None,), ("plain  Text",)]
    keys = [r[0] for r in spark.createDataFrame(texts, "t string").select(X.norm_key(F.col("t"))).collect()]
    assert keys[0] == keys[1] == keys[2] and keys[3] is None and keys[4] == "plain text"
    left = selection.without_holdouts(spark.createDataFrame(texts[:2] + texts[4:], "text string"), spark.createDataFrame(texts[:1], "text string"))
    assert [r["text"] for r in left.collect()] == ["plain  Text"]


def test_best_by_takes_the_first_tag_of_equals(spark):
    rows = [("b", 0.5), ("a", 0.5), ("c", 0.4), ("d", None)]
    for order in itertools.permutations(rows):
        assert tuple(selection.best_by(spark.createDataFrame(order, "tag string, m double").coalesce(1), "m", "tag").first()) == ("a", 0.5)


def test_form_items_come_back_whatever_their_text(spark):
    items = spark.createDataFrame([("item01", "an end ]; here\nand </script> [x];", "data:audio/wav;base64,AAEC"), ("item02", "line\u2028mark", "data:audio/wav;base64,AAEC")], "item_id string, text string, audio string")
    page = writers.form(items, ["ok", "bad"], "A kit")
    got = readers.form_items(spark.createDataFrame([(page,)], "html string")).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [(r["item_id"], r["text"], bytearray(b"\x00\x01\x02")) for r in items.orderBy("item_id").collect()]


def test_exact_binomial_test(spark):
    cases = [(0, 1), (1, 1), (0, 5), (2, 5), (5, 10), (12, 30), (400, 1000), (4900, 10_000), (0, 0), (1, 40), (7, 15), (8, 16), (495_000, 1_000_000)]

    def brute(k, n):
        if 2 * k == n:
            return 1.0 if n else None
        total, term = 0, 1
        for i in range(min(k, n - k) + 1):
            total += term
            term = term * (n - i) // (i + 1)
        return min(1.0, 2 * total / 2**n)

    out = spark.createDataFrame(cases, "k long, n long").select("k", "n", S.binom_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    for r in out:
        if r["n"] <= 10_000:
            want = brute(r["k"], r["n"])
            assert r["p"] is None if want is None else r["p"] == pytest.approx(want, rel=1e-9), r
        else:
            assert r["p"] == pytest.approx(math.erfc(9999 / 1000 / math.sqrt(2)), rel=1e-3)


def test_ranks_and_auroc_against_pairs(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(40)), float(rng.randrange(9)), rng.randrange(2)) for _ in range(500)] + [(None, 1.0, 1), (3.0, 2.0, None)]
    df = spark.createDataFrame(rows, "s double, v double, y int").repartition(7)
    live = [(s, y) for s, _, y in rows if s is not None and y is not None]
    pos, neg = [s for s, y in live if y], [s for s, y in live if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert tuple(metrics.auroc(df, "s", "y").first()) == (len(live), len(pos), pytest.approx(want))
    ranks = {r["s"]: r["r"] for r in metrics.average_ranks(df, "s", "r").collect()}
    every = [s for s, _, _ in rows if s is not None]
    assert ranks == {s: sum(x < s for x in every) + (every.count(s) + 1) / 2 for s in every}


def test_running_totals(spark):
    rows = [(k * 37 % 101, float(k % 7)) for k in range(101)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    got = {r["k"]: r["b"] for r in running.running(df, F.col("v"), "k", out="b").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    assert {r["k"]: r["n"] for r in running.numbered(df, -F.col("k"), out="n").collect()} == {k: 100 - k for k in range(101)}
    assert running.running(df.limit(0), F.col("v"), "k").count() == 0


def test_item_ids_and_round_robin(spark):
    rows = spark.createDataFrame([(k,) for k in range(30)], "clip long").repartition(4)
    ids = [r["item_id"] for r in selection.item_ids(rows, 9, "clip").collect()]
    assert sorted(ids) == [f"item{k:02d}" for k in range(1, 31)]
    natives = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "native string")
    catches = spark.createDataFrame([(f"c{k}",) for k in range(5)], "catch string")
    assert sorted(map(tuple, selection.round_robin(catches, natives, "catch", "native").select("catch", "native").collect())) == [(f"c{k}", f"n{k % 3 + 1}") for k in range(5)]


def test_answers_of_several_codes(spark):
    codes = spark.createDataFrame([("r", 1, "P;a=ok;a= Bad ;b=ok"), ("r", 2, "P;a=unsure;;noise")], "rater string, sitting int, code string")
    assert {tuple(r) for r in pilot.answer_rows(codes, order="sitting").collect()} == {("r", "a", "unsure"), ("r", "b", "ok")}
    assert {tuple(r) for r in pilot.answer_rows(codes.where("sitting = 1")).collect()} == {("r", "a", "bad"), ("r", "b", "ok")}


def test_cocovered_needs_equal_targets(spark):
    t = "clip_id string, tbu_idx int, target string, pred string"
    a = spark.createDataFrame([("x", 0, "H", "H"), ("x", 1, "L", None), ("y", 0, "H", "L"), ("z", 0, "M", "M")], t)
    b = spark.createDataFrame([("x", 0, "H", "M"), ("x", 1, "L", "L"), ("y", 0, "L", "L"), ("z", 0, "M", "M"), ("z", 1, "M", "M"), ("w", 0, "H", "H")], t)
    assert [tuple(r) for r in metrics.cocovered(a, b).collect()] == [("x", 0, "H", "H", "M")]
