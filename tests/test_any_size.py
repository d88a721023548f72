"""Resampling and selection at any size: trees of draws, keyed permutations, exact places."""

import hashlib
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import multinomial, resample, running


def test_groups_do_not_matter(spark, monkeypatch):
    """The same draws however the tree is cut."""
    rng = random.Random(3)
    rows = [(rng.randrange(900), rng.randrange(3), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "c_a long, c_b long, c_n long")
    want = None
    for per in (1 << 20, 1024, 64, 7):
        monkeypatch.setattr(multinomial, "PER", per)
        got = sorted(map(tuple, resample.replicates(df.repartition(per % 5 + 1), 60, 9).select("rep", "c_a", "c_b", "c_n").collect()))
        want = want or got
        assert got == want and all(r[3] == 3000 for r in got)


@pytest.mark.parametrize("per", (1 << 20, 1))
def test_draws_are_multinomial(monkeypatch, spark, per):
    """Every way that four units can fall on three kinds, as often as the multinomial says (chi square)."""
    monkeypatch.setattr(multinomial, "PER", per)
    kinds = spark.createDataFrame([(0, 1, 0), (5, 2, 1), (6, 1, 2)], "key long, w long, k int")
    use = lambda columns, n: {f"n{k}": n[columns["k"].tolist().index(k)] if k in columns["k"] else np.zeros(n.shape[1], np.int64) for k in range(3)}
    parts = multinomial.drawn(kinds, 3, 20000, 4, "n0 long, n1 long, n2 long", use)
    found = Counter(tuple(r)[1:] for r in parts.where("rep >= 0").groupBy("rep").agg(*(F.sum(f"n{k}") for k in range(3))).collect())
    assert parts.where("rep < 0").groupBy().agg(*(F.sum(f"n{k}") for k in range(3))).first() == (1, 2, 1)
    chi, cells = 0.0, 0
    for a in range(5):
        for b in range(5 - a):
            c = 4 - a - b
            p = math.factorial(4) / (math.factorial(a) * math.factorial(b) * math.factorial(c)) * 0.25**a * 0.5**b * 0.25**c
            chi += (found[a, b, c] - 20000 * p) ** 2 / (20000 * p)
            cells += 1
    assert sum(found.values()) == 20000 and cells == 15 and chi < 36.1  # 0.1 % of 14 degrees


def test_equal_hashes_are_drawn_apart():
    n = multinomial.split(1, np.array([4, 4, 9]), np.array([1, 3, 4]), np.full(4000, 8))
    assert (n.sum(axis=0) == 8).all() and n.mean(axis=1) == pytest.approx([1, 3, 4], abs=0.1)


def item_stats(items):
    s, y, m = (np.array([i[k] for i in items], float) for k in range(3))
    order = np.argsort(s)
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = s[order] == v
        rank[order[at]] = np.flatnonzero(at).mean() + 1
    pos, n = y.sum(), len(y)
    po, pe = (m == y).mean(), m.mean() * y.mean() + (1 - m.mean()) * (1 - y.mean())
    return ((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)), np.corrcoef(s, y)[0, 1], (po - pe) / (1 - pe))


def test_items_against_plain_resampling(spark, monkeypatch):
    rng = random.Random(11)
    items = [(rng.gauss(y, 1.2) if k % 3 else float(rng.randrange(3)), y, int(rng.random() < 0.3 + 0.4 * y)) for k in range(150) for y in [rng.randrange(2)]]
    df = spark.createDataFrame([(*i, "x") for i in items] + [(None, 1, 1, ""), (2.0, None, 0, "")], "s double, y int, m int, rep string")
    values = [item_stats(rng.choices(items, k=150)) for _ in range(1500)]
    want, first = item_stats(items), None
    for per in (1 << 20, 16, 1):
        monkeypatch.setattr(multinomial, "PER", per)
        rows = {r["rep"]: (r["auroc"], r["r"], r["kappa"]) for r in resample.item_bootstrap(df.repartition(per % 7 + 1), "s", "y", 1500, 5, "m").collect()}
        assert rows[-1] == pytest.approx(want) and len(rows) == 1501
        first = first or rows
        assert all(rows[k] == pytest.approx(first[k]) for k in rows)
    for k in range(3):
        have, plain = sorted(r[k] for rep, r in first.items() if rep >= 0), sorted(v[k] for v in values)
        assert statistics.mean(have) == pytest.approx(statistics.mean(plain), abs=0.01)
        for q in (37, 750, 1462):
            assert plain[max(0, q - 30)] - 0.005 <= have[q] <= plain[min(1499, q + 30)] + 0.005


def test_items_at_the_edges(spark):
    one = lambda rows: resample.item_bootstrap(spark.createDataFrame(rows, "s double, y int"), "s", "y", 3, 1).where("rep < 0").collect()
    assert one([]) == [] and one([(None, 1)]) == []
    (r,) = one([(1.0, 1), (1.0, 1)])
    assert r["auroc"] is None and r["r"] is None and r["kappa"] == 1.0
    (r,) = one([(1.0, 1), (2.0, 0)])
    assert (r["auroc"], r["kappa"]) == (0.0, 1.0) and r["r"] == pytest.approx(-1)


def test_200000_distinct_scores(spark):
    rows = spark.range(200_000).select((F.rand(3) + F.col("id") / 1e9).alias("s"), (F.rand(4) < 0.5).cast("int").alias("noise")).withColumn("y", F.when(F.rand(5) < 0.6, (F.col("s") > 0.5).cast("int")).otherwise(F.col("noise")))
    rows.write.mode("overwrite").parquet(path := f"{resample.Tables(spark, 'test').root}/items")
    rows = spark.read.parquet(path)
    out = {r["rep"]: r for r in resample.item_bootstrap(rows, "s", "y", 40, 2).collect()}
    data = np.array([(r["s"], r["y"]) for r in rows.select("s", "y").collect()])
    rank = np.argsort(np.argsort(data[:, 0])) + 1
    pos = data[:, 1].sum()
    auroc = (rank[data[:, 1] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(data) - pos))
    assert out[-1]["auroc"] == pytest.approx(auroc) and out[-1]["r"] == pytest.approx(np.corrcoef(data.T)[0, 1])
    spread = statistics.pstdev(out[k]["auroc"] for k in range(40))
    assert abs(statistics.mean(out[k]["auroc"] for k in range(40)) - auroc) < 4 * spread / 40**0.5 and 0.0003 < spread < 0.003


def test_moved_is_a_bijection_and_fair():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for rep in range(5):
            keys = np.random.default_rng([n, rep]).integers(0, 1 << 30, 2 * resample.ROUNDS)
            assert sorted(resample.moved(np.arange(n), n, keys).tolist()) == list(range(n))
    rng, found = np.random.default_rng(2), Counter()
    for _ in range(12000):
        found[tuple(resample.moved(np.arange(4), 4, rng.integers(0, 1 << 30, 2 * resample.ROUNDS)).tolist())] += 1
    assert len(found) == 24 and sum((c - 500) ** 2 / 500 for c in found.values()) < 49.7  # 0.1 % of 23 degrees


def test_trend_equals_python(spark):
    """The same permutations from MD5 and plain integers."""
    rng = random.Random(6)
    n, seed, n_perm = 90, 17, 200
    xs = [float(rng.randrange(4)) for _ in range(n)]
    rows = [(x, x / 4 + rng.gauss(0, 2)) for x in xs]
    md5 = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:8], 16) >> 2
    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    pairs = sorted(zip(ranks([r[0] for r in rows]), ranks([r[1] for r in rows]), strict=True))
    side = next(s for s in range(2, 100, 2) if s == resample.side_of(n))
    own, usual = sum(a * b for a, b in pairs), max(set(a for a, _ in pairs), key=lambda v: ([a for a, _ in pairs].count(v), -v))
    ge = 0
    for rep in range(n_perm):
        dot = usual * sum(b for _, b in pairs)
        for place, (a, _) in enumerate(pairs):
            if a != usual:
                to = place
                while True:
                    left, right = divmod(to, side)
                    for k in range(resample.ROUNDS):
                        left, right = right, (left + (right + md5(seed, rep, k, 0)) * (right + md5(seed, rep, k, 1)) % (2**31 - 1)) % side
                    to = left * side + right
                    if to < n:
                        break
                dot += (a - usual) * pairs[to][1]
        ge += dot >= own - 1e-6
    for parts in (1, 6):
        r = resample.trend_test(spark.createDataFrame(rows, "x double, y double").repartition(parts), "x", "y", n_perm, seed).first()
        assert r["p"] == pytest.approx((ge + 1) / (n_perm + 1))


def test_trend_of_200000_distinct_values(spark):
    rows = spark.range(200_000).select(F.col("id").cast("double").alias("x"), (F.rand(1) + F.col("id") / 1e7).alias("y"))
    r = resample.trend_test(rows, "x", "y", 30, 1).first()
    assert r["n"] == 200_000 and 0 < r["rho"] < 0.1 and r["p"] == pytest.approx(1 / 31)
    flat = spark.range(200_000).select(F.col("id").cast("double").alias("x"), F.rand(2).alias("y"))
    assert 1 / 31 < resample.trend_test(flat, "x", "y", 30, 1).first()["p"] <= 1


@pytest.mark.parametrize("parts", (1, 13))
def test_places_in_keys_of_any_share(spark, parts):
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(400))) for _ in range(2000)] + [(rng.choice("abcdefgh"), rng.gauss(0, 9)) for _ in range(300)] + [(None, 3.0), (None, 4.0), ("null", None), ("one", 7.0)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "key string, v double").repartition(5)
        by = {}
        for k, v in rows:
            if v is not None:
                by.setdefault(k, []).append(v)
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            got = {r["key"]: r["quantile"] for r in resample.index_quantile(df, "v", q, keys=["key"]).collect()}
            assert got == {k: sorted(v)[min(len(v) - 1, int(q * len(v)))] for k, v in by.items()}
        assert {r["key"]: r["median"] for r in resample.exact_median(df, "v", ["key"]).collect()} == {k: statistics.median(v) for k, v in by.items()}
        assert resample.exact_median(df, "v").first()["median"] == statistics.median(v for _, v in rows if v is not None)
        assert resample.index_quantile(df, "v", 1.0, clamp=False).collect() == [] and resample.exact_median(df.limit(0), "v", ["key"]).collect() == [] and resample.exact_median(df.limit(0), "v").first()["median"] is None
        if parts > 1:
            placed = running.keyed_running(df.where("v is not null").groupBy("key", "v").agg(F.count("*").alias("ties")), F.col("ties"), ["key"], "v")
            assert "_p" not in placed.columns and placed.where("key = 'hot'").agg(F.max("n")).first()[0] == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
