import hashlib
import itertools
import random
import statistics
from collections import Counter, defaultdict

import pytest

from contourlake.operators import resample
from contourlake.plans import metric_queries
from contourlake.plans import tables as T


def drawn(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def balanced(cells, key=lambda t: t):
    recalls = [cells[t, key(t)] / n for t in "HML" if (n := sum(cells[t, p] for p in "HML"))]
    return sum(recalls) / len(recalls)


@pytest.fixture(scope="module")
def few(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{data}/lineitem.parquet").where("l_orderkey <= 100").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def kappa(c, n=None):
    n = n or sum(c[t, p] for t in "HML" for p in "HML")
    pe = sum(sum(c[t, p] for p in "HML") * sum(c[p, t] for p in "HML") for t in "HML") / n**2
    return (sum(c[t, t] for t in "HML") / n - pe) / (1 - pe)


def limits(values, draws, qs):
    """Quantiles with room for the draws' own chance: the values at a few places to either side."""
    v = sorted(values)
    return [(v[max(0, int((q - 0.02) * draws))], v[min(draws - 1, int((q + 0.02) * draws))]) for q in qs]


def test_bootstraps_against_plain_resampling(spark, few):
    """Points are exact; limits lie where a thousand plain resamples, of clips or of pairs, put them."""
    clips, pairs = defaultdict(lambda: defaultdict(int)), []
    for r in T.tbu(spark, few).collect():
        clips[r["clip_id"]][r["target"], r["pred"]] += 1
        pairs += [(r["target"], r["pred"])] if r["pred"] else []
    clips = [clips[k] for k in sorted(clips)]
    swap = {"H": "L", "L": "H", "M": "M"}.get
    rng, values = random.Random(1), defaultdict(list)
    for _ in range(1000):
        cells, pool = defaultdict(int), Counter(rng.choices(pairs, k=len(pairs)))
        for c in rng.choices(clips, k=len(clips)):
            for cell, n in c.items():
                cells[cell] += n
        values["acc"].append(balanced(cells))
        values["delta"].append(balanced(cells) - balanced(cells, swap))
        values["kappa"].append(kappa(pool))
    whole = defaultdict(int)
    for c in clips:
        for cell, n in c.items():
            whole[cell] += n
    points = {"acc": balanced(whole), "delta": balanced(whole) - balanced(whole, swap), "kappa": kappa(Counter(pairs))}
    for name, what, qs in (("bootstrap_lcb", "acc", (0.05,)), ("bootstrap_ci", "acc", (0.025, 0.975)), ("bootstrap_kappa", "kappa", (0.05,)), ("paired_delta", "delta", (0.025, 0.975))):
        r = tuple(metric_queries.QUERIES[name](spark, few).first())
        assert r[0] == pytest.approx(points[what], abs=2e-6)
        for have, (lo, hi) in zip(r[1:], limits(values[what], 1000, qs), strict=True):
            assert lo - 1e-6 <= have <= hi + 1e-6, name
        assert tuple(metric_queries.QUERIES[name](spark, few).first()) == r


def test_replicates_are_multinomial_draws_of_all_units(spark):
    """Each replicate draws as many units as there are; kinds come as often as their share says, independently of how rows are laid out."""
    rows = [(1, 0, 1)] * 300 + [(0, 1, 1)] * 100 + [(2, 2, 1)] * 50 + [(k, 9, 1) for k in range(100, 150)]
    df = spark.createDataFrame(rows, "c_a long, c_b long, c_n long")
    out = {r["rep"]: r for r in resample.replicates(df.repartition(3), 2000, 5).collect()}
    assert out == {r["rep"]: r for r in resample.replicates(df.repartition(1), 2000, 5).collect()} and len(out) == 2001
    assert tuple(out[-1][c] for c in ("c_a", "c_b", "c_n")) == tuple(map(sum, zip(*rows, strict=True)))
    assert all(r["c_n"] == 500 for r in out.values())
    for c, k in (("c_a", 0), ("c_b", 1)):
        v = [r[k] for r in rows]
        drawn = [out[rep][c] for rep in range(2000)]
        mean, sd = 500 * statistics.mean(v), (500 * statistics.pvariance(v)) ** 0.5
        assert abs(statistics.mean(drawn) - mean) < 5 * sd / 2000**0.5 and abs(statistics.pstdev(drawn) / sd - 1) < 0.1
    assert [r["rep"] for r in resample.replicates(df.limit(0), 10, 1).collect()] == [-1]


def test_scramble_floor_has_25_seeds(spark, few):
    clips = defaultdict(list)
    for r in T.tbu(spark, few).orderBy("clip_id", "tbu_idx").collect():
        clips[r["clip_id"]].append(r)
    found = []
    for seed in range(25):
        cells = defaultdict(int)
        for k, rows in clips.items():
            for a, b in zip(rows, sorted(rows, key=lambda r: (drawn(seed, k, r["tbu_idx"]), r["tbu_idx"])), strict=True):
                cells[b["target"], a["pred"]] += 1
        found.append(balanced(cells))
    r = metric_queries.QUERIES["scramble_floor"](spark, few).first()
    assert tuple(r) == pytest.approx((statistics.mean(found), statistics.pstdev(found)), abs=2e-6)


def test_trend_has_2000_permutations(spark, few):
    p = metric_queries.QUERIES["trend_permutation"](spark, few).first()["p"] * 2001
    assert p == pytest.approx(round(p), abs=2e-3)


def test_trend_against_all_permutations(spark):
    """With few rows the share of all orders that are as large is known."""
    xs, ys = (1.0, 2.0, 2.0, 3.0, 4.0, 5.0), (0.1, 0.0, 0.4, 0.4, 0.3, 0.9)
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    rx, ry = rank(xs), rank(ys)
    own = sum(a * b for a, b in zip(rx, ry, strict=True))
    share = statistics.mean(sum(a * b for a, b in zip(rx, q, strict=True)) >= own - 1e-9 for q in itertools.permutations(ry))
    for seed in (3, 4):
        r = resample.trend_test(spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double"), "x", "y", 2000, seed).first()
        assert r["n"] == 6 and r["rho"] == pytest.approx(statistics.correlation(rx, ry)) and abs(r["p"] - share) < 0.03
