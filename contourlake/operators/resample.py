"""Bootstrap, permutation and control populations with deterministic draws.

Permutations are keyed by (seed, replicate), so a rerun, a retry and another
engine give the same ones. A bootstrap first reduces its units (clips, pairs or
items) to rows of counts and these to kinds, equal rows with their number. A
replicate draws as many units as there are, with replacement; how often each
kind is drawn is a multinomial, drawn down a tree of kinds (``multinomial``), so
no unit is ever multiplied or joined and any number of kinds will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..storage import Tables
from .metrics import TONES, average_ranks
from .multinomial import drawn, kinds_of
from .running import keyed_running, numbered

Stat = Callable[[str], Column]


def clip_counts(tbu: DataFrame) -> DataFrame:
    """c_HH ... c_LL: each clip's confusion counts."""
    cells = [F.count_if((F.col("target") == t) & (F.col("pred") == p)).alias(f"c_{t}{p}") for t in TONES for p in TONES]
    return tbu.groupBy("clip_id").agg(*cells)


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """c_HH ... c_LL of each pair, one of which is 1 if both sides are in the classes, and c_n, 1."""
    return pairs.select(*(F.coalesce((F.col(a) == t) & (F.col(b) == p), F.lit(False)).cast("long").alias(f"c_{t}{p}") for t in TONES for p in TONES), F.lit(1).cast("long").alias("c_n"))


def balanced(prefix: str = "c_") -> Column:
    """Balanced accuracy from summed confusion counts."""
    recalls = []
    for t in TONES:
        covered = sum((F.col(f"{prefix}{t}{p}") for p in TONES), F.lit(0))
        recalls.append(F.when(covered > 0, F.col(f"{prefix}{t}{t}") / covered))
    kept = F.array_compact(F.array(*recalls))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def swapped_balanced(prefix: str = "c_") -> Column:
    """Balanced accuracy against the key with H and L exchanged."""
    swap = {"H": "L", "L": "H", "M": "M"}
    recalls = []
    for t in TONES:
        covered = sum((F.col(f"{prefix}{t}{p}") for p in TONES), F.lit(0))
        recalls.append(F.when(covered > 0, F.col(f"{prefix}{t}{swap[t]}") / covered))
    kept = F.array_compact(F.array(*recalls))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def counts_kappa(prefix: str = "c_", total: str | None = None) -> Column:
    """Cohen's kappa of target and pred from summed confusion counts; total: the column of all pairs, those outside the classes, too."""
    at = lambda t, p: F.col(f"{prefix}{t}{p}").cast("double")
    n = sum((at(t, p) for t in TONES for p in TONES), F.lit(0.0)) if total is None else F.col(total).cast("double")
    po = sum((at(t, t) for t in TONES), F.lit(0.0)) / n
    pe = sum((sum((at(t, p) for p in TONES), F.lit(0.0)) / n * (sum((at(p, t) for p in TONES), F.lit(0.0)) / n) for t in TONES), F.lit(0.0))
    return F.when(n > 0, S.kappa(po, pe))


def replicates(rows: DataFrame, n_rep: int, seed: int) -> DataFrame:
    """Sums of the count columns c_... of rows over each replicate's draws; rep -1 is the sample itself, of which empty rows are zeros."""
    names = [c for c in rows.columns if c.startswith("c_")]
    kinds = kinds_of(rows.select(*(F.col(c).cast("long").alias(c) for c in names)), names, Tables(rows.sparkSession, "kinds"))

    def use(columns: dict[str, np.ndarray], n: np.ndarray) -> dict[str, np.ndarray]:
        return {c: columns[c].astype(np.int64) @ n for c in names}

    parts = drawn(kinds, 62, n_rep, seed, ", ".join(f"{c} long" for c in names), use)
    none = rows.sparkSession.range(1).select(F.lit(0).alias("g"), F.lit(-1).alias("rep"), *(F.lit(None).cast("long").alias(c) for c in names))
    return parts.unionByName(none).groupBy("rep").agg(*(F.sum(c).alias(c) for c in names))


def _spots(values: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Each key's distinct values with how many are smaller (before), equal (ties) and there at all (n)."""
    live = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    return keyed_running(live, F.col("ties"), keys, value)


def index_quantile(values: DataFrame, value: str, q: float, clamp: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """The value at place floor(q n) of each key's sorted non-NULL values (the last, if clamped and beyond). A key may have any share of the rows."""
    at = F.floor(F.lit(q) * F.col("n"))
    at = F.least(F.col("n") - 1, at) if clamp else at
    return _spots(values, value, keys).where((F.col("before") <= at) & (at < F.col("before") + F.col("ties"))).select(*keys, F.col(value).alias("quantile"))


def exact_median(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The median of each key's non-NULL values, the mean of the middle two for an even number."""
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("ties"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    two = _spots(values, value, keys).where(holds(low) | holds(high)).withColumn("_v", F.col(value).cast("double"))
    return two.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def _place(replicates: DataFrame, value: str, q: float) -> DataFrame:
    """index_quantile of replicates, of which there are as many as the caller asked for."""
    ranked = replicates.where(F.col(value).isNotNull()).select(F.col(value).alias("quantile"), F.row_number().over(Window.orderBy(value)).alias("_rn"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return ranked.where(F.col("_rn") == F.least(F.col("_n"), F.floor(F.lit(q) * F.col("_n")) + 1)).select("quantile")


def bootstrap(rows: DataFrame, stat: Column, n_rep: int, seed: int, lo: float, hi: float | None = None) -> DataFrame:
    """point, lo (and hi) of a statistic over summed counts, all from one sorted list of the replicates."""
    values = Tables(rows.sparkSession, "bootstrap").put("values", replicates(rows, n_rep, seed).select("rep", stat.alias("value")))
    both = values.agg(F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("point"), F.sort_array(F.collect_list(F.when(F.col("rep") >= 0, F.col("value")))).alias("_v")).where(F.size("_v") > 0)
    at = lambda q: F.element_at("_v", F.least(F.size("_v"), F.floor(F.lit(q) * F.size("_v")) + 1).cast("int"))
    return both.select("point", at(lo).alias("lo"), *([] if hi is None else [at(hi).alias("hi")]))


def permuted_targets(tbu: DataFrame, *seeds: int) -> DataFrame:
    """The clip's targets in a hashed order for each seed: the control that keeps each clip's tone counts.

    A clip's units meet once, as a list in one row; a seed orders the list there
    and its rows leave one by one, so no row is shuffled, sorted or joined again
    for a seed.
    """
    unit = F.struct("tbu_idx", "target", "pred")
    clips = tbu.groupBy("clip_id").agg(F.sort_array(F.collect_list(unit)).alias("_u")).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    drawn_order = F.array_sort(F.transform("_u", lambda u: F.struct(S.hash_number(F.col("seed"), F.col("clip_id"), u["tbu_idx"]).alias("h"), u["tbu_idx"].alias("tbu_idx"), u["target"].alias("target"))))
    paired = F.zip_with("_u", drawn_order, lambda u, o: F.struct(u["tbu_idx"].alias("tbu_idx"), o["target"].alias("target"), u["pred"].alias("pred")))
    return clips.select("clip_id", "seed", F.inline(paired)).select("clip_id", "tbu_idx", "seed", "target", "pred")


def all_mid(tbu: DataFrame) -> DataFrame:
    """Every covered unit is called M."""
    return tbu.withColumn("pred", F.when(F.col("pred").isNotNull(), "M"))


def swap_high_low(tbu: DataFrame) -> DataFrame:
    return tbu.withColumn("target", F.when(F.col("target") == "H", "L").when(F.col("target") == "L", "H").otherwise(F.col("target")))


def only_high_low(tbu: DataFrame) -> DataFrame:
    return tbu.where(F.col("target") != "M")


#: Rounds of the keyed bijection, and the prime that its rounds are reduced by.
ROUNDS, PRIME = 8, (1 << 31) - 1


def side_of(n: int) -> int:
    """Half of the bijection's digits: the even number whose square holds n places with room to spare."""
    return 2 * ((int(max(n - 1, 0) ** 0.5) + 1) // 2 + 1)


def round_keys(reps: DataFrame, seed: int) -> DataFrame:
    """rep and keys: two numbers below 2**30 for each round, from MD5 over (seed, rep, round, which)."""
    parts = [F.shiftright(S.hash_number(F.lit(seed), F.col("rep"), F.lit(k), F.lit(w)), 2) for k in range(ROUNDS) for w in (0, 1)]
    return reps.select("rep", F.array(*parts).alias("keys"))


def moved(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where a replicate puts each of the places 0 ... n - 1: a keyed bijection of the square of pairs (l, r), repeated until the place is below n."""
    side, out = side_of(n), np.array(places, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = np.divmod(out[todo], side)
        for a, b in keys.reshape(-1, 2).tolist():
            left, right = right, (left + (right + a) * (right + b) % PRIME) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= n]
    return out


def trend_test(rows: DataFrame, x: str, y: str, n_perm: int, seed: int) -> DataFrame:
    """One-sided permutation test of a rising trend: rho and p = (as large + 1) / (n_perm + 1); p is 1 if rho is undefined.

    Ranks do not change under permutation. Rows get places once; a replicate is a
    keyed bijection of places, so each row's new place is computed where the row
    is and meets the rank there by a join: no sort, no window and no task for a
    replicate. The rank that most rows have counts from zero, so they stay out.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "trend")
    ranked = average_ranks(average_ranks(rows.select(x, y), x, "rx"), y, "ry").select("rx", "ry")
    whole = tables.put("ranks", numbered(ranked, "rx", "ry", out="place"))
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    n, sx, sy, xx, yy, xy = whole.agg(F.count("*"), F.sum("rx"), F.sum("ry"), product("rx", "rx"), product("ry", "ry"), product("rx", "ry")).first()
    vx, vy = ((s2 / n - (s1 / n) ** 2 if n else 0.0) for s1, s2 in ((sx, xx), (sy, yy)))
    if vx <= 1e-12 or vy <= 1e-12:
        return spark.createDataFrame([(n, None, 1.0)], "n long, rho double, p double")
    rho_of = lambda dot: (dot / n - sx / n * sy / n) / (vx * vy) ** 0.5
    usual = {c: whole.groupBy(c).count().orderBy(F.desc("count"), c).first() for c in ("rx", "ry")}
    moving, still = ("rx", "ry") if usual["rx"]["count"] >= usual["ry"]["count"] else ("ry", "rx")
    zero, total = usual[moving][moving], sx if still == "rx" else sy
    keys = round_keys(spark.range(n_perm).withColumnRenamed("id", "rep"), seed).orderBy("rep").collect()  # n_perm rows
    sent = np.array([r["keys"] for r in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, value = b.column(0).to_numpy(), b.column(1).to_numpy()
            for rep, k in enumerate(sent):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), rep)), pa.array(moved(place, n, k)), pa.array(value)], ["rep", "place", "v"])

    dealt = whole.where(F.col(moving) != zero).select("place", (F.col(moving) - zero).alias("v")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place")
    met = dealt.mapInArrow(run, "rep long, place long, v double").join(whole.select("place", still), "place")
    dots = met.groupBy("rep").agg((F.sum(F.col("v") * F.col(still)) + zero * total).alias("dot"))
    ge = F.count_if(rho_of(F.col("dot")) >= rho_of(xy) - 1e-12)
    return dots.agg(F.lit(n).cast("long").alias("n"), F.lit(rho_of(xy)).alias("rho"), ((ge + 1) / F.lit(n_perm + 1.0)).alias("p"))


PARTS = "n double, pos double, u double, ds double, dss double, dsy double, agree double, pick double"


def item_bootstrap(items: DataFrame, score: str, label: str, n_rep: int, seed: int, pick: str | None = None) -> DataFrame:
    """rep, auroc, r (of score and label) and kappa (of pick and label, both 0 or 1) of items drawn with replacement; rep -1 is the sample.

    Equal items are one kind; kinds are ordered by score, so a group of them is a
    range of scores. Each group gives its own pairs of unequal labels and its
    sums; what a group's positives win over all negatives below it is added by
    running totals over the groups of a replicate.
    """
    tables = Tables(items.sparkSession, "items")
    label_col, pick_col = F.col(label).cast("int"), F.col(pick or label).cast("int")
    live = items.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    kinds = tables.put("kinds", live.groupBy(F.col(score).cast("double").alias("s"), label_col.alias("y"), pick_col.alias("m")).agg(F.count("*").alias("w")))
    places = numbered(kinds.groupBy("s").agg(F.sum("w").alias("_w")), "s").select("s", "k")
    n_scores, total, centre = kinds.agg(F.count_distinct("s"), F.sum("w"), F.sum(F.col("s") * F.col("w")) / F.sum("w")).first()
    names = ("auroc", "r", "kappa")
    if not total:
        return items.sparkSession.createDataFrame([], "rep long, auroc double, r double, kappa double")
    bits = max(1, (4 * n_scores - 1).bit_length())
    keyed = tables.put("keyed", kinds.join(places, "s").select((F.col("k") * 4 + F.col("y") * 2 + F.coalesce("m", F.lit(0))).alias("key"), "w", (F.col("s") - centre).alias("s"), "y", "m"))

    def use(columns: dict[str, np.ndarray], drawn: np.ndarray) -> dict[str, np.ndarray]:
        s, y, m = (columns[c].astype(np.float64) for c in ("s", "y", "m"))
        c = drawn.astype(np.float64)
        first = np.flatnonzero(np.r_[True, np.diff(columns["key"] >> 2) != 0])
        up, down = (np.add.reduceat(c * side[:, None], first, axis=0) for side in (y, 1 - y))
        below = np.cumsum(down, axis=0) - down
        return {"n": c.sum(axis=0), "pos": y @ c, "u": (up * (below + down / 2)).sum(axis=0), "ds": s @ c, "dss": (s * s) @ c, "dsy": (s * y) @ c, "agree": (m == y).astype(np.float64) @ c, "pick": m @ c}

    parts = drawn(keyed, bits, n_rep, seed, PARTS, use)
    neg = F.col("n") - F.col("pos")
    below = F.coalesce(F.sum(neg).over(Window.partitionBy("rep").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row per group
    sums = parts.withColumn("u", F.col("u") + F.col("pos") * below).groupBy("rep").agg(*(F.sum(c).alias(c) for c in (f.split()[0] for f in PARTS.split(", "))))
    n, pos = F.col("n"), F.col("pos")
    mean_s, py, pm, po = F.col("ds") / n, pos / n, F.col("pick") / n, F.col("agree") / n
    vs, vy = F.col("dss") / n - mean_s * mean_s, py * (1 - py)
    pe = pm * py + (1 - pm) * (1 - py)
    return sums.select(
        "rep",
        F.when((pos > 0) & (neg > 0), F.col("u") / (pos * neg)).alias(names[0]),
        F.when((vs > 1e-24) & (vy > 1e-24), (F.col("dsy") / n - mean_s * py) / F.sqrt(vs * vy)).alias(names[1]),
        F.when(pe < 1, (po - pe) / (1 - pe)).otherwise((po >= 1).cast("double")).alias(names[2]),
    )


def interval(values: DataFrame, stat: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """stat, point, lo and hi of a column of replicates; missing values are left out."""
    v = values.select("rep", F.col(stat).alias("v"))
    out = v.where("rep < 0").select(F.lit(stat).alias("stat"), F.col("v").alias("point"))
    for name, q in (("lo", lo), ("hi", hi)):
        out = out.join(_place(v.where("rep >= 0"), "v", q).select(F.lit(stat).alias("stat"), F.col("quantile").alias(name)), "stat", "left")
    return out
