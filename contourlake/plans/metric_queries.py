"""Queries of population metrics, statistics, resampling and gates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import gates, metrics, resample, selection
from . import tables as T

TONE = "CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'N' THEN 'M' ELSE 'L' END"
PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)"
TBU = f"tbu AS (SELECT l_orderkey AS clip_id, {PLACE} AS tbu_idx, {TONE} AS target, CASE WHEN l_discount = 0 THEN NULL WHEN l_quantity > 33 THEN 'H' WHEN l_quantity <= 16 THEN 'L' ELSE 'M' END AS pred FROM lineitem)"
TBU2 = f"tbu2 AS (SELECT l_orderkey AS clip_id, {PLACE} AS tbu_idx, {TONE} AS target, CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.055 THEN 'H' WHEN l_tax <= 0.025 THEN 'L' ELSE 'M' END AS pred FROM lineitem)"
STATS = "cs AS (SELECT target, count(*) AS support, count(pred) AS covered, sum(CASE WHEN pred = target THEN 1 ELSE 0 END) AS correct FROM tbu GROUP BY target)"
#: Replicates of a bootstrap, seeds of the scramble floor, permutations of the trend test, and the draws' seed.
N_BOOT, FLOOR_SEEDS, N_PERM, SEED = 1000, 25, 2000, 7
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("class_stats", f"WITH {TBU}, {STATS} SELECT target, support, covered, correct::BIGINT AS correct, round(correct::DOUBLE / nullif(covered, 0), 6) AS recall, round(covered::DOUBLE / support, 6) AS coverage FROM cs")
def class_stats(spark, d):
    return r6(metrics.class_stats(T.tbu(spark, d)), "recall", "coverage")


@query("confusion", f"WITH {TBU} SELECT target, pred, count(*) AS n FROM tbu WHERE pred IS NOT NULL GROUP BY target, pred")
def confusion(spark, d):
    return metrics.confusion(T.tbu(spark, d))


@query("balanced_accuracy", f"WITH {TBU}, {STATS} SELECT round(avg(correct::DOUBLE / nullif(covered, 0)), 6) AS balanced_acc, round(sum(correct)::DOUBLE / sum(covered), 6) AS micro_acc, round(sum(covered)::DOUBLE / sum(support), 6) AS coverage, sum(covered)::BIGINT AS n_covered, sum(support)::BIGINT AS n_tbu FROM cs")
def balanced_accuracy(spark, d):
    return r6(metrics.population(T.tbu(spark, d)), "balanced_acc", "micro_acc", "coverage")


@query("weighted_f1", f"""WITH {TBU}, c AS (SELECT target, pred, count(*) AS n FROM tbu WHERE pred IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT t.tone, (SELECT sum(n) FROM c WHERE target = t.tone) AS a, (SELECT sum(n) FROM c WHERE pred = t.tone) AS s, (SELECT sum(n) FROM c WHERE pred = t.tone AND target = t.tone) AS h FROM (VALUES ('H'), ('M'), ('L')) t(tone))
 SELECT round(sum(coalesce(2.0 * h / (a + s), 0) * a) / sum(a), 6) AS weighted_f1 FROM k""")
def weighted_f1(spark, d):
    return r6(metrics.weighted_f1(T.tbu(spark, d)), "weighted_f1")


KAPPA = "SELECT n, round(CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT count(*) AS n, avg((a = b)::INT) AS po, " + " + ".join(f"avg((a = '{t}')::INT) * avg((b = '{t}')::INT)" for t in "HML") + " AS pe FROM p)"


@query("kappa_vs_target", f"WITH {TBU}, p AS (SELECT pred AS a, target AS b FROM tbu WHERE pred IS NOT NULL) {KAPPA}")
def kappa_vs_target(spark, d):
    return r6(metrics.kappa_vs_target(T.tbu(spark, d)), "kappa")


@query("cocovered_kappa", f"WITH {TBU}, {TBU2}, p AS (SELECT x.pred AS a, y.pred AS b FROM tbu x JOIN tbu2 y USING (clip_id, tbu_idx) WHERE x.pred IS NOT NULL AND y.pred IS NOT NULL) {KAPPA}")
def cocovered_kappa(spark, d):
    pairs = metrics.cocovered(T.tbu(spark, d), T.second(spark, d))
    return r6(metrics.pair_kappa(pairs, "pred_a", "pred_b"), "kappa")


@query("subset_metrics", f"""WITH {TBU}, s AS (SELECT CASE WHEN tbu_idx % 2 = 0 THEN 'minpair' ELSE 'long' END AS kind, * FROM tbu),
 c AS (SELECT coalesce(kind, 'ALL') AS subset, target, count(*) AS support, count(pred) AS covered, sum((pred = target)::INT) AS correct FROM s GROUP BY GROUPING SETS ((kind, target), (target))),
 k AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'minpair' ELSE 'long' END AS kind, CASE WHEN l_discount > 0 THEN l_discount END AS cer, l_tax AS ssim, l_quantity / 50 AS len_ratio FROM lineitem),
 m AS (SELECT coalesce(kind, 'ALL') AS subset, avg(cer) AS cer, avg(ssim) AS ssim, min(ssim) AS ssim_least, avg(len_ratio) AS len_ratio FROM k GROUP BY GROUPING SETS ((kind), ()))
 SELECT subset, round(avg(correct::DOUBLE / nullif(covered, 0)), 6) AS tone_i2, round(sum(covered)::DOUBLE / sum(support), 6) AS coverage, sum(covered)::BIGINT AS n, round(any_value(cer), 6) AS cer, round(any_value(ssim), 6) AS ssim, any_value(ssim_least) AS ssim_least, round(any_value(len_ratio), 6) AS len_ratio FROM c JOIN m USING (subset) GROUP BY subset""")
def subset_metrics(spark, d):
    rows = T.tbu(spark, d).withColumn("kind", F.when(F.col("tbu_idx") % 2 == 0, "minpair").otherwise("long"))
    li = T.table(spark, d, "lineitem")
    clips = li.select(F.when(F.col("l_linenumber") % 2 == 0, "minpair").otherwise("long").alias("kind"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("cer"), F.col("l_tax").alias("ssim"), (F.col("l_quantity") / 50).alias("len_ratio"))
    out = metrics.by_subset(rows, "kind").join(metrics.clip_means(clips, "kind", ["cer", "ssim", "len_ratio"], ["ssim"]), "subset")
    return r6(out, "tone_i2", "coverage", "cer", "ssim", "len_ratio")


@query("tone_by_speaker", f"""WITH {TBU}, x AS (SELECT o_custkey AS speaker_id, target, pred FROM tbu JOIN orders ON clip_id = o_orderkey WHERE pred IS NOT NULL),
 c AS (SELECT speaker_id, target, count(*) AS n, sum((pred = target)::INT) AS k FROM x GROUP BY 1, 2)
 SELECT speaker_id, round(avg(k::DOUBLE / n), 6) AS tone_i2, sum(n)::BIGINT AS n FROM c GROUP BY 1 HAVING sum(n) >= 20""")
def tone_by_speaker(spark, d):
    who = T.manifest(spark, d).select(F.col("id").alias("clip_id"), "speaker_id")
    return r6(metrics.pooled_by(T.tbu(spark, d).join(who, "clip_id"), "speaker_id"), "tone_i2")


@query("speaker_spread", f"SELECT count(*) AS n, round(avg(tone_i2), 6) AS mean, min(tone_i2) AS least, max(tone_i2) AS greatest FROM ({SQL['tone_by_speaker']})")
def speaker_spread(spark, d):
    return tone_by_speaker(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("tone_i2"), 6).alias("mean"), F.min("tone_i2").alias("least"), F.max("tone_i2").alias("greatest"))


def _runs(spark, d):
    """One row per (condition = order priority, seed = order year): a metric table."""
    o = T.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run_tag"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("tone_i2"), F.count("*").cast("double").alias("cer"))


RUNS = "runs AS (SELECT o_orderpriority AS run_tag, year(o_orderdate) AS seed, avg(o_totalprice) AS tone_i2, count(*)::DOUBLE AS cer FROM orders GROUP BY 1, 2), l AS (SELECT run_tag, 'tone_i2' AS metric, tone_i2 AS v FROM runs UNION ALL SELECT run_tag, 'cer', cer FROM runs)"


@query("seed_stats", f"WITH {RUNS} SELECT run_tag, metric, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(stddev_pop(v) / sqrt(count(v)), 4) AS sem, round(min(v), 4) AS least, round(max(v), 4) AS greatest FROM l GROUP BY 1, 2")
def seed_stats(spark, d):
    out = metrics.spread(_runs(spark, d), ["run_tag"], ["tone_i2", "cer"], sample=False)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "sem", "least", "greatest")})


@query("training_seed_stats", f"WITH {RUNS} SELECT run_tag, metric, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(coalesce(stddev_samp(v), 0) / sqrt(count(v)), 4) AS sem, round(min(v), 4) AS least, round(max(v), 4) AS greatest FROM l GROUP BY 1, 2")
def training_seed_stats(spark, d):
    out = metrics.spread(_runs(spark, d), ["run_tag"], ["tone_i2", "cer"], sample=True)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "sem", "least", "greatest")})


@query("band_overlap", f"WITH {RUNS}, s AS (SELECT run_tag, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd FROM l WHERE metric = 'tone_i2' GROUP BY 1) SELECT a.run_tag AS run_a, b.run_tag AS run_b, (a.m - a.sd <= b.m + b.sd AND b.m - b.sd <= a.m + a.sd) AS overlap FROM s a JOIN s b ON a.run_tag < b.run_tag")
def band_overlap(spark, d):
    return metrics.band_overlaps(metrics.spread(_runs(spark, d), ["run_tag"], ["tone_i2"], sample=True), "run_tag")


@query("condition_ablation", f"""WITH {TBU}, x AS (SELECT o_orderpriority AS condition, target, pred FROM tbu JOIN orders ON clip_id = o_orderkey WHERE pred IS NOT NULL),
 c AS (SELECT condition, target, count(*) AS n, sum((pred = target)::INT) AS k FROM x GROUP BY 1, 2), b AS (SELECT condition, avg(k::DOUBLE / n) AS tone_i2 FROM c GROUP BY 1),
 e AS (SELECT o_orderpriority AS condition, avg(l_discount) AS cer, avg(l_tax) AS roundtrip FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), a AS (SELECT * FROM b JOIN e USING (condition)),
 d AS (SELECT a.condition, a.tone_i2, a.cer, a.roundtrip, a.tone_i2 - o.tone_i2 AS d_tone, a.cer - o.cer AS d_cer, a.roundtrip - o.roundtrip AS d_roundtrip FROM a, a o WHERE o.condition = '1-URGENT')
 SELECT condition, round(tone_i2, 6) AS tone_i2, round(cer, 6) AS cer, round(roundtrip, 6) AS roundtrip, round(d_tone, 6) AS d_tone, round(d_cer, 6) AS d_cer, round(d_roundtrip, 6) AS d_roundtrip, CASE WHEN abs(d_cer) < 0.08 AND d_tone < -0.12 AND abs(d_roundtrip) < 0.12 THEN 'CER IS TONE-BLIND' ELSE 'NOT SHOWN' END AS verdict FROM d""")
def condition_ablation(spark, d):
    cond = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.col("o_orderpriority").alias("condition"))
    tone = metrics.population(T.tbu(spark, d).where("pred IS NOT NULL").join(cond, "clip_id"), ["condition"]).select("condition", F.col("balanced_acc").alias("tone_i2"))
    errors = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip_id"), "l_discount", "l_tax").join(cond, "clip_id").groupBy("condition").agg(F.avg("l_discount").alias("cer"), F.avg("l_tax").alias("roundtrip"))
    out = metrics.against(tone.join(errors, "condition"), "condition", "1-URGENT", {"tone_i2": "d_tone", "cer": "d_cer", "roundtrip": "d_roundtrip"})
    return r6(out.withColumn("verdict", gates.tone_blind()), "tone_i2", "cer", "roundtrip", "d_tone", "d_cer", "d_roundtrip")


@query("dose_response", f"""WITH {TBU}, c AS (SELECT tbu_idx AS factor, target, count(pred) AS n, sum((pred = target)::INT) AS k FROM tbu GROUP BY 1, 2), e AS (SELECT l_linenumber AS factor, avg(l_discount) AS cer FROM lineitem GROUP BY 1),
 a AS (SELECT factor, avg(k::DOUBLE / nullif(n, 0)) AS t FROM c GROUP BY 1), s AS (SELECT *, lead(t) OVER (ORDER BY factor) AS nx FROM a LEFT JOIN e USING (factor))
 SELECT count(*) AS n, bool_and(nx IS NULL OR nx <= t + 0.03) AS monotone, round(corr(factor, t), 6) AS r, round(corr(factor, cer), 6) AS r_cer, round(avg(cer), 6) AS mean_cer FROM s""")
def dose_response(spark, d):
    tone = metrics.population(T.tbu(spark, d), ["tbu_idx"]).select(F.col("tbu_idx").alias("factor"), F.col("balanced_acc").alias("tone_i2"))
    cer = T.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("factor")).agg(F.avg("l_discount").alias("cer"))
    return r6(metrics.dose_response(tone.join(cer, "factor", "left"), "factor", "tone_i2", "cer"), "r", "r_cer", "mean_cer")


@query("hours", "SELECT o_orderpriority AS source, round(sum(o_totalprice) / 3600, 4) AS hours, count(DISTINCT o_custkey) AS speakers, count(*) AS clips FROM orders GROUP BY 1")
def hours(spark, d):
    return T.manifest(spark, d).groupBy("source").agg(F.round(F.sum("duration_sec") / 3600, 4).alias("hours"), F.count_distinct("speaker_id").alias("speakers"), F.count("*").alias("clips"))


@query("auroc", """WITH x AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x)
 SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r""")
def auroc(spark, d):
    return r6(metrics.auroc(T.judged(spark, d), "n_chars", "quality"), "auroc")


@query("point_biserial", "SELECT count(*) AS n, round(corr(n_chars::DOUBLE, quality::DOUBLE), 6) AS r FROM labels JOIN documents USING (doc_id)")
def point_biserial(spark, d):
    return r6(metrics.point_biserial(T.judged(spark, d), "n_chars", "quality"), "r")


@query("binary_kappa", "WITH x AS (SELECT (quality = 1)::INT AS a, (n_chars > 1000)::INT AS b FROM labels JOIN documents USING (doc_id)), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM x) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM s")
def binary_kappa(spark, d):
    return r6(metrics.binary_kappa(T.judged(spark, d), F.col("quality") == 1, F.col("n_chars") > 1000), "kappa")


@query("spearman", """WITH x AS (SELECT o_totalprice AS a, o_custkey AS b FROM orders), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
 SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark, d):
    return r6(metrics.spearman(T.table(spark, d, "orders"), "o_totalprice", "o_custkey"), "rho")


@query("wilson_interval", """WITH x AS (SELECT source, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), y AS (SELECT *, k::DOUBLE / n AS p, 1 + (1.95996 * 1.95996) / n AS d FROM x)
 SELECT source, n, k::BIGINT AS k, round(p, 6) AS p, round(greatest(0, (p + (1.95996 * 1.95996) / (2 * n)) / d - 1.95996 * sqrt(p * (1 - p) / n + (1.95996 * 1.95996) / (4 * n * n)) / d), 6) AS lo, round(least(1, (p + (1.95996 * 1.95996) / (2 * n)) / d + 1.95996 * sqrt(p * (1 - p) / n + (1.95996 * 1.95996) / (4 * n * n)) / d), 6) AS hi FROM y""")
def wilson_interval(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "source")
    x = T.table(spark, d, "labels").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    return r6(x.select("source", "n", "k", w["p"].alias("p"), w["lo"].alias("lo"), w["hi"].alias("hi")), "p", "lo", "hi")


#: The lower tail of n fair throws up to m, as a list of its terms.
TAIL = "list_sum(list_transform(range(0, m::BIGINT + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))".replace("m::", "({m})::")


@query("binomial_test", f"""WITH x AS (SELECT source, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), t AS (SELECT *, least(k, n - k) AS m FROM x)
 SELECT source, n, k::BIGINT AS k, round(CASE WHEN 2 * k = n THEN 1.0 ELSE least(1.0, 2 * {TAIL.format(m="m", n="n")}) END, 6) AS p_value FROM t""")
def binomial_test(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "source")
    x = T.table(spark, d, "labels").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    return r6(x.withColumn("p_value", S.binom_two_sided(F.col("k"), F.col("n"))), "p_value")


@query("paired_win_rate", f"""WITH c AS (SELECT count(*) AS n, count_if(l_tax > l_discount)::BIGINT AS wins, count_if(l_tax < l_discount)::BIGINT AS losses, avg(l_tax - l_discount) AS margin FROM lineitem)
 SELECT n, wins, losses, round((wins + 0.5 * (n - wins - losses)) / n, 6) AS win_rate, round(CASE WHEN wins = losses THEN 1.0 ELSE least(1.0, 2 * {TAIL.format(m="least(wins, losses)", n="(wins + losses)")}) END, 6) AS sign_p, round(margin, 6) AS mean_margin FROM c""")
def paired_win_rate(spark, d):
    return r6(metrics.paired_win_rate(T.table(spark, d, "lineitem"), "l_tax", "l_discount"), "win_rate", "sign_p", "mean_margin")


# Multinomial draws are not SQL's; the tests hold the bootstraps against brute force.


@query("bootstrap_lcb")
def bootstrap_lcb(spark, d):
    return r6(resample.bootstrap(resample.clip_counts(T.tbu(spark, d)), resample.balanced(), N_BOOT, SEED, 0.05), "point", "lo")


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return r6(resample.bootstrap(resample.clip_counts(T.tbu(spark, d)), resample.balanced(), N_BOOT, SEED, 0.025, 0.975), "point", "lo", "hi")


@query("bootstrap_kappa")
def bootstrap_kappa(spark, d):
    """At the grain of pairs, covered units and their targets."""
    pairs = resample.pair_counts(T.tbu(spark, d).where("pred IS NOT NULL"), "pred", "target")
    return r6(resample.bootstrap(pairs, resample.counts_kappa(total="c_n"), N_BOOT, SEED, 0.05), "point", "lo")


@query("paired_delta")
def paired_delta(spark, d):
    return r6(resample.bootstrap(resample.clip_counts(T.tbu(spark, d)), resample.balanced() - resample.swapped_balanced(), N_BOOT, SEED, 0.025, 0.975), "point", "lo", "hi")


def permuted_sql(seed):
    h = HASH.format(f"'{seed}|' || clip_id || '|' || tbu_idx")
    return f"(SELECT a.clip_id, a.tbu_idx, b.target, a.pred FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY tbu_idx) AS r FROM tbu) a JOIN (SELECT clip_id, target, row_number() OVER (PARTITION BY clip_id ORDER BY {h}, tbu_idx) AS r FROM tbu) b USING (clip_id, r))"


def balanced_of(rel):
    return f"(SELECT avg(k::DOUBLE / nullif(n, 0)) FROM (SELECT target, count(pred) AS n, sum((pred = target)::INT) AS k FROM {rel} GROUP BY target))"


@query("controls", f"WITH {TBU} SELECT 'shuffled_target' AS control, round({balanced_of(permuted_sql(11))}, 6) AS balanced_acc UNION ALL SELECT 'all_mid', round({balanced_of("(SELECT target, CASE WHEN pred IS NOT NULL THEN 'M' END AS pred FROM tbu)")}, 6) UNION ALL SELECT 'swapped', round({balanced_of("(SELECT CASE target WHEN 'H' THEN 'L' WHEN 'L' THEN 'H' ELSE 'M' END AS target, pred FROM tbu)")}, 6) UNION ALL SELECT 'high_low', round({balanced_of("(SELECT * FROM tbu WHERE target <> 'M')")}, 6)")
def controls(spark, d):
    t = T.placed(spark, d)
    parts = {"shuffled_target": resample.permuted_targets(t, 11), "all_mid": resample.all_mid(t), "swapped": resample.swap_high_low(t), "high_low": resample.only_high_low(t)}
    out = None
    for name, rows in parts.items():
        one = metrics.population(rows).select(F.lit(name).alias("control"), F.round("balanced_acc", 6).alias("balanced_acc"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scramble_floor", f"WITH {TBU}, s AS (" + " UNION ALL ".join(f"SELECT {balanced_of(permuted_sql(s))} AS v" for s in range(FLOOR_SEEDS)) + ") SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM s")
def scramble_floor(spark, d):
    v = metrics.population(resample.permuted_targets(T.tbu(spark, d), *range(FLOOR_SEEDS)), ["seed"])
    return v.agg(F.round(F.avg("balanced_acc"), 6).alias("mean"), F.round(F.stddev_pop("balanced_acc"), 6).alias("std"))


@query("index_quantiles", "WITH r AS (SELECT o_orderpriority AS source, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT source, v AS quantile FROM r WHERE rn = least(n, floor(0.9 * n)::BIGINT + 1)")
def index_quantiles(spark, d):
    return resample.index_quantile(T.manifest(spark, d), "duration_sec", 0.9, keys=["source"])


@query("trend_permutation")
def trend_permutation(spark, d):
    a = metrics.population(T.tbu(spark, d), ["tbu_idx"]).select(F.col("tbu_idx").cast("double").alias("dose"), F.col("balanced_acc").alias("rate"))
    return r6(resample.trend_test(a, "dose", "rate", N_PERM, 3), "rho", "p")


WIDE = f"""w AS (SELECT 'I2' AS instrument, 'tone' AS role, avg(correct::DOUBLE / covered) AS balanced_acc, sum(correct)::DOUBLE / sum(covered) AS micro_acc, sum(covered)::DOUBLE / sum(support) AS coverage,
 max(CASE WHEN target = 'H' THEN correct::DOUBLE / covered END) AS recall_H, max(CASE WHEN target = 'L' THEN correct::DOUBLE / covered END) AS recall_L, max(CASE WHEN target = 'H' THEN covered::DOUBLE / support END) AS coverage_H, max(CASE WHEN target = 'L' THEN covered::DOUBLE / support END) AS coverage_L,
 avg(correct::DOUBLE / covered) - {balanced_of(permuted_sql(11))} AS margin, {balanced_of(permuted_sql(11))} AS shuffled_target FROM cs)"""


def _wide(spark, d):
    t = T.placed(spark, d)
    cs = metrics.class_stats(t)
    at = lambda c, k: F.max(F.when(F.col("target") == k, F.col(c)))
    w = cs.agg(F.avg("recall").alias("balanced_acc"), S.share(F.sum("correct"), F.sum("covered")).alias("micro_acc"), S.share(F.sum("covered"), F.sum("support")).alias("coverage"), *(at(c, k).alias(f"{c}_{k}") for c in ("recall", "coverage", "support") for k in "HL"))
    shuf = metrics.population(resample.permuted_targets(t, 11)).select(F.col("balanced_acc").alias("shuffled_target"))
    mono = metrics.population(resample.all_mid(t)).select(F.col("balanced_acc").alias("monotone"))
    return w.crossJoin(F.broadcast(shuf)).crossJoin(F.broadcast(mono)).select(F.lit("I2").alias("instrument"), F.lit("tone").alias("role"), "*", (F.col("balanced_acc") - F.col("shuffled_target")).alias("margin"))


LAYER_B_SQL = " UNION ALL ".join([f"SELECT instrument, 'micro_acc' AS \"check\", round(micro_acc, 6) AS value, 0.68::DOUBLE AS threshold, micro_acc >= 0.68 AS pass FROM w"] + [f"SELECT instrument, '{c}', round({c}, 6), {x}::DOUBLE, {c} >= {x} FROM w" for c, x in gates.LAYER_B.items()])


@query("tone_gate", f"WITH {TBU}, {STATS}, {WIDE} {LAYER_B_SQL}")
def tone_gate(spark, d):
    return r6(gates.tone_gate(_wide(spark, d)), "value")


@query("tone_gate_verdict", f"WITH {TBU}, {STATS}, {WIDE} SELECT CASE WHEN bool_and(pass) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({LAYER_B_SQL})")
def tone_gate_verdict(spark, d):
    return gates.tone_gate_verdict(_wide(spark, d), ["I2"])


REWARD_COLS = "o_totalprice / 500000 AS tone_acc, CASE WHEN o_orderkey % 11 = 0 THEN 'proportional' ELSE 'forced-align' END AS method, (o_custkey % 100) / 100.0 AS voiced, o_orderkey % 4 AS n_kinds, (o_orderkey % 50) / 100.0 AS cer, (o_custkey % 7) / 7.0 AS ssim, (o_orderkey % 30) / 10.0 AS dur, o_orderpriority AS text"


@query("reward", f"""WITH x AS (SELECT o_orderkey AS id, {REWARD_COLS} FROM orders), g AS (SELECT *, CASE WHEN voiced < 0.35 THEN 'voiced' WHEN method <> 'forced-align' THEN 'align' WHEN cer > 0.25 THEN 'cer' WHEN NOT (dur BETWEEN 0.6 * greatest(0.3, 0.157 * length(text)) AND 1.6 * greatest(0.3, 0.157 * length(text))) THEN 'length' WHEN n_kinds < 2 THEN 'monotone' ELSE 'ok' END AS gate FROM x)
 SELECT id, gate, round(CASE WHEN gate = 'ok' THEN greatest(0, least(1, (tone_acc - 0.15) / 0.85)) + 0.05 * greatest(0, least(1, (ssim - 0.3) / 0.7)) ELSE 0 END, 6)::DOUBLE AS reward FROM g""")
def reward(spark, d):
    o = T.table(spark, d, "orders")
    x = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("tone_acc"), F.when(F.col("o_orderkey") % 11 == 0, "proportional").otherwise("forced-align").alias("method"), ((F.col("o_custkey") % 100) / 100).alias("voiced"), (F.col("o_orderkey") % 4).alias("n_kinds"), ((F.col("o_orderkey") % 50) / 100).alias("cer"), ((F.col("o_custkey") % 7) / 7).alias("ssim"), ((F.col("o_orderkey") % 30) / 10).alias("dur"), F.col("o_orderpriority").alias("text"))
    gate, value = gates.reward()
    return x.select("id", gate.alias("gate"), F.round(value, 6).alias("reward"))


@query("go_no_go", """WITH x AS (SELECT o_custkey AS id, avg((o_orderkey % 50) / 100.0) AS cer, 0.5 + avg((o_orderkey % 10) / 15.0) AS i1_cov, avg((o_orderkey % 9) / 9.0) AS ssim, avg((o_orderkey % 6)) AS len_ratio, 0.4 + avg((o_orderkey % 8) / 10.0) AS coverage, avg((o_orderkey % 13) / 16.0) AS tone_i2 FROM orders GROUP BY 1)
 SELECT id, CASE WHEN cer <= 0.25 AND i1_cov >= 0.8 AND ssim >= 0.4 AND len_ratio <= 2.5 AND coverage >= 0.7 AND tone_i2 >= 1 / 3.0 + 0.04 THEN 'GO' WHEN NOT tone_i2 >= 1 / 3.0 + 0.04 THEN 'NO-GO-FLAT' ELSE 'MIXED' END AS verdict FROM x""")
def go_no_go(spark, d):
    """Means lie at the thresholds often and a sum of floats depends on its order, so each is taken in the order of the keys, on any layout."""
    k, own = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    mean = lambda c: F.avg(c).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    means = {"cer": mean((k % 50) / 100), "i1_cov": 0.5 + mean((k % 10) / 15), "ssim": mean((k % 9) / 9), "len_ratio": mean(k % 6), "coverage": 0.4 + mean((k % 8) / 10), "tone_i2": mean((k % 13) / 16)}
    x = T.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), *(v.alias(c) for c, v in means.items()), F.row_number().over(own).alias("_k")).where("_k = 1")
    return x.select("id", gates.go_no_go().alias("verdict"))


@query("budget_prefix")
def budget_prefix(spark, d):
    m = T.manifest(spark, d)
    return selection.budget_prefix(m, [1e6, 5e6, 15e6], "duration_sec", 3, "id").select("budget", "id")


H3 = HASH.format("'3|' || o_orderkey")
SQL["budget_prefix"] = f"WITH s AS (SELECT o_orderkey AS id, coalesce(sum(o_totalprice) OVER (ORDER BY {H3}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT budget, id FROM s, (VALUES (1e6::DOUBLE), (5e6::DOUBLE), (15e6::DOUBLE)) v(budget) WHERE b < budget"


@query("speaker_cap", "SELECT id, speaker_id FROM (SELECT o_orderkey AS id, o_custkey AS speaker_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def speaker_cap(spark, d):
    return selection.capped(T.manifest(spark, d), "speaker_id", 3, "id").select("id", "speaker_id")


@query("seeded_sample", f"SELECT o_orderkey AS id FROM orders ORDER BY {H3}, o_orderkey LIMIT 25")
def seeded_sample(spark, d):
    return selection.sampled(T.manifest(spark, d), 25, 3, "id").select("id")


@query("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def top_sources(spark, d):
    return T.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)


@query("dominant_speaker", "WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1) SELECT o_orderkey AS id, o_custkey AS speaker_id FROM orders WHERE o_custkey IN (SELECT * FROM t)")
def dominant_speaker(spark, d):
    return selection.dominant(T.manifest(spark, d), "speaker_id").select("id", "speaker_id")


@query("side_assignment", f"SELECT o_orderkey AS id, CASE WHEN {HASH.format("'5|' || o_orderkey")} % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM orders")
def side_assignment(spark, d):
    return T.manifest(spark, d).select("id", selection.random_side(5, F.col("id")).alias("side"))


@query("best_checkpoint", f"WITH {RUNS}, s AS (SELECT run_tag, avg(v) AS tone_i2 FROM l WHERE metric = 'tone_i2' GROUP BY 1) SELECT run_tag, round(tone_i2, 4) AS tone_i2 FROM s ORDER BY s.tone_i2 DESC, run_tag LIMIT 1")
def best_checkpoint(spark, d):
    s = _runs(spark, d).groupBy("run_tag").agg(F.avg("tone_i2").alias("tone_i2"))
    return selection.best_by(s, "tone_i2", "run_tag").withColumn("tone_i2", F.round("tone_i2", 4))


@query("eligible_flips", f"""WITH {TBU}, {TBU2}, b AS (SELECT * FROM tbu UNION ALL SELECT * FROM tbu2), e AS (SELECT clip_id, tbu_idx, target FROM b WHERE target IN ('H', 'L') GROUP BY 1, 2, 3 HAVING bool_and(coalesce(pred = target, false)))
 SELECT clip_id, tbu_idx, target FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY tbu_idx) AS k FROM e) WHERE k <= 2""")
def eligible_flips(spark, d):
    both = T.tbu(spark, d).withColumn("instrument", F.lit("I1")).unionByName(T.second(spark, d).withColumn("instrument", F.lit("I2")))
    return selection.eligible_flips(both.withColumn("t0", F.lit(0.0)), 2).select("clip_id", "tbu_idx", "target")


@query("clip_balanced", f"""WITH {TBU}, c AS (SELECT clip_id, target, count(*) AS n, sum((pred = target)::INT) AS k FROM tbu WHERE pred IS NOT NULL GROUP BY 1, 2) SELECT clip_id, round(avg(k::DOUBLE / n), 6) AS tone_i2, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def clip_balanced(spark, d):
    """Per clip, an estimator of its own: its mean is not the pooled value."""
    return metrics.population(T.tbu(spark, d).where("pred IS NOT NULL"), ["clip_id"]).select("clip_id", F.round("balanced_acc", 6).alias("tone_i2"), F.col("n_covered").alias("n"))
