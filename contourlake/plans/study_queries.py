"""Queries of kits, selections, controls, contours, files and probes, each with its SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import tables as sql_tables
from ..functions import text as X
from ..leaves import backend, synth
from ..operators import conditions, gates, kits, metrics, oracle, pilot, probe, recurrent, resample, selection, signal, sketches
from ..sources import readers, writers
from ..storage import Tables
from ..streaming import monitor, scorer
from . import pipelines
from . import tables as T
from .metric_queries import HASH, STATS, TAIL, TBU, WIDE, _wide, balanced_of, permuted_sql, r6
from .signal_queries import ANSWERS, FRAMES, KEY, PRED, SIGNAL, SPANS, STEP, TONES, WINS, _codes, _key, sql_translate

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- verdicts

MONO = balanced_of("(SELECT target, CASE WHEN pred IS NOT NULL THEN 'M' END AS pred FROM tbu)")


@query("layer0_verdict", f"""WITH {TBU}, {STATS}, {WIDE}, s AS (SELECT max(CASE WHEN target = 'H' THEN support END) AS sh, max(CASE WHEN target = 'L' THEN support END) AS sl FROM cs)
 SELECT CASE WHEN NOT (sh >= 150 AND sl >= 150 AND shuffled_target IS NOT NULL AND {MONO} IS NOT NULL) THEN 'INDETERMINATE'
  WHEN balanced_acc >= 0.52 AND recall_H >= 0.40 AND recall_L >= 0.40 AND {MONO} <= 0.40 AND margin >= 0.08 AND shuffled_target <= 0.40 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM w, s""")
def layer0_verdict(spark, d):
    return gates.layer0_verdict(spark, _wide(spark, d), ["I2"])


@query("layer0_checks", f"""WITH {TBU}, {STATS}, {WIDE}, v AS (SELECT instrument, balanced_acc, recall_H, recall_L, {MONO} AS monotone, margin, shuffled_target FROM w),
 l AS (UNPIVOT v ON balanced_acc, recall_H, recall_L, monotone, margin, shuffled_target INTO NAME "check" VALUE value)
 SELECT "check", round(value, 6) AS value, t::DOUBLE AS threshold, CASE WHEN floor THEN value >= t ELSE value <= t END AS pass FROM l JOIN (VALUES ('balanced_acc', true, 0.52), ('recall_H', true, 0.40), ('recall_L', true, 0.40), ('monotone', false, 0.40), ('margin', true, 0.08), ('shuffled_target', false, 0.40)) x("check", floor, t) USING ("check")""")
def layer0_checks(spark, d):
    return r6(gates.layer0(_wide(spark, d)).select("check", "value", "threshold", "pass"), "value")


@query("export_gate", "SELECT bool_and(o_totalprice > 100) AS export FROM orders")
def export_gate(spark, d):
    return gates.export_gate(T.table(spark, d, "orders").select((F.col("o_totalprice") > 100).alias("salient")), True)


@query("controls_compared", f"""WITH {TBU}, r AS (SELECT 'I2' AS instrument, {balanced_of("tbu")} AS balanced_acc, {balanced_of(permuted_sql(11))} AS shuffled_target, {MONO} AS all_mid)
 SELECT instrument, round(balanced_acc, 6) AS balanced_acc, round(shuffled_target, 6) AS shuffled_target, NULL::DOUBLE AS monotone, round(all_mid, 6) AS all_mid, round(balanced_acc - shuffled_target, 6) AS margin FROM r""")
def controls_compared(spark, d):
    t = T.placed(spark, d)
    of = lambda rows, name: metrics.population(rows).select(F.lit("I2").alias("instrument"), F.lit(name).alias("control"), "balanced_acc")
    controls = of(resample.permuted_targets(t, 11), "shuffled_target").unionByName(of(resample.all_mid(t), "all_mid"))
    return r6(oracle.compared(of(t, "").drop("control"), controls), "balanced_acc", "shuffled_target", "monotone", "all_mid", "margin")


@query("generated_against_shuffled", "WITH g AS (SELECT o_orderpriority AS instrument, avg(o_totalprice) / 400000 AS gen FROM orders WHERE o_orderpriority < '5' GROUP BY 1), s AS (SELECT o_orderpriority AS instrument, avg(o_custkey) / 5000 AS shuf FROM orders WHERE o_orderpriority > '2' GROUP BY 1) SELECT instrument, round(gen, 6) AS gen, round(shuf, 6) AS shuf, round(gen - shuf, 6) AS margin, CASE WHEN gen IS NULL OR shuf IS NULL THEN 'missing' ELSE 'ok' END AS status FROM g FULL JOIN s USING (instrument)")
def generated_against_shuffled(spark, d):
    o = T.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "instrument")
    g = o.where("instrument < '5'").groupBy("instrument").agg((F.avg("o_totalprice") / 400000).alias("micro_acc"))
    s = o.where("instrument > '2'").groupBy("instrument").agg((F.avg("o_custkey") / 5000).alias("micro_acc"))
    return r6(oracle.generated_against_shuffled(g, s), "gen", "shuf", "margin")


# --- kits and pooled results

TRIALS = "k AS (SELECT l_orderkey || '|' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pair_id, l_linenumber = 1 AS is_catch, CASE WHEN l_quantity > 5 THEN l_tax END AS fc, l_discount AS ff, l_quantity / 50 AS dc, l_tax * 10 AS df FROM lineitem)"


def _trials(spark, d):
    li = T.table(spark, d, "lineitem").withColumn("n", T._place())
    return li.select(
        F.concat_ws("|", "l_orderkey", "n").alias("pair_id"), (F.col("l_linenumber") == 1).alias("is_catch"), F.when(F.col("l_quantity") > 5, F.col("l_tax")).alias("tone_i2_frozen_correct"), F.col("l_discount").alias("tone_i2_frozen_flipped"),
        (F.col("l_quantity") / 50).alias("tone_i2_deployed_correct"), (F.col("l_tax") * 10).alias("tone_i2_deployed_flipped"),
    )


@query("paired_blocks", f"""WITH {TRIALS}, b AS (SELECT 'frozen' AS block, fc AS c, ff AS f FROM k WHERE NOT is_catch UNION ALL SELECT 'deployed', dc, df FROM k WHERE NOT is_catch),
 s AS (SELECT block, count(*) AS usable, count_if(c > f)::BIGINT AS wins, count_if(c < f)::BIGINT AS losses, count_if(c = f)::BIGINT AS ties FROM b WHERE c IS NOT NULL AND f IS NOT NULL GROUP BY 1) SELECT *, round((wins + 0.5 * ties) / usable, 6) AS win_rate, round(CASE WHEN wins = losses THEN 1.0 ELSE least(1.0, 2 * {TAIL.format(m="least(wins, losses)", n="(wins + losses)")}) END, 6) AS sign_p FROM s""")
def paired_blocks(spark, d):
    return r6(metrics.paired_blocks(_trials(spark, d)), "win_rate", "sign_p")


@query("margins", f"WITH {TRIALS} SELECT count(*) AS n, round(avg(fc - ff), 6) AS mean, round(min(fc - ff), 6) AS least FROM k WHERE NOT is_catch AND fc IS NOT NULL AND ff IS NOT NULL")
def margins(spark, d):
    return metrics.margins(_trials(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean"), F.round(F.min("margin"), 6).alias("least"))


SIDE = f"CASE WHEN {HASH.format("'5|' || item_id")} % 2 = 0 THEN 'A' ELSE 'B' END"


@query("judged_pairs", f"WITH {ANSWERS}, {KEY} SELECT rater, count(*) AS n, sum((CASE label WHEN 'ok' THEN 'A' ELSE 'B' END = {SIDE})::INT)::BIGINT AS correct FROM ans JOIN key USING (item_id) WHERE NOT is_catch AND label <> 'unsure' GROUP BY 1")
def judged_pairs(spark, d):
    a = pilot.answer_rows(_codes(spark, d), order="sitting").withColumn("label", F.when(F.col("label") == "ok", "a").when(F.col("label") == "bad", "b").otherwise("unsure"))
    k = _key(spark, d).withColumns({"pair_id": F.col("item_id"), "correct_side": selection.random_side(5, F.col("item_id"))})
    return pilot.judged_pairs(a, k).groupBy("rater").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))


@query("pooled_items", f"WITH {ANSWERS}, {KEY}, t AS (SELECT rater FROM ans JOIN key USING (item_id) GROUP BY 1 HAVING count_if(is_catch) >= 5 AND count_if(is_catch AND label = coalesce(catch_expected, 'ok')) >= 5) SELECT count(*) AS n, count(DISTINCT rater) AS raters, sum((label = 'ok')::INT)::BIGINT AS ok, sum((tone_i2 >= 0.5)::INT)::BIGINT AS metric FROM ans JOIN key USING (item_id) WHERE NOT is_catch AND tone_i2 IS NOT NULL AND label <> 'unsure' AND rater IN (SELECT rater FROM t)")
def pooled_items(spark, d):
    a = pilot.answer_rows(_codes(spark, d), order="sitting")
    k = _key(spark, d)
    items = pilot.pooled(pilot.scored_items(a, k, 0.5), pilot.rater_gate(pilot.rater_tallies(a, k)))
    return items.agg(F.count("*").alias("n"), F.count_distinct("rater").alias("raters"), F.sum("human").alias("ok"), F.sum("metric").alias("metric"))


@query("pilot_result")
def pilot_result(spark, d):
    """Bootstrap limits of AUROC, r and kappa; tests hold them against plain resampling."""
    out = pilot.pilot_result(pilot.answer_rows(_codes(spark, d), order="sitting"), _key(spark, d), 0.5)
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


@query("kit_items", "SELECT source, is_catch, count(*) AS n, count(catch_expected) AS expected FROM (SELECT CASE WHEN item_id % 3 = 0 THEN 'native' WHEN item_id % 3 = 1 THEN 'model' END AS source, item_id % 3 = 2 AS is_catch, CASE WHEN item_id % 3 = 2 THEN 'bad' END AS catch_expected FROM benchmark) GROUP BY 1, 2")
def kit_items(spark, d):
    b = T.table(spark, d, "benchmark").select(F.col("item_id").alias("clip_id"), "text")
    part = lambda k: b.where(F.col("clip_id") % 3 == k)
    return selection.kit_items(part(0), part(1), part(2).withColumn("catch_expected", F.lit("bad"))).groupBy("source", "is_catch").agg(F.count("*").alias("n"), F.count("catch_expected").alias("expected"))


@query("round_robin", "WITH n AS (SELECT n_nationkey AS native, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation), c AS (SELECT s_suppkey AS catch, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT catch, native FROM c JOIN n ON k = i % (SELECT count(*) FROM n)")
def round_robin(spark, d):
    return selection.round_robin(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("catch")), T.table(spark, d, "nation").select(F.col("n_nationkey").alias("native")), "catch", "native").select("catch", "native")


@query("clone_diversity", "WITH p AS (SELECT l_suppkey, avg(l_tax) AS v, avg(l_discount) AS o FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS n_voices, count_if(v > o)::BIGINT AS n_ok, avg(v) AS to_voice, avg(o) AS to_other FROM p) SELECT n_voices, n_ok, round(to_voice, 6) AS to_voice, round(to_other, 6) AS to_other, n_voices >= 2 AND to_voice > to_other + 0.05 AND n_ok >= (n_voices + 1) // 2 AS intact FROM s")
def clone_diversity(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("speaker_id"), F.col("l_tax").alias("to_voice"), F.col("l_discount").alias("to_other"))
    return r6(signal.clone_diversity(rows), "to_voice", "to_other")


# --- selections and sets

H3 = HASH.format("'3|' || o_orderkey")
PREFIX = f"SELECT o_orderkey AS id FROM (SELECT o_orderkey, coalesce(sum(o_totalprice) OVER (ORDER BY {H3}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 5e6"


@query("remainder", f"WITH dev AS ({PREFIX}) SELECT o_orderpriority AS source, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM dev) GROUP BY 1")
def remainder(spark, d):
    m = T.manifest(spark, d)
    return selection.remainder(m, selection.budget_prefix(m, [5e6], "duration_sec", 3, "id"), "id").groupBy("source").agg(F.count("*").alias("n"))


@query("train_and_dev", f"WITH dev AS ({PREFIX}) SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM dev) OR o_orderkey % 97 = 0")
def train_and_dev(spark, d):
    m = T.manifest(spark, d)
    return selection.train_and_dev(m, selection.budget_prefix(m, [5e6], "duration_sec", 3, "id"), m.where("id % 97 = 0"), "id").select("id")


@query("anchored", "SELECT o_orderpriority AS run_tag, round(avg(o_totalprice), 4) AS v, NULL::VARCHAR AS kind FROM orders GROUP BY 1 UNION ALL SELECT 'native', 0.58, 'anchor' UNION ALL SELECT 'chance', 0.333, 'anchor'")
def anchored(spark, d):
    points = T.manifest(spark, d).groupBy(F.col("source").alias("run_tag")).agg(F.round(F.avg("duration_sec"), 4).alias("v"))
    return selection.anchored(points, spark.createDataFrame([("native", 0.58, "anchor"), ("chance", 0.333, "anchor")], "run_tag string, v double, kind string"))


@query("first_passing", f"SELECT o_custkey AS speaker_id, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {H3}, o_orderkey) AS k FROM orders WHERE o_totalprice > 150000) WHERE k = 1")
def first_passing(spark, d):
    m = T.manifest(spark, d).withColumn("ok", F.col("duration_sec") > 150000)
    return selection.first_passing(m, "speaker_id", "ok", S.hash_number(F.lit(3), F.col("id")), "id").select("speaker_id", "id")


@query("with_paths", "SELECT o_orderkey AS id, 'clip_' || o_orderkey || '.wav' AS path FROM orders WHERE o_orderkey % 5 = 0")
def with_paths(spark, d):
    m = T.manifest(spark, d).select("id")
    return selection.with_paths(m, m.where("id % 5 = 0").withColumn("path", F.format_string("clip_%d.wav", "id")))


@query("grid", "SELECT n_name AS checkpoint, s.range AS seed, r_name AS line FROM nation, range(0, 3) s, region")
def grid(spark, d):
    return metrics.grid(T.table(spark, d, "nation").select(F.col("n_name").alias("checkpoint")), spark.range(3).toDF("seed"), T.table(spark, d, "region").select(F.col("r_name").alias("line")))


@query("ordered", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 1")
def ordered(spark, d):
    x = T.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("v"))
    return metrics.ordered(x, ascending=["n"], descending=["v"])


@query("salience", "WITH x AS (SELECT o_orderkey AS id, (o_custkey % 50) / 5.0 AS f, (o_orderkey % 30) / 5.0 AS c, (o_orderkey % 17) / 4.0 - 2 AS r, CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'M' END AS pred, CASE WHEN o_custkey % 2 = 0 THEN 'H' ELSE 'L' END AS expect FROM orders) SELECT id, round(abs(f - c), 6)::DOUBLE AS realized_st, abs(f - c) >= 3 AND CASE WHEN expect = 'H' THEN r >= 1 ELSE r <= -1 END AND pred = expect AS passed FROM x")
def salience(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pred = F.when(k % 3 == 0, "H").when(k % 3 == 1, "L").otherwise("M")
    s = selection.salience((c % 50) / 5, (k % 30) / 5, (k % 17) / 4 - 2, F.lit(0.0), pred, F.when(c % 2 == 0, "H").otherwise("L"))
    return T.table(spark, d, "orders").select(k.alias("id"), s.alias("s")).select("id", F.round("s.realized_st", 6).alias("realized_st"), "s.passed")


@query("training_steps", "SELECT o_custkey AS id, greatest(50, round_even(10 * count(*) / 41.3, 0))::INT AS steps FROM orders GROUP BY 1")
def training_steps(spark, d):
    return T.manifest(spark, d).groupBy(F.col("speaker_id").alias("id")).agg(F.count("*").alias("n")).select("id", S.training_steps(F.col("n"), 10, 41.3).alias("steps"))


# --- texts

@query("plain_texts", r"SELECT lang, count(DISTINCT trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))) AS n FROM documents GROUP BY 1")
def plain_texts(spark, d):
    return T.table(spark, d, "documents").groupBy("lang").agg(F.count_distinct(X.plain_text(F.col("text"))).alias("n"))


FLAT = {chr(c): k for c in X.LATIN if (k := X.unicodedata.normalize("NFC", "".join(m for m in X.unicodedata.normalize("NFD", chr(c)) if m not in X.TONE_OF_MARK))) != chr(c) and len(k) == 1}


@query("align_texts", f"SELECT doc_id, md5(lower({sql_translate('text', FLAT)})) AS digest FROM documents")
def align_texts(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.md5(X.flat_for_align(F.col("text")).cast("binary")).alias("digest"))


@query("first_replaced", "SELECT doc_id, CASE WHEN strpos(text, source) > 0 THEN 1 ELSE 0 END AS found, md5(CASE WHEN strpos(text, 'the') > 0 THEN substr(text, 1, strpos(text, 'the') - 1) || 'THE' || substr(text, strpos(text, 'the') + 3) ELSE text END) AS digest FROM documents")
def first_replaced(spark, d):
    docs = T.table(spark, d, "documents")
    new = X.first_replaced(F.col("text"), F.lit("the"), F.lit("THE"))
    return docs.select("doc_id", F.when(F.instr("text", F.col("source")) > 0, 1).otherwise(0).alias("found"), F.md5(new.cast("binary")).alias("digest"))


@query("probe_lines", "WITH w AS (SELECT n_nationkey AS id, n_name AS text, (row_number() OVER (ORDER BY n_nationkey::VARCHAR) - 1) % 5 AS k FROM nation) SELECT w.id::VARCHAR AS id, 'minpair' AS kind, 'Mo rí ' || w.text || ' ' || r_name AS text FROM w JOIN region ON r_regionkey = k UNION ALL SELECT 'long' || item_id, 'long', text FROM benchmark WHERE item_id % 7 = 0")
def probe_lines(spark, d):
    words = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text"))
    carriers = T.table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("Mo rí ___ "), "r_name").alias("template"))
    long = T.table(spark, d, "benchmark").where("item_id % 7 = 0").select(F.concat(F.lit("long"), "item_id").alias("id"), "text")
    return selection.probe_lines(words, carriers, long, 1)


@query("bad_tags", "WITH x AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(lower(source || ',' || lang || ' , x'), ','), lambda t: trim(t)), lambda t: t <> '')) AS t FROM documents) SELECT doc_id, len(list_filter(t, lambda v: v NOT IN ('en', 'de', 'src1')))::INT AS n FROM x")
def bad_tags(spark, d):
    tags = X.bad_tags(F.concat("source", F.lit(","), "lang", F.lit(" , x")), ["en", "de", "src1"])
    return T.table(spark, d, "documents").select("doc_id", F.size(tags).alias("n"))


# --- pitch

@query("transition_scores", f"{SIGNAL}, {STEP}, p AS (SELECT clip_id, CASE WHEN g > 0 THEN 'R' WHEN g < 0 THEN 'F' ELSE 'level' END AS target, CASE WHEN s IS NULL THEN NULL WHEN s >= 0.6 THEN 'R' WHEN s <= -0.9 THEN 'F' ELSE 'level' END AS pred FROM step WHERE k > 1) SELECT clip_id, round(sum((pred = target)::INT)::DOUBLE / nullif(count(pred), 0), 6) AS accuracy, round(count(pred)::DOUBLE / count(*), 6) AS coverage, count(pred) AS n_scored, count(*) AS n_trans FROM p GROUP BY 1")
def transition_scores(spark, d):
    steps = signal.transitions(T.residuals(spark, d))
    return r6(signal.clip_scores(steps).withColumnRenamed("n_tbu", "n_trans"), "accuracy", "coverage")


@query("v1_scores", f"WITH {FRAMES}, {SPANS}, {WINS}, ref AS (SELECT clip_id, median(f0) AS r FROM frames GROUP BY 1), m AS (SELECT w.clip_id, w.tbu_idx, median(f0) AS m FROM wins w JOIN frames f ON f.clip_id = w.clip_id AND t >= t0 AND t <= t1 GROUP BY 1, 2), p AS (SELECT clip_id, target, 12 * log2(m / r) AS c FROM wins LEFT JOIN m USING (clip_id, tbu_idx) LEFT JOIN ref USING (clip_id)) SELECT clip_id, round(avg((CASE WHEN c > 0.8 THEN 'H' WHEN c < -0.8 THEN 'L' ELSE 'M' END = target)::INT), 6) AS accuracy, count(*) AS n_tbu, 'proportional' AS method FROM p GROUP BY 1")
def v1_scores(spark, d):
    w = T.windows(spark, d)
    return r6(signal.v1_scores(T.frames(spark, d), w, w.select("clip_id").distinct().withColumn("method", F.lit("proportional"))), "accuracy")


@query("frozen_centres", f"{SIGNAL}, {PRED}, z AS (SELECT clip_id, tbu_idx, target, res - 10 - clip_id % 7 AS c FROM res WHERE clip_id % 5 > 0) SELECT clip_id, count(*) AS n, count_if(c >= 1)::BIGINT AS h, count_if(c <= -1)::BIGINT AS l FROM z WHERE c IS NOT NULL GROUP BY 1")
def frozen_centres(spark, d):
    res = T.residuals(spark, d)
    mids = res.select("clip_id").distinct().where("clip_id % 5 > 0").withColumn("mid", 10 + F.col("clip_id") % 7)
    out = signal.classify(res, mid_ref=mids).where("pred IS NOT NULL")
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == "H").alias("h"), F.count_if(F.col("pred") == "L").alias("l"))


@query("fitting_windows", f"WITH {FRAMES}, {SPANS}, {WINS}, u AS (SELECT DISTINCT clip_id, CASE WHEN clip_id % 3 = 0 THEN 5 ELSE 6 END AS n FROM wins) SELECT clip_id, n::BIGINT AS units, CASE WHEN n = 6 THEN 6 ELSE 0 END::BIGINT AS aligned FROM u")
def fitting_windows(spark, d):
    w = T.windows(spark, d)
    tones = w.select("clip_id").distinct().withColumn("tones", F.when(F.col("clip_id") % 3 == 0, F.array(*map(F.lit, "HMLHM"))).otherwise(F.array(*map(F.lit, "HMLHML"))))
    return signal.fitting_windows(w, tones).groupBy("clip_id").agg(F.count("*").alias("units"), F.count("t0").alias("aligned"))


@query("median_in_span", f"WITH {FRAMES}, {SPANS} SELECT f.clip_id, round(12 * log2(greatest(median(f0), 1e-6) / 100), 6) AS st FROM frames f JOIN spans s ON f.clip_id = s.clip_id AND t >= v0 AND t < (v0 + v1) / 2 WHERE f0 IS NOT NULL GROUP BY 1")
def median_in_span(spark, d):
    f = T.frames(spark, d)
    spans = signal.voiced_span(f).select("clip_id", F.col("v0").alias("e0"), ((F.col("v0") + F.col("v1")) / 2).alias("e1"))
    return r6(signal.median_in_span(f, spans), "st")


@query("reimposed", f"WITH {FRAMES}, {SPANS}, k AS (SELECT f.* FROM frames f JOIN spans s ON f.clip_id = s.clip_id WHERE NOT (t >= v0 AND t < (v0 + v1) / 2) OR f0 IS NOT NULL) SELECT clip_id, count(*) AS n, count(f0) AS voiced, round(sum(f0), 4) AS total FROM k GROUP BY 1")
def reimposed(spark, d):
    f = T.frames(spark, d)
    spans = signal.voiced_span(f).where("v0 IS NOT NULL").select("clip_id", F.col("v0").alias("e0"), ((F.col("v0") + F.col("v1")) / 2).alias("e1"))
    out = signal.set_contour(f.join(spans.select("clip_id"), "clip_id"), spans, signal.contour_points(f, spans))
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), F.count("f0").alias("voiced"), F.round(F.sum("f0"), 4).alias("total"))


@query("flip_contour", f"WITH {FRAMES}, {SPANS}, p AS (SELECT clip_id, v0 + i * 0.01 AS t FROM (SELECT clip_id, v0, unnest(range(0, 21)) AS i FROM spans WHERE v0 IS NOT NULL)) SELECT clip_id, count(*) AS n, round(sum(100 * pow(2, (3 - 0.5 * t / 1000) / 12)), 4) AS total FROM p GROUP BY 1")
def flip_contour(spark, d):
    spans = signal.voiced_span(T.frames(spark, d)).where("v0 IS NOT NULL").select("clip_id", F.col("v0").alias("e0"), (F.col("v0") + 0.2).alias("e1"), F.lit(3.0).alias("r"), F.lit(-0.0005).alias("slope"))
    return signal.flip_contour(spans).groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.sum("f0"), 4).alias("total"))


@query("neighbour_edges", f"WITH {FRAMES}, {SPANS}, {WINS}, e AS (SELECT clip_id, tbu_idx, CASE WHEN tbu_idx % 3 <> 1 THEN t0 END AS t0, CASE WHEN tbu_idx % 3 <> 1 THEN t1 END AS t1 FROM wins) SELECT clip_id, tbu_idx, last_value(t1 IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY tbu_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS \"left\", first_value(t0 IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY tbu_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS \"right\" FROM e")
def neighbour_edges(spark, d):
    w = T.windows(spark, d)
    live = F.col("tbu_idx") % 3 != 1
    return signal.neighbour_edges(w.withColumns({"t0": F.when(live, F.col("t0")), "t1": F.when(live, F.col("t1"))})).select("clip_id", "tbu_idx", "left", "right")


@query("confidence_sweep", "WITH s AS (SELECT l_orderkey AS clip_id, l_linenumber / 10.0 AS confidence, max(l_quantity) / 50 AS coverage FROM lineitem GROUP BY 1, 2) SELECT clip_id, confidence::DOUBLE AS confidence, coverage FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN coverage >= 0.6 THEN confidence END DESC NULLS LAST, confidence) AS k FROM s) WHERE k = 1")
def confidence_sweep(spark, d):
    s = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id"), (F.col("l_linenumber") / 10).alias("confidence")).agg((F.max("l_quantity") / 50).alias("coverage"))
    return signal.confidence_sweep(s).select("clip_id", "confidence", "coverage")


@query("flat_condition", f"WITH {FRAMES}, m AS (SELECT clip_id, avg(f0) AS m FROM frames GROUP BY 1) SELECT 'flat|' || clip_id AS clip_id, count(f0) AS n, round(sum(CASE WHEN f0 IS NOT NULL THEN m END), 4) AS total FROM frames JOIN m USING (clip_id) GROUP BY 1")
def flat_condition(spark, d):
    f, _ = conditions.applied(T.frames(spark, d), T.windows(spark, d), ["flat"])
    return f.groupBy("clip_id").agg(F.count("f0").alias("n"), F.round(F.sum("f0"), 4).alias("total"))


def _signal(spark, d):
    """Frames and windows, written once for plans that read them many times."""
    t = Tables(spark, "signal")
    return t.put_large("frames", T.frames(spark, d)), t.put_large("windows", T.windows(spark, d))


@query("sql_units", f"SELECT lang, target, count(*) AS n, sum(i)::BIGINT AS places FROM (SELECT lang, translate(substr(s, i::INT + 1, 1), '{''.join(X.STAND_IN.values())}', '{''.join(X.STAND_IN)}') AS target, i FROM (SELECT lang, s, unnest(range(0, length(s)::BIGINT)) AS i FROM (SELECT lang, {TONES} AS s FROM documents))) GROUP BY 1, 2")
def sql_units(spark, d):
    """Tone-bearing units of all texts, by a table function in SQL."""
    sql_tables.register_tables(spark)
    return spark.sql("SELECT lang, target, count(*) AS n, sum(tbu_idx) AS places FROM {docs}, LATERAL tbu_rows(text) GROUP BY lang, target", docs=T.table(spark, d, "documents").select("lang", "text"))


@query("sql_conditions", f"WITH {FRAMES}, m AS (SELECT clip_id, avg(f0) AS m FROM frames GROUP BY 1), c AS (SELECT clip_id, unnest(['original', 'roundtrip', 'flat', 'half']) AS condition, f0, m FROM frames JOIN m USING (clip_id)) SELECT condition, clip_id, count(f0) AS n, round(sum(CASE condition WHEN 'flat' THEN CASE WHEN f0 IS NOT NULL THEN m END WHEN 'half' THEN m + 0.5 * (f0 - m) ELSE f0 END), 4) AS total FROM c GROUP BY 1, 2")
def sql_conditions(spark, d):
    """Every clip under every condition, by a table function in SQL."""
    sql_tables.register_tables(spark)
    nested = T.frames(spark, d).groupBy("clip_id").agg(F.collect_list(F.struct("t", "f0")).alias("frames"))
    return spark.sql("SELECT condition, clip_id, count(f0) AS n, round(sum(f0), 4) AS total FROM {clips}, LATERAL all_conditions(frames) GROUP BY condition, clip_id", clips=nested)


@query("sketched_manifest")
def sketched_manifest(spark, d):
    """Opt-in sketches stored by source and merged, beside the exact values; the tests hold them to their bounds."""
    path, m = Tables(spark, "sketches").root, T.manifest(spark, d)
    sketches.store(sketches.sketched(m, ["duration_sec"], ["speaker_id"], ["source"]), path, "source")
    about = sketches.approximate(sketches.merged(spark.read.parquet(path)), (0.5,))
    exact = resample.exact_median(m, "duration_sec").crossJoin(F.broadcast(m.agg(F.count_distinct("speaker_id").alias("speakers"))))  # one row each
    return about.crossJoin(F.broadcast(exact))


@query("flip_oracle_run")
def flip_oracle_run(spark, d):
    """Edits, scores and summarises; the tests hold the oracle against clips whose tones are known."""
    rows = Tables(spark, "oracle").put_large("rows", oracle.run(*_signal(spark, d), {"I2": oracle.absolute_meter()}))
    return r6(pilot.oracle_summary(rows, 1.0).withColumn("detect_by_k", pilot.by_k("detect_by_k")).crossJoin(F.broadcast(oracle.trend(rows, "I2").drop("n"))), "false_flip_rate", "control_trip", "strong_detect", "trend_rho", "trend_p")


@query("ab_pairs")
def ab_pairs(spark, d):
    """The tests hold the pairs against clips whose tones are known."""
    out = kits.ab_pairs(*_signal(spark, d)).drop("variant", "e0", "e1")
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


@query("native_anchor")
def native_anchor(spark, d):
    return r6(pipelines.native_anchor(T.tbu(spark, d)), "point", "lo", "hi")


@query("answer_key_oracle")
def answer_key_oracle(spark, d):
    out = pipelines.answer_key_oracle(T.tbu(spark, d))
    return r6(out, *out.columns)


#: Tones of a part's clip: its number in base 3, four digits, all three tones before them.
LETTERS = {"H": "á", "M": "a", "L": "à"}
PART_TONES = "'HML' || translate(" + " || ".join(f"(p_partkey // {3**k} % 3)::INT::VARCHAR" for k in range(4)) + ", '012', 'HML')"


def _clips(spark, d):
    """A hummed clip per part, made in the tasks: what it says is in the part's number."""
    digits = F.concat(F.lit("HML"), F.translate(F.concat(*(F.expr(f"cast(p_partkey div {3**k} % 3 as string)") for k in range(4))), "012", "HML"))
    rows = T.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("clip_id"), digits.alias("tones")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    said = F.array_join(F.transform(F.split("tones", ""), lambda t: F.concat(F.lit("b"), F.translate(t, "HML", "".join(LETTERS[k] for k in "HML")))), " ")
    return synth.clips(rows.select("clip_id", said.alias("text"), "tones"))


@query("audio_tones", f"WITH p AS (SELECT p_partkey::VARCHAR AS clip_id, {PART_TONES} AS tones FROM part) SELECT clip_id, 'proportional' AS method, i::INT AS tbu_idx, substr(tones, i::INT + 1, 1) AS target, substr(tones, i::INT + 1, 1) AS pred FROM p, range(0, 7) r(i)")
def audio_tones(spark, d):
    """From a part's number to audio, from audio to tones: each unit must be heard as what the number says."""
    pre = Tables(spark, "precomputed").put("clips", backend.precompute(_clips(spark, d)))
    mids = pre.select("clip_id", F.lit(12 * math.log2(1.4)).alias("mid"))
    units = backend.units_of(pre)
    heard = signal.classify(signal.residuals(units, signal.fw_slope(units)), mid_ref=mids)
    return heard.join(pre.select("clip_id", "method"), "clip_id").select("clip_id", "method", "tbu_idx", "target", "pred")


@query("audio_transitions", f"WITH p AS (SELECT p_partkey::VARCHAR AS clip_id, {PART_TONES} AS tones FROM part), u AS (SELECT clip_id, i, strpos('LMH', substr(tones, i::INT + 1, 1)) - strpos('LMH', substr(tones, i::INT, 1)) AS step FROM p, range(1, 7) r(i)) SELECT CASE WHEN step > 0 THEN 'R' WHEN step < 0 THEN 'F' ELSE 'level' END AS target, CASE WHEN step > 0 THEN 'R' WHEN step < 0 THEN 'F' ELSE 'level' END AS pred, count(*) AS n FROM u GROUP BY 1, 2")
def audio_transitions(spark, d):
    """The steps between neighbours, heard in the audio: how often each kind was said and heard. What is heard is read once, so it is not written."""
    units = backend.units_of(backend.precompute(_clips(spark, d)))
    steps = signal.transitions(units.withColumn("res", F.col("st")))
    return steps.groupBy("target", "pred").agg(F.count("*").alias("n"))


#: Keys that the stream's clips share.
KEYS = 2048


@query("stream_tones", f"{SIGNAL}, {PRED} SELECT clip_id::VARCHAR AS clip_id, tbu_idx, target, pred FROM pred")
def stream_tones(spark, d):
    """The events in three shuffled files, read as a stream that keeps clips open until all have come; final tones are the batch meter's."""
    tables, hour = Tables(spark, "stream"), lambda x: F.timestamp_micros((F.lit(1704067200000000) + F.round(x * 3.6e9)).cast("long"))
    frames = scorer.frame_rows(T.frames(spark, d).withColumn("ts", hour(F.col("t"))))
    units = scorer.unit_rows(T.windows(spark, d).withColumn("ts", hour(F.col("t0"))))
    tables.put("arrived/a", frames.unionByName(units).repartition(3, F.xxhash64("clip_id", "t")))
    end = spark.range(1).select(F.lit("end").alias("clip_id"), F.to_timestamp(F.lit("2100-01-01")).alias("ts"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("f0"))
    tables.put("arrived/b", scorer.frame_rows(end))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    scorer.state_store(spark)
    try:
        stream = spark.readStream.schema(scorer.ROWS).option("maxFilesPerTrigger", 2).parquet(f"{tables.root}/arrived/*")
        monitor.run_once(scorer.scores(stream, delay="3650 days", gap=60.0, unit=3600.0, digits=6, groups=KEYS), f"{tables.root}/out", f"{tables.root}/checkpoint")
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(scorer.SCORES).parquet(f"{tables.root}/out").where("final").select("clip_id", "tbu_idx", "target", "pred")


# --- files

@query("manifest_read", "SELECT o_orderkey::VARCHAR AS id, o_totalprice AS duration_sec FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000")
def manifest_read(spark, d):
    path = Tables(spark, "manifest").root
    m = T.manifest(spark, d).select(F.col("id").cast("string").alias("id"), F.col("source").alias("text"), "source", F.col("speaker_id").cast("string").alias("speaker_id"), "duration_sec")
    m.write.json(path)
    return readers.manifest(spark, path, F.col("duration_sec").between(50000, 90000)).select("id", "duration_sec")


@query("training_manifest", "SELECT o_orderkey::VARCHAR AS id, round(o_totalprice / 7, 3) AS duration FROM orders")
def training_manifest(spark, d):
    path = Tables(spark, "training").root
    rows = T.manifest(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("audio_path"), F.lit("t").alias("text"), F.lit("yo").alias("language_id"), (F.col("duration_sec") / 7).alias("duration"))
    writers.training_manifest(rows, path)
    return spark.read.schema("id string, duration double").json(path)


@query("keymap_read", f"WITH {KEY} SELECT item_id, source, round(tone_i2, 4)::DOUBLE AS tone_i2, is_catch, catch_expected FROM key")
def keymap_read(spark, d):
    path = Tables(spark, "key").root
    writers.keymap(_key(spark, d), path)
    return readers.keymap_lines(spark, path).select("item_id", "source", "tone_i2", "is_catch", "catch_expected")


@query("answers_csv", "SELECT 'r1' AS rater, 'item' || p_partkey AS item_id, CASE WHEN p_size > 25 THEN 'ok' ELSE 'bad' END AS label FROM part WHERE p_size % 4 > 0")
def answers_csv(spark, d):
    path = Tables(spark, "answers").root
    answer = F.when(F.col("p_size") % 4 == 0, F.lit(None)).when(F.col("p_size") > 25, " OK ").otherwise("Bad")
    T.table(spark, d, "part").select(F.concat(F.lit("item"), "p_partkey").alias("item_id"), answer.alias("answer")).write.option("header", True).csv(path)
    return readers.answers_csv(spark, path, "r1")


@query("foreign_texts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS text FROM documents")
def foreign_texts(spark, d):
    path = Tables(spark, "foreign").root
    docs = T.table(spark, d, "documents")
    docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("sentence"), F.col("source").alias("transcription")).write.parquet(path)
    return readers.texts(spark, path, ["raw_text", "sentence", "transcription"]).select("doc_id", "text")


@query("upsert_written", "SELECT o_orderpriority AS run_tag, round(avg(o_totalprice), 4) AS v FROM orders WHERE o_orderpriority > '2' GROUP BY 1 UNION ALL SELECT DISTINCT o_orderpriority, -1 FROM orders WHERE o_orderpriority < '2'")
def upsert_written(spark, d):
    path = Tables(spark, "runs").root
    old = T.manifest(spark, d).groupBy(F.col("source").alias("run_tag")).agg(F.round(F.avg("duration_sec"), 4).alias("v"))
    writers.upsert(old, path)
    for _ in range(2):
        writers.upsert(old.where("run_tag < '2'").select("run_tag", F.lit(-1.0).alias("v")), path)
    return spark.read.parquet(path).select(F.col("run_tag").cast("string").alias("run_tag"), "v")


@query("reference_clip", "SELECT o_orderkey AS id, o_totalprice AS duration_sec FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 50000 AND 60000 ORDER BY o_orderkey LIMIT 1")
def reference_clip(spark, d):
    return readers.reference_clip(T.manifest(spark, d), "1-URGENT", 50000, 60000, "id").select("id", "duration_sec")


@query("missing_files", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0")
def missing_files(spark, d):
    m = T.manifest(spark, d).select("id")
    return readers.missing_files(m, m.where("id % 4 = 0"), "id")


@query("log_lines", "SELECT url AS value FROM pages WHERE regexp_matches(url, 'page=|feed')")
def log_lines(spark, d):
    path = Tables(spark, "log").root
    return writers.tee(T.table(spark, d, "pages").select(F.col("url").alias("value")).where("url IS NOT NULL"), path, "page=|feed")
