"""Queries of texts, pitch, joins, listening tests and the stream, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import pilot, selection, signal
from ..sources import writers
from ..streaming import monitor
from . import tables as T
from .metric_queries import HASH, TAIL, r6

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def sql_translate(col, table):
    return f"translate({col}, '{''.join(table)}', '{''.join(table.values())}')"


MARKED = sql_translate("text", {k: X.STAND_IN[v] for k, v in X.tone_letters().items()})
TONES = f"regexp_replace({MARKED}, '[^{''.join(X.STAND_IN.values())}]', '', 'g')"
BARE = sql_translate("{}", X.bare_letters())
CER_TEXT = f"trim(regexp_replace(lower({BARE}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+', ' ', 'g'))"
NORM = "trim(regexp_replace(lower(nfc_normalize({})), '\\s+', ' ', 'g'))"


@query("tbu_counts", "SELECT lang, " + ", ".join(f"sum(length(m) - length(replace(m, '{X.STAND_IN[t]}', '')))::BIGINT AS n_{t.lower()}" for t in "HML") + f" FROM (SELECT lang, {MARKED} AS m FROM documents) GROUP BY lang")
def tbu_counts(spark, d):
    return X.tone_counts(T.table(spark, d, "documents"), "text", ["lang"])


@query("tone_bigrams", f"SELECT lang, translate(substr(s, i::INT, 2), '{''.join(X.STAND_IN.values())}', '{''.join(X.STAND_IN)}') AS bigram, count(*) AS n FROM (SELECT lang, s, unnest(range(1, length(s)::BIGINT)) AS i FROM (SELECT lang, {TONES} AS s FROM documents)) GROUP BY 1, 2")
def tone_bigrams(spark, d):
    return X.tone_bigrams(T.table(spark, d, "documents"), "text", ["lang"])


@query("tone_density", f"SELECT doc_id, length({TONES})::INT AS n_tbu, round(length({TONES})::DOUBLE / length(text), 6) AS density FROM documents")
def tone_density(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text", F.length(X.tone_letters_of(F.col("text"))).alias("n_tbu"))
    size = F.length("text")
    return docs.select("doc_id", "n_tbu", F.when(size == 0, float("nan")).otherwise(F.round(S.share(F.col("n_tbu"), size), 6)).alias("density"))  # 0/0 of an empty text, as in SQL


@query("norm_keys", f"SELECT lang, count(*) AS n, count(DISTINCT {NORM.format('text')}) AS keys FROM documents GROUP BY 1")
def norm_keys(spark, d):
    keys = T.table(spark, d, "documents").select("lang", X.norm_key(F.col("text")).alias("key"))
    return keys.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("tone_swap", f"SELECT lang, sum((text <> {sql_translate('text', X.swapped_letters())})::INT)::BIGINT AS changed FROM documents GROUP BY 1")
def tone_swap(spark, d):
    return T.table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("text") != X.swap_tones(F.col("text"))).alias("changed"))


#: DuckDB's distance counts bytes, so letters beyond ASCII that keep their form without marks become capitals, which no lower-cased text has.
SINGLE = dict(zip("ßæœøđłðþŋəɛɔɓɗƙƴıĸħŧʼʔªº", "ABCDEFGHIJKLMNOPQRSTUVWX", strict=True))
CER_A, CER_B = (sql_translate(CER_TEXT.format(c), SINGLE) for c in ("a.text", "b.text"))


@query("cer_pairs", f"SELECT item_id, round(levenshtein(r, h)::DOUBLE / length(r), 6) AS cer FROM (SELECT a.item_id, {CER_A} AS r, {CER_B} AS h FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)")
def cer_pairs(spark, d):
    b = T.table(spark, d, "benchmark")
    pairs = b.select("item_id", "text").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.round(X.cer(F.col("text"), F.col("other")), 6).alias("cer"))


@query("holdout_drop", f"WITH l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT DISTINCT {NORM.format('line')} AS k FROM l WHERE source = 'src0') SELECT lang, count(*) AS n FROM l WHERE source <> 'src0' AND {NORM.format('line')} NOT IN (SELECT k FROM h) GROUP BY 1")
def holdout_drop(spark, d):
    lines = T.table(spark, d, "documents").select("lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    kept = selection.without_holdouts(lines.where("source <> 'src0'"), lines.where("source = 'src0'"), "line", "line")
    return kept.groupBy("lang").agg(F.count("*").alias("n"))


FRAMES = "frames AS (SELECT user_id AS clip_id, round((epoch_us(ts) - 1704067200000000) / 3.6e9, 6) AS t, max(CASE WHEN value BETWEEN 65 AND 400 THEN value END) AS f0 FROM events GROUP BY 1, 2)"
SPANS = "spans AS (SELECT clip_id, min(CASE WHEN f0 IS NOT NULL THEN t END) AS v0, max(CASE WHEN f0 IS NOT NULL THEN t END) AS v1, avg((f0 IS NOT NULL)::INT) AS voiced FROM frames GROUP BY 1)"
WINS = "wins AS (SELECT clip_id, i::INT AS tbu_idx, substr('HMLHML', i::INT + 1, 1) AS target, v0 + i * ((v1 - v0) / 6) AS t0, v0 + (i + 1) * ((v1 - v0) / 6) AS t1 FROM spans, range(0, 6) r(i) WHERE v1 > v0)"
UNITS = "meds AS (SELECT w.clip_id, w.tbu_idx, median(CASE WHEN t >= t0 + 0.5 * (t1 - t0) THEN f0 END) AS a, median(f0) AS b FROM wins w JOIN frames f ON f.clip_id = w.clip_id AND t >= t0 AND t < t1 WHERE f0 IS NOT NULL GROUP BY 1, 2), units AS (SELECT w.clip_id, w.tbu_idx, w.target, CASE WHEN coalesce(a, b) IS NOT NULL THEN 12 * log2(greatest(coalesce(a, b), 1e-6) / 100) END AS st, (t0 + t1) / 2 AS t_mid FROM wins w LEFT JOIN meds m USING (clip_id, tbu_idx))"
CLAMP = "greatest(-2.0, least(0.0, coalesce({}, 0.0)))"
SLOPES = f"live AS (SELECT * FROM units WHERE st IS NOT NULL), ps AS (SELECT a.clip_id, median((b.st - a.st) / (b.t_mid - a.t_mid)) AS m FROM live a JOIN live b ON a.clip_id = b.clip_id AND a.tbu_idx < b.tbu_idx WHERE abs(b.t_mid - a.t_mid) > 1e-9 GROUP BY 1), slopes AS (SELECT clip_id, CASE WHEN n < 3 THEN 0.0 ELSE {CLAMP.format('m')} END AS slope FROM (SELECT clip_id, count(*) AS n FROM live GROUP BY 1) LEFT JOIN ps USING (clip_id))"
RES = "res AS (SELECT clip_id, tbu_idx, target, round(st - coalesce(slope, 0) * t_mid, 6) AS res FROM units LEFT JOIN slopes USING (clip_id))"
SIGNAL = f"WITH {FRAMES}, {SPANS}, {WINS}, {UNITS}, {SLOPES}, {RES}"
PRED = "pred AS (SELECT clip_id, tbu_idx, target, CASE WHEN c IS NULL THEN NULL WHEN c >= 1 THEN 'H' WHEN c <= -1 THEN 'L' ELSE 'M' END AS pred FROM (SELECT *, res - median(res) OVER (PARTITION BY clip_id) AS c FROM res))"


@query("voiced_span", f"WITH {FRAMES}, {SPANS} SELECT clip_id, v0, v1, round(voiced, 6) AS voiced FROM spans")
def voiced_span(spark, d):
    return r6(signal.voiced_span(T.frames(spark, d)), "voiced")


@query("unit_semitones", f"{SIGNAL} SELECT clip_id, tbu_idx, target, round(st, 6) AS st, round(t_mid, 6) AS t_mid FROM units")
def unit_semitones(spark, d):
    return r6(T.units(spark, d), "st", "t_mid")


@query("theil_sen", f"{SIGNAL} SELECT clip_id, round(slope, 6) AS slope FROM slopes")
def theil_sen(spark, d):
    return r6(signal.theil_sen(T.units(spark, d)), "slope")


@query("fw_slope", f"{SIGNAL}, dev AS (SELECT clip_id, t_mid - avg(t_mid) OVER w AS x, st - avg(st) OVER w AS y FROM live WINDOW w AS (PARTITION BY clip_id, target)) SELECT clip_id, round(CASE WHEN count(*) < 4 OR sum(x * x) < 1e-9 THEN 0.0 ELSE {CLAMP.format('sum(x * y) / sum(x * x)')} END, 6) AS slope FROM dev GROUP BY 1")
def fw_slope(spark, d):
    return r6(signal.fw_slope(T.units(spark, d)), "slope")


@query("tone_scores", f"{SIGNAL}, {PRED} SELECT clip_id, round(sum((pred = target)::INT)::DOUBLE / nullif(count(pred), 0), 6) AS accuracy, round(count(pred)::DOUBLE / count(*), 6) AS coverage, count(pred) AS n_scored, count(*) AS n_tbu FROM pred GROUP BY 1")
def tone_scores(spark, d):
    return r6(signal.clip_scores(signal.classify(T.residuals(spark, d))), "accuracy", "coverage")


STEP = "step AS (SELECT clip_id, tbu_idx, res - lag(res) OVER w AS s, CASE target WHEN 'H' THEN 2 WHEN 'M' THEN 1 ELSE 0 END - lag(CASE target WHEN 'H' THEN 2 WHEN 'M' THEN 1 ELSE 0 END) OVER w AS g, row_number() OVER w AS k FROM res WINDOW w AS (PARTITION BY clip_id ORDER BY tbu_idx))"


@query("transitions", f"{SIGNAL}, {STEP} SELECT CASE WHEN g > 0 THEN 'R' WHEN g < 0 THEN 'F' ELSE 'level' END AS target, CASE WHEN s IS NULL THEN NULL WHEN s >= 0.6 THEN 'R' WHEN s <= -0.9 THEN 'F' ELSE 'level' END AS pred, count(*) AS n FROM step WHERE k > 1 GROUP BY 1, 2")
def transitions(spark, d):
    return signal.transitions(T.residuals(spark, d)).groupBy("target", "pred").agg(F.count("*").alias("n"))


@query("tone_levels", f"{SIGNAL} SELECT clip_id, median(CASE WHEN target = 'H' THEN res END) AS med_h, median(CASE WHEN target = 'L' THEN res END) AS med_l, median(res) AS mid_ref, round(median(CASE WHEN target = 'H' THEN res END) - median(CASE WHEN target = 'L' THEN res END), 6) AS delta_hl FROM res GROUP BY 1")
def tone_levels(spark, d):
    return r6(signal.levels(T.residuals(spark, d)), "delta_hl")


@query("v1_tones", f"WITH {FRAMES}, {SPANS}, {WINS}, ref AS (SELECT clip_id, median(f0) AS r FROM frames GROUP BY 1), m AS (SELECT w.clip_id, w.tbu_idx, median(f0) AS m FROM wins w JOIN frames f ON f.clip_id = w.clip_id AND t >= t0 AND t <= t1 GROUP BY 1, 2), p AS (SELECT target, 12 * log2(m / r) AS c FROM wins LEFT JOIN m USING (clip_id, tbu_idx) LEFT JOIN ref USING (clip_id)) SELECT target, CASE WHEN c > 0.8 THEN 'H' WHEN c < -0.8 THEN 'L' ELSE 'M' END AS pred, count(*) AS n FROM p GROUP BY 1, 2")
def v1_tones(spark, d):
    return signal.v1_tones(T.frames(spark, d), T.windows(spark, d)).groupBy("target", "pred").agg(F.count("*").alias("n"))


@query("islands", f"WITH {FRAMES}, i AS (SELECT clip_id, t, f0, sum((f0 IS NULL)::INT) OVER (PARTITION BY clip_id ORDER BY t) AS island FROM frames) SELECT clip_id, island::BIGINT AS island, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM i WHERE f0 IS NOT NULL GROUP BY 1, 2")
def islands(spark, d):
    return signal.islands(T.frames(spark, d)).groupBy("clip_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query("voiced_rhyme", f"""WITH {FRAMES}, {SPANS}, {WINS}, e AS (SELECT *, lag(t1) OVER w AS lft, lead(t0) OVER w AS rgt FROM wins WINDOW w AS (PARTITION BY clip_id ORDER BY tbu_idx)),
 i AS (SELECT clip_id, t, f0, sum((f0 IS NULL)::INT) OVER (PARTITION BY clip_id ORDER BY t) AS island FROM frames),
 n AS (SELECT e.clip_id, tbu_idx, t, island, first_value(island) OVER (PARTITION BY e.clip_id, tbu_idx ORDER BY NOT (t >= t0 AND t < t1), abs(t - (t0 + t1) / 2), t) AS seed FROM e JOIN i ON i.clip_id = e.clip_id WHERE f0 IS NOT NULL AND (lft IS NULL OR t >= lft) AND (rgt IS NULL OR t < rgt))
 SELECT clip_id, tbu_idx, min(t) AS r0, max(t) AS r1 FROM n WHERE island = seed GROUP BY 1, 2 HAVING max(t) - min(t) >= 0.06 - 1e-9""")
def voiced_rhyme(spark, d):
    return signal.voiced_rhyme(T.frames(spark, d), T.windows(spark, d))


@query("pitch_edits", f"WITH {FRAMES}, m AS (SELECT clip_id, avg(f0) AS m FROM frames GROUP BY 1) SELECT clip_id, round(avg(CASE WHEN f0 IS NOT NULL THEN m END), 6) AS flat, round(max(m + 0.5 * (f0 - m)), 6) AS halved, round(sum(f0 * CASE WHEN t >= 100 AND t < 200 THEN pow(2, 3 / 12.0) ELSE 1 END), 4) AS shifted FROM frames JOIN m USING (clip_id) GROUP BY 1")
def pitch_edits(spark, d):
    f = T.frames(spark, d)
    edits = f.select("clip_id").distinct().select("clip_id", F.lit(100.0).alias("e0"), F.lit(200.0).alias("e1"), F.lit(3.0).alias("semitones"))
    flat = signal.flatten(f).groupBy("clip_id").agg(F.round(F.avg("f0"), 6).alias("flat"))
    half = signal.scale_excursion(f, 0.5).groupBy("clip_id").agg(F.round(F.max("f0"), 6).alias("halved"))
    moved = signal.shift_window(f, edits).groupBy("clip_id").agg(F.round(F.sum("f0"), 4).alias("shifted"))
    return flat.join(half, "clip_id").join(moved, "clip_id")


@query("ssim_pairs", "SELECT a.vec_id, round((greatest(-1, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))) + 1) / 2, 6) AS ssim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ssim_pairs(spark, d):
    e = T.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(signal.ssim(F.col("embedding"), F.col("other")), 6).alias("ssim"))


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("voice_diversity", f"SELECT a.label, count(*) AS pairs, round(avg({COS}), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def voice_diversity(spark, d):
    """Over all pairs of voices of each line, without listing them; the SQL lists them."""
    return r6(signal.mean_pair_cosine(T.table(spark, d, "embeddings"), "label", "embedding"), "mean_cosine")


@query("role_changes", "WITH t AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) SELECT before, role, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2")
def role_changes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = T.table(spark, d, "conversations").select("role", F.lag("role").over(w).alias("before"))
    return c.where("before IS NOT NULL").groupBy("before", "role").agg(F.count("*").alias("n"))


def _codes(spark, d):
    """Raters' answers as compact codes, one for each sitting: suppliers rate the parts of an order."""
    li = T.table(spark, d, "lineitem")
    label = F.when(F.col("l_quantity") > 30, " OK").when(F.col("l_quantity") > 12, "bad ").otherwise("unsure")
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", F.concat(F.lit("item"), F.col("l_partkey"), F.lit("="), label).alias("part"))
    codes = li.groupBy(F.col("l_suppkey").alias("rater"), F.col("l_orderkey").alias("sitting")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return codes.select("rater", "sitting", F.concat(F.lit("PILOT1;;noise;"), F.array_join(F.transform("x", lambda y: y["part"]), ";")).alias("code"))


ANSWERS = "ans AS (SELECT rater, item_id, label FROM (SELECT l_suppkey AS rater, 'item' || l_partkey AS item_id, CASE WHEN l_quantity > 30 THEN 'ok' WHEN l_quantity > 12 THEN 'bad' ELSE 'unsure' END AS label, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1)"


@query("answers_parse", f"WITH {ANSWERS} SELECT rater, label, count(*) AS n FROM ans GROUP BY 1, 2")
def answers_parse(spark, d):
    return pilot.answer_rows(_codes(spark, d), order="sitting").groupBy("rater", "label").agg(F.count("*").alias("n"))


def _key(spark, d):
    p = T.table(spark, d, "part")
    catch = F.col("p_size") % 10 == 0
    return p.select(F.concat(F.lit("item"), F.col("p_partkey")).alias("item_id"), F.when(F.col("p_size") % 3 == 0, "native").otherwise("model").alias("source"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0).alias("tone_i2"), catch.alias("is_catch"), F.when(F.col("p_size") % 20 == 0, "bad").alias("catch_expected"))


KEY = "key AS (SELECT 'item' || p_partkey AS item_id, CASE WHEN p_size % 3 = 0 THEN 'native' ELSE 'model' END AS source, CASE WHEN p_size % 7 <> 0 THEN p_size / 50.0 END AS tone_i2, p_size % 10 = 0 AS is_catch, CASE WHEN p_size % 20 = 0 THEN 'bad' END AS catch_expected FROM part)"
TALLY = "tally AS (SELECT rater, count_if(is_catch)::BIGINT AS catch_total, count_if(is_catch AND label = coalesce(catch_expected, 'ok'))::BIGINT AS catch_ok, count_if(NOT is_catch AND source = 'native' AND label <> 'unsure')::BIGINT AS native_total, count_if(NOT is_catch AND source = 'native' AND label = 'ok')::BIGINT AS native_ok, count_if(NOT is_catch AND label = 'unsure')::BIGINT AS unsure, count_if(NOT is_catch AND label <> 'unsure' AND tone_i2 IS NOT NULL)::BIGINT AS scoreable FROM ans JOIN key USING (item_id) GROUP BY 1)"


@query("rater_gate", f"WITH {ANSWERS}, {KEY}, {TALLY} SELECT *, catch_total >= 5 AND catch_ok >= 5 AS kept, round(native_ok::DOUBLE / nullif(native_total, 0), 6) AS anchor, CASE WHEN NOT (catch_total >= 5 AND catch_ok >= 5) THEN 'FAILED CATCHES' WHEN scoreable < 30 THEN 'NO SCOREABLE PILOT' WHEN NOT coalesce(native_ok::DOUBLE / nullif(native_total, 0) >= 0.75, false) THEN 'ANCHOR LOW' ELSE 'OK' END AS status FROM tally")
def rater_gate(spark, d):
    return r6(pilot.rater_gate(pilot.rater_tallies(pilot.answer_rows(_codes(spark, d), order="sitting"), _key(spark, d))), "anchor")


@query("tone_threshold", f"WITH {KEY} SELECT round(coalesce(median(CASE WHEN source = 'native' AND NOT is_catch THEN tone_i2 END), 0.58)::DOUBLE, 6) AS tau FROM key")
def tone_threshold(spark, d):
    return r6(pilot.threshold(_key(spark, d)), "tau")


AB = f"ab AS (SELECT rater, CASE label WHEN 'ok' THEN 'A' WHEN 'bad' THEN 'B' ELSE 'unsure' END AS pick, is_catch, CASE WHEN {HASH.format("'5|' || item_id")} % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM ans JOIN key USING (item_id))"
Z2 = "(1.95996 * 1.95996)"


@query("ab_gate", f"""WITH {ANSWERS}, {KEY}, {AB}, t AS (SELECT rater, count_if(is_catch)::BIGINT AS catch_total, count_if(is_catch AND pick = side)::BIGINT AS catch_ok, count_if(NOT is_catch AND pick <> 'unsure')::BIGINT AS trials, count_if(NOT is_catch AND pick = side)::BIGINT AS wins, count_if(NOT is_catch AND pick = 'unsure')::BIGINT AS unsure FROM ab GROUP BY 1), w AS (SELECT *, wins::DOUBLE / trials AS p, 1 + {Z2} / trials AS d FROM t)
 SELECT rater, catch_total, catch_ok, trials, wins, unsure, coalesce(catch_ok::DOUBLE / nullif(catch_total, 0) >= 0.8, false) AS kept, round(p, 6) AS share, round(greatest(0, (p + {Z2} / (2 * trials)) / d - 1.95996 * sqrt(p * (1 - p) / trials + {Z2} / (4 * trials * trials)) / d), 6) AS lo, round(least(1, (p + {Z2} / (2 * trials)) / d + 1.95996 * sqrt(p * (1 - p) / trials + {Z2} / (4 * trials * trials)) / d), 6) AS hi,
 round(CASE WHEN 2 * wins = trials THEN 1.0 ELSE least(1.0, 2 * {TAIL.format(m="least(wins, trials - wins)", n="trials")}) END, 5) AS p_value, CASE WHEN NOT coalesce(catch_ok::DOUBLE / nullif(catch_total, 0) >= 0.8, false) THEN 'FAILED CATCHES' WHEN trials < 24 THEN 'NO SCOREABLE PILOT' ELSE 'OK' END AS status FROM w""")
def ab_gate(spark, d):
    a = pilot.answer_rows(_codes(spark, d), order="sitting").withColumn("label", F.when(F.col("label") == "ok", "a").when(F.col("label") == "bad", "b").otherwise("unsure"))
    k = _key(spark, d).withColumns({"correct_side": selection.random_side(5, F.col("item_id")), "expect_pick": selection.random_side(5, F.col("item_id"))})
    return r6(pilot.ab_gate(pilot.ab_tallies(a, k)), "share", "lo", "hi").withColumn("p_value", F.round("p_value", 5))


@query("flip_oracle", """WITH o AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'flip' ELSE 'control' END AS kind, (l_linenumber % 3 + 1) * 0.5 AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'I1' ELSE 'I2' END AS meter, l_quantity > 20 AS detected, l_linenumber % 2 AS ff, 8 AS tot, l_tax > 0.06 AS flipped FROM lineitem),
 s AS (SELECT meter, count_if(kind = 'flip')::BIGINT AS n_flips, round(sum(CASE WHEN kind = 'flip' THEN ff END)::DOUBLE / sum(CASE WHEN kind = 'flip' THEN tot END), 6) AS false_flip_rate, round(count_if(kind = 'control' AND flipped)::DOUBLE / count_if(kind = 'control'), 6) AS control_trip FROM o GROUP BY 1),
 r AS (SELECT meter, k, avg(detected::INT) AS rate FROM o WHERE kind = 'flip' GROUP BY 1, 2), j AS (SELECT meter, string_agg(format('{:.2f}={:.6f}', k::DOUBLE, rate), ';' ORDER BY k) AS detect_by_k FROM r GROUP BY 1)
 SELECT s.*, round((SELECT rate FROM r WHERE r.meter = s.meter AND k = 1.0), 6) AS strong_detect, detect_by_k FROM s JOIN j USING (meter)""")
def flip_oracle(spark, d):
    li = T.table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_linestatus") == "F", "flip").otherwise("control").alias("kind"), ((F.col("l_linenumber") % 3 + 1) * F.lit(0.5)).alias("k"), F.when(F.col("l_suppkey") % 2 == 0, "I1").otherwise("I2").alias("meter"), (F.col("l_quantity") > 20).alias("detected"), (F.col("l_linenumber") % 2).alias("false_flips"), F.lit(8).alias("ff_total"), (F.col("l_tax") > 0.06).alias("flipped"))
    return r6(pilot.oracle_summary(rows, 1.0).withColumn("detect_by_k", pilot.by_k("detect_by_k")), "false_flip_rate", "control_trip", "strong_detect")


@query("upsert_runs", "SELECT run_tag, round(v, 4) AS v FROM (SELECT o_orderpriority AS run_tag, avg(o_totalprice) AS v FROM orders WHERE o_orderpriority > '2' GROUP BY 1 UNION ALL SELECT o_orderpriority, -1 FROM orders WHERE o_orderpriority < '2' GROUP BY 1)")
def upsert_runs(spark, d):
    old = T.manifest(spark, d).groupBy(F.col("source").alias("run_tag")).agg(F.round(F.avg("duration_sec"), 4).alias("v"))
    new = old.where("run_tag < '2'").select("run_tag", F.lit(-1.0).alias("v"))
    return writers.upserted(old, new)


@query("usable_clips", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000 AND length(trim(o_orderpriority)) > 0")
def usable_clips(spark, d):
    return selection.usable(T.manifest(spark, d), 50000, 90000, text="source").select("id")


@query("length_checks", "SELECT doc_id, round(n_chars / 20.0 / greatest(0.157 * length(text), 1e-6), 6) AS len_ratio, n_chars / 20.0 BETWEEN 0.6 * greatest(0.3, 0.157 * length(text)) AND 1.6 * greatest(0.3, 0.157 * length(text)) AS length_ok FROM documents")
def length_checks(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") / 20.0).alias("dur"))
    return docs.select("doc_id", F.round(S.len_ratio(F.col("dur"), F.col("text")), 6).alias("len_ratio"), S.length_ok(F.col("dur"), F.col("text")).alias("length_ok"))


@query("item_ids", f"SELECT item_id AS clip, printf('item%02d', row_number() OVER (ORDER BY {HASH.format("'9|' || item_id")}, item_id)) AS item_id FROM benchmark")
def item_ids(spark, d):
    b = T.table(spark, d, "benchmark").select(F.col("item_id").alias("clip"))
    return selection.item_ids(b, 9, "clip")


@query("pitch_histogram", "SELECT least(greatest(floor((value - 0) / 50) + 1, 0), 11)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def pitch_histogram(spark, d):
    return writers.histogram(T.table(spark, d, "events"), "value", 0.0, 500.0, 10).select("bin", "n")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
 SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, count(CASE WHEN value BETWEEN 65 AND 400 THEN 1 END) AS n_voiced, round(avg(CASE WHEN value BETWEEN 65 AND 400 THEN value END), 6) AS mean_f0 FROM g GROUP BY user_id, s""")
def stream_sessions(spark, d):
    """The stream's plan over a finished input."""
    return monitor.sessions(T.table(spark, d, "events")).select("user_id", F.unix_micros("start").alias("start_us"), "n", "n_voiced", "mean_f0")


@query("stream_rates", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, count(CASE WHEN value BETWEEN 65 AND 400 THEN 1 END) AS n_voiced FROM events GROUP BY 1, 2")
def stream_rates(spark, d):
    return monitor.rates(T.table(spark, d, "events")).select(F.unix_micros("start").alias("start_us"), "event_type", "n", "n_voiced")
