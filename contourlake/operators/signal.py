"""From pitch frames to tones, all relational.

frames(clip_id, t, f0): f0 is NULL where unvoiced. windows(clip_id, tbu_idx,
target, t0, t1): NULL times where a unit was not aligned. Frames meet windows by
time bins, so a long clip is cut over tasks and a frame meets the windows near it
only; nearest frames come from one sorted merge of frames and the times that are
asked for; per-clip regressions and medians are aggregates and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

#: Limits of a declination in semitones a second, thresholds of levels and of transitions, and where a window's late part begins.
SLOPE_LEAST, SLOPE_MOST = -2.0, 0.0
THETA_H = THETA_L = 1.0
RISE, FALL = 0.6, 0.9
LATE = 0.5
#: Seconds of an interval beyond which it counts as so long where bins are made.
LONGEST = 1e9


def voiced_span(frames: DataFrame) -> DataFrame:
    """First and last voiced time of each clip, and the voiced share."""
    voiced = F.col("f0").isNotNull()
    return frames.groupBy("clip_id").agg(F.min(F.when(voiced, F.col("t"))).alias("v0"), F.max(F.when(voiced, F.col("t"))).alias("v1"), F.avg(voiced.cast("double")).alias("voiced"))


def proportional_windows(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """The voiced span in as many equal windows as the clip has units. targets(clip_id, tones array)."""
    both = spans.join(targets, "clip_id")
    each = (F.col("v1") - F.col("v0")) / F.size("tones")
    unit = both.select("clip_id", "v0", each.alias("each"), F.posexplode("tones").alias("tbu_idx", "target"))
    return unit.select("clip_id", "tbu_idx", "target", (F.col("v0") + F.col("tbu_idx") * F.col("each")).alias("t0"), (F.col("v0") + (F.col("tbu_idx") + 1) * F.col("each")).alias("t1"))


def inside(points: DataFrame, intervals: DataFrame, key: str, t: str, lo: str, hi: str) -> DataFrame:
    """Each point(key, t, ...) with each interval(key, lo, hi, ...) of its key that holds it, lo <= t < hi.

    Time is cut into bins as wide as the key's intervals are on average: a point
    lies in one, an interval in all that it touches, and they meet by key and
    bin. So a key with most of the points is spread over tasks, a point is beside
    the intervals near it only, and there are at most three times as many rows
    as intervals. Widths are means of whole milliseconds, the same in any order
    of the rows. The size of the files that intervals come from says little of
    the rows they become, so both joins are by a shuffle.
    """
    live, own = intervals.where(F.col(lo) < F.col(hi)), Window.partitionBy(key)
    ms = F.round(F.least(F.col(hi) - F.col(lo), F.lit(LONGEST)) * 1000).cast("long")
    width = lambda total, n: F.greatest(total / n, F.lit(1.0)) / 1000
    bin_of = lambda x: F.floor(F.col(x) / F.col("_w"))
    widths = live.groupBy(key).agg(width(F.sum(ms), F.count("*")).alias("_w"))
    cut = live.withColumn("_w", width(F.sum(ms).over(own), F.count("*").over(own))).withColumn("_b", F.explode(F.sequence(bin_of(lo), bin_of(hi)))).drop("_w")
    binned = points.join(widths.hint("merge"), key).withColumn("_b", bin_of(t)).drop("_w")
    return binned.join(cut.hint("merge"), [key, "_b"]).where((F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi))).drop("_b")


def unit_semitones(frames: DataFrame, windows: DataFrame, late: float = LATE) -> DataFrame:
    """st and t_mid of each unit: the median pitch of the window's late part, else of all of it, else NULL."""
    w = windows.select("clip_id", "tbu_idx", "target", "t0", "t1")
    voiced = frames.where(F.col("f0").isNotNull()).select("clip_id", F.col("t").alias("_t"), F.col("f0").alias("_f0"))
    near = inside(voiced, w.select("clip_id", "tbu_idx", "t0", "t1"), "clip_id", "_t", "t0", "t1")
    from_late = F.col("_t") >= F.col("t0") + late * (F.col("t1") - F.col("t0"))
    med = near.groupBy("clip_id", "tbu_idx").agg(F.median(F.when(from_late, F.col("_f0"))).alias("a"), F.median("_f0").alias("b"))
    out = w.join(med, ["clip_id", "tbu_idx"], "left")
    return out.select("clip_id", "tbu_idx", "target", S.semitone(F.coalesce("a", "b")).alias("st"), ((F.col("t0") + F.col("t1")) / 2).alias("t_mid"))


def clamped(slope: Column) -> Column:
    return F.least(F.lit(SLOPE_MOST), F.greatest(F.lit(SLOPE_LEAST), F.coalesce(slope, F.lit(0.0))))


def theil_sen(units: DataFrame) -> DataFrame:
    """slope of each clip: the median of the slopes of all pairs of its units, clamped; 0 for fewer than three units."""
    live = units.where(F.col("st").isNotNull()).select("clip_id", "tbu_idx", "st", "t_mid")
    a, b = live.alias("a"), live.alias("b")
    pairs = a.join(b, (F.col("a.clip_id") == F.col("b.clip_id")) & (F.col("a.tbu_idx") < F.col("b.tbu_idx")))
    dx = F.col("b.t_mid") - F.col("a.t_mid")
    slope = pairs.where(F.abs(dx) > 1e-9).groupBy(F.col("a.clip_id").alias("clip_id")).agg(F.median((F.col("b.st") - F.col("a.st")) / dx).alias("m"))
    n = live.groupBy("clip_id").agg(F.count("*").alias("n"))
    return n.join(slope, "clip_id", "left").select("clip_id", F.when(F.col("n") < 3, F.lit(0.0)).otherwise(clamped(F.col("m"))).alias("slope"))


def fw_slope(units: DataFrame) -> DataFrame:
    """slope of each clip by least squares within target classes (both sides centred per class), clamped; 0 for fewer than four units."""
    w = Window.partitionBy("clip_id", "target")
    live = units.where(F.col("st").isNotNull())
    dev = live.select("clip_id", (F.col("t_mid") - F.avg("t_mid").over(w)).alias("x"), (F.col("st") - F.avg("st").over(w)).alias("y"))
    s = dev.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    return s.select("clip_id", F.when((F.col("n") < 4) | (F.col("xx") < 1e-9), F.lit(0.0)).otherwise(clamped(F.col("xy") / F.col("xx"))).alias("slope"))


def residuals(units: DataFrame, slopes: DataFrame) -> DataFrame:
    """res: semitones without the clip's slope."""
    return units.join(slopes, "clip_id", "left").withColumn("res", F.col("st") - F.coalesce("slope", F.lit(0.0)) * F.col("t_mid"))


def classify(res: DataFrame, theta_h: float = THETA_H, theta_l: float = THETA_L, mid_ref: float | DataFrame | None = None) -> DataFrame:
    """pred of each unit: its residual over the clip's median against the thresholds, both inclusive; NULL stays NULL. mid_ref: one centre for all, or mids(clip_id, mid), frozen per clip; a clip without one abstains."""
    if mid_ref is None:
        res = res.join(res.groupBy("clip_id").agg(F.median("res").alias("mid")), "clip_id")
    elif isinstance(mid_ref, DataFrame):
        res = res.join(mid_ref.select("clip_id", "mid"), "clip_id", "left")
    else:
        res = res.withColumn("mid", F.lit(float(mid_ref)))
    c = F.col("res") - F.col("mid")
    return res.withColumn("pred", F.when(c.isNull(), F.lit(None).cast("string")).when(c >= theta_h, "H").when(c <= -theta_l, "L").otherwise("M"))


def fitting_windows(windows: DataFrame, targets: DataFrame) -> DataFrame:
    """windows of targets(clip_id, tones): where a clip has another number of windows than tones, each of its units has NULL times."""
    units = targets.select("clip_id", F.size("tones").alias("_n"), F.posexplode("tones").alias("tbu_idx", "target"))
    sizes = windows.groupBy("clip_id").agg(F.count("*").alias("_m"))
    both = units.join(sizes, "clip_id", "left").join(windows.select("clip_id", "tbu_idx", "t0", "t1"), ["clip_id", "tbu_idx"], "left")
    ok = F.col("_n") == F.col("_m")
    return both.select("clip_id", "tbu_idx", "target", F.when(ok, F.col("t0")).alias("t0"), F.when(ok, F.col("t1")).alias("t1"))


def score_tone(frames: DataFrame, windows: DataFrame, mode: str = "blind", theta_h: float = THETA_H, theta_l: float = THETA_L, late: float = LATE, mid_ref: float | DataFrame | None = None) -> DataFrame:
    """The absolute meter: tbu rows with pred, residual and slope. mode: blind (Theil-Sen) or fw (with the answer key)."""
    units = unit_semitones(frames, windows, late)
    slopes = theil_sen(units) if mode == "blind" else fw_slope(units)
    return classify(residuals(units, slopes), theta_h, theta_l, mid_ref)


def clip_scores(tbu: DataFrame) -> DataFrame:
    """accuracy (micro, NULL if nothing is scored), coverage, n_scored and n_tbu of each clip."""
    hit = F.count_if(F.col("pred") == F.col("target"))
    return tbu.groupBy("clip_id").agg(S.share(hit, F.count("pred")).alias("accuracy"), S.share(F.count("pred"), F.count("*")).alias("coverage"), F.count("pred").alias("n_scored"), F.count("*").alias("n_tbu"))


def level(tone: Column) -> Column:
    return F.when(tone == "H", 2).when(tone == "M", 1).when(tone == "L", 0)


def transitions(res: DataFrame, rise: float = RISE, fall: float = FALL) -> DataFrame:
    """target and pred (R, level or F) of each step between neighbours; pred is NULL if a side is."""
    w = Window.partitionBy("clip_id").orderBy("tbu_idx")
    step = F.col("res") - F.lag("res").over(w)
    goal = level(F.col("target")) - level(F.lag("target").over(w))
    out = res.select("clip_id", "tbu_idx", F.when(goal > 0, "R").when(goal < 0, "F").when(goal == 0, "level").alias("target"), F.when(step.isNull(), F.lit(None).cast("string")).when(step >= rise, "R").when(step <= -fall, "F").otherwise("level").alias("pred"), F.row_number().over(w).alias("_k"))
    return out.where("_k > 1").drop("_k")


def transition_scores(frames: DataFrame, windows: DataFrame, rise: float = RISE, fall: float = FALL, late: float = LATE) -> DataFrame:
    """accuracy, coverage, n_scored and n_trans of each clip's transitions, from frames and windows in one call."""
    units = unit_semitones(frames, windows, late)
    steps = transitions(residuals(units, theil_sen(units)), rise, fall)
    return clip_scores(steps).withColumnRenamed("n_tbu", "n_trans")


def v1_tones(frames: DataFrame, windows: DataFrame, band: float = 0.8) -> DataFrame:
    """The retired meter: median pitch in the closed window against the clip's median, strict thresholds, unvoiced is M."""
    voiced = frames.where(F.col("f0").isNotNull())
    whole = voiced.groupBy("clip_id").agg(F.median("f0").alias("ref"))
    inside = voiced.select("clip_id", F.col("t").alias("_t"), F.col("f0").alias("_f0")).join(windows, "clip_id").where((F.col("_t") >= F.col("t0")) & (F.col("_t") <= F.col("t1")))
    med = inside.groupBy("clip_id", "tbu_idx").agg(F.median("_f0").alias("m"))
    c = F.lit(12.0) * F.log2(F.col("m") / F.col("ref"))
    out = windows.join(med, ["clip_id", "tbu_idx"], "left").join(whole, "clip_id", "left")
    return out.select("clip_id", "tbu_idx", "target", F.when(c > band, "H").when(c < -band, "L").otherwise("M").alias("pred"))


def v1_scores(frames: DataFrame, windows: DataFrame, methods: DataFrame, band: float = 0.8) -> DataFrame:
    """The retired meter's accuracy of each clip, beside the method of its windows; methods(clip_id, method)."""
    return clip_scores(v1_tones(frames, windows, band)).select("clip_id", "accuracy", "n_tbu").join(methods.select("clip_id", "method"), "clip_id", "left")


def shift_window(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """f0 times 2**(semitones/12) inside edits(clip_id, e0, e1, semitones), half-open and disjoint within a clip."""
    w = edits.select("clip_id", "e0", "e1", "semitones")
    hit = frames.join(w, "clip_id", "left").withColumn("_in", (F.col("t") >= F.col("e0")) & (F.col("t") < F.col("e1")))
    moved = hit.groupBy("clip_id", "t", "f0").agg(F.max(F.when(F.col("_in"), F.col("semitones"))).alias("st"))
    return moved.select("clip_id", "t", (F.col("f0") * F.pow(F.lit(2.0), F.coalesce("st", F.lit(0.0)) / 12)).alias("f0"))


def flatten(frames: DataFrame) -> DataFrame:
    """Voiced frames at the clip's mean pitch."""
    return frames.withColumn("f0", F.when(F.col("f0").isNotNull(), F.avg("f0").over(Window.partitionBy("clip_id"))))


def scale_excursion(frames: DataFrame, factor: float) -> DataFrame:
    """Pitch excursions around the clip's mean, scaled."""
    mean = F.avg("f0").over(Window.partitionBy("clip_id"))
    return frames.withColumn("f0", mean + factor * (F.col("f0") - mean))


def set_contour(frames: DataFrame, spans: DataFrame, points: DataFrame) -> DataFrame:
    """Each clip's frames outside its span [e0, e1), and those of the given points(clip_id, t, f0) that lie in it. spans(clip_id, e0, e1), one per clip; a clip without one stays."""
    s = spans.select("clip_id", "e0", "e1")
    inside = (F.col("t") >= F.col("e0")) & (F.col("t") < F.col("e1"))
    out = frames.join(s, "clip_id", "left").where(F.col("e0").isNull() | ~inside)
    return out.select("clip_id", "t", "f0").unionByName(points.join(s, "clip_id").where(inside).select("clip_id", "t", "f0"))


def contour_points(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Each clip's own voiced points in its closed span, to impose again."""
    inside = frames.join(spans.select("clip_id", "e0", "e1"), "clip_id")
    return inside.where(F.col("f0").isNotNull() & F.col("t").between(F.col("e0"), F.col("e1"))).select("clip_id", "t", "f0")


def median_in_span(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """st of each clip: the median semitone of its voiced frames in [e0, e1); a clip without any has no row."""
    inside = frames.where(F.col("f0").isNotNull()).join(spans.select("clip_id", "e0", "e1"), "clip_id").where((F.col("t") >= F.col("e0")) & (F.col("t") < F.col("e1")))
    return inside.groupBy("clip_id").agg(S.semitone(F.median("f0")).alias("st"))


def flip_contour(edits: DataFrame, step: float = 0.01) -> DataFrame:
    """Points every step seconds over [e0, e1]: 100 * 2**((r + slope * t) / 12)."""
    n = F.floor((F.col("e1") - F.col("e0")) / step + 1e-9).cast("int")
    at = edits.select("clip_id", "e0", "r", "slope", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    t = F.col("e0") + F.col("k") * step
    return at.select("clip_id", t.alias("t"), (F.lit(100.0) * F.pow(F.lit(2.0), (F.col("r") + F.col("slope") * t) / 12)).alias("f0"))


def neighbour_edges(windows: DataFrame) -> DataFrame:
    """left (end of the last aligned unit before) and right (start of the next aligned unit) of each unit."""
    w = Window.partitionBy("clip_id").orderBy("tbu_idx")
    return windows.withColumns({"left": F.last("t1", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "right": F.first("t0", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def islands(frames: DataFrame) -> DataFrame:
    """island of each voiced frame: runs of frames without an unvoiced one between."""
    w = Window.partitionBy("clip_id").orderBy("t")
    gap = F.sum(F.col("f0").isNull().cast("int")).over(w)
    return frames.withColumn("island", gap).where(F.col("f0").isNotNull())


#: Which frame is asked for: the last up to a time, or the first from it on; frames at the very time count or not.
LAST_BEFORE, LAST_UP_TO, FIRST_FROM, FIRST_AFTER = range(4)


def nearest(points: DataFrame, asked: DataFrame, key: str, t: str, *carry: str) -> DataFrame:
    """asked(key, at, which, ...) with found: the point (t and carry) of the key that is asked for, or NULL.

    An as-of merge: points and times are one table, sorted by key and time once
    in each direction, and each time takes the last point that went by.
    """
    point = F.struct(t, *carry)
    names = [c for c in asked.columns if c not in (key, "at", "which")]
    empty = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names]
    rows = points.select(key, F.col(t).cast("double").alias("at"), F.lit(None).cast("int").alias("which"), point.alias("_p"), *empty)
    times = asked.select(key, F.col("at").cast("double").alias("at"), F.col("which").cast("int").alias("which"), F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), *names)
    # Where a time meets a point: those that leave it out to the left come before it, the others after it.
    side = F.when(F.col("which").isNull(), 1).when(F.col("which").isin(LAST_BEFORE, FIRST_FROM), 0).otherwise(2)
    both = rows.unionByName(times).withColumn("_s", side)
    w = Window.partitionBy(key)
    past = lambda *order: F.last("_p", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    filled = both.withColumns({"_back": past("at", "_s"), "_on": past(F.desc("at"), F.desc("_s"))})
    is_last = F.col("which").isin(LAST_BEFORE, LAST_UP_TO)
    return filled.where(F.col("which").isNotNull()).select(key, "at", "which", *names, F.when(is_last, F.col("_back")).otherwise(F.col("_on")).alias("found"))


def voiced_rhyme(frames: DataFrame, windows: DataFrame, min_s: float = 0.06) -> DataFrame:
    """r0 and r1 of each aligned unit: the island of voiced frames around the frame nearest its centre, cut at its neighbours' edges; NULL if shorter than min_s.

    The nearest frame is one inside the window if there is any, then the
    earliest of equals. It is the last one up to the centre or the first one
    after it, within the edges; a window that holds a frame holds one of the two.
    """
    units = neighbour_edges(windows).where(F.col("t0").isNotNull()).select("clip_id", "tbu_idx", "t0", "t1", "left", "right", ((F.col("t0") + F.col("t1")) / 2).alias("c"))
    voiced = islands(frames).select("clip_id", "t", "island")
    left, right, c = F.col("left"), F.col("right"), F.col("c")
    ask = lambda name, at, which: F.struct(F.lit(name).alias("name"), at.alias("at"), F.lit(which).alias("which"))
    four = F.array(
        F.when(right <= c, ask("back", right, LAST_BEFORE)).otherwise(ask("back", c, LAST_UP_TO)),
        F.when(left > c, ask("on", left, FIRST_FROM)).otherwise(ask("on", c, FIRST_AFTER)),
        ask("first", left, FIRST_FROM),
        ask("last", right, LAST_BEFORE),
    )
    asked = units.select("clip_id", "tbu_idx", F.explode(four).alias("q")).select("clip_id", "tbu_idx", "q.name", "q.at", "q.which").where(F.col("at").isNotNull())
    found = nearest(voiced, asked, "clip_id", "t", "island")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("found"))).alias(f"_{name}")
    wide = found.groupBy("clip_id", "tbu_idx").agg(*map(of, ("back", "on", "first", "last"))).join(units, ["clip_id", "tbu_idx"])
    ok = lambda p: F.col(p).isNotNull() & (left.isNull() | (F.col(p)["t"] >= left)) & (right.isNull() | (F.col(p)["t"] < right))
    rank = lambda p: F.when(ok(p), F.struct(~((F.col(p)["t"] >= F.col("t0")) & (F.col(p)["t"] < F.col("t1"))).alias("o"), F.abs(F.col(p)["t"] - c).alias("d"), F.col(p)["t"].alias("t"), F.col(p)["island"].alias("island")))
    best = wide.withColumn("island", F.least(rank("_back"), rank("_on"))["island"]).where(F.col("island").isNotNull())
    ends = voiced.groupBy("clip_id", "island").agg(F.min("t").alias("i0"), F.max("t").alias("i1"))
    grown = best.join(ends, ["clip_id", "island"]).select("clip_id", "tbu_idx", F.greatest("i0", F.col("_first.t")).alias("r0"), F.least("i1", F.col("_last.t")).alias("r1"))
    return grown.where(F.col("r1") - F.col("r0") >= min_s - 1e-9)


def levels(res: DataFrame) -> DataFrame:
    """Median residuals of H and L units, of all, and their difference, of each clip."""
    med = lambda t: F.median(F.when(F.col("target") == t, F.col("res")))
    return res.groupBy("clip_id").agg(med("H").alias("med_h"), med("L").alias("med_l"), F.median("res").alias("mid_ref")).withColumn("delta_hl", F.col("med_h") - F.col("med_l"))


def confidence_sweep(scored: DataFrame, least: float = 0.6) -> DataFrame:
    """Of scored(clip_id, confidence, coverage, ...), each clip's row of the highest confidence that covers enough, else of the lowest."""
    enough = F.when(F.col("coverage") >= least, F.col("confidence"))
    w = Window.partitionBy("clip_id").orderBy(enough.desc_nulls_last(), F.col("confidence"))
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pair_cosine(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """pairs and mean_cosine over all pairs of each key's vectors, without pairs: (|sum of unit vectors|^2 - n) / (n (n - 1)). Vectors without length count in pairs only."""
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = rows.where(F.col(key).isNotNull()).select(key, F.when(length > 0, F.transform(x, lambda v: v / length)).alias("_u"))
    counts = unit.groupBy(key).agg(F.count("*").alias("_n"), F.count("_u").cast("double").alias("_m")).where("_n > 1")
    sums = unit.select(key, F.posexplode("_u").alias("_i", "_v")).groupBy(key, "_i").agg(F.sum("_v").alias("_s")).groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    mean = F.when(F.col("_m") > 1, (F.col("_q") - F.col("_m")) / (F.col("_m") * (F.col("_m") - 1)))
    return counts.join(sums, key, "left").select(key, F.expr("_n * (_n - 1) div 2").alias("pairs"), mean.alias("mean_cosine"))


def clone_diversity(rows: DataFrame, speaker: str = "speaker_id", voice: str = "to_voice", other: str = "to_other", least: int = 2, margin: float = 0.05) -> DataFrame:
    """Whether clones keep to their speakers: per speaker the mean similarity to the own voice and to the common one, then their means, how many speakers are nearer to their own, and intact (enough speakers, a margin between the means, and at least half nearer)."""
    per = rows.groupBy(speaker).agg(F.avg(voice).alias("v"), F.avg(other).alias("o"))
    out = per.agg(F.count("*").alias("n_voices"), F.count_if(F.col("v") > F.col("o")).alias("n_ok"), F.avg("v").alias("to_voice"), F.avg("o").alias("to_other"))
    intact = (F.col("n_voices") >= least) & (F.col("to_voice") > F.col("to_other") + margin) & (F.col("n_ok") >= F.floor((F.col("n_voices") + 1) / 2))
    return out.withColumn("intact", F.coalesce(intact, F.lit(False)))


def ssim(a: Column, b: Column) -> Column:
    """Speaker similarity in [0, 1]."""
    return (S.clip(cosine(a, b), -1.0, 1.0) + 1) / 2
