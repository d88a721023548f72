"""Online tone scores of open clips: keyed state with event-time timers.

Rows are frames (t, f0) and units (tbu_idx, target, t0, t1) of clips, in any
order, with an event time. A unit's frames are held until the watermark has
passed its end; then they become one median and are dropped. So the state of a
clip is a value per unit and the frames of units that are still open, plus those
that the watermark has not passed (their unit may still come). When a clip's
units close, its running declination and centre are given out; when the
watermark has passed everything of the clip by ``gap``, its units' final tones
are, and its state goes. Frames that come later than the watermark are ignored,
as the batch meter never saw them.

Keys are clips, or groups of clips by their hash (``groups``): a key costs some
milliseconds a micro-batch in calls to the state store, however few its rows, so
where many clips move at once they share them. A group has one timer, that of
the clip that is due first.

Final rows are those of ``signal.score_tone`` over the same rows. Restarting
from a checkpoint changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import signal

ROWS = "clip_id string, ts timestamp, t double, f0 double, tbu_idx int, target string, t0 double, t1 double"
SCORES = "clip_id string, final boolean, tbu_idx int, target string, pred string, res double, slope double, mid double, n_closed int"
CLIP = "clip string, base double, last double, told int, t array<double>, f0 array<double>, idx array<int>, target array<string>, t0 array<double>, t1 array<double>, st array<double>, closed array<boolean>"
STATE = f"due long, clips array<struct<{', '.join(f.replace(' ', ': ', 1) for f in CLIP.split(', '))}>>"
FIELDS, COLUMNS = ([f.split()[0] for f in x.split(", ")] for x in (CLIP, SCORES))


def frame_rows(frames: DataFrame) -> DataFrame:
    """Stream rows of frames(clip_id, ts, t, f0)."""
    return frames.select(F.col("clip_id").cast("string").alias("clip_id"), "ts", "t", "f0", *(F.lit(None).cast(k).alias(c) for c, k in (("tbu_idx", "int"), ("target", "string"), ("t0", "double"), ("t1", "double"))))


def unit_rows(windows: DataFrame) -> DataFrame:
    """Stream rows of windows(clip_id, ts, tbu_idx, target, t0, t1), ts being the time of t0."""
    none = F.lit(None).cast("double")
    return windows.select(F.col("clip_id").cast("string").alias("clip_id"), "ts", F.col("t0").alias("t"), none.alias("f0"), F.col("tbu_idx").cast("int").alias("tbu_idx"), "target", "t0", "t1")


def unit_pitch(t: list[float], f0: list[float], t0: float, t1: float, late: float) -> float | None:
    """Semitones of the median pitch of a window's late part, else of all of it."""
    whole = [(x, y) for x, y in zip(t, f0, strict=True) if t0 <= x < t1]
    part = [y for x, y in whole if x >= t0 + late * (t1 - t0)] or [y for _, y in whole]
    return 12 * math.log2(max(median(part), 1e-6) / 100) if part else None


def declination(points: list[tuple[float, float]]) -> float:
    """The clamped median slope of all pairs of (time, semitones); 0 for fewer than three."""
    if len(points) < 3:
        return 0.0
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for k, a in enumerate(points) for b in points[k + 1 :] if abs(b[0] - a[0]) > 1e-9]
    return min(signal.SLOPE_MOST, max(signal.SLOPE_LEAST, median(slopes) if slopes else 0.0))


class Scorer(StatefulProcessor):
    """The states of a key's clips; times of a clip are ``unit`` seconds of event time each."""

    def __init__(self, gap: float, unit: float, theta_h: float, theta_l: float, late: float, digits: int | None = None):
        self.gap, self.unit, self.theta_h, self.theta_l, self.late, self.digits = gap, unit, theta_h, theta_l, late, digits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int | None, dict[str, dict]]:
        """When the key's timer goes off, and its clips' states."""
        held = self.open.get()
        if held is None:
            return None, {}
        plain = lambda v: list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v
        return held[0], {c[0]: dict(zip(FIELDS, map(plain, c), strict=True)) for c in held[1]}

    def _keep(self, due: int | None, clips: dict[str, dict]) -> None:
        """Writes the clips' states, and sees that a timer goes off no later than the first of them is due; one that goes off too early is set again."""
        first = min(map(self._due, clips.values()))
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(due := first)
        self.open.update((due, [tuple(s[c] for c in FIELDS) for s in clips.values()]))

    def _settle(self, s: dict, passed: float) -> None:
        """Closes the units that end by a time of the clip and drops the frames that no unit can need."""
        for k in range(len(s["idx"])):
            if not s["closed"][k] and s["t1"][k] <= passed:
                s["st"][k], s["closed"][k] = unit_pitch(s["t"], s["f0"], s["t0"][k], s["t1"][k], self.late), True
        still = [(a, b) for a, b, c in zip(s["t0"], s["t1"], s["closed"], strict=True) if not c]
        kept = [(x, y) for x, y in zip(s["t"], s["f0"], strict=True) if x > passed or any(a <= x < b for a, b in still)]
        s["t"], s["f0"] = [x for x, _ in kept], [y for _, y in kept]

    def _scores(self, clip: str, s: dict, final: bool) -> list[tuple]:
        live = sorted((k, (a + b) / 2, st, tone) for k, a, b, st, tone, c in zip(s["idx"], s["t0"], s["t1"], s["st"], s["target"], s["closed"], strict=True) if c)
        slope = declination([(t, st) for _, t, st, _ in live if st is not None])
        res = [None if st is None else st - slope * t if self.digits is None else round(st - slope * t, self.digits) for _, t, st, _ in live]
        known = [r for r in res if r is not None]
        mid = median(known) if known else None
        if not final:
            return [(clip, False, None, None, None, None, slope, mid, len(live))]
        said = [None if r is None else "H" if r - mid >= self.theta_h else "L" if r - mid <= -self.theta_l else "M" for r in res]
        return [(clip, True, k, tone, p, r, slope, mid, len(live)) for (k, _, _, tone), p, r in zip(live, said, res, strict=True)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (due, clips), mark = self._read(), timerValues.getCurrentWatermarkInMs() / 1000
        changed, out = {}, []
        for b in rows:
            is_unit, is_frame = (b[c].notna().tolist() for c in ("tbu_idx", "f0"))
            for clip, unit, frame, when, t, f0, k, tone, t0, t1 in zip(b.clip_id, is_unit, is_frame, *(b[c].tolist() for c in ("at", "t", "f0", "tbu_idx", "target", "t0", "t1")), strict=True):
                s = clips.get(clip)
                if s is None:
                    s = clips[clip] = dict(zip(FIELDS, (clip, when - t * self.unit, -math.inf, 0, [], [], [], [], [], [], [], []), strict=True))
                changed[clip] = s
                s["last"] = max(s["last"], when)
                if unit:
                    for c, v in zip(("idx", "target", "t0", "t1", "st", "closed"), (int(k), tone, t0, t1, None, False), strict=True):
                        s[c].append(v)
                    s["last"] = max(s["last"], s["base"] + t1 * self.unit)
                elif frame:
                    s["t"].append(t)
                    s["f0"].append(f0)
        for clip, s in changed.items():
            self._settle(s, (mark - s["base"]) / self.unit)
            if (n := sum(s["closed"])) > s["told"]:
                s["told"] = n
                out += self._scores(clip, s, final=False)
        self._keep(due, clips)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _due(self, s: dict) -> int:
        return int((s["last"] + self.gap) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (_, clips), mark, out = self._read(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
        for clip in [c for c, s in clips.items() if self._due(s) <= mark]:
            s = clips.pop(clip)
            self._settle(s, math.inf)
            out += self._scores(clip, s, final=True)
        if clips:
            self._keep(None, clips)  # the timer that went off is dropped by itself
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def scores(rows: DataFrame, delay: str = "10 seconds", gap: float = 5.0, unit: float = 1.0, theta_h: float = signal.THETA_H, theta_l: float = signal.THETA_L, late: float = signal.LATE, digits: int | None = None, groups: int | None = None) -> DataFrame:
    """Running and final rows of a stream of ``ROWS``. delay: how late a row may come; gap: seconds of event time after which a silent clip is final; digits: to which residuals are rounded; groups: how many keys all clips share, one a clip without it. Needs the RocksDB state store (``state_store``)."""
    key = F.xxhash64("clip_id")
    marked = rows.withWatermark("ts", delay).withColumns({"at": F.unix_micros("ts") / 1e6, "_key": key if groups is None else F.pmod(key, F.lit(groups))})
    return marked.groupBy("_key").transformWithStateInPandas(statefulProcessor=Scorer(gap, unit, theta_h, theta_l, late, digits), outputStructType=T.StructType.fromDDL(SCORES), outputMode="Append", timeMode="EventTime")


def state_store(spark) -> None:
    """Keyed state with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
