import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from contourlake.streaming import scorer
from test_scorer import batch, check, end, feed, run, store, study  # noqa: F401


@pytest.mark.parametrize("groups", [1, 3])
def test_clips_that_share_a_key_end_one_by_one(spark, store, tmp_path, groups):  # noqa: F811
    rng = random.Random(11)
    rows = study(rng, clips=5)
    want = batch(spark, rows)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.random() * 3))
    for k in range(0, len(rows), 80):
        feed(spark, f"{tmp_path}/in", rows[k : k + 80])
    first = run(spark, tmp_path, delay="4 seconds", gap=2.0, groups=groups)  # stops with clips open, and goes on
    end(spark, f"{tmp_path}/in")
    got = run(spark, tmp_path, delay="4 seconds", gap=2.0, groups=groups)
    assert {r["clip_id"] for r in first if r["final"]} < {c for c, _ in want}
    check(got, want)


class Store:
    """One key's state and timers, with how often the store was asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.remove(at)


def test_one_timer_and_few_calls_for_all_clips_of_a_key():
    s, held = scorer.Scorer(5.0, 1.0, 1.0, 1.0, 0.5), Store()
    s.init(held)
    data = lambda *rows: list(s.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["clip_id", "at", "t", "f0", "tbu_idx", "target", "t0", "t1"])]), TimerValues(0, 0)))
    unit = lambda clip, start: (clip, start, 0.0, None, 0, "H", 0.0, 1.0)
    assert data(*(unit(f"c{k}", 10.0 * k) for k in range(1, 41))) == []
    assert held.timers == {16_000} and held.asked == 3
    data(("c1", 20.0, 10.0, 150.0, None, None, None, None))  # c1 is due later now, so its timer will go off too early
    assert held.timers == {16_000} and held.asked == 5

    def fires(at, mark):
        out = list(s.handleExpiredTimer((0,), TimerValues(0, mark), ExpiredTimerInfo(at)))
        held.timers.discard(at)  # as Spark does afterwards
        return [c for o in out for c in o.clip_id]

    assert fires(16_000, 16_000) == [] and held.timers == {25_000}
    assert sorted(fires(25_000, 36_500)) == ["c1", "c2", "c3"] and held.timers == {46_000} and len(held.value[1]) == 37
    assert len(fires(46_000, 10**9)) == 37 and held.value is None and not held.timers
