import statistics
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import metrics, resample
from contourlake.plans import pipelines

TBU = "clip_id long, tbu_idx int, target string, pred string"


@pytest.fixture(scope="module")
def tbu(spark):
    rng = np.random.default_rng(6)
    rows = [(c, k, str(rng.choice(["H", "M", "L", "X"])), [None, "H", "M", "L", "Y"][rng.integers(0, 5)]) for c in range(60) for k in range(int(rng.integers(1, 9)))]
    return spark.createDataFrame([*rows, (99, 0, None, "H")], TBU)


def test_the_last_plan_reads_rows_that_are_counted(spark, tbu):
    out = pipelines.answer_key_oracle(tbu, 50, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "tbu_idx" not in plan
    got, of = out.first(), lambda df: df.first()["balanced_acc"]
    assert (got["right"], got["swapped"], got["high_low"]) == tuple(pytest.approx(of(metrics.population(f(tbu)))) for f in (lambda u: u, resample.swap_high_low, resample.only_high_low))
    floors = [r["balanced_acc"] for r in metrics.population(resample.permuted_targets(tbu, *range(4)), ["seed"]).collect()]
    assert (got["floor"], got["floor_std"]) == (pytest.approx(statistics.fmean(floors)), pytest.approx(statistics.pstdev(floors)))
    assert got["delta_lo"] <= got["delta"] <= got["delta_hi"]


def test_population_of_cells_is_that_of_their_units(tbu):
    for keys in ([], ["clip_id"]):
        a, b = metrics.population(tbu, keys), metrics.population(metrics.cells(tbu, keys), keys, "n")
        assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_limits_of_a_bootstrap_are_places_of_its_replicates(spark, tbu):
    counts, stat = resample.clip_counts(tbu), resample.balanced()
    values = {r["rep"]: r["v"] for r in resample.replicates(counts, 40, 3).select("rep", stat.alias("v")).collect()}
    v = sorted(x for k, x in values.items() if k >= 0)
    out = resample.bootstrap(counts, stat, 40, 3, 0.05, 1.0)
    assert tuple(out.first()) == (values[-1], v[floor(0.05 * 40)], v[-1]) and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert resample.bootstrap(counts, F.lit(None).cast("double"), 5, 3, 0.1).count() == 0 and resample.bootstrap(counts.limit(0), stat, 5, 3, 0.1).count() == 0
