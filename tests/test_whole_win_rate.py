import pytest

from contourlake.plans import metric_queries


def test_paired_win_rate_reads_all_pairs(spark, data):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").select("l_tax", "l_discount").collect()
    wins, losses = sum(t > d for t, d in rows), sum(t < d for t, d in rows)
    r = metric_queries.QUERIES["paired_win_rate"](spark, data).first()
    assert (r["n"], r["wins"], r["losses"]) == (len(rows), wins, losses)
    assert r["win_rate"] == pytest.approx((wins + 0.5 * (len(rows) - wins - losses)) / len(rows), abs=1e-6)
    assert r["mean_margin"] == pytest.approx(sum(float(t) - float(d) for t, d in rows) / len(rows), abs=1e-6)
