import itertools
import random

import numpy as np
import pytest

from contourlake.plans import signal_queries


def test_voice_diversity_takes_all_pairs(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.gauss(0.3, 1) for _ in range(8)]) for i in range(40)] + [(40, 0, [0.0] * 8), (41, 9, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["label"]: r for r in signal_queries.QUERIES["voice_diversity"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        pairs = list(itertools.combinations([np.array(v) for _, x, v in rows if x == k], 2))
        cosines = [a @ b / np.sqrt((a @ a) * (b @ b)) for a, b in pairs if a.any() and b.any()]
        assert r["pairs"] == len(pairs) and r["mean_cosine"] == pytest.approx(np.mean(cosines), abs=2e-6)
