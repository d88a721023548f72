import pytest

from contourlake.plans import signal_queries

#: Texts as they are after normalising, so that brute force needs no normaliser.
TEXTS = ["plain text here", "plain tekst", "stra\u00dfe und haus", "strasse und haus", "\u6f22\u5b57 end", "\u6f22 end", "\u03bb\u03bc\u03bd"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_pairs_has_every_pair(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["cer"] for r in signal_queries.QUERIES["cer_pairs"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(edits(a, b) / len(a), abs=1e-6) for i, (a, b) in enumerate(zip(TEXTS, TEXTS[1:], strict=False))}
