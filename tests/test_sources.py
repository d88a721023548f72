import json

import pytest
from pyspark.sql import functions as F

from contourlake import storage
from contourlake.sources import readers, writers
from contourlake.streaming import monitor


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


def test_manifest_and_pairs(spark, tmp_path):
    m = put(tmp_path / "m.jsonl", "\n".join(json.dumps({"id": str(k), "text": "t", "source": "bible", "duration_sec": k * 1.0}) for k in range(9)))
    assert readers.manifest(spark, m, F.col("duration_sec").between(3, 6), 3).count() == 3
    pairs = put(tmp_path / "p.json", {"carriers": [{"template": "Mo rí ___", "gloss": "g", "verified": True}], "sets": [{"base": "oko", "items": [{"text": "ọkọ", "tones": "M-M", "gloss": "hoe", "verified": False}, {"text": "ọkọ̀", "tones": "M-L", "gloss": "car", "verified": True}]}]})
    got = {r["id"]: r["tones"] for r in readers.minimal_pairs(spark, pairs).collect()}
    assert got == {"mp_oko_0": ["M", "M"], "mp_oko_1": ["M", "L"]} and readers.carriers(spark, pairs).first()["template"] == "Mo rí ___"
    held = put(tmp_path / "h.json", {"language": "yo", "eval_texts": [{"base": "a", "text": "b", "more": {"deep": ['c, "d": ]', "è\n"]}}, "bare"], "other": "no"})
    assert {r[0] for r in readers.holdouts(spark, held).collect()} == {"a", "b", 'c, "d": ]', "è\n", "bare"}
    assert [r[0] for r in readers.holdouts(spark, put(tmp_path / "h1.json", {"eval_texts": "single one"})).collect()] == ["single one"]
    assert readers.holdouts(spark, put(tmp_path / "h2.json", {"eval_texts": None, "more": "x"})).count() == 0
    c = readers.calibration(spark, put(tmp_path / "c.json", {"theta_h": 1.5, "theta_l": 1.0})).first()
    assert tuple(c) == (1.5, 1.0, "blind", 0.5)


def test_keys_answers_and_forms(spark, tmp_path):
    items = spark.createDataFrame([("item01", "c1", 0.123456, False), ("item02", "c2", float("nan"), True)], "item_id string, clip_id string, tone_i2 double, is_catch boolean")
    path = put(tmp_path / "k.json", writers.keymap_json(items).first()[0])
    got = {r["item_id"]: (r["clip_id"], r["tone_i2"], r["is_catch"]) for r in readers.keymap(spark, path).collect()}
    assert got == {"item01": ("c1", 0.1235, False), "item02": ("c2", None, True)}
    csv = put(tmp_path / "a.csv", "item_id,answer\nitem01, OK \n,bad\nitem02,\n")
    codes = spark.createDataFrame([("r1", "PILOT1;item01=bad")], "rater string, code string")
    rows = readers.answers(spark, codes, [("r2", csv)]).collect()
    assert {tuple(r) for r in rows} == {("r1", "item01", "bad"), ("r2", "item01", "ok")}
    kit = spark.createDataFrame([("item01", "a </script> b", bytearray(b"wav"))], "item_id string, text string, audio binary").select("item_id", "text", writers.data_uri(F.col("audio")).alias("audio"))
    page = writers.form(kit, ["ok", "bad"], "Kit <1>")
    assert "a <\\/script> b" in page and "Kit &lt;1&gt;" in page
    back = readers.form_items(spark.createDataFrame([(page.replace("];\n", "];"),)], "html string")).first()
    assert back["item_id"] == "item01" and bytes(back["audio"]) == b"wav"


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = lambda tag, v: spark.createDataFrame([(tag, v)], "run_tag string, v double")
    for tag, v in (("a", 1.0), ("b", 2.0), ("a", 3.0), ("a", 3.0)):
        writers.upsert(run(tag, v), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("run_tag", "v").collect()} == {("a", 3.0), ("b", 2.0)}
    assert {tuple(r) for r in writers.upserted(run("a", 1.0).union(run("b", 2.0)), run("a", 9.0)).collect()} == {("a", 9.0), ("b", 2.0)}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "value")
    flush = events.limit(1).selectExpr("user_id", "event_type", "timestamp_ntz'2030-01-01' ts", "value")
    events.unionByName(flush).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    monitor.run_once(monitor.rates(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in monitor.rates(events).collect()}


def test_oracles_agree(spark):
    """Every core query against its SQL on the smallest tables."""
    import duckdb

    from contourlake.plans.queries import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    shown = lambda v: "-" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    for name in ("class_stats", "weighted_f1", "subset_metrics", "auroc", "wilson_interval", "budget_prefix", "tone_scores", "voiced_rhyme", "cer_pairs", "holdout_drop", "rater_gate", "stream_sessions"):
        a, b = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        assert sorted(tuple(map(shown, r)) for r in a[cols].itertuples(index=False)) == sorted(tuple(map(shown, r)) for r in b[cols].itertuples(index=False)), name


def test_forms_for_trials_give_a_csv(spark):
    kit = spark.createDataFrame([("item01", "t", "data:a", "data:b")], "item_id string, text string, audio_a string, audio_b string")
    page = writers.form(kit, ["A", "B", "unsure"], "Trials", "PILOT2")
    assert "it.audio_a" in page and "it.audio_b" in page and "responses.csv" in page and "'PILOT2'" in page and "item_id,answer" in page


def test_uploads_shards_and_logs(spark, tmp_path):
    files = spark.createDataFrame([(f"d{k % 2}/c{k}.wav", bytearray([k] * k)) for k in range(6)], "path string, content binary")
    for _ in range(2):
        assert {tuple(r) for r in writers.upload(files, f"file://{tmp_path}/up").collect()} == {(f"d{k % 2}/c{k}.wav", k) for k in range(6)}
    assert (tmp_path / "up/d1/c5.wav").read_bytes() == bytes([5] * 5)
    rows = spark.createDataFrame([(str(k), "t") for k in range(40)], "id string, text string")
    writers.shards(rows, str(tmp_path / "shards"), 4, 1)
    assert spark.read.json(str(tmp_path / "shards")).count() == 40 and 2 <= len(list((tmp_path / "shards").glob("part-*"))) <= 4
    log = spark.createDataFrame([("step 1",), ("loss 0.5",), ("noise",)], "value string")
    assert {r[0] for r in writers.tee(log, str(tmp_path / "log"), "step|loss").collect()} == {"step 1", "loss 0.5"}
    assert spark.read.text(str(tmp_path / "log")).count() == 3


def test_audio_uris():
    def broken(_):
        raise OSError("no codec")

    assert writers.audio_uri(b"ab").startswith("data:audio/wav;base64,") and writers.audio_uri(b"ab", broken) == writers.audio_uri(b"ab")
    assert writers.audio_uri(b"ab", lambda x: x[::-1]) == "data:audio/mpeg;base64,YmE="


def test_required_settings(spark):
    with pytest.raises(ValueError, match="spark.store.a, spark.store.b"):
        storage.required(spark, "spark.store.a", "spark.sql.session.timeZone", "spark.store.b")
    assert storage.required(spark, "spark.sql.session.timeZone") == {"spark.sql.session.timeZone": "UTC"}
