import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from speechloom.sources import io
from speechloom.streaming import scoring


def test_records_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "um é", "é", None), ("b", "x", "x", "k")], "id string, input string, output string, combo string")
    io.write_records(d, str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()]
    assert {"id", "input", "output", "combo"} == set(lines[0]) and any(x["combo"] is None for x in lines)
    back = io.read_records(spark, str(tmp_path / "r"))
    assert sorted((r.id, r.input, r.combo) for r in back.collect()) == [("a", "um é", None), ("b", "x", "k")]


def test_predictions_default_to_empty(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id":"a","output":"x"}\n\n{"id":"b","output":"x","actual":"y"}\n')
    assert sorted((r.id, r.actual) for r in io.read_predictions(spark, str(tmp_path / "p.json")).collect()) == [("a", ""), ("b", "y")]


def test_splits_and_recipes(spark, tmp_path):
    d = spark.createDataFrame([("1", "a", "train"), ("2", "a", "test"), ("3", "b", "train")], "id string, kind string, split string")
    assert io.write_splits(d, str(tmp_path / "s")) == {"train": {"a": 1, "b": 1}, "test": {"a": 1}}
    assert {(r.id, r.split) for r in io.read_splits(spark, str(tmp_path / "s")).collect()} == {("1", "train"), ("2", "test"), ("3", "train")}
    r = spark.createDataFrame([("r1", [("filler",) + (None,) * 9 + (2,)], "filler", "1", None)], io.RECIPE)
    assert io.recipes_from_json(io.recipes_to_json(r)).collect() == r.collect()


def test_config():
    assert io.load_config('{"total": 10}', ["seed:7", "total:20"]) == io.BuildConfig(total=20, seed=7)
    for bad in ('{"nope": 1}', '{"test": 0.9, "validation": 0.2}'):
        with pytest.raises(ValueError):
            io.load_config(bad)


def test_stream_scores(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 5)
    rows = [("1", "Call Hana now.", "Call Hana now.", t), ("2", "Call Hana now.", "Call now.", t)]
    spark.createDataFrame(rows, scoring.SCHEMA).write.json(str(tmp_path / "in"))
    q = scoring.windowed(scoring.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    r = spark.table("w").first()
    assert (r.n, r.exact_match) == (2, 0.5) and abs(r.wer - 1 / 6) < 1e-9
    assert spark.table("w").where(F.col("n") > 2).count() == 0


def test_review_keeps_twenty_a_bucket(spark, tmp_path):
    rows = [(f"u{i:03}", "wer" if i % 3 else "length", f'said "{i}", again') for i in range(90)] + [("u999", None, "fine")]
    io.write_review(spark.createDataFrame(rows, "utt_id string, bucket string, actual string"), str(tmp_path / "review"))
    got = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "review")).collect()
    assert sorted(r.utt_id for r in got if r.bucket == "length") == [f"u{i:03}" for i in range(0, 60, 3)]
    assert sum(r.bucket == "wer" for r in got) == 20 and len(got) == 40 and {r.utt_id: r.actual for r in got}["u001"] == 'said "1", again'
