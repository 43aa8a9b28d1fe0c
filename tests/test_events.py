import collections
import datetime as dt

from speechloom.streaming import events, scoring

T0 = dt.datetime(2024, 1, 1, 10, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, path, rows):
    spark.createDataFrame(rows, scoring.SCHEMA).coalesce(1).write.mode("append").json(str(path))


def run(stream, tmp_path, name="out"):
    q = events.sink(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def rows(spark, tmp_path, schema, name="out"):
    return events.written(spark, str(tmp_path / name), schema).drop("batch_id").collect()


def test_each_row_once_over_restarts_and_a_repeated_batch(spark, tmp_path):
    stream = lambda: events.once(scoring.read(spark, str(tmp_path / "in")), ["utt_id"])
    put(spark, tmp_path / "in", [("a", "x", "x", at(0)), ("b", "x", "y", at(1)), ("a", "x", "x", at(2))])
    run(stream(), tmp_path)
    put(spark, tmp_path / "in", [("b", "x", "y", at(3)), ("c", "x", "x", at(4)), ("c", "x", "x", at(4))])
    run(stream(), tmp_path)
    commits = sorted((tmp_path / "out-checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last = commits[-1]  # as if the driver had died after the batch was written and before it was committed
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    put(spark, tmp_path / "in", [("d", "x", "x", at(5)), ("a", "x", "x", at(6))])
    run(stream(), tmp_path)
    got = collections.Counter(r.utt_id for r in rows(spark, tmp_path, scoring.SCHEMA))
    assert got == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_sessions_end_by_a_gap(spark, tmp_path):
    stream = lambda: events.sessions(scoring.read(spark, str(tmp_path / "in")), "utt_id")
    put(spark, tmp_path / "in", [("a", "x", "x", at(0)), ("a", "x", "y", at(4)), ("a", "x", "x", at(10)), ("b", "x", "x", at(2))])
    run(stream(), tmp_path)
    put(spark, tmp_path / "in", [("z", "x", "x", at(60))])
    run(stream(), tmp_path)
    put(spark, tmp_path / "in", [("a", "x", "x", at(8)), ("z", "x", "x", at(61))])  # the first is later than the watermark
    run(stream(), tmp_path)
    got = sorted((r.utt_id, r.start, r.end, r.n, r.exact_match) for r in rows(spark, tmp_path, "utt_id string, start timestamp, end timestamp, n long, exact_match double"))
    assert got == [("a", at(0), at(9), 2, 0.5), ("a", at(10), at(15), 1, 1.0), ("b", at(2), at(7), 1, 1.0)]


def test_predictions_meet_references_by_time(spark, tmp_path):
    def stream():
        return events.matched(scoring.read(spark, str(tmp_path / "p")), scoring.read(spark, str(tmp_path / "r")))

    put(spark, tmp_path / "r", [("a", "said a", "", at(0)), ("b", "said b", "", at(1)), ("c", "said c", "", at(2))])
    put(spark, tmp_path / "p", [("a", "", "heard a", at(5)), ("c", "", "heard c", at(90)), ("n", "", "heard n", at(6))])
    run(stream(), tmp_path)
    put(spark, tmp_path / "r", [("y", "said y", "", at(400))])
    put(spark, tmp_path / "p", [("b", "", "late", at(7)), ("y", "", "heard y", at(401))])
    run(stream(), tmp_path)
    put(spark, tmp_path / "r", [("z", "said z", "", at(402))])
    put(spark, tmp_path / "p", [("z", "", "heard z", at(403))])
    run(stream(), tmp_path)
    got = {(r.utt_id, r.output, r.actual) for r in rows(spark, tmp_path, "utt_id string, ts timestamp, output string, actual string")}
    assert got >= {("a", "said a", "heard a"), ("c", None, "heard c"), ("n", None, "heard n"), ("y", "said y", "heard y"), ("z", "said z", "heard z")}
    assert collections.Counter(r[0] for r in got)["c"] == 1
