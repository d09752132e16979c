"""Streams over several batches, repeated batches and restarts from a checkpoint."""

import time

import pytest
from pyspark.sql import functions as F

from mateframe.streaming import streams as S

SCHEMA = "run string, at long, loss double, acc double"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def lines(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(batches):
    """Deltas and bests of lines in the order of batches, then of ``at``."""
    best, last, out = {}, {}, []
    for batch in batches:
        for run, at, loss, acc in sorted(batch, key=lambda r: (r[0] or "", r[1])):
            before = last.get(run, (None, None))
            delta = [round(x - y, 9) if x is not None and y is not None else 0.0 for x, y in zip((loss, acc), before)]
            better = acc is not None and (best.get(run) is None or acc > best[run])
            best[run] = acc if better else best.get(run)
            last[run] = (loss, acc)
            out.append((run, at, *delta, best[run], better))
    return sorted(out, key=str)


BATCHES = [
    [("a", 1, 3.0, 0.1), ("a", 2, 2.0, 0.5), ("b", 1, 9.0, 0.2), (None, 5, 1.0, 0.3)],
    [("a", 3, 2.5, 0.4), ("c", 1, 1.0, 0.9), (None, 6, 1.0, 0.4)],
    [("b", 2, 8.0, 0.7), ("a", 5, 1.0, 0.5), ("a", 4, 1.5, 0.6), ("a", 0, 4.0, 0.0)],
]


def logged(spark, folder, stream):
    S.live_log(stream, f"{folder}/out", f"{folder}/cp", run="run", order=["at"], metrics=["loss", "acc"], lead="acc").awaitTermination()


def test_live_log_across_batches_and_restarts(spark, folder):
    """Each batch is a run of its own from the checkpoint; a run with nothing new changes nothing."""
    schema = lines(spark, []).schema
    for batch in BATCHES:
        lines(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        logged(spark, folder, S.shards(spark, f"{folder}/in", schema))
        logged(spark, folder, S.shards(spark, f"{folder}/in", schema))
    got = [(r["run"], r["at"], round(r["delta_loss"], 9), round(r["delta_acc"], 9), r["best"], r["better"]) for r in S.log_lines(spark, f"{folder}/out", schema, ["loss", "acc"]).collect()]
    assert sorted(got, key=str) == by_hand(BATCHES)
    state = {r["run"]: (r["lines"], r["best"], r["last_loss"]) for r in S.latest(spark, f"{folder}/out/state", S.log_state(lines(spark, []), "run", ["loss", "acc"])).collect()}
    assert state == {"a": (6, 0.6, 1.0), "b": (2, 0.7, 8.0), "c": (1, 0.9, 1.0), None: (2, 0.4, 1.0)}


def test_live_log_in_one_stream_of_many_batches(spark, folder):
    schema = lines(spark, []).schema
    for batch in BATCHES:
        lines(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken up by their time
    logged(spark, folder, S.shards(spark, f"{folder}/in", schema, 1))
    got = S.log_lines(spark, f"{folder}/out", schema, ["loss", "acc"])
    assert sorted(((r["run"], r["at"], round(r["delta_loss"], 9), round(r["delta_acc"], 9), r["best"], r["better"]) for r in got.collect()), key=str) == by_hand(BATCHES)


def test_repeated_batch_counts_once(spark, folder):
    """A batch that is merged again, as after a failure, leaves the totals as they are."""
    kind = "k string, n long"
    first, second = spark.createDataFrame([("x", 3), (None, 1)], kind), spark.createDataFrame([("x", 5), ("y", 2)], kind)
    for number, batch in ((0, first), (0, first), (1, second), (1, second), (1, second)):
        S.merge_totals(batch, number, folder, "k")
    assert sorted(map(tuple, S.latest(spark, folder, first.schema).collect()), key=str) == sorted([("x", 5), ("y", 2), (None, 1)], key=str)


def test_live_totals_and_progress(spark, folder):
    listener = S.Progress()
    spark.streams.addListener(listener)
    try:
        for part in (["x", "x", None], ["y", "x"], ["y"]):
            spark.createDataFrame([(p,) for p in part], "k string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = S.shards(spark, f"{folder}/in", "k string")
            S.live_totals(stream, "k", f"{folder}/out", f"{folder}/cp").awaitTermination()
        got = S.latest(spark, f"{folder}/out", S.totals(spark.createDataFrame([], "k string"), "k").schema)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 3), ("y", 2), (None, 1)], key=str)
        until = time.time() + 30
        while sum(r[3] for r in listener.rows) < 6 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    seen = listener.table(spark).where("rows > 0").orderBy("batch").collect()
    assert [r["rows"] for r in seen] == [3, 2, 1] and seen[-1]["state_rows"] == 3


def test_event_time_dedup_drops_late_rows_and_forgets(spark, folder):
    """A repeat within the delay goes; a row behind the watermark goes; keys leave the state."""
    def batch(rows):
        frame = spark.createDataFrame([(k, t) for k, t in rows], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = S.distinct_keys(S.shards(spark, f"{folder}/in", frame.schema), ["k"], "ts", "1 hour")
        return [r["k"] for r in S.drain(stream, f"{folder}/out", f"{folder}/cp", "append").collect()]

    listener = S.Progress()
    spark.streams.addListener(listener)
    try:
        assert sorted(batch([("a", 7200), ("b", 7000), ("a", 7100)])) == ["a", "b"]
        assert sorted(batch([("a", 9000), ("c", 20000), ("b", 6900)])) == ["a", "b", "c"]  # out of order, within the hour
        assert sorted(batch([("d", 9000), ("e", 21000)])) == ["a", "b", "c", "e"]  # d is behind the watermark
        until = time.time() + 30
        while not any(r[6] for r in listener.rows) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.table(spark).collect()
    assert sum(r["state_removed"] for r in rows) >= 2 and min(r["state_rows"] for r in rows[-2:]) <= 2
