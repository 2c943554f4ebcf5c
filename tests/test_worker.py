"""The stateful worker: restarts, replays, late and bad messages, timers; against the batch over all messages."""

import datetime
import time

from pyspark.sql import functions as F

from ledgerloom.streaming import ingest as I
from ledgerloom.streaming import worker as W

DAY = datetime.datetime(2025, 1, 1)
OUT = [(1, 0, "a", True, ["x"], 0.8), (1, 1, "b", True, ["x"], 0.9)]
LOW = [(1, 0, "a", True, ["x"], 0.1)]


def message(n, key, hours, stage="prepared", kind="screenshot", outputs=OUT, error=None):
    return (f"m{n}", key, None if hours is None else DAY + datetime.timedelta(hours=hours), stage, kind, outputs, error)


FILES = [
    [message(1, "a", 1, "queued"), message(2, "a", 2), message(3, "b", 1, "queued"), message(4, None, 1), message(5, "c", 5, outputs=LOW)],
    [message(2, "a", 2), message(6, "b", 3, error="broken"), message(7, "c", 2), message(8, "d", 1, kind=None), message(9, "e", None)],  # m2 again, m7 late
    [message(6, "b", 3, error="broken"), message(10, "b", 9), message(11, "f", 1, "queued"), message(12, "g", 1, kind="real_pdf", outputs=None), message(13, "h", 1, "what"), message(14, "a", 2, outputs=LOW)],  # m14 at the time of m2, which comes after it by name
]


def rows_of(df):
    return sorted(tuple(r[c] for c in ("input_id", "message_id", "at_ms", "status", "reason", "preferred", "attempts")) for r in df.collect())


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    landing, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    every = None
    for i, file in enumerate(FILES):
        rows = spark.createDataFrame(file, W.MESSAGE).coalesce(1)
        rows.write.mode("append").parquet(landing)
        every = rows if every is None else every.unionByName(rows)
        if i != 1:  # two files are taken by one run
            W.run_worker(I.landing(spark, landing, rows.schema, 1), out, cp).awaitTermination()
    want = rows_of(W.batch_statuses(every))
    assert rows_of(W.statuses(spark, out)) == want
    assert {r[0]: r[3] for r in want} == {"a": "preprocessed", "b": "preprocessed", "c": "preprocessing_needs_review", "d": "preprocessing_failed", "f": "preprocessing", "g": "preprocessed", "h": "preprocessing_failed"}
    assert {r[0]: r[4] for r in want if r[4]} == {"d": "missing_classification_kind", "h": "unknown_stage"} and {r[0]: r[6] for r in want}["b"] == 3
    assert {(r["message_id"], r["reason"]) for r in W.rejects(spark, out).collect()} == {("m4", "missing_input_id"), ("m9", "missing_time")}
    # nothing new: nothing changes
    before = spark.read.parquet(out).count()
    W.run_worker(I.landing(spark, landing, every.schema, 1), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == before


def test_timers_mark_what_stays_queued(spark, tmp_path):
    landing, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    take = lambda rows: (spark.createDataFrame(rows, W.MESSAGE).coalesce(1).write.mode("append").parquet(landing), W.run_worker(I.landing(spark, landing, spark.createDataFrame([], W.MESSAGE).schema), out, cp, datetime.timedelta(seconds=1)).awaitTermination())
    first, second, third = [message(1, "a", 1, "queued"), message(2, "b", 1, "queued")], [message(3, "b", 2)], [message(4, "c", 1)]
    for rows in (first, second):
        take(rows)
    time.sleep(1.5)
    take(third)
    every = spark.createDataFrame(first + second + third, W.MESSAGE)
    assert rows_of(W.statuses(spark, out)) == rows_of(W.batch_statuses(every, F.lit(True)))
    assert {r["input_id"]: r["status"] for r in W.statuses(spark, out).collect()} == {"a": "preprocessing_stalled", "b": "preprocessed", "c": "preprocessed"}
    take([message(5, "a", 3)])  # a result after all
    assert W.statuses(spark, out).where("input_id = 'a'").first()["status"] == "preprocessed"
