"""The preprocessing worker as a stateful stream: messages land as files, each input's status follows them.

A message (MESSAGE) says that an input is queued, or what preprocessing made of it. State is kept by input: its last
message, how many it had, and which, so that a message that comes again changes nothing and one that comes late doesn't
undo a later one. A timer marks inputs that stay queued. What cannot be worked on is kept with a reason.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import preprocess as X
from .ingest import staged

MESSAGE = "message_id string, input_id string, at timestamp, stage string, kind string, outputs array<struct<page: int, ord: int, variant: string, is_candidate: boolean, operations: array<string>, readiness: double>>, error string"
STATUS = T.StructType([T.StructField(c, t) for c, t in (("input_id", T.StringType()), ("version", T.LongType()), ("message_id", T.StringType()), ("at_ms", T.LongType()), ("status", T.StringType()), ("reason", T.StringType()), ("preferred", T.StringType()), ("attempts", T.LongType()))])
LAST = T.StructType([f for f in STATUS.fields if f.name != "input_id"])
QUEUED, STALLED, REJECTED = "preprocessing", "preprocessing_stalled", "rejected"


def worked(messages: DataFrame) -> DataFrame:
    """(key, input_id, message_id, at_ms, status, reason, preferred) of each message: what the worker makes of it, row by row.

    A message without input_id or time is rejected under a key of its own. An error, a missing kind or stage is a failure
    with its reason; else readiness decides, as X.input_status() says.
    """
    rows = X.plan(messages.withColumn("kind", F.coalesce("kind", F.lit("")))).withColumnRenamed("status", "_plan")
    outs = F.coalesce("outputs", F.array().cast("array<struct<page: int, ord: int, variant: string, is_candidate: boolean, operations: array<string>, readiness: double>>"))
    known = F.filter(outs, lambda o: o["readiness"].isNotNull())
    mean = F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, o: s + o["readiness"]) / F.size(known), 4))
    best = F.array_max(F.transform(outs, lambda o: F.struct(o["is_candidate"].cast("int").alias("c"), o["readiness"].alias("r"), (-o["ord"]).alias("o"), o["variant"].alias("variant"))))["variant"]
    ready = F.coalesce("is_ready", best.isNotNull() & (mean.isNull() | (mean >= 0.35)))
    wrong = F.when(F.coalesce("input_id", F.lit("")) == "", "missing_input_id").when(F.col("at").isNull(), "missing_time")
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("kind") == "", "missing_classification_kind").when(~F.coalesce(F.col("stage").isin("queued", "prepared"), F.lit(False)), "unknown_stage")
    rows = rows.withColumn("_ready", ready).withColumn("_wrong", wrong).withColumn("_failed", failed)
    status = F.when(F.col("_wrong").isNotNull(), REJECTED).when(F.col("_failed").isNotNull(), "preprocessing_failed").when(F.col("stage") == "queued", QUEUED).when(F.col("_ready"), "preprocessed").otherwise("preprocessing_needs_review")
    key = F.when(F.col("_wrong").isNull(), F.col("input_id")).otherwise(F.concat(F.lit("\x00"), F.coalesce("message_id", F.lit(""))))
    preferred = F.when(status.isin("preprocessed", "preprocessing_needs_review"), F.when(F.col("kind") == "real_pdf", "original_pdf").otherwise(best))
    return rows.select(key.alias("key"), "input_id", F.coalesce("message_id", F.lit("")).alias("message_id"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), status.alias("status"), F.coalesce("_wrong", "_failed").alias("reason"), preferred.alias("preferred"))


class Worker(StatefulProcessor):
    """Keeps the last message of an input by (time, message_id). wait_ms: how long an input may stay queued."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = T.StringType()
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("message_id", text)]), T.StructType([T.StructField("at_ms", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = tuple(self.last.get()) if self.last.exists() else None
        now = old
        for r in rows:
            if r["status"] == REJECTED:
                yield Row(input_id=r["input_id"], version=0, message_id=r["message_id"], at_ms=r["at_ms"], status=REJECTED, reason=r["reason"], preferred=None, attempts=1)
                continue
            if self.seen.containsKey((r["message_id"],)):
                continue  # it came before
            self.seen.updateValue((r["message_id"],), (r["at_ms"],))
            version, attempts = (now[0] + 1, now[6] + 1) if now else (1, 1)
            if now is None or (r["at_ms"], r["message_id"]) > (now[2], now[1]):
                now = (version, r["message_id"], r["at_ms"], r["status"], r["reason"], r["preferred"], attempts)
            else:  # a late one counts, and no more
                now = (version, *now[1:6], attempts)
        if now != old:
            self.last.update(now)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now[3] == QUEUED:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            yield self.row(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = tuple(self.last.get())
        if now[3] == QUEUED:
            now = (now[0] + 1, *now[1:3], STALLED, "no_result_in_time", *now[5:])
            self.last.update(now)
            yield self.row(key, now)

    @staticmethod
    def row(key: tuple, now: tuple) -> Row:
        return Row(input_id=key[0], **dict(zip(LAST.names, now)))

    def close(self) -> None:
        pass


def run_worker(messages: DataFrame, out: str, checkpoint: str, wait: datetime.timedelta = datetime.timedelta(hours=1), **trigger) -> StreamingQuery:
    """Takes what has landed in the stream `messages`, in one batch unless a trigger is given (processingTime="1 minute"; availableNow doesn't end where timers run on the clock), and writes changes of status below out, by batch: a batch that runs again replaces its own files. Sets the session's state store, as timers and maps need RocksDB."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = worked(messages).groupBy("key").transformWithState(Worker(int(wait.total_seconds() * 1000)), STATUS, "Update", "ProcessingTime")
    return staged(changes, lambda b: b, out, checkpoint, "update", **(trigger or {"once": True}))


def statuses(spark: SparkSession, out: str) -> DataFrame:
    """The status of each input after all changes written below out; what was rejected is apart, in rejects()."""
    rows = spark.read.schema(STATUS).parquet(out).where(F.col("status") != REJECTED)
    return rows.groupBy("input_id").agg(F.max_by(F.struct(*(c for c in STATUS.names if c != "input_id")), "version").alias("s")).select("input_id", "s.*")


def rejects(spark: SparkSession, out: str) -> DataFrame:
    """Messages that no input could take, each once, with the reason."""
    return spark.read.schema(STATUS).parquet(out).where(F.col("status") == REJECTED).select("message_id", "input_id", "reason").distinct()


def batch_statuses(messages: DataFrame, stalled: Column | None = None) -> DataFrame:
    """The same table from all messages at once: (input_id, message_id, at_ms, status, reason, preferred, attempts). stalled: which inputs, still queued, have waited too long."""
    rows = worked(messages).where(F.col("status") != REJECTED)
    fields = ["message_id", "at_ms", "status", "reason", "preferred"]
    # a message that came twice is one: by its first form
    once = rows.groupBy("input_id", "message_id").agg(F.min(F.struct("at_ms", "status", "reason", "preferred")).alias("m")).select("input_id", "message_id", "m.*")
    out = once.groupBy("input_id").agg(F.max_by(F.struct(*fields), F.struct("at_ms", "message_id")).alias("s"), F.count(F.lit(1)).alias("attempts")).select("input_id", "s.*", "attempts")
    if stalled is None:
        return out
    late = (F.col("status") == QUEUED) & stalled
    return out.withColumn("reason", F.when(late, "no_result_in_time").otherwise(F.col("reason"))).withColumn("status", F.when(late, STALLED).otherwise(F.col("status")))
