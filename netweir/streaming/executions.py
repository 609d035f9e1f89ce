"""Execution life cycle as a stream: approvals that time out, durations of finished runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions.timing import duration_seconds, elapsed_seconds, micros
from netweir.operators.runbooks import APPROVAL_TIMEOUT_S

MICRO = 1_000_000
DONE = ["Completed", "Failed", "Cancelled", "RolledBack"]


STATE = "execution STRING, deadline_us BIGINT, left_us BIGINT, ended_us BIGINT"


def track_batches(path: str, late_s: int = 0, keep_s: int = 7 * 86_400) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that follows executions until their approval times out or they finish.

    Input rows: execution, phase, ts, start_time, approval_timeout. An execution whose first
    event after PendingApproval comes later than its deadline has timed out, and that is its
    end; so has one that still waits when the newest event seen is ``late_s`` past the deadline.
    Each execution ends once, however its events are cut into batches of rising time. Between
    batches one row per execution is kept; ended ones for ``keep_s`` more, so that repeated
    events do not end them again.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        us = micros(F.col("ts"))
        pending = F.col("phase") == "PendingApproval"
        wait = (duration_seconds(F.col("approval_timeout"), APPROVAL_TIMEOUT_S) * MICRO).cast("long")
        done = F.when(F.col("phase").isin(DONE), F.struct("ts", "phase", "start_time"))
        events = batch.groupBy("execution").agg(
            F.min(F.when(pending, us + wait)).alias("new_deadline"), F.min(F.when(~pending, us)).alias("new_left"), F.min(done).alias("done"), F.max(us).alias("newest")
        ).persist()
        try:
            newest = events.agg(F.max("newest")).first()[0] or 0
            before = spark.createDataFrame([], STATE)
            if batch_id > 0:
                before = spark.read.schema(STATE).parquet(f"{path}/waiting/batch_id={batch_id - 1}")
                newest = max(newest, spark.read.parquet(f"{path}/clock/batch_id={batch_id - 1}").first()[0])
            spark.range(1).select(F.lit(newest).cast("long").alias("us")).write.mode("overwrite").parquet(f"{path}/clock/batch_id={batch_id}")
            deadline, left = F.least("deadline_us", "new_deadline"), F.least("left_us", "new_left")
            now = before.join(events, "execution", "full").withColumns({"deadline_us": deadline, "left_us": left})
            overdue = F.coalesce(F.col("left_us") > F.col("deadline_us"), F.lit(newest - late_s * MICRO) > F.col("deadline_us"), F.lit(False))
            now = now.withColumn("late", overdue & F.col("deadline_us").isNotNull()).withColumn(
                "ends", F.col("ended_us").isNull() & (F.col("late") | F.col("done").isNotNull())
            )
            ended = now.where("ends").select(
                "execution",
                F.when(F.col("late"), "TimedOut").otherwise(F.col("done.phase")).alias("phase"),
                F.when(F.col("late"), F.timestamp_micros("deadline_us").cast("timestamp_ntz")).otherwise(F.col("done.ts").cast("timestamp_ntz")).alias("at"),
                F.when(~F.col("late"), elapsed_seconds(F.col("done.start_time"), F.col("done.ts"))).alias("duration_s"),
            )
            ended.write.mode("overwrite").parquet(f"{path}/ended/batch_id={batch_id}")
            kept = now.select("execution", "deadline_us", "left_us", F.when(F.col("ends"), F.lit(newest).cast("long")).otherwise(F.col("ended_us")).alias("ended_us"))
            kept = kept.where(F.col("ended_us").isNull() | (F.col("ended_us") > newest - keep_s * MICRO))
            kept.write.mode("overwrite").parquet(f"{path}/waiting/batch_id={batch_id}")
        finally:
            events.unpersist()

    return sink
