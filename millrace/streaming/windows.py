"""Structured Streaming over the event stream: windows with late data, a restartable exactly-once log, duplicate delivery, keyed state.

Each query reads the stream to its end and gives what a batch query of the same rows gives; sinks and checkpoints lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.session import importable, materialize, shared_dir


def source(spark, sf: str) -> DataFrame:
    """The events as a stream with the column `at`, the event time."""
    importable(spark)
    # As a pattern the path may be a file or a folder.
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def steps(spark, df: DataFrame, name: str, n: int = 4) -> tuple[DataFrame, str]:
    """`df` written in `n` files, in order of event_id, and a stream that takes one file a batch: an unbounded ordered source of steps."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}/in"
    edges = df.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    lo, hi = edges["lo"] or 0, edges["hi"] or 0
    for k in range(n):  # files are taken by age
        a, b = lo + (hi - lo + 1) * k // n, lo + (hi - lo + 1) * (k + 1) // n
        df.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has, into a table whose commits are the sink's own log, and returns that table.

    A run that was stopped goes on from its checkpoint; rows that a failed batch wrote aren't part of the table.
    """
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("stream_windows", """
WITH m AS (SELECT max(ts) AS t FROM events), d AS (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events)
SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM d, m WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= t - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_windows(spark, sf):
    """Events by type and day, each day written once, when the watermark (a day behind the latest event) has passed its end; its state then goes."""
    counts = source(spark, sf).withWatermark("at", "1 day").groupBy("event_type", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return run_to_end(counts.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "events", "total"), place(spark, "stream-windows"))


@query("stream_ledger", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ledger(spark, sf):
    """A log of steps that is written once although the run stops twice: each start takes a part of the source and leaves the rest."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    stream, _ = steps(spark, events, "stream-ledger")
    path = place(spark, "stream-ledger")
    for _ in range(2):  # these runs are stopped after a batch or so
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(processingTime="0 seconds").start()
        while run.isActive and not run.recentProgress:
            run.awaitTermination(1)
        run.stop()
    return run_to_end(stream, path)


@query("stream_batches", """
WITH e AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), b AS (SELECT (event_id - lo) * 4 // (hi - lo + 1) AS k, event_id, value FROM events, e)
SELECT CAST(sum(1) AS BIGINT) AS records, CAST(min(event_id) AS BIGINT) AS first_record, CAST(max(event_id) AS BIGINT) AS last_record FROM (SELECT event_id, lo + (hi - lo + 1) * 1 // 4 AS a, lo + (hi - lo + 1) * 2 // 4 AS b, lo + (hi - lo + 1) * 3 // 4 AS c FROM events, e) GROUP BY (event_id >= a)::INT + (event_id >= b)::INT + (event_id >= c)::INT""")
def stream_batches(spark, sf):
    """Steps handed to a function batch by batch; each writes under its number, so a batch that is run again overwrites itself."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    stream, _ = steps(spark, events, "stream-batches")
    path = place(spark, "stream-batches")

    def keep(batch: DataFrame, number: int) -> None:
        batch.agg(F.count("*").alias("records"), F.min("event_id").alias("first_record"), F.max("event_id").alias("last_record")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.schema("records long, first_record long, last_record long").parquet(f"{path}/out").drop("batch")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    """Every record is delivered twice, as after a crash; the second delivery goes, within the watermark's reach."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    stream, path = steps(spark, events, "stream-dedup", 1)
    events.coalesce(1).write.mode("append").parquet(path)
    once = stream.withWatermark("at", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    return run_to_end(once.select("event_id", "user_id", "event_type"), place(spark, "stream-dedup"))


_TOTALS = "user_id long, records long, tokens long, first_record long, last_record long, gaps long"


@query("stream_state", """
WITH l AS (SELECT user_id, event_id, event_id % 97 + 1 AS n, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS tokens, min(event_id) AS first_record, max(event_id) AS last_record, CAST(count_if(abs(day - before) > 1) AS BIGINT) AS gaps FROM l GROUP BY user_id""")
def stream_state(spark, sf):
    """State by key across batches: each user's records, tokens, first and last record, and jumps of more than a day between records."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")).cast("long").alias("day"))
    stream, _ = steps(spark, events, "stream-state")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, tokens, first, last, gaps, day = state.get if state.exists else (0, 0, -1, -1, 0, -1)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for e, d in zip(rows["event_id"].tolist(), rows["day"].tolist(), strict=True):
            gaps += day >= 0 and abs(d - day) > 1
            n, tokens, first, last, day = n + 1, tokens + e % 97 + 1, e if first < 0 else first, e, d
        state.update((n, tokens, first, last, int(gaps), day))
        yield pd.DataFrame([(key[0], n, tokens, first, last, int(gaps))], columns=[c.split(" ")[0] for c in _TOTALS.split(", ")])

    totals = stream.groupBy("user_id").applyInPandasWithState(update, _TOTALS, "n long, tokens long, first long, last long, gaps long, day long", "update", "NoTimeout")
    path = place(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    run = totals.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{_TOTALS}, batch int").parquet(f"{path}/out")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("records", "tokens", "first_record", "last_record", "gaps"), "batch").alias("x"))
    return last.select("user_id", "x.*")
