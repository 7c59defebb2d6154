"""Stream queries without state of our own: rates, correlation, duplicates, late rows."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from tillflow.operators.correlate import in_time
from tillflow.streaming.processors import FIRST_ANSWERS, FirstAnswerProcessor, InFrames, bucket


def throughput_stream(requests: DataFrame, width: str, lateness: str) -> DataFrame:
    """Requests per route and time window; rows later than ``lateness`` are dropped."""
    return (requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
            .groupBy("route", F.window("ts", width)).agg(F.count("*").alias("n"))
            .select("route", F.col("window.start").alias("window_start"), "n"))


def completed(spark: SparkSession, counts: DataFrame, path: str) -> DataFrame:
    """Run a counting stream over all there is and read its newest counts.

    Update mode writes a window again whenever its count grows. Each
    micro-batch overwrites its own folder, so a retried one adds nothing.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    (counts.writeStream.foreachBatch(keep).outputMode("update")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    keys = [c for c in counts.columns if c != "n"]
    return spark.read.schema(counts.schema).parquet(f"{path}/out/*").groupBy(*keys).agg(F.max("n").alias("n"))


def correlate_stream(requests: DataFrame, responses: DataFrame, timeout: str, lateness: str,
                     how: str = "inner") -> DataFrame:
    """Requests joined with their responses within ``timeout``.

    ``how="left_outer"`` also gives the requests that timed out, once the
    watermark has passed the end of their time.
    """
    left = requests.withWatermark("request_ts", lateness)
    right = responses.withColumnRenamed("request_id", "response_to").withWatermark("response_ts", lateness)
    joined = left.join(right, (F.col("request_id") == F.col("response_to")) & in_time(timeout), how)
    return joined.select("request_id", "request_ts", "response_ts")


def first_answers(requests: DataFrame, responses: DataFrame, timeout_seconds: int, lateness: str) -> DataFrame:
    """One row per request, answered or (``response_ts`` NULL) timed out, as soon as the watermark tells.

    ``requests`` has request_id and request_ts, ``responses`` request_id and
    response_ts. State lasts no longer than timeout and ``lateness``; both
    sides meet in one keyed state, so repeated answers make no pairs. A request
    without time has no answer in time, and an answer without time is none.
    """
    both = requests.select("request_id", F.col("request_ts").alias("ts"), F.lit(False).alias("is_answer")).unionByName(
        responses.select("request_id", F.col("response_ts").alias("ts"), F.lit(True).alias("is_answer")))
    both = both.where("ts is not null").withColumns({"us": F.unix_micros("ts"), "bucket": bucket("request_id")})
    processor = InFrames(FirstAnswerProcessor(timeout_seconds * 1000), ["request_id", "is_answer", "us"], FIRST_ANSWERS)
    found = both.withWatermark("ts", lateness).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=FIRST_ANSWERS, outputMode="append", timeMode="eventTime")
    timeless = requests.where("request_ts is null").select("request_id", "request_ts", F.col("request_ts").alias("response_ts"))
    return found.select("request_id", F.timestamp_micros("request_us").alias("request_ts"),
                        F.timestamp_micros("response_us").alias("response_ts")).unionByName(timeless)


def dedup_stream(requests: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The first arrival of every request id; its copies within ``lateness`` are dropped."""
    return requests.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["request_id"])


class LateRows(StreamingQueryListener):
    """Counts, per query, the rows dropped because they came after the watermark.

    The count grows with every micro-batch's report, so it does not depend on
    how many reports the session keeps.
    """

    def __init__(self):
        self.dropped: Counter = Counter()
        self.ended: defaultdict = defaultdict(threading.Event)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.dropped[str(event.progress.runId)] += sum(
            op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()


def late_rows(spark: SparkSession, writer: DataStreamWriter, timeout: float = 120) -> int:
    """Run a stream to its end; how many rows it dropped as late."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        query = writer.start()
        query.awaitTermination()
        if not listener.ended[str(query.runId)].wait(timeout):
            raise TimeoutError("the stream's last report did not come")
        return listener.dropped[str(query.runId)]
    finally:
        spark.streams.removeListener(listener)
