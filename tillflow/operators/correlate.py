"""Requests and their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def in_time(timeout: str) -> Column:
    """Responses that come no earlier than the request and within ``timeout``."""
    return F.col("response_ts").between(F.col("request_ts"), F.col("request_ts") + F.expr(f"interval {timeout}"))


def correlate(requests: DataFrame, responses: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    """Each request with its first response in time; later ones are ignored.

    ``requests`` (unique request_id, request_ts), ``responses`` (request_id,
    response_ts and what the response says: result, message, params or any
    other columns, which come along; of equal times the smallest). Responses are reduced to one row per request before the
    outer join, so a request with very many responses stays cheap: the inner
    join may be split on the response side and the minimum combines map-side.
    """
    said = [c for c in responses.columns if c not in ("request_id", "response_ts")]
    first = (responses.join(requests.select("request_id", "request_ts"), "request_id")
             .where(in_time(timeout))
             .groupBy("request_id").agg(F.min(F.struct("response_ts", *said)).alias("first_"))
             .select("request_id", "first_.*"))
    return requests.join(first, "request_id", "left").withColumn("answered", F.col("response_ts").isNotNull())


def orphan_responses(responses: DataFrame, requests: DataFrame) -> DataFrame:
    return responses.join(requests.select("request_id"), "request_id", "left_anti")


def timed_out(requests: DataFrame, responses: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    return correlate(requests, responses.select("request_id", "response_ts"), timeout).where(~F.col("answered")).drop(
        "response_ts", "answered")


def dedup_requests(requests: DataFrame) -> DataFrame:
    """One row per request id: the earliest time it was sent, and how often."""
    return requests.groupBy("request_id").agg(F.min("request_ts").alias("request_ts"), F.count("*").alias("copies"))


def throughput(requests: DataFrame, ts: str = "ts", width: str = "1 second", slide: str | None = None) -> DataFrame:
    """Requests per route, and the most within one window; with ``slide`` windows begin that far apart and overlap."""
    if slide is not None:
        peaks = requests.groupBy("route", F.window(F.col(ts).cast("timestamp"), width, slide)).agg(F.count("*").alias("n"))
        counts = requests.groupBy("route").agg(F.count("*").alias("n_requests"))
        return counts.join(peaks.groupBy("route").agg(F.max("n").alias("peak")), "route")
    per_window = requests.groupBy("route", F.window(F.col(ts).cast("timestamp"), width)).agg(F.count("*").alias("n"))
    return per_window.groupBy("route").agg(F.sum("n").alias("n_requests"), F.max("n").alias("peak"))


def sessions(requests: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Stretches of a key's requests no further apart than ``gap``: first and last time, and how many.

    Works on a stream as well, where ``ts`` must carry a watermark.
    """
    return (requests.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
            .select(key, F.col("session_window.start").alias("first"), "last", "n"))
