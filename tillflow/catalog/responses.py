"""Requests, their responses and their rates."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.views import sql
from tillflow.operators import correlate as ops
from tillflow.sources.fixtures import cmd, micros
from tillflow.sources.tables import table

TIMEOUT = "180 days"


def requests(spark, folder):
    return table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").alias("request_ts"))


def answers(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_shipdate").alias("response_ts"))


PAIRS = {
    "req": """SELECT CAST(o_orderkey AS VARCHAR) request_id, o_orderdate request_ts FROM orders WHERE o_orderstatus <> 'P'""",
    "resp": "SELECT CAST(l_orderkey AS VARCHAR) request_id, l_shipdate response_ts FROM lineitem",
    "answered": """SELECT request_id, request_ts, min(response_ts) response_ts FROM req LEFT JOIN resp
        ON resp.request_id = req.request_id AND response_ts >= request_ts
        AND response_ts <= request_ts + INTERVAL 180 DAY GROUP BY ALL""".replace("SELECT request_id", "SELECT req.request_id"),
}


@query("correlate", sql("""
    SELECT request_id, epoch_us(request_ts) request_at, epoch_us(response_ts) response_at,
           response_ts IS NOT NULL answered FROM answered""", **PAIRS))
def correlate(spark, folder):
    return ops.correlate(requests(spark, folder), answers(spark, folder), TIMEOUT).select(
        "request_id", micros(F.col("request_ts")).alias("request_at"),
        micros(F.col("response_ts")).alias("response_at"), "answered")


@query("correlate_answer", sql("""
    SELECT request_id, epoch_us(first.ts) response_at, first.result result, first.message message, first.params params
    FROM (SELECT req.request_id, min({'ts': l_shipdate, 'result': CASE WHEN l_returnflag = 'R' THEN 'failure' WHEN l_returnflag IS NOT NULL THEN 'success' END,
                                      'message': l_linestatus, 'params': '{"item_id":"' || l_partkey || '"}'}) AS first
          FROM req LEFT JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = req.request_id AND l_shipdate >= request_ts
              AND l_shipdate <= request_ts + INTERVAL 180 DAY GROUP BY 1)""", **PAIRS))
def correlate_answer(spark, folder):
    """What each request is answered: result, message and params of its first response in time."""
    said = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_shipdate").alias("response_ts"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("result"),
        F.col("l_linestatus").alias("message"),
        F.concat(F.lit('{"item_id":"'), F.col("l_partkey").cast("string"), F.lit('"}')).alias("params"))
    return ops.correlate(requests(spark, folder), said, TIMEOUT).select(
        "request_id", micros(F.col("response_ts")).alias("response_at"), "result", "message", "params")


@query("orphan_responses", sql("""
    SELECT request_id, epoch_us(response_ts) response_at FROM resp
    WHERE request_id NOT IN (SELECT request_id FROM req)""", **PAIRS))
def orphan_responses(spark, folder):
    return ops.orphan_responses(answers(spark, folder), requests(spark, folder)).select(
        "request_id", micros(F.col("response_ts")).alias("response_at"))


@query("timed_out", sql("""
    SELECT request_id, epoch_us(request_ts) request_at FROM answered WHERE response_ts IS NULL""", **PAIRS))
def timed_out(spark, folder):
    return ops.timed_out(requests(spark, folder), answers(spark, folder), TIMEOUT).select(
        "request_id", micros(F.col("request_ts")).alias("request_at"))


@query("checkout_expired", sql("""
    SELECT request_id order_id, CASE WHEN response_ts IS NULL THEN 3::BIGINT ELSE 2 END checkout_status,
           CASE WHEN response_ts IS NULL THEN 'Order checkout failed.' ELSE 'Order successfully purchased.' END message
    FROM answered""", **PAIRS))
def checkout_expired(spark, folder):
    """Checkouts that did not end within the timeout have failed."""
    done = ops.correlate(requests(spark, folder), answers(spark, folder), TIMEOUT)
    ended = F.col("answered")
    return done.select(F.col("request_id").alias("order_id"),
                       F.when(ended, v.SUCCEEDED).otherwise(v.FAILED).cast("bigint").alias("checkout_status"),
                       F.when(ended, v.CHECKOUT_DONE).otherwise(v.CHECKOUT_FAILED).alias("message"))


@query("dedup_requests", sql("""
    SELECT request_id, epoch_us(min(response_ts)) request_at, count(*) copies FROM resp GROUP BY 1""", **PAIRS))
def dedup_requests(spark, folder):
    sent = answers(spark, folder).withColumnRenamed("response_ts", "request_ts")
    return ops.dedup_requests(sent).select("request_id", micros(F.col("request_ts")).alias("request_at"), "copies")


@query("route_throughput", sql("""
    SELECT route, CAST(sum(n) AS BIGINT) n_requests, max(n) peak
    FROM (SELECT route, time_bucket(INTERVAL 10 MINUTE, ts) w, count(*) n FROM cmd GROUP BY 1, 2) GROUP BY 1""", "cmd"))
def route_throughput(spark, folder):
    return ops.throughput(cmd(spark, folder), width="10 minutes")


@query("peak_per_second", sql("""
    SELECT route, CAST(sum(n) AS BIGINT) n_requests, max(n) peak
    FROM (SELECT route, time_bucket(INTERVAL 1 SECOND, ts) w, count(*) n FROM cmd GROUP BY 1, 2) GROUP BY 1""", "cmd"))
def peak_per_second(spark, folder):
    return ops.throughput(cmd(spark, folder))


@query("sliding_peak", sql("""
    SELECT route, (SELECT count(*) FROM cmd c WHERE c.route = w.route) n_requests, max(n) peak
    FROM (SELECT route, w, count(*) n FROM (
        SELECT route, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE,
                              time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) w FROM cmd) GROUP BY 1, 2) w GROUP BY 1""", "cmd"))
def sliding_peak(spark, folder):
    """The most requests of a route within any hour that begins at a third of an hour."""
    return ops.throughput(cmd(spark, folder), width="60 minutes", slide="20 minutes")


SESSION_GAP = "2 hours"
SESSIONS = sql("""
    SELECT user_id, epoch_us(min(ts)) first_at, epoch_us(max(ts)) last_at, count(*) n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq) s FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END fresh
            FROM cmd)) GROUP BY user_id, s""", "cmd")


@query("user_sessions", SESSIONS)
def user_sessions(spark, folder):
    """The commands of each user in sessions that two idle hours end."""
    found = ops.sessions(cmd(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", SESSION_GAP)
    return found.select("user_id", micros(F.col("first")).alias("first_at"), micros(F.col("last")).alias("last_at"), "n")
