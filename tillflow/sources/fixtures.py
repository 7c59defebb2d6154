"""Commerce views over the given tables.

The tables are a star schema and an event log; these views read them as
commands, accounts, stock, baskets and messages, so that every operator has
input that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow.functions.jsontext import json_object, quoted
from tillflow.sources.tables import table

# fixed values: which route each event type stands for
ROUTE_OF_EVENT = {
    "signup": "users/credit/add",
    "purchase": "users/credit/subtract",
    "view": "users/find",
    "click": "users/credit",
    "error": "users/unknown",
}
CHECKOUT_STATUS_OF = {"O": 0, "F": 2, "P": 3}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def as_commands(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("event_id").alias("seq"),
        "ts",
        micros(F.col("ts")).alias("t"),
        F.col("user_id").cast("string").alias("user_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        lookup(ROUTE_OF_EVENT, F.col("event_type")).alias("route"))


def cmd(spark: SparkSession, folder: str) -> DataFrame:
    return as_commands(table(spark, folder, "events"))


def users0(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("c_acctbal") / 5)).alias("credits"),
        (F.col("c_acctbal") >= 0).alias("user_exists"))


def items0(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        (F.col("p_size").cast("bigint") * 20).alias("amount"),
        (F.col("p_size") > 5).alias("item_exists"))


def orders0(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        micros(F.col("o_orderdate")).alias("t"),
        (F.col("o_orderstatus") == "F").alias("is_paid"),
        lookup(CHECKOUT_STATUS_OF, F.col("o_orderstatus")).alias("checkout_status"))


def lines0(spark: SparkSession, folder: str) -> DataFrame:
    # grouped on the numbers: cheaper to hash and to shuffle than their text
    return (table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
            .select(F.col("l_orderkey").cast("string").alias("order_id"),
                    F.col("l_partkey").cast("string").alias("item_id"), F.col("qty").cast("bigint").alias("qty")))


def size_of(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """One key column of a table, to find hot keys with."""
    name = {"l": "lineitem", "o": "orders", "c": "customer", "p": "part"}.get(column[0], "events")
    return table(spark, folder, "events" if column == "user_id" else name).select(column)


def request_params(commands: DataFrame) -> Column:
    """Path parameters as JSON; they always arrive as strings."""
    with_amount = json_object(user_id=quoted("user_id"), amount=quoted(F.col("amount").cast("string")))
    needs = F.col("route").isin("users/credit/add", "users/credit/subtract")
    return F.when(needs, with_amount).otherwise(json_object(user_id=quoted("user_id")))


def msg(spark: SparkSession, folder: str) -> DataFrame:
    """Commands as request envelopes; the ones of event type error are cut short."""
    from tillflow.functions.envelope import make_envelope
    commands = cmd(spark, folder)
    text = make_envelope(F.col("request_id"), F.lit("user_in"), F.col("route"), request_params(commands))
    broken = F.col("route") == "users/unknown"
    return commands.select(
        "seq", "ts", F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("value"))
