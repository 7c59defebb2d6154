"""Users and stock items: creation, views, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.functions.jsontext import json_object, quoted, raw
from tillflow.operators.guards import can_remove
from tillflow.operators.skew import joined_sorted


def create_once(requests: DataFrame, key: str, created: str, taken: str) -> DataFrame:
    """The first request per key creates the entry, every later one is refused.

    The first of a key is found by aggregation and joined back on the unique
    ``seq``, so a key with many requests makes no large group.
    """
    first = requests.groupBy(key).agg(F.min(F.struct("t", "seq")).alias("first_"))
    first = first.select(F.col("first_.seq").alias("seq"), F.lit(True).alias("first_"))
    new = F.col("first_").isNotNull()
    return requests.join(first, "seq", "left").select(
        "seq", key, F.when(new, "success").otherwise("error").alias("result"),
        F.when(new, created).otherwise(v.MANAGED + taken).alias("message"))


def order_sets(users: DataFrame, orders: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Per user the ids of the orders owned, as text; ``sized_by`` as in ``skew.hot_keys``."""
    owned = joined_sorted(orders.select("user_id", "order_id").distinct(), "user_id", F.col("order_id"), F.col("order_id"),
                          ", ", "orders", sized_by=sized_by).drop("n_entries")
    return users.join(owned, "user_id", "left").withColumn(
        "orders", F.concat(F.lit("["), F.coalesce("orders", F.lit("")), F.lit("]")))


def user_params(user_id="user_id", balance="credits", orders="orders") -> Column:
    return json_object(user_id=quoted(user_id), balance=raw(balance), orders=quoted(orders))


def stock_params(item_id="item_id", amount="amount") -> Column:
    return json_object(item_id=quoted(item_id), amount=raw(amount))


def answer_view(requests: DataFrame, known: DataFrame, key: str, entity: str) -> DataFrame:
    """Answer lookups: the ``params`` of the known entry, or not found."""
    found = F.col("params").isNotNull()
    return requests.join(known.select(key, "params"), key, "left").select(
        "seq", key, F.when(found, "success").otherwise("error").alias("result"),
        F.when(~found, v.MANAGED + v.not_found(entity)).alias("message"), "params")


def remove_users(removed: DataFrame, orders: DataFrame) -> DataFrame:
    """Removing users: a removal per owned order, and a success per user.

    Each order removal carries the answer the order gives to it.
    """
    allowed = can_remove(F.col("is_paid"), F.col("checkout_status"))
    cascade = orders.join(removed.select("user_id"), "user_id", "left_semi").select(
        "user_id", "order_id", F.lit(v.IN_TOPIC[v.ORDER]).alias("topic"), F.lit("orders/remove").alias("route"),
        F.lit("user-order-removed").alias("state"),
        F.when(allowed, "success").otherwise("error").alias("result"),
        F.when(allowed, "Order removed.").otherwise(v.MANAGED + v.CANNOT_REMOVE).alias("message"))
    done = removed.select("user_id", F.lit("web").alias("route"), F.lit("success").alias("result"),
                          F.lit("User removed.").alias("message"))
    return cascade.unionByName(done, allowMissingColumns=True)
