"""Orders and their baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.functions.jsontext import json_object, quoted, raw
from tillflow.operators.guards import can_modify, can_remove
from tillflow.operators.routing import first_reason
from tillflow.operators.skew import joined_sorted


def object_of(pairs: Column) -> Column:
    """A JSON object from an array of structs ``name``, ``value`` (as JSON)."""
    return F.concat(F.lit("{"), F.array_join(
        F.transform(pairs, lambda p: F.concat(quoted(p["name"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def products(lines: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Per order its items as JSON object, sorted by item; ``sized_by`` as in ``skew.hot_keys``."""
    entry = F.concat(quoted("item_id"), F.lit(":"), raw("qty"))
    found = joined_sorted(lines, "order_id", entry, F.col("item_id"), ",", "entries_", sized_by=sized_by)
    return found.select("order_id", F.col("n_entries").alias("n_items"),
                        F.concat(F.lit("{"), "entries_", F.lit("}")).alias("products"))


def outcome(reason: Column, success: str, *failures: str) -> tuple[Column, Column]:
    """(result, message): refusals are errors, except the given failure texts."""
    result = (F.when(reason.isNull(), "success").when(reason.isin(*failures), "failure").otherwise("error")
              if failures else F.when(reason.isNull(), "success").otherwise("error"))
    text = (F.when(reason.isNull(), success)
             .when(result == "error", F.concat(F.lit(v.MANAGED), reason)).otherwise(reason))
    return result.alias("result"), text.alias("message")


def create_orders(orders: DataFrame, users: DataFrame) -> DataFrame:
    """An order is kept only if its user exists."""
    known = users.select("user_id").distinct().withColumn("user_checked", F.lit(True))
    refusal = "Order not created. User did not exist."
    checked = F.coalesce("user_checked", F.lit(False))
    return orders.join(known, "user_id", "left").select(
        "order_id", "user_id", checked.alias("user_checked"),
        *outcome(first_reason((~checked, refusal)), "Order created.", refusal))


def remove_orders(requests: DataFrame, orders: DataFrame) -> DataFrame:
    state = orders.select("order_id", "user_id", can_remove(F.col("is_paid"), F.col("checkout_status")).alias("free_"))
    reason = first_reason((F.col("free_").isNull(), v.not_found("order")), (~F.col("free_"), v.CANNOT_REMOVE))
    return requests.join(state, "order_id", "left").select(
        "order_id", "user_id", *outcome(reason, "Order removed."))


def modifiable(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders with ``open_``: whether their basket may change."""
    known = users.select("user_id").distinct().withColumn("checked_", F.lit(True))
    checked = F.coalesce("checked_", F.lit(False))
    return orders.join(known, "user_id", "left").select(
        "order_id", can_modify(checked, F.col("is_paid"), F.col("checkout_status")).alias("open_"))


def add_items(requests: DataFrame, orders: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Answer per added (order, item): the order must be open, the item known."""
    known = items.select("item_id").distinct().withColumn("item_", F.lit(True))
    missing = "Item does not exist."
    reason = first_reason((F.col("open_").isNull(), v.not_found("order")), (~F.col("open_"), v.CANNOT_MODIFY),
                          (F.col("item_").isNull(), missing))
    return (requests.join(modifiable(orders, users), "order_id", "left").join(known, "item_id", "left")
            .select("order_id", "item_id", *outcome(reason, "Item added.", missing)))


def remove_items(requests: DataFrame, orders: DataFrame, users: DataFrame, lines: DataFrame) -> DataFrame:
    """Answer per removed (order, item); an item is removed whole."""
    held = lines.select("order_id", "item_id", F.lit(True).alias("held_"))
    missing = "No such item exists."
    reason = first_reason((F.col("open_").isNull(), v.not_found("order")), (~F.col("open_"), v.CANNOT_MODIFY),
                          (F.col("held_").isNull(), missing))
    return (requests.join(modifiable(orders, users), "order_id", "left")
            .join(held, ["order_id", "item_id"], "left")
            .select("order_id", "item_id", *outcome(reason, "Item(s) removed.", missing)))


def basket(changes: DataFrame) -> DataFrame:
    """Quantity per (order, item): the adds after its last removal.

    ``changes`` has order_id, item_id, t and ``is_add``. Both steps aggregate
    on the same keys and combine before the shuffle.
    """
    keys = ["order_id", "item_id"]
    cleared = changes.where(~F.col("is_add")).groupBy(*keys).agg(F.max("t").alias("cleared_"))
    kept = changes.where("is_add").join(cleared, keys, "left").where(
        F.col("cleared_").isNull() | (F.col("t") > F.col("cleared_")))
    return kept.groupBy(*keys).agg(F.count("*").alias("qty"))


def order_params(products_text="products") -> Column:
    return json_object(
        order_id=quoted("order_id"), user_id=quoted("user_id"), user_checked=raw("user_checked"),
        is_paid=raw("is_paid"), products=F.coalesce(products_text, F.lit("{}")),
        checkout_status=raw("checkout_status"), checkout_progress=raw("checkout_progress"))


def order_view(orders: DataFrame, lines: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    return orders.join(products(lines, sized_by), "order_id", "left").select("order_id", order_params().alias("params"))


def checkout_requests(orders: DataFrame, lines: DataFrame, prices: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """The two messages a checkout sends: take the stock, and pay."""
    stock = orders.join(products(lines, sized_by), "order_id").select(
        "order_id", F.lit(v.IN_TOPIC[v.STOCK]).alias("topic"), F.lit("batch/subtract").alias("route"),
        F.lit("batch:subtract").alias("state"),
        json_object(products=F.col("products"), order_id=quoted("order_id"), user_id=quoted("user_id"),
                    return_state=quoted(F.lit("send-stock"))).alias("params"))
    pay = orders.join(prices, "order_id").select(
        "order_id", F.lit(v.IN_TOPIC[v.PAYMENT]).alias("topic"), F.lit("orders/checkout").alias("route"),
        F.lit("send-payment").alias("state"),
        json_object(order_id=quoted("order_id"), user_id=quoted("user_id"), price=raw("price")).alias("params"))
    return stock.unionByName(pay)


def mark_paid(orders: DataFrame, notices: DataFrame) -> DataFrame:
    """Set orders paid; a notice for an unknown order is an error, others get no answer."""
    paid = notices.select("order_id").distinct().withColumn("noticed_", F.lit(True))
    state = orders.select("order_id", F.col("is_paid").alias("was_paid"), F.lit(True).alias("known_"))
    both = state.join(paid, "order_id", "full_outer")
    return both.select(
        "order_id", (F.coalesce("was_paid", F.lit(False)) | (F.col("known_").isNotNull() & F.col("noticed_").isNotNull()))
        .alias("is_paid"),
        F.when(F.col("known_").isNull(), v.MANAGED + v.not_found("order")).alias("message"))
