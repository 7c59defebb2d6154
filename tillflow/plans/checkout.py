"""Checkout of many orders at once, as joins and two guarded ledgers.

Every order with items is checked out in the order (date, id). Stock is taken
per item and the price is debited per user, independently of each other; an
order is bought only if both worked, and what did work is given back if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.functions.codes import name_of
from tillflow.functions.jsontext import json_object, quoted, raw
from tillflow.operators.ledger import HOT_ROWS, guarded_ledger
from tillflow.operators.skew import joined_sorted


def order_prices(lines: DataFrame) -> DataFrame:
    """Price of an order: the sum of its quantities, each at unit price 1."""
    return lines.groupBy("order_id").agg(F.sum("qty").alias("price"), F.count("*").alias("n_items"))


def reserve_stock(lines: DataFrame, orders: DataFrame, items: DataFrame, hot_rows=HOT_ROWS,
                  sized_by: DataFrame | None = None) -> DataFrame:
    """Take every line from stock in order; ``accepted`` says whether it fitted."""
    takes = (lines.join(orders.select("order_id", "seq", "t"), "order_id")
             .select(F.col("item_id").alias("key"), "t", "seq", (-F.col("qty")).alias("delta"), "order_id", "qty"))
    return guarded_ledger(takes, items.select(F.col("item_id").alias("key"), F.col("amount").alias("opening")),
                          hot_rows, lines.select("item_id") if sized_by is None else sized_by
                          ).withColumnRenamed("key", "item_id")


def debit_users(prices: DataFrame, orders: DataFrame, users: DataFrame, hot_rows=HOT_ROWS,
                sized_by: DataFrame | None = None) -> DataFrame:
    debits = (prices.join(orders.select("order_id", "seq", "t", "user_id"), "order_id")
              .select(F.col("user_id").alias("key"), "t", "seq", (-F.col("price")).alias("delta"),
                      "order_id", "price", "n_items"))
    return guarded_ledger(debits, users.select(F.col("user_id").alias("key"), F.col("credits").alias("opening")),
                          hot_rows, orders.select("user_id") if sized_by is None else sized_by
                          ).withColumnRenamed("key", "user_id")


def checkout(lines: DataFrame, orders: DataFrame, items: DataFrame, users: DataFrame,
             hot_rows: int = HOT_ROWS, item_sizes: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """One row per order: what happened and what has to be given back.

    ``item_sizes`` may be a cheap scan of the items ordered, see ``skew.hot_keys``;
    ``taken`` what ``reserve_stock`` gave for the same lines, if that is there already.
    """
    paid = debit_users(order_prices(lines), orders, users, hot_rows)
    if taken is None:
        taken = reserve_stock(lines, orders, items, hot_rows, item_sizes)
    taken = (taken.groupBy("order_id")
             .agg(F.bool_and("accepted").alias("stock_ok"),
                  F.count_if(~F.col("accepted")).alias("failed_items"),
                  F.sum(F.when(F.col("accepted"), F.col("qty")).otherwise(0)).alias("taken_qty")))
    both = F.col("stock_ok") & F.col("payment_ok")
    nothing = F.lit(0).cast("bigint")
    return (paid.withColumnRenamed("accepted", "payment_ok").join(taken, "order_id")
            .select("order_id", "user_id", "price", "n_items", "stock_ok", "payment_ok", "failed_items",
                    F.when(both, v.SUCCEEDED).otherwise(v.FAILED).cast("bigint").alias("checkout_status"),
                    both.alias("is_paid"),
                    F.when(both, nothing).otherwise(F.col("taken_qty")).alias("restock_qty"),
                    F.when(F.col("payment_ok") & ~F.col("stock_ok"), F.col("price"))
                     .otherwise(nothing).alias("refund")))


def stock_after(result: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Stock once all is settled: only bought orders keep their items."""
    sold = (lines.join(result.where("is_paid"), "order_id", "left_semi")
            .groupBy("item_id").agg(F.sum("qty").alias("sold")))
    return items.join(sold, "item_id", "left").select(
        "item_id", (F.col("amount") - F.coalesce("sold", F.lit(0))).alias("amount"))


def credits_after(result: DataFrame, users: DataFrame) -> DataFrame:
    spent = result.where("is_paid").groupBy("user_id").agg(F.sum("price").alias("spent"))
    return users.join(spent, "user_id", "left").select(
        "user_id", (F.col("credits") - F.coalesce("spent", F.lit(0))).alias("credits"))


def progress_bits(stock_ok: Column, payment_ok: Column, restock_qty: Column) -> Column:
    """Progress once both answers are in and the ways back have been asked for."""
    restock = (F.when(stock_ok & payment_ok, 0)
                .when(restock_qty > 0, v.RESTOCK_SENT | v.AWAIT_RESTOCK).otherwise(v.RESTOCK_SENT))
    refund = F.when(payment_ok & ~stock_ok, v.REFUND_SENT | v.AWAIT_REFUND).otherwise(0)
    bits = F.when(stock_ok, v.STOCK_OK).otherwise(v.STOCK_FAILED)
    for more in (F.when(payment_ok, v.PAYMENT_OK).otherwise(v.PAYMENT_FAILED), restock, refund):
        bits = bits.bitwiseOR(more)
    return bits


def compensations(result: DataFrame) -> DataFrame:
    """What a failed checkout sends to undo its half that worked."""
    def ask(amount, topic, route, state):
        return result.where(F.col(amount) > 0).select(
            "order_id", F.lit(topic).alias("topic"), F.lit(route).alias("route"), F.lit(state).alias("state"),
            F.col(amount).alias("amount"))
    return ask("restock_qty", v.IN_TOPIC[v.STOCK], "batch/add", "batch:add").unionByName(
        ask("refund", v.IN_TOPIC[v.PAYMENT], "orders/checkout", "replenish-payment"))


def checkout_log(stock: DataFrame, payments: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Per order the reasons of its failure as a JSON array, sorted; ``sized_by`` as in ``skew.hot_keys``.

    ``stock`` (order_id, item_id, code), ``payments`` (order_id, code, message).
    """
    text = F.when(F.col("code") == v.ERROR, "Item does not exist: ").otherwise("Not enough items in stock: ")
    reasons = (stock.where(F.col("code") != v.SUCCESS)
               .select("order_id", "code", F.concat(text, "item_id").alias("message"))
               .unionByName(payments.where(F.col("code") != v.SUCCESS).select(
                   "order_id", "code", F.coalesce("message", F.lit("Insufficient funds.")).alias("message"))))
    entry = json_object(message=quoted("message"), status=quoted(name_of(F.col("code"), v.OPERATION_RESULT)),
                        status_code=raw("code"))
    return joined_sorted(reasons, "order_id", entry, entry, ",", "entries_", sized_by=sized_by).select(
        "order_id", F.concat(F.lit("["), F.col("entries_"), F.lit("]")).alias("log"))


def outcomes(result: DataFrame) -> DataFrame:
    text = (F.when(F.col("is_paid"), f"Order checkout done: {v.CHECKOUT_DONE}")
             .otherwise(f"Order checkout reverted: {v.CHECKOUT_FAILED}"))
    return result.groupBy(text.alias("outcome")).agg(F.count("*").alias("n"))
