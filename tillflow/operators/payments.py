"""Payments: paying, cancelling, and what a checkout hears back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.functions.codes import name_of
from tillflow.functions.jsontext import json_object, quoted, raw
from tillflow.operators.guards import payment_price_reason
from tillflow.operators import claims
from tillflow.operators.claims import HOT_ROWS
from tillflow.operators.routing import first_reason

# fixed values: why a payment is not started again
UNDER_WAY, CONCLUDED = "Payment is already being executed.", "Payment already concluded."
INVALID, PAID, FAILED, CANCELLED, PROCESSING = range(5)  # codes of vocabulary.PAYMENT_STATUS


def payment_params(status="status") -> Column:
    return json_object(order_id=quoted("order_id"), status=quoted(name_of(F.col(status), v.PAYMENT_STATUS)),
                       status_code=raw(status))


def order_lookup(requests: DataFrame, orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Ask the order of each payment for user and price; empty orders cost 0.

    A request that brings both already keeps its own.
    """
    priced = orders.join(prices, "order_id", "left").select(
        "order_id", F.col("user_id").alias("user_"), F.coalesce("price", F.lit(0).cast("bigint")).alias("price_"))
    out = requests
    for name, kind in (("user_id", "string"), ("price", "bigint")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    given = F.col("user_id").isNotNull() & F.col("price").isNotNull()
    return (out.join(priced, "order_id", "left")
            .withColumn("state", F.when(given | F.col("user_").isNotNull(), "order-exists").otherwise("no-order"))
            .withColumns({"user_id": F.when(given, F.col("user_id")).otherwise(F.col("user_")),
                          "price": F.when(given, F.col("price")).otherwise(F.col("price_"))})
            .drop("user_", "price_"))


def settle(requests: DataFrame, orders: DataFrame, prices: DataFrame, users: DataFrame, moves: DataFrame | None = None,
           hot_rows: int = HOT_ROWS, sized_by: DataFrame | None = None) -> DataFrame:
    """Payments and cancellations in one pass, per user in the order (t, seq).

    ``requests`` has order_id, t, a unique seq and may have ``give_back`` (a
    cancellation), user_id and price; ``users`` holds the existing users with
    their credits, ``moves`` (key, t, seq, delta) what else happens to them. A
    payment that ended invalid, failed or cancelled is started again by the next
    request; a paid one is concluded, and the first cancellation refunds what was
    paid. Requests of an order that bring different users are settled by user.
    """
    asked = order_lookup(requests, orders, prices)
    if "give_back" not in asked.columns:
        asked = asked.withColumn("give_back", F.lit(False))
    there = F.col("state") == "order-exists"
    commands = asked.select(
        "order_id", "user_id", "price", "seq", "t", F.coalesce("give_back", F.lit(False)).alias("give_back"), there.alias("there"),
        F.when(there, F.col("user_id")).alias("key"), F.col("order_id").alias("claim"),
        F.when(F.col("price") > 0, -F.col("price")).alias("delta"))
    if moves is not None:
        commands = commands.unionByName(moves.select("key", "t", "seq", "delta"), allowMissingColumns=True)
    opening = users.select(F.col("user_id").alias("key"), F.col("credits").alias("opening"))
    ran = claims.claim_ledger(commands, opening, hot_rows, sized_by).where(F.col("claim").isNotNull())
    outcome, back = F.col("outcome"), F.col("give_back")
    errors = first_reason(
        (back & (~F.col("there") | (outcome == claims.ABSENT)), v.not_found("payment")),
        (back & ~F.col("accepted"), "Cannot cancel payment."), (outcome == claims.HELD, CONCLUDED))
    failures = first_reason(
        (~F.col("there"), "Order does not exist."), (outcome == claims.VOID, payment_price_reason(F.col("price"))),
        (outcome == claims.UNKNOWN, "User does not exist."), (outcome == claims.SHORT, "User does not have enough credits."))
    state = F.col("claim_state")
    status = (F.when(state == claims.HELD, PAID).when(state == claims.SHORT, FAILED).when(state == claims.VOID, INVALID)
               .when(state == claims.RETURNED, CANCELLED).when(~back, INVALID))
    return ran.select(
        "order_id", "user_id", "price", "seq", "t", "give_back", status.alias("status"), "balance",
        F.when(errors.isNotNull(), "error").when(failures.isNotNull(), "failure").otherwise("success").alias("result"),
        F.coalesce(F.concat(F.lit(v.MANAGED), errors), failures,
                   F.when(back, "Payment cancelled. User credits refunded.")
                    .otherwise("Payment completed, user credits subtracted.")).alias("message"))


def pay_orders(requests: DataFrame, orders: DataFrame, prices: DataFrame, users: DataFrame,
               hot_rows: int = HOT_ROWS, sized_by: DataFrame | None = None) -> DataFrame:
    """Pay orders: ``settle`` without cancellations."""
    return settle(requests, orders, prices, users, None, hot_rows, sized_by).drop("give_back")


def first_of_each(requests: DataFrame, key: str) -> DataFrame:
    """The ``seq`` of the first request (t, seq) of each key."""
    first = requests.groupBy(key).agg(F.min(F.struct("t", "seq")).alias("first_"))
    return first.select(F.col("first_.seq").alias("seq"))


def cancel_payments(requests: DataFrame, payments: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """Cancel paid payments: the recorded price goes back to the user.

    ``requests`` has order_id, t and a unique seq. Only the first request of a
    payment can cancel it; by the later ones it is no longer paid.
    """
    state = payments.select("order_id", "user_id", "price", "status")
    known_orders = orders.select("order_id", F.lit(True).alias("order_"))
    known_users = users.select("user_id", F.lit(True).alias("user_"))
    first = first_of_each(requests, "order_id").withColumn("first_", F.lit(True))
    joined = (requests.select("order_id", "seq").join(first, "seq", "left").join(state, "order_id", "left")
              .join(known_orders, "order_id", "left").join(known_users, "user_id", "left"))
    errors = first_reason((F.col("status").isNull(), v.not_found("payment")),
                          ((F.col("status") != PAID) | F.col("first_").isNull(), "Cannot cancel payment."))
    failures = first_reason((F.col("order_").isNull(), "Order does not exist anymore."),
                            (F.col("user_").isNull(), "User does not exist anymore."))
    fine = errors.isNull() & failures.isNull()
    return joined.select(
        "order_id", "seq", F.when(fine | (F.col("status") == PAID) & F.col("first_").isNull() & failures.isNull(), CANCELLED)
        .otherwise(F.col("status")).alias("status"),
        F.when(fine, F.col("price")).otherwise(F.lit(0).cast("bigint")).alias("refund"),
        F.when(fine, "success").when(errors.isNotNull(), "error").otherwise("failure").alias("result"),
        F.when(fine, "Payment cancelled. User credits refunded.")
         .when(errors.isNotNull(), F.concat(F.lit(v.MANAGED), errors)).otherwise(failures).alias("message"))


def duplicate_payments(requests: DataFrame, settled: DataFrame) -> DataFrame:
    """Requests after the first of their order, and why they are refused.

    ``settled`` has order_id, status and ``settled_at``: before that moment
    the payment is still under way. A payment that ended unpaid may be tried
    again, so such a request has no reason.
    """
    later = requests.join(first_of_each(requests, "order_id"), "seq", "left_anti").join(settled, "order_id", "left")
    reason = first_reason(
        (F.col("settled_at").isNull() | (F.col("t") < F.col("settled_at")), UNDER_WAY),
        (F.col("status") == PAID, CONCLUDED))
    return later.select("seq", "order_id", F.concat(F.lit(v.MANAGED), reason).alias("message"))


def checkout_payments(orders: DataFrame, prices: DataFrame, users: DataFrame, hot_rows: int = HOT_ROWS,
                      sized_by: DataFrame | None = None) -> DataFrame:
    """The payment side of a checkout: result code, payment status and message."""
    paid = pay_orders(orders.select("order_id", "t", "seq"), orders, prices, users, hot_rows, sized_by)
    message = (F.when(F.col("status") == PAID, "Credits subtracted.")
                .when(F.col("status") == FAILED, v.NO_CREDITS).otherwise(F.col("message")))
    code = (F.when(F.col("status") == PAID, v.SUCCESS).when(F.col("status") == FAILED, v.FAILURE).otherwise(v.ERROR))
    return paid.select("order_id", code.alias("code"), "status", message.alias("message"),
                       F.col("balance").alias("user_credits"))
