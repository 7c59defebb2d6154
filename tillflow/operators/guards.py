"""Checks that turn a command away, each with the text it is refused with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.operators.routing import first_reason


def missing_field(params: Column, required: dict[str, str]) -> Column:
    """Reason text of the first required field that ``params`` lacks."""
    return first_reason(*[(F.get_json_object(params, f"$.{name}").isNull(), text)
                          for name, text in required.items()])


def amount_reason(amount: Column) -> Column:
    return first_reason((amount <= 0, v.BAD_AMOUNT))


def payment_price_reason(price: Column) -> Column:
    """Payments refuse free orders as well."""
    return first_reason((price == 0, "Cannot pay for an empty order."), (price < 0, "Price cannot be negative"))


def user_price_reason(price: Column) -> Column:
    """Accounts allow a price of zero."""
    return first_reason((price < 0, "Price cannot be negative."))


def can_modify(user_checked: Column, is_paid: Column, status: Column) -> Column:
    return user_checked & ~is_paid & status.isin(v.NOT_PROCESSED, v.FAILED)


def can_remove(is_paid: Column, status: Column) -> Column:
    return ~is_paid & (status == v.NOT_PROCESSED)


def checkout_reason(exists: Column, is_paid: Column, user_checked: Column, status: Column, price: Column) -> Column:
    """First reason that keeps an order from being checked out."""
    return first_reason(
        (~exists, v.not_found("order")),
        (is_paid, "Order has already been paid."),
        (~user_checked, "Cannot checkout order."),
        (status == v.SUCCEEDED, "Order already concluded."),
        (status == v.INVALID, "Invalid order state."),
        (status == v.FAILED, v.CHECKOUT_FAILED),
        (price <= 0, "Cannot checkout an order with no items."))


def exists_guard(df: DataFrame, known: DataFrame, key: str, entity: str) -> DataFrame:
    """Add ``reason``: the not-found text where ``key`` is not among ``known``."""
    marked = known.select(key).distinct().withColumn("known_", F.lit(True))
    return (df.join(marked, key, "left")
              .withColumn("reason", first_reason((F.col("known_").isNull(), v.not_found(entity))))
              .drop("known_"))
