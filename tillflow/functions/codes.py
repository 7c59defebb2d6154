"""Status codes and the checkout progress bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tillflow import vocabulary as v


def name_of(code: Column, names: dict[int, str], fail: bool = False) -> Column:
    """Name of a code; an unknown code is NULL, or stops the query if ``fail``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = table[code.cast("int")]
    return F.coalesce(name, F.raise_error(F.lit("Unrecognised code.")).cast("string")) if fail else name


def has(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) == mask


def has_any(bits: Column, *masks: int) -> Column:
    return bits.bitwiseAND(F.lit(reduce(int.__or__, masks))) != 0


def with_bits(bits: Column, mask: int) -> Column:
    return bits.bitwiseOR(F.lit(mask))


def without_bits(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(~mask))


def progress_view(bits: Column) -> dict[str, Column]:
    """What a checkout still waits for and how its two sides ended."""
    return {
        "awaiting_send": has_any(bits, v.AWAIT_STOCK, v.AWAIT_PAYMENT),
        "awaiting_replenish": has_any(bits, v.AWAIT_RESTOCK, v.AWAIT_REFUND),
        "awaiting_anything": has_any(bits, v.AWAIT_STOCK, v.AWAIT_PAYMENT, v.AWAIT_RESTOCK, v.AWAIT_REFUND),
        "has_failed": has_any(bits, v.STOCK_FAILED, v.PAYMENT_FAILED),
        "has_succeeded": has(bits, v.STOCK_OK | v.PAYMENT_OK),
        # one of the two is enough: a failed payment never sends a refund
        "replenish_sent": has_any(bits, v.RESTOCK_SENT, v.REFUND_SENT),
    }
