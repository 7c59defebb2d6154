"""Messages about many items: one message per item, and the answers joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.functions.jsontext import json_object, quoted, raw
from tillflow.operators.guards import missing_field
from tillflow.operators.ledger import HOT_ROWS, guarded_ledger
from tillflow.operators.orders import object_of

# fixed values: what a fan-out message must carry
REQUIRED = {
    "products": "Products node is expected to exist.",
    "order_id": "Order ID is expected to exist.",
    "user_id": "User ID is expected to exist.",
}


def missing_for_fan_out(params: Column) -> Column:
    return missing_field(params, REQUIRED)


NO_PRODUCTS = "A batch needs at least one product."


def unfit_for_fan_out(params: Column) -> Column:
    """Why a message cannot be fanned out: a field is missing, or it would give no message at all."""
    products = F.from_json(F.get_json_object(params, "$.products"), "map<string,bigint>")
    return F.coalesce(missing_for_fan_out(params),
                      F.when(F.coalesce(F.size(products), F.lit(-1)) < 1, NO_PRODUCTS))


MESSAGE = "products map<string,bigint>, order_id string, user_id string, return_state string"


def batch_id(request_id: str, order_id: str, return_state: str) -> Column:
    """A hash, so a task that runs twice gives the same id."""
    return F.sha2(F.concat_ws(":", request_id, order_id, return_state), 256)


def fan_out(messages: DataFrame, keep: str | None = None) -> DataFrame:
    """One row per product of each message; ``messages`` has request_id and params.

    All rows of a message share a batch id and the number of its products.
    ``keep`` names one more column to carry along.
    """
    kept = ["request_id"] + ([keep] if keep else [])
    read = messages.select(*kept, F.from_json("params", MESSAGE).alias("m_")).select(*kept, "m_.*")
    return read.select(
        *kept, "order_id", "user_id", "return_state",
        batch_id("request_id", "order_id", "return_state").alias("batch_id"),
        F.size("products").cast("bigint").alias("batch_count"),
        # a plain explode would have the JSON parsed once more, to filter on its size
        F.explode_outer("products").alias("item_id", "amount")).where(F.col("item_id").isNotNull())


def batch_progress(items: DataFrame) -> DataFrame:
    """Per batch how many different items came back, and whether that is all."""
    return (items.groupBy("batch_id").agg(F.count_distinct("item_id").alias("seen"), F.max("batch_count").alias("batch_count"))
            .withColumn("complete", F.col("seen") >= F.col("batch_count")))


def collect_batches(items: DataFrame) -> DataFrame:
    """Join the answers of complete batches into one products object each.

    ``items`` has batch_id, batch_count, order_id, user_id, return_state,
    item_id, ``t`` and ``passed`` (the answer as JSON). Of several answers for
    one item the latest counts. A batch is handed on once, as one message.
    """
    keys = ["batch_id", "item_id"]
    # dealt by batch once, both aggregates find their rows together
    latest = items.repartition("batch_id").groupBy(*keys).agg(
        F.max_by("passed", "t").alias("passed"),
        *[F.max(c).alias(c) for c in ("batch_count", "order_id", "user_id", "return_state")])
    joined = latest.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("name"), F.col("passed").alias("value"))))
         .alias("pairs_"),
        F.count("*").alias("seen_"),
        *[F.max(c).alias(c) for c in ("batch_count", "order_id", "user_id", "return_state")])
    return joined.where(F.col("seen_") >= F.col("batch_count")).select(
        "batch_id", "order_id", F.col("return_state").alias("state"),
        json_object(order_id=quoted("order_id"), user_id=quoted("user_id"),
                    products=object_of(F.col("pairs_"))).alias("params"))


def passed(code: Column, amount: Column | None = None) -> Column:
    """The answer for one item: a result code, and the amount if given."""
    plain = json_object(state=raw(code))
    if amount is None:
        return plain
    return F.when(amount.isNotNull(), json_object(state=raw(code), amount=raw(amount))).otherwise(plain)


def take_items(takes: DataFrame, stock: DataFrame, hot_rows: int = HOT_ROWS,
               sized_by: DataFrame | None = None) -> DataFrame:
    """Take amounts from stock in order; code 0 taken, 1 too few left, 2 unknown item or bad amount."""
    # a stock entry that is there n times takes n times
    copies = stock.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count("*").cast("int").alias("n_")).where("n_ > 1")
    if not copies.isEmpty():
        again = F.explode(F.array_repeat(F.lit(True), F.coalesce("n_", F.lit(1))))
        takes = takes.join(copies, "item_id", "left").withColumn("again_", again).drop("n_", "again_")
    # a bad amount changes nothing
    fits = F.col("amount") >= 0
    commands = takes.withColumn("delta", F.when(fits, -F.col("amount")).otherwise(0)).withColumnRenamed("item_id", "key")
    opening = stock.select(F.col("item_id").alias("key"), F.col("amount").alias("opening"))
    # an item without stock entry has no opening, so the ledger tells what a join would
    valid = F.col("opened") & fits
    code = F.when(~valid, v.ERROR).when(F.col("accepted"), v.SUCCESS).otherwise(v.FAILURE)
    return (guarded_ledger(commands, opening, hot_rows, sized_by, opened=True).withColumn("code", code)
            .drop("delta", "balance", "accepted", "opened").withColumnRenamed("key", "item_id"))


def put_items(puts: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give amounts back: the answers per row, and the stock afterwards."""
    known = stock.select("item_id", F.lit(True).alias("known_"))
    valid = F.col("known_").isNotNull() & (F.col("amount") >= 0)
    answers = puts.join(known, "item_id", "left").withColumn(
        "code", F.when(valid, v.SUCCESS).otherwise(v.ERROR)).drop("known_")
    added = puts.where("amount >= 0").groupBy("item_id").agg(F.sum("amount").alias("added_"))
    after = stock.join(added, "item_id", "left").select(
        "item_id", (F.col("amount") + F.coalesce("added_", F.lit(0))).alias("amount"))
    return answers, after


def count_items(asked: DataFrame, stock: DataFrame) -> DataFrame:
    """The amount in stock per asked item, -1 for an unknown one."""
    return asked.join(stock.select("item_id", F.col("amount").alias("held_")), "item_id", "left").withColumn(
        "in_stock", F.coalesce("held_", F.lit(-1).cast("bigint"))).drop("held_")
