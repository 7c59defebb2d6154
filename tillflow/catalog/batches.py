"""Item batches: fan-out, per-item work, fan-in, and what a checkout makes of it."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.accounts import existing_items
from tillflow.catalog.checkouts import saga
from tillflow.catalog.views import sql
from tillflow.functions.codes import progress_view
from tillflow.operators import batching, orders as ops
from tillflow.operators.payments import checkout_payments
from tillflow.plans import checkout as plan
from tillflow.sources.fixtures import items0, lines0, orders0, size_of, users0

BATCH_ID = "sha256(order_id || ':' || order_id || ':send-stock')"


def stock_messages(spark, folder):
    """The stock request of every checkout, keyed by request id = order id."""
    lines = lines0(spark, folder)
    sent = ops.checkout_requests(orders0(spark, folder), lines, plan.order_prices(lines), size_of(spark, folder, "l_orderkey"))
    return sent.where(F.col("topic") == "stock_in").select(F.col("order_id").alias("request_id"), "params")


@query("batch_fan_out", sql(f"""
    SELECT order_id, user_id, item_id, qty amount, n_items batch_count, {BATCH_ID} batch_id, 'send-stock' return_state
    FROM lines0 JOIN prices USING (order_id) JOIN orders0 USING (order_id)""", "orders0", "prices"))
def batch_fan_out(spark, folder):
    return batching.fan_out(stock_messages(spark, folder)).drop("request_id")


def batch_items(spark, folder):
    """Answers per item of every order, one item missing where the order id divides by 7."""
    lines = lines0(spark, folder)
    sized = lines.join(plan.order_prices(lines), "order_id").join(
        orders0(spark, folder).select("order_id", "user_id", "t", "seq"), "order_id")
    lost = lines.groupBy("order_id").agg(F.min("item_id").alias("lost")).where(
        F.col("order_id").cast("bigint") % 7 == 0)
    # joined by the order alone, as before it, so the lines are not shuffled again and those of an order stay together
    kept = sized.join(lost, "order_id", "left").where(F.col("lost").isNull() | F.col("item_id").isNull() | (F.col("item_id") != F.col("lost")))
    return kept.select(
        F.sha2(F.concat(F.lit("b"), "order_id"), 256).alias("batch_id"), F.col("n_items").alias("batch_count"),
        "order_id", "user_id", "item_id", "t", F.lit("send-stock").alias("return_state"),
        batching.passed(F.lit(0), F.col("qty")).alias("passed"))


BATCH_ITEMS = """SELECT sha256('b' || order_id) batch_id, n_items batch_count, order_id, user_id, item_id, qty
    FROM lines0 JOIN prices USING (order_id) JOIN orders0 USING (order_id)
    WHERE NOT (CAST(order_id AS BIGINT) % 7 = 0 AND (order_id, item_id) IN (
        SELECT (order_id, min(item_id)) FROM lines0 GROUP BY order_id))"""
SEEN = "SELECT batch_id, count(*) seen, max(batch_count) batch_count FROM batch_items GROUP BY 1"


@query("batch_complete", sql("SELECT batch_id, seen FROM seen WHERE seen >= batch_count",
                             "prices", "orders0", batch_items=BATCH_ITEMS, seen=SEEN))
def batch_complete(spark, folder):
    return batching.batch_progress(batch_items(spark, folder)).where("complete").select("batch_id", "seen")


@query("incomplete_batches", sql("SELECT * FROM seen WHERE seen < batch_count",
                                 "prices", "orders0", batch_items=BATCH_ITEMS, seen=SEEN))
def incomplete_batches(spark, folder):
    return batching.batch_progress(batch_items(spark, folder)).where("not complete").drop("complete")


@query("batch_collect", sql("""
    SELECT batch_id, max(order_id) order_id, 'send-stock' state,
           '{"order_id":"' || max(order_id) || '","user_id":"' || max(user_id) || '","products":{' || string_agg(
               '"' || item_id || '":{"state":0,"amount":' || qty || '}', ',' ORDER BY item_id) || '}}' params
    FROM batch_items GROUP BY 1 HAVING count(*) >= max(batch_count)""",
    "prices", "orders0", batch_items=BATCH_ITEMS))
def batch_collect(spark, folder):
    return batching.collect_batches(batch_items(spark, folder))


def taken(spark, folder):
    """Every checkout's items fanned out and taken from stock, in order."""
    # a message carries its time into the fan-out, so that no item has to be joined with it
    when = orders0(spark, folder).select(F.col("order_id").alias("request_id"), F.struct("t", "seq").alias("when"))
    takes = batching.fan_out(stock_messages(spark, folder).join(when, "request_id"), keep="when").select("*", "when.*")
    # the id is a hash of what a row has anyway, and most of its bytes: it is made again behind the ledger's shuffle
    done = batching.take_items(takes.drop("when", "batch_id"), items0(spark, folder).select("item_id", "amount"),
                               sized_by=size_of(spark, folder, "l_partkey"))
    return done.withColumn("batch_id", batching.batch_id("request_id", "order_id", "return_state"))


PASSED = """CASE WHEN ok THEN '{"state":0,"amount":' || qty || '}' ELSE '{"state":1}' END"""


@query("stock_batch", sql(f"""
    SELECT {BATCH_ID} batch_id, order_id, 'send-stock' state,
           '{{"order_id":"' || order_id || '","user_id":"' || max(user_id) || '","products":{{' || string_agg(
               '"' || item_id || '":' || {PASSED}, ',' ORDER BY item_id) || '}}}}' params
    FROM item_fold JOIN orders0 USING (order_id) GROUP BY order_id""", "item_fold", "orders0"))
def stock_batch(spark, folder):
    done = taken(spark, folder)
    amount = F.when(F.col("code") == v.SUCCESS, F.col("amount"))
    return batching.collect_batches(done.withColumn("passed", batching.passed(F.col("code"), amount)))


@query("stock_outcome", sql("""
    SELECT order_id, NOT bool_and(ok) is_failure, false is_error, count(*) FILTER (ok) n_taken
    FROM item_fold GROUP BY 1""", "item_fold"))
def stock_outcome(spark, folder):
    return taken(spark, folder).groupBy("order_id").agg(
        F.bool_or(F.col("code") == v.FAILURE).alias("is_failure"),
        F.bool_or(F.col("code") == v.ERROR).alias("is_error"),
        F.count_if(F.col("code") == v.SUCCESS).alias("n_taken"))


@query("refund_map", sql("""
    SELECT order_id, '{' || string_agg('"' || item_id || '":' || qty, ',' ORDER BY item_id) || '}' refunds
    FROM item_fold JOIN saga USING (order_id) WHERE ok AND NOT is_paid GROUP BY 1""", "item_fold", "saga"))
def refund_map(spark, folder):
    back = saga(spark, folder).where(~F.col("is_paid"))
    held = plan.reserve_stock(lines0(spark, folder), orders0(spark, folder), items0(spark, folder),
                              sized_by=size_of(spark, folder, "l_partkey")).where("accepted")
    return (ops.products(held.select("order_id", "item_id", "qty").join(back, "order_id", "left_semi"), size_of(spark, folder, "l_orderkey"))
            .select("order_id", F.col("products").alias("refunds")))


@query("restock", sql("""
    SELECT item_id, order_id, qty amount, CASE WHEN i.item_id IS NULL THEN 2::BIGINT ELSE 0 END code,
           CASE WHEN i.item_id IS NULL THEN '{"state":2}' ELSE '{"state":0}' END passed,
           i.amount + CAST(sum(qty) OVER (PARTITION BY item_id) AS BIGINT) stock_after
    FROM lines0 LEFT JOIN (SELECT * FROM items0 WHERE item_exists) i USING (item_id)""", "lines0", "items0"))
def restock(spark, folder):
    stock = existing_items(spark, folder)
    puts = lines0(spark, folder).withColumnRenamed("qty", "amount")
    answers, after = batching.put_items(puts, stock)
    return (answers.join(after.withColumnRenamed("amount", "stock_after"), "item_id", "left")
            .withColumn("passed", batching.passed(F.col("code"))).withColumn("code", F.col("code").cast("bigint")))


# -- the order's side of a checkout ----------------------------------------------------

@query("payment_outcome", sql("""
    SELECT order_id, CASE WHEN coalesce(price, 0) = 0 THEN 2::BIGINT WHEN ok THEN 0 ELSE 1 END code,
           CASE WHEN coalesce(price, 0) = 0 THEN 0::BIGINT WHEN ok THEN 1 ELSE 2 END status,
           CASE WHEN coalesce(price, 0) = 0 THEN 'Cannot pay for an empty order.'
                WHEN ok THEN 'Credits subtracted.' ELSE 'Not enough credits.' END message, bal user_credits
    FROM orders0 LEFT JOIN (SELECT order_id, price, ok, bal FROM user_fold) USING (order_id)""", "orders0", "user_fold"))
def payment_outcome(spark, folder):
    prices = plan.order_prices(lines0(spark, folder)).drop("n_items")
    return (checkout_payments(orders0(spark, folder), prices, users0(spark, folder).select("user_id", "credits"),
                              sized_by=size_of(spark, folder, "o_custkey"))
            .withColumns({"code": F.col("code").cast("bigint"), "status": F.col("status").cast("bigint")}))


@query("progress_flags", sql("""
    SELECT order_id, bits, false awaiting_send, bits & 12 <> 0 awaiting_replenish, bits & 12 <> 0 awaiting_anything,
           bits & 48 <> 0 has_failed, bits & 192 = 192 has_succeeded, bits & 768 <> 0 replenish_sent
    FROM (SELECT order_id, CASE WHEN stock_ok THEN 64::BIGINT ELSE 16 END + CASE WHEN payment_ok THEN 128 ELSE 32 END
               + CASE WHEN is_paid THEN 0 WHEN restock_qty > 0 THEN 256 + 4 ELSE 256 END
               + CASE WHEN refund > 0 THEN 512 + 8 ELSE 0 END bits FROM saga)""", "saga"))
def progress_flags(spark, folder):
    bits = plan.progress_bits(F.col("stock_ok"), F.col("payment_ok"), F.col("restock_qty"))
    return saga(spark, folder).withColumn("bits", bits.cast("bigint")).select(
        "order_id", "bits", *[c.alias(n) for n, c in progress_view(F.col("bits")).items()])


@query("compensations", sql("""
    SELECT order_id, 'stock_in' topic, 'batch/add' route, 'batch:add' state, restock_qty amount
    FROM saga WHERE restock_qty > 0
    UNION ALL SELECT order_id, 'payment_in', 'orders/checkout', 'replenish-payment', refund FROM saga WHERE refund > 0
    """, "saga"))
def compensations(spark, folder):
    return plan.compensations(saga(spark, folder))


@query("checkout_log", sql("""
    SELECT order_id, '[' || string_agg(entry, ',' ORDER BY entry) || ']' log FROM (
        SELECT order_id, '{"message":"Not enough items in stock: ' || item_id || '","status":"FAILURE","status_code":1}' entry
        FROM item_fold WHERE NOT ok
        UNION ALL SELECT order_id, '{"message":"Not enough credits.","status":"FAILURE","status_code":1}'
        FROM user_fold WHERE NOT ok) GROUP BY 1""", "item_fold", "user_fold"))
def checkout_log(spark, folder):
    lines, orders = lines0(spark, folder), orders0(spark, folder)
    stock = (plan.reserve_stock(lines, orders, items0(spark, folder), sized_by=size_of(spark, folder, "l_partkey"))
             .withColumn("code", F.when(F.col("accepted"), v.SUCCESS).otherwise(v.FAILURE)))
    paid = (plan.debit_users(plan.order_prices(lines), orders, users0(spark, folder))
            .withColumns({"code": F.when(F.col("accepted"), v.SUCCESS).otherwise(v.FAILURE),
                          "message": F.lit(v.NO_CREDITS)}))
    return plan.checkout_log(stock, paid, size_of(spark, folder, "l_orderkey"))


@query("checkout_outcomes", sql("""
    SELECT CASE WHEN is_paid THEN 'Order checkout done: Order successfully purchased.'
                ELSE 'Order checkout reverted: Order checkout failed.' END outcome, count(*) n
    FROM saga GROUP BY 1""", "saga"))
def checkout_outcomes(spark, folder):
    return plan.outcomes(saga(spark, folder))
