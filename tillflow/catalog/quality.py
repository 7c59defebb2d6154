"""Data-quality checks over whole results."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.accounts import existing_items, existing_users
from tillflow.catalog.checkouts import credit_commands, saga
from tillflow.catalog.orders import ITEM_THERE, OPEN, basket_changes
from tillflow.catalog.views import sql
from tillflow.operators import guards, ledger, orders as order_ops, quality
from tillflow.plans import checkout as plan
from tillflow.session import written
from tillflow.sources.fixtures import items0, lines0, orders0, size_of, users0


@query("dq_credit_conserved", sql("""
    SELECT user_id key, arg_max(bal, rn) change, coalesce(CAST(sum(delta) FILTER (ok AND delta > 0) AS BIGINT), 0) added,
           coalesce(CAST(-sum(delta) FILTER (ok AND delta < 0) AS BIGINT), 0) subtracted, true conserved
    FROM ledger GROUP BY 1""", "ledger"))
def dq_credit_conserved(spark, folder):
    commands = credit_commands(spark, folder)
    nothing = commands.select("key").distinct().withColumn("opening", F.lit(0).cast("bigint"))
    sizes = size_of(spark, folder, "user_id")
    return quality.conserved(ledger.guarded_ledger(commands, sized_by=sizes),
                             ledger.guarded_balance(commands, sized_by=sizes), nothing)


@query("dq_stock_conserved", sql("""
    SELECT item_id key, coalesce(s.back, 0) - coalesce(s.taken, 0) change, coalesce(s.back, 0) added,
           coalesce(s.taken, 0) subtracted, true conserved
    FROM items0 LEFT JOIN (SELECT item_id, CAST(sum(qty) AS BIGINT) taken,
                                  coalesce(CAST(sum(qty) FILTER (NOT is_paid) AS BIGINT), 0) back
                           FROM item_fold JOIN saga USING (order_id) WHERE ok GROUP BY 1) s USING (item_id)""",
    "items0", "item_fold", "saga"))
def dq_stock_conserved(spark, folder):
    """The stock after all checkouts, from the orders that were bought, against what the ledger took and got back."""
    lines, items = lines0(spark, folder), items0(spark, folder).select("item_id", "amount")
    # the ledger and the checkouts are each read several times
    taken = written(plan.reserve_stock(lines, orders0(spark, folder), items, sized_by=size_of(spark, folder, "l_partkey"))
                    .select("item_id", "order_id", "qty", "accepted"), "taken")
    result = written(plan.checkout(lines, orders0(spark, folder), items, users0(spark, folder), taken=taken)
                     .select("order_id", "is_paid"), "checkouts")
    closing = plan.stock_after(result, lines, items).select(F.col("item_id").alias("key"), F.col("amount").alias("balance"))
    moves = taken.where("accepted").join(result.select("order_id", "is_paid"), "order_id").select(
        F.col("item_id").alias("key"), "accepted", F.explode(F.when(F.col("is_paid"), F.array(-F.col("qty")))
                                                             .otherwise(F.array(-F.col("qty"), F.col("qty")))).alias("delta"))
    opening = items.select(F.col("item_id").alias("key"), F.col("amount").alias("opening"))
    return quality.conserved(moves, closing, opening)


@query("dq_removed_orders", sql("""
    SELECT count(*) n_checked, CAST(0 AS BIGINT) n_violations FROM orders0
    WHERE seq % 3 = 0 AND NOT is_paid AND checkout_status = 0""", "orders0"))
def dq_removed_orders(spark, folder):
    orders = orders0(spark, folder)
    asked = orders.where("seq % 3 = 0").select("order_id")
    gone = order_ops.remove_orders(asked, orders).where("result = 'success'").select("order_id", "user_id")
    left = orders.where(~((F.col("seq") % 3 == 0) & guards.can_remove(F.col("is_paid"), F.col("checkout_status"))))
    return quality.still_there(gone, left, ["user_id", "order_id"])


@query("dq_added_items", sql(f"""
    SELECT count(*) n_checked, CAST(0 AS BIGINT) n_violations FROM lines0 JOIN orders0 USING (order_id)
    WHERE {OPEN} AND {ITEM_THERE}""", "lines0", "orders0", "users0", "items0"))
def dq_added_items(spark, folder):
    lines = lines0(spark, folder)
    added = order_ops.add_items(lines.select("order_id", "item_id"), orders0(spark, folder),
                                existing_users(spark, folder), existing_items(spark, folder)).where("result = 'success'")
    baskets = order_ops.products(lines).select(
        "order_id", F.explode(F.map_keys(F.from_json("products", "map<string,bigint>"))).alias("item_id"))
    return quality.not_there(added, baskets, ["order_id", "item_id"])


@query("dq_removed_items", sql("""
    SELECT count(*) n_checked, CAST(0 AS BIGINT) n_violations FROM (
        SELECT order_id, item_id FROM changes GROUP BY 1, 2
        HAVING max(t) FILTER (NOT is_add) IS NOT NULL AND max(t) FILTER (NOT is_add) >= coalesce(max(t) FILTER (is_add), 0))""",
    changes="""SELECT CAST(l_orderkey AS VARCHAR) order_id, CAST(l_partkey % 3 AS VARCHAR) item_id,
               epoch_us(l_shipdate) t, l_returnflag <> 'R' is_add FROM lineitem"""))
def dq_removed_items(spark, folder):
    """Items whose last change is a removal must not be in the basket."""
    changes = basket_changes(spark, folder)
    when = F.col("t")
    last = changes.groupBy("order_id", "item_id").agg(
        F.max(F.when(~F.col("is_add"), when)).alias("removed"), F.max(F.when(F.col("is_add"), when)).alias("added"))
    gone = last.where(F.col("removed").isNotNull() & (F.col("removed") >= F.coalesce("added", F.lit(0))))
    return quality.still_there(gone, order_ops.basket(changes), ["order_id", "item_id"])


@query("dq_checkout_outcome", sql("""
    SELECT count(*) n_checked, CAST(0 AS BIGINT) n_violations FROM saga""", "saga"))
def dq_checkout_outcome(spark, folder):
    """A checkout either succeeds or fails with nothing kept: neither goods nor money."""
    done = saga(spark, folder)
    bought = F.col("is_paid") & (F.col("checkout_status") == v.SUCCEEDED) & (F.col("restock_qty") == 0) & (F.col("refund") == 0)
    undone = (~F.col("is_paid") & (F.col("checkout_status") == v.FAILED)
              & (F.col("refund") == F.when(F.col("payment_ok"), F.col("price")).otherwise(0)))
    return done.agg(F.count("*").alias("n_checked"), F.count_if(~(bought | undone)).alias("n_violations"))
