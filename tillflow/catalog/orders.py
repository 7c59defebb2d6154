"""Orders, baskets and the checks around a checkout."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.accounts import NOT_FOUND, existing_items, existing_users
from tillflow.catalog.views import sql
from tillflow.functions.jsontext import json_object, quoted
from tillflow.operators import guards, orders as ops
from tillflow.operators.batching import missing_for_fan_out
from tillflow.plans.checkout import order_prices
from tillflow.sources.fixtures import lines0, micros, orders0, size_of
from tillflow.sources.tables import table

USER_THERE = "user_id IN (SELECT user_id FROM users0 WHERE user_exists)"
ITEM_THERE = "item_id IN (SELECT item_id FROM items0 WHERE item_exists)"
OPEN = f"({USER_THERE} AND NOT is_paid AND checkout_status IN (0, 3))"


def checked_orders(spark, folder):
    """Orders with ``user_checked`` and price; empty ones cost 0."""
    known = existing_users(spark, folder).select("user_id").withColumn("there_", F.lit(True))
    prices = order_prices(lines0(spark, folder))
    return (orders0(spark, folder).join(known, "user_id", "left").join(prices, "order_id", "left")
            .withColumns({"user_checked": F.coalesce("there_", F.lit(False)),
                          "price": F.coalesce("price", F.lit(0).cast("bigint")),
                          "checkout_progress": F.lit(0)}).drop("there_"))


@query("order_price", sql("""
    SELECT order_id, coalesce(price, 0) price FROM orders0 LEFT JOIN prices USING (order_id)""", "orders0", "prices"))
def order_price(spark, folder):
    return checked_orders(spark, folder).select("order_id", "price")


@query("create_orders", sql(f"""
    SELECT order_id, user_id, {USER_THERE} user_checked,
           CASE WHEN {USER_THERE} THEN 'success' ELSE 'failure' END result,
           CASE WHEN {USER_THERE} THEN 'Order created.' ELSE 'Order not created. User did not exist.' END message
    FROM orders0""", "orders0", "users0"))
def create_orders(spark, folder):
    return ops.create_orders(orders0(spark, folder).select("order_id", "user_id"), existing_users(spark, folder))


@query("remove_orders", sql(f"""
    SELECT r.order_id, user_id, CASE WHEN NOT is_paid AND checkout_status = 0 THEN 'success' ELSE 'error' END result,
           CASE WHEN o.order_id IS NULL THEN '{NOT_FOUND.format('order')}'
                WHEN is_paid OR checkout_status <> 0 THEN 'Managed Exception: Cannot remove order.'
                ELSE 'Order removed.' END message
    FROM (SELECT CASE WHEN seq % 5 = 0 THEN order_id || 'x' ELSE order_id END order_id FROM orders0) r
    LEFT JOIN orders0 o USING (order_id)""", "orders0"))
def remove_orders(spark, folder):
    orders = orders0(spark, folder)
    asked = orders.select(F.when(F.col("seq") % 5 == 0, F.concat("order_id", F.lit("x")))
                          .otherwise(F.col("order_id")).alias("order_id"))
    return ops.remove_orders(asked, orders)


@query("add_items", sql(f"""
    SELECT order_id, item_id, CASE WHEN NOT {OPEN} THEN 'error' WHEN {ITEM_THERE} THEN 'success' ELSE 'failure' END result,
           CASE WHEN NOT {OPEN} THEN 'Managed Exception: Cannot modify order.'
                WHEN {ITEM_THERE} THEN 'Item added.' ELSE 'Item does not exist.' END message
    FROM lines0 JOIN orders0 USING (order_id)""", "lines0", "orders0", "users0", "items0"))
def add_items(spark, folder):
    return ops.add_items(lines0(spark, folder).select("order_id", "item_id"), orders0(spark, folder),
                         existing_users(spark, folder), existing_items(spark, folder))


@query("remove_items", sql(f"""
    SELECT r.order_id, r.item_id,
           CASE WHEN NOT {OPEN.replace('user_id IN', 'o.user_id IN')} THEN 'error' WHEN l.item_id IS NULL THEN 'failure' ELSE 'success' END result,
           CASE WHEN NOT {OPEN.replace('user_id IN', 'o.user_id IN')} THEN 'Managed Exception: Cannot modify order.'
                WHEN l.item_id IS NULL THEN 'No such item exists.' ELSE 'Item(s) removed.' END message
    FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) order_id,
                 CAST(l_partkey + l_linenumber % 2 AS VARCHAR) item_id FROM lineitem) r
    JOIN orders0 o USING (order_id) LEFT JOIN lines0 l ON l.order_id = r.order_id AND l.item_id = r.item_id""",
    "lines0", "orders0", "users0"))
def remove_items(spark, folder):
    asked = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string").alias("item_id")).distinct()
    return ops.remove_items(asked, orders0(spark, folder), existing_users(spark, folder), lines0(spark, folder))


def basket_changes(spark, folder):
    """Lines as adds of one of three items; a returned line clears its item."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_partkey") % 3).cast("string").alias("item_id"),
        micros(F.col("l_shipdate")).alias("t"), (F.col("l_returnflag") != "R").alias("is_add"))


@query("basket", sql("""
    SELECT order_id, item_id, count(*) qty FROM changes c
    WHERE is_add AND NOT EXISTS (SELECT 1 FROM changes r WHERE NOT r.is_add AND r.order_id = c.order_id
                                 AND r.item_id = c.item_id AND r.t >= c.t) GROUP BY 1, 2""",
    changes="""SELECT CAST(l_orderkey AS VARCHAR) order_id, CAST(l_partkey % 3 AS VARCHAR) item_id,
               epoch_us(l_shipdate) t, l_returnflag <> 'R' is_add FROM lineitem"""))
def basket(spark, folder):
    return ops.basket(basket_changes(spark, folder))


PRODUCTS = """SELECT order_id, '{' || string_agg('"' || item_id || '":' || qty, ',' ORDER BY item_id) || '}' products
              FROM lines0 GROUP BY 1"""


def listed_products(spark, folder):
    return ops.products(lines0(spark, folder), size_of(spark, folder, "l_orderkey"))


@query("order_view", sql(f"""
    SELECT order_id, '{{"order_id":"' || order_id || '","user_id":"' || user_id || '","user_checked":'
        || ({USER_THERE})::VARCHAR || ',"is_paid":' || is_paid::VARCHAR || ',"products":' || coalesce(products, '{{}}')
        || ',"checkout_status":' || checkout_status || ',"checkout_progress":0}}' params
    FROM orders0 LEFT JOIN products USING (order_id)""", "orders0", "users0", "lines0", products=PRODUCTS))
def order_view(spark, folder):
    return ops.order_view(checked_orders(spark, folder), lines0(spark, folder), size_of(spark, folder, "l_orderkey"))


@query("json_products", sql("SELECT order_id, item_id, qty FROM lines0", "lines0"))
def json_products(spark, folder):
    packed = listed_products(spark, folder)
    return packed.select("order_id", F.explode(F.from_json("products", "map<string,bigint>")).alias("item_id", "qty"))


@query("map_ops", sql("""
    SELECT order_id, count(*) + 1 n_put, count(*) FILTER (qty > 10) n_large, CAST(sum(qty) + 1 AS BIGINT) total,
           coalesce(max(qty) FILTER (item_id = '7'), 0) seven, bool_or(item_id = '7') has_seven,
           string_agg(item_id, ',' ORDER BY item_id) item_ids
    FROM lines0 GROUP BY 1""", "lines0"))
def map_ops(spark, folder):
    held = listed_products(spark, folder).withColumn("held", F.from_json("products", "map<string,bigint>"))
    put = F.map_concat("held", F.create_map(F.lit("gift"), F.lit(1).cast("bigint")))
    none = F.lit(0).cast("bigint")
    return held.select(
        "order_id", F.size(put).cast("bigint").alias("n_put"),
        F.size(F.map_filter("held", lambda _, q: q > 10)).cast("bigint").alias("n_large"),
        F.aggregate(F.map_values(put), none, lambda a, x: a + x).alias("total"),
        F.coalesce(F.try_element_at("held", F.lit("7")), none).alias("seven"),
        F.map_contains_key("held", "7").alias("has_seven"),
        F.array_join(F.array_sort(F.map_keys("held")), ",").alias("item_ids"))


@query("order_can_modify", sql(f"SELECT order_id, {OPEN} can_modify FROM orders0", "orders0", "users0"))
def order_can_modify(spark, folder):
    return checked_orders(spark, folder).select("order_id", guards.can_modify(
        F.col("user_checked"), F.col("is_paid"), F.col("checkout_status")).alias("can_modify"))


@query("order_can_remove", sql("""
    SELECT order_id, NOT is_paid AND checkout_status = 0 can_remove FROM orders0""", "orders0"))
def order_can_remove(spark, folder):
    return orders0(spark, folder).select("order_id", guards.can_remove(
        F.col("is_paid"), F.col("checkout_status")).alias("can_remove"))


@query("checkout_precheck", sql(f"""
    SELECT r.order_id, CASE WHEN o.order_id IS NULL THEN '{NOT_FOUND.format('order')[19:]}'
        WHEN is_paid THEN 'Order has already been paid.'
        WHEN o.user_id NOT IN (SELECT user_id FROM users0 WHERE user_exists) THEN 'Cannot checkout order.'
        WHEN checkout_status = 2 THEN 'Order already concluded.' WHEN checkout_status = 3 THEN 'Order checkout failed.'
        WHEN coalesce(price, 0) <= 0 THEN 'Cannot checkout an order with no items.' END reason
    FROM (SELECT order_id FROM orders0 UNION ALL SELECT order_id || 'x' FROM orders0 WHERE seq % 10 = 0) r
    LEFT JOIN orders0 o USING (order_id) LEFT JOIN prices p ON p.order_id = r.order_id""", "orders0", "users0", "prices"))
def checkout_precheck(spark, folder):
    orders = checked_orders(spark, folder)
    all_ids = orders0(spark, folder).select("order_id", "seq")
    asked = all_ids.select("order_id").unionByName(
        all_ids.where("seq % 10 = 0").select(F.concat("order_id", F.lit("x")).alias("order_id")))
    exists = F.col("user_id").isNotNull()
    return asked.join(orders, "order_id", "left").select("order_id", guards.checkout_reason(
        exists, F.col("is_paid"), F.col("user_checked"), F.col("checkout_status"), F.col("price")).alias("reason"))


@query("checkout_requests", sql("""
    SELECT order_id, 'stock_in' topic, 'batch/subtract' route, 'batch:subtract' state,
           '{"products":' || products || ',"order_id":"' || order_id || '","user_id":"' || user_id
           || '","return_state":"send-stock"}' params FROM orders0 JOIN products USING (order_id)
    UNION ALL SELECT order_id, 'payment_in', 'orders/checkout', 'send-payment',
           '{"order_id":"' || order_id || '","user_id":"' || user_id || '","price":' || price || '}'
           FROM orders0 JOIN prices USING (order_id)""", "orders0", "prices", products=PRODUCTS))
def checkout_requests(spark, folder):
    lines = lines0(spark, folder)
    return ops.checkout_requests(orders0(spark, folder), lines, order_prices(lines), size_of(spark, folder, "l_orderkey"))


@query("mark_paid", sql(f"""
    SELECT order_id, coalesce(is_paid, false) OR (p.order_id IS NOT NULL AND o.order_id IS NOT NULL) is_paid,
           CASE WHEN o.order_id IS NULL THEN '{NOT_FOUND.format('order')}' END message
    FROM orders0 o FULL JOIN (
        SELECT order_id FROM orders0 WHERE seq % 2 = 0 UNION ALL SELECT order_id || 'x' FROM orders0 WHERE seq % 9 = 0) p
    USING (order_id)""", "orders0"))
def mark_paid(spark, folder):
    orders = orders0(spark, folder)
    notices = orders.where("seq % 2 = 0").select("order_id").unionByName(
        orders.where("seq % 9 = 0").select(F.concat("order_id", F.lit("x")).alias("order_id")))
    return ops.mark_paid(orders, notices)


@query("require_fields", sql("""
    SELECT order_id, CASE WHEN products IS NULL THEN 'Products node is expected to exist.'
                          WHEN checkout_status = 3 THEN 'User ID is expected to exist.' END reason
    FROM orders0 LEFT JOIN products USING (order_id)""", "orders0", "lines0", products=PRODUCTS))
def require_fields(spark, folder):
    listed = listed_products(spark, folder)
    whole = json_object(products=F.coalesce("products", F.lit("null")), order_id=quoted("order_id"),
                        user_id=quoted("user_id"))
    nameless = json_object(products=F.coalesce("products", F.lit("null")), order_id=quoted("order_id"))
    messages = orders0(spark, folder).join(listed, "order_id", "left").withColumn(
        "params", F.when(F.col("checkout_status") == v.FAILED, nameless).otherwise(whole))
    return messages.select("order_id", missing_for_fan_out(F.col("params")).alias("reason"))
