"""Users and stock items."""

from pyspark.sql import functions as F

from tillflow.catalog import query
from tillflow.catalog.views import sql
from tillflow.operators import accounts, guards
from tillflow.operators.batching import count_items
from tillflow.sources.fixtures import cmd, items0, lines0, orders0, size_of, users0

NOT_FOUND = "Managed Exception: Entry ''{}'' with the given ID does not exist."


def existing_users(spark, folder):
    return users0(spark, folder).where("user_exists").drop("user_exists")


def existing_items(spark, folder):
    return items0(spark, folder).where("item_exists").drop("item_exists")


def line_requests(spark, folder):
    """One request per order line, numbered by order and item."""
    orders = orders0(spark, folder).select("order_id", "t", F.col("seq").alias("order_seq"))
    return lines0(spark, folder).join(orders, "order_id").select(
        "order_id", "item_id", "qty", "t", (F.col("order_seq") * 10_000_000 + F.col("item_id").cast("bigint")).alias("seq"))


LINE_REQUESTS = """SELECT order_id, item_id, qty, t, seq * 10000000 + CAST(item_id AS BIGINT) seq
                   FROM lines0 JOIN orders0 USING (order_id)"""


@query("create_users", sql("""
    SELECT seq, user_id, CASE WHEN seq = f THEN 'success' ELSE 'error' END result,
           CASE WHEN seq = f THEN 'User created.' ELSE 'Managed Exception: User already exists.' END message
    FROM (SELECT seq, user_id, first_value(seq) OVER (PARTITION BY user_id ORDER BY t, seq) f FROM cmd)""", "cmd"))
def create_users(spark, folder):
    return accounts.create_once(cmd(spark, folder), "user_id", "User created.", "User already exists.")


@query("create_items", sql("""
    SELECT seq, item_id, CASE WHEN seq = f THEN 'success' ELSE 'error' END result,
           CASE WHEN seq = f THEN 'Item created.' ELSE 'Managed Exception: Item already exists.' END message
    FROM (SELECT seq, item_id, first_value(seq) OVER (PARTITION BY item_id ORDER BY t, seq) f FROM line_requests)""",
    "lines0", "orders0", line_requests=LINE_REQUESTS))
def create_items(spark, folder):
    return accounts.create_once(line_requests(spark, folder), "item_id", "Item created.", "Item already exists.")


@query("user_view", sql(f"""
    SELECT c.seq, c.user_id, CASE WHEN u.user_id IS NULL THEN 'error' ELSE 'success' END result,
           CASE WHEN u.user_id IS NULL THEN '{NOT_FOUND.format('user')}' END message,
           '{{"user_id":"' || u.user_id || '","balance":' || u.credits || ',"orders":"[' || coalesce(o.ids, '') || ']"}}' params
    FROM cmd c LEFT JOIN (SELECT * FROM users0 WHERE user_exists) u USING (user_id)
    LEFT JOIN (SELECT user_id, string_agg(order_id, ', ' ORDER BY order_id) ids FROM orders0 GROUP BY 1) o USING (user_id)
    WHERE c.route IN ('users/find', 'users/credit')""", "cmd", "users0", "orders0"))
def user_view(spark, folder):
    known = accounts.order_sets(existing_users(spark, folder), orders0(spark, folder), size_of(spark, folder, "o_custkey")).withColumn(
        "params", accounts.user_params())
    asked = cmd(spark, folder).where(F.col("route").isin("users/find", "users/credit"))
    return accounts.answer_view(asked, known, "user_id", "user")


@query("stock_view", sql(f"""
    SELECT l.seq, l.item_id, CASE WHEN i.item_id IS NULL THEN 'error' ELSE 'success' END result,
           CASE WHEN i.item_id IS NULL THEN '{NOT_FOUND.format('stock_item')}' END message,
           '{{"item_id":"' || i.item_id || '","amount":' || i.amount || '}}' params
    FROM line_requests l LEFT JOIN (SELECT * FROM items0 WHERE item_exists) i USING (item_id)""",
    "lines0", "orders0", "items0", line_requests=LINE_REQUESTS))
def stock_view(spark, folder):
    known = existing_items(spark, folder).withColumn("params", accounts.stock_params())
    return accounts.answer_view(line_requests(spark, folder), known, "item_id", "stock_item")


@query("user_orders", sql("""
    SELECT user_id, '[' || coalesce(ids, '') || ']' orders
    FROM users0 LEFT JOIN (
        SELECT user_id, string_agg(order_id, ', ' ORDER BY order_id) ids FROM orders0
        WHERE NOT (seq % 3 = 0 AND NOT is_paid AND checkout_status = 0) GROUP BY 1) USING (user_id)""",
    "users0", "orders0"))
def user_orders(spark, folder):
    gone = (F.col("seq") % 3 == 0) & guards.can_remove(F.col("is_paid"), F.col("checkout_status"))
    return accounts.order_sets(users0(spark, folder), orders0(spark, folder).where(~gone), size_of(spark, folder, "o_custkey")).select("user_id", "orders")


@query("remove_user_cascade", sql("""
    SELECT user_id, order_id, 'order_in' topic, 'orders/remove' route, 'user-order-removed' state,
           CASE WHEN NOT is_paid AND checkout_status = 0 THEN 'success' ELSE 'error' END result,
           CASE WHEN NOT is_paid AND checkout_status = 0 THEN 'Order removed.'
                ELSE 'Managed Exception: Cannot remove order.' END message
    FROM orders0 WHERE user_id IN (SELECT user_id FROM users0 WHERE credits = 0)
    UNION ALL SELECT user_id, NULL, NULL, 'web', NULL, 'success', 'User removed.' FROM users0 WHERE credits = 0""",
    "users0", "orders0"))
def remove_user_cascade(spark, folder):
    return accounts.remove_users(users0(spark, folder).where("credits = 0"), orders0(spark, folder))


@query("exists_guard", sql(f"""
    SELECT order_id, CASE WHEN u.user_id IS NULL THEN '{NOT_FOUND.format('user')[19:]}' END reason
    FROM orders0 LEFT JOIN (SELECT user_id FROM users0 WHERE user_exists) u USING (user_id)""", "orders0", "users0"))
def exists_guard(spark, folder):
    return guards.exists_guard(orders0(spark, folder), existing_users(spark, folder), "user_id", "user").select(
        "order_id", "reason")


@query("batch_count", sql("""
    SELECT order_id, item_id, coalesce(amount, -1) in_stock FROM lines0
    LEFT JOIN (SELECT item_id, amount FROM items0 WHERE item_exists) USING (item_id)""", "lines0", "items0"))
def batch_count(spark, folder):
    return count_items(lines0(spark, folder).select("order_id", "item_id"), existing_items(spark, folder))
