"""Users and orders that are created, removed and created again."""

from pyspark.sql import functions as F

from tillflow.catalog import query
from tillflow.catalog.accounts import NOT_FOUND, existing_users
from tillflow.catalog.views import sql
from tillflow.operators import lifecycle
from tillflow.sources.fixtures import orders0, users0

# every order in these steps, a microsecond apart; only paid orders are locked
STEPS = ["orders/create", "orders/create", "orders/remove", "orders/remove", "orders/create", "orders/lock",
         "orders/remove", "orders/create"]
# every user is removed twice in the middle of its orders, and created twice a month later
PAUSE = 30 * 86_400_000_000
USER_STEPS = [("users/remove", 0), ("users/remove", 1), ("users/create", PAUSE), ("users/create", PAUSE + 1)]
USER_SEQ = 1 << 40


def life_commands(spark, folder):
    orders = orders0(spark, folder)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(verb).alias("verb")) for i, verb in enumerate(STEPS)])
    of_orders = orders.select("user_id", "order_id", "t", "seq", "is_paid", F.explode(steps).alias("s")).where(
        "s.verb <> 'orders/lock' or is_paid").select(
        "s.verb", "user_id", "order_id", (F.col("t") + F.col("s.i")).alias("t"), (F.col("seq") * 8 + F.col("s.i")).alias("seq"))
    middle = orders.groupBy("user_id").agg(((F.min("t") + F.max("t")) / 2).cast("bigint").alias("middle"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(verb).alias("verb"), F.lit(at).cast("bigint").alias("at"))
                      for i, (verb, at) in enumerate(USER_STEPS)])
    of_users = users0(spark, folder).join(middle, "user_id", "left").select("user_id", "middle", F.explode(steps).alias("s")).select(
        "s.verb", "user_id", F.lit(None).cast("string").alias("order_id"),
        (F.coalesce("middle", F.lit(0)) + 100 + F.col("s.at")).alias("t"),
        (F.col("user_id").cast("bigint") * 4 + F.col("s.i") + USER_SEQ).alias("seq"))
    return of_orders.unionByName(of_users)


CREATED = "'Order created.'"
TAKEN = "'Managed Exception: Order already exists.'"
GONE = f"'{NOT_FOUND.format('order')}'"
KEPT = "'Managed Exception: Cannot remove order.'"
NO_USER = "'Order not created. User did not exist.'"
# messages of each step where the user is there, and where not
WITH_USER = [CREATED, TAKEN, "'Order removed.'", GONE, CREATED, None,
             f"CASE WHEN is_paid THEN {KEPT} ELSE 'Order removed.' END", f"CASE WHEN is_paid THEN {TAKEN} ELSE {CREATED} END"]
WITHOUT = [NO_USER, NO_USER, GONE, GONE, NO_USER, None, GONE, NO_USER]
ANSWERS = " UNION ALL ".join(
    f"SELECT '{verb}' verb, user_id, order_id, seq * 8 + {i} seq, CASE WHEN ok THEN {WITH_USER[i]} ELSE {WITHOUT[i]} END message FROM owned"
    for i, verb in enumerate(STEPS) if WITH_USER[i])
SQL = sql(f"""
    SELECT *, CASE WHEN message = {NO_USER} THEN 'failure' WHEN message LIKE 'Managed%' THEN 'error' ELSE 'success' END result FROM (
        {ANSWERS}
        UNION ALL SELECT 'cascade', user_id, order_id, CAST(user_id AS BIGINT) * 4 + {USER_SEQ},
            CASE WHEN is_paid THEN {KEPT} ELSE 'Order removed.' END FROM owned WHERE ok AND t < ends
        UNION ALL SELECT verb, user_id, NULL, CAST(user_id AS BIGINT) * 4 + i + {USER_SEQ},
            CASE WHEN i = 0 AND user_exists THEN 'User removed.' WHEN i < 2 THEN '{NOT_FOUND.format('user')}'
                 WHEN i = 2 THEN 'User created.' ELSE 'Managed Exception: User already exists.' END
        FROM ends, (VALUES (0, 'users/remove'), (1, 'users/remove'), (2, 'users/create'), (3, 'users/create')) s(i, verb))""",
    "orders0", "users0",
    ends="""SELECT user_id, user_exists, coalesce(middle, 0) + 100 ends FROM users0 LEFT JOIN (
            SELECT user_id, CAST(trunc((min(t) + max(t)) / 2) AS BIGINT) middle FROM orders0 GROUP BY 1) USING (user_id)""",
    owned=f"""SELECT o.*, ends, CASE WHEN t < ends THEN user_exists ELSE t >= ends + {PAUSE} END ok
              FROM orders0 o JOIN ends USING (user_id)""")


@query("entity_lives", SQL)
def entity_lives(spark, folder):
    """Repeated creations and removals of orders and users, and what a user's removal brings."""
    done = lifecycle.lives(life_commands(spark, folder), existing_users(spark, folder))
    return done.select("verb", "user_id", "order_id", "seq", "result", "message")
