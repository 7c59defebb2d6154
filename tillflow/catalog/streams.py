"""Streaming queries. Each reads whole tables as streams and returns what its sink holds."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.accounts import NOT_FOUND, existing_users
from tillflow.catalog.batches import BATCH_ITEMS, SEEN, batch_items
from tillflow.catalog.orders import ITEM_THERE, OPEN, USER_THERE, checked_orders, listed_products
from tillflow.catalog.payments import ASKED, PAY_FOLD, pay_requests
from tillflow.catalog.responses import SESSION_GAP, SESSIONS
from tillflow.catalog.views import sql
from tillflow.functions import envelope as env
from tillflow.functions.jsontext import field, json_object, quoted
from tillflow.session import fresh_path, state_stores
from tillflow.sources import bus as buses
from tillflow.sources.fixtures import as_commands, cmd, items0, lines0, micros, msg, orders0, request_params, users0
from tillflow.operators import correlate
from tillflow.operators.routing import target_topic
from tillflow.sources.tables import table_stream
from tillflow.streaming import analytics, jobs, processors, replay


FAR = "2200-01-01 00:00:00"
ANSWER_DAYS = 30  # a shipment later than that is no answer to its order


def drained(spark, stream, schema, label, *partition_by, mode="append"):
    """Run a stream over all there is, into a fresh folder, and read that back."""
    path = fresh_path(spark, label)
    with state_stores(spark):
        query = (stream.writeStream.format("parquet").option("path", f"{path}/out").partitionBy(*partition_by)
                 .option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


# -- stateless streams -----------------------------------------------------------------

@query("scan_commands", sql("SELECT seq, request_id, route, user_id, amount FROM cmd", "cmd"))
def scan_commands(spark, folder):
    stream = as_commands(table_stream(spark, folder, "events")).select("seq", "request_id", "route", "user_id", "amount")
    return drained(spark, stream, stream.schema, "scan")


@query("sink_topics", sql("""
    SELECT CASE route WHEN 'users/credit/add' THEN 'order_in' WHEN 'users/credit/subtract' THEN 'stock_in'
                      ELSE 'user_out_api1' END topic, seq FROM cmd""", "cmd"))
def sink_topics(spark, folder):
    commands = as_commands(table_stream(spark, folder, "events"))
    to = (F.when(F.col("route") == "users/credit/add", F.lit("order_in"))
           .when(F.col("route") == "users/credit/subtract", F.lit("stock_in")))
    stream = commands.select("seq", target_topic(to).alias("topic"))
    return drained(spark, stream, stream.schema, "topics", "topic")


# -- one service ---------------------------------------------------------------------------

def web(df, topic, route, **params):
    """Requests of the front end as bus records; ``df`` has ts, seq and ``request_id``."""
    route = F.lit(route) if isinstance(route, str) else route
    body = params.pop("body", None)
    if body is None:
        body = json_object(**{k: quoted(c) for k, c in params.items()})
    return df.select(F.lit(topic).alias("topic"),
                     env.make_envelope(F.col("request_id"), F.lit(topic), route, body).alias("value"),
                     F.col("ts").cast("timestamp").alias("ts"), "seq")


def user_snapshot(users):
    return users.select(F.col("user_id").alias("key"), "credits", F.lit(None).cast("array<string>").alias("orders"))


def order_snapshot(spark, folder, paid=True, status=True, checked=True):
    """Orders with their baskets; the flags say which of their columns are taken over."""
    orders = checked_orders(spark, folder)
    return orders.join(listed_products(spark, folder), "order_id", "left").select(
        F.col("order_id").alias("key"), "user_id",
        (F.col("user_checked") if checked else F.lit(True)).alias("user_checked"),
        (F.col("is_paid") if paid else F.lit(False)).alias("is_paid"),
        (F.col("checkout_status") if status else F.lit(v.NOT_PROCESSED)).alias("checkout_status"),
        F.coalesce("products", F.lit("{}")).alias("products"))


USER_OPEN = {
    "open": "SELECT user_id AS key, credits FROM users0 WHERE user_exists",
    "folded": """SELECT user_id, seq, rn, credits + delta >= 0 ok,
               CASE WHEN credits + delta >= 0 THEN credits + delta ELSE credits END bal
        FROM ledger_cmd JOIN open ON key = user_id WHERE rn = 1
        UNION ALL SELECT c.user_id, c.seq, c.rn, f.bal + c.delta >= 0,
               CASE WHEN f.bal + c.delta >= 0 THEN f.bal + c.delta ELSE f.bal END
        FROM folded f JOIN ledger_cmd c ON c.user_id = f.user_id AND c.rn = f.rn + 1""",
}
USER_ANSWERS = sql(f"""
    SELECT c.seq, c.route, CASE WHEN NOT (c.user_id IN (SELECT key FROM open)) OR c.route = 'users/unknown'
               OR l.ok = false THEN 'error' ELSE 'success' END result,
           CASE WHEN c.route = 'users/unknown' THEN 'Managed Exception: Unrecognised route.'
                WHEN NOT (c.user_id IN (SELECT key FROM open)) THEN '{NOT_FOUND.format('user')}'
                WHEN l.ok = false THEN 'Managed Exception: Not enough credits.'
                WHEN c.route = 'users/credit/add' THEN 'Credits added.'
                WHEN c.route = 'users/credit/subtract' THEN 'Credits subtracted.' END message,
           CASE WHEN l.ok THEN l.bal END balance
    FROM cmd c LEFT JOIN folded l USING (seq)""", "ledger_cmd", "users0", **USER_OPEN)


def user_answers(parsed):
    moved = F.col("input.route").isin("users/credit/add", "users/credit/subtract")
    return parsed.select(
        "seq", "input.route", F.col("result.result").alias("result"), F.col("result.message").alias("message"),
        F.when(moved, field("result.params", "balance").try_cast("bigint")).alias("balance"))


@query("user_job", USER_ANSWERS)
def user_job(spark, folder):
    """Commands of the event log through the user job, on the customers' balances."""
    commands = as_commands(table_stream(spark, folder, "events"))
    records = web(commands, "user_in", F.col("route"), body=request_params(commands))
    out = jobs.service_job(records, v.USER, user_snapshot(existing_users(spark, folder)))
    sunk = drained(spark, out, out.schema, "user-job")
    return user_answers(env.parse_envelope(sunk))


@query("restart_recovers", USER_ANSWERS)
def restart_recovers(spark, folder):
    """The same commands in two halves, with the job stopped and started again in between."""
    commands = cmd(spark, folder)
    middle = commands.agg(F.expr("percentile_approx(seq, 0.5)").alias("middle"))
    halves = commands.join(F.broadcast(middle))
    bus = fresh_path(spark, "restart")
    buses.make_folders(spark, bus)
    for half in (halves.where("seq <= middle"), halves.where("seq > middle")):
        buses.send(web(half, "user_in", F.col("route"), body=request_params(half)), bus)
        replay.replay(spark, bus, {v.USER: user_snapshot(existing_users(spark, folder))}, only=[v.USER])
    return user_answers(env.parse_envelope(spark.read.schema(buses.RECORD).parquet(f"{bus}/{v.USER}")))


def served(spark, folder, service, requests, snapshots, **options):
    """Send requests, run one job once, and return its outgoing records parsed."""
    bus = fresh_path(spark, f"{service}-bus")
    buses.make_folders(spark, bus)
    for records in requests:
        buses.send(records, bus)
    replay.replay(spark, bus, snapshots, only=[service], **options)
    return env.parse_envelope(spark.read.schema(buses.RECORD).parquet(f"{bus}/{service}"))


@query("order_job", sql(f"""
    SELECT order_id, 'orders/find' asked, 'user_out_api1' topic, 'success' result, NULL message, coalesce(price, 0) price
    FROM orders0 LEFT JOIN prices USING (order_id)
    UNION ALL SELECT order_id || 'x', 'orders/remove', 'user_out_api1', 'error',
        '{NOT_FOUND.format('order')}', NULL FROM orders0 WHERE seq % 10 = 0
    UNION ALL SELECT order_id, 'orders/removeItem', 'user_out_api1',
        CASE WHEN NOT {OPEN} THEN 'error' WHEN has THEN 'success' ELSE 'failure' END,
        CASE WHEN NOT {OPEN} THEN 'Managed Exception: Cannot modify order.' WHEN has THEN 'Item(s) removed.'
             ELSE 'No such item exists.' END, NULL
    FROM orders0 JOIN (SELECT order_id, order_id IN (SELECT order_id FROM lines0 WHERE item_id = '7') has FROM orders0)
    USING (order_id)
    UNION ALL SELECT order_id, 'orders/remove', CASE WHEN NOT is_paid AND checkout_status = 0 THEN 'user_in' ELSE 'user_out_api1' END,
        CASE WHEN NOT is_paid AND checkout_status = 0 THEN NULL ELSE 'error' END,
        CASE WHEN NOT is_paid AND checkout_status = 0 THEN NULL ELSE 'Managed Exception: Cannot remove order.' END, NULL
    FROM orders0""", "orders0", "prices", "users0"))
def order_job(spark, folder):
    orders = orders0(spark, folder).withColumn("request_id", F.col("order_id"))
    numbered = [orders.withColumn("seq", F.col("seq") * 10 + i) for i in range(3)]
    lost = numbered[0].where("seq % 100 = 0").withColumn("order_id", F.concat("order_id", F.lit("x")))
    out = served(spark, folder, v.ORDER, [
        web(numbered[0], "order_in", "orders/find", order_id="order_id"),
        web(lost.withColumn("request_id", F.col("order_id")), "order_in", "orders/remove", order_id="order_id"),
        web(numbered[1], "order_in", "orders/removeItem", order_id="order_id", item_id=F.lit("7")),
        web(numbered[2], "order_in", "orders/remove", order_id="order_id")],
        {v.ORDER: order_snapshot(spark, folder)})
    found = F.col("input.route") == "orders/find"
    counts = F.from_json(field("result.params", "products"), "map<string,bigint>")
    price = F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(F.col("input.request_id").alias("order_id"), F.col("input.route").alias("asked"), "topic",
                      F.col("result.result").alias("result"), F.col("result.message").alias("message"),
                      F.when(found, price).alias("price"))


@query("stock_job", sql(f"""
    SELECT order_id, item_id, 'orders/addItem' asked, 'order_in' topic,
           CASE WHEN {ITEM_THERE} THEN 'item-exists' ELSE 'no-item' END state, NULL message FROM lines0
    UNION ALL SELECT order_id, item_id, 'stock/subtract', 'user_out_api1', NULL,
           CASE WHEN NOT {ITEM_THERE} THEN '{NOT_FOUND.format('stock_item')}'
                WHEN ok THEN 'Items removed.' ELSE 'Managed Exception: Not enough items in stock.' END
    FROM item_fold""", "item_fold", "items0", "lines0"))
def stock_job(spark, folder):
    """Every order line asks for its item and then takes it from stock."""
    lines = lines0(spark, folder).join(orders0(spark, folder).select("order_id", "ts", "seq"), "order_id").withColumn(
        "request_id", F.concat("order_id", F.lit("/"), "item_id"))
    stock = items0(spark, folder).where("item_exists").select(F.col("item_id").alias("key"), "amount")
    out = served(spark, folder, v.STOCK, [
        web(lines, "stock_in", "orders/addItem", order_id="order_id", item_id="item_id"),
        web(lines, "stock_in", "stock/subtract", item_id="item_id", amount=F.col("qty").cast("string"))],
        {v.STOCK: stock})
    ids = F.split("input.request_id", "/")
    return out.select(ids[0].alias("order_id"), ids[1].alias("item_id"), F.col("input.route").alias("asked"), "topic",
                      "state.state", F.col("result.message").alias("message"))


def batch_message(products, user_id):
    """A stock request of a checkout as the order service sends it."""
    body = json_object(products=products, order_id=quoted("order_id"), user_id=user_id, return_state=quoted(F.lit("send-stock")))
    nameless = json_object(products=products, order_id=quoted("order_id"), return_state=quoted(F.lit("send-stock")))
    params = F.when(F.col("nameless"), nameless).otherwise(body)
    return json_object(
        input=json_object(request_id=quoted("order_id"), consumer=quoted(F.lit("order_in")), route=quoted(F.lit("orders/checkout")),
                          params=F.lit("{}")),
        params=params, state=json_object(route=quoted(F.lit("batch/subtract")), sender=quoted(F.lit("order")),
                                         state=quoted(F.lit("batch:subtract"))))


@query("job_quarantine", sql(f"""
    SELECT seq * 2 + 1 seq, CASE WHEN route = 'users/unknown' THEN 'quarantine' ELSE 'answers' END sink,
           CASE WHEN route = 'users/unknown' THEN 'Unknown message format.' END reason,
           CASE WHEN route = 'users/unknown' THEN md5(value) END record, CAST(1 AS BIGINT) n FROM msg
    UNION ALL SELECT seq * 2, CASE WHEN checkout_status = 3 OR n_items IS NULL THEN 'quarantine' ELSE 'bus' END,
           CASE WHEN checkout_status = 3 THEN 'User ID is expected to exist.'
                WHEN n_items IS NULL THEN 'A batch needs at least one product.' END, NULL,
           CASE WHEN checkout_status = 3 THEN 1 ELSE coalesce(n_items, 1) END
    FROM orders0 LEFT JOIN prices USING (order_id)""", "msg", "orders0", "prices"))
def job_quarantine(spark, folder):
    """Every event and every order's stock request through the stock job: answered, passed on by item, or kept aside with a reason."""
    orders = orders0(spark, folder).join(listed_products(spark, folder), "order_id", "left").withColumn(
        "nameless", F.col("checkout_status") == v.FAILED)
    batches = orders.select(F.lit("stock_in").alias("topic"), batch_message(F.coalesce("products", F.lit("{}")), quoted("user_id")).alias("value"),
                            F.col("ts").cast("timestamp").alias("ts"), (F.col("seq") * 2).alias("seq"))
    events = msg(spark, folder).select(F.lit("stock_in").alias("topic"), "value", F.col("ts").cast("timestamp").alias("ts"),
                                       (F.col("seq") * 2 + 1).alias("seq"))
    bus = fresh_path(spark, "quarantine-bus")
    buses.make_folders(spark, bus)
    for records in (batches, events):
        buses.send(records, bus)
    stock = items0(spark, folder).where("item_exists").select(F.col("item_id").alias("key"), "amount")
    replay.replay(spark, bus, {v.STOCK: stock}, only=[v.STOCK])
    out = spark.read.schema(buses.RECORD).parquet(f"{bus}/{v.STOCK}")
    kept = F.col("topic") == buses.QUARANTINE_TOPIC
    sink = F.when(kept, "quarantine").when(F.col("topic") == v.DEFAULT_OUT_TOPIC, "answers").otherwise("bus")
    record = F.when(kept & (F.col("seq") % 2 == 1), F.md5(F.get_json_object("value", "$.record").cast("binary")))
    return out.groupBy("seq", sink.alias("sink"), F.when(kept, F.get_json_object("value", "$.reason")).alias("reason"),
                       record.alias("record")).agg(F.count("*").alias("n"))


# service, state token and sender of a checkout message, and what it is told
DISPATCH = [(v.PAYMENT, "send-payment", "order", None), (v.PAYMENT, "send-payment", "stock", v.UNKNOWN_SENDER),
            (v.PAYMENT, "replenish-payment", "web", v.UNKNOWN_SENDER), (v.PAYMENT, "nonsense", "order", v.unknown_state("nonsense")),
            (v.PAYMENT, None, "order", v.unknown_state(None)), (v.USER, None, "payment", v.NO_STATE),
            (v.USER, "nonsense", "payment", v.unknown_state("nonsense")), (v.USER, "replenish-payment", "payment", None),
            (v.ORDER, "nonsense", "stock", v.unknown_state("nonsense")), (v.ORDER, "send-stock", "stock", None)]


@query("dispatch_reasons", sql("SELECT order_id, c.i, c.reason FROM orders0, (VALUES " + ", ".join(
    f"({i}::BIGINT, {'NULL' if text is None else repr(text)})" for i, (*_, text) in enumerate(DISPATCH)) + ") c(i, reason)", "orders0"))
def dispatch_reasons(spark, folder):
    """Checkout messages of every order under right and wrong states and senders, as the jobs judge them."""
    out = None
    for i, (service, token, sender, _) in enumerate(DISPATCH):
        body = json_object(order_id=quoted("order_id"), user_id=quoted("user_id"))
        value = json_object(
            input=json_object(request_id=quoted("order_id"), consumer=quoted(F.lit("order_in")), route=quoted(F.lit("orders/checkout")),
                              params=F.lit("{}")), params=body,
            state=json_object(route=quoted(F.lit("orders/checkout")), sender=quoted(F.lit(sender)), state=quoted(F.lit(token).cast("string"))))
        records = orders0(spark, folder).select(value.alias("value"), F.col("ts").cast("timestamp").alias("ts"), "seq")
        judged = jobs.keyed_messages(records, service).select("order_id", F.lit(i).cast("bigint").alias("i"), F.col("text").alias("reason"))
        out = judged if out is None else out.unionByName(judged)
    return out


# -- several services on one bus ---------------------------------------------------------------

@query("payment_job", sql("SELECT order_id, result, message FROM paid",
                          "orders0", "prices", "users0", asked=ASKED, **PAY_FOLD))
def payment_job(spark, folder):
    """A payment for every order: payment asks order, then user, then answers."""
    bus = fresh_path(spark, "payments")
    buses.make_folders(spark, bus)
    asked = pay_requests(spark, folder).withColumns({
        "request_id": F.col("order_id"), "ts": F.timestamp_micros("t")})
    buses.send(web(asked, "payment_in", "payment/pay", order_id="order_id"), bus)
    replay.replay(spark, bus, {v.USER: user_snapshot(existing_users(spark, folder)),
                               v.ORDER: order_snapshot(spark, folder)}, only=[v.USER, v.PAYMENT, v.ORDER])
    return replay.responses(spark, bus, [v.PAYMENT]).select(
        F.col("request_id").alias("order_id"), "result", "message")


@query("bus_replay", sql("""
    SELECT order_id, CASE WHEN is_paid THEN 'success' ELSE 'failure' END result,
           CASE WHEN is_paid THEN 'Order successfully purchased.' ELSE 'Order checkout failed.' END message,
           CASE WHEN is_paid THEN 0 ELSE failed_items + CASE WHEN payment_ok THEN 0 ELSE 1 END END n_log FROM saga
    UNION ALL SELECT order_id, 'error', 'Managed Exception: Cannot checkout an order with no items.', NULL
    FROM orders0 WHERE order_id NOT IN (SELECT order_id FROM lines0)""", "saga", "orders0", "lines0"))
def bus_replay(spark, folder):
    """Checkout of every order through all five jobs; the same as the set-based plan."""
    bus = checked_out(spark, folder)
    log = F.size(F.from_json(field("params", "log"), "array<string>"))
    return replay.responses(spark, bus, [v.ORDER]).select(
        F.col("request_id").alias("order_id"), "result", "message",
        F.when(F.col("result") == "failure", log).when(F.col("result") == "success", 0).cast("bigint").alias("n_log"))


def checked_out(spark, folder):
    """A bus on which every order has been checked out."""
    bus = fresh_path(spark, "checkouts")
    buses.make_folders(spark, bus)
    asked = orders0(spark, folder).withColumn("request_id", F.col("order_id"))
    buses.send(web(asked, "order_in", "orders/checkout", order_id="order_id"), bus)
    replay.replay(spark, bus, {
        v.USER: user_snapshot(users0(spark, folder)),
        v.STOCK: items0(spark, folder).select(F.col("item_id").alias("key"), "amount"),
        v.ORDER: order_snapshot(spark, folder, paid=False, status=False, checked=False)})
    return bus


def stored_state(spark, bus, service, columns):
    """The states of a job as its checkpoint holds them: key and the columns of a state."""
    state = spark.read.format("statestore").option("stateVarName", processors.STATE).load(f"{bus}/checkpoints/{service}")
    entries = state.select(F.explode(F.arrays_zip("value.ids", "value.states")).alias("e"))
    return entries.select(F.col("e.ids").alias("key"), F.from_json("e.states", columns).alias("s")).select("key", "s.*")


@query("replayed_state", sql("""
    SELECT 'user' entity, user_id AS id, credits - coalesce(spent, 0) held, NULL::BIGINT status
    FROM users0 LEFT JOIN (SELECT user_id, CAST(sum(price) AS BIGINT) spent FROM saga WHERE is_paid GROUP BY 1) USING (user_id)
    UNION ALL SELECT 'item', item_id, amount - coalesce(sold, 0), NULL
    FROM items0 LEFT JOIN (SELECT item_id, CAST(sum(qty) AS BIGINT) sold FROM item_fold JOIN saga USING (order_id)
                           WHERE is_paid GROUP BY 1) USING (item_id)
    UNION ALL SELECT 'order', order_id, CASE WHEN s.is_paid THEN 1 ELSE 0 END, coalesce(s.checkout_status, 3)
    FROM orders0 LEFT JOIN saga s USING (order_id)
    UNION ALL SELECT 'payment', order_id, price, CASE WHEN s.is_paid THEN 1 WHEN payment_ok THEN 3 ELSE 2 END FROM saga s""",
    "saga", "orders0", "users0", "items0", "item_fold"))
def replayed_state(spark, folder):
    """What the jobs hold after the checkout of every order, read from their checkpoints: the same as the set-based plan's ledger."""
    bus = checked_out(spark, folder)
    none = F.lit(None).cast("bigint")
    users = stored_state(spark, bus, v.USER, "credits bigint").select(
        F.lit("user").alias("entity"), F.col("key").alias("id"), F.col("credits").alias("held"), none.alias("status"))
    items = stored_state(spark, bus, v.STOCK, "amount bigint").select(
        F.lit("item").alias("entity"), F.col("key").alias("id"), F.col("amount").alias("held"), none.alias("status"))
    orders = stored_state(spark, bus, v.ORDER, "is_paid boolean, checkout_status bigint").select(
        F.lit("order").alias("entity"), F.col("key").alias("id"), F.col("is_paid").cast("bigint").alias("held"),
        F.col("checkout_status").alias("status"))
    payments = stored_state(spark, bus, v.PAYMENT, "status bigint, price bigint").select(
        F.lit("payment").alias("entity"), F.col("key").alias("id"), F.col("price").alias("held"), "status")
    return users.unionByName(items).unionByName(orders).unionByName(payments)


# -- fan-in, correlation, rates, late rows ---------------------------------------------------

@query("fan_in_stream", sql("""
    SELECT batch_id, seen >= batch_count complete, seen FROM seen""",
    "prices", "orders0", batch_items=BATCH_ITEMS, seen=SEEN))
def fan_in_stream(spark, folder):
    """Answers of item batches as a stream, each sent twice; incomplete batches are given up by the timer."""
    items = batch_items(spark, folder).select(
        "batch_id", "batch_count", "item_id", "passed", F.lit("{}").alias("value"),
        F.timestamp_micros("t").alias("ts"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("seq"))
    folder_in = fresh_path(spark, "fan-in")
    items.write.parquet(folder_in)
    # one record far in the future moves the watermark past every timer
    far = spark.read.schema(items.schema).parquet(folder_in).limit(1).withColumns({
        "batch_id": F.lit("sentinel"), "batch_count": F.lit(2).cast("bigint"), "ts": F.to_timestamp(F.lit(FAR))})
    far.write.mode("append").parquet(folder_in)
    stream = jobs.fan_in(spark.readStream.schema(items.schema).parquet(folder_in), watermark="0 seconds", shared=True)
    done = drained(spark, stream, stream.schema, "fan-in-out")
    return done.where("batch_id <> 'sentinel'").select("batch_id", "complete", "seen")


@query("route_throughput_stream", sql("""
    SELECT route, epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) window_start, count(*) n FROM cmd GROUP BY 1, 2""", "cmd"))
def route_throughput_stream(spark, folder):
    commands = as_commands(table_stream(spark, folder, "events"))
    counts = analytics.throughput_stream(commands, "10 minutes", "1 hour")
    return analytics.completed(spark, counts, fresh_path(spark, "throughput")).select(
        "route", micros(F.col("window_start")).alias("window_start"), "n")


@query("correlate_stream", sql("""
    SELECT request_id, epoch_us(request_ts) request_at, epoch_us(min(response_ts)) response_at,
           CASE WHEN min(response_ts) IS NULL THEN 'timed out' ELSE 'answered' END outcome
    FROM req LEFT JOIN (SELECT request_id, response_ts FROM resp) r USING (request_id)
    WHERE true GROUP BY request_id, request_ts""",
    req="SELECT CAST(o_orderkey AS VARCHAR) request_id, o_orderdate request_ts FROM orders",
    resp=f"""SELECT CAST(l_orderkey AS VARCHAR) request_id, l_shipdate response_ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey
             WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL {ANSWER_DAYS} DAY"""))
def correlate_stream(spark, folder):
    """Every order's first shipment within the timeout as the answer to it, by timers in keyed state."""
    requests = table_stream(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("request_ts"))
    answers = table_stream(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("response_ts"))
    # one record far in the future moves the watermark past every deadline
    far = fresh_path(spark, "far")
    spark.range(1).select(F.lit("sentinel").alias("request_id"), F.to_timestamp(F.lit(FAR)).alias("request_ts")).write.parquet(far)
    requests = requests.unionByName(spark.readStream.schema("request_id string, request_ts timestamp").parquet(far))
    rows = analytics.first_answers(requests, answers, ANSWER_DAYS * 86_400, f"{ANSWER_DAYS} days")
    found = drained(spark, rows, rows.schema, "correlate")
    return found.select("request_id", micros(F.col("request_ts")).alias("request_at"), micros(F.col("response_ts")).alias("response_at"),
                        F.when(F.col("response_ts").isNull(), "timed out").otherwise("answered").alias("outcome"))


@query("user_sessions_stream", SESSIONS)
def user_sessions_stream(spark, folder):
    """The same sessions as a stream, each given out once the watermark has passed its end."""
    commands = as_commands(table_stream(spark, folder, "events")).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    far = fresh_path(spark, "far")
    spark.range(1).select(F.lit("sentinel").alias("user_id"), F.to_timestamp(F.lit(FAR)).alias("ts")).write.parquet(far)
    commands = commands.unionByName(spark.readStream.schema("user_id string, ts timestamp").parquet(far)).withWatermark("ts", "1 hour")
    found = correlate.sessions(commands, "user_id", SESSION_GAP)
    done = drained(spark, found, found.schema, "sessions")
    return done.where("user_id <> 'sentinel'").select(
        "user_id", micros(F.col("first")).alias("first_at"), micros(F.col("last")).alias("last_at"), "n")


@query("dedup_requests_stream", sql("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) request_id FROM lineitem"))
def dedup_requests_stream(spark, folder):
    sent = table_stream(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    first = analytics.dedup_stream(sent, "ts", "3650 days")
    return drained(spark, first, first.schema, "dedup").select("request_id")


@query("late_rows", sql("""
    SELECT (SELECT count(*) FROM events) n_rows, count(*) n_late FROM events
    WHERE event_id < (SELECT count(*) FROM events) // 2"""))
def late_rows(spark, folder):
    """The newer half of the events arrives first, so the older half is late."""
    commands = cmd(spark, folder).select("seq", F.col("ts").cast("timestamp").alias("ts"))
    n = commands.count()
    path = fresh_path(spark, "late")
    late = 0
    for part in (F.col("seq") >= n // 2, F.col("seq") < n // 2):
        commands.where(part).write.mode("append").parquet(f"{path}/in")
        stream = (spark.readStream.schema(commands.schema).parquet(f"{path}/in")
                  .withWatermark("ts", "0 seconds").dropDuplicates(["seq", "ts"]))
        late += analytics.late_rows(spark, stream.writeStream.format("parquet").option("path", f"{path}/out")
                                    .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True))
    return spark.read.schema(commands.schema).parquet(f"{path}/out").agg(
        (F.count("*") + F.lit(late)).alias("n_rows"), F.lit(late).cast("bigint").alias("n_late"))


# -- checkout timeouts and repeated checkouts ----------------------------------------------------

@query("checkout_timeout", sql("""
    SELECT order_id, CASE WHEN price IS NULL THEN 'error' ELSE 'failure' END result,
           CASE WHEN price IS NULL THEN 'Managed Exception: Cannot checkout an order with no items.'
                ELSE 'Order checkout failed.' END message
    FROM orders0 LEFT JOIN prices USING (order_id)""", "orders0", "prices"))
def checkout_timeout(spark, folder):
    """No service answers the order job, so every checkout runs into its timer."""
    bus = fresh_path(spark, "timeouts")
    buses.make_folders(spark, bus)
    asked = orders0(spark, folder).withColumn("request_id", F.col("order_id"))
    # a record far in the future moves the watermark past every timer
    far = asked.limit(1).withColumns({"request_id": F.lit("sentinel"), "ts": F.to_timestamp(F.lit(FAR))})
    snapshot = {v.ORDER: order_snapshot(spark, folder, paid=False, status=False, checked=False)}
    for records in (web(asked, "order_in", "orders/checkout", order_id="order_id"),
                    web(far, "order_in", "orders/find", order_id=F.lit("none"))):
        buses.send(records, bus)
        replay.replay(spark, bus, snapshot, watermark="0 seconds", only=[v.ORDER])
    return (replay.responses(spark, bus, [v.ORDER]).where("request_id <> 'sentinel'")
            .select(F.col("request_id").alias("order_id"), "result", "message"))


@query("checkout_retry", sql(f"""
    SELECT order_id, CASE WHEN reason = 'Order checkout failed.' THEN 'failure' ELSE 'error' END result,
           CASE WHEN reason = 'Order checkout failed.' THEN reason ELSE 'Managed Exception: ' || reason END message,
           CASE WHEN reason = 'Order checkout failed.' THEN CAST(0 AS BIGINT) END n_log
    FROM (SELECT order_id, CASE WHEN is_paid THEN 'Order has already been paid.'
        WHEN NOT {USER_THERE} THEN 'Cannot checkout order.'
        WHEN checkout_status = 2 THEN 'Order already concluded.' WHEN checkout_status = 3 THEN 'Order checkout failed.'
        WHEN price IS NULL THEN 'Cannot checkout an order with no items.' END reason
        FROM orders0 LEFT JOIN prices USING (order_id)) WHERE reason IS NOT NULL""", "orders0", "users0", "prices"))
def checkout_retry(spark, folder):
    """Checkout of every order in the state it is in; a failed one fails again and moves nothing."""
    asked = orders0(spark, folder).withColumn("request_id", F.col("order_id"))
    out = served(spark, folder, v.ORDER, [web(asked, "order_in", "orders/checkout", order_id="order_id")],
                 {v.ORDER: order_snapshot(spark, folder)}).where(F.col("topic") == v.DEFAULT_OUT_TOPIC)
    failed = F.col("result.result") == "failure"
    log = F.size(F.from_json(field("result.params", "log"), "array<string>")).cast("bigint")
    return out.select(F.col("input.request_id").alias("order_id"), F.col("result.result").alias("result"),
                      F.col("result.message").alias("message"), F.when(failed, log).alias("n_log"))
