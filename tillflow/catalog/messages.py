"""Scanning, parsing, building and routing of message envelopes."""

from pyspark.sql import functions as F

from tillflow import vocabulary as v
from tillflow.catalog import query
from tillflow.catalog.views import sql
from tillflow.functions import envelope as env
from tillflow.functions.codes import name_of
from tillflow.functions.jsontext import coerce_long, field, json_object, merge_json, quoted, raw, text_or
from tillflow.operators import guards, routing
from tillflow.sources.fixtures import cmd, items0, msg, orders0, request_params
from tillflow.sources.tables import table



def null():
    return F.lit(None).cast("string")


def readable(spark, folder):
    """Parsed messages with their key set, unreadable ones left out."""
    return env.keyed(env.parse_envelope(msg(spark, folder)).where(env.is_message()), "user_id")


# -- sources ----------------------------------------------------------------------

def bus(spark, folder):
    """All requests of all services with the topic each was sent to."""
    def sent(df, topic, route, **params):
        topic, route = F.lit(topic), F.lit(route)
        body = json_object(**{k: quoted(c) for k, c in params.items()})
        return df.select(topic.alias("topic"), F.col("id").alias("request_id"),
                         env.make_envelope(F.col("id"), topic, route, body).alias("value"))
    orders = orders0(spark, folder).withColumn("id", F.col("order_id"))
    items = items0(spark, folder).withColumn("id", F.col("item_id"))
    users = cmd(spark, folder).withColumn("id", F.col("request_id"))
    return (sent(users, "user_in", "users/find", user_id="user_id")
            .unionByName(sent(orders, "order_in", "orders/find", order_id="order_id"))
            .unionByName(sent(items, "stock_in", "stock/availability", item_id="item_id"))
            .unionByName(sent(orders, "payment_in", "payment/status", order_id="order_id")))


@query("scan_by_topic", sql("""
    SELECT order_id request_id, 'order_in' consumer, 'orders/find' route, order_id FROM orders0""", "orders0"))
def scan_by_topic(spark, folder):
    mine = bus(spark, folder).where(F.col("topic") == v.IN_TOPIC[v.ORDER])
    return env.parse_envelope(mine.drop("request_id")).select(
        "input.request_id", "input.consumer", "input.route", field("params", "order_id").alias("order_id"))


def responses(spark, folder):
    """Answers to commands, spread over the response topics and one other topic."""
    names = F.array(*[F.lit(t) for t in [*v.RESPONSE_TOPICS, "user_in"]])
    commands = cmd(spark, folder)
    ok = F.col("route") != "users/unknown"
    body = json_object(
        input=json_object(request_id=quoted("request_id")),
        result=json_object(result=quoted(F.when(ok, "success").otherwise("error")),
                           params=json_object(user_id=quoted("user_id"))))
    text = F.when(F.col("seq") % 7 == 0, F.substring(body, 1, 30)).otherwise(body)
    return commands.select("seq", "request_id", F.element_at(names, (F.col("seq") % 5 + 1).cast("int")).alias("topic"),
                           text.alias("value"))


RESPONSES = """SELECT seq, request_id, user_id,
    ['user_out_api1', 'orders_out_api1', 'stock_out_api1', 'payment_out_api1', 'user_in'][seq % 5 + 1] topic,
    CASE WHEN route <> 'users/unknown' THEN 'success' ELSE 'error' END result, seq % 7 <> 0 whole FROM cmd"""


@query("scan_responses", sql("""
    SELECT topic, request_id, result FROM responses WHERE whole AND seq % 5 <> 4""", "cmd", responses=RESPONSES))
def scan_responses(spark, folder):
    answers = responses(spark, folder).where(F.col("topic").isin(v.RESPONSE_TOPICS)).select("topic", "value")
    return (env.parse_envelope(answers).where(env.is_message())
            .select("topic", "input.request_id", "result.result"))


@query("drop_malformed", sql("SELECT request_id, route FROM cmd WHERE route <> 'users/unknown'", "cmd"))
def drop_malformed(spark, folder):
    kept, _ = env.split_malformed(msg(spark, folder))
    return kept.select("input.request_id", "input.route")


@query("make_envelope", sql("""
    SELECT seq, '{"input":{"request_id":"' || order_id || '","consumer":"order_in","route":"orders/checkout","params":{"order_id":"'
        || order_id || '"}},"params":{"order_id":"' || order_id
        || '"},"state":{"route":"orders/checkout","sender":"web","state":null}}' AS value FROM orders0""", "orders0"))
def make_envelope(spark, folder):
    return orders0(spark, folder).select("seq", env.make_envelope(
        F.col("order_id"), F.lit("order_in"), F.lit("orders/checkout"),
        json_object(order_id=quoted("order_id"))).alias("value"))


CATALOGUE = "VALUES " + ", ".join(
    f"('{route}', '{service}', '{v.IN_TOPIC[service]}', '{'/'.join(['', route, *('{' + n + '}' for n in names)])}')"
    for route, service, names in v.ROUTES)


@query("route_catalogue", sql("""
    SELECT route, service, topic, template, coalesce(n, 0) n_requests
    FROM (SELECT col0 route, col1 service, col2 topic, col3 template FROM catalogue)
    LEFT JOIN (SELECT route, count(*) n FROM cmd GROUP BY 1) USING (route)""", "cmd", catalogue=CATALOGUE))
def route_catalogue(spark, folder):
    used = cmd(spark, folder).groupBy("route").agg(F.count("*").alias("n"))
    return routing.route_catalogue(spark).join(used, "route", "left").select(
        "route", "service", "topic", "template", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_requests"))


def url_log(spark, folder):
    """Request paths of the commands, and the page addresses of another site."""
    commands = cmd(spark, folder).select(F.concat(
        F.lit("/"), "route", F.lit("/"), "user_id",
        F.when(F.col("route").like("users/credit/%"), F.concat(F.lit("/"), F.col("amount").cast("string")))
         .otherwise("")).alias("url"))
    orders = orders0(spark, folder).select(F.concat(F.lit("https://shop.example/orders/checkout/"), "order_id",
                                                    F.lit("?ref=1")).alias("url"))
    return commands.unionByName(orders).unionByName(table(spark, folder, "pages").select("url"))


@query("match_route", sql("""
    SELECT '/' || route || '/' || user_id || CASE WHEN route LIKE 'users/credit/%' THEN '/' || amount ELSE '' END url,
           CASE WHEN route <> 'users/unknown' THEN route END matched,
           CASE WHEN route <> 'users/unknown' THEN params END params FROM req_params
    UNION ALL SELECT 'https://shop.example/orders/checkout/' || order_id || '?ref=1', 'orders/checkout',
           '{"order_id":"' || order_id || '"}' FROM orders0
    UNION ALL SELECT url, NULL, NULL FROM pages""", "req_params", "orders0"))
def match_route(spark, folder):
    return routing.match_route(url_log(spark, folder), "url").select("url", "matched", "params")


# -- sinks ------------------------------------------------------------------------

def outputs(spark, folder):
    """Handler results: some for another service, some for the default topic."""
    to = (F.when(F.col("route") == "users/credit/add", F.lit("order_in"))
           .when(F.col("route") == "users/credit/subtract", F.lit("stock_in")))
    return cmd(spark, folder).withColumn("topic", to)


OUTPUTS = """SELECT *, CASE route WHEN 'users/credit/add' THEN 'order_in'
                       WHEN 'users/credit/subtract' THEN 'stock_in' END topic FROM cmd"""


@query("route_to_topic", sql("""
    SELECT request_id, coalesce(topic, 'user_out_api1') topic FROM outputs""", "cmd", outputs=OUTPUTS))
def route_to_topic(spark, folder):
    return outputs(spark, folder).select("request_id", routing.target_topic(F.col("topic")).alias("topic"))


@query("filter_topic", sql("""
    SELECT request_id, coalesce(topic = 'stock_in', false) to_batch, coalesce(topic <> 'stock_in', true) to_sink
    FROM outputs""", "cmd", outputs=OUTPUTS))
def filter_topic(spark, folder):
    topic = F.col("topic")
    return outputs(spark, folder).select(
        "request_id",
        routing.topic_filter(topic, "stock_in", True, False).alias("to_batch"),
        routing.topic_filter(topic, "stock_in", False, True).alias("to_sink"))


# -- envelopes ----------------------------------------------------------------------

@query("parse_envelope", sql("""
    SELECT seq, request_id, 'user_in' consumer, route, 'web' sender, CAST(NULL AS VARCHAR) state, user_id,
           CASE WHEN params LIKE '%amount%' THEN CAST(amount AS VARCHAR) END amount, CAST(0 AS BIGINT) n_path
    FROM req_params WHERE route <> 'users/unknown'
    UNION ALL SELECT seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM req_params WHERE route = 'users/unknown'
    """, "req_params"))
def parse_envelope(spark, folder):
    return env.parse_envelope(msg(spark, folder)).select(
        "seq", "input.request_id", "input.consumer", "input.route", "state.sender", "state.state",
        field("params", "user_id").alias("user_id"), field("params", "amount").alias("amount"),
        F.size("path").cast("bigint").alias("n_path"))


@query("quarantine", sql("""
    SELECT seq, value raw, 'Unknown message format.' reason FROM msg WHERE route = 'users/unknown'""", "msg"))
def quarantine(spark, folder):
    _, bad = env.split_malformed(msg(spark, folder))
    return bad.select("seq", "raw", "reason")


GOOD = "SELECT * FROM req_params WHERE route <> 'users/unknown'"
INPUT = """'{"input":{"request_id":"' || request_id || '","consumer":"user_in","route":"' || route
           || '","params":' || params || '}'"""
STEP = """'{"consumer":"user","route":"' || route || '","state":null,"state_id":"' || user_id
          || '","params":' || params || '}'"""


@query("serialize_envelope", sql(f"""
    SELECT seq, {INPUT} || ',"state":{{"route":"' || route || '","sender":"web","state":null,"state_id":null}},"params":'
           || params || ',"path":[],"result":{{}}}}' AS value FROM good
    UNION ALL SELECT seq, '{{"input":{{}},"state":{{}},"params":null,"path":[],"result":{{}}}}' FROM req_params
    WHERE route = 'users/unknown'""", "req_params", good=GOOD))
def serialize_envelope(spark, folder):
    return env.parse_envelope(msg(spark, folder)).select("seq", env.serialize_envelope().alias("value"))


@query("redirect", sql(f"""
    SELECT seq, {INPUT} || ',"state":{{"route":"orders/remove","sender":"user","state":"user-order-removed","state_id":null}},"params":{{"order_id":"'
           || seq || '"}},"path":[' || {STEP} || '],"result":{{}}}}' AS value FROM good""", "req_params", good=GOOD))
def redirect(spark, folder):
    sent = env.redirect(readable(spark, folder), v.USER, F.lit("orders/remove"), F.lit("user-order-removed"),
                        json_object(order_id=quoted(F.col("seq").cast("string"))))
    return sent.select("seq", env.serialize_envelope().alias("value"))


def result_sql(result, message, params):
    return f"""SELECT seq, {INPUT} || ',"state":{{"route":"web","sender":"user","state":null,"state_id":null}},"params":null,"path":['
        || {STEP} || '],"result":{{"result":"' || {result} || '","message":' || {message}
        || ',"params":' || {params} || '}}}}' AS value FROM good"""


@query("make_result", sql(result_sql(
    "'success'", "'null'", """'{"user_id":"' || user_id || '","balance":' || seq || '}'"""), "req_params", good=GOOD))
def make_result(spark, folder):
    body = json_object(user_id=quoted(field("params", "user_id")), balance=raw("seq"))
    answered = env.reply(readable(spark, folder), v.USER, F.lit("success"), null(), body)
    return answered.select("seq", env.serialize_envelope().alias("value"))


ERROR_TEXT = "\"Managed Exception: Entry 'user' with the given ID does not exist.\""


@query("error_result", sql(result_sql(
    "'error'", "'" + ERROR_TEXT.replace("'", "''") + "'",
    """'{"type":"EntryNotFound","info":"user ' || user_id || '"}'"""), "req_params", good=GOOD))
def error_result(spark, folder):
    text = F.lit(v.MANAGED + v.not_found(v.ENTITY[v.USER]))
    details = json_object(type=quoted(F.lit("EntryNotFound")),
                          info=quoted(F.concat(F.lit("user "), field("params", "user_id"))))
    failed = env.reply(readable(spark, folder), v.USER, F.lit("error"), text, details)
    return failed.select("seq", env.serialize_envelope().alias("value"))


@query("emit_outputs", sql("""
    SELECT seq, CASE WHEN route = 'users/credit/add' THEN 'order_in' END topic,
           CASE WHEN route = 'users/credit/add' THEN 'orders/create' ELSE 'web' END route,
           CASE WHEN route = 'users/credit/add' THEN 'user-order-added' END state,
           CASE route WHEN 'users/credit/add' THEN NULL WHEN 'users/credit/subtract' THEN 'failure' ELSE 'success' END result,
           CASE WHEN route = 'users/credit/add' THEN params END params, CAST(1 AS BIGINT) n_path
    FROM good""", "req_params", good=GOOD))
def emit_outputs(spark, folder):
    asked = F.col("input.route")
    rows = readable(spark, folder).withColumns({
        "kind": F.when(asked == "users/credit/add", "redirect")
                 .when(asked == "users/credit/subtract", "failure").otherwise("success"),
        "topic": F.when(asked == "users/credit/add", F.lit(v.IN_TOPIC[v.ORDER]))})
    sent = env.emit(rows, F.lit(v.USER), F.col("kind"), F.lit("orders/create"), F.lit("user-order-added"),
                    F.col("params"), null())
    return sent.select("seq", "topic", "state.route", "state.state", "result.result", "params",
                       F.size("path").cast("bigint").alias("n_path"))


@query("scrub_response", sql("""
    SELECT seq, true no_input, true no_path, true no_state, 'success' result, params FROM good""",
    "req_params", good=GOOD))
def scrub_response(spark, folder):
    answered = env.reply(readable(spark, folder), v.USER, F.lit("success"), null(), F.col("params"))
    return env.scrub_response(answered).select(
        "seq", F.col("input").isNull().alias("no_input"), F.col("path").isNull().alias("no_path"),
        F.col("state").isNull().alias("no_state"), "result.result", "result.params")


@query("extract_key", sql("""
    SELECT seq, user_id, sha256(request_id || ':order_id') order_id FROM good""", "req_params", good=GOOD))
def extract_key(spark, folder):
    return readable(spark, folder).select(
        "seq", F.col("state.state_id").alias("user_id"), env.extract_key("order_id").alias("order_id"))


@query("require_key", sql("""
    SELECT seq, CAST(amount AS VARCHAR) state_id FROM good WHERE params LIKE '%amount%'""", "req_params", good=GOOD))
def require_key(spark, folder):
    rows = readable(spark, folder).withColumn(
        "state", F.col("state").withField("state_id", field("params", "amount")))
    return env.require_key(rows).select("seq", "state.state_id")


@query("text_default", sql("""
    SELECT seq, CASE seq % 3 WHEN 0 THEN 'Not enough credits.' ELSE 'Insufficient funds.' END message FROM cmd""", "cmd"))
def text_default(spark, folder):
    params = (F.when(F.col("seq") % 3 == 0, json_object(message=quoted(F.lit(v.NO_CREDITS))))
               .when(F.col("seq") % 3 == 1, json_object(message=F.lit("null"))).otherwise("{}"))
    return cmd(spark, folder).select("seq", text_or(params, "message", "Insufficient funds.").alias("message"))


@query("merge_params", sql("""
    SELECT seq, CASE WHEN params LIKE '%amount%' THEN '{"user_id":"u' || user_id || '","amount":"' || amount || '","price":' || amount || '}'
                     ELSE '{"user_id":"u' || user_id || '","price":' || amount || '}' END params FROM req_params""",
    "req_params"))
def merge_params(spark, folder):
    commands = cmd(spark, folder)
    merged = merge_json(request_params(commands), price=raw("amount"),
                        user_id=quoted(F.concat(F.lit("u"), "user_id")))
    return commands.select("seq", merged.alias("params"))


# -- filters and dispatch -------------------------------------------------------------

def tokens(spark, folder):
    """Commands with a state token: batch, plain, unknown or none."""
    some = F.array(F.lit("batch:subtract"), F.lit("batch:add"), F.lit("send-stock"), F.lit("lost"), null())
    return cmd(spark, folder).withColumn("state", F.element_at(some, (F.col("seq") % 5 + 1).cast("int")))


TOKENS = "SELECT *, ['batch:subtract', 'batch:add', 'send-stock', 'lost', NULL][seq % 5 + 1] state FROM cmd"


@query("split_batch", sql("""
    SELECT seq, coalesce(starts_with(state, 'batch:'), false) is_batch FROM tokens""", "cmd", tokens=TOKENS))
def split_batch(spark, folder):
    return tokens(spark, folder).select("seq", routing.is_batch(F.col("state")).alias("is_batch"))


@query("dispatch_route", sql("""
    SELECT seq, route, CASE WHEN route <> 'users/unknown' THEN 'user' END service,
           CASE WHEN route = 'users/unknown' THEN 'Unrecognised route.' END reason FROM cmd""", "cmd"))
def dispatch_route(spark, folder):
    service = routing.service_of(F.col("route"))
    return cmd(spark, folder).select(
        "seq", "route", service.alias("service"),
        routing.first_reason((service.isNull(), v.UNKNOWN_ROUTE)).alias("reason"))


@query("illegal_route", sql("""
    SELECT route, 'Managed Exception: Unrecognised route.' message, count(*) n FROM cmd
    WHERE route = 'users/unknown' GROUP BY 1""", "cmd"))
def illegal_route(spark, folder):
    return (cmd(spark, folder).where(routing.service_of(F.col("route")).isNull())
            .groupBy("route", F.lit(v.MANAGED + v.UNKNOWN_ROUTE).alias("message")).agg(F.count("*").alias("n")))


@query("illegal_state", sql("""
    SELECT seq, 'Managed Exception: Unrecognised state: ' || coalesce('"' || state || '".', 'null.') message
    FROM tokens WHERE state IS NULL OR state = 'lost'""", "cmd", tokens=TOKENS))
def illegal_state(spark, folder):
    known = F.coalesce(F.col("state").isin("batch:subtract", "batch:add", "send-stock"), F.lit(False))
    return tokens(spark, folder).where(~known).select("seq", F.concat(
        F.lit(v.MANAGED), routing.unknown_state_text(F.col("state"))).alias("message"))


def amount_texts(spark, folder):
    """Amounts as they arrive in a path: numbers, decimals, signs and junk."""
    seq, text = F.col("seq"), F.col("amount").cast("string")
    return cmd(spark, folder).select("seq", F.when(seq % 5 == 0, "abc").when(seq % 7 == 0, F.concat(F.lit("-"), text))
                                     .when(seq % 11 == 0, F.concat(text, F.lit(".9")))
                                     .when(seq % 13 == 0, F.concat(F.lit(" "), text)).otherwise(text).alias("text"))


AMOUNTS = """SELECT seq, CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 7 = 0 THEN -amount ELSE amount END amount,
    CASE WHEN seq % 5 = 0 THEN 'abc' WHEN seq % 7 = 0 THEN '-' || amount WHEN seq % 11 = 0 THEN amount || '.9'
         WHEN seq % 13 = 0 THEN ' ' || amount ELSE CAST(amount AS VARCHAR) END AS text FROM cmd"""


@query("coerce_long", sql("SELECT seq, text, CAST(amount AS BIGINT) amount FROM amounts", "cmd", amounts=AMOUNTS))
def coerce_amount(spark, folder):
    return amount_texts(spark, folder).withColumn("amount", coerce_long("text"))


@query("validate_amount", sql("""
    SELECT seq, CASE WHEN amount <= 0 THEN 'Amount must be positive.' END reason FROM amounts""", "cmd", amounts=AMOUNTS))
def validate_amount(spark, folder):
    return amount_texts(spark, folder).select("seq", guards.amount_reason(coerce_long("text")).alias("reason"))


@query("merge_streams", sql("""
    SELECT seq, state, NULL::BIGINT n_items FROM tokens WHERE NOT coalesce(starts_with(state, 'batch:'), false)
    UNION ALL SELECT seq, state, 2::BIGINT FROM tokens, range(2) WHERE starts_with(state, 'batch:')""",
    "cmd", tokens=TOKENS))
def merge_streams(spark, folder):
    rows = tokens(spark, folder).select("seq", "state")
    batch = routing.is_batch(F.col("state"))
    fanned = (rows.where(batch).withColumn("n_items", F.lit(2).cast("bigint"))
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1)))).drop("copy"))
    return rows.where(~batch).unionByName(fanned, allowMissingColumns=True)


@query("decode_status", sql("""
    SELECT code, CASE code WHEN 0 THEN 'NOT_PROCESSED' WHEN 2 THEN 'SUCCEEDED' WHEN 3 THEN 'FAILED' END checkout_status,
           CASE code WHEN 0 THEN 'INVALID' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'CANCELLED' END payment_status,
           CASE code WHEN 0 THEN 'SUCCESS' WHEN 2 THEN 'ERROR' END operation_result, count(*) n
    FROM (SELECT CAST(checkout_status AS BIGINT) code FROM orders0) GROUP BY 1""", "orders0"))
def decode_status(spark, folder):
    code = F.col("code")
    return (orders0(spark, folder).groupBy(F.col("checkout_status").cast("bigint").alias("code"))
            .agg(F.count("*").alias("n"))
            .select("code", name_of(code, v.CHECKOUT_STATUS).alias("checkout_status"),
                    name_of(code, v.PAYMENT_STATUS).alias("payment_status"),
                    name_of(code, v.OPERATION_RESULT).alias("operation_result"), "n"))
