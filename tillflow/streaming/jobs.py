"""The streaming jobs: one per service, and the fan-in of item batches.

Everything but the state change itself is column work: parsing, key
extraction, finding the rule, building and routing the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow import vocabulary as v
from tillflow.functions import envelope as env
from tillflow.functions.jsontext import coerce_long, field, json_object, merge_objects, quoted, raw
from tillflow.operators.batching import MESSAGE, NO_PRODUCTS, batch_id, unfit_for_fan_out
from tillflow.operators.routing import first_reason, is_batch, unknown_state_text
from tillflow.session import state_stores
from tillflow.sources import bus as buses
from tillflow.streaming import processors as p, rules

PASSED = "map<string, struct<state:int, amount:bigint>>"
# the params that kernels know, and what a kernel sees of a message besides its time and its text
PARAMS = ["user_id", "order_id", "item_id", "amount", "price", "state", "message", "products"]
KERNEL_COLUMNS = ["key", "seq", "rule", "text", "user_id", "order_id", "item_id",
                  "amount", "price", "code", "note", "results"]


UNREADABLE = "Unknown message format."
# the parameter that keys each service; ``entities.register`` adds to it
KEY_PARAM = dict(v.KEY_PARAM)


def parsed_records(records: DataFrame) -> DataFrame:
    """Bus records with their sections and ``reason``, why they cannot be read, if so."""
    parsed = env.parse_envelope(records.withColumn("m_", F.col("value")), "m_")
    known = F.col("reason") if "reason" in records.columns else F.lit(None).cast("string")
    return parsed.withColumn("reason", F.coalesce(known, F.when(~env.is_message(), UNREADABLE)))


def own_key(key: Column) -> Column:
    """The key, and one of its own for a record that no service can read."""
    return F.when(F.col("reason").isNull(), key).otherwise(
        F.concat(F.lit("quarantine:"), F.sha2(F.concat_ws(":", "value", F.col("ts").cast("string"), "seq"), 256)))


def unknown_text(service: str) -> Column:
    """What a message without rule is told, if its route is known."""
    mine = [r for r in rules.RULES if r[0] == service]
    token, sender = F.col("state.state"), F.col("state.sender")
    by_sender = sorted({f"{route}:{t}" for _, route, t, s in mine if s != rules.ANY})
    return first_reason(
        (~F.col("state.route").isin(sorted({route for _, route, _, _ in mine})), F.lit(None).cast("string")),
        (F.concat_ws(":", "state.route", token).isin(by_sender), v.UNKNOWN_SENDER),
        (F.lit(service == v.USER) & token.isNull(), v.NO_STATE),
        (F.lit(True), unknown_state_text(token)))


def keyed_messages(records: DataFrame, service: str) -> DataFrame:
    """Records with their key, their rule and the typed params a kernel needs.

    Records that cannot be read have the rule ``quarantine``, a key of their own
    and the reason as text.
    """
    return matched_messages(parsed_records(records), service)


def matched_messages(parsed: DataFrame, service: str) -> DataFrame:
    """``keyed_messages`` of records that are parsed already."""
    def number(name):
        return F.when(F.col(f"{name}_").isNotNull(), coerce_long(f"{name}_"))

    token, sender = F.col("state.state"), F.col("state.sender")
    matched = parsed.join(
        F.broadcast(rules.rules(parsed.sparkSession, service)),
        (F.col("state.route") == F.col("route_")) & ((F.col("token_") == rules.ANY) | F.col("token_").eqNullSafe(token))
        & ((F.col("sender_") == rules.ANY) | (F.col("sender_") == sender)), "left")
    # one pass over the params for all fields
    read = matched.select("*", F.json_tuple("params", *PARAMS).alias(*[f"{name}_" for name in PARAMS]))
    return read.select(
        own_key(env.extract_key(KEY_PARAM[service])).alias("key"), "ts", "seq",
        F.when(F.col("reason").isNotNull(), p.QUARANTINE).otherwise(F.coalesce("rule", F.lit("unknown"))).alias("rule"),
        F.coalesce("reason", F.when(F.col("rule").isNull(), unknown_text(service))).alias("text"), "value",
        *[F.col(f"{name}_").alias(name) for name in ("user_id", "order_id", "item_id")],
        F.coalesce(number("amount"), F.lit(0).cast("bigint")).alias("amount"), number("price").alias("price"),
        number("state").cast("int").alias("code"), F.col("message_").alias("note"),
        F.map_entries(F.from_json("products_", PASSED)).alias("results"))


def answers(outcomes: DataFrame, service: str) -> DataFrame:
    """Bus records for the outcomes of a stateful operator; what it could not read goes to the quarantine topic."""
    unread = F.col("outcome") == p.QUARANTINE
    found = outcomes.join(F.broadcast(rules.replies(outcomes.sparkSession, service)), ["rule", "outcome"], "left").where(
        F.col("kind").isNotNull() | unread)
    text = F.coalesce("text", "reply_text")
    refused = F.col("kind") == "error"
    rows = env.parse_envelope(found.withColumn("m_", F.col("value")), "m_")
    rows = env.keyed(rows, KEY_PARAM[service])
    asked = F.col("params_from")
    rows = rows.withColumn("new_params", F.when(
        refused, json_object(type=quoted(F.lit("ServiceException")), info=quoted(text)))
        .when(asked == rules.EXTRA, F.col("extra")).when(asked == rules.KEEP, F.col("params"))
        .when(asked == rules.MERGE, merge_objects("params", "extra")))
    sent = env.emit(
        rows, F.lit(service), F.col("kind"),
        F.when(F.col("to_route") == rules.SAME, F.col("state.route")).otherwise(F.col("to_route")),
        F.when(F.col("to_token") == rules.SAME, F.col("state.state")).otherwise(F.col("to_token")),
        F.col("new_params"), F.when(refused & ~text.startswith(v.UNMANAGED), F.concat(F.lit(v.MANAGED), text)).otherwise(text))
    return sent.select(
        F.when(unread, buses.QUARANTINE_TOPIC).otherwise(F.coalesce("to_topic", F.lit(v.DEFAULT_OUT_TOPIC))).alias("topic"),
        F.when(unread, quarantined(F.col("text"))).otherwise(env.serialize_envelope()).alias("value"), "ts", "seq")


def quarantined(reason: Column) -> Column:
    """What the quarantine topic gets: the record as it came, and why."""
    return json_object(reason=quoted(reason), record=quoted("value"))


def fan_out_batches(records: DataFrame) -> DataFrame:
    """Replace each message about many items by one message per item, in one pass over the records.

    Adds ``reason``: messages that cannot be read or fanned out stay as they are.
    """
    return parsed_by_item(records).select(*records.columns, "reason")


def parsed_by_item(records: DataFrame) -> DataFrame:
    """``fan_out_batches`` with the sections of the messages it gives, so that none is parsed again."""
    parsed = parsed_records(records)
    batch = F.coalesce(is_batch(F.col("state.state")), F.lit(False))
    parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(batch, unfit_for_fan_out(F.col("params")))))
    whole = batch & F.col("reason").isNull()
    message = F.when(whole, F.from_json("params", MESSAGE))
    read = parsed.withColumn("message_", message)
    entries = F.map_entries(F.col("message_.products"))
    none = F.array(F.lit(None).cast("struct<key:string,value:bigint>"))
    rows = read.withColumn("item_", F.explode(F.when(F.col("message_").isNotNull(), entries).otherwise(none)))
    rows = rows.withColumns({
        "came_": F.col("state"), "body_": F.col("params"),
        "item_id": F.col("item_.key"), "amount": F.col("item_.value"), "user_id": F.col("message_.user_id"),
        "order_id": F.col("message_.order_id"), "return_state": F.col("message_.return_state"),
        "batch_id": batch_id("input.request_id", "message_.order_id", "message_.return_state"),
        "batch_count": F.size("message_.products").cast("bigint")})
    one = json_object(item_id=quoted("item_id"), amount=raw("amount"), user_id=quoted("user_id"),
                      order_id=quoted("order_id"), batch_id=quoted("batch_id"), batch_count=raw("batch_count"),
                      return_state=quoted("return_state"))
    sent = env.redirect(rows, v.STOCK, F.col("state.route"), F.col("state.state"), one)
    by_item = F.col("item_").isNotNull()
    value = F.when(by_item, env.serialize_envelope()).otherwise(F.col("value"))
    return sent.select(*[value.alias(c) if c == "value" else F.col(c) for c in records.columns], "reason", "input",
                       F.when(by_item, F.col("state")).otherwise(F.col("came_")).alias("state"),
                       F.when(by_item, F.col("params")).otherwise(F.col("body_")).alias("params"))


PROCESSORS = {v.USER: p.UserProcessor, v.STOCK: p.StockProcessor, v.PAYMENT: p.PaymentProcessor}


def service_job(records: DataFrame, service: str, snapshot: DataFrame | None = None,
                watermark: str | None = None) -> DataFrame:
    """The answers of one service to a stream of bus records.

    ``snapshot`` (column ``key`` and the entity's columns) is the state to
    start from. With a ``watermark`` delay the order job also times out
    checkouts; records later than the watermark are dropped.
    """
    parsed = parsed_by_item(records) if service == v.STOCK else parsed_records(records)
    messages = matched_messages(parsed, service)
    timers = watermark is not None and service == v.ORDER
    if timers:
        messages = messages.withWatermark("ts", watermark)
    processor = p.OrderProcessor(timers) if service == v.ORDER else PROCESSORS[service]()
    record = F.to_json(F.struct(F.unix_micros("ts").alias("us"), *KERNEL_COLUMNS))
    # the watermark is found by its column
    packed = messages.select(p.bucket("key").alias("bucket"), record.alias("record"), "value", *["ts"] * timers)
    outcomes = packed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=p.InFrames(processor, ["record", "value"], p.OUTCOMES), outputStructType=p.OUTCOMES, outputMode="append",
        timeMode="eventTime" if timers else "none",
        initialState=None if snapshot is None else p.bucketed(snapshot).groupBy("bucket"))
    return answers(outcomes.withColumn("ts", F.timestamp_micros("us")), service)


def batch_answers(records: DataFrame) -> DataFrame:
    """Per item of a batch what the fan-in needs; ``reason`` says what keeps a record out of any batch."""
    params = F.col("params")
    read = parsed_records(records).withColumns({
        "batch_id": field(params, "batch_id"), "batch_count": coerce_long(field(params, "batch_count")),
        "item_id": field(params, "item_id"), "passed": field(params, "batch_pass")})
    read = read.withColumn("reason", F.coalesce("reason", first_reason(
        *[(F.col(c).isNull(), f"{text} is expected to exist.") for c, text in BATCH_FIELDS.items()],
        (F.col("batch_count") < 1, NO_PRODUCTS))))
    return read.select(own_key(F.col("batch_id")).alias("batch_id"), "batch_count", "item_id", "passed", "value", "ts", "seq", "reason")


BATCH_FIELDS = {"batch_id": "Batch ID", "batch_count": "Batch count", "item_id": "Item ID", "passed": "Batch pass"}


def fan_in(items: DataFrame, watermark: str | None = None, window_seconds: int = v.BATCH_WINDOW_SECONDS,
           shared: bool = False) -> DataFrame:
    """Batches that are complete, and those given up after ``window_seconds``.

    With a ``watermark`` delay time is that of the records, else that of their
    arrival, as the protocol has it. Either way a batch's state ends. Records with
    a ``reason`` come out with ``complete`` NULL. Every batch has a state of its own,
    or with ``shared`` a place in that of its bucket, which takes far fewer calls.
    """
    if "reason" not in items.columns:
        items = items.withColumn("reason", F.lit(None).cast("string"))
    clock = F.current_timestamp() if watermark is None else F.col("ts")
    items = items.withColumn("clock", clock).withWatermark("clock", watermark or "0 seconds")
    if shared:
        record = F.to_json(F.struct("batch_id", "batch_count", "item_id", "passed", F.unix_micros("ts").alias("us"), "seq",
                                    "reason", F.unix_millis("clock").alias("clock")))
        packed = items.select(p.bucket("batch_id").alias("bucket"), record.alias("record"), "value", "clock")
        found = packed.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=p.InFrames(p.FanInBuckets(window_seconds * 1000), ["record", "value"], p.FAN_IN_ROWS),
            outputStructType=p.FAN_IN_ROWS, outputMode="append", timeMode="eventTime")
        return found.select(*[F.timestamp_micros("us").alias("ts") if c == "us" else c for c in found.columns])
    return items.groupBy("batch_id").transformWithState(
        statefulProcessor=p.FanInProcessor(window_seconds * 1000), outputStructType=p.FAN_IN,
        outputMode="append", timeMode="eventTime")


def batch_results(batches: DataFrame) -> DataFrame:
    """Bus records: complete batches go to the orders, others to the dead-letter topic, unreadable ones to quarantine."""
    rows = env.parse_envelope(batches.withColumn("m_", F.col("value")), "m_")
    params = F.col("params")
    sent = env.redirect(rows, v.STOCK, F.col("input.route"),
                        F.coalesce(field(params, "return_state"), F.col("state.state")),
                        json_object(order_id=quoted(field(params, "order_id")),
                                    user_id=quoted(field(params, "user_id")), products=raw("products")))
    unread = F.col("complete").isNull()
    return sent.select(
        F.when(unread, buses.QUARANTINE_TOPIC).when(F.col("complete"), F.lit(v.IN_TOPIC[v.ORDER]))
        .otherwise(F.lit(buses.DEAD_TOPIC)).alias("topic"),
        F.when(unread, quarantined(F.col("products"))).otherwise(env.serialize_envelope()).alias("value"), "ts", "seq")


def start(spark: SparkSession, bus: str, name: str, snapshot: DataFrame | None = None,
          watermark: str | None = None, window_seconds: int = v.BATCH_WINDOW_SECONDS, **trigger):
    """Start one job on a folder bus; its checkpoint lies next to the bus."""
    records = buses.read_stream(spark, bus, name)
    out = (batch_results(fan_in(batch_answers(records), watermark, window_seconds, shared=True)) if name == buses.FAN_IN
           else service_job(records, name, snapshot, watermark))
    with state_stores(spark):
        return (out.writeStream.format("parquet").option("path", f"{bus}/{name}")
                .option("checkpointLocation", f"{bus}/checkpoints/{name}").queryName(name)
                .trigger(**(trigger or {"availableNow": True})).start())
