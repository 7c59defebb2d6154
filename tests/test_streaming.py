"""Streams: a whole shopping trip from empty state, and joins that time out."""

import datetime as dt
import hashlib
import json
import random
from itertools import count

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tillflow import vocabulary as v
from tillflow.functions import envelope as env
from tillflow.session import fresh_path
from tillflow.sources import bus as buses
from tillflow.streaming import analytics, entities, jobs, processors, replay, rules

NUMBERS = count(1)


class Shop:
    """Sends requests in waves and looks up the answers."""

    def __init__(self, spark):
        self.spark, self.bus = spark, fresh_path(spark, "shop")
        buses.make_folders(spark, self.bus)

    def wave(self, *requests):
        """Each request is (id, route, params); returns the answers by id."""
        rows = []
        for request_id, route, params in requests:
            n = next(NUMBERS)
            service = next((s for r, s, _ in v.ROUTES if r == route), v.USER)
            rows.append((v.IN_TOPIC[service], request_id, route, json.dumps(params),
                         dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), n))
        df = self.spark.createDataFrame(rows, "topic string, id string, route string, params string, ts timestamp, seq bigint")
        buses.send(df.withColumn("value", env.make_envelope(*map(F.col, ("id", "topic", "route", "params")))), self.bus)
        replay.replay(self.spark, self.bus)
        wanted = [r[0] for r in requests]
        found = replay.responses(self.spark, self.bus).where(F.col("request_id").isin(wanted)).collect()
        return {r.request_id: (r.result, r.message, json.loads(r.params) if r.params else None) for r in found}


def made_id(request_id, param):
    return hashlib.sha256(f"{request_id}:{param}".encode()).hexdigest()


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark)


def test_a_shopping_trip(shop):
    user, pen, ink = made_id("u", "user_id"), made_id("i1", "item_id"), made_id("i2", "item_id")
    first, second, lost = (made_id(o, "order_id") for o in ("o1", "o2", "o3"))

    got = shop.wave(("u", "users/create", {}), ("i1", "stock/item/create", {}), ("i2", "stock/item/create", {}),
                    ("bad", "users/unknown", {}))
    assert got["u"] == ("success", "User created.", {"user_id": user, "balance": 0, "orders": "[]"})
    assert got["i1"] == ("success", "Item created.", {"item_id": pen, "amount": 0})
    assert got["bad"][:2] == ("error", "Managed Exception: Unrecognised route.")

    got = shop.wave(
        ("c1", "users/credit/add", {"user_id": user, "amount": "10"}),
        ("c2", "users/credit/subtract", {"user_id": user, "amount": "11"}),
        ("s1", "stock/add", {"item_id": pen, "amount": "5"}), ("s2", "stock/add", {"item_id": ink, "amount": "1"}),
        ("s3", "stock/add", {"item_id": ink, "amount": "x"}),
        ("o1", "orders/create", {"user_id": user}), ("o2", "orders/create", {"user_id": user}),
        ("o3", "orders/create", {"user_id": "nobody"}))
    assert got["c1"][1:] == ("Credits added.", {"user_id": user, "balance": 10, "orders": "[]"})
    assert got["c2"][:2] == ("error", "Managed Exception: Not enough credits.")
    assert got["s3"][:2] == ("error", "Managed Exception: Amount must be positive.")
    assert got["o1"][:2] == ("success", "Order created.") and got["o1"][2]["order_id"] == first
    assert got["o3"][:2] == ("failure", "Order not created. User did not exist.")
    assert got["o3"][2]["order_id"] == lost

    got = shop.wave(
        ("a1", "orders/addItem", {"order_id": first, "item_id": pen}),
        ("a2", "orders/addItem", {"order_id": first, "item_id": pen}),
        ("a3", "orders/addItem", {"order_id": first, "item_id": ink}),
        ("a4", "orders/addItem", {"order_id": first, "item_id": "nothing"}),
        ("a5", "orders/addItem", {"order_id": second, "item_id": ink}),
        ("a6", "orders/addItem", {"order_id": lost, "item_id": ink}))
    assert got["a4"][:2] == ("failure", "Item does not exist.")
    assert got["a4"][2]["products"] == {pen: 2, ink: 1}
    assert got["a6"][:2] == ("error", f"Managed Exception: {v.not_found('order')}")

    # both want the only ink: the earlier order gets it, the other gets its money back
    got = shop.wave(("k1", "orders/checkout", {"order_id": first}), ("k2", "orders/checkout", {"order_id": second}))
    assert got["k1"][:2] == ("success", "Order successfully purchased.")
    assert got["k1"][2]["is_paid"] is True and got["k1"][2]["checkout_status"] == v.SUCCEEDED
    assert got["k2"][:2] == ("failure", "Order checkout failed.")
    assert got["k2"][2]["log"] == [
        {"message": f"Not enough items in stock: {ink}", "status": "FAILURE", "status_code": 1}]

    got = shop.wave(
        ("f1", "users/find", {"user_id": user}), ("f2", "stock/availability", {"item_id": pen}),
        ("f3", "stock/availability", {"item_id": ink}), ("p1", "payment/status", {"order_id": first}),
        ("p2", "payment/status", {"order_id": second}), ("p3", "payment/cancelPayment", {"order_id": first}))
    assert got["f1"][2]["balance"] == 7 and got["f1"][2]["orders"] == f"[{', '.join(sorted([first, second]))}]"
    assert (got["f2"][2]["amount"], got["f3"][2]["amount"]) == (3, 0)
    assert (got["p1"][2]["status"], got["p2"][2]["status"]) == ("PAID", "CANCELLED")
    assert got["p3"][:2] == ("success", "Payment cancelled. User credits refunded.")

    got = shop.wave(("f4", "users/find", {"user_id": user}), ("r1", "users/remove", {"user_id": user}))
    assert got["f4"][2]["balance"] == 10
    answers = replay.responses(shop.spark, shop.bus).where("request_id = 'r1'").select("message").collect()
    # two orders that may no longer be removed, and the user
    assert sorted(r.message for r in answers) == ["Managed Exception: Cannot remove order."] * 2 + ["User removed."]


def test_every_outcome_has_a_reply(spark):
    for service in v.KEY_PARAM:
        table = rules.replies(spark, service)
        assert table.count() == table.select("rule", "outcome").distinct().count()
        assert table.where("kind = 'redirect' and to_topic is null").count() == 0


def test_requests_without_answer_time_out(spark):
    path = fresh_path(spark, "timeouts")
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {})"
    asked = spark.range(10).selectExpr("cast(id as string) request_id", f"{at.format('id * 100')} request_ts")
    replied = spark.range(5).selectExpr("cast(id as string) request_id", f"{at.format('id * 100 + 50')} response_ts")
    for label, frame, name in (("asked", asked, "request_ts"), ("replied", replied, "response_ts")):
        frame.write.parquet(f"{path}/{label}")
        frame.limit(1).selectExpr("'far' request_id", f"timestamp'2030-01-01' {name}").write.mode("append").parquet(
            f"{path}/{label}")
    joined = analytics.correlate_stream(
        spark.readStream.schema(asked.schema).parquet(f"{path}/asked"),
        spark.readStream.schema(replied.schema).parquet(f"{path}/replied"), "60 seconds", "0 seconds", "left_outer")
    (joined.writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(joined.schema).parquet(f"{path}/out").where("request_id <> 'far'").collect()
    assert sorted((r.request_id, r.response_ts is not None) for r in rows) == [(str(i), i < 5) for i in range(10)]


def run_to_files(stream, path, label):
    (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint-{label}")
     .trigger(availableNow=True).start().awaitTermination(300))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


ITEMS = "batch_id string, batch_count long, item_id string, passed string, value string, ts timestamp, seq long, reason string"


def test_fan_in_counts_items_not_answers(spark):
    path = fresh_path(spark, "items")

    def at(seconds):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)

    def send(*rows):
        spark.createDataFrame([(b, 2, i, p, "{}", at(s), n, reason) for n, (b, i, p, s, reason) in enumerate(rows)], ITEMS).coalesce(
            1).write.mode("append").parquet(f"{path}/in")
        return run_to_files(jobs.fan_in(spark.readStream.schema(ITEMS).parquet(f"{path}/in"), "0 seconds", 10), path, "fan-in").collect()

    # one item answers twice: not complete; an unreadable record comes out as such
    got = send(("b1", "i1", "1", 0, None), ("b1", "i1", "2", 1, None), ("b2", "i1", "7", 1, None), ("quarantine:x", None, None, 1, "no item"))
    assert [(r.complete, r.products) for r in got] == [(None, "no item")]
    # the other item completes it, with the latest answer of the first; the repeat behind it changes nothing
    got = send(("b1", "i2", "3", 2, None), ("b1", "i2", "3", 2, None), ("b1", "i1", "2", 2, None))
    done = [r for r in got if r.complete]
    assert [(r.batch_id, r.seen, r.products) for r in done] == [("b1", 2, '{"i1":2,"i2":3}')]
    assert len(send(("b1", "i1", "9", 3, None))) == 2
    # past every timer: the incomplete one is given up, and nothing is kept of the other
    got = send(("end", "i1", "1", 1000, None))
    assert [(r.batch_id, r.seen) for r in got if r.complete is False] == [("b2", 1)]
    state = spark.read.format("statestore").option("stateVarName", "done").load(f"{path}/checkpoint-fan-in")
    assert state.count() == 0
    kept = spark.read.format("statestore").option("stateVarName", "seen").load(f"{path}/checkpoint-fan-in").select("key.*").collect()
    assert [tuple(r) for r in kept] == [("end",)]


def test_first_answers_come_once(spark):
    rng, path = random.Random(3), fresh_path(spark, "answers")
    start = dt.datetime(2024, 1, 1)
    asked = {f"r{i}": rng.randrange(2000) for i in range(60)}
    replied = [(f"r{rng.randrange(80)}", rng.randrange(2200)) for _ in range(300)]
    # in slices of arrival that are out of order by less than the lateness
    for low in range(0, 2400, 200):
        spark.createDataFrame([(k, start + dt.timedelta(seconds=t)) for k, t in asked.items() if low <= t + hash_of(k) % 90 < low + 200],
                              "request_id string, request_ts timestamp").write.mode("append").parquet(f"{path}/asked")
        spark.createDataFrame([(k, start + dt.timedelta(seconds=t)) for k, t in replied if low <= t + hash_of(k + str(t)) % 90 < low + 200],
                              "request_id string, response_ts timestamp").write.mode("append").parquet(f"{path}/replied")
    spark.createDataFrame([("end", start + dt.timedelta(days=9))], "request_id string, request_ts timestamp").write.mode("append").parquet(f"{path}/asked")
    rows = run_to_files(analytics.first_answers(
        spark.readStream.schema("request_id string, request_ts timestamp").option("maxFilesPerTrigger", 8).parquet(f"{path}/asked"),
        spark.readStream.schema("request_id string, response_ts timestamp").option("maxFilesPerTrigger", 8).parquet(f"{path}/replied"),
        100, "400 seconds"), path, "answers").collect()
    want = {}
    for k, t in asked.items():
        want[k] = min((a for b, a in replied if b == k and t <= a <= t + 100), default=None)
    got = {r.request_id: None if r.response_ts is None else int((r.response_ts - start).total_seconds()) for r in rows}
    assert len(rows) == len(got) and got == want
    assert {v is None for v in want.values()} == {True, False}


def hash_of(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_payments_are_tried_again_as_the_job_does(spark, folder):
    """All payments, then all of them once more: the batch form equals the payment job."""
    from tillflow.catalog import payments as fixtures, streams
    from tillflow.catalog.accounts import existing_users
    from tillflow.operators import payments
    from tillflow.sources.fixtures import orders0
    once = fixtures.pay_requests(spark, folder)
    again = once.select("order_id", (F.col("t") + 10**15).alias("t"), (F.col("seq") + 10**9).alias("seq"))
    bus = fresh_path(spark, "twice")
    buses.make_folders(spark, bus)
    snapshots = {v.USER: streams.user_snapshot(existing_users(spark, folder)), v.ORDER: streams.order_snapshot(spark, folder)}
    for asked in (once, again):
        asked = asked.withColumns({"request_id": F.concat_ws("/", "order_id", "seq"), "ts": F.timestamp_micros("t")})
        buses.send(streams.web(asked, "payment_in", "payment/pay", order_id="order_id"), bus)
        replay.replay(spark, bus, snapshots, only=[v.USER, v.PAYMENT, v.ORDER])
    job = {(r.request_id, r.result, r.message) for r in replay.responses(spark, bus, [v.PAYMENT]).collect()}
    batch = payments.pay_orders(once.unionByName(again), orders0(spark, folder), fixtures.prices0(spark, folder), existing_users(spark, folder))
    rows = {(f"{r.order_id}/{r.seq}", r.result, r.message) for r in batch.collect()}
    assert rows == job and len({r[2] for r in rows}) >= 5


def test_an_entity_of_ones_own(spark):
    """Coupons: created, redeemed a number of times, handed on to the users when used up."""
    def create(state, m):
        return ({"left": m.amount}, [("ok", {"left": m.amount}, None)]) if state is None else (state, [("taken", {}, None)])

    def redeem(state, m):
        if state is None:
            return None, [("absent", {}, None)]
        if m.amount > state["left"]:
            return state, [("refused", {}, f"Only {state['left']} left.")]
        state["left"] -= m.amount
        done = [("ok", state, None)]
        return (state, done) if state["left"] else (None, done + [("used_up", {"user_id": "u"}, None)])

    def fail(state, m):
        state["left"] = 1 // 0

    entities.register(entities.Entity("coupon", "coupon_id", {"coupon/create": create, "coupon/redeem": redeem, "coupon/fail": fail}, [
        entities.Reply("coupon/create", "ok", "success", "Coupon created."), entities.Reply("coupon/create", "taken", "error", "Coupon exists."),
        entities.Reply("coupon/redeem", "ok", "success", "Redeemed."),
        entities.Reply("coupon/redeem", "used_up", "redirect", topic="user_in", to_route="users/credit/add", token=None)]))
    with pytest.raises(ValueError):
        entities.register(entities.Entity(v.USER, "user_id", {}))
    path = fresh_path(spark, "coupons")
    asked = [("c1", "coupon/create", 5), ("c1", "coupon/create", 5), ("c1", "coupon/redeem", 3), ("c1", "coupon/redeem", 3),
             ("c2", "coupon/redeem", 1), ("c1", "coupon/fail", 1), ("c1", "coupon/redeem", 2), ("c1", "coupon/redeem", 1), ("c1", "coupon/other", 1)]
    rows = [("coupon_in", f"q{i}", route, json.dumps({"coupon_id": c, "amount": n}), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i)
            for i, (c, route, n) in enumerate(asked)]
    df = spark.createDataFrame(rows, "topic string, id string, route string, params string, ts timestamp, seq bigint")
    df = df.withColumn("value", env.make_envelope(*map(F.col, ("id", "topic", "route", "params")))).select("topic", "value", "ts", "seq")
    df.write.parquet(f"{path}/in")
    out = run_to_files(jobs.service_job(spark.readStream.schema(df.schema).parquet(f"{path}/in"), "coupon"), path, "coupon")
    got = env.parse_envelope(out).select("seq", "topic", "state.route", "result.message").collect()
    web, bad = v.DEFAULT_OUT_TOPIC, "Managed Exception: "
    assert {(r.seq, r.topic, r.route, r.message) for r in got if r.seq != 5} == {
        (0, web, "web", "Coupon created."), (1, web, "web", bad + "Coupon exists."), (2, web, "web", "Redeemed."),
        (3, web, "web", bad + "Only 2 left."), (4, web, "web", bad + v.not_found("coupon")), (6, web, "web", "Redeemed."),
        (6, "user_in", "users/credit/add", None), (7, web, "web", bad + v.not_found("coupon")), (8, web, "web", bad + v.UNKNOWN_ROUTE)}
    assert [r.message.startswith(v.UNMANAGED) for r in got if r.seq == 5] == [True]


def test_kafka_options_and_rows(spark):
    options = buses.kafka_read_options("user_in,order_in", "broker:9092", most_per_trigger=1000)
    assert options["subscribe"] == "user_in,order_in" and options["maxOffsetsPerTrigger"] == "1000"
    with pytest.raises(ValueError):
        buses.kafka_read_options("user_in", "")
    rows = buses.kafka_rows(spark.createDataFrame([("t", "{}")], "topic string, value string"))
    assert rows.columns == ["topic", "key", "value"]


def test_failfast_parsing_stops_the_query(spark):
    df = spark.createDataFrame([('{"input":',)], "value string")
    assert env.parse_envelope(df).where(env.is_message()).count() == 0
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        env.parse_envelope(df, mode="FAILFAST").select("input").collect()


def test_a_literal_message_with_unknown_fields(spark):
    text = json.dumps({"input": {"request_id": "r", "consumer": "c", "route": "users/find", "params": {"foo": 1}},
                       "state": {"route": "users/find", "sender": "web", "web": True, "state": None},
                       "params": {"order_id": "o", "user_id": "u"}})
    df = env.parse_envelope(spark.createDataFrame([(text,)], "value string"))
    out = json.loads(df.select(env.serialize_envelope().alias("x")).first().x)
    assert out["path"] == [] and out["result"] == {} and "web" not in out["state"]
    assert out["params"] == {"order_id": "o", "user_id": "u"}


class CountedState:
    """A value state that counts the calls, as the state store would be called."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class CountedHandle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, CountedState())

    def registerTimer(self, ms):
        self.timers.append(ms)

    def calls(self):
        return sum(s.calls for s in self.states.values()) + len(self.timers)


def fired(ms):
    return TimerValues(-1, ms + 1), ExpiredTimerInfo(ms)


def test_keys_of_a_bucket_share_their_state_calls(spark):
    """A state call per key made the jobs take milliseconds a message."""
    keys = [f"o{i}" for i in range(500)]
    order = {"user_id": "u", "user_checked": True, "is_paid": False, "checkout_status": 0, "products": '{"p":1}'}
    handle, job = CountedHandle(), processors.OrderProcessor(timers=True)
    job.init(handle)
    job.handleInitialState((1,), Row(ids=keys, states=[json.dumps(order)] * 500), None)
    asked = [Row(value="v", record=json.dumps({"key": k, "us": i * 10**6, "seq": i, "rule": "orders/checkout:-", "amount": 0}))
             for i, k in enumerate(keys)]
    taken = list(job.handleInputRows((1,), iter(asked), None))
    assert sorted(r.outcome for r in taken) == ["pay"] * 500 + ["take"] * 500
    assert handle.calls() < 10 and handle.timers == [v.CHECKOUT_TIMEOUT_MS]
    # the first 100 are due; the rest keep waiting for a timer of their own
    gone = list(job.handleExpiredTimer((1,), *fired(99_000 + v.CHECKOUT_TIMEOUT_MS)))
    assert [(r.seq, r.outcome) for r in gone] == [(i, "failed") for i in range(100)]
    assert handle.timers[-1] == 100_000 + v.CHECKOUT_TIMEOUT_MS and handle.calls() < 20
    left = [json.loads(s) for s in handle.states[processors.STATE].value[1]]
    assert [s["checkout_status"] for s in left] == [v.FAILED] * 100 + [v.IN_PROGRESS] * 400


def test_first_answers_of_a_bucket_share_their_state_calls(spark):
    handle, job = CountedHandle(), processors.FirstAnswerProcessor(1000)
    job.init(handle)
    rows = [Row(request_id=f"r{i}", is_answer=reply, us=i * 10**6 + reply) for i in range(500) for reply in (False, True)]
    list(job.handleInputRows((1,), iter(rows), None))
    assert handle.calls() < 10
    got = list(job.handleExpiredTimer((1,), *fired(10**9)))
    assert sorted((r.request_us, r.response_us) for r in got) == [(i * 10**6, i * 10**6 + 1) for i in range(500)]
    assert handle.states[processors.STATE].value is None


def test_a_snapshot_that_has_a_key_twice(spark):
    rows = spark.createDataFrame([("k", 5), ("k", 5), (None, None)], "key string, credits bigint")
    buckets = processors.bucketed(rows).collect()
    assert sorted(len(b.ids) for b in buckets) == [1, 2]
    for b in buckets:
        handle, job = CountedHandle(), processors.UserProcessor()
        job.init(handle)
        job.handleInitialState((b.bucket,), b, None)
        ids, states = handle.states[processors.STATE].value
        assert (ids, json.loads(states[0]).get("credits")) in ((["k"], 5), ([None], None))


def test_a_bucket_comes_and_goes_as_one_frame(spark):
    """Rows that crossed value by value took longer than the work on them."""
    handle, job = CountedHandle(), processors.InFrames(processors.StockProcessor(), ["record", "value"], processors.OUTCOMES)
    job.init(handle)
    job.handleInitialState((1,), pd.DataFrame({"ids": [["i0", "i1"]], "states": [['{"amount":5}', '{"amount":7}']]}), None)
    seqs = [None, 2**53 + 1, 3]  # as a column of floats the second would change
    frames = [pd.DataFrame({"bucket": 1, "record": [json.dumps({"key": f"i{n % 2}", "us": n, "seq": s, "rule": "stock/subtract", "amount": 2})],
                            "value": ["v"]}) for n, s in enumerate(seqs)]
    out = list(job.handleInputRows((1,), iter(frames), None))
    assert len(out) == 1 and list(out[0].columns) == ["value", "us", "seq", "rule", "outcome", "extra", "text"]
    assert sorted(zip(out[0]["seq"], out[0]["extra"]), key=str) == sorted(
        [(None, '{"item_id":"i0","amount":3}'), (2**53 + 1, '{"item_id":"i1","amount":5}'), (3, '{"item_id":"i0","amount":1}')], key=str)
    assert list(job.handleInputRows((1,), iter([]), None)) == []


def test_stock_messages_by_item_are_not_parsed_again(spark):
    one = {"input": {"request_id": "r", "consumer": "c", "route": "orders/checkout", "params": {}},
           "state": {"route": "batch/subtract", "sender": "order", "state": "batch:subtract"},
           "params": {"products": {"i1": 2, 'i"2': 3}, "order_id": "o", "user_id": "u", "return_state": "send-stock"}}
    plain = {**one, "state": {"route": "stock/add", "sender": "web", "state": None}, "params": {"item_id": "i3", "amount": "4"}}
    rows = [("stock_in", json.dumps(one), 1), ("stock_in", json.dumps(plain), 2), ("stock_in", "{", 3),
            ("stock_in", json.dumps({**one, "params": {"products": {}}}), 4), ("stock_in", None, 5)]
    records = spark.createDataFrame(rows, "topic string, value string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    got = jobs.matched_messages(jobs.parsed_by_item(records), v.STOCK)
    want = jobs.keyed_messages(jobs.fan_out_batches(records), v.STOCK)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 6


def test_fan_in_by_bucket_is_that_by_batch(spark):
    """A state and a timer per batch took several calls and milliseconds each."""
    rng, paths, found = random.Random(5), {}, {}
    rows = [(f"b{rng.randrange(40)}", 1 + rng.randrange(3), f"i{rng.randrange(3)}", str(n), f"v{n}",
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n // 4), n, None) for n in range(240)]
    counts = {}
    rows = [(b, counts.setdefault(b, n), *rest) for b, n, *rest in rows]
    rows.insert(100, ("quarantine:x", None, None, None, "q", dt.datetime(2024, 1, 1, 0, 1), None, "no item"))
    for shared in (False, True):
        path = paths[shared] = fresh_path(spark, "both")
        for part in (rows[:90], rows[90:], [("end", 2, "i1", "1", "v", dt.datetime(2025, 1, 1), 0, None)]):
            spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(f"{path}/in")
            out = run_to_files(jobs.fan_in(spark.readStream.schema(ITEMS).parquet(f"{path}/in"), "0 seconds", 10, shared=shared), path, "fan-in")
        found[shared] = sorted(map(repr, out.collect()))
    assert found[True] == found[False] and len(found[True]) > 40
    assert {text.split("complete=")[1].split(",")[0] for text in found[True]} == {"True", "False", "None"}


def test_batches_of_a_bucket_share_their_state_calls(spark):
    handle, job = CountedHandle(), processors.FanInBuckets(1000)
    job.init(handle)
    rows = [Row(record=json.dumps({"batch_id": f"b{i}", "batch_count": 2, "item_id": f"i{n}", "passed": "1", "us": n, "seq": n, "clock": i}), value="v")
            for i in range(500) for n in range(1 + i % 2)]
    done = list(job.handleInputRows((1,), iter(rows), None))
    assert len(done) == 250 and {(r.complete, r.seen, r.products) for r in done} == {(True, 2, '{"i0":1,"i1":1}')}
    assert handle.calls() < 10 and handle.timers == [1000]
    gone = list(job.handleExpiredTimer((1,), *fired(1099)))
    assert [(r.batch_id, r.complete, r.seen) for r in gone] == [(f"b{i}", False, 1) for i in range(0, 100, 2)]
    assert handle.timers[-1] == 1100 and len(handle.states[processors.STATE].value[0]) == 400


def test_requests_and_answers_without_time(spark):
    """They ended the job; in a frame they would turn the times beside them into floats."""
    path, at = fresh_path(spark, "timeless"), dt.datetime(2024, 1, 1)
    asked = [("a", at), ("b", None), ("end", at + dt.timedelta(days=9))]
    replied = [("a", None), ("a", at + dt.timedelta(microseconds=7)), ("b", at)]
    for name, rows, ts in (("asked", asked, "request_ts"), ("replied", replied, "response_ts")):
        spark.createDataFrame(rows, f"request_id string, {ts} timestamp").write.parquet(f"{path}/{name}")
    rows = run_to_files(analytics.first_answers(
        spark.readStream.schema("request_id string, request_ts timestamp").parquet(f"{path}/asked"),
        spark.readStream.schema("request_id string, response_ts timestamp").parquet(f"{path}/replied"), 100, "400 seconds"), path, "answers").collect()
    assert sorted(map(tuple, rows)) == [("a", at, at + dt.timedelta(microseconds=7)), ("b", None, None)]


def test_state_stores_follow_the_cores(spark):
    path, name = fresh_path(spark, "stores"), "spark.sql.shuffle.partitions"
    spark.createDataFrame([("user_in", json.dumps({"input": {"request_id": "u"}, "params": {"user_id": "1"}, "state": {"route": "users/create"}}),
                            dt.datetime(2024, 1, 1), 1)], buses.RECORD).write.parquet(f"{path}/{v.WEB}")
    buses.make_folders(spark, path)
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    try:
        replay.replay(spark, path, only=[v.USER])
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, before)
    stores = spark.read.format("state-metadata").load(f"{path}/checkpoints/{v.USER}").select("numPartitions").distinct().collect()
    assert [r.numPartitions for r in stores] == [max(8, 2 * spark.sparkContext.defaultParallelism)]
    assert replay.responses(spark, path, [v.USER]).select("message").collect() == [Row(message="User created.")]


def test_a_message_is_read_and_written_in_few_calls(spark):
    """A JSON parser or writer for every field cost more than the message."""
    odd = ['}"', "[]", "\\", "a\n\u0001", "ü😀", "", None]
    sent = {"input": {"request_id": odd[0], "consumer": odd[1], "route": odd[2], "params": {"user_id": odd[3]}},
            "state": {"route": odd[4], "sender": odd[5], "state": odd[6], "state_id": odd[0]},
            "params": {"item_id": odd[3], "amount": " 7.9 ", "price": 2, "state": "1", "message": odd[0], "products": {"i": {"state": 0}}},
            "path": [{"consumer": odd[0], "route": odd[1], "state": odd[3], "state_id": odd[6], "params": {"}": "}"}}],
            "result": {"result": odd[2], "message": odd[6], "params": None}}
    df = spark.createDataFrame([(json.dumps(sent), dt.datetime(2024, 1, 1), 1)], buses.RECORD.split(", ", 1)[1])
    written = env.parse_envelope(df).select(env.serialize_envelope().alias("text"))
    keyed = jobs.keyed_messages(df, v.STOCK)
    for frame, call, most in ((written, "to_json(", 5), (keyed, "get_json_object(", 1)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count(call) <= most
    assert json.loads(written.first().text) == sent
    row = keyed.first()
    assert (row.key, row.item_id, row.amount, row.price, row.code, row.note) == (odd[3], odd[3], 7, 2, 1, odd[0])
    assert row.results == [Row(key="i", value=Row(state=0, amount=None))]


def test_the_lines_of_a_batch_are_shuffled_by_their_order_alone(spark, tmp_path):
    """Shuffling them by order and item once more doubled the shuffled bytes and scattered the lines of a batch."""
    from tillflow.catalog import batches
    name, at = "spark.sql.autoBroadcastJoinThreshold", dt.datetime(2024, 1, 1)
    lines = [(7, 1), (7, 2), (8, 1), (8, None), (None, 1), (14, 5), (14, 5), (14, None)]
    spark.createDataFrame([(o, p, 1.0) for o, p in lines], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 1, at, "O") for o in (7, 8, 14, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string").write.parquet(
        f"{tmp_path}/orders.parquet")
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        items = batches.batch_items(spark, str(tmp_path))
        plan = items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(order_id" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("order_id") and "item_id" in x.split(")")[0]]
    # an item that is not there is never the lost one; the smallest one of an order that 7 divides is
    assert sorted(map(tuple, items.select("order_id", "item_id").collect()), key=str) == sorted(
        [("7", "2"), ("8", "1"), ("8", None), ("14", None)], key=str)


def test_json_writers_are_made_once(monkeypatch):
    """The standard one makes an encoder for every value, which took longer than the message."""
    odd = {"a": [1, None, True, 2.5, "ü\"\\\n 😀"], "": {}, "n": {"x": -(2**60)}}
    text = processors.compact(odd)
    assert text == json.dumps(odd, separators=(",", ":"), ensure_ascii=False) and processors.parsed(text) == odd
    made = []
    monkeypatch.setattr(json.encoder, "c_make_encoder", lambda *a: made.append(a))
    assert [processors.compact(x) for x in (odd, {}, "s", None)] == [text, "{}", '"s"', "null"] and not made
    # they stay where they are, a task makes its own
    assert [type(f).__reduce__(f)[1] for f in (processors.compact, processors.parsed)] == [(), ()]


def test_the_text_of_a_basket_is_written_only_when_it_changes():
    order = {"user_id": "u", "user_checked": True, "is_paid": False, "checkout_status": 0, "products": '{"p": 1,"q":2}'}
    job = processors.OrderProcessor(timers=False)
    for rule, kept in (("orders/find", True), ("orders/checkout:-", True), ("payment/pay:order-mark-paid", True), ("orders/removeItem", False)):
        job.load("o", order)
        job.apply("o", processors.Message({"rule": rule, "key": "o", "item_id": "q", "us": 1, "seq": 1}, "v"))
        text = job.store("o")["products"]
        assert text == (order["products"] if kept else '{"p":1}')
