"""Hot keys: results stay whole when groups are split into pages."""

import json

from pyspark.sql import functions as F

from tillflow.operators import accounts, batching, orders, skew
from tillflow.plans import checkout as plan


def hot_lines(spark, n=2000):
    """One order with a third of all lines."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), (F.col("id") % 50).cast("string"))).alias("order_id"),
        F.col("id").cast("string").alias("item_id"), (F.col("id") % 7 + 1).alias("qty"))


def test_hot_keys_are_found_and_the_limit_grows(spark, monkeypatch):
    lines = hot_lines(spark)
    assert list(skew.hot_keys(lines, "order_id", 200)[0]) == ["hot"]
    assert skew.hot_keys(lines, "order_id", 200, lines.select("order_id").limit(150))[0] == {}
    monkeypatch.setattr(skew, "HOT_KEYS_MOST", 5)
    found, limit = skew.hot_keys(lines, "order_id", 10)
    assert list(found) == ["hot"] and limit == 100


def test_number_keys_find_hot_text_keys(spark):
    df = spark.range(100).select(F.lit("7").alias("key"))
    assert skew.hot_keys(df, "key", 10, spark.range(100).select(F.lit(7).alias("k")))[0] == {"7": 100}


def test_products_of_a_hot_order_are_one_row(spark):
    lines = hot_lines(spark)
    rows = orders.products(lines).collect()
    assert len([r for r in rows if r.order_id == "hot"]) == 1
    got = {(r.order_id, item): qty for r in rows for item, qty in json.loads(r.products).items()}
    assert got == {(r.order_id, r.item_id): r.qty for r in lines.collect()}


def test_order_sets_of_a_hot_user(spark):
    owned = spark.range(900).select(F.lit("u").alias("user_id"), F.col("id").cast("string").alias("order_id"))
    users = spark.createDataFrame([("u", 1), ("v", 2)], "user_id string, credits bigint")
    rows = accounts.order_sets(users, owned).collect()
    ids = [i for r in rows if r.user_id == "u" for i in r.orders.strip("[]").split(", ")]
    assert sorted(ids) == sorted(str(i) for i in range(900))
    assert [r.orders for r in rows if r.user_id == "v"] == ["[]"]


def test_a_large_batch_is_handed_on_once_and_whole(spark):
    def items(n, count):
        return spark.range(n).select(
            F.lit(f"b{n}").alias("batch_id"), F.lit(count).cast("bigint").alias("batch_count"),
            F.lit("o").alias("order_id"), F.lit("u").alias("user_id"), F.lit("send-stock").alias("return_state"),
            F.col("id").cast("string").alias("item_id"), F.col("id").alias("t"), F.lit('{"state":0}').alias("passed"))
    repeated = items(30, 31).unionByName(items(30, 31).limit(5))  # a repeated answer does not stand for a missing one
    rows = batching.collect_batches(items(900, 900).unionByName(repeated)).collect()
    assert [r.batch_id for r in rows] == ["b900"]
    assert len(json.loads(rows[0].params)["products"]) == 900


def test_fan_out_counts_the_whole_message(spark):
    lines = spark.range(300).select(F.lit("o").alias("order_id"), F.col("id").cast("string").alias("item_id"),
                                    F.lit(1).cast("bigint").alias("qty"))
    book = spark.createDataFrame([("o", "u")], "order_id string, user_id string")
    sent = orders.checkout_requests(book, lines, plan.order_prices(lines)).where("topic = 'stock_in'")
    out = batching.fan_out(sent.select(F.col("order_id").alias("request_id"), "params"))
    assert [tuple(r) for r in out.groupBy("batch_id", "batch_count").count().select("batch_count", "count").collect()] == [(300, 300)]
    some = out.where("cast(item_id as int) % 3 > 0")
    assert [(r.seen, r.complete) for r in batching.batch_progress(some).collect()] == [(200, False)]


def test_checkout_is_the_same_with_hot_items_and_users(spark):
    lines = hot_lines(spark, 600).withColumn("item_id", F.when(F.col("qty") > 4, "hot").otherwise(F.col("item_id")))
    lines = lines.groupBy("order_id", "item_id").agg(F.sum("qty").alias("qty"))
    ids = lines.select("order_id").distinct()
    book = ids.select("order_id", F.xxhash64("order_id").alias("seq"), F.lit(0).cast("bigint").alias("t"),
                      F.lit("hot").alias("user_id"))
    items = lines.select("item_id").distinct().withColumn("amount", F.lit(60).cast("bigint"))
    users = spark.createDataFrame([("hot", 500)], "user_id string, credits bigint")
    plain = plan.checkout(lines, book, items, users)
    split = plan.checkout(lines, book, items, users, hot_rows=8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_unknown_items_and_bad_amounts_take_nothing(spark):
    takes = spark.createDataFrame([("o1", "a", 2, 1, 1), ("o2", "x", 1, 2, 2), ("o3", "a", -1, 3, 3), ("o4", "a", 9, 4, 4),
                                   ("o5", "a", 3, 5, 5)], "order_id string, item_id string, amount bigint, t bigint, seq bigint")
    stock = spark.createDataFrame([("a", 5)], "item_id string, amount bigint")
    got = {r.order_id: r.code for r in batching.take_items(takes, stock).collect()}
    assert got == {"o1": 0, "o2": 2, "o3": 2, "o4": 1, "o5": 0}


def test_checks_notice_one_wrong_row(spark):
    from tillflow.operators import quality
    moves = spark.createDataFrame([("a", -3, True), ("a", 2, True), ("a", -9, False), ("b", -1, True)], "key string, delta bigint, accepted boolean")
    opening = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "key string, opening bigint")
    closing = spark.createDataFrame([("a", 9), ("b", 3), ("c", 1)], "key string, balance bigint")
    assert all(r.conserved for r in quality.conserved(moves, closing, opening).collect())
    broken = closing.withColumn("balance", F.when(F.col("key") == "b", 4).otherwise(F.col("balance")))
    assert [r.key for r in quality.conserved(moves, broken, opening).where("not conserved").collect()] == ["b"]
    gone = spark.createDataFrame([("o1",), ("o2",)], "order_id string")
    assert tuple(quality.still_there(gone, gone.where("order_id = 'o2'"), ["order_id"]).first()) == (2, 1)
    assert tuple(quality.not_there(gone, gone.where("order_id = 'o2'"), ["order_id"]).first()) == (2, 1)


def test_texts_of_hot_keys_are_joined_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ENTRIES", 40)
    lines = hot_lines(spark)
    order, text = F.col("item_id"), F.concat("item_id", F.lit("="), "qty")
    plain = {r.order_id: (r.all, r.n_entries) for r in skew.joined_sorted(lines, "order_id", text, order, ",", "all").collect()}
    ranged = skew.joined_sorted(lines, "order_id", text, order, ",", "all", hot_entries=150)
    assert {r.order_id: (r.all, r.n_entries) for r in ranged.collect()} == plain and len(plain) == 51
    hot = sorted((str(i), i % 7 + 1) for i in range(0, 2000, 3))
    assert plain["hot"] == (",".join(f"{i}={q}" for i, q in hot), len(hot))


def test_items_of_a_batch_are_shuffled_once(spark):
    items = spark.createDataFrame(
        [("b", 2, "o", "u", "s", i, t, f'{{"state":{t}}}') for i, t in (("x", 1), ("x", 2), ("y", 1))],
        "batch_id string, batch_count bigint, order_id string, user_id string, return_state string, item_id string, t bigint, passed string")
    out = batching.collect_batches(items)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r.params for r in out.collect()] == ['{"order_id":"o","user_id":"u","products":{"x":{"state":2},"y":{"state":1}}}']


def test_the_ledger_tells_unknown_items(spark):
    """Codes without a join with the stock, for ordinary and for hot items."""
    takes = spark.createDataFrame([(k, i, i, a) for k, i, a in [
        ("a", 1, 3), ("a", 2, 3), ("a", 3, -1), ("a", 4, None), ("b", 1, 0), ("none", 1, 0), ("none", 2, 1), (None, 1, 1), ("zero", 1, 0)]
        + [("hot", i, 1) for i in range(30)] + [("lost", i, 0) for i in range(30)]],
        "item_id string, t bigint, seq bigint, amount bigint")
    stock = spark.createDataFrame([("a", 5), ("b", 1), ("hot", 20), ("zero", None)], "item_id string, amount bigint")
    want = {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 0, ("b", 1): 0, ("none", 1): 2, ("none", 2): 2, (None, 1): 2, ("zero", 1): 0}
    want |= {("hot", i): int(i >= 20) for i in range(30)} | {("lost", i): 2 for i in range(30)}
    for hot_rows in (1000, 10):  # no amount changes nothing and is no error
        out = batching.take_items(takes, stock, hot_rows)
        assert {(r.item_id, r.t): r.code for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString() or hot_rows == 10


def test_checkout_takes_a_ledger_that_is_there(spark):
    lines = spark.createDataFrame([("o1", "a", 2), ("o2", "a", 2), ("o2", "b", 1)], "order_id string, item_id string, qty bigint")
    book = spark.createDataFrame([("o1", 1, 1, "u"), ("o2", 2, 2, "u")], "order_id string, seq bigint, t bigint, user_id string")
    stock = spark.createDataFrame([("a", 3), ("b", 9)], "item_id string, amount bigint")
    users = spark.createDataFrame([("u", 9)], "user_id string, credits bigint")
    taken = plan.reserve_stock(lines, book, stock)
    plain = plan.checkout(lines, book, stock, users).collect()
    assert sorted(plan.checkout(lines, book, stock.limit(0), users, taken=taken).collect()) == sorted(plain)
