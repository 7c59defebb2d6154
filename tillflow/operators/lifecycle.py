"""The lives of users and orders: created, removed and created again, in the order (t, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillflow import vocabulary as v
from tillflow.operators.histories import HOT_ROWS, Machine, starts_of, with_states
from tillflow.operators.ledger import guarded_ledger
from tillflow.operators.orders import outcome
from tillflow.operators.routing import first_reason
from tillflow.operators.skew import hot_keys
from tillflow.session import written

ABSENT, THERE, LOCKED = 0, 1, 2
USER: Machine = {"users/create": (THERE, THERE), "users/remove": (ABSENT, ABSENT)}
# a locked order is paid or in a checkout; it can no longer be removed
ORDER: Machine = {"create": (THERE, THERE, LOCKED), "orders/remove": (ABSENT, ABSENT, LOCKED), "cascade": (ABSENT, ABSENT, LOCKED),
                  "orders/lock": (ABSENT, LOCKED, LOCKED)}
# fixed values: what a creation is refused with
ORDER_TAKEN, USER_TAKEN = "Order already exists.", "User already exists."
NO_USER = "Order not created. User did not exist."
LONG_AGO = -(1 << 62)


def lives(commands: DataFrame, users: DataFrame | None = None, orders: DataFrame | None = None,
          hot_rows: int = HOT_ROWS) -> DataFrame:
    """The answer to every command, and to every order removal that the removal of its user brings.

    ``commands`` has verb (users/create, users/remove, orders/create,
    orders/remove, orders/lock, which has no answer), user_id, order_id, t and a
    unique seq. ``users`` (user_id) and ``orders`` (order_id, user_id, locked) are
    there from the start. Removing a user removes the orders that are its own
    then: those it created last and that are still there. Gives verb, user_id,
    order_id, t, seq, result, message; a brought removal has the verb ``cascade``
    and the user's t and seq.
    """
    initial = None if users is None else users.select(F.col("user_id").alias("key"), F.lit(THERE).alias("state")).distinct()
    old = None if orders is None else orders.select(
        F.lit("held").alias("verb"), "user_id", "order_id", F.lit(LONG_AGO).alias("t"),
        F.xxhash64("order_id").alias("seq"), "locked")
    of_users = commands.where("verb in ('users/create', 'users/remove', 'orders/create')").withColumn("locked", F.lit(False))
    if old is not None:
        of_users = of_users.unionByName(old.select(of_users.columns))
    seen = written(with_states(of_users.withColumn("key", F.col("user_id")), USER, initial, hot_rows), "user-lives")
    # removals of a user so far: a creation is the user's until the removal with the next number
    ended = (F.col("verb") == "users/remove") & (F.col("before") == THERE)
    counted = written(guarded_ledger(seen.withColumn("delta", ended.cast("bigint")), None, hot_rows).drop("accepted", "delta"), "user-ends")
    owners = counted.where("verb in ('orders/create', 'held')")
    ends = counted.where(ended).select(
        "user_id", (F.col("balance") - 1).alias("balance"), F.col("t").alias("end_t"), F.col("seq").alias("end_seq"))
    brought = owners.where((F.col("before") == THERE) | (F.col("verb") == "held")).join(ends, ["user_id", "balance"]).select(
        F.lit("cascade").alias("verb"), "user_id", "order_id", F.col("end_t").alias("t"), F.col("end_seq").alias("seq"),
        F.col("seq").alias("made_by"))
    creations = owners.where("verb = 'orders/create'").select(
        F.when(F.col("before") == THERE, "create").otherwise("lost").alias("verb"), "user_id", "order_id", "t", "seq")
    others = commands.where("verb in ('orders/remove', 'orders/lock')").select("verb", "user_id", "order_id", "t", "seq")
    fixed = creations.unionByName(others)
    start = None
    if old is not None:
        start = orders.select(F.col("order_id").alias("key"), F.when(F.col("locked"), LOCKED).otherwise(THERE).alias("state"))
        # the first owner counts like a creation that comes before all others
        fixed = fixed.unionByName(old.select("verb", "user_id", "order_id", "t", "seq"))
    states = _order_states(fixed, written(brought, "brought"), start, hot_rows)
    verb, before = F.col("verb"), F.col("before")
    gone = before == ABSENT
    made = verb.isin("create", "lost")
    reason = first_reason(
        (made & ~gone, ORDER_TAKEN), (verb == "lost", NO_USER), (~made & gone, v.not_found("order")),
        (~made & (before == LOCKED), v.CANNOT_REMOVE))
    of_orders = states.where(~verb.isin("orders/lock", "held") & ~((verb == "cascade") & gone)).select(
        F.when(made, "orders/create").otherwise(verb).alias("verb"), "user_id", "order_id", "t", "seq",
        *_answer(reason, F.when(made, "Order created.").otherwise("Order removed."), NO_USER))
    there, create = before == THERE, verb == "users/create"
    reason = first_reason((create & there, USER_TAKEN), (~create & ~there, v.not_found("user")))
    people = seen.where("verb like 'users/%'").select(
        "verb", "user_id", "order_id", "t", "seq",
        *_answer(reason, F.when(create, "User created.").otherwise("User removed."), NO_USER))
    return of_orders.unionByName(people)


def _order_states(fixed: DataFrame, brought: DataFrame, start: DataFrame | None, hot_rows: int) -> DataFrame:
    """Every command of an order, and every removal brought to it that counts, with the state ``before`` it.

    Orders whose commands are too many for one task, and those to which the same removal is brought twice, go in rounds.
    """
    rows = fixed.unionByName(brought, allowMissingColumns=True).withColumn("key", F.col("order_id"))
    hot, _ = hot_keys(rows, "key", hot_rows)
    again = brought.where("order_id is not null").groupBy("order_id", "seq", "made_by").count().where("count > 1")
    apart = written(again.select("order_id").unionByName(
        fixed.sparkSession.createDataFrame([(k,) for k in hot], fixed.select("order_id").schema)).distinct(), "apart")
    if apart.isEmpty():
        return _in_one_pass(rows, start)
    by_key = apart.withColumnRenamed("order_id", "key")
    some = None if start is None else start.join(by_key, "key", "left_semi")
    rounds = _in_rounds(fixed.join(apart, "order_id", "left_semi"), brought.join(apart, "order_id", "left_semi"), some, hot_rows)
    done = _in_one_pass(rows.join(by_key, "key", "left_anti"), start)
    return done.unionByName(rounds.select(done.columns))


HELD, OTHER, VOID = len(ORDER), len(ORDER) + 1, len(ORDER) + 2


def _in_one_pass(rows: DataFrame, start: DataFrame | None) -> DataFrame:
    """One walk along each order: a brought removal counts if the order still is, or last was, the one of ``made_by``.

    Whether it counts depends only on what came before it, so one sorted pass settles it. An order takes
    two numbers of memory, its state and the creation that made it, which go on from batch to batch.
    """
    names = ["verb", "user_id", "order_id", "t", "seq"]
    rows = rows.select("key", *names, "made_by", F.lit(None).cast("int").alias("start_"))
    if start is not None:
        rows = rows.unionByName(start.where(F.col("key").isNotNull()).select(
            "key", F.col("state").cast("int").alias("start_")), allowMissingColumns=True)
    rows = (rows.repartition("key", F.when(F.col("key").isNull(), F.xxhash64("t", "seq")))
            .sortWithinPartitions("key", F.col("start_").isNull(), "t", "seq"))
    schema = ", ".join([f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names] + ["before int"])
    create, cascade = list(ORDER).index("create"), list(ORDER).index("cascade")
    # held, other verbs, and brought removals that can belong to no creation change nothing
    after = [*ORDER.values(), *[(ABSENT, THERE, LOCKED)] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, born = None, ABSENT, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, seqs, made_by = (batch.column(c) for c in ("key", "seq", "made_by"))
            first = pc.fill_null(batch.column("start_"), -1).to_numpy(zero_copy_only=False)
            verbs = batch.column("verb")
            codes = pc.fill_null(pc.index_in(verbs, pa.array([*ORDER, "held"], verbs.type)), OTHER).to_numpy(zero_copy_only=False).copy()
            known = pc.and_(pc.and_(keys.is_valid(), seqs.is_valid()), made_by.is_valid()).to_numpy(zero_copy_only=False)
            codes[(codes == cascade) & ~known] = VOID
            codes[first >= 0] = OTHER
            makers = pc.fill_null(made_by, 0).to_numpy(zero_copy_only=False).tolist()
            numbers = seqs.to_pylist() if seqs.null_count else seqs.to_numpy(zero_copy_only=False).tolist()
            codes = codes.tolist()
            before, keep = [ABSENT] * len(codes), [True] * len(codes)
            starts = starts_of(keys).tolist()
            for low, high in zip(starts, [*starts[1:], len(codes)]):
                key = keys[low].as_py()
                if low or key is None or key != last:
                    state, born = max(int(first[low]), ABSENT), None
                for i in range(low, high):
                    code = codes[i]
                    before[i] = state
                    if code == cascade:
                        if born != makers[i]:
                            keep[i] = False
                            continue
                    elif code == HELD or code == create and state == ABSENT:
                        born = numbers[i]
                    elif code == VOID:
                        keep[i] = False
                    state = after[code][state]
                    if key is None:  # a command without key stands alone
                        state = ABSENT
            last = keys[-1].as_py()
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(before, pa.int32())], names=[*names, "before"])
            yield out.filter(pa.array(np.array(keep) & (first < 0)))
    return rows.mapInArrow(run, schema)


def _in_rounds(fixed: DataFrame, brought: DataFrame, start: DataFrame | None, hot_rows: int) -> DataFrame:
    """The same in rounds until nothing changes, none of which needs an order in one task."""
    valid = brought
    while True:
        rows = fixed.unionByName(valid, allowMissingColumns=True).withColumn("key", F.col("order_id"))
        states = written(with_states(rows, ORDER, start, hot_rows), "order-lives")
        made = (F.col("verb") == "held") | (F.col("verb") == "create") & (F.col("before") == ABSENT)
        # what a user's removal brings counts only while the order is the one this user created
        marked = states.unionByName(brought.join(valid.select("seq", "order_id", "made_by"), ["seq", "order_id", "made_by"], "left_anti")
                                    .withColumn("key", F.col("order_id")), allowMissingColumns=True)
        lives_ = guarded_ledger(marked.withColumn("delta", F.when(F.coalesce(made, F.lit(False)), 1).otherwise(0).cast("bigint")), None, hot_rows)
        lives_ = written(lives_.select("verb", "order_id", "seq", "made_by", "before", F.col("balance").alias("life")), "order-ends")
        births = lives_.where(made).select(F.col("seq").alias("made_by"), F.col("life"), "order_id")
        now = written(brought.join(lives_.where("verb = 'cascade'").select("order_id", "seq", "made_by", "life"), ["order_id", "seq", "made_by"])
                      .join(births, ["order_id", "made_by", "life"], "left_semi").select(brought.columns), "brought")
        keys = ["order_id", "seq", "made_by"]
        same = now.join(valid, keys, "left_anti").isEmpty() and valid.join(now, keys, "left_anti").isEmpty()
        if same:
            break
        valid = now
    return states


def _answer(reason, success, failure):
    result, _ = outcome(reason, "", failure)
    text = (F.when(reason.isNull(), success).when(reason == failure, reason).otherwise(F.concat(F.lit(v.MANAGED), reason)))
    return result, text.alias("message")
