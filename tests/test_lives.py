"""State machines over histories, and the lives of users and orders, against plain walks."""

import random

import pytest

from tillflow.operators import histories, lifecycle

MACHINE = {"up": (1, 2, 3, 3), "down": (0, 0, 1, 2), "end": (0, 0, 0, 0), "swap": (3, 1, 2, 0)}


@pytest.mark.parametrize("hot,batch", [(10**6, 11), (10**6, 1000), (70, 13)])
def test_states(spark, hot, batch):
    rng = random.Random(hot + batch)
    keys = ["hot"] * 6 + [None] + [f"k{i}" for i in range(9)]
    rows = [(rng.choice(keys), rng.randrange(300), i, rng.choice([*MACHINE, "unheard of"])) for i in range(600)]
    initial = [("hot", 2), ("k1", 3), ("idle", 1), (None, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = histories.with_states(spark.createDataFrame(rows, "key string, t long, seq long, verb string"), MACHINE,
                                    spark.createDataFrame(initial, "key string, state int"), hot).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at, want = dict(initial), {}
    for k, t, seq, verb in sorted(rows, key=lambda r: r[1:3]):
        want[seq] = 0 if k is None else at.get(k, 0)
        if k is not None and verb in MACHINE:
            at[k] = MACHINE[verb][at.get(k, 0)]
    assert {r.seq: r.before for r in got} == want


def walk(commands, users, orders):
    """One command after the other, as the services would."""
    there, owned, state = set(users), {}, {}
    for o, u, locked in orders:
        state[o] = "locked" if locked else "free"
        owned.setdefault(u, set()).add(o)
    out = []

    def say(verb, u, o, seq, result, message):
        out.append((verb, u, o, seq, result, message))

    def remove(verb, u, o, seq):
        if o not in state:
            say(verb, u, o, seq, "error", "Managed Exception: Entry 'order' with the given ID does not exist.")
        elif state[o] == "locked":
            say(verb, u, o, seq, "error", "Managed Exception: Cannot remove order.")
        else:
            del state[o]
            for own in owned.values():
                own.discard(o)
            say(verb, u, o, seq, "success", "Order removed.")

    for verb, u, o, t, seq in sorted(commands, key=lambda c: c[3:]):
        if verb == "users/create":
            new = u not in there
            there.add(u)
            say(verb, u, o, seq, *(("success", "User created.") if new else ("error", "Managed Exception: User already exists.")))
        elif verb == "users/remove":
            if u not in there:
                say(verb, u, o, seq, "error", "Managed Exception: Entry 'user' with the given ID does not exist.")
                continue
            there.discard(u)
            for own in sorted(owned.pop(u, ())):
                remove("cascade", u, own, seq)
            say(verb, u, o, seq, "success", "User removed.")
        elif verb == "orders/create":
            if o in state:
                say(verb, u, o, seq, "error", "Managed Exception: Order already exists.")
            elif u not in there:
                say(verb, u, o, seq, "failure", "Order not created. User did not exist.")
            else:
                state[o] = "free"
                owned.setdefault(u, set()).add(o)
                say(verb, u, o, seq, "success", "Order created.")
        elif verb == "orders/remove":
            remove(verb, u, o, seq)
        elif o in state:
            state[o] = "locked"
    return out


@pytest.mark.parametrize("seed,hot", [(1, 10**6), (2, 10**6), (3, 60)])
def test_lives(spark, seed, hot):
    rng = random.Random(seed)
    commands = []
    for i in range(400):
        verb = rng.choice(["users/create", "users/remove", "orders/create", "orders/create", "orders/create", "orders/remove", "orders/lock"])
        if verb == "orders/lock" and rng.random() < 0.6:
            continue
        u, o = f"u{rng.randrange(5)}", None if verb.startswith("users") else f"o{rng.randrange(12)}"
        commands.append((verb, u, o, rng.randrange(1000), i))
    users, orders = ["u1", "u2"], [("o1", "u1", False), ("o2", "u1", True), ("o3", "u3", False)]
    got = lifecycle.lives(
        spark.createDataFrame(commands, "verb string, user_id string, order_id string, t long, seq long"),
        spark.createDataFrame([(u,) for u in users], "user_id string"),
        spark.createDataFrame(orders, "order_id string, user_id string, locked boolean"), hot)
    rows = sorted(((r.verb, r.user_id, r.order_id, r.seq, r.result, r.message) for r in got.collect()), key=repr)
    assert rows == sorted(walk(commands, users, orders), key=repr)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_lives_of_ordinary_orders_go_in_one_pass(spark, monkeypatch, batch):
    def refused(*_):
        raise AssertionError("rounds over orders that fit one task")

    monkeypatch.setattr(lifecycle, "_in_rounds", refused)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        test_lives(spark, 4, 10**6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_order_created_twice_in_one_line_goes_in_rounds(spark):
    schema = "verb string, user_id string, order_id string, t long, seq long"
    twice = [("orders/create", "u", "a", 1, 1)] * 2 + [("orders/create", "u", "b", 2, 2), ("users/remove", "u", None, 3, 3),
                                                      ("orders/remove", "u", None, 4, 4), ("orders/remove", "u", "b", 5, 5)]
    got = lifecycle.lives(spark.createDataFrame(twice, schema), spark.createDataFrame([("u",)], "user_id string")).collect()
    rows = sorted((r.order_id or "", r.seq, r.verb, r.result) for r in got)
    assert rows == [("", 3, "users/remove", "success"), ("", 4, "orders/remove", "error"), ("a", 1, "orders/create", "error"),
                    ("a", 1, "orders/create", "success"), ("a", 3, "cascade", "success"), ("b", 2, "orders/create", "success"),
                    ("b", 3, "cascade", "success"), ("b", 5, "orders/remove", "error")]
