"""Guarded ledgers against a plain loop, on ordinary and on hot keys."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tillflow.operators import ledger


def loop(commands, opening):
    balance, out = dict(opening), []
    for key, t, seq, delta in sorted(commands, key=lambda c: (c[0], c[1], c[2])):
        now = balance.get(key, 0)
        ok = now + delta >= 0
        balance[key] = now + delta if ok else now
        out.append((key, seq, ok, balance[key]))
    return sorted(out), balance


def made(kind, rows=3000, seed=5):
    rng = random.Random(seed)
    low, high = {"dry": (-60, 40), "rich": (-10, 40), "tight": (-7, 7)}[kind]
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", t // 3, t, rng.randint(low, high) or 1)
            for t in range(rows)]


def frames(spark, commands, opening):
    return (spark.createDataFrame(commands, "key string, t bigint, seq bigint, delta bigint"),
            spark.createDataFrame(list(opening.items()), "key string, opening bigint"))


@pytest.mark.parametrize("kind", ["dry", "rich", "tight"])
@pytest.mark.parametrize("hot_rows", [10_000, 70])
def test_every_command_as_in_a_loop(spark, kind, hot_rows):
    commands, opening = made(kind), {"hot": 55, "k1": 10}
    want, balances = loop(commands, opening)
    df, first = frames(spark, commands, opening)
    got = ledger.guarded_ledger(df, first, hot_rows).collect()
    assert sorted((r.key, r.seq, r.accepted, r.balance) for r in got) == want
    closing = ledger.guarded_balance(df, first, hot_rows).collect()
    assert {r.key: r.balance for r in closing} == {**opening, **balances}
    assert sum(r.n_accepted + r.n_rejected for r in closing) == len(commands)
    assert sum(r.n_rejected for r in closing) == sum(not ok for _, _, ok, _ in want)


def test_balance_is_carried_over_arrow_batches(spark):
    commands, opening = made("dry"), {}
    df, first = frames(spark, commands, {"other": 3})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ledger.guarded_ledger(df, first).collect()
        closing = ledger.guarded_balance(df, first).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, balances = loop(commands, opening)
    assert sorted((r.key, r.seq, r.accepted, r.balance) for r in got) == want
    assert {r.key: r.balance for r in closing} == {**balances, "other": 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=30), st.integers(0, 60), st.integers(0, 60))
def test_a_piece_holds_for_every_start_inside(deltas, start, other):
    def run(b):
        for d in deltas:
            b = b + d if b + d >= 0 else b
        return b
    lo, hi, shift = ledger.replay_piece(iter([np.array(deltas)]), start)
    assert lo <= start < hi and start + shift == run(start)
    if lo <= other < hi:
        assert other + shift == run(other)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=2, max_size=30), st.integers(0, 60), st.data())
def test_pieces_extend(deltas, start, data):
    cut = data.draw(st.integers(1, len(deltas) - 1))
    state = (start, 0, ledger.UNBOUNDED, 0)
    for part in (deltas[:cut], deltas[cut:]):
        state = ledger._extend(state, np.array(part))
    whole = ledger.replay_piece(iter([np.array(deltas)]), start)
    assert state[3] == whole[2] and state[1] <= start < state[2]
    for other in range(state[1], min(state[2], 80)):
        b = other
        for d in deltas:
            b = b + d if b + d >= 0 else b
        assert b == other + state[3]


def test_hot_and_ordinary_keys_give_the_same_with_gaps(spark):
    """Openings that repeat, keys without commands, and commands without key or delta."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), i // 3, i, rng.choice([None, *range(-9, 10)])) for i in range(400)]
    commands = spark.createDataFrame(rows, "key string, t bigint, seq bigint, delta bigint")
    opening = spark.createDataFrame([("a", 6), ("a", 5), ("h", 9), (None, 3)], "key string, opening bigint")
    sizes = spark.createDataFrame([(k,) for k in ["a", "b", "h", None] for _ in range(60)], "key string")
    for fold in (ledger.guarded_ledger, ledger.guarded_balance):
        plain = fold(commands, opening)
        split = fold(commands, opening, hot_rows=40, sized_by=sizes)
        same = sorted(plain.columns)
        assert sorted(map(repr, plain.select(*same).collect())) == sorted(map(repr, split.select(*same).collect()))
    done = ledger.guarded_ledger(commands, opening)
    assert done.count() == 400 and done.where("accepted and (key is null or delta is null)").count() == 0
    assert {r.key: (r.balance, r.n_accepted) for r in ledger.guarded_balance(commands, opening).collect()}["h"] == (9, 0)
