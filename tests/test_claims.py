"""Ledgers of claims against one walk over all commands, also with hot accounts and small batches."""

import random

import pytest

from tillflow.operators import claims

COMMANDS = "key string, t long, seq long, delta long, claim string, give_back boolean, note string"


def walk(commands, opening):
    """Every command's outcome, one after the other."""
    balance = {}
    for k, o in opening:
        if k is not None:
            balance[k] = balance.get(k, 0) + o
    held, out = {}, {}
    for k, t, seq, delta, claim, back, _ in sorted(commands, key=lambda c: c[1:3]):
        if k is None:
            out[seq] = (False, None, "void", None)
            continue
        state = held.get((k, claim)) if claim is not None else None
        got = balance.get(k)
        if back and claim is not None:
            if isinstance(state, int):
                balance[k] += state
                held[k, claim] = "returned"
                out[seq] = (True, balance[k], "ok", "returned")
            else:
                out[seq] = (False, got, "absent" if state is None else "free", state)
            continue
        if isinstance(state, int):
            out[seq] = (False, got, "held", "held")
        elif delta is None or got is None:
            if claim is not None:
                held[k, claim] = "void"
            out[seq] = (False, None, "void" if delta is None else "unknown", None if claim is None else "void")
        elif got + delta < 0:
            if claim is not None:
                held[k, claim] = "short"
            out[seq] = (False, got, "short", None if claim is None else "short")
        else:
            balance[k] = got + delta
            if claim is not None:
                held[k, claim] = -delta
            out[seq] = (True, balance[k], "ok", None if claim is None else "held")
    return out


def history(seed, keys, n, repeats):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(keys)
        claim = None if rng.random() < 0.3 else f"{k}/{rng.randrange(repeats)}"
        back = claim is not None and rng.random() < 0.25
        price = None if claim and rng.random() < 0.05 else -rng.randrange(40)
        delta = rng.randrange(-20, 30) if claim is None else price
        out.append((k, rng.randrange(n), i, delta, claim, back, f"n{i}"))
    return out


@pytest.mark.parametrize("seed,keys,n,repeats,hot,batch", [
    (1, ["a", "b", "c", None, "lost"], 600, 12, 10**6, 7), (2, [f"k{i}" for i in range(80)], 500, 3, 10**6, 1000),
    (3, ["a", "b", "c", None, "lost"], 500, 10, 60, 50), (4, ["hot", "hot", "hot", "x", "y"], 700, 200, 100, 1000)])
def test_against_one_walk(spark, seed, keys, n, repeats, hot, batch):
    commands = history(seed, keys, n, repeats)
    opening = [(k, 15) for k in sorted({k for k in keys if k not in (None, "lost")})] + [(keys[0], 10), (None, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = claims.claim_ledger(spark.createDataFrame(commands, COMMANDS), spark.createDataFrame(opening, "key string, opening long"), hot)
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = walk(commands, opening)
    assert len(rows) == n and {r.note for r in rows} == {f"n{i}" for i in range(n)}
    for r in rows:
        assert (r.accepted, r.balance, r.outcome, r.claim_state) == want[r.seq], (r, want[r.seq])
    assert {w[2] for w in want.values()} >= {"ok", "short", "held", "free"}


def test_empty(spark):
    none = spark.createDataFrame([], COMMANDS)
    assert claims.claim_ledger(none, spark.createDataFrame([("a", 1)], "key string, opening long")).count() == 0
