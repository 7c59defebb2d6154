"""Ledgers of claims: what may be tried again after it failed, and taken back after it worked.

A claim is one thing an account can be charged for once, such as the payment
of an order. Commands of an account are applied in order: a charge counts if
its claim is not held and the balance covers it; it then holds the claim, and a
further one is refused. Giving back a held claim returns what was charged and
leaves it free for another try. Plain moves of the account stand between them.

Whether a charge counts depends on the balance and on its claim, both on all
earlier commands of the account, so balance and claims are carried together
over the sorted commands. Accounts with more than ``hot_rows`` commands are
settled in rounds instead: the ledger in chunks says what fits, a pass by
claim says which charges that leaves, until nothing changes. What precedes the
first wrong command of an account is right, so each round mends at least it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillflow.operators.ledger import apply_guard, guarded_ledger
from tillflow.operators.skew import hot_keys, split_hot
from tillflow.session import written

# an account's claims are held in memory while its commands pass, some 100 bytes each
HOT_ROWS = 1_000_000
OK, SHORT, HELD, FREE, ABSENT, UNKNOWN, VOID = "ok", "short", "held", "free", "absent", "unknown", "void"
RETURNED = "returned"
RESULT = ["accepted", "balance", "outcome", "claim_state"]


def claim_ledger(commands: DataFrame, opening: DataFrame, hot_rows: int = HOT_ROWS,
                 sized_by: DataFrame | None = None) -> DataFrame:
    """Every command with ``accepted``, the ``balance`` after it, its ``outcome`` and the ``claim_state`` after it.

    ``commands`` has ``key`` (the account), the order (``t``, ``seq``), a signed
    ``delta``, ``claim``, ``give_back`` and any further columns; ``opening`` has ``key``
    and ``opening`` >= 0, several of a key add up. Without a claim a command is a
    plain move. Outcomes: ``ok``; ``short`` of balance; ``held`` already; not held, so ``free``
    or never tried, so ``absent`` when given back; ``unknown`` account; ``void`` without
    key or, unless its claim is held, without delta. A claim's state is ``held``,
    ``short``, ``void`` or ``returned``, null if it was never tried. Commands without key
    are spread and change nothing.
    """
    opening = opening.where(F.col("key").isNotNull())
    hot, limit = hot_keys(commands, "key", hot_rows, sized_by)
    if not hot:
        return _carried(commands, opening)
    hot_part, rest = split_hot(commands, "key", hot)
    hot_open, opening = split_hot(opening, "key", hot)
    return _carried(rest, opening).unionByName(_in_rounds(hot_part, hot_open, limit))


def _carried(commands: DataFrame, opening: DataFrame) -> DataFrame:
    first = opening.select("key", F.col("opening").cast("bigint").alias("delta"), F.lit(True).alias("is_opening"))
    rows = (commands.withColumn("is_opening", F.lit(False)).unionByName(first, allowMissingColumns=True)
            .repartition("key", F.when(F.col("key").isNull(), F.xxhash64("t", "seq")))
            .sortWithinPartitions("key", F.col("is_opening").desc(), "t", "seq"))
    names = commands.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in commands.schema]
                       + ["accepted boolean", "balance bigint", "outcome string", "claim_state string"])
    return rows.mapInArrow(lambda batches: _fold(batches, names), schema)


# -- inside a task -----------------------------------------------------------------

class Account:
    """Balance and claims of the account whose commands pass; None as balance if it is unknown."""

    def __init__(self):
        self.balance, self.claims = None, {}

    def apply(self, delta, claim, give_back) -> tuple[bool, str, str | None]:
        """(accepted, outcome, claim state); a held claim is stored with what was charged for it."""
        if claim is None:
            if self.balance is None or delta is None:
                return False, VOID if delta is None else UNKNOWN, None
            fits = self.balance + delta >= 0
            self.balance += delta if fits else 0
            return fits, OK if fits else SHORT, None
        state = self.claims.get(claim)
        held = isinstance(state, int)
        if give_back:
            if not held:
                return False, ABSENT if state is None else FREE, state
            self.balance += state
            self.claims[claim] = RETURNED
            return True, OK, RETURNED
        if held:
            return False, HELD, HELD
        if delta is None or self.balance is None:
            self.claims[claim] = VOID
            return False, VOID if delta is None else UNKNOWN, VOID
        if self.balance + delta < 0:
            self.claims[claim] = SHORT
            return False, SHORT, SHORT
        self.balance += delta
        self.claims[claim] = -delta
        return True, OK, HELD


def _fold(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    last_key, account = None, Account()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, claims = batch.column("key"), batch.column("claim")
        codes = pc.fill_null(pc.dictionary_encode(keys).indices, -1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        ends = np.append(starts[1:], n)
        run_of = np.repeat(np.arange(len(starts)), ends - starts)
        same = keys[0].as_py() is not None and keys[0].as_py() == last_key
        opening = batch.column("is_opening").to_numpy(zero_copy_only=False).astype(bool)
        whole = batch.column("delta").is_valid().to_numpy(zero_copy_only=False)
        delta = pc.fill_null(batch.column("delta"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        back = pc.fill_null(batch.column("give_back"), False).to_numpy(zero_copy_only=False).astype(bool)
        claim = pc.fill_null(pc.dictionary_encode(claims).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)

        # accounts whose claims are each tried once and whose commands are whole need no walk
        plain = opening[starts].copy()
        plain[run_of[back | ~whole]] = False
        pair = run_of[claim >= 0] * (n + 1) + claim[claim >= 0]
        met, counts = np.unique(pair, return_counts=True)
        plain[met[counts > 1] // (n + 1)] = False
        plain[codes[starts] == -1] = False
        if same:
            plain[0] = False
        in_plain = plain[run_of]
        accepted, balance = apply_guard(np.where(in_plain, delta, 0), starts, 0)
        accepted &= in_plain
        outcome = np.where(accepted, OK, SHORT).astype(object)
        state = np.where(claim >= 0, np.where(accepted, HELD, SHORT), None).astype(object)
        known = in_plain.copy()
        for run in np.flatnonzero(~plain):
            lo, hi = int(starts[run]), int(ends[run])
            if codes[lo] == -1:
                outcome[lo:hi], state[lo:hi], accepted[lo:hi] = VOID, None, False
                continue
            if not (run == 0 and same):
                account = Account()
            names_ = claims.slice(lo, hi - lo).to_pylist()
            for i in range(lo, hi):
                if opening[i]:
                    account.balance = (account.balance or 0) + int(delta[i])
                    continue
                accepted[i], outcome[i], state[i] = account.apply(int(delta[i]) if whole[i] else None, names_[i - lo], back[i])
                known[i] = account.balance is not None and outcome[i] != VOID
                balance[i] = account.balance or 0
        if plain[-1]:
            account, lo = Account(), int(starts[-1])
            account.balance = int(balance[-1])
            account.claims = {c: -int(d) if a else SHORT for c, d, a in zip(
                claims.slice(lo).to_pylist(), delta[lo:], accepted[lo:]) if c is not None}
        last_key = keys[-1].as_py()
        columns = [batch.column(c) for c in names] + [
            pa.array(accepted), pa.array(balance, pa.int64(), mask=~known), pa.array(outcome, pa.string()), pa.array(state, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, *RESULT]).filter(pa.array(~opening))


# -- hot accounts ------------------------------------------------------------------

def _in_rounds(commands: DataFrame, opening: DataFrame, hot_rows: int) -> DataFrame:
    names = commands.columns
    known = opening.select("key", F.lit(True).alias("known")).distinct()
    rows = written(commands.join(F.broadcast(known), "key", "left")  # one row a hot key
                   .withColumn("effect", F.when(F.coalesce("give_back", F.lit(False)), 0).otherwise(F.col("delta"))), "claims")
    while True:
        ledger = guarded_ledger(rows.withColumnRenamed("delta", "asked").withColumn("delta", F.coalesce("effect", F.lit(0))),
                                opening, hot_rows)
        before = F.col("balance") - F.when(F.col("accepted"), F.col("delta")).otherwise(0)
        fits = ledger.withColumn("fits", before + F.coalesce("asked", F.lit(0)) >= 0).drop("accepted")
        done = written(_by_claim(fits), "rounds")
        if done.where("effect <> next_effect").isEmpty():
            break
        rows = done.select(*[c for c in names if c != "delta"], F.col("asked").alias("delta"), "known", F.col("next_effect").alias("effect"))
    return done.select(*[F.col("asked").alias("delta") if c == "delta" else F.col(c) for c in names], "accepted",
                       F.when(F.col("known").isNotNull() & (F.col("outcome") != VOID), F.col("balance")).alias("balance"),
                       "outcome", "claim_state")


def _by_claim(rows: DataFrame) -> DataFrame:
    """Each command's outcome and its effect, from whether it fits and from the earlier ones of its claim."""
    # moves without a claim stand for themselves, so they are spread
    sorted_ = (rows.repartition("key", F.coalesce(F.col("claim").cast("string"), F.xxhash64("t", "seq").cast("string")))
               .sortWithinPartitions("key", "claim", "t", "seq"))
    names = [c for c in sorted_.columns if c != "fits"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "fits"]
                       + ["accepted boolean", "outcome string", "claim_state string", "next_effect bigint"])

    def run(batches):
        last, account = None, Account()
        for batch in batches:
            made = [[], [], [], []]
            for key, claim, asked, back, known, fits in zip(*[
                    batch.column(c).to_pylist() for c in ("key", "claim", "asked", "give_back", "known", "fits")]):
                if claim is None or (key, claim) != last:
                    last, account = (key, claim), Account()
                # only the claim's state counts here: the balance is as large as it must be
                account.balance = None if not known else (1 << 62) if fits or asked is None else 0
                was = account.balance
                for column, value in zip(made, account.apply(asked, claim, back)):
                    column.append(value)
                made[3].append(0 if account.balance is None else account.balance - was)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(made[0], pa.bool_()), pa.array(made[1], pa.string()),
                                                    pa.array(made[2], pa.string()), pa.array(made[3], pa.int64())],
                names=[*names, "accepted", "outcome", "claim_state", "next_effect"])
    return sorted_.mapInArrow(run, schema)
