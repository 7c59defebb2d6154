"""Guarded ledgers: balances that never go below zero.

Commands of one key are applied in order. A deposit always counts; a
withdrawal counts only if the balance covers it, else it is rejected and the
balance stays. Whether a command counts depends on which earlier ones did, so
no window function expresses it.

Two ways lead to the same rows:

* Ordinary keys: one shuffle by key, a sort inside each partition, and a pass
  over Arrow batches that carries only (key, balance) from batch to batch.
* Keys with more than ``hot_rows`` commands: their history is cut into
  time-ordered chunks of bounded size that are worked on in parallel. For a
  start balance b inside [lo, hi) a chunk accepts the same commands, so it ends
  with b + shift. One replay from a guessed start gives one such piece.
  Rounds of replays go on until every chunk's true start balance falls in a
  known piece; each round settles at least one more chunk of each key, and
  all chunks at once for keys that never, or often, run dry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tillflow.operators.skew import hot_keys, split_hot
from tillflow.session import written

HOT_ROWS = 20_000_000
UNBOUNDED = 1 << 62


def guarded_ledger(commands: DataFrame, opening: DataFrame | None = None,
                   hot_rows: int = HOT_ROWS, sized_by: DataFrame | None = None, opened: bool = False) -> DataFrame:
    """Every command with ``accepted`` and the ``balance`` after it; with ``opened`` also whether its key has an opening.

    ``commands`` has ``key``, the order (``t``, ``seq``), a signed ``delta``
    and any further columns; ``opening`` has ``key`` and ``opening`` >= 0;
    several openings of a key add up. A command without key or delta is never
    accepted and changes nothing.
    ``sized_by`` helps to find the hot keys, see ``skew.hot_keys``.
    """
    return _fold(commands, opening, hot_rows, sized_by, True, opened)


def guarded_balance(commands: DataFrame, opening: DataFrame | None = None,
                    hot_rows: int = HOT_ROWS, sized_by: DataFrame | None = None) -> DataFrame:
    """Per key the final ``balance`` and the counts of accepted and rejected.

    Keys that only have an opening keep it; rows without key are left out.
    """
    commands = commands.where(F.col("key").isNotNull()).select("key", "t", "seq", "delta")
    return _fold(commands, opening, hot_rows, sized_by, each_command=False)


def _fold(commands, opening, hot_rows, sized_by, each_command, opened=False):
    if opening is not None:
        opening = opening.where(F.col("key").isNotNull())
    hot, limit = hot_keys(commands, "key", hot_rows, sized_by)
    if not hot:
        return _fold_by_key(commands, opening, each_command, opened)
    hot_part, rest = split_hot(commands, "key", hot)
    hot_open = None
    if opening is not None:
        hot_open, opening = split_hot(opening, "key", hot)
    chunks = -(-sum(hot.values()) // limit) + len(hot)
    in_chunks = _fold_in_chunks(hot_part, hot_open, int(chunks), each_command)
    if opened:  # of hot keys only, so the openings are few
        flag = F.lit(None).cast("boolean") if hot_open is None else F.col("opened_")
        if hot_open is not None:
            has = hot_open.select("key").distinct().withColumn("opened_", F.lit(True))
            in_chunks = in_chunks.join(F.broadcast(has), "key", "left")
        in_chunks = in_chunks.withColumn("opened", F.coalesce(flag, F.lit(False))).drop("opened_")
    return _fold_by_key(rest, opening, each_command, opened).unionByName(in_chunks)


def _as_commands(commands, opening):
    """Opening balances become a deposit ahead of every command of the key."""
    flagged = commands.withColumn("is_opening", F.lit(False))
    if opening is None:
        return flagged
    first = opening.select(
        "key", F.col("opening").cast("bigint").alias("delta"), F.lit(True).alias("is_opening"))
    return flagged.unionByName(first, allowMissingColumns=True)


def _schema(commands, each_command, opened=False):
    if each_command:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in commands.schema]
                         + ["accepted boolean", "balance bigint"] + ["opened boolean"] * opened)
    key = commands.schema["key"].dataType.simpleString()
    return f"key {key}, balance bigint, n_accepted bigint, n_rejected bigint"


def _fold_by_key(commands, opening, each_command, opened=False):
    rows = (_as_commands(commands, opening)
            # rows without key need no order, so they are spread
            .repartition("key", F.when(F.col("key").isNull(), F.xxhash64("t", "seq")))
            .sortWithinPartitions("key", F.col("is_opening").desc(), "t", "seq"))
    if not each_command:
        rows = rows.select("key", "delta", "is_opening")
    names = commands.columns
    fold = (lambda batches: _per_command(batches, names, opened)) if each_command else _per_key
    return rows.mapInArrow(fold, _schema(commands, each_command, opened))


# -- inside a task -----------------------------------------------------------------

def apply_guard(delta: np.ndarray, starts: np.ndarray, first: int):
    """Acceptance and balance per row; runs of equal keys begin at ``starts``.

    ``first`` is the balance carried into the first run. Runs that stay above
    zero are done with one cumulative sum; only the others are walked.
    """
    running = np.cumsum(delta)
    base = np.concatenate(([-first], running[starts[1:] - 1]))
    ends = np.append(starts[1:], len(delta))
    balance = running - np.repeat(base, ends - starts)
    accepted = np.ones(len(delta), dtype=bool)
    for run in np.flatnonzero(np.minimum.reduceat(balance, starts) < 0):
        lo, hi = starts[run], ends[run]
        now, kept, level = (first if run == 0 else 0), [], []
        for step in delta[lo:hi].tolist():
            fits = now + step >= 0
            if fits:
                now += step
            kept.append(fits)
            level.append(now)
        accepted[lo:hi], balance[lo:hi] = kept, level
    return accepted, balance


def _deltas(batch) -> tuple[np.ndarray, np.ndarray]:
    """The changes, 0 where key or delta is missing, and which rows are whole."""
    whole = pc.and_(pc.is_valid(batch.column("key")), pc.is_valid(batch.column("delta")))
    delta = pc.if_else(whole, batch.column("delta"), pa.scalar(0, batch.column("delta").type))
    return delta.to_numpy(zero_copy_only=False), whole.to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]):
    """Guarded batches, with the balance of the last key carried along."""
    last_key, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        codes = pc.fill_null(pc.dictionary_encode(keys).indices, -1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        same = keys[0].as_py() == last_key
        delta, whole = _deltas(batch)
        accepted, balance = apply_guard(delta, starts, carried if same else 0)
        yield batch, keys, starts, same, accepted & whole, balance
        last_key, carried = keys[-1].as_py(), int(balance[-1])


def _per_command(batches, names, opened=False):
    held = False  # whether the last key has an opening
    for batch, _, starts, same, accepted, balance in _runs(batches):
        columns = [batch.column(n) for n in names] + [pa.array(accepted), pa.array(balance)]
        if opened:  # openings come first
            has = batch.column("is_opening").to_numpy(zero_copy_only=False)[starts]
            has[0] |= same and held
            held = bool(has[-1])
            columns.append(pa.array(np.repeat(has, np.diff(np.append(starts, batch.num_rows)))))
        out = pa.RecordBatch.from_arrays(columns, names=[*names, "accepted", "balance"] + ["opened"] * opened)
        yield out.filter(pc.invert(batch.column("is_opening")))


def _per_key(batches):
    def rows(keys, balance, ok, bad):
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(balance, pa.int64()), pa.array(ok, pa.int64()), pa.array(bad, pa.int64())],
            names=["key", "balance", "n_accepted", "n_rejected"])

    held = None  # the open key: (key array, balance, accepted, rejected)
    for batch, keys, starts, same, accepted, balance in _runs(batches):
        command = ~batch.column("is_opening").to_numpy(zero_copy_only=False)
        ok = np.add.reduceat((accepted & command).astype(np.int64), starts)
        bad = np.add.reduceat((~accepted & command).astype(np.int64), starts)
        last = np.append(starts[1:], len(accepted)) - 1
        if held is not None:
            if same:
                ok[0] += held[2]
                bad[0] += held[3]
            else:
                yield rows(held[0], [held[1]], [held[2]], [held[3]])
        if len(starts) > 1:
            yield rows(keys.take(pa.array(last[:-1])), balance[last[:-1]], ok[:-1], bad[:-1])
        held = (keys.take(pa.array(last[-1:])), int(balance[-1]), int(ok[-1]), int(bad[-1]))
    if held is not None:
        yield rows(held[0], [held[1]], [held[2]], [held[3]])


# -- hot keys ----------------------------------------------------------------------

PIECE = "chunk bigint, key {key}, lo bigint, hi bigint, shift bigint"


def replay_piece(deltas: Iterator[np.ndarray], start: int) -> tuple[int, int, int]:
    """(lo, hi, shift): any start in [lo, hi) accepts what ``start`` accepts."""
    now, lo, hi = start, 0, UNBOUNDED
    for delta in deltas:
        level = now + np.cumsum(delta)
        if level.min() >= 0:  # the whole stretch is accepted
            withdrawn = level[delta < 0]
            if len(withdrawn):
                lo = max(lo, start - int(withdrawn.min()))
            now = int(level[-1])
            continue
        for step in delta.tolist():
            if now + step >= 0:
                now += step
                if step < 0:
                    lo = max(lo, start - now)
            else:
                hi = min(hi, start - now - step)
    return lo, hi, now - start


def _fold_in_chunks(commands, opening, chunks, each_command):
    spark = commands.sparkSession
    key_type = commands.schema["key"].dataType.simpleString()
    # unique (key, t, seq) lets the range partitioner cut inside a key
    cut = (commands.repartitionByRange(chunks, "key", "t", "seq")
           .withColumn("chunk", F.spark_partition_id().cast("bigint"))
           .sortWithinPartitions("key", "t", "seq"))
    stored = written(cut, "ledger-chunks", "chunk")
    starts_at = {}
    if opening is not None:
        # one row per hot key
        starts_at = {r.key: r.opening for r in opening.groupBy("key").agg(F.sum("opening").alias("opening")).collect()}

    # a start no history can exhaust, and the emptiest one
    pieces: dict[tuple, list] = {}
    todo = None
    guesses = [UNBOUNDED >> 1, 0]
    while True:
        if todo is None:
            found = _replay(stored, None, guesses, key_type)
        else:
            wanted = spark.createDataFrame(
                [(c, k, b) for (c, k), b in todo.items()], f"chunk bigint, key {key_type}, start bigint")
            found = _replay(stored, wanted, None, key_type)
        for r in found.collect():  # one row per chunk and guess
            pieces.setdefault((r.chunk, r.key), []).append((r.lo, r.hi, r.shift))
        known, todo = _walk(pieces, starts_at)
        if not todo:
            break
    begin = spark.createDataFrame(
        [(c, k, b) for (c, k), b in known.items()], f"chunk bigint, key {key_type}, start bigint")
    done = _emit(stored, begin, commands, each_command)
    idle = [(k, b, 0, 0) for k, b in starts_at.items() if k not in {key for _, key in pieces}]
    if each_command or not idle:
        return done
    return done.unionByName(spark.createDataFrame(idle, _schema(commands, False)))


def _walk(pieces, starts_at):
    """Follow each key through its chunks; guess on where a piece is missing."""
    known, todo, at, sure = {}, {}, {}, {}
    for chunk, key in sorted(pieces):
        start = at.get(key, starts_at.get(key, 0))
        if sure.get(key, True):
            known[chunk, key] = start
        options = pieces[chunk, key]
        hit = next((p for p in options if p[0] <= start < p[1]), None)
        if hit is None:
            todo[chunk, key] = start
            sure[key] = False
            hit = min(options, key=lambda p: p[0] - start if start < p[0] else start - p[1])
        at[key] = max(0, start + hit[2])
    return known, todo


def _by_chunk(stored, starts):
    """Chunks with their start balance, each (chunk, key) sorted in one partition."""
    rows = stored if starts is None else stored.join(F.broadcast(starts), ["chunk", "key"])
    return rows.repartition("chunk").sortWithinPartitions("chunk", "key", "t", "seq")


def _stretches(batches, per_row=None):
    """Yield (chunk, key, batch slice) for each run of one chunk and key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk").to_numpy()
        code = pc.dictionary_encode(batch.column("key")).indices.to_numpy()
        edge = np.flatnonzero((chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            yield int(chunk[lo]), part.column("key")[0].as_py(), part


def _replay(stored, starts, guesses, key_type):
    rows = _by_chunk(stored, starts).select(
        "chunk", "key", "delta", *([] if starts is None else ["start"]))

    def run(batches):
        from itertools import groupby
        for (chunk, key), parts in groupby(_stretches(batches), key=lambda s: s[:2]):
            state = None
            for _, _, part in parts:
                tries = guesses or [part.column("start")[0].as_py()]
                state = state or [(b, 0, UNBOUNDED, 0) for b in tries]
                delta, _ = _deltas(part)
                state = [_extend(s, delta) for s in state]
            yield pa.RecordBatch.from_pylist(
                [{"chunk": chunk, "key": key, "lo": lo, "hi": hi, "shift": shift}
                 for _, lo, hi, shift in state],
                schema=pa.schema([("chunk", pa.int64()), ("key", part.column("key").type),
                                  ("lo", pa.int64()), ("hi", pa.int64()), ("shift", pa.int64())]))

    return rows.mapInArrow(run, PIECE.format(key=key_type))


def _extend(state, delta):
    """Carry a piece (start, lo, hi, shift) over the next commands."""
    start, lo, hi, shift = state
    more_lo, more_hi, more = replay_piece(iter([delta]), start + shift)
    return start, max(lo, more_lo - shift), min(hi, more_hi - shift), shift + more


def _emit(stored, begin, commands, each_command):
    rows = _by_chunk(stored, begin)
    names = commands.columns

    def run(batches):
        last, now = None, 0
        for chunk, key, part in _stretches(batches):
            if (chunk, key) != last:
                last, now = (chunk, key), part.column("start")[0].as_py()
            delta, whole = _deltas(part)
            accepted, balance = apply_guard(delta, np.array([0]), now)
            now = int(balance[-1])
            columns = [part.column(n) for n in names] + [pa.array(accepted & whole), pa.array(balance)]
            out = pa.RecordBatch.from_arrays(columns, names=[*names, "accepted", "balance"])
            yield out if each_command else out.append_column("chunk", part.column("chunk"))

    if each_command:
        return rows.mapInArrow(run, _schema(commands, True))
    folded = rows.mapInArrow(run, _schema(commands, True) + ", chunk bigint")
    return folded.groupBy("key").agg(
        F.max_by("balance", F.struct("chunk", "t", "seq")).alias("balance"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_rejected"))
