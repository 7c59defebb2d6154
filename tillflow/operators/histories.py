"""Histories of keys as runs of small state machines.

A machine has a few numbered states, 0 being the first, and names a function
from state to state for each verb. Functions compose associatively, so a key's
history need not lie in one task: what a stretch of it does to every state is
one short array. Ordinary keys take one shuffle and a pass over Arrow batches
that carries one number; within a batch all prefixes are composed at once by
doubling. Keys with more than ``hot_rows`` commands are cut into time-ordered
chunks; each chunk becomes one array, and the start states follow from these.
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
Machine = dict[str, tuple[int, ...]]


def with_states(commands: DataFrame, machine: Machine, initial: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                sized_by: DataFrame | None = None) -> DataFrame:
    """Every command with ``before``, the state of its key when it comes.

    ``commands`` has ``key``, the order (``t``, a unique ``seq``), ``verb`` and any further
    columns; ``initial`` has ``key`` and ``state``, one row a key. A verb the machine lacks
    changes nothing; a command without key meets state 0 and is spread.
    """
    hot, limit = hot_keys(commands, "key", hot_rows, sized_by)
    if not hot:
        return _by_key(commands, machine, initial)
    hot_part, rest = split_hot(commands, "key", hot)
    hot_initial = None
    if initial is not None:
        hot_initial, initial = split_hot(initial, "key", hot)
    chunks = int(-(-sum(hot.values()) // limit) + len(hot))
    return _by_key(rest, machine, initial).unionByName(_in_chunks(hot_part, machine, hot_initial, chunks))


def _schema(commands: DataFrame) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in commands.schema] + ["before int"])


def _by_key(commands, machine, initial):
    rows = commands.withColumn("start_", F.lit(None).cast("int"))
    if initial is not None:
        rows = rows.unionByName(initial.where(F.col("key").isNotNull()).select(
            "key", F.col("state").cast("int").alias("start_")), allowMissingColumns=True)
    rows = (rows.repartition("key", F.when(F.col("key").isNull(), F.xxhash64("t", "seq")))
            .sortWithinPartitions("key", F.col("start_").isNull(), "t", "seq"))
    names = commands.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            starts = starts_of(keys)
            start = pc.fill_null(batch.column("start_"), -1).to_numpy(zero_copy_only=False)
            first = np.maximum(start[starts], 0)
            if keys[0].as_py() is not None and keys[0].as_py() == last:
                first[0] = state
            functions = _functions(batch.column("verb"), machine)
            before, after = _walk(functions, starts, first)
            # a command without key stands alone
            before[~keys.is_valid().to_numpy(zero_copy_only=False)] = 0
            last, state = keys[-1].as_py(), int(after[-1])
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(before.astype(np.int32))],
                                             names=[*names, "before"])
            yield out.filter(pa.array(start < 0))
    return rows.mapInArrow(run, _schema(commands))


# -- inside a task -----------------------------------------------------------------

def starts_of(*columns) -> np.ndarray:
    """Where a run of equal values begins."""
    edge = None
    for c in columns:
        codes = pc.fill_null(pc.dictionary_encode(c).indices, -1).to_numpy(zero_copy_only=False)
        other = codes[1:] != codes[:-1]
        edge = other if edge is None else edge | other
    return np.flatnonzero(np.concatenate(([True], edge)))


def _functions(verbs: pa.Array, machine: Machine) -> np.ndarray:
    """For each row the states that each state turns into."""
    size = max(len(f) for f in machine.values())
    table = np.array([*machine.values(), tuple(range(size))], np.int8)
    at = pc.fill_null(pc.index_in(verbs, pa.array(list(machine), verbs.type)), len(machine))
    return table[at.to_numpy(zero_copy_only=False)]


def _prefixes(functions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The composition of each row's function with all before it in its run."""
    n = len(functions)
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    out, step = functions, 1
    longest = int(np.diff(np.append(starts, n)).max())
    while step < longest:
        at = np.flatnonzero(np.arange(n) - step >= begin)
        more = out.copy()
        more[at] = np.take_along_axis(out[at], out[at - step], axis=1)
        out, step = more, step * 2
    return out


def _walk(functions: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each row, from the runs' first states."""
    n = len(functions)
    begin = np.repeat(first, np.diff(np.append(starts, n)))
    after = np.take_along_axis(_prefixes(functions, starts), begin[:, None].astype(np.int64), axis=1)[:, 0].astype(np.int64)
    before = np.concatenate(([0], after[:-1]))
    before[starts] = first
    return before, after


# -- hot keys ----------------------------------------------------------------------

def _in_chunks(commands, machine, initial, chunks):
    spark = commands.sparkSession
    cut = (commands.repartitionByRange(chunks, "key", "t", "seq")
           .withColumn("chunk", F.spark_partition_id().cast("bigint")).sortWithinPartitions("key", "t", "seq"))
    stored = written(cut, "history", "chunk")
    ordered = stored.repartition("chunk").sortWithinPartitions("chunk", "key", "t", "seq")
    key = commands.schema["key"].dataType.simpleString()
    names = commands.columns

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                starts = starts_of(batch.column("chunk"), batch.column("key"))
                last = pa.array(np.append(starts[1:], batch.num_rows) - 1)
                done = _prefixes(_functions(batch.column("verb"), machine), starts)[last.to_numpy()]
                at = pa.array([int(x) for x in starts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").take(last), batch.column("key").take(last), batch.column("t").take(at),
                     batch.column("seq").take(at), pa.array(done.tolist(), pa.list_(pa.int32()))],
                    names=["chunk", "key", "t", "seq", "does"])

    starts = {r.key: r.state for r in initial.collect()} if initial is not None else {}  # one row a hot key
    begin, at = [], {}
    # some rows for each chunk and key: one for each Arrow batch
    for r in ordered.select("chunk", "key", "t", "seq", "verb").mapInArrow(
            compose, f"chunk bigint, key {key}, t bigint, seq bigint, does array<int>").orderBy("key", "chunk", "t", "seq").toLocalIterator():
        state = at.get(r.key, starts.get(r.key, 0))
        if not begin or begin[-1][:2] != (r.chunk, r.key):
            begin.append((r.chunk, r.key, state))
        at[r.key] = r.does[state]
    first = spark.createDataFrame(begin, f"chunk bigint, key {key}, first_ int")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts_ = starts_of(batch.column("chunk"), batch.column("key"))
            first_ = batch.column("first_").to_numpy()[starts_].copy()
            if (batch.column("chunk")[0].as_py(), batch.column("key")[0].as_py()) == last:
                first_[0] = state
            before, after = _walk(_functions(batch.column("verb"), machine), starts_, first_)
            last, state = (batch.column("chunk")[-1].as_py(), batch.column("key")[-1].as_py()), int(after[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(before.astype(np.int32))],
                                             names=[*names, "before"])

    rows = stored.join(F.broadcast(first), ["chunk", "key"]).repartition("chunk").sortWithinPartitions("chunk", "key", "t", "seq")
    return rows.mapInArrow(emit, _schema(commands))
