"""Tools for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

HOT_KEYS_MOST = 100_000
# a key with more entries is put together in ranges, each of them in pieces of so many entries
HOT_ENTRIES, PIECE_ENTRIES = 1_000_000, 10_000


def hot_keys(df: DataFrame, key: str, rows_per_key: int, sized_by: DataFrame | None = None) -> tuple[dict, int]:
    """Keys with more than ``rows_per_key`` rows, and the limit really used.

    ``sized_by`` may name a cheaper frame, best a plain table scan, that has at
    least as many rows of each key in its one column. Its row count, which
    comes from file footers, often settles that there is no hot key.

    Counts combine map-side, so the shuffle carries one row per key and map
    task. The driver gets at most ``HOT_KEYS_MOST`` keys: where more pass the
    limit it is raised, so the answer stays small however big the data is.
    """
    if sized_by is not None:
        if sized_by.count() <= rows_per_key:
            return {}, rows_per_key
        df, as_text = sized_by, isinstance(df.schema[key].dataType, T.StringType)
        key = sized_by.columns[0]
    else:
        as_text = False
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_"))
    while True:
        found = sizes.where(F.col("rows_") > rows_per_key).limit(HOT_KEYS_MOST + 1).collect()
        if len(found) <= HOT_KEYS_MOST:
            return {str(r[0]) if as_text else r[0]: r[1] for r in found}, rows_per_key
        rows_per_key *= 10


def split_hot(df: DataFrame, key: str, hot: dict) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys and all other rows. The key list is bounded, see above."""
    names = df.sparkSession.createDataFrame([(k,) for k in hot], df.select(key).schema)
    names = F.broadcast(names)
    return df.join(names, key, "left_semi"), df.join(names, key, "left_anti")


def joined_sorted(df: DataFrame, key: str, text: Column, order: Column, separator: str, alias: str,
                  hot_entries: int = HOT_ENTRIES, sized_by: DataFrame | None = None) -> DataFrame:
    """Per key the texts of its rows in ``order``, joined, and their number as ``n_entries``.

    The text becomes one message, so it must fit a row. But only texts of keys
    with up to ``hot_entries`` rows are gathered in one task. The rows of hotter
    keys are ranged over all tasks by key and order; each range is joined as it
    passes, in pieces, and only the pieces meet. ``sized_by`` as in ``hot_keys``.
    """
    rows = df.select(F.col(key), order.alias("order_"), text.alias("text_"))
    hot, limit = hot_keys(rows, key, hot_entries, sized_by)
    if not hot:
        return _joined(rows, key, separator, alias)
    hot_part, rest = split_hot(rows, key, hot)
    chunks = int(-(-sum(hot.values()) // limit) + len(hot))
    ranged = hot_part.repartitionByRange(chunks, key, "order_", "text_").sortWithinPartitions(key, "order_", "text_")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, last = TaskContext.get().partitionId(), 0, [], None

        def piece():
            nonlocal number, held
            number += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([last], names.type), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([separator.join(held)]), pa.array([len(held)], pa.int64())], names=["key", "part", "number", "piece", "n"])
            held = []
            return out

        for batch in batches:
            names = batch.column(0)
            for name, value in zip(names.to_pylist(), batch.column(1).to_pylist()):
                if held and (name != last or len(held) >= PIECE_ENTRIES):
                    yield piece()
                last = name
                held.append(value)
        if held:
            yield piece()

    pieces = ranged.select(key, "text_").mapInArrow(run, f"key {kind}, part int, number int, piece string, n bigint")
    whole = F.array_sort(F.collect_list(F.struct("part", "number", "piece")))
    hot_texts = pieces.groupBy(F.col("key").alias(key)).agg(
        F.array_join(F.transform(whole, lambda p: p["piece"]), separator).alias(alias), F.sum("n").alias("n_entries"))
    return _joined(rest, key, separator, alias).unionByName(hot_texts)


def _joined(rows: DataFrame, key: str, separator: str, alias: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("order_", "text_")))
    return rows.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: e["text_"]), separator).alias(alias),
                                 F.count("*").alias("n_entries"))
