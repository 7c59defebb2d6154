"""Small helpers that the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.session import prepare

# rows and bytes of one Arrow batch: long texts must not pile up in a Python worker
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
# a writing task holds a row group of texts in memory
ROW_GROUP_BYTES = 32 << 20


def settings(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", ROW_GROUP_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the key columns and the text, where a null text counts as empty."""
    return df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sampled(df: DataFrame, id_col: str, most: int, longest: int) -> list[str]:
    """The non-empty texts of up to ``longest`` bytes among the rows with the ``most`` smallest hashes of ids.

    Ids are chosen before any text is read; both the ids and the texts that
    come to the driver are bounded by the parameters.
    """
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(hashed, id_col).limit(most)
    rows = df.where(F.octet_length("text").between(1, longest)).join(F.broadcast(ids), id_col, "left_semi")
    return [r.text for r in rows.orderBy(hashed, id_col, "text").limit(most).select("text").collect()]


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened where a column has that name already; Spark does not tell cases apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str) -> DataFrame:
    """Add the columns that ``fn`` makes of a batch's texts and drop the text.

    ``df`` has key columns and ``text``; ``schema`` names the added columns.
    """
    keys = [c for c in df.columns if c != "text"]
    types_ = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + [schema])
    out_schema = df.sparkSession.createDataFrame([], types_).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(batch.schema.get_field_index("text")).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            columns += [made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type)
                        for f in list(arrow)[len(keys):]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in arrow])

    return df.mapInArrow(run, out_schema)


def kept(name: str, make: Callable):
    """A value that a Python worker makes once and keeps over its tasks."""
    store = sys.modules.get("_tillflow_worker")
    if store is None:
        store = sys.modules["_tillflow_worker"] = types.ModuleType("_tillflow_worker")
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
