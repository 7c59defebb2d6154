"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions and sorted along several Hilbert
curves, each with its own projection and shift. Vectors of different length have
curves of their own: each band of lengths does. Spark range-partitions the keys
and so ranks every row on every curve. A query is compared with the rows whose
ranks on some curve lie near its own; the curves' findings are merged and
ranked by the exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.frames import table
from tillflow.llm.registry import query
from tillflow.session import written

CURVES, DIMENSIONS, BITS, SEED = 14, 8, 7, 11
# rows on each side of a query along a curve: a share of the table, and no fewer than so many
WINDOW_SHARE, WINDOW_LEAST = 0.05, 250
# rows and queries that are multiplied at once
CELL, QUERIES = 4096, 2048
SAMPLE = 4096  # rows that the projections' ranges are taken from


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of whole-numbered points (rows, dimensions) below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    step = top
    while step > 1:  # undo the rotations and reflections of each level
        low = step - 1
        for i in range(dims):
            high = (x[i] & step) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swapped)
            x[i] ^= swapped
        step >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip, step = np.zeros_like(x[0]), top
    while step > 1:
        flip ^= np.where(x[-1] & step, step - 1, 0)
        step >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """The projections, ranges and shifts of a band's curves."""

    def __init__(self, dimension: int, longest: float, sample: np.ndarray, curves: int):
        rng = np.random.default_rng(SEED)
        self.longest, dims = longest, min(DIMENSIONS, dimension + 1)
        self.projections = [np.linalg.qr(rng.normal(size=(dimension + 1, dims)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, dims)) * 0.25
        self.ranges = []
        raised = self.raised(sample)
        for p in self.projections:
            low, high = np.quantile(raised @ p, [0.002, 0.998], axis=0)
            self.ranges.append((low, np.maximum(high - low, 1e-12)))

    def raised(self, rows: np.ndarray) -> np.ndarray:
        """Rows with one more component that gives all the same length: inner products become distances."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (rows ** 2).sum(axis=1), 0))
        return np.c_[rows, rest]

    def keys(self, raised: np.ndarray) -> list[np.ndarray]:
        out = []
        for p, (low, width), shift in zip(self.projections, self.ranges, self.shifts):
            at = ((raised @ p - low) / width * 0.75 + shift) * (1 << BITS)
            out.append(hilbert_keys(np.clip(at, 0, (1 << BITS) - 1), BITS))
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _best(left: pa.Table, right: pa.Table, top: int, dimension: int) -> pa.Table:
    """The ``top`` vectors of a cell for each of its queries, the query's own included, ties to smaller vec_ids."""
    out = {"query": [], "row": [], "vec_id": [], "score": []}
    if left.num_rows and right.num_rows:
        queries, rows = _matrix(left.column("vector"), dimension), _matrix(right.column("vector"), dimension)
        own, uid, vec = (x.to_numpy() for x in (left.column("uid"), right.column("uid"), right.column("vec_id")))
        scores = queries @ rows.T
        slack = 1e-9 * max(1.0, float(np.abs(scores).max()))
        for i in range(len(queries)):
            near = scores[i]
            if len(near) > top:
                least = np.partition(near, len(near) - top)[len(near) - top] - slack
                near = np.flatnonzero(near >= least)
            else:
                near = np.arange(len(near))
            # one order of adding for every pair, so equal vectors tie exactly
            exact = (rows[near] * queries[i]).sum(axis=1)
            order = np.lexsort((vec[near], -exact))[:top]
            out["query"].append(np.full(len(order), own[i]))
            out["row"].append(uid[near][order])
            out["vec_id"].append(vec[near][order])
            out["score"].append(exact[order])
    none = np.zeros(0, np.int64)
    return pa.table({k: pa.array(np.concatenate(v) if v else none, pa.float64() if k == "score" else pa.int64())
                     for k, v in out.items()})


def nearest(vectors: DataFrame, is_query, top: int, id_col: str = "vec_id", vector_col: str = "embedding",
            window_share: float = WINDOW_SHARE, window_least: int = WINDOW_LEAST, cell: int = CELL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``top`` rows of largest inner product for each query row.

    ``is_query`` is a condition on the rows; candidates are all rows but the
    query's own, other rows of the same id included. Rows take no part if id or
    vector is null, if a component is null or not finite, if all are zero, or
    if the length is not the most frequent one. Ties go to the smaller id. Empty
    tables and tables without queries give no rows. Extra columns are left out.
    Equal vectors are searched for once, and stand for their ``top`` + 1 smallest
    ids. The windows hold ``window_share`` of each band's rows, so that recall does not
    fall as it grows; on vectors without any structure no smaller share will do.
    """
    spark = vectors.sparkSession
    typed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                           is_query.alias("is_query"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    typed = typed.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0))
    sizes = typed.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dimension = sizes.d
    every = written(typed.where(F.size("vector") == dimension).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # of equal vectors the first top + 1; Spark drops others before the shuffle, too
    same = Window.partitionBy("vector").orderBy("vec_id", "uid")
    members = written(every.withColumns({"place": F.row_number().over(same), "first": F.first("uid").over(same)}).where(
        F.col("place") <= top + 1).select(F.col("first").alias("group"), "uid", "vec_id", "place", "vector"), "members")
    heads = members.where("place = 1").select("uid", "vec_id", "vector")
    asks = written(every.where("is_query").select("vector", F.col("uid").alias("query"), F.col("vec_id").alias("query_id")).join(
        heads.select("vector", F.col("uid").alias("group")), "vector").select("group", "query", "query_id"), "asks")
    # from here on a row is a distinct vector
    rows = written(heads.join(asks.select(F.col("group").alias("uid"), F.lit(True).alias("asks")).distinct(), "uid", "left").select(
        "uid", "vec_id", "vector", F.coalesce("asks", F.lit(False)).alias("is_query")), "distinct")
    n_queries = rows.where("is_query").count()
    # a band for each half octave of lengths; lengths of one stand in the middle of theirs
    square = F.greatest(F.lit(1e-300), F.least(F.lit(1e300), F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))
    rows = rows.withColumns({"square": square, "band": F.floor(F.log2(square) + 0.5).cast("int")})
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("square").alias("longest")).orderBy("band").collect()
    curves, slots, starts, before_band = {}, [], {}, 0
    for b in bands:  # bounded: some 2,000 half octaves, of which tables have few
        sample = rows.where(F.col("band") == b.band).orderBy(F.xxhash64("vec_id"), "uid").limit(
            max(256, SAMPLE // len(bands))).select("vector").collect()
        window = max(window_least, math.ceil(window_share * b.n))
        # where the window holds all rows of a band, one curve shows all
        made = Curves(dimension, math.sqrt(b.longest), np.array([r.vector for r in sample]), 1 if window >= b.n else CURVES)
        curves[b.band], starts[b.band] = made, len(slots)
        # queries of a cell are split so that no task multiplies more than QUERIES by CELL
        chunks = max(1, math.ceil(min(1.0, (cell + 2 * window) / b.n) * n_queries / QUERIES))
        for _ in made.projections:
            slots.append((before_band, window, (b.n - 1) // cell, chunks))
            before_band += b.n

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, asks = batch.column("uid").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            data, own = _matrix(batch.column("vector"), dimension), batch.column("band").to_numpy()
            asked = data[asks] / np.maximum(np.abs(data[asks]).max(axis=1), 1e-300)[:, None]
            asked /= np.linalg.norm(asked, axis=1)[:, None]
            for band, made in curves.items():
                # a query's length changes no order, so it gets the band's; it has none to make up and its place differs from its row's
                groups = ((uid[own == band], made.raised(data[own == band]), False),
                          (uid[asks], np.c_[asked * made.longest, np.zeros(len(asked))], True))
                for ids, raised, asking in groups:
                    for curve, key in enumerate(made.keys(raised) if len(ids) else [], starts[band]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids), pa.array(np.full(len(ids), curve, np.int32)), pa.array(key),
                             pa.array(np.full(len(ids), asking))], names=["uid", "curve", "key", "asking"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            # ranks count rows: a query's is the number of rows before it
            rows_ = np.cumsum(~batch.column(3).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.full(len(batch), part, np.int32)),
                 pa.array(at + np.concatenate(([0], rows_[:-1]))[:len(batch)])], names=["uid", "curve", "asking", "part", "at"])
            at += int(rows_[-1]) if len(batch) else 0

    entries = rows.select("uid", "is_query", "band", "vector").mapInArrow(keyed, "uid long, curve int, key long, asking boolean")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["curve", "key", "uid", "asking"]
    places = written(entries.repartitionByRange(shuffles, *sort).sortWithinPartitions(*sort).mapInArrow(
        placed, "uid long, curve int, asking boolean, part int, at long"), "places")
    before, total = {}, 0
    counted = places.groupBy("part").agg(F.sum((~F.col("asking")).cast("long")))
    for part, count in sorted(counted.collect()):  # one number a range
        before[part], total = total, total + count
    offset = F.element_at(F.create_map(*[F.lit(x).cast(t) for p in before.items() for x, t in zip(p, ("int", "long"))]), F.col("part"))
    start, window, last, chunks = (F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("curve")) for xs in zip(*slots))
    places = places.withColumn("rank", offset + F.col("at") - start)

    asked = places.where("asking").select("uid", "curve", F.explode(F.sequence(
        F.greatest(F.floor((F.col("rank") - window) / cell), F.lit(0)),
        F.least(F.floor((F.col("rank") + window) / cell), last))).alias("cell"),
        F.pmod(F.xxhash64("uid"), chunks).alias("chunk"))
    held = places.where("not asking").select("uid", "curve", F.floor(F.col("rank") / cell).alias("cell"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    by = ["curve", "cell", "chunk"]
    data = rows.select("uid", "vec_id", "vector")
    # both sides come from the same tables, so the right one gets columns of its own
    left, right = asked.join(data, "uid"), held.join(data, "uid")
    right = right.select(*[F.col(c).alias(c, metadata={"side": "right"}) for c in right.columns])
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        lambda left, right: _best(left, right, top + 1, dimension),
        "query long, row long, vec_id long, score double")
    pairs = pairs.groupBy("query", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))

    def first(df: DataFrame, by: str, most: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id", "row")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    # one more each time, since a query's own row falls out at the end
    found = first(pairs, "query", top + 1).select(F.col("query").alias("asked"), F.col("row").alias("group"), "score")
    found = found.join(members.select("group", F.col("uid").alias("row"), "vec_id"), "group")
    found = first(found, "asked", top + 1).select(F.col("asked").alias("group"), "row", "vec_id", "score")
    found = asks.join(found, "group").where(F.col("row") != F.col("query"))
    return first(found, "query", top).select("query_id", "rank", "vec_id", "score")


@query("op3_nearest")
def op3_nearest(spark, folder):
    """The 20 nearest vectors of every twentieth."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)
