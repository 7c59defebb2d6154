"""Target-distribution importance resampling over hashed word features.

A document weighs as much as its features are more usual in the target than in
the collection, by buckets of their CRC32. Words with at least 2^-16 of all
words are the head: their CRC states, and the buckets of pairs that are as
frequent, go to every task. All other features, the tail, take their CRC
directly. Both feed the same exact bucket totals. The sample is drawn without
replacement by adding each document's own Gumbel noise and taking the top.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.frames import table, unused
from tillflow.llm.registry import query
from tillflow.session import written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
# the head: features with at least this share of all words, so at most 65,536; longer ones take the direct way
HEAD_SHARE, HEAD_BYTES = 1 / (1 << 16), 64
COUNTED = 200_000  # a task hands on its counts when it has met so many features

# A-Z lower-cased; of ASCII only letters and digits belong to words
WORD_BYTES = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Features:
    """Buckets of the runs of 1 to ``longest`` words; the head is looked up, the tail hashed."""

    def __init__(self, longest: int, buckets: int, words: list[bytes] = (), pairs: list[bytes] = ()):
        self.longest, self.buckets, self.words, self.pairs = longest, buckets, list(words), list(pairs)

    @cached_property
    def states(self) -> dict[bytes, int]:
        return {w: crc32(w) for w in self.words}

    @cached_property
    def pair_buckets(self) -> dict[bytes, int]:
        return {p: crc32(p) % self.buckets for p in self.pairs}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "pair_buckets")}

    def __call__(self, words: list[bytes]) -> list[int]:
        known, size = self.states.get, self.buckets
        states = [crc32(w) if (s := known(w)) is None else s for w in words]
        out = [s % size for s in states]
        if self.longest > 1:
            frequent = self.pair_buckets.get
            follow = [b" " + w for w in words[1:]]
            for at, (first, second) in enumerate(zip(words, follow)):
                bucket = frequent(first + second)
                out.append(crc32(second, states[at]) % size if bucket is None else bucket)
            for length in range(2, self.longest):
                # a run's state goes on with its next word
                states = [crc32(w, s) for w, s in zip(follow[length - 2:], states)]
                out += [crc32(w, s) % size for w, s in zip(follow[length - 1:], states)]
        return out


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).cast("string").cast("binary").alias("text_"))


def _counted(texts: DataFrame, features) -> DataFrame:
    """``(feature, n)``: how often ``features(words)`` gives each one, added up in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())], names=["feature", "n"])
        met: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                met.update(features(words_of(text.as_py())))
                if len(met) >= COUNTED:
                    yield out()
                    met = Counter()
        yield out()
    return texts.mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, total: int) -> list[bytes]:
    head = counts.where((F.col("n") >= F.lit(total * HEAD_SHARE)) & (F.octet_length("feature") <= HEAD_BYTES))
    return [bytes(r.feature) for r in head.select("feature").collect()]


def head_of(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> Features:
    """The features whose states or buckets every task gets: exactly the frequent ones of both tables together."""
    texts = _texts(docs, text_col).unionAll(_texts(target, text_col))
    counts = written(_counted(texts, lambda words: words), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words, pairs = _frequent(counts, total), []
    if longest > 1:
        head = frozenset(words)

        def both(words: list[bytes]) -> Iterable[bytes]:
            # a pair is no more frequent than either of its words
            return (a + b" " + b for a, b in zip(words, words[1:]) if a in head and b in head)
        pairs = _frequent(_counted(texts, both), total)
    return Features(longest, buckets, words, pairs)


def bucketed(df: DataFrame, features: Features, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns, ``n_words`` and the ``buckets`` of all features of each row's whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    schema = df.sparkSession.createDataFrame([], f"{kinds + ', ' if kinds else ''}n_words long, buckets array<int>").schema
    arrow = to_arrow_schema(schema)
    head = df.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = head.value
        for batch in batches:
            counts, offsets, flat = [], [0], []
            for text in batch.column(len(columns)):
                words = words_of(text.as_py())
                found = np.array(of(words), np.int32)
                counts.append(len(words))
                offsets.append(offsets[-1] + len(found))
                flat.append(found)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(arrow.field("buckets").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(counts, pa.int64()), lists], schema=arrow)

    return df.select(*columns, F.col(text_col).cast("string").cast("binary").alias("text_")).mapInArrow(run, schema)


def bucket_totals(buckets: DataFrame, size: int) -> np.ndarray:
    """How many features each bucket holds; a task hands on at most ``size`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    out = np.zeros(size, np.int64)
    sums = buckets.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(all_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat that a feature of each bucket adds, rounded down."""
    size, s, t = len(all_), all_.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``n_features`` and ``weight`` instead of ``buckets``, which is the last column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keys = rows.columns[:-1]
    schema = rows.drop("buckets").withColumns({"n_features": F.lit(0).cast("long"), "weight": F.lit(0).cast("long")}).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy()])))
            made = [pa.array(np.diff(ends)), pa.array(sums[ends[1:]] - sums[ends[:-1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], *made], schema=arrow)
    return rows.mapInArrow(run, schema)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; of a null id that of an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3 ... over all its rows, which no one task holds.

    Rows are range-partitioned and sorted; each is counted within its range and
    the ranges before it are added. Equal rows are told apart by their place, so ties spread, too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = df.sparkSession
    place, part_, offset = unused(df.columns, "place", "part", "before")
    rows = df.withColumn(place, F.monotonically_increasing_id())
    order = (*order, F.col(place))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = df.withColumns({part_: F.lit(0), "rank": F.lit(0).cast("long")}).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)),
                                              pa.array(np.arange(before + 1, before + n + 1))], schema=arrow)
            before += n

    sorted_ = rows.repartitionByRange(shuffles, *order).sortWithinPartitions(*order).drop(place)
    placed = written(sorted_.mapInArrow(run, schema), "ranked")
    totals, before = [], 0
    for r in placed.groupBy(part_).agg(F.count("*").alias("n")).orderBy(part_).collect():  # one row a range
        totals.append((r[part_], before))
        before += r.n
    offsets = spark.createDataFrame(totals, f"{part_} int, {offset} long")
    return placed.join(F.broadcast(offsets), part_).withColumn("rank", F.col("rank") + F.col(offset)).drop(part_, offset)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
              buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, n_features, weight, score, rank)`` for every row of ``docs``.

    ``rank`` numbers the drawn rows: of those with at least ``least_words`` words
    ``percent`` in a hundred, rounded down, with the highest scores, ties to the
    smaller id (null first), then in any order. Others have a null rank. Null, empty
    and wordless texts have no features and weight 0. Repeated rows count as
    often as they come and give one row each; rows of one id share its noise. Empty
    tables are fine on either side. ``keep`` names further columns to
    carry along, as the texts of a training set; all others are left out.
    """
    clash = {c.lower() for c in keep} & {id_col.lower(), "n_words", "buckets", "n_features", "weight", "score", "rank"}
    if clash:
        raise ValueError(f"these names are taken: {sorted(clash)}")
    features = head_of(docs, target, longest, buckets, text_col)
    rows = written(bucketed(docs, features, [id_col, *keep], text_col), "buckets")
    gain = gains(bucket_totals(rows, buckets), bucket_totals(bucketed(target, features, [], text_col), buckets))
    weighed = _weighed(rows, gain).withColumn("score", F.col("weight") + noise(id_col, seed))
    scored = written(weighed, "weights")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    order = ranked(scored.where(fit), F.desc("score"), F.col(id_col))
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(others).select(id_col, *keep, "n_features", "weight", "score", "rank")


_WORDS = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")

SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY c) AS t FROM (SELECT c, list_reduce(range(8), lambda v, k:
    CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, c) AS v FROM range(256) r(c))),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
features AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
coded AS (
  SELECT word, list_transform(range(octet_length(encode(word))),
                              lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT word FROM features UNION SELECT word FROM wanted)),
bucket AS (
  SELECT word, xor(list_reduce(b, lambda v, x: xor(t[(xor(v, x) & 255) + 1], v >> 8), 4294967295), 4294967295) % {BUCKETS} AS k
  FROM coded, crc_table),
s AS (SELECT k, CAST(sum(n) AS DOUBLE) AS n FROM features JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, CAST(sum(n) AS DOUBLE) AS n FROM wanted JOIN bucket USING (word) GROUP BY k),
gain AS (
  SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {BUCKETS})
         / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (k)),
weights AS (SELECT doc_id, CAST(sum(f.n * g) AS BIGINT) AS weight
            FROM features f JOIN bucket USING (word) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5)
                                     / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS}
  QUALIFY rank <= count(*) OVER () * {PERCENT} // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op12_resampling", SQL)
def op12_resampling(spark, folder):
    """Every document's weight towards the benchmark's distribution, and its rank in the drawn tenth."""
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
