"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints
that differ in at most three bits, one segment differs in at most one, so they
share a variant of that segment with one bit put aside. Variants are joined by
equality and each pair is verified in the join itself. A variant that very many
fingerprints share is cut again, by the same rule, in the bits it left open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.components import components
from tillflow.llm.frames import map_texts, table, texts, unused
from tillflow.llm.registry import query
from tillflow.session import written

BITS_APART = 3
SHINGLE_WORDS = 3
SEED = 42
# variants with more fingerprints than this are cut again instead of joined
CROWDED = 256
# so many crowded variants may be sent to every task, more are joined by a shuffle
FEW = 20_000
BLOCK = 1 << 15


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The text's fingerprint as a signed 64-bit number; 0 without any word."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(firsts[at:at + BLOCK], lasts[at:at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, bits)``: a fingerprint of every row's whole text."""
    return map_texts(texts(docs, id_col), lambda batch: {"bits": [fingerprint(t) for t in batch]}, "bits long")


def _segment(of: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(of, shift).bitwiseAND((1 << width) - 1)


def _keys(segment: Column, part: int, width: int) -> Column:
    """A segment's variants, each as one number: part, bit put aside, the other bits."""
    return F.array(*[segment.bitwiseAND(((1 << width) - 1) ^ (1 << i)) + F.lit((part * 64 + i) << 32)
                     for i in range(width)])


def _first_agreeing(parts: list[tuple[int, int]], key: Column) -> Column:
    """The part in ``key`` agrees and none before it does, so each pair is found once.

    A part agrees if the two are equal in it, which counts for the first
    position only, or differ in just the bit that ``key`` puts aside.
    """
    part, hole = F.shiftright(key, 38), F.shiftright(key, 32).bitwiseAND(63)
    result, open_so_far = F.lit(False), F.lit(True)
    for p, (shift, width) in enumerate(parts):
        apart = _segment(F.col("x").bitwiseXOR(F.col("y")), shift, width)
        here = ((apart == 0) & (hole == 0)) | (F.call_function("shiftright", apart, hole.cast("int")) == 1) & (F.bit_count(apart) == 1)
        result = result | ((part == p) & open_so_far & here)
        open_so_far = open_so_far & (F.bit_count(apart) > 1)
    return result


def _search(rows: DataFrame, parts: list[tuple[int, int]], above: list, crowded: int) -> DataFrame:
    depth = len(above)
    outer, key = [f"key{d}" for d in range(depth)], f"key{depth}"
    by = [*outer, key]
    index = rows.select(*outer, "bits", F.explode(F.concat(*[
        _keys(_segment(F.col("bits"), s, w), p, w) for p, (s, w) in enumerate(parts)])).alias(key))
    full, crowds = None, 0
    if depth < 2:
        # a variant is two whole segments, so counting those (two rows a fingerprint) finds the crowded ones
        whole = rows.select(*outer, F.explode(F.array(*[
            F.struct(F.lit(p).alias("part"), _segment(F.col("bits"), s, w).alias("segment"))
            for p, (s, w) in enumerate(parts)])).alias("c")).select(*outer, "c.part", "c.segment")
        many = whole.groupBy(*outer, "part", "segment").count().where(F.col("count") > crowded // 2)
        full = written(many.select(*outer, F.explode(F.when(F.col("part") == 0, _keys(F.col("segment"), 0, parts[0][1]))
                       .otherwise(_keys(F.col("segment"), 1, parts[1][1]))).alias(key)).distinct(), "crowded")
        crowds = full.count()
        full = full if crowds <= FEW else full.hint("merge")
    plain = index.join(full, by, "left_anti") if crowds else index
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS_APART
    for d, p in enumerate([*above, parts]):
        close = close & _first_agreeing(p, F.col(f"key{d}"))
    # Spark takes exploded rows for no larger than what they came from and would send all variants to the driver
    pairs = (plain.withColumnRenamed("bits", "x").join(plain.withColumnRenamed("bits", "y").hint("merge"), by)
             .where((F.col("x") < F.col("y")) & close).select(F.col("x").alias("a"), F.col("y").alias("b")))
    if crowds:
        packed = index.join(full, by, "left_semi")
        for p in (0, 1):
            shift, width = parts[1 - p]  # the bits that part p leaves open, besides the one put aside
            halves = [(shift + width // 2, width // 2), (shift, width // 2)]
            pairs = pairs.unionByName(_search(packed.where(F.shiftright(key, 38) == p), halves, [*above, parts], crowded))
    return pairs


def near_pairs(distinct_bits: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(a, b)``, a < b: all pairs of different fingerprints that differ in at most three bits.

    ``distinct_bits`` has a column ``bits`` without repeats. Each level leaves
    fewer bits open (33, 18, 11), so the fingerprints of a crowded variant end
    in groups of 2,048 at most, whatever the input.
    """
    return _search(distinct_bits.select("bits"), [(32, 32), (0, 32)], [], crowded)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", crowded: int = CROWDED) -> DataFrame:
    """``(id, bits, component_id, root)`` for every row: fingerprint, group, and the group's smallest fingerprint.

    Rows with at most three different bits are linked; component_id is the
    smallest id reachable. Null and blank texts have fingerprint 0 and are
    linked like any other. Repeated ids give one row each. A null id takes no
    part in the minimum (null if a group has no other). An empty table gives no
    rows. Extra columns of ``docs`` are left out.
    """
    every = written(fingerprints(docs, id_col), "fingerprints")
    distinct = written(every.groupBy("bits").agg(F.min(id_col).alias("first")), "distinct")
    roots = components(near_pairs(distinct, crowded))
    rooted = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    rooted = rooted.select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(smallest, "root").select("bits", "component_id", "root")
    return every.join(groups, "bits").select(id_col, "bits", "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, of equal ids the row of the smallest JSON text.

    A group without any id keeps the smallest row by the same rule. All columns
    stay as they are, whatever their names and types. Null and blank texts are one group.
    """
    groups = written(near_duplicates(docs, id_col), "groups")
    several_, head_, bits_ = unused(docs.columns, "several", "head", "bits")
    heads = F.col(id_col).eqNullSafe(F.col("component_id")) | F.col("component_id").isNull()
    several = groups.groupBy(id_col).agg(F.count("*").alias("rows_")).where(f"rows_ > 1 or `{id_col}` is null")
    several = written(several.select(F.col(id_col).alias(several_)), "several")
    clear = groups.where(heads & F.col(id_col).isNotNull()).select(F.col(id_col).alias(head_))
    clear = clear.join(several, F.col(head_) == F.col(several_), "left_anti")
    kept = docs.join(clear, F.col(id_col) == F.col(head_), "left_semi")
    if several.isEmpty():
        return kept
    # rare: an id that several rows have, or none at all, does not say which row is meant; the fingerprint does
    unsure = with_bits(docs.join(several, F.col(id_col).eqNullSafe(F.col(several_)), "left_semi"), bits_)
    chosen = groups.where(heads).select(F.col(id_col).alias(head_), F.col("bits").alias(several_), F.col("root")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns])
    packed = unsure.select(row.alias("row"), F.col(bits_).alias("own"), F.col(id_col).alias("asked"))
    chosen = chosen.select(F.col(head_).alias("id"), F.col(several_).alias("bits"), "root")
    least = (packed.join(chosen, F.col("asked").eqNullSafe(F.col("id")) & (F.col("own") == F.col("bits")))
             .groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row")))
    return kept.unionByName(least.select("row.*"))


def with_bits(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and each text's fingerprint as ``name``; of a null text that of an empty one."""
    @F.arrow_udf("bigint")
    def bits(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "") for t in text.to_pylist()], pa.int64())
    return docs.withColumn(name, bits(F.col("text").cast("string")))


@query("op1_simhash")
def op1_simhash(spark, folder):
    """One row per document: fingerprint in hex and the smallest doc_id of its group."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
