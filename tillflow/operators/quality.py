"""Checks that nothing is created or lost on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def conserved(ledger: DataFrame, closing: DataFrame, opening: DataFrame) -> DataFrame:
    """Per key: closing minus opening balance against accepted deposits and withdrawals.

    ``ledger`` (key, delta, accepted), ``closing`` (key, balance), ``opening`` (key, opening).
    """
    moved = ledger.where("accepted").groupBy("key").agg(
        F.sum(F.greatest("delta", F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("subtracted"))
    nothing = F.lit(0).cast("bigint")
    return (closing.join(opening, "key", "left").join(moved, "key", "left")
            .select("key", (F.col("balance") - F.coalesce("opening", nothing)).alias("change"),
                    F.coalesce("added", nothing).alias("added"), F.coalesce("subtracted", nothing).alias("subtracted"))
            .withColumn("conserved", F.col("change") == F.col("added") - F.col("subtracted")))


def still_there(gone: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """How many entries were removed, and how many of them are listed all the same."""
    hits = gone.select(*keys).distinct().join(
        listed.select(*keys).distinct().withColumn("hit_", F.lit(1)), keys, "left")
    return hits.agg(F.count("*").alias("n_checked"), F.count("hit_").alias("n_violations"))


def not_there(expected: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """How many entries were added, and how many of them are missing."""
    hits = still_there(expected, listed, keys)
    return hits.select("n_checked", (F.col("n_checked") - F.col("n_violations")).alias("n_violations"))
