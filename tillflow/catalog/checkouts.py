"""Ledgers and the checkout of whole order books."""

from pyspark.sql import functions as F

from tillflow.catalog import query
from tillflow.catalog.views import sql
from tillflow.operators import ledger
from tillflow.plans import checkout as plan
from tillflow.sources.fixtures import cmd, items0, lines0, orders0, size_of, users0


def credit_commands(spark, folder):
    """Positive deposits and withdrawals, signed, as ledger commands."""
    return (cmd(spark, folder)
            .where(F.col("route").isin("users/credit/add", "users/credit/subtract") & (F.col("amount") > 0))
            .select(F.col("user_id").alias("key"), "t", "seq",
                    F.when(F.col("route") == "users/credit/add", F.col("amount"))
                     .otherwise(-F.col("amount")).alias("delta")))


@query("guarded_ledger", sql("""
    SELECT user_id, seq, delta, ok accepted, bal balance FROM ledger""", "ledger"))
def guarded_ledger(spark, folder):
    return (ledger.guarded_ledger(credit_commands(spark, folder), sized_by=size_of(spark, folder, "user_id"))
            .select(F.col("key").alias("user_id"), "seq", "delta", "accepted", "balance"))


@query("guarded_balance", sql("""
    SELECT user_id, arg_max(bal, rn) balance, count(*) FILTER (ok) n_accepted, count(*) FILTER (NOT ok) n_rejected
    FROM ledger GROUP BY 1""", "ledger"))
def guarded_balance(spark, folder):
    return (ledger.guarded_balance(credit_commands(spark, folder), sized_by=size_of(spark, folder, "user_id")).withColumnRenamed("key", "user_id"))


def saga(spark, folder):
    return plan.checkout(lines0(spark, folder), orders0(spark, folder), items0(spark, folder), users0(spark, folder),
                         item_sizes=size_of(spark, folder, "l_partkey"))


@query("checkout_saga", sql("SELECT * FROM saga", "saga"))
def checkout_saga(spark, folder):
    return saga(spark, folder)


@query("checkout_stock", sql("""
    SELECT item_id, amount - coalesce(s.sold, 0) amount FROM items0 LEFT JOIN (
        SELECT item_id, CAST(sum(qty) AS BIGINT) sold FROM lines0
        WHERE order_id IN (SELECT order_id FROM saga WHERE is_paid) GROUP BY 1) s USING (item_id)""", "saga"))
def checkout_stock(spark, folder):
    return plan.stock_after(saga(spark, folder), lines0(spark, folder),
                            items0(spark, folder).select("item_id", "amount"))


@query("checkout_credits", sql("""
    SELECT user_id, credits - coalesce(s.spent, 0) credits FROM users0 LEFT JOIN (
        SELECT user_id, CAST(sum(price) AS BIGINT) spent FROM saga WHERE is_paid GROUP BY 1) s USING (user_id)""",
    "saga"))
def checkout_credits(spark, folder):
    return plan.credits_after(saga(spark, folder), users0(spark, folder).select("user_id", "credits"))
