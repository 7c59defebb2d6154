"""Every registered query next to its SQL; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from compare import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, folder, con):
    df = QUERIES[name](spark, folder)
    if name in ORACLES:
        problem = compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_entry_gives_the_flagship(spark):
    df = entry.entry(spark)
    assert {"order_id", "is_paid", "restock_qty", "refund"} <= set(df.columns)


def test_all_four_outcomes_occur(spark, folder):
    rows = QUERIES["checkout_saga"](spark, folder).groupBy("stock_ok", "payment_ok").count().collect()
    assert {(r.stock_ok, r.payment_ok): r["count"] for r in rows} == {
        (False, False): 449, (False, True): 654, (True, False): 89, (True, True): 281}
