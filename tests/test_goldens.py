"""Hand-calculated cases."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from centavo.functions.money import exact_median
from centavo.operators import detect, fx

D = Decimal


def test_median_is_half_up(spark):
    df = spark.createDataFrame([([D("1.11"), D("1.12")],), ([D("3.00")],), ([],)], "v array<decimal(14,2)>")
    assert [r[0] for r in df.select(exact_median(F.col("v"))).collect()] == [D("1.12"), D("3.00"), None]


def test_stale_rate_stays_pending(spark):
    rates = spark.createDataFrame([("USD", "CAD", date(2024, 1, 1), D("1.30000000"))], "base string, quote string, as_of date, rate decimal(18,8)")
    txn = spark.createDataFrame([("a", date(2024, 1, 8), "USD", D("10.00")), ("b", date(2024, 1, 9), "USD", D("10.00")), ("c", date(2023, 12, 31), "USD", D("10.00")), ("d", date(2030, 1, 1), "CAD", D("7.00"))], "id string, booked_date date, currency_native string, amount_native decimal(14,2)")
    out = {r["id"]: r["amount_base"] for r in fx.stamp(txn, rates, "CAD").collect()}
    assert out == {"a": D("13.00"), "b": None, "c": None, "d": D("7.00")}


def test_near_duplicate_window_is_inclusive(spark):
    rows = [(f"t{d}", "A", "M", "CAD", D("5.00"), date(2024, 1, d), "spend", "debit", False) for d in (1, 4, 5)] + [("r", "A", "M", "CAD", D("5.00"), date(2024, 1, 4), "spend", "debit", True)]
    txn = spark.createDataFrame(rows, "transaction_id string, account_id string, merchant_key string, currency_native string, amount_native decimal(14,2), booked_date date, flow_type string, direction string, is_reversal boolean")
    found = {(r["first_transaction_id"], r["second_transaction_id"], r["days_apart"]) for r in detect.near_duplicates(txn).collect()}
    assert found == {("t1", "t4", 3), ("t4", "t5", 1)}
