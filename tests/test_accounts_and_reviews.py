"""Hand-calculated cases of account lists with reasons, movers by side, coverage of a range, entity filters and reviews of findings."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from centavo.operators import cube, merges, reads, statements

HELD = "account_id string, kind string, native_currency string, credit_limit decimal(14,2), current_balance decimal(18,2), balance_basis string, used_credit decimal(18,2), available_credit decimal(18,2)"
RATES = "base string, quote string, as_of date, rate decimal(18,8)"


@pytest.fixture
def held(spark):
    card = lambda name, currency, limit, balance, basis="balance": (name, "credit_card", currency, D(limit) if limit else None, D(balance), basis, max(D(balance), D(0)) if limit and basis == "balance" else None, D(limit) - D(balance) if limit and basis == "balance" else None)
    rows = [card("c1", "CAD", "1000.00", "250.00"), card("c2", "USD", "100.00", "-20.00"), card("c3", "CAD", None, "5.00"), card("c4", "CAD", "10.00", "5.00", "net_activity"), card("c5", "TZS", "9000.00", "1.00"), card("c6", "CAD", None, "5.00", "net_activity")]
    rows += [("s1", "savings", "USD", None, D("10.01"), "balance", None, None), ("s2", "savings", "CAD", None, D("-3.00"), "balance", None, None)]
    return spark.createDataFrame(rows, HELD)


@pytest.fixture
def rates(spark):
    return spark.createDataFrame([("USD", "CAD", date(2026, 1, 1), D("1.35500000")), ("TZS", "CAD", date(2025, 12, 1), D("0.00050000"))], RATES)


def test_net_worth_leaves_out_what_is_unverified_or_has_no_fresh_rate(held, rates):
    rows = {r["account_id"]: r for r in statements.contributions(held, rates, "CAD", "2026-01-05").collect()}
    assert {k: r["excluded_reason"] for k, r in rows.items() if r["excluded_reason"]} == {"c4": "unverified_balance", "c5": "missing_fx_rate", "c6": "unverified_balance"}
    assert (rows["s1"]["base_value"], rows["s1"]["contribution"], rows["s1"]["fx_rate_date"]) == (D("13.56"), D("13.56"), date(2026, 1, 1))
    assert (rows["c2"]["base_value"], rows["c2"]["contribution"]) == (D("-27.10"), D("27.10"))
    assert rows["c5"]["base_value"] is None and rows["c5"]["contribution"] is None
    whole = statements.net_worth(held, rates, "CAD", "2026-01-05").first().asDict()
    assert whole == {"assets": D("40.66"), "liabilities": D("258.00"), "net_worth": D("-217.34"), "missing_fx": 1, "unverified": 2, "is_partial": True}


def test_card_use_in_the_base_currency(held, rates):
    cards = statements.credit(held, rates, "CAD", "2026-01-05")
    assert {r["account_id"]: r["excluded_reason"] for r in cards.collect()} == {"c1": None, "c2": None, "c3": "missing_credit_limit", "c4": "unverified_balance", "c5": "missing_fx_rate", "c6": "missing_credit_limit"}
    whole = statements.utilization(cards).first().asDict()
    assert whole == {"used_credit_base": D("250.00"), "credit_limit_base": D("1135.50"), "available_credit_base": D("912.60"), "utilization_percent": D("22.02"), "included_accounts": 2, "excluded_accounts": 4}
    none = statements.utilization(cards.where("false")).first()
    assert (none["used_credit_base"], none["utilization_percent"], none["included_accounts"]) == (D(0), None, 0)


def test_movers_by_side(spark):
    moved = spark.createDataFrame([("merchant", f"m{i}", D(i)) for i in range(-7, 8)], "dimension_type string, dimension_key string, change decimal(18,2)")
    found = {(r["side"], r["rank"]): r["dimension_key"] for r in cube.movers_split(moved).collect()}
    assert found == {("positive", i): f"m{8 - i}" for i in range(1, 6)} | {("negative", i): f"m{i - 8}" for i in range(1, 6)}


def test_coverage_of_a_range(spark):
    rows = spark.createDataFrame([(date(2026, 1, 1), "CAD", D(1)), (date(2026, 1, 31), "USD", None), (date(2026, 1, 31), "EUR", None), (date(2026, 1, 2), "USD", None), (date(2026, 2, 1), "TZS", None)], "booked_date date, currency_native string, amount_base decimal(14,2)")
    assert reads.range_coverage(rows, "2026-01-01", "2026-01-31").first().asDict() == {"transaction_count": 4, "valued_count": 1, "pending_count": 3, "pending_by_currency": {"EUR": 1, "USD": 2}, "coverage_status": "partial"}
    assert reads.range_coverage(rows, "2020-01-01", "2020-01-31").first().asDict() == {"transaction_count": 0, "valued_count": 0, "pending_count": 0, "pending_by_currency": {}, "coverage_status": "complete"}


def test_series_of_an_entity(spark):
    series = spark.createDataFrame([("ALL", "f1", "m1"), ("ALL", "f2", "m2"), ("CA", "f1", "m1"), ("ALL", "f3", None)], "market_scope string, detector_fingerprint string, merchant_id string")
    seen = spark.createDataFrame([("ALL", "f1", "t1"), ("ALL", "f1", "t2"), ("ALL", "f2", "t3"), ("CA", "f1", "t1"), ("ALL", "f3", "t9")], "market_scope string, detector_fingerprint string, transaction_id string")
    txn = spark.createDataFrame([("t1", "a", "x"), ("t2", "b", None), ("t3", "b", "y")], "transaction_id string, account_id string, category_id string")
    keys = lambda entity: sorted((r[0], r[1]) for r in reads.series_of(series, seen, entity, txn).collect())
    assert keys(("account", "b")) == [("ALL", "f1"), ("ALL", "f2")]
    assert keys(("category", "x")) == [("ALL", "f1"), ("CA", "f1")]
    assert keys(("merchant", "m2")) == [("ALL", "f2")]
    assert keys(("category", "z")) == []


def test_reviews_of_findings(spark):
    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    held = spark.createDataFrame([("ALL", "a", "new", 2, None, None), ("ALL", "b", "resolved", 2, t0, t0), ("ALL", "c", "new", 1, None, None), ("ALL", "d", "resolved", 2, None, t0), ("ALL", "e", "confirmed", 2, t0, None), ("ALL", "f", "new", 2, None, None)], "market_scope string, detector_fingerprint string, status string, last_detected_generation int, reviewed_at timestamp, resolved_at timestamp")
    said = spark.createDataFrame([("ALL", "a", "dismissed"), ("ALL", "a", "dismissed"), ("ALL", "b", "new"), ("ALL", "c", "confirmed"), ("ALL", "e", "resolved"), ("ALL", "f", None), ("ALL", "f", "odd"), ("CA", "d", "confirmed"), ("ALL", "z", "new")], "market_scope string, detector_fingerprint string, status string")
    found = {r["detector_fingerprint"]: (r["status"], r["reviewed_at"], r["resolved_at"]) for r in merges.review_findings(held, said, F.lit(t1), 2).collect()}
    assert found == {"a": ("dismissed", t1, None), "b": ("new", t0, None), "c": ("new", None, None), "d": ("resolved", None, t0), "e": ("resolved", t0, t1), "f": ("new", None, None)}


def test_too_many_terms_are_refused(spark):
    terms = spark.range(reads.MOST_TERMS + 1).selectExpr("'account' as kind", "cast(id as string) as term", "'ALL' as market")
    known = spark.createDataFrame([("account", "1", "x", None, "x", "x", "x")], "kind string, id string, label string, market_code string, choice string, name string, choice_name string")
    with pytest.raises(ValueError):
        reads.resolve(terms, known)
