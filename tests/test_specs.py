"""Declarative queries: what is refused, and plans over one snapshot."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from centavo.operators import reads

COLUMNS = "transaction_id string, account_id string, account_name string, market_code string, merchant_id string, merchant_name string, category_id string, category_name string, booked_date date, posted_date date, description_raw string, direction string, flow_type string, amount_native decimal(14,2), amount_base decimal(14,2), currency_native string, original_amount decimal(14,2), original_currency string, fx_fee_amount_native decimal(14,2), is_fx_fee boolean, fx_rate decimal(18,8), updated_at timestamp"


@pytest.fixture
def txn(spark):
    def row(n, amount, rate="1", original=None, fee=None, at=1):
        money = lambda x: None if x is None else Decimal(x)
        return (f"t{n}", "a", "A", "CA", "m", "M", "c", "C", date(2026, 1, n), None, f"text {n}", "debit", "spend", money(amount), None if rate is None else money(amount), "CAD", money(original), original and "USD", money(fee), False, money(rate), datetime(2026, 2, at))

    return spark.createDataFrame([row(1, "13.00", original="10.00"), row(2, "5.00", fee="0.50"), row(3, "7.00", rate=None), row(4, "27.00", original="20.00"), row(5, "99.00", at=9)], COLUMNS)


@pytest.fixture
def rates(spark):
    return spark.createDataFrame([("USD", "CAD", date(2026, 1, 1), Decimal("1.25"))], "base string, quote string, as_of date, rate decimal(18,8)")


def test_costs_of_conversion(txn, rates):
    from centavo.operators import costs

    rows = costs.fx_cost(txn, rates)
    got = {r["transaction_id"]: (r["bank_rate"], r["markup_percent"], r["estimated_markup_base"], r["missing_currency"]) for r in rows.collect()}
    assert got == {"t1": (Decimal("1.3"), Decimal("4"), Decimal("0.50"), None), "t2": (None, None, None, None), "t3": (None, None, None, "CAD"), "t4": (Decimal("1.35"), Decimal("8"), Decimal("2.00"), None)}
    totals = {r["missing_currency"]: (r["rows"], r["missing"], r["explicit_fee_base"], r["estimated_markup_base"], r["fx_cost_base"]) for r in costs.fx_cost_totals(rows).collect()}
    assert totals == {None: (4, 1, Decimal("0.50"), Decimal("2.50"), Decimal("3.00")), "CAD": (1, 1, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))}


def test_a_plan_reads_one_pinned_snapshot(txn, rates):
    specs = [{"dataset": "transactions", "sort": "amount_desc"}, {"dataset": "aggregate", "metrics": ["transaction_count"]}, {"dataset": "fx"}]
    out = reads.run_plan(specs, txn, "2026-01-31", datetime(2026, 2, 2), datetime(2026, 2, 1), datetime(2026, 2, 1), rates=rates)
    assert [r["transaction_id"] for r in out[0].collect()] == ["t4", "t1", "t2", "t3"]
    assert [r["transaction_count"] for r in out[1].collect()] == [4] and out[2].count() == 2
    folders = [{f.rpartition("/")[0] for f in df.inputFiles()} for df in out[:2]]
    assert folders[0] == folders[1] and len(folders[0]) == 1 and "pinned" in min(folders[0])


def test_what_is_refused(txn, rates):
    fx = [{"dataset": "fx"}]
    for plan in ([], fx * 4):
        with pytest.raises(ValueError, match="one to three"):
            reads.run_plan(plan, txn, "2026-01-31")
    for known in (None, datetime(2026, 1, 31)):
        with pytest.raises(reads.StaleRates):
            reads.run_plan(fx, txn, "2026-01-31", None, datetime(2026, 2, 1), known, rates=rates)
    assert len(reads.run_plan([{"dataset": "transactions"}], txn, "2026-01-31", None, datetime(2026, 2, 1), None)) == 1
    for spec in ({"dataset": "sql"}, {"dataset": "fx", "search": "x"}, {"dataset": "aggregate", "metrics": ["spending", "inflow", "outflow", "transaction_count"], "comparison": "previous_year"}):
        with pytest.raises(ValueError, match="."):
            reads.run_spec(spec, txn, "2026-01-31", rates=rates)
