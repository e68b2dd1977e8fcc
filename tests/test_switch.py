"""A switch of the base currency, freshness from footers, and balance series, calculated by hand."""

from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from centavo.functions.money import fingerprint
from centavo.operators import merges, refresh, series, statements
from centavo.sources import changes, tables
from centavo.storage import new_path

TXN = "transaction_id string, account_id string, booked_date date, flow_type string, amount_native decimal(14,2), currency_native string, amount_base decimal(14,2), merchant_key string, merchant_id string, category_id string, original_amount decimal(14,2), original_currency string, fx_fee_amount_native decimal(14,2), direction string, is_reversal boolean, market_code string, updated_at timestamp"
RATES = "base string, quote string, as_of date, rate decimal(18,8), source string"
DAY = "2026-06-01"


def monthly(name, key, currency, price, base):
    """Four monthly postings, every other one in CAD: compared in base currency unless the currency is CAD too."""
    first = date(2026, 1, 5)
    out = []
    for i in range(4):
        home = i % 2 == 0
        out.append((f"{name}{i}", "A" if home else "B", first + timedelta(days=30 * i), "spend", D(base if home else price), "CAD" if home else currency, D(base), key, "m", "c", None, None, None, "debit", False, None, datetime(2026, 5, 1)))
    return out


@pytest.fixture
def store(spark):
    """A store with two published series, one compared in base currency; a user has set that one's amount."""
    rows = spark.createDataFrame(monthly("x", "club", "USD", "9.00", "12.00") + monthly("y", "gym", "CAD", "30.00", "30.00"), TXN)
    held = refresh.Store(spark, new_path(spark, "store"))
    refresh.refresh(held, rows, None, DAY, "full")
    run = held.pointer()
    decided = held.read("series", run).withColumn("expected_amount_override", F.when(F.col("basis") == "base", F.lit("12.34").cast("decimal(14,2)"))).withColumn("status", F.lit("confirmed")).cache()
    decided.count()
    held.write("series", run, spark.createDataFrame(decided.collect(), decided.schema))
    seen = held.read("findings", run)
    held.write("findings", run, spark.createDataFrame(seen.withColumn("status", F.lit("dismissed")).collect(), seen.schema))
    held.rows = rows
    return held


def rate(spark, source, target, value, days_ago=1):
    return spark.createDataFrame([(source, target, date(2026, 6, 1) - timedelta(days=days_ago), D(value), "desk")], RATES)


def of_base(store):
    (row,) = store.read("series", store.head()["carried"]).where("basis = 'base' and market_scope = 'ALL'").collect()
    return row


def test_there_and_back_by_audited_rates(spark, store):
    first = store.current("series", "CAD").where("basis = 'base'").first()["detector_fingerprint"]
    native = sorted(r["detector_fingerprint"] for r in store.current("series", "CAD").where("basis = 'native'").collect())
    there, back, want = ("CAD", "TZS", "1850.12345678"), ("TZS", "CAD", "0.00054000"), {"TZS": [D("22830.52"), D("22812.02")], "CAD": [D("12.33"), D("12.32")]}
    for n, (source, target, value) in enumerate((there, back, there, back)):
        told = refresh.switch(store, rate(spark, source, target, value), refresh.Settings(target), DAY)
        assert (told["previous_currency"], told["target_currency"], D(told["rate"]), told["rate_source"]) == (source, target, D(value), "desk")
        now = of_base(store)
        assert (now["expected_amount_override"], now["currency"], now["status"]) == (want[target][n // 2], target, "confirmed")
        name = fingerprint("ALL", "recurring", "club", "spend", "base", target, series.POLICY)
        assert now["detector_fingerprint"] == spark.range(1).select(name).first()[0] and (now["detector_fingerprint"] == first) == (target == "CAD")
        held = store.head()["carried"]
        each = store.read("occurrences", held).where(F.col("detector_fingerprint") == now["detector_fingerprint"])
        assert {r["comparison_currency"] for r in each.collect()} == {target} and each.count() == 4
        late = store.read("findings", held).where("finding_type = 'recurring_overdue'")
        (told,) = late.where(F.col("series_fingerprint") == now["detector_fingerprint"]).collect()
        key = spark.range(1).select(fingerprint("ALL", fingerprint("recurring_overdue", now["detector_fingerprint"], told["evidence"]["expectedNextDate"]))).first()[0]
        assert (told["detector_fingerprint"], told["status"], told["evidence"]["baseCurrency"]) == (key, "dismissed", target)
        assert sorted(r["detector_fingerprint"] for r in store.read("series", held).where("basis = 'native'").collect()) == native
        with pytest.raises(refresh.StaleRun):
            store.current("series", target)
    assert [r["rate"] for r in store.switches().orderBy("version").collect()] == [D(x[2]) for x in (there, back, there, back)]
    before = store.head()
    assert refresh.switch(store, rate(spark, "CAD", "TZS", "1"), refresh.Settings("CAD"), DAY) is None and store.head() == before and store.switches().count() == 4


def test_the_next_run_keeps_what_users_decided(spark, store):
    refresh.switch(store, rate(spark, "CAD", "TZS", "2000"), refresh.Settings("TZS"), DAY)
    valued = store.rows.withColumn("amount_base", (F.col("amount_base") * 2000).cast("decimal(14,2)")).withColumn("updated_at", F.lit(datetime(2026, 5, 2)))
    refresh.refresh(store, valued, None, DAY, "incremental", refresh.Settings("TZS"))
    rows = {r["basis"]: r for r in store.current("series", "TZS").collect()}
    assert (rows["base"]["expected_amount"], rows["base"]["expected_amount_override"], rows["base"]["status"]) == (D("24000.00"), D("24680.00"), "confirmed")
    assert store.pointer()["mode"] == "full" and store.pointer()["generation"] == 2 and store.head()["carried"] is None
    late = store.current("findings", "TZS").where("finding_type = 'recurring_overdue'").collect()
    assert {r["status"] for r in late} == {"dismissed"} and len(late) == 2


def test_no_rate_no_switch_and_one_of_two_wins(spark, store):
    before = store.head()
    with pytest.raises(ValueError, match="no rate"):
        refresh.switch(store, rate(spark, "CAD", "TZS", "2000", days_ago=8), refresh.Settings("TZS"), DAY)
    assert store.head() == before and store.switches().count() == 0
    store.commit(before, before["version"])  # someone else comes first
    with pytest.raises(refresh.StaleRun):
        store.commit(before | {"published": None}, before["version"])
    assert store.current("series", "CAD").count() == 2


def test_base_sensitive_findings_are_resolved(spark):
    kinds = ("unusual_amount", "monthly_spike", "recurring_price_increase", "pending_fx", "coverage_gap", "near_duplicate")
    rows = spark.createDataFrame([("ALL", k, None, k, {"a": "b"}, s) for k in kinds for s in ("new",)] + [("ALL", "recurring_overdue", "old", "late", {"expectedNextDate": ""}, "new")], "market_scope string, finding_type string, series_fingerprint string, detector_fingerprint string, evidence map<string,string>, status string")
    converted = spark.createDataFrame([("ALL", "new", "old")], "market_scope string, detector_fingerprint string, former_fingerprint string")
    got = {r["finding_type"]: r for r in merges.convert_findings(rows, converted, "TZS", "p").collect()}
    assert {k for k, r in got.items() if r["status"] == "resolved"} == set(kinds[:4])
    assert got["recurring_overdue"]["detector_fingerprint"] == "late" and got["recurring_overdue"]["series_fingerprint"] == "new"


def test_marks_come_from_footers(spark):
    root = new_path(spark, "sources")
    at = lambda day: datetime(2026, 1, day)
    for name, days in {"txn": (1, 9), "statement": (3, 4), "account": ()}.items():
        changes.write_source(spark.createDataFrame([(at(d),) for d in days], "updated_at timestamp"), f"{root}/{name}")
    changes.write_source(spark.createDataFrame([(at(2),)], "fetched_at timestamp"), f"{root}/fx", "fetched_at")
    marks = changes.watermarks(spark, {n: f"{root}/{n}" for n in ("txn", "statement", "account")}, f"{root}/fx")
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [MAX(changed_us)]") == 4 and "ReadSchema: struct<changed_us" not in plan
    row = changes.freshness(marks, at(8), at(2)).first()
    assert tuple(row) == (at(9), at(2), True, False)
    assert tuple(changes.freshness(marks, at(9), None).first())[2:] == (False, True)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_latest_fetch_of_a_rate(spark):
    rows = [("USD", "CAD", date(2026, 1, 1), D(r), datetime(2026, 1, f)) for r, f in (("1.30", 1), ("1.40", 3), ("1.50", 2), ("1.35", 3))]
    rates = spark.createDataFrame(rows, "base string, quote string, as_of date, rate decimal(18,8), fetched_at timestamp")
    assert [r["rate"] for r in tables.latest_fetch(rates).collect()] == [D("1.40")]


def test_balance_from_openings_to_the_first_pending_day(spark):
    accounts = spark.createDataFrame([("bank", "chequing", "CAD"), ("card", "credit_card", "CAD"), ("usd", "savings", "USD"), ("bare", "wallet", "CAD")], "account_id string, kind string, native_currency string")
    checked = spark.createDataFrame(
        [("bank", "b1", date(2026, 1, 1), D("100.00"), D("1.00"), "ok"), ("bank", "b0", date(2025, 1, 1), None, D("1.00"), "pending"), ("card", "c1", date(2026, 1, 1), D("40.00"), D("1.00"), "mismatch"), ("card", "c2", date(2026, 2, 1), D("50.00"), None, "pending"), ("usd", "u1", date(2026, 1, 1), D("10.00"), D("1.00"), "gap")],
        "account_id string, statement_id string, period_start date, opening_balance decimal(14,2), closing_balance decimal(14,2), reconcile_status string",
    )
    rates = spark.createDataFrame([("USD", "CAD", date(2025, 12, 28), D("1.255"))], "base string, quote string, as_of date, rate decimal(18,8)")
    opened = statements.openings(accounts, checked, rates, "CAD")
    assert {r["account_id"]: (r["opening_base"], r["is_balance"]) for r in opened.collect()} == {"bank": (D("100.00"), True), "card": (D("50.00"), False), "usd": (D("12.55"), True), "bare": (None, False)}
    rows = [("bank", date(2026, 1, 5), None, "10.00"), ("bank", date(2026, 1, 6), date(2026, 2, 3), "-4.00"), ("card", date(2026, 1, 5), None, "7.00"), ("usd", date(2026, 2, 4), None, None), ("bank", date(2026, 3, 1), None, "1.00"), ("elsewhere", date(2026, 1, 1), None, "99.00")]
    txn = spark.createDataFrame([(a, b, p, D(m) if m else None) for a, b, p, m in rows], "account_id string, booked_date date, posted_date date, amount_base decimal(14,2)")
    got = [tuple(r) for r in statements.balance_series(txn, opened).orderBy("day").collect()]
    assert got == [(None, date(2026, 1, 5), D("3.00"), D("65.55"), "net_activity"), (None, date(2026, 2, 3), D("-4.00"), D("61.55"), "net_activity")]
    each = [tuple(r) for r in statements.balance_series(txn, opened, consolidated=False).orderBy("account_id", "day").collect()]
    assert each == [("bank", date(2026, 1, 5), D("10.00"), D("110.00"), "balance"), ("bank", date(2026, 2, 3), D("-4.00"), D("106.00"), "balance"), ("bank", date(2026, 3, 1), D("1.00"), D("107.00"), "balance"), ("card", date(2026, 1, 5), D("7.00"), D("57.00"), "net_activity")]
    assert statements.balance_series(txn.limit(0), opened).count() == 0
