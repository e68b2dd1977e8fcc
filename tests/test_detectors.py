"""Hand-calculated cases of cube, detectors, series, refresh and merges."""

from datetime import date, timedelta
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from centavo.operators import costs, cube, ingest, merges, outliers, reads, refresh, series
from centavo.storage import new_path

TXN = "transaction_id string, account_id string, booked_date date, flow_type string, amount_native decimal(14,2), currency_native string, amount_base decimal(14,2), merchant_key string, merchant_id string, category_id string, original_amount decimal(14,2), original_currency string, fx_fee_amount_native decimal(14,2), direction string, is_reversal boolean, market_code string, updated_at timestamp"


def posting(name, day, amount, flow="spend", base="same", currency="CAD", key="shop", merchant="m", category="c", fee=None, market=None):
    value = D(amount) if base == "same" else base
    return (name, "A", day, flow, D(amount), currency, value, key, merchant, category, None, None, D(fee) if fee else None, "debit", False, market, None)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, TXN)


def first_of(year, month):
    return F.lit(date(year, month, 1))


def test_months_with_a_gap_and_pending_rows(table):
    day = date(2026, 1, 4)
    rows = [posting("i", day, "1000.00", "income"), posting("s", day, "200.00"), posting("f", day, "10.00", "fee"), posting("r", day, "-20.00", "refund"), posting("t", day, "500.00", "transfer"), posting("p", day, "27000.00", base=None, currency="TZS"), posting("q", day, "20.00", base=None, currency="USD"), posting("m", date(2026, 3, 2), "300.00")]
    found = cube.trends(cube.monthly(table(rows), ("total",))).orderBy("period_start").collect()
    january, february, march = found
    assert [january[c] for c in ("inflow", "outflow", "spending", "net", "transaction_count", "valued_count", "pending_count", "coverage_status")] == [D("1000.00"), D("190.00"), D("190.00"), D("810.00"), 7, 5, 2, "partial"]
    assert january["pending_fx_by_currency"] == {"TZS": 1, "USD": 1}
    assert (february["transaction_count"], february["coverage_status"], february["change"], february["change_percent"]) == (0, "complete", D("-190.00"), D("-100.0000"))
    assert (march["change"], march["change_percent"], march["trailing_mean"], march["trailing_median"]) == (D("300.00"), None, D("163.33"), D("190.00"))


@pytest.mark.parametrize(
    ("before", "now", "sensitivity", "want"),
    [
        (["10.00", "11.00", "12.00", "13.00", "14.00"], "100.00", "balanced", ("mad", D("59.3560"), D("12.00"), D("88.00"))),
        (["10.00", "10.00", "10.00", "20.00", "20.00"], "50.00", "balanced", ("iqr", D("3.0000"), D("10.00"), D("40.00"))),
        (["10.00"] * 5, "30.00", "balanced", ("iqr", None, D("10.00"), D("20.00"))),
        (["10.00"] * 5, "30.00", "low", None),
        (["10.00"] * 5, "35.00", "low", ("iqr", None, D("10.00"), D("25.00"))),
    ],
)
def test_amounts_against_earlier_ones(table, before, now, sensitivity, want):
    rows = [posting(f"b{i}", date(2026, 1, 1) + timedelta(days=i), a) for i, a in enumerate(before)] + [posting("now", date(2026, 1, 20), now)]
    found = [r for r in outliers.amounts(table(rows), sensitivity).collect() if r["transaction_id"] == "now"]
    assert [(r["method"], r["score"], r["baseline"], r["difference"]) for r in found] == ([want] if want else [])


def test_statistics_of_a_cut_key_are_those_of_the_whole(table):
    """A hot key in many parts, against numpy."""
    rng = np.random.default_rng(1)
    cents = rng.integers(100, 900, 300)
    rows = [posting(f"t{i:03}", date(2026, 1, 1) + timedelta(days=i // 4), f"{c / 100:.2f}") for i, c in enumerate(cents.tolist())]
    held = table(rows).select("merchant_key", "booked_date", "transaction_id", F.col("amount_base").alias("value"))
    found = outliers.prior_statistics(held, ["merchant_key"], "booked_date", "transaction_id", "value", chunk_rows=17).orderBy("transaction_id").collect()
    assert len(found) == 295
    for r in found:
        n = int(r["transaction_id"][1:])
        s = np.sort(cents[:n])
        middle = lambda v: int(np.floor(np.median(v) + 0.5))
        m = middle(s)
        assert (r["prior_count"], r["baseline"], r["mad"]) == (n, D(m) / 100, D(middle(np.abs(s - m))) / 100)
        assert (r["lower_quartile"], r["upper_quartile"]) == (D(middle(s[: n // 2])) / 100, D(middle(s[n - n // 2 :])) / 100)


def test_frequency_of_whole_months(table):
    rows = [posting(f"b{m}", date(2026, m, 10), "10.00") for m in range(1, 6)] + [posting(f"j{d}", date(2026, 6, d), "10.00") for d in (10, 11, 12)]
    (r,) = outliers.frequency(table(rows), first_of(2026, 7)).collect()
    assert (r["period_start"], r["value"], r["baseline"], r["difference"], r["prior_count"]) == (date(2026, 6, 1), D("3.00"), D("1.00"), D("2.00"), 5)
    assert outliers.frequency(table(rows), F.lit(date(2026, 6, 15))).count() == 0


def test_spikes_stop_where_anything_in_the_scope_is_pending(table):
    rows = [posting(f"b{m}", date(2026, m, 10), "10.00") for m in range(1, 6)] + [posting("now", date(2026, 6, 10), "100.00")]
    found = outliers.spikes(cube.monthly(table(rows)), first_of(2026, 7)).collect()
    assert {(r["dimension_type"], r["dimension_key"], r["baseline"], r["difference"]) for r in found} == {("category", "c", D("10.00"), D("90.00")), ("merchant", "m", D("10.00"), D("90.00"))}
    other = posting("p", date(2026, 3, 15), "1000.00", base=None, currency="TZS", key="o", merchant="o", category="o")
    assert outliers.spikes(cube.monthly(table([*rows, other])), first_of(2026, 7)).count() == 0


def test_series_without_fees_and_their_price(table):
    rows = [posting(f"s{i}", date(2026, 1, 1) + timedelta(days=30 * i), "10.50" if i < 3 else "11.50", fee="0.50") for i in range(4)]
    found = series.recurring(table(rows), F.lit(date(2026, 6, 1)))
    (r,) = found.collect()
    assert (r["cadence"], r["basis"], r["overdue"], r["expected_amount"], r["next_date"], r["confidence"]) == ("monthly", "native", True, D("10.00"), date(2026, 5, 1), D("1.0000"))
    (p,) = series.price_increases(found).collect()
    assert [p[c] for c in ("previous_median", "latest_amount", "increase_amount", "increase_percent", "increase_base")] == [D("10.00"), D("11.00"), D("1.00"), D("10.0000"), D("1.00")]
    twice = [*rows, posting("again", date(2026, 1, 31), "10.50")]
    assert series.recurring(table(twice), F.lit(date(2026, 6, 1))).count() == 0


def test_refresh_by_generations(spark, table):
    """An incremental run aggregates the changed month alone, gives what a full run gives, and decisions survive it."""
    at = lambda rows, stamp: table(rows).withColumn("updated_at", F.lit(stamp).cast("timestamp"))
    old = at([posting(f"s{i}", date(2026, 1, 1) + timedelta(days=30 * i), "10.00", market="CA") for i in range(4)], "2026-05-01 00:00:00")
    both = old.unionByName(at([posting("s4", date(2026, 5, 1), "10.00", market="CA")], "2026-05-02 00:00:00"))
    store, full = refresh.Store(spark, new_path(spark, "test-store")), refresh.Store(spark, new_path(spark, "test-full"))
    with pytest.raises(refresh.StaleRun):
        store.current("cube", "CAD")
    refresh.refresh(store, old, None, "2026-04-10").collect()
    assert {r["status"] for r in store.current("series", "CAD").collect()} == {"detected"}
    rows = merges.patch(store.current("series", "CAD"), store.current("series", "CAD").select("market_scope", "detector_fingerprint", F.lit("confirmed").alias("status")), ["status"])
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    store.write("series", store.pointer(), kept)
    counts = {r["market_scope"]: r.asDict() for r in refresh.refresh(store, both, None, "2026-05-05").collect()}
    assert counts["CA"]["aggregate_count"] == 4 and set(counts) == {"ALL", "CA"}
    refresh.refresh(full, both, None, "2026-05-05", "full").collect()
    plain = lambda s: sorted(str(sorted(r.asDict().items(), key=str)) for r in s.current("cube", "CAD").drop("generation").collect())
    assert plain(store) == plain(full)
    assert {(r["status"], r["last_detected_generation"], r["first_date"]) for r in store.current("series", "CAD").collect()} == {("confirmed", 2, date(2026, 1, 1))}
    assert [(r["generation"], r["mode"], r["affected_periods"]) for r in store.runs().orderBy("generation").collect()] == [(1, "full", 3), (2, "incremental", 1)]
    assert {r["status"] for r in store.runs().collect()} == {"succeeded"}
    with pytest.raises(refresh.StaleRun):
        store.current("cube", "TZS")


def test_ingestion_again_adds_nothing(table):
    rows = table([posting("a", date(2026, 1, 1), "5.00"), posting("b", date(2026, 1, 2), "6.00")]).withColumn("dedup_hash", F.col("transaction_id"))
    assert ingest.insert_absent(rows, rows.unionByName(rows)).count() == 0
    assert ingest.insert_absent(rows.limit(0), rows.unionByName(rows)).count() == 2


def test_rules_split_rows(table):
    rows = table([posting("good", date(2026, 1, 1), "5.00"), posting("bad", date(2026, 1, 1), "5.00", currency="cad")]).withColumn("is_fx_fee", F.lit(False))
    good, bad = costs.split(rows)
    assert [r["transaction_id"] for r in good.collect()] == ["good"] and [(r["transaction_id"], r["violations"]) for r in bad.collect()] == [("bad", ["currency"])]


def test_ranges():
    assert reads.date_range("last_month", "2024-03-31") == ("2024-02-01", "2024-02-29")
    assert reads.date_range("last_quarter", "2024-05-10") == ("2024-01-01", "2024-03-31")
    assert reads.date_range("last_12_months", "2024-05-10") == ("2023-06-01", "2024-05-10")
    assert reads.date_range(7, "2024-03-03") == ("2024-02-26", "2024-03-03")
    assert reads.date_range("all", "2024-03-03", "2020-01-05") == ("2020-01-05", "2024-03-03")
    assert reads.earlier_range("2024-02-29", "2024-03-31", "previous_year") == ("2023-02-28", "2023-03-31")
    assert reads.earlier_range("2024-02-01", "2024-02-29", "previous_period") == ("2024-01-03", "2024-01-31")


def test_monthly_detectors_and_near_duplicates_move_rows_once(spark):
    """A row moves once to be judged, and near duplicates meet among few rows; before, judged rows were joined back, and every row met two buckets."""
    rows = spark.range(400).selectExpr("concat('t', id) as transaction_id", "'a' as account_id", "concat('m', id div 200) as merchant_key", "'CAD' as currency_native", "cast(id as decimal(14,2)) as amount_native", "date_add(date '2020-01-01', cast(id as int)) as booked_date", "'spend' as flow_type", "false as is_reversal", "'debit' as direction", "'CA' as market_code", "cast(id as decimal(14,2)) as amount_base")
    plan = outliers.amounts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    twin = rows.where("transaction_id in ('t127', 't128')").selectExpr("concat(transaction_id, 'x') as transaction_id", "account_id", "merchant_key", "currency_native", "amount_native", "date_add(booked_date, 3) as booked_date", "flow_type", "is_reversal", "direction", "market_code")
    from centavo.operators import detect

    found = detect.near_duplicates(rows.select(*twin.columns).unionByName(twin), more=("market_code",)).orderBy("first_transaction_id").collect()
    assert [(r["first_transaction_id"], r["second_transaction_id"], r["days_apart"], r["market_code"]) for r in found] == [("t127", "t127x", 3, "CA"), ("t128", "t128x", 3, "CA")]
