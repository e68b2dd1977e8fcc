"""What moves between tasks: rates go to postings, only what a result needs is shuffled, and results are those of the plainer form."""

from datetime import date
from decimal import Decimal

import pytest

from centavo.operators import costs, cube, fx, merges, reads
from centavo.plans import streams
from centavo.storage import names


@pytest.fixture
def no_broadcast(spark):
    """Tables as at size: nothing is small enough to be sent around unasked."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_go_to_the_rows(spark, no_broadcast):
    rows = spark.createDataFrame([("a", "USD", date(2000, 1, 9), Decimal("2.00")), ("b", "USD", date(2000, 1, 10), Decimal("2.00")), ("c", "CAD", date(2000, 1, 9), Decimal("2.00")), ("d", None, date(2000, 1, 9), Decimal("2.00"))], "transaction_id string, currency_native string, booked_date date, amount_native decimal(14,2)")
    rates = spark.createDataFrame([("USD", "CAD", date(2000, 1, 2), Decimal("1.5"))], "base string, quote string, as_of date, rate decimal(18,8)")
    out = fx.stamp(rows, rates, "CAD")
    assert "SortMergeJoin" not in _plan(out)
    assert {r["transaction_id"]: r["amount_base"] for r in out.collect()} == {"a": Decimal("3.00"), "b": None, "c": Decimal("2.00"), "d": None}


def test_months_anew_are_those_of_the_whole_cube(spark):
    """A market without postings in an affected month still has that month, since it lies within the market's span."""
    day = lambda m: date(2000, m, 5)
    rows = [("x", "TZ", day(1)), ("x", "TZ", day(5)), ("y", "CA", day(3)), ("y", "CA", day(4))]
    txn = spark.createDataFrame([(a, "C1", "M1", market, d, "spend", Decimal("1.00"), "CAD") for a, market, d in rows], "account_id string, category_id string, merchant_id string, market_code string, booked_date date, flow_type string, amount_base decimal(14,2), currency_native string")
    months = spark.createDataFrame([(date(2000, m, 1),) for m in (3, 5)], "period_start date")
    got = cube.monthly_of(txn, months)
    want = cube.monthly(txn).join(months, "period_start", "left_semi").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("market_scope = 'TZ' and dimension_type = 'total' and period_start = '2000-03-01' and transaction_count = 0").count() == 1


def test_days_of_balances_do_not_ask_for_statements(spark, no_broadcast):
    rows = [("t1", "x", "s1", date(2000, 1, 2), None, Decimal("1.00")), ("t0", "x", "s2", date(2000, 1, 2), None, Decimal("2.00")), ("t2", "x", None, date(2000, 1, 2), None, Decimal("4.00")), ("t3", "x", "s2", date(2000, 1, 3), None, Decimal("8.00"))]
    txn = spark.createDataFrame([(*r, r[-1]) for r in rows], "transaction_id string, account_id string, statement_id string, booked_date date, posted_date date, amount_native decimal(14,2), amount_base decimal(14,2)")
    starts = spark.createDataFrame([("s1", date(2000, 1, 1)), ("s2", date(1999, 12, 1))], "statement_id string, statement_start date")
    opened = spark.createDataFrame([("x", Decimal("100.00"), Decimal("100.00"))], "account_id string, opening_balance decimal(14,2), opening_base decimal(14,2)")
    out = reads.running_balances(txn, opened, starts)
    assert {r["transaction_id"]: r["running_native"] for r in out.collect()} == {"t0": Decimal("102.00"), "t1": Decimal("103.00"), "t2": Decimal("107.00"), "t3": Decimal("115.00")}
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 3  # statements once, days with openings, rows with days


def test_costs_are_told_in_place(spark, no_broadcast):
    rows = spark.createDataFrame([("a", "CAD", date(2000, 1, 9), Decimal("-9.00"), Decimal("-6.00"), "USD", Decimal("0.50"), False, Decimal("1")), ("b", "CAD", date(2000, 1, 9), Decimal("-9.00"), None, None, None, False, Decimal("1"))], "transaction_id string, currency_native string, booked_date date, amount_native decimal(14,2), original_amount decimal(14,2), original_currency string, fx_fee_amount_native decimal(14,2), is_fx_fee boolean, fx_rate decimal(18,8)")
    rates = spark.createDataFrame([("USD", "CAD", date(2000, 1, 2), Decimal("1.25"))], "base string, quote string, as_of date, rate decimal(18,8)")
    (row,) = costs.with_cost(rows, rates).collect()
    assert (row["transaction_id"], row["amount_native"], row["market_rate"], row["estimated_markup_native"]) == ("a", Decimal("-9.00"), Decimal("1.25000000"), Decimal("1.00"))
    assert costs.fx_cost(rows, rates).columns[:3] == ["transaction_id", "foreign_amount", "market_rate"]


def test_first_findings_are_new_and_wait_for_nothing(spark, no_broadcast):
    found = spark.createDataFrame([("ALL", "f1"), ("ALL", "f1"), ("CA", "f1")], "market_scope string, detector_fingerprint string").dropDuplicates()
    out = merges.first_findings(found, 3)
    assert "Join" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("ALL", "f1", "new", 3), ("CA", "f1", "new", 3)]


def test_a_streams_source_is_written_by_all_tasks(spark, monkeypatch):
    class Seen(Exception):
        pass

    def read(spark, path, schema, files):
        raise Seen(sum(x.endswith(".parquet") for x in names(spark, path)), files)

    monkeypatch.setattr(streams.jobs, "read_files", read)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Seen) as seen:
            streams._refreshed(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert seen.value.args == (9, 5)


def _tables(folder):
    """Small source tables of their own: four customers, three suppliers, and a line of each."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    day = lambda m: __import__("datetime").datetime(1998, m, 5)
    rows = {
        "customer": [{"c_custkey": k, "c_name": f"c{k}", "c_nationkey": k, "c_acctbal": 1.0, "c_mktsegment": "MACHINERY" if k % 2 else "FURNITURE"} for k in range(1, 5)],
        "supplier": [{"s_suppkey": k, "s_name": f"s{k}", "s_nationkey": k, "s_acctbal": 10.0 * k} for k in range(1, 4)],
        "part": [{"p_partkey": 1, "p_name": "p", "p_brand": "b", "p_type": "t", "p_size": 1, "p_retailprice": 1.0}],
        "orders": [{"o_orderkey": k, "o_custkey": k, "o_orderstatus": "O", "o_totalprice": 1.0, "o_orderdate": day(k), "o_orderpriority": "1"} for k in range(1, 4)],
        "lineitem": [{"l_orderkey": k, "l_partkey": 1, "l_suppkey": k, "l_linenumber": k, "l_quantity": 1.0, "l_extendedprice": 5.0 * k, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": day(k + 1)} for k in range(1, 4)],
        "events": [{"event_id": 1, "ts": day(1), "user_id": 1, "event_type": "purchase", "value": 1.0, "props": "{}"}],
    }
    for name, held in rows.items():
        pq.write_table(pa.Table.from_pylist(held).cast(pa.schema([(f.name, pa.int32()) if f.name in ("c_nationkey", "s_nationkey", "p_size", "l_linenumber") else f for f in pa.Table.from_pylist(held).schema])), folder / f"{name}.parquet")
    return str(folder)


def test_series_do_not_pair_suppliers_with_customers(spark, no_broadcast, tmp_path):
    """A cube needs few of a series' columns; before, Spark then paired all suppliers with all customers."""
    from centavo.plans import QUERIES

    out = QUERIES["val_cube"](spark, _tables(tmp_path))
    plan = _plan(out)
    assert "CartesianProduct" not in plan and "l_linenumber" not in plan
    assert out.where("dimension_type = 'total' and violation = 'net'").count() > 0
