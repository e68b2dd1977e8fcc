"""Streams: landing by an index of bounded reads, months, alerts with late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from centavo.storage import names, new_path
from centavo.streaming import jobs


@pytest.fixture
def source(spark):
    path = new_path(spark, "source")

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    put.path = path
    return put


def test_a_batch_reads_a_bounded_part_of_the_index(spark, monkeypatch):
    """Twelve batches into few prefixes: what a batch reads does not grow with the table, nothing is landed twice."""
    monkeypatch.setattr(jobs.Identities, "DIGITS", 1)
    monkeypatch.setattr(jobs.Identities, "MOST", 3)
    table, read = new_path(spark, "landed"), []
    known = jobs.Identities.known

    def counted(self, prefixes, batch):
        out = known(self, prefixes, batch)
        if batch >= 0 and len(prefixes) == 16:
            read.append(sum(len(self.parts(p, batch)) for p in prefixes) / 16)
        return out

    monkeypatch.setattr(jobs.Identities, "known", counted)
    batch = lambda n: spark.range(40 * n, 40 * n + 80).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_hash"), "id")  # noqa: E731  half of it was in the batch before
    for n in range(12):
        jobs._land(batch(n), table, n)
        assert spark.read.parquet(table).count() == 40 * n + 80
    assert read and max(read) <= 4 and len(names(spark, table)) >= 12
    jobs._land(batch(11), table, 11)  # the same batch again
    jobs._land(batch(3), table, 12)
    rows = spark.read.parquet(table)
    assert rows.count() == rows.select("dedup_hash").distinct().count() == 40 * 11 + 80


def test_a_table_landed_before_the_index(spark):
    table = new_path(spark, "landed")
    rows = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_hash"), "id")
    rows.write.parquet(f"{table}/batch=0")
    jobs._land(rows.unionByName(spark.range(50, 60).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_hash"), "id")), table, 1)
    assert spark.read.parquet(table).groupBy("batch").count().orderBy("batch").collect() == [(0, 50), (1, 10)]


def test_alerts_forget_and_drop_late_rows(spark, source):
    schema = "transaction_id string, account_id string, merchant_key string, currency_native string, amount_native decimal(14,2), booked_at timestamp, flow_type string, is_reversal boolean, direction string"
    first = datetime(2026, 1, 1)
    from decimal import Decimal

    row = lambda t, day, merchant="m": (t, "a", merchant, "CAD", Decimal("5.00"), first + timedelta(days=day), "spend", False, None)
    spread = lambda lo, hi: [row(f"f{d}", d, f"only {d}") for d in range(lo, hi)]  # noqa: E731  a posting a day that nothing matches
    for part in (
        [row("t1", 0), row("t2", 2), *spread(0, 30)],
        [row("t3", 29.5, "edge"), *spread(30, 60)],
        [row("t4", 57, "wait"), row("late", 1), *spread(60, 90)],  # late: far behind the watermark of day 56
        [row("t5", 86.5, "in time"), row("t6", 88, "in time"), *spread(90, 120)],
    ):
        source(part, schema)
    one, other = (jobs.read_files(spark, source.path, spark.read.parquet(source.path).schema, 1) for _ in range(2))
    out = new_path(spark, "alerts")
    query = jobs.near_duplicate_alerts(one, other).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    got = {(r["first_transaction_id"], r["second_transaction_id"]) for r in spark.read.parquet(out).collect()}
    assert got == {("t1", "t2"), ("t5", "t6")}
    told = jobs.state_report(query)
    assert sum(t["late"] for t in told) == 2  # the late row, on either side
    assert max(t["held"] for t in told) < 2 * 75 and told[-1]["held"] < 2 * 12, told  # of 126 rows on either side


def test_slices_of_alerts_are_written_by_many_tasks():
    """A slice is no single file; before, one task read and wrote each whole slice."""
    import inspect

    from centavo.plans import streams

    assert "coalesce(1)" not in inspect.getsource(streams._alerts)
