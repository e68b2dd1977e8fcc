"""Times the headline queries and the whole refresh; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from centavo import fixtures
from centavo.operators import findings, refresh, statements
from centavo.plans import QUERIES, registry
from centavo.storage import new_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("agg_trends", "agg_monthly", "join_fx_asof", "agg_cashflow", "agg_compare", "agg_position", "win_running_native", "agg_fx_cost", "det_near_duplicate", "det_recurring", "det_amount_outlier", "det_frequency", "det_spike", "agg_trends_read", "read_transactions")


def whole_refresh(spark: SparkSession) -> None:
    """The reference's benchmark: all postings through cube, series, findings and publication, from nothing published."""
    rows = registry.postings(spark, SF_DIR).withColumn("updated_at", F.col("booked_date").cast("timestamp"))
    checked = statements.coverage_status(statements.reconcile(fixtures.view(spark, SF_DIR, "d_statement"), fixtures.view(spark, SF_DIR, "d_txn")))
    sources = findings.statement_findings(checked, fixtures.view(spark, SF_DIR, "d_account"))
    refresh.refresh(refresh.Store(spark, new_path(spark, "bench-store")), rows, sources, "2001-06-15", "full").collect()


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name: str, job: object) -> None:
        began = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - began, 3)

    run = lambda name: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    timed("derive_tables", lambda: [fixtures.view(spark, SF_DIR, name).count() for name in ("d_txn", "d_statement", "d_posting")])
    run("agg_trends")  # warm-up, not counted
    for name in HEADLINE:
        timed(name, lambda name=name: run(name))
    timed("job_refresh", lambda: whole_refresh(spark))
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
