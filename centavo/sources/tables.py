"""Canonical Parquet tables, read by fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Columns that a file lacks come as null; other columns are not read."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def latest_fetch(rates: DataFrame, fetched: str = "fetched_at") -> DataFrame:
    """One rate a (base, quote, as_of): the latest fetch; of equal times the greatest rate. Partial maxima meet before the shuffle."""
    rest = [c for c in rates.columns if c not in ("base", "quote", "as_of")]
    first = F.max(F.struct(fetched, "rate", *[c for c in rest if c not in (fetched, "rate")])).alias("r")
    return rates.groupBy("base", "quote", "as_of").agg(first).select("base", "quote", "as_of", *[F.col(f"r.{c}").alias(c) for c in rest])


def up_to(rows: DataFrame, column: str, watermark: object) -> DataFrame:
    """The rows of a pinned snapshot: not changed after the watermark."""
    return rows.where(F.col(column) <= F.lit(watermark))
