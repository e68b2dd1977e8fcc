"""When sources last changed, from Parquet footers alone, and whether a published run is behind them.

Footers hold the greatest value of a whole number in each row group, but none that Spark may use of a timestamp. So a source's time
of change is also kept in microseconds, and its maximum is pushed down: no column data is read, however large the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column of a source that holds its rows' times of change, in microseconds.
MICROS = "changed_us"


def write_source(df: DataFrame, path: str, column: str = "updated_at") -> None:
    df.withColumn(MICROS, F.unix_micros(F.col(column).cast("timestamp"))).write.parquet(path)


def footers(spark: SparkSession) -> SparkSession:
    """A session, beside the given one, whose Parquet source answers maxima from footers."""
    aside = spark.newSession()
    aside.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    old = [s for s in (aside.conf.get("spark.sql.sources.useV1SourceList") or "").split(",") if s and s != "parquet"]
    aside.conf.set("spark.sql.sources.useV1SourceList", ",".join(old) or "none")
    aside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return aside


def newest(aside: SparkSession, path: str) -> DataFrame:
    """(changed) of one source: its latest change; null of an empty one."""
    return aside.read.parquet(path).agg(F.max(MICROS).alias("us")).select(F.timestamp_micros("us").alias("changed"))


def watermarks(spark: SparkSession, sources: dict[str, str], rates: str) -> DataFrame:
    """One row (watermark, fx_watermark): the latest change of any source, of those that hold rows, and the latest fetch of a rate."""
    aside = footers(spark)
    out = newest(aside, rates).withColumnRenamed("changed", "fx_watermark")
    for name, path in sources.items():
        out = out.crossJoin(newest(aside, path).withColumnRenamed("changed", f"{name}_changed"))  # one row each
    names = [F.col(f"{name}_changed") for name in sources]
    return out.select((F.greatest(*names) if len(names) > 1 else names[0]).alias("watermark"), "fx_watermark")


def freshness(marks: DataFrame, watermark: datetime | None, fx_watermark: datetime | None) -> DataFrame:
    """Adds source_changed and fx_rates_changed against the marks of a run; a run without a mark is behind any change."""
    behind = lambda c, seen: F.coalesce(F.col(c) > F.lit(seen), F.lit(False)) if seen is not None else F.col(c).isNotNull()
    return marks.select("watermark", "fx_watermark", behind("watermark", watermark).alias("source_changed"), behind("fx_watermark", fx_watermark).alias("fx_rates_changed"))
