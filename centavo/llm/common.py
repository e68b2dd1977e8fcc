"""Shared helpers: staged tables, folds, batches and text words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import delete, new_path, stage

__all__ = ["Stages", "delete", "held_out", "new_path", "numbered", "small_batches", "stage", "table"]

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


class Stages:
    """Staged tables of one job: inside the with-block each call stages a table; at its end all but the kept ones are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Stages:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((read, path))
        return read

    def keep(self, df: DataFrame) -> DataFrame:
        """A staged table that outlives the block."""
        self.tables = [x for x in self.tables if x[0] is not df]
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes a staged table that nothing reads any more."""
        for _, path in [x for x in self.tables if x[0] is df]:
            delete(self.spark, path)
        self.keep(df)

    def __exit__(self, *failed: object) -> None:
        for _, path in self.tables:
            delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str, modulus: int, remainder: int) -> F.Column:
    """crc32 of the id as text falls on the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each stays near a bound (one longer text stands alone)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, held: Stages) -> tuple[DataFrame, DataFrame]:
    """Rows with their place (from 1) within their group, and the group's pieces: (group, piece, before, total).

    Rows are dealt by ranges of group and order, so that a group of any size lies in pieces of about one partition each; places
    within a piece and the sizes of the pieces before it give the place. order has to end in a column that tells rows apart.
    Group columns hold no nulls. Both results are staged in held; rows keep the column piece.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held(rows.repartitionByRange(parts, *group, *order).withColumn("piece", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*group, "piece").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    pieces = sizes.select(*group, "piece", F.coalesce(F.sum("n").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    pieces = held(pieces, "pieces")
    within = F.row_number().over(Window.partitionBy(*group, "piece").orderBy(*order))
    out = dealt.withColumn(name, within.cast("long")).join(pieces.select(*group, "piece", "before"), [*group, "piece"])
    return held(out.withColumn(name, F.col(name) + F.col("before")).drop("before"), name), pieces
