"""Robust outliers against what came before: amounts, monthly counts, monthly spending.

A value is judged by the median and the median absolute deviation of the earlier values of its key alone; where that deviation is
zero, by Tukey's fences around the quartiles of halves. All statistics are exact to the cent.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.money import TOTAL, month
from ..functions.order_statistics import robust
from ..storage import stage

#: Fixed values by sensitivity: least modified z score, least amount difference, IQR multiplier, least count difference.
SENSITIVITY = {"low": ("5.0", "25.00", "3", 3), "balanced": ("3.5", "10.00", "1.5", 2), "high": ("2.5", "5.00", "1", 1)}
LEAST_PRIOR = 5
#: A key with more rows is judged in several tasks.
CHUNK_ROWS = 200_000
#: Rows that are judged together; no key of so few is cut.
BATCH_ROWS = 65_536
#: Quantiles among which the buckets of a hot key's values are cut; more buckets than that would not be evener.
CUTS = 1000
_OWN, _STATS = ("h1", "h2", "chunk", "real", "cents", "times"), ("prior_count", "middle", "mad", "lower", "upper")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, what came before the chunk first (not real, weighted), to the rows with the statistics of what precedes each in its group.

    Whole groups are judged together, about BATCH_ROWS rows at a time, whether they are one group or thousands."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_starts(rows))[-1])
            if cut:
                yield from _statistics(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, size = rows.to_batches(), rows.num_rows
    if size:
        yield from _statistics(pa.Table.from_batches(held).combine_chunks())


def _starts(rows: pa.Table) -> np.ndarray:
    """Whether a row begins a group."""
    start = np.zeros(rows.num_rows, bool)
    start[0] = True
    for name in ("h1", "h2", "chunk"):
        x = rows.column(name).to_numpy()
        start[1:] |= x[1:] != x[:-1]
    return start


def _statistics(rows: pa.Table) -> list[pa.RecordBatch]:
    real, cents, times = (rows.column(c).to_numpy() for c in ("real", "cents", "times"))
    start = _starts(rows)
    left, right = np.flatnonzero(start)[np.cumsum(start) - 1], np.arange(rows.num_rows)
    total = np.r_[0, np.cumsum(times)]
    asked = np.flatnonzero(real & (total[right] - total[left] >= LEAST_PRIOR))
    found = robust(cents, times, left[asked], right[asked])
    out = rows.drop_columns(list(_OWN)).take(pa.array(asked))
    for name, values in zip(_STATS, (found[c] for c in ("count", "middle", "mad", "lower", "upper")), strict=True):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out.combine_chunks().to_batches()


def _near(edges: list[int], counts: list[int], rows: int) -> list[int]:
    """Buckets of earlier values that can hold a quartile, the median or the median distance from it while so many rows are added.

    Bucket i holds values from edges[i] to before edges[i + 1]; counts: how many earlier values it holds. A rank of the union lies among the earlier
    values at most rows places lower. Distances are bounded by what surely lies, and what can lie, around the median."""
    low, high = np.array(edges[:-1], np.int64), np.array(edges[1:], np.int64) - 1
    count = np.array(counts, np.int64)
    ends = np.cumsum(count)
    n, starts = int(ends[-1]), ends - count
    wanted = np.zeros(len(count), bool)

    def bounds(share: float) -> tuple[int, int]:
        first, last = share * n - rows - 2, share * (n + rows) + 2
        some = (ends > first) & (starts <= last) & (count > 0)
        wanted[some] = True
        return int(low[some].min()), int(high[some].max())

    bounds(0.25), bounds(0.75)
    least, most = bounds(0.5)
    distances = np.unique(np.abs(np.r_[low - least, high - least, low - most, high - most]))
    can = lambda d: int(count[(high >= least - d) & (low <= most + d)].sum())
    must = lambda d: int(count[(low >= most - d) & (high <= least + d)].sum())
    few, many = n / 2 - rows - 2, (n + rows) / 2 + 2
    at = bisect.bisect_left(distances, True, key=lambda d: can(int(d)) >= few)
    small = int(distances[at - 1]) if at else 0
    at = bisect.bisect_left(distances, True, key=lambda d: must(int(d)) >= many)
    large = int(distances[at]) if at < len(distances) else int(max(abs(int(low[0])), abs(int(high[-1])))) * 2 + 1
    for a, b in ((least - large, most - small), (least + small, most + large)):
        wanted |= (low <= b) & (high >= a) & (count > 0)
    return np.flatnonzero(wanted).tolist()


def _seeds(narrow: DataFrame, days: DataFrame, hot: DataFrame) -> DataFrame:
    """(h1, h2, chunk, cents, times): what a hot key's chunk has to know of earlier values. Those near a statistic come by value, the others
    as one value and count a bucket; buckets are about as many as the chunks and hold about as many rows, so all seeds together grow with the rows."""
    group = ["h1", "h2"]
    rows = narrow.join(hot, group, "left_semi").join(days.select(*group, "day", "chunk"), [*group, "day"])
    chunks = days.groupBy(*group, "chunk").agg(F.sum("n").alias("rows"))
    last = chunks.groupBy(*group).agg((F.max("chunk") + 1).alias("buckets"))
    cuts = rows.groupBy(*group).agg(F.percentile_approx("cents", [i / CUTS for i in range(1, CUTS)], 4 * CUTS).alias("cuts"), F.min("cents").alias("lo"), F.max("cents").alias("hi")).join(last, group)
    some = F.transform(F.sequence(F.lit(1), F.least(F.col("buckets"), F.lit(CUTS - 1))), lambda i: F.get("cuts", F.floor((i - 1) * (CUTS - 1) / F.least(F.col("buckets"), F.lit(CUTS - 1))).cast("int")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array("lo"), F.filter(some, lambda v: v > F.col("lo")), F.array(F.col("hi") + 1))))
    cuts = cuts.select(*group, "buckets", edges.alias("edges"))
    placed = rows.groupBy(*group, "cents", "chunk").agg(F.count("*").alias("n")).join(cuts, group).select(*group, "cents", "chunk", "n", (F.size(F.filter("edges", lambda e: e <= F.col("cents"))) - 1).alias("bucket"))
    placed = stage(placed, "earlier-values")
    earlier = Window.partitionBy(*group, "bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    grid = cuts.select(*group, F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("chunk"), F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bucket", "low"))
    sums = placed.groupBy(*group, "chunk", "bucket").agg(F.sum("n").alias("n"))
    grid = grid.join(sums, [*group, "chunk", "bucket"], "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0)))
    grid = stage(grid.where("chunk > 0").select(*group, "chunk", "bucket", "low", "before"), "value-buckets")
    each = grid.groupBy(*group, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "before"))), lambda x: x["before"]).alias("counts"))
    each = each.join(cuts.select(*group, "edges"), group).join(chunks, [*group, "chunk"])
    near = F.pandas_udf(lambda e, c, r: pd.Series([_near(list(x), list(y), int(z)) for x, y, z in zip(e, c, r, strict=True)]), "array<int>")
    wanted = stage(each.select(*group, "chunk", F.explode(near("edges", "counts", "rows")).alias("bucket")), "wanted-buckets")
    exact = placed.withColumnRenamed("chunk", "of").join(wanted, [*group, "bucket"]).where("of < chunk").groupBy(*group, "chunk", "cents").agg(F.sum("n").alias("times"))
    whole = grid.where("before > 0").join(wanted, [*group, "chunk", "bucket"], "left_anti").select(*group, "chunk", F.col("low").alias("cents"), F.col("before").alias("times"))
    return exact.unionByName(whole)


def prior_statistics(rows: DataFrame, keys: list[str], day: str, tie: str, value: str, chunk_rows: int | None = CHUNK_ROWS, scoped: bool = False) -> DataFrame:
    """Adds prior_count, baseline, mad, lower_quartile and upper_quartile of the earlier values of a row's key, in the order of day and
    tie; rows with fewer than LEAST_PRIOR earlier ones go. scoped: market_scope is a key, and rows have market_code instead; they are dealt once for all their scopes.

    Rows move once, with all their columns, into tasks by key, and are sorted there by two 64-bit hashes. A key with more than chunk_rows rows is cut at days, and each part
    starts from a summary of the values before it (_seeds), so no task holds the rows of a hot key; a part is at least one day. Parts of less than BATCH_ROWS rows would meet
    in a task's batch again, with summaries larger than they are: consecutive ones stay together up to that size. Without chunk_rows no key may be hot, and rows lie by key already."""
    of = [k for k in keys if not scoped or k != "market_scope"]
    wide = (lambda df: _scoped(df).drop("market_code")) if scoped else (lambda df: df)
    columns = [f for f in wide(rows).schema.fields]
    group, names = ["h1", "h2"], [f.name for f in columns]
    marks = [F.xxhash64(F.lit(1), *keys).alias("h1"), F.xxhash64(F.lit(2), *keys).alias("h2"), (F.col(value) * 100).cast("long").alias("cents")]
    start = lambda df: df.select("*", *marks, F.lit(True).alias("real"), F.lit(1).cast("long").alias("times"))
    ready = lambda df: df.sortWithinPartitions(*group, "chunk", "real", day, F.col(tie).cast("string")).select(*names, *_OWN)
    schema = StructType([*columns, *[StructField(c, LongType()) for c in _STATS]])
    if chunk_rows is None:
        found = ready(start(wide(rows)).withColumn("chunk", F.lit(0))).mapInArrow(_judged, schema)
    else:
        chunk_rows = max(chunk_rows, BATCH_ROWS)
        hot = stage(rows.groupBy(*of).agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).drop("n"), "hot-keys")
        some = not hot.isEmpty()
        cold = _apart(rows, hot, of, "left_anti") if some else rows
        found = ready(start(wide(cold.repartition(*of))).withColumn("chunk", F.lit(0))).mapInArrow(_judged, schema)
        if some:
            found = found.unionByName(ready(_parts(stage(start(wide(_apart(rows, hot, of, "left_semi"))), "observations"), day, tie, chunk_rows)).mapInArrow(_judged, schema))
    money = lambda c: (F.col(c).cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(TOTAL)
    return found.select(*names, "prior_count", money("middle").alias("baseline"), money("mad").alias("mad"), money("lower").alias("lower_quartile"), money("upper").alias("upper_quartile"))


def _apart(rows: DataFrame, hot: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The rows of hot keys (so few that they are sent around: each has more than BATCH_ROWS rows), or those of no hot key; null keys are equal here."""
    of = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    same = [*[c.alias(f"__{i}") for i, c in enumerate(of)], *[F.col(k).isNull().alias(f"__{i}n") for i, k in enumerate(keys)]]
    names = [f"__{i}{n}" for n in ("", "n") for i in range(len(keys))]
    return rows.select("*", *same).join(F.broadcast(hot.select(*same)), names, how).drop(*names)


def _parts(held: DataFrame, day: str, tie: str, chunk_rows: int) -> DataFrame:
    """Rows of hot keys (with h1, h2, cents, real, times) and what their chunks have to know of earlier values, dealt by chunk."""
    group = ["h1", "h2"]
    narrow = held.select(*group, F.col(day).alias("day"), "cents")
    days = narrow.groupBy(*group, "day").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    days = days.withColumn("before", before).select(*group, "day", "n", F.floor(F.col("before") / chunk_rows).alias("part"))
    days = stage(days.select(*group, "day", "n", (F.dense_rank().over(Window.partitionBy(*group).orderBy("part")) - 1).alias("chunk")), "days")
    seeds = _seeds(narrow, days, narrow.select(*group).distinct()).select(*group, "chunk", F.lit(False).alias("real"), "cents", "times")
    parts = held.join(days.select(*group, F.col("day").alias(day), "chunk"), [*group, day], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    return parts.unionByName(seeds, allowMissingColumns=True).repartition(*group, "chunk")


def judge(stats: DataFrame, value: Column, least: str, sensitivity: str, two_sided: bool) -> DataFrame:
    """The rows of prior_statistics() that are outliers, with difference, method and score (null where the fences have no width)."""
    z, _, times, _ = SENSITIVITY[sensitivity]
    diff = (value - F.col("baseline")).cast(TOTAL)
    size = F.abs(diff) if two_sided else diff
    width = F.col("upper_quartile") - F.col("lower_quartile")
    by_mad = F.bround(F.lit(Decimal("0.6745")) * diff / F.col("mad"), 4).cast("decimal(18,4)")
    above, below = value > F.col("upper_quartile") + F.lit(Decimal(times)) * width, value < F.col("lower_quartile") - F.lit(Decimal(times)) * width
    outside = (above | below) if two_sided else above
    edge = F.when(value > F.col("upper_quartile"), F.col("upper_quartile")).otherwise(F.col("lower_quartile")) if two_sided else F.col("upper_quartile")
    by_iqr = F.when(width > 0, F.bround((value - edge) / width, 4)).cast("decimal(18,4)")
    mad = F.col("mad") > 0
    fires = F.when(mad, (F.abs(by_mad) if two_sided else by_mad) >= F.lit(Decimal(z))).otherwise((width == 0) | outside)
    rows = stats.where((size >= F.lit(Decimal(least))) & fires)
    return rows.select("*", diff.alias("difference"), F.when(mad, "mad").otherwise("iqr").alias("method"), F.when(mad, by_mad).otherwise(by_iqr).alias("score"))


def _scoped(txn: DataFrame) -> DataFrame:
    from .cube import scopes

    return txn.withColumn("market_scope", F.explode(scopes()))


def amounts(txn: DataFrame, sensitivity: str = "balanced", least: str | None = None) -> DataFrame:
    """Valued postings whose magnitude is far from earlier ones of their merchant and flow, by scope; transfers and refunds are left out."""
    rows = txn.where("merchant_key is not null and amount_base is not null and flow_type not in ('transfer', 'refund')")
    rows = rows.select("market_code", "merchant_key", "flow_type", "transaction_id", "account_id", "booked_date", "amount_base", F.abs("amount_base").cast(TOTAL).alias("value"))
    stats = prior_statistics(rows, ["market_scope", "merchant_key", "flow_type"], "booked_date", "transaction_id", "value", scoped=True)
    return judge(stats, F.col("value"), least or SENSITIVITY[sensitivity][1], sensitivity, two_sided=True)


def frequency(txn: DataFrame, as_of: Column, sensitivity: str = "balanced") -> DataFrame:
    """Months before as_of's in which a merchant and flow occur far more often than before; months without a posting between count as zero."""
    keys = ["market_scope", "merchant_key", "flow_type"]
    rows = _scoped(txn.where("merchant_key is not null and flow_type not in ('transfer', 'refund')").where(F.col("booked_date") < month(as_of)))
    counts = rows.groupBy(*keys, month(F.col("booked_date")).alias("period_start")).agg(F.count("*").alias("n"))
    filled = _filled(counts, keys, "n")
    stats = prior_statistics(filled, keys, "period_start", "period_start", "value", chunk_rows=None)
    return judge(stats, F.col("value"), str(SENSITIVITY[sensitivity][3]), sensitivity, two_sided=False)


def spikes(cube: DataFrame, as_of: Column, sensitivity: str = "balanced", least: str | None = None) -> DataFrame:
    """Months before as_of's in which a category's or merchant's spending is far above earlier months. cube: monthly() with dimensions total, category
    and merchant. A month with a pending posting anywhere in the scope counts for no key."""
    keys = ["market_scope", "dimension_type", "dimension_key"]
    known = cube.where(F.col("period_start") < month(as_of))
    partial = known.where("dimension_type = 'total' and pending_count > 0").select("market_scope", "period_start")
    months = known.where("dimension_type in ('category', 'merchant')").select(*keys, "period_start", "spending")
    filled = _filled(months, keys, "spending").join(F.broadcast(partial), ["market_scope", "period_start"], "left_anti")  # a row a scope and month
    stats = prior_statistics(filled.select(*keys, "period_start", "value"), keys, "period_start", "period_start", "value", chunk_rows=None)
    return judge(stats, F.col("value"), least or SENSITIVITY[sensitivity][1], sensitivity, two_sided=False)


def _filled(months: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every month from a key's first to its last, with its value, or zero. The months of a key lie in one task (a row a month is all that a key can have)."""
    held = months.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("period_start", F.col(value).cast(TOTAL).alias("value")))).alias("held"), F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
    each = held.select(*keys, "held", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("period_start"))
    return each.select(*keys, "period_start", F.coalesce(F.try_element_at("held", F.col("period_start")), F.lit(0).cast(TOTAL)).alias("value"))
