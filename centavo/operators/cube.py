"""Monthly aggregates by scope and dimension, trends, coverage, cash flow, seasonality, movers and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import TOTAL, exact_median, month, percent_change, percent_change4, total


DIMENSIONS = ("total", "account", "category", "merchant")
_KEYS = ["market_scope", "dimension_type", "dimension_key", "period_start"]
_SUMS = ("inflow", "outflow", "spending", "net")


def scopes() -> Column:
    """A posting counts in scope ALL and in its account's market."""
    return F.array_compact(F.array(F.lit("ALL"), F.col("market_code")))


def monthly(txn: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(market_scope, dimension_type, dimension_key, period_start, sums, counts, pending by currency, coverage) of the wanted dimensions; total has key ''.

    Scopes and dimensions are exploded once, so one partially aggregated shuffle serves all. Pending rows are counted and add
    nothing; only they are counted by currency, in a second and small aggregate. Months of total without a posting are filled in."""
    keys = {"total": F.lit(""), "account": F.col("account_id"), "category": F.col("category_id"), "merchant": F.col("merchant_id")}
    dims = F.array(*[F.struct(F.lit(t).alias("dimension_type"), keys[t].alias("dimension_key")) for t in dimensions])
    rows = txn.select("flow_type", "amount_base", "currency_native", month(F.col("booked_date")).alias("period_start"), F.explode(scopes()).alias("market_scope"), F.filter(dims, lambda d: d["dimension_key"].isNotNull()).alias("dims"))
    rows = rows.select("*", F.explode("dims").alias("d")).select("*", "d.*")
    amount = F.abs("amount_base")
    spent = F.when(F.col("flow_type").isin("spend", "fee"), amount).when(F.col("flow_type") == "refund", -amount)
    out = rows.groupBy(*_KEYS).agg(total(F.when(F.col("flow_type") == "income", amount)).alias("inflow"), total(spent).alias("outflow"), F.count("*").alias("transaction_count"), F.count("amount_base").alias("valued_count"))
    pending = rows.where("amount_base is null").groupBy(*_KEYS, "currency_native").agg(F.count("*").cast("int").alias("n"))
    pending = pending.groupBy(*_KEYS).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency_native", "n")))).alias("pending_fx_by_currency"))
    out = out.join(pending, _KEYS, "left").withColumn("pending_count", F.col("transaction_count") - F.col("valued_count"))
    if "total" in dimensions:
        months = rows.where("dimension_type = 'total'").groupBy("market_scope").agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
        spine = months.select("market_scope", F.lit("total").alias("dimension_type"), F.lit("").alias("dimension_key"), F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("period_start"))
        out = out.join(spine, _KEYS, "full") if dimensions == ("total",) else out.where("dimension_type != 'total'").unionByName(spine.join(out.where("dimension_type = 'total'"), _KEYS, "left"))
    zero, none = F.lit(0).cast(TOTAL), F.lit(0).cast("long")
    sums = {"inflow": F.coalesce("inflow", zero), "outflow": F.coalesce("outflow", zero)}
    counts = [F.coalesce(c, none).alias(c) for c in ("transaction_count", "valued_count", "pending_count")]
    out = out.select(*_KEYS, *[c.alias(n) for n, c in sums.items()], *counts, "pending_fx_by_currency")
    return out.select("*", F.col("outflow").alias("spending"), (F.col("inflow") - F.col("outflow")).cast(TOTAL).alias("net"), F.when(F.col("pending_count") > 0, "partial").otherwise("complete").alias("coverage_status"))


def monthly_of(txn: DataFrame, months: DataFrame) -> DataFrame:
    """monthly() in the given months (period_start): postings of other months are left out before they are aggregated, but count for the span of total, whose months without a posting are filled in."""
    months = F.broadcast(months.select("period_start").distinct())  # a row a month
    touched = txn.join(months, month(F.col("booked_date")) == months["period_start"], "left_semi")
    return monthly(touched, tuple(d for d in DIMENSIONS if d != "total")).unionByName(monthly(txn, ("total",)).join(months, "period_start", "left_semi"))


def pending_text(pending: Column) -> Column:
    """A map of counts by currency as sorted text, empty for none."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(pending)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","), F.lit(""))


def trends(months: DataFrame) -> DataFrame:
    """Month on month and year on year of gap-filled months, with trailing mean and median of up to three rows, partial ones included. months: rows of monthly() for dimension total."""
    w = Window.partitionBy("market_scope").orderBy("period_start")
    last3 = w.rowsBetween(-2, 0)
    spent, before, year = F.col("spending"), F.lag("spending", 1).over(w), F.lag("spending", 12).over(w)
    rows = months.select("market_scope", "period_start", *_SUMS, "transaction_count", "valued_count", "pending_count", "pending_fx_by_currency", "coverage_status")
    return rows.select(
        "*",
        (spent - before).cast(TOTAL).alias("change"),
        percent_change4(spent, before).alias("change_percent"),
        (spent - year).cast(TOTAL).alias("year_change"),
        percent_change4(spent, year).alias("year_change_percent"),
        F.round(F.sum("spending").over(last3) / F.count("*").over(last3), 2).cast(TOTAL).alias("trailing_mean"),
        exact_median(F.collect_list("spending").over(last3)).alias("trailing_median"),
    )


def trends_read(cube: DataFrame, dimension: str, labels: DataFrame | None = None) -> DataFrame:
    """Trends over a published cube for one dimension: changes against the previous calendar month and year (two places), and the mean and median
    of three calendar months, a missing one as zero, only where none of the three is partial. labels: (dimension_key, label)."""
    rows = cube.where(F.col("dimension_type") == dimension)
    keys = ["market_scope", "dimension_key"]
    shifted = lambda months, name: rows.select(*keys, F.add_months("period_start", months).alias("period_start"), F.col("spending").alias(name), F.col("coverage_status").alias(f"{name}_status"))
    out = rows
    for months, name in ((1, "previous"), (2, "earlier"), (12, "year")):
        out = out.join(shifted(months, name), [*keys, "period_start"], "left")
    spent = F.col("spending")
    zero = lambda c: F.coalesce(c, F.lit(0).cast(TOTAL))
    three = F.array(spent.cast(TOTAL), zero("previous"), zero("earlier"))
    whole = (F.col("coverage_status") == "complete") & (F.coalesce("previous_status", F.lit("complete")) == "complete") & (F.coalesce("earlier_status", F.lit("complete")) == "complete")
    out = out.select(
        *keys,
        "period_start",
        "spending",
        "coverage_status",
        F.col("previous").alias("previous_spending"),
        (spent - F.col("previous")).cast(TOTAL).alias("change"),
        percent_change(spent, F.col("previous")).alias("change_percent"),
        F.col("year").alias("year_spending"),
        percent_change(spent, F.col("year")).alias("year_change_percent"),
        F.when(whole, F.round((spent + zero("previous") + zero("earlier")) / 3, 2)).cast(TOTAL).alias("trailing_mean"),
        F.when(whole, exact_median(three)).alias("trailing_median"),
    )
    return out if labels is None else out.join(labels, "dimension_key", "left")


def summary(months: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of a range of months, and its latest month against the previous month and year. months: rows of dimension total."""
    held = months.where(F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    sums = held.groupBy("market_scope").agg(*[total(F.col(c)).alias(c) for c in _SUMS], F.sum("transaction_count").alias("transaction_count"), F.sum("pending_count").alias("pending_count"), F.max("period_start").alias("latest_month"), F.max_by("spending", "period_start").alias("latest_spending"))
    at = lambda n, name: months.select("market_scope", F.add_months("period_start", n).alias("latest_month"), F.col("spending").alias(name))
    out = sums.join(at(1, "previous"), ["market_scope", "latest_month"], "left").join(at(12, "year"), ["market_scope", "latest_month"], "left")
    return out.select("*", percent_change(F.col("latest_spending"), F.col("previous")).alias("change_percent"), percent_change(F.col("latest_spending"), F.col("year")).alias("year_change_percent"))


def broken_rows(cube: DataFrame) -> DataFrame:
    """A row for each invariant that a cube row breaks."""
    rules = {
        "first_of_month": "period_start != trunc(period_start, 'month')",
        "counts": "valued_count + pending_count != transaction_count",
        "coverage": "(coverage_status = 'partial') != (pending_count > 0)",
        "key_shape": "(dimension_type = 'total') != (dimension_key = '')",
        "net": "net != inflow - outflow",
        "pending_sum": "coalesce(aggregate(map_values(pending_fx_by_currency), 0, (a, x) -> a + x), 0) != pending_count",
    }
    return cube.select(*_KEYS, F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))).alias("violation"))


def coverage(txn: DataFrame) -> DataFrame:
    pending = F.col("amount_base").isNull()
    return txn.groupBy("currency_native").agg(F.count("amount_base").alias("valued_count"), F.count_if(pending).alias("pending_count"), total(F.when(pending, F.abs("amount_native"))).alias("pending_native"))


def cashflow(txn: DataFrame) -> DataFrame:
    """Inflow, outflow and card payments by month; transfers are in neither. A card refund is inflow here, unlike in the cube."""
    card, own, base = F.col("kind") == "credit_card", F.col("kind").isin("chequing", "savings", "wallet"), F.col("amount_base")
    moved = F.col("flow_type") != "transfer"
    inflow = F.when(moved & card & (base < 0) & F.col("direction").isin("credit", "refund"), F.abs(base)).when(moved & own & (base > 0), base)
    outflow = F.when(moved & card & (base > 0) & (F.col("direction") != "payment"), base).when(moved & own & (base < 0), F.abs(base))
    out = txn.groupBy(month(F.col("booked_date")).alias("period")).agg(total(inflow).alias("inflow"), total(outflow).alias("outflow"), total(F.when(card & (F.col("direction") == "payment"), F.abs(base))).alias("card_payments"))
    return out.withColumn("net", (F.col("inflow") - F.col("outflow")).cast(TOTAL))


def seasonality(months: DataFrame, as_of: Column, least: int = 12) -> DataFrame:
    """Spending by month of year over complete months before as_of's; nothing for a scope with fewer than 12 of them."""
    rows = months.where((F.col("coverage_status") == "complete") & (F.col("period_start") < month(as_of)))
    enough = rows.groupBy("market_scope").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("market_scope")
    out = rows.join(enough, "market_scope", "left_semi").groupBy("market_scope", F.month("period_start").alias("month_number")).agg(F.count("*").alias("observation_count"), F.round(F.avg("spending"), 2).cast(TOTAL).alias("average_spending"), F.collect_list("spending").alias("s"))
    return out.select("*", exact_median(F.col("s")).alias("median_spending")).drop("s")


def movers(cube: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """Categories and merchants whose spending moved most between the two latest complete months; keys of either month count, those that did not move do not."""
    complete = cube.where((F.col("dimension_type") == "total") & (F.col("market_scope") == "ALL") & (F.col("coverage_status") == "complete") & (F.col("period_start") < month(as_of)))
    months = complete.agg(F.array_sort(F.collect_set("period_start")).alias("m")).select(F.get("m", F.size("m") - 1).alias("now"), F.get("m", F.size("m") - 2).alias("then"))
    rows = cube.where((F.col("market_scope") == "ALL") & F.col("dimension_type").isin("category", "merchant")).crossJoin(F.broadcast(months))
    part = lambda which: total(F.when(F.col("period_start") == F.col(which), F.col("spending")))
    both = rows.where("period_start in (now, then)").groupBy("dimension_type", "dimension_key").agg(part("now").alias("current"), part("then").alias("previous"))
    both = both.withColumn("change", (F.col("current") - F.col("previous")).cast(TOTAL))
    return both.where("change != 0").orderBy(F.abs("change").desc(), "dimension_type", "dimension_key").limit(most)


def movers_split(moved: DataFrame, each: int = 5) -> DataFrame:
    """Of movers(), the largest rises and the largest falls, each by its own rank. The input is a top-k report, so one task ranks a few rows."""
    side = F.when(F.col("change") > 0, "positive").when(F.col("change") < 0, "negative")
    w = Window.partitionBy("side").orderBy(F.abs("change").desc(), "dimension_type", "dimension_key")
    return moved.withColumn("side", side).where("side is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each)


def compare_years(txn: DataFrame, start: str, end: str) -> DataFrame:
    """Spending by month of a range and category, against the same month a year before; keys of either side count."""
    spent = F.when(F.col("flow_type").isin("spend", "fee"), F.abs("amount_base")).when(F.col("flow_type") == "refund", -F.abs("amount_base"))
    now = F.col("booked_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    then = F.add_months("booked_date", 12).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    side = lambda keep, day, name: txn.where(keep).select(month(day).alias("bucket"), "category_id", F.lit(name).alias("side"), spent.alias("spent"), F.col("amount_base").isNull().alias("pending"))
    rows = side(now, F.col("booked_date"), "now").unionByName(side(then, F.add_months("booked_date", 12), "then"))
    out = rows.groupBy("bucket", "category_id").agg(total(F.when(F.col("side") == "now", F.col("spent"))).alias("current"), total(F.when(F.col("side") == "then", F.col("spent"))).alias("previous"), F.count_if("pending").alias("pending_count"))
    return out.select("*", (F.col("current") - F.col("previous")).cast(TOTAL).alias("change"), percent_change(F.col("current"), F.col("previous")).alias("change_percent"))
