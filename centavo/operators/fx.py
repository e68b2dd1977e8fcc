"""Nearest-prior FX rates with a staleness bound, valuation, and missing rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, RATE, rounded

STALE_DAYS = 7


def rate_days(rates: DataFrame, stale_days: int = STALE_DAYS) -> DataFrame:
    """Each day's usable rate: a rate serves its own day and the stale_days after it, unless a later one does. Turns the as-of join into an equi-join."""
    days = rates.select("base", "quote", "as_of", "rate", F.explode(F.sequence("as_of", F.date_add("as_of", stale_days))).alias("day"))
    return days.groupBy("base", "quote", "day").agg(F.max(F.struct("as_of", "rate")).alias("r")).select("base", "quote", "day", F.col("r.as_of").alias("rate_date"), F.col("r.rate").alias("rate"))


def as_of_rate(rows: DataFrame, rates: DataFrame, currency: str, quote: str, day: str, prefix: str = "fx") -> DataFrame:
    """Adds <prefix>_rate and <prefix>_rate_date: identity for equal currencies, null when no rate is fresh enough.

    Usable rates are a row a pair of currencies and day, however many rows are valued: they go to the rows, which do not move."""
    known = rate_days(rates).select(F.col("base").alias("__b"), F.col("quote").alias("__q"), F.col("day").alias("__d"), F.col("rate_date").alias("__a"), F.col("rate").alias("__r"))
    same = F.col(currency) == F.col(quote)
    needed = F.when(~same, F.col(currency))  # rows in the quote's own currency match nothing; a null key keeps them out of one hot partition
    joined = rows.join(F.broadcast(known), (needed == F.col("__b")) & (F.col(quote) == F.col("__q")) & (F.col(day) == F.col("__d")), "left")
    return joined.withColumn(f"{prefix}_rate", F.when(same, F.lit(1)).otherwise(F.col("__r")).cast(RATE)).withColumn(f"{prefix}_rate_date", F.when(same, F.col(day)).otherwise(F.col("__a"))).drop("__b", "__q", "__d", "__a", "__r")


def stamp(rows: DataFrame, rates: DataFrame, base_currency: str) -> DataFrame:
    """Values rows in the base currency; a row without a fresh rate stays pending (null), never zero."""
    valued = as_of_rate(rows.withColumn("currency_base", F.lit(base_currency)), rates, "currency_native", "currency_base", "booked_date")
    return valued.withColumn("amount_base", F.when(F.col("currency_native") == F.col("currency_base"), F.col("amount_native")).otherwise(rounded(F.col("amount_native") * F.col("fx_rate"))).cast(MONEY))


def revalue(rows: DataFrame, rates: DataFrame, base_currency: str) -> DataFrame:
    """Rows whose valuation changes when stamped again in a currency."""
    now = stamp(rows.withColumnsRenamed({"fx_rate": "__rate", "fx_rate_date": "__date", "amount_base": "__amount"}), rates, base_currency)
    same = F.col("fx_rate").eqNullSafe(F.col("__rate")) & F.col("fx_rate_date").eqNullSafe(F.col("__date")) & F.col("amount_base").eqNullSafe(F.col("__amount"))
    return now.where(~same).drop("__rate", "__date", "__amount")


def requirements(txn: DataFrame, statements: DataFrame, base_currency: str, accounts: DataFrame | None = None, as_of: str | None = None, switch_to: str | None = None) -> DataFrame:
    """Distinct (base, quote, day) that valuations need: postings, statements' ends, purchases' own currencies, accounts' currencies on the day
    as_of, and the pair of a switch of the base currency on that day."""
    base = F.lit(base_currency)
    parts = [
        txn.select(F.col("currency_native").alias("base"), base.alias("quote"), F.col("booked_date").alias("day")),
        statements.select(F.col("currency").alias("base"), base.alias("quote"), F.col("period_start").alias("day")),
        statements.select(F.col("currency").alias("base"), base.alias("quote"), F.col("period_end").alias("day")),
        txn.select(F.col("original_currency").alias("base"), F.col("currency_native").alias("quote"), F.col("booked_date").alias("day")),
    ]
    if accounts is not None:
        parts.append(accounts.select(F.col("native_currency").alias("base"), base.alias("quote"), F.lit(as_of).cast("date").alias("day")))
        if switch_to:
            parts.append(accounts.select(base.alias("base"), F.lit(switch_to).alias("quote"), F.lit(as_of).cast("date").alias("day")).distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("base is not null and base != quote").distinct()


def missing(needed: DataFrame, rates: DataFrame) -> DataFrame:
    return needed.join(rate_days(rates), ["base", "quote", "day"], "left_anti")
