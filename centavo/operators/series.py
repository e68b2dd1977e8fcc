"""Recurring series, their price increases and overdue dates."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, TOTAL, base_price, exact_median, fingerprint, native_price
from .cube import scopes

#: Cadences with their ranges and typical length in days, shortest first.
CADENCES = (("weekly", 5, 9, 7), ("biweekly", 12, 16, 14), ("monthly", 25, 35, 30), ("quarterly", 80, 100, 90), ("annual", 330, 400, 365))
POLICY = "materiality-v1"
_KEYS = ["market_scope", "merchant_key", "flow_type"]


def _within(lo: int, hi: int) -> Callable[[Column], Column]:
    return lambda gap: gap.between(lo, hi)


def _ratio(a: Column, b: Column) -> Column:
    return F.bround(a.cast("decimal(18,8)") / b, 4).cast("decimal(5,4)")


def recurring(txn: DataFrame, as_of: Column, base_currency: str = "CAD", policy: str = POLICY) -> DataFrame:
    """A row for each evenly spaced merchant and flow of a scope: cadence, comparison basis, expected amount, next date, stabilities, confidence,
    fingerprint, and the occurrences (date, id, account, compared price, base price).

    Two postings on one day rule a series out, so merchants with more postings than days leave at a partial aggregate, and what
    is gathered into one row has a row a day at most."""
    rows = txn.where("merchant_key is not null and flow_type in ('spend', 'income') and amount_native != 0").withColumn("market_scope", F.explode(scopes()))
    even = rows.groupBy(*_KEYS, "booked_date").agg(F.count("*").alias("n")).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.count("*").alias("days")).where("n = days and n >= 2").select(*_KEYS)
    price, base = native_price(F.col("amount_native"), F.col("fx_fee_amount_native")), base_price(F.col("amount_base"), F.col("amount_native"), F.col("fx_fee_amount_native"))
    item = F.struct("booked_date", "transaction_id", "account_id", F.abs("original_amount").cast(MONEY).alias("original"), price.alias("native"), base.alias("base"))
    held = rows.join(even, _KEYS, "left_semi").groupBy(*_KEYS).agg(
        F.sort_array(F.collect_list(item)).alias("o"),
        F.min("original_currency").alias("oc"),
        (F.min("original_currency") == F.max("original_currency")).alias("one_original"),
        F.count("original_amount").alias("originals"),
        F.min("currency_native").alias("nc"),
        (F.min("currency_native") == F.max("currency_native")).alias("one_native"),
        F.count("amount_base").alias("valued"),
        F.when(F.min("merchant_id") == F.max("merchant_id"), F.min("merchant_id")).alias("merchant_id"),
    )
    n = F.size("o")
    held = held.withColumn("gaps", F.transform(F.slice("o", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, i: F.datediff(x["booked_date"], F.get(F.col("o"), i)["booked_date"])))
    for name, lo, hi, _ in CADENCES:
        held = held.withColumn(name, F.size(F.filter("gaps", _within(lo, hi))))
    best = F.greatest(*[F.col(c[0]) for c in CADENCES])
    held = held.withColumn("matches", best).withColumn("cadence", F.coalesce(*[F.when(F.col(c[0]) == best, c[0]) for c in CADENCES]))
    held = held.where((F.col("matches") * 4 >= F.size("gaps") * 3) & ((F.col("cadence") == "annual") | (n >= 3)))
    basis = F.when(F.coalesce("one_original", F.lit(False)) & (F.col("originals") == n), "original").when(F.col("one_native"), "native").when(F.col("valued") == n, "base")
    held = held.withColumn("basis", basis).where("basis is not null")
    held = held.withColumn("currency", F.when(F.col("basis") == "original", F.col("oc")).when(F.col("basis") == "native", F.col("nc")).otherwise(F.lit(base_currency)))
    chosen = lambda x: F.when(F.col("basis") == "original", x["original"]).when(F.col("basis") == "native", x["native"]).otherwise(x["base"])
    held = held.withColumn("occurrences", F.transform("o", lambda x: F.struct(x["booked_date"].alias("booked_date"), x["transaction_id"].alias("transaction_id"), x["account_id"].alias("account_id"), chosen(x).alias("price"), x["base"].alias("base"))))
    held = held.withColumn("prices", F.transform("occurrences", lambda x: x["price"])).where(F.forall("prices", lambda p: F.coalesce(p > 0, F.lit(False))))
    held = held.withColumn("expected_amount", exact_median(F.col("prices"))).withColumn("step", F.round(exact_median(F.transform("gaps", lambda g: g.cast(TOTAL)))).cast("int"))
    near = F.size(F.filter("prices", lambda p: F.abs(p - F.col("expected_amount")) * 10 <= F.col("expected_amount")))
    last = F.element_at("occurrences", -1)["booked_date"]
    held = held.withColumn("interval_stability", _ratio(F.col("matches"), F.size("gaps"))).withColumn("amount_stability", _ratio(near, n))
    confidence = F.bround(F.col("interval_stability") * F.lit(Decimal("0.55")) + F.col("amount_stability") * F.lit(Decimal("0.25")) + F.lit(Decimal("0.20")), 4).cast("decimal(5,4)")
    tail = F.when(F.col("basis") == "base", F.concat_ws("\x1f", F.lit(base_currency), F.lit(policy))).otherwise(F.col("currency"))
    name = fingerprint(F.col("market_scope"), "recurring", F.col("merchant_key"), F.col("flow_type"), F.col("basis"), tail)
    out = held.select(*_KEYS, "merchant_id", "cadence", "basis", "currency", n.alias("occurrence_count"), "expected_amount", F.get("occurrences", F.lit(0))["booked_date"].alias("first_date"), last.alias("last_date"), F.date_add(last, F.col("step")).alias("next_date"), "interval_stability", "amount_stability", confidence.alias("confidence"), name.alias("detector_fingerprint"), "occurrences")
    return out.withColumn("overdue", as_of > F.col("next_date"))


def occurrences(series: DataFrame) -> DataFrame:
    """A row an occurrence of each series, numbered from 1 in order of date and id."""
    rows = series.select("market_scope", "detector_fingerprint", "basis", "currency", F.posexplode("occurrences").alias("i", "x"))
    return rows.select("market_scope", "detector_fingerprint", (F.col("i") + 1).alias("occurrence_number"), F.col("x.transaction_id").alias("transaction_id"), F.col("x.account_id").alias("account_id"), F.col("x.booked_date").alias("occurrence_date"), F.col("x.price").alias("comparison_amount"), F.col("basis").alias("comparison_basis"), F.col("currency").alias("comparison_currency"))


#: Columns of review states: what users decided about a series.
REVIEWS = "market_scope string, detector_fingerprint string, status string, cadence_override string, expected_amount_override decimal(14,2), next_date_override date"


def _reviewed(series: DataFrame, reviews: DataFrame | None) -> DataFrame:
    if reviews is None:
        reviews = series.sparkSession.createDataFrame([], REVIEWS)
    rows = series.join(reviews, ["market_scope", "detector_fingerprint"], "left")
    return rows.where(~F.coalesce(F.col("status").isin("cancelled", "ignored"), F.lit(False)))


def price_increases(series: DataFrame, reviews: DataFrame | None = None, base_currency: str = "CAD", percent: str = "5", least_base: str = "1.00", least_by_currency: dict[str, str] | None = None) -> DataFrame:
    """Series whose latest price is above the median of the prices before by percent and by a floor in base currency. Earlier prices of other than annual series
    must lie within 5 % of their median. Without base values the floor applies only to prices in base currency or in one named in least_by_currency."""
    rows = _reviewed(series, reviews)
    n = F.col("occurrence_count")
    enough = F.when(F.col("cadence") == "annual", (n > 2) | ((n == 2) & F.coalesce(F.col("status") == "confirmed", F.lit(False)))).otherwise(n >= 4)
    rows = rows.where(enough).withColumn("latest", F.element_at("occurrences", -1)).withColumn("before", F.slice("occurrences", F.lit(1), n - 1))
    prices = F.transform("before", lambda x: x["price"])
    rows = rows.withColumn("previous_median", exact_median(prices)).withColumn("latest_amount", F.col("latest.price"))
    even = F.forall(prices, lambda p: F.abs(p - F.col("previous_median")) * 20 <= F.col("previous_median"))
    rows = rows.where((F.col("previous_median") > 0) & ((F.col("cadence") == "annual") | even))
    rows = rows.withColumn("increase_amount", (F.col("latest_amount") - F.col("previous_median")).cast(TOTAL))
    rows = rows.withColumn("increase_percent", F.bround(F.col("increase_amount") * 100 / F.col("previous_median"), 4).cast("decimal(18,4)"))
    valued = F.col("latest.base").isNotNull() & F.forall("before", lambda x: x["base"].isNotNull())
    rows = rows.withColumn("increase_base", F.when(valued, F.col("latest.base") - exact_median(F.transform("before", lambda x: x["base"]))).cast(TOTAL))
    floors = {base_currency: least_base} | (least_by_currency or {})
    floor = F.coalesce(*[F.when(F.col("currency") == c, F.lit(Decimal(v))) for c, v in floors.items()])
    material = F.when(F.col("increase_base").isNotNull(), F.col("increase_base") >= F.lit(Decimal(least_base))).otherwise(F.coalesce(F.col("increase_amount") >= floor, F.lit(False)))
    told = F.coalesce(F.col("latest_amount") > F.col("expected_amount_override"), F.lit(True))
    rows = rows.where((F.col("increase_amount") > 0) & (F.col("increase_percent") >= F.lit(Decimal(percent))) & material & told)
    return rows.select("market_scope", "detector_fingerprint", F.col("latest.transaction_id").alias("latest_transaction_id"), F.col("latest.account_id").alias("account_id"), "currency", "previous_median", "latest_amount", "increase_amount", "increase_percent", "increase_base")


def overdue(series: DataFrame, as_of: Column, reviews: DataFrame | None = None) -> DataFrame:
    """Series past their effective next date: a user's date, else the last date plus the typical days of a user's cadence, else the detected date."""
    rows = _reviewed(series, reviews)
    typical = F.coalesce(*[F.when(F.col("cadence_override") == name, F.lit(days)) for name, _, _, days in CADENCES])
    expected = F.coalesce("next_date_override", F.date_add("last_date", typical), "next_date")
    latest = F.element_at("occurrences", -1)
    rows = rows.select("market_scope", "detector_fingerprint", "merchant_key", F.coalesce("cadence_override", "cadence").alias("cadence"), expected.alias("expected_next_date"), latest["transaction_id"].alias("transaction_id"), latest["account_id"].alias("account_id"))
    return rows.where(as_of > F.col("expected_next_date"))
