"""All detectors' results as one table of findings with evidence and stable fingerprints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL, fingerprint
from ..storage import stage
from . import detect, outliers, series
from .cube import scopes

#: Findings whose meaning depends on the base currency and its thresholds.
BASE_SENSITIVE = ("unusual_amount", "monthly_spike", "recurring_price_increase", "pending_fx")


def _finding(rows: DataFrame, kind: str, severity: str, headline: Column | str, parts: list[Column], evidence: dict[str, Column], account: str | None = None, transaction: str | None = None, of_series: str | None = None) -> DataFrame:
    """Rows (with market_scope) in the common form; the fingerprint is still without its scope."""
    column = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in evidence]), F.array(*[v.cast("string") for v in evidence.values()]))
    return rows.select("market_scope", F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), (F.lit(headline) if isinstance(headline, str) else headline).alias("headline"), column(account).alias("account_id"), column(transaction).alias("transaction_id"), column(of_series).alias("series_fingerprint"), fingerprint(kind, *parts).alias("raw"), pairs.alias("evidence"))


def _plain(middle: Column, n: Column) -> Column:
    """The text of a median of whole counts: a whole number where the middle is one value, two places where it is a mean."""
    return F.when(n % 2 == 1, middle.cast("long").cast("string")).otherwise(middle.cast("decimal(18,2)").cast("string"))


def statement_findings(checked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Mismatches and gaps of checked statements, in scope ALL and in the account's market."""
    rows = checked.join(accounts.select("account_id", "market_code"), "account_id").withColumn("market_scope", F.explode(scopes()))
    c = F.col
    activity = F.coalesce("activity", F.lit(0)).cast(TOTAL)
    wrong = rows.where("reconcile_status = 'mismatch'").withColumn("short", (-c("difference")).cast(TOTAL))
    wrong = _finding(wrong, "reconciliation_mismatch", "critical", "Statement does not reconcile", [c("statement_id"), c("opening_balance"), activity, c("closing_balance"), c("short")], {"statementId": c("statement_id"), "periodStart": c("period_start"), "periodEnd": c("period_end"), "openingBalance": c("opening_balance"), "transactionTotal": activity, "reportedClosing": c("closing_balance"), "difference": c("short"), "currency": c("currency")}, "account_id")
    gap = rows.where("is_gap").withColumn("gap_start", F.date_add("covered_until", 1)).withColumn("gap_end", F.date_sub("period_start", 1))
    gap = _finding(gap, "coverage_gap", "warning", "Statement coverage gap", [c("account_id"), c("gap_start"), c("gap_end")], {"followingStatementId": c("statement_id"), "gapStart": c("gap_start"), "gapEnd": c("gap_end"), "currency": c("currency")}, "account_id")
    return wrong.unionByName(gap)


def build(txn: DataFrame, cube: DataFrame, found: DataFrame, sources: DataFrame | None, as_of: Column, reviews: DataFrame | None = None, sensitivity: str = "balanced", base_currency: str = "CAD", policy: str = series.POLICY, least: str | None = None, least_increase: str = "1.00") -> DataFrame:
    """txn: valued postings; cube: its monthly cube; found: its recurring series; sources: statement findings. One row a finding, of equal fingerprints one."""
    z, floor, times, least_count = outliers.SENSITIVITY[sensitivity]
    floor = least or floor
    c, lit = F.col, F.lit
    found = stage(found, "found-series")  # read by two detectors
    common = {"method": c("method"), "score": c("score"), "modifiedZThreshold": lit(z), "iqrMultiplier": lit(times)}
    amounts = outliers.amounts(txn, sensitivity, floor)
    parts = [_finding(amounts, "unusual_amount", "warning", "Unusual transaction amount", [c("transaction_id"), c("amount_base"), c("baseline"), c("difference"), c("method")], {"amountBase": c("amount_base"), "baselineMedian": c("baseline"), "deviationBase": c("difference"), "priorObservationCount": c("prior_count"), "minimumDifferenceBase": lit(floor)} | common, "account_id", "transaction_id")]
    often = outliers.frequency(txn, as_of, sensitivity).withColumn("times", c("value").cast("long")).withColumn("middle", _plain(c("baseline"), c("prior_count")))
    parts.append(_finding(often, "unusual_frequency", "warning", "Unusual transaction frequency", [c("merchant_key"), c("flow_type"), c("period_start"), c("times"), c("middle")], {"merchantKey": c("merchant_key"), "flowType": c("flow_type"), "periodStart": c("period_start"), "transactionCount": c("times"), "baselineMedian": c("middle"), "priorMonthCount": c("prior_count"), "minimumCountDifference": lit(least_count)} | common))
    spikes = outliers.spikes(cube, as_of, sensitivity, floor)
    parts.append(_finding(spikes, "monthly_spike", "warning", F.concat(lit("Monthly "), c("dimension_type"), lit(" spending spike")), [c("dimension_type"), c("dimension_key"), c("period_start"), c("value"), c("baseline")], {"dimensionType": c("dimension_type"), "dimensionId": c("dimension_key"), "periodStart": c("period_start"), "spendingBase": c("value"), "baselineMedian": c("baseline"), "differenceBase": c("difference"), "priorMonthCount": c("prior_count"), "minimumDifferenceBase": lit(floor)} | common))
    twice = detect.near_duplicates(txn, more=("market_code",)).withColumn("market_scope", F.explode(scopes()))
    twice = _finding(twice, "near_duplicate", "warning", "Possible duplicate charge", [lit("")], {"firstTransactionId": c("first_transaction_id"), "secondTransactionId": c("second_transaction_id"), "merchantKey": c("merchant_key"), "amountNative": c("amount_native"), "currencyNative": c("currency_native"), "daysApart": c("days_apart"), "windowDays": lit(3), "secondBookedDate": c("second_booked_date"), "fingerprint": c("detector_fingerprint")}, "account_id", "second_transaction_id")
    parts.append(twice.withColumn("raw", c("evidence")["fingerprint"]).withColumn("evidence", F.map_filter("evidence", lambda k, _: k != "fingerprint")))
    dearer = series.price_increases(found, reviews, base_currency, least_base=least_increase)
    parts.append(_finding(dearer, "recurring_price_increase", "warning", "Recurring price increased", [c("detector_fingerprint"), c("latest_transaction_id"), c("previous_median"), c("latest_amount")], {"previousMedian": c("previous_median"), "latestAmount": c("latest_amount"), "increaseAmount": c("increase_amount"), "increasePercent": c("increase_percent"), "comparisonCurrency": c("currency"), "increaseBase": c("increase_base"), "percentThreshold": lit("5"), "minimumIncreaseBase": lit(least_increase)}, "account_id", "latest_transaction_id", "detector_fingerprint"))
    late = series.overdue(found, as_of, reviews)
    parts.append(_finding(late, "recurring_overdue", "info", "Recurring transaction is overdue", [c("detector_fingerprint"), c("expected_next_date")], {"expectedNextDate": c("expected_next_date"), "cadence": c("cadence"), "merchantKey": c("merchant_key")}, "account_id", "transaction_id", "detector_fingerprint"))
    pending = txn.where("amount_base is null").withColumn("market_scope", F.explode(scopes()))
    parts.append(_finding(pending, "pending_fx", "info", f"{base_currency} valuation is pending", [c("transaction_id"), c("booked_date"), c("amount_native"), c("currency_native")], {"bookedDate": c("booked_date"), "amountNative": c("amount_native"), "currencyNative": c("currency_native")}, "account_id", "transaction_id"))
    if sources is not None:
        parts.append(sources)
    rows = functools.reduce(DataFrame.unionByName, parts)
    sensitive = F.when(c("finding_type").isin(*BASE_SENSITIVE), F.concat_ws("\x1f", lit(base_currency), lit(policy)))
    rows = rows.withColumn("detector_fingerprint", F.sha2(F.concat_ws("\x1f", "market_scope", sensitive, "raw"), 256)).drop("raw")
    more = F.create_map(lit("marketScope"), c("market_scope"), lit("baseCurrency"), lit(base_currency), lit("thresholdPolicyVersion"), lit(policy))
    return rows.withColumn("evidence", F.map_concat("evidence", more)).dropDuplicates(["market_scope", "detector_fingerprint"])
