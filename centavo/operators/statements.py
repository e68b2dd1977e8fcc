"""Statements: reconciliation, coverage, latest and first balances, positions, running balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import TOTAL, rounded, total

_TRUSTED = ("ok", "gap", "pending")


def reconcile(statements: DataFrame, txn: DataFrame) -> DataFrame:
    """opening + the statement's postings (by statement_id) against closing: ok, mismatch or pending (no opening or no closing), with calculated - reported."""
    sums = txn.where("statement_id is not null").groupBy("statement_id").agg(total(F.col("amount_native")).alias("activity"))
    rows = statements.join(sums, "statement_id", "left")
    difference = (F.col("opening_balance") + F.coalesce("activity", F.lit(0)) - F.col("closing_balance")).cast(TOTAL)
    return rows.withColumn("difference", difference).withColumn("balance_status", F.when(F.col("closing_balance").isNull() | F.col("opening_balance").isNull(), "pending").when(F.col("difference") == 0, "ok").otherwise("mismatch"))


def coverage_status(reconciled: DataFrame) -> DataFrame:
    """Overlays gaps on statements that reconcile: a gap is a period that begins over a day after all earlier ones end."""
    earlier = Window.partitionBy("account_id").orderBy("period_start", "period_end", "statement_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = reconciled.withColumn("covered_until", F.max("period_end").over(earlier))
    gap = F.col("period_start") > F.date_add("covered_until", 1)
    return rows.withColumn("is_gap", F.coalesce(gap, F.lit(False))).withColumn("reconcile_status", F.when((F.col("balance_status") == "ok") & F.col("is_gap"), "gap").otherwise(F.col("balance_status")))


def gaps(checked: DataFrame) -> DataFrame:
    return checked.where("is_gap").select("account_id", "statement_id", F.date_add("covered_until", 1).alias("gap_start"), F.date_sub("period_start", 1).alias("gap_end"))


def positions(accounts: DataFrame, checked: DataFrame, txn: DataFrame) -> DataFrame:
    """Balance an account: the latest closing plus later postings, else the first opening plus all, else net activity."""
    closed = F.when(F.col("closing_balance").isNotNull(), F.struct("period_end", "statement_id", "closing_balance", "reconcile_status"))
    opened = F.when(F.col("reconcile_status").isin(*_TRUSTED) & F.col("opening_balance").isNotNull(), F.struct("period_start", "statement_id", "opening_balance"))
    ends = checked.groupBy("account_id").agg(F.max(closed).alias("latest"), F.min(opened).alias("first"))
    after = F.coalesce("posted_date", "booked_date") > F.col("latest.period_end")
    activity = txn.select("account_id", "posted_date", "booked_date", "amount_native").join(ends, "account_id", "left").groupBy("account_id").agg(total(F.col("amount_native")).alias("all"), total(F.when(after, F.col("amount_native"))).alias("later"))
    rows = accounts.join(ends, "account_id", "left").join(activity, "account_id", "left")
    trusted = F.coalesce(F.col("latest.reconcile_status").isin(*_TRUSTED), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    balance = F.when(trusted, F.col("latest.closing_balance") + zero("later")).otherwise(zero("first.opening_balance") + zero("all"))
    known = trusted | (F.col("latest").isNull() & F.col("first.opening_balance").isNotNull())
    rows = rows.select("account_id", "kind", "native_currency", "credit_limit", balance.cast(TOTAL).alias("current_balance"), F.when(known, "balance").otherwise("net_activity").alias("balance_basis"), F.col("latest.period_end").alias("last_statement_date"))
    usable = (F.col("kind") == "credit_card") & F.col("credit_limit").isNotNull() & (F.col("balance_basis") == "balance")
    used = F.greatest("current_balance", F.lit(0).cast(TOTAL))
    return rows.select("*", F.when(usable, used).cast(TOTAL).alias("used_credit"), F.when(usable, F.col("credit_limit") - F.col("current_balance")).cast(TOTAL).alias("available_credit"), F.when(usable, F.round(used * 100 / F.col("credit_limit"), 2)).cast(TOTAL).alias("utilization_percent"))


def _valued(held: DataFrame, rates: DataFrame, base_currency: str, as_of: str) -> DataFrame:
    from .fx import as_of_rate

    return as_of_rate(held.withColumn("quote", F.lit(base_currency)).withColumn("day", F.lit(as_of).cast("date")), rates, "native_currency", "quote", "day").drop("quote", "day")


def contributions(held: DataFrame, rates: DataFrame, base_currency: str, as_of: str) -> DataFrame:
    """A row an account: its balance's value in the base currency and what it adds to net worth (cards negated), or why it is left out:
    unverified_balance (mere net activity) before missing_fx_rate."""
    rows = _valued(held, rates, base_currency, as_of)
    reason = F.when(F.col("balance_basis") != "balance", "unverified_balance").when(F.col("fx_rate").isNull(), "missing_fx_rate")
    value = F.when(reason.isNull(), rounded(F.col("current_balance") * F.col("fx_rate"))).cast(TOTAL)
    share = F.when(F.col("kind") == "credit_card", -F.col("base_value")).otherwise(F.col("base_value")).cast(TOTAL)
    rows = rows.select("account_id", "kind", "native_currency", "current_balance", "fx_rate", "fx_rate_date", value.alias("base_value"), reason.alias("excluded_reason"))
    return rows.withColumn("contribution", share)


def net_worth(held: DataFrame, rates: DataFrame, base_currency: str, as_of: str) -> DataFrame:
    """Assets, liabilities and net over the accounts that contribute; those left out are counted by reason and make the figures partial."""
    rows, value = contributions(held, rates, base_currency, as_of), F.col("contribution")
    left_out = lambda reason: F.count_if(F.col("excluded_reason") == reason)
    return rows.agg(total(F.when(value > 0, value)).alias("assets"), total(F.when(value < 0, -value)).alias("liabilities"), total(value).alias("net_worth"), left_out("missing_fx_rate").alias("missing_fx"), left_out("unverified_balance").alias("unverified"), (F.count("excluded_reason") > 0).alias("is_partial"))


def credit(held: DataFrame, rates: DataFrame, base_currency: str, as_of: str) -> DataFrame:
    """A row a card: used, limit and available in the base currency, or why it is left out: missing_credit_limit, unverified_balance, missing_fx_rate, in that order."""
    rows = _valued(held.where("kind = 'credit_card'"), rates, base_currency, as_of)
    reason = F.when(F.col("credit_limit").isNull(), "missing_credit_limit").when(F.col("balance_basis") != "balance", "unverified_balance").when(F.col("fx_rate").isNull(), "missing_fx_rate")
    worth = lambda c: F.when(reason.isNull(), rounded(F.col(c) * F.col("fx_rate"))).cast(TOTAL)
    return rows.select("account_id", "native_currency", "current_balance", "credit_limit", "used_credit", "fx_rate", worth("used_credit").alias("used_base"), worth("credit_limit").alias("limit_base"), worth("available_credit").alias("available_base"), reason.alias("excluded_reason"))


def utilization(cards: DataFrame) -> DataFrame:
    """One row over the cards of credit(): sums of those that count, their use in percent by unrounded values, and how many count or are left out. Without any, percent is null."""
    counts = F.col("excluded_reason").isNull()
    exact = lambda c: F.sum(F.when(counts, F.col(c) * F.col("fx_rate")))
    sums = [total(F.col(c)).alias(n) for c, n in (("used_base", "used_credit_base"), ("limit_base", "credit_limit_base"), ("available_base", "available_credit_base"))]
    percent = F.round(exact("used_credit") * 100 / F.nullif(exact("credit_limit"), F.lit(0)), 2).cast(TOTAL)
    return cards.agg(*sums, percent.alias("utilization_percent"), F.count_if(counts).alias("included_accounts"), F.count("excluded_reason").alias("excluded_accounts"))


def openings(accounts: DataFrame, checked: DataFrame, rates: DataFrame, base_currency: str) -> DataFrame:
    """A row an account: its first trusted opening in the base currency, by the rate of that statement's first day (null without either), and whether
    that opening bears a balance: it is valued, and no statement with a balance fails to reconcile."""
    from .fx import as_of_rate

    opened = F.when(F.col("reconcile_status").isin(*_TRUSTED) & F.col("opening_balance").isNotNull(), F.struct("period_start", "statement_id", "opening_balance"))
    wrong = (F.col("reconcile_status") == "mismatch") & (F.col("opening_balance").isNotNull() | F.col("closing_balance").isNotNull())
    first = checked.groupBy("account_id").agg(F.min(opened).alias("first"), F.bool_or(F.coalesce(wrong, F.lit(False))).alias("wrong"))
    rows = accounts.select("account_id", "kind", "native_currency").join(first, "account_id", "left")
    rows = rows.select("account_id", "kind", "native_currency", "wrong", F.col("first.period_start").alias("day"), F.col("first.opening_balance").alias("opening"), F.lit(base_currency).alias("quote"))
    valued = F.when(F.col("native_currency") == base_currency, F.col("opening")).otherwise(rounded(F.col("opening") * F.col("fx_rate"))).cast(TOTAL)
    rows = as_of_rate(rows, rates, "native_currency", "quote", "day").withColumn("opening_base", valued)
    return rows.select("account_id", "kind", "opening_base", (F.col("opening_base").isNotNull() & ~F.coalesce("wrong", F.lit(False))).alias("is_balance"))


def balance_series(txn: DataFrame, opened: DataFrame, consolidated: bool = True) -> DataFrame:
    """The balance in base currency at the end of each day with postings: openings plus all deltas so far, up to the day before the first pending posting.

    One series over all accounts given (cards negated; account_id null), or one an account. basis is balance where every account of the series has an opening that bears it,
    else net_activity. Postings become one row an account and day first; sums run over a series' months, then over a month's days, so that no task
    sees more than the months of a series or the days of a month."""
    signed = lambda c: F.when(F.col("kind") == "credit_card", -F.col(c)).otherwise(F.col(c)) if consolidated else F.col(c)
    key = ["series"]
    begin = opened.withColumn("series", F.lit("") if consolidated else F.col("account_id")).groupBy(*key).agg(total(signed("opening_base")).alias("opening"), F.when(F.bool_and("is_balance"), "balance").otherwise("net_activity").alias("basis"))
    days = txn.groupBy("account_id", F.coalesce("posted_date", "booked_date").alias("day")).agg(F.sum("amount_base").alias("amount"), F.count_if(F.col("amount_base").isNull()).alias("pending"))
    days = days.join(opened.select("account_id", "kind"), "account_id").withColumn("series", F.lit("") if consolidated else F.col("account_id"))
    days = days.groupBy(*key, "day").agg(total(signed("amount")).alias("delta"), F.sum("pending").alias("pending")).withColumn("month", F.trunc("day", "month"))
    earlier = Window.partitionBy(*key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = days.groupBy(*key, "month").agg(F.sum("delta").alias("d"), F.sum("pending").alias("p"))
    months = months.select(*key, "month", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("carried"), F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("waiting")).where("waiting = 0")
    within = Window.partitionBy(*key, "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("sofar", F.sum("delta").over(within)).withColumn("seen", F.sum("pending").over(within)).where("seen = 0").join(months, [*key, "month"]).join(begin, key)
    return rows.select(F.nullif("series", F.lit("")).alias("account_id"), "day", "delta", (F.col("opening") + F.col("carried") + F.col("sofar")).cast(TOTAL).alias("balance"), "basis")
