"""Reads of postings, series and findings: listings with running balances, comparisons, labels, entities, and declarative queries."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import TOTAL, month, percent_change, plain_description, total
from ..storage import stage

# --- postings ---------------------------------------------------------------------------------------------------------------


def openings(checked: DataFrame, accounts: DataFrame, rates: DataFrame, base_currency: str) -> DataFrame:
    """(account_id, opening_balance, opening_base): an account's earliest trusted statement with an opening balance, and its value on that day."""
    from .fx import stamp

    opened = checked.where(F.col("reconcile_status").isin("ok", "gap", "pending") & F.col("opening_balance").isNotNull())
    first = opened.groupBy("account_id").agg(F.min(F.struct("period_start", "statement_id", "opening_balance")).alias("s")).select("account_id", "s.*")
    rows = first.join(accounts.select("account_id", F.col("native_currency").alias("currency_native")), "account_id").select("account_id", "opening_balance", "currency_native", F.col("period_start").alias("booked_date"), F.col("opening_balance").alias("amount_native"))
    return stamp(rows, rates, base_currency).select("account_id", "opening_balance", F.col("amount_base").alias("opening_base"))


def running_balances(txn: DataFrame, opened: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Adds running_native (opening and all postings so far) and running_base (null from an account's first pending posting on, or if the opening has no base value).

    Postings go by effective date, then statement period (null last), posted (null last), booked and id. Sums run in two levels: over an
    account's days, which are narrow, and within a day; so no task orders all postings of a busy account. starts: (statement_id, statement_start) of postings
    that have none; days do not ask for it."""
    dated = lambda df: df.withColumn("effective", F.coalesce("posted_date", "booked_date"))
    rows = dated(txn if starts is None else txn.join(starts, "statement_id", "left"))
    days = dated(txn).groupBy("account_id", "effective").agg(F.sum("amount_native").alias("n"), F.sum("amount_base").alias("b"), F.count_if(F.col("amount_base").isNull()).alias("p"))
    before = Window.partitionBy("account_id").orderBy("effective").rowsBetween(Window.unboundedPreceding, -1)
    start = days.select("account_id", "effective", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "b", "p")]).join(opened, "account_id", "left")
    within = Window.partitionBy("account_id", "effective").orderBy(F.col("statement_start").asc_nulls_last(), F.col("posted_date").asc_nulls_last(), "booked_date", "transaction_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(start, ["account_id", "effective"])
    pending = F.col("p0") + F.count_if(F.col("amount_base").isNull()).over(within)
    native = F.coalesce("opening_balance", F.lit(0)) + F.col("n0") + F.sum("amount_native").over(within)
    base = F.col("b0") + F.sum("amount_base").over(within) + F.when(F.col("opening_balance").isNull(), F.lit(0).cast(TOTAL)).otherwise(F.col("opening_base"))
    return rows.select(*txn.columns, *[c for c in ("statement_start",) if starts is not None], native.cast(TOTAL).alias("running_native"), F.when(pending == 0, base).cast(TOTAL).alias("running_base"))


def matching(rows: DataFrame, account: str | None = None, market: str | None = None, category: str | None = None, direction: str | None = None, start: str | None = None, end: str | None = None, search: str | None = None, valuation: str | None = None) -> DataFrame:
    """Postings of an account, market, category, direction and range of days, with a text in description or merchant whatever its case, valued or pending_fx."""
    for column, value in (("account_id", account), ("market_code", market), ("category_id", category), ("direction", direction)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start:
        rows = rows.where(F.col("booked_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("booked_date") <= F.lit(end).cast("date"))
    if search:
        rows = rows.where(F.contains(F.lower("description_raw"), F.lit(search.lower())) | F.coalesce(F.contains(F.lower("merchant_name"), F.lit(search.lower())), F.lit(False)))
    if valuation:
        rows = rows.where(F.col("amount_base").isNotNull() if valuation == "valued" else F.col("amount_base").isNull())
    return rows


def order(sort: str) -> list[Column]:
    """Orders by effective date or by magnitude in base currency, pending last; ids settle ties."""
    day, size = F.coalesce("posted_date", "booked_date"), F.abs("amount_base")
    late = [day.desc(), F.col("booked_date").desc(), F.col("transaction_id").desc()]
    return {"date_desc": late, "date_asc": [day.asc(), F.col("booked_date").asc(), F.col("transaction_id").asc()], "amount_desc": [size.desc_nulls_last(), *late], "amount_asc": [size.asc_nulls_last(), *late]}[sort]


def page(rows: DataFrame, by: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows, each with the total number of rows."""
    count = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*by).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(count))


def truncated(rows: DataFrame, by: list[Column], most: int) -> DataFrame:
    """The first rows in order, each with whether there are more: one row more is fetched to see it."""
    held = rows.orderBy(*by).limit(most + 1).withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # at most most + 1 rows meet
    return held.withColumn("truncated", F.max("rank").over(Window.partitionBy(F.lit(1))) > most).where(F.col("rank") <= most)


def indicators(rows: DataFrame) -> DataFrame:
    """Adds conversion badges: fx (other original money or a fee), pending, converted."""
    differs = F.col("original_amount").isNotNull() & F.col("original_currency").isNotNull() & ((F.col("original_currency") != F.col("currency_native")) | (F.col("original_amount") != F.col("amount_native")))
    fx = differs | F.col("fx_fee_amount_native").isNotNull() | F.coalesce("is_fx_fee", F.lit(False))
    third = F.when(F.col("amount_base").isNull(), "pending").when(~fx & (F.col("currency_native") != F.col("currency_base")), "converted")
    return rows.withColumn("indicators", F.array_compact(F.array(F.when(fx, "fx"), third)))


# --- ranges and comparisons -------------------------------------------------------------------------------------------------


def _shift(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 + months
    year, number = divmod(at, 12)
    return date(year, number + 1, min(day.day, calendar.monthrange(year, number + 1)[1]))


def date_range(selector: str | int | tuple[str, str], as_of: str, earliest: str | None = None) -> tuple[str, str]:
    """First and last day of a preset (this_month, last_3_months, all, ...), of so many days up to as_of, or as given."""
    if isinstance(selector, tuple):
        return selector
    now = date.fromisoformat(as_of)
    if isinstance(selector, int):
        return (now - timedelta(days=selector - 1)).isoformat(), as_of
    first = now.replace(day=1)
    quarter = first.replace(month=(now.month - 1) // 3 * 3 + 1)
    day = timedelta(days=1)
    if selector.startswith("last_") and selector.endswith("_months"):
        return _shift(first, 1 - int(selector.split("_")[1])).isoformat(), as_of
    start, end = {
        "this_month": (first, now),
        "last_month": (_shift(first, -1), first - day),
        "this_quarter": (quarter, now),
        "last_quarter": (_shift(quarter, -3), quarter - day),
        "year_to_date": (now.replace(month=1, day=1), now),
        "last_year": (date(now.year - 1, 1, 1), date(now.year - 1, 12, 31)),
        "all": (date.fromisoformat(earliest or as_of), now),
    }[selector]
    return start.isoformat(), end.isoformat()


def earlier_range(start: str, end: str, comparison: str) -> tuple[str, str] | None:
    """The range before: of equal length, or a year earlier; none for none."""
    lo, hi = date.fromisoformat(start), date.fromisoformat(end)
    if comparison == "previous_year":
        return _shift(lo, -12).isoformat(), _shift(hi, -12).isoformat()
    if comparison == "previous_period":
        return (lo - (hi - lo) - timedelta(days=1)).isoformat(), (lo - timedelta(days=1)).isoformat()
    return None


METRICS = ("inflow", "outflow", "spending", "net_cashflow", "transaction_count", "valued_count", "pending_fx_count")
_GROUPS = {"account": ("account_id", "account_name", None, None), "category": ("category_id", "category_name", "uncategorized", "Uncategorized"), "merchant": ("merchant_id", "merchant_name", "unknown", "Unknown merchant")}


def compare(txn: DataFrame, start: str, end: str, group_by: str = "total", metrics: tuple[str, ...] = METRICS, comparison: str = "none", most: int | None = None) -> DataFrame:
    """Metrics of a range by total, month, account, category or merchant, beside those of the range before; keys of either side count.
    Days of the range before are moved into the range before months are cut. most: the largest by the first metric's change (or, uncompared, its size)."""
    lit = lambda day: F.lit(day).cast("date")
    before = earlier_range(start, end, comparison)
    spent = F.abs("amount_base")

    def side(name: str, lo: str, hi: str, day: Column) -> DataFrame:
        if group_by == "month":
            keys = month(day).cast("string"), F.date_format(month(day), "yyyy-MM")
        elif group_by == "total":
            keys = F.lit("total"), F.lit("All activity")
        else:
            key, label, no_key, no_label = _GROUPS[group_by]
            keys = F.coalesce(key, F.lit(no_key)), F.coalesce(label, F.lit(no_label))
        rows = txn.where(F.col("booked_date").between(lit(lo), lit(hi)))
        return rows.select(F.lit(name).alias("bucket"), keys[0].alias("dimension_id"), keys[1].alias("dimension_label"), "amount_base", "flow_type")

    rows = side("current", start, end, F.col("booked_date"))
    if before:
        moved = F.add_months("booked_date", 12) if comparison == "previous_year" else F.date_add(lit(start), F.datediff("booked_date", lit(before[0])))
        rows = rows.unionByName(side("previous", *before, moved))
    flow = F.col("flow_type")
    values = {
        "inflow": F.when(flow == "income", spent),
        "outflow": F.when(flow.isin("spend", "fee"), spent).when(flow == "refund", -spent),
        "transaction_count": F.lit(1),
        "valued_count": F.col("amount_base").isNotNull().cast("int"),
        "pending_fx_count": F.col("amount_base").isNull().cast("int"),
    }
    values["spending"] = values["outflow"]
    values["net_cashflow"] = F.coalesce(values["inflow"], F.lit(0)) - F.coalesce(values["outflow"], F.lit(0))

    def measure(name: str, bucket: str) -> Column:
        kind = "long" if name.endswith("count") else TOTAL
        return F.coalesce(F.sum(F.when(F.col("bucket") == bucket, values[name])), F.lit(0)).cast(kind)

    out = rows.groupBy("dimension_id", "dimension_label").agg(*[measure(m, "current").alias(m) for m in metrics], *[measure(m, "previous").alias(f"previous_{m}") for m in metrics if before])
    if before:
        out = out.select("*", *[(F.col(m) - F.col(f"previous_{m}")).alias(f"{m}_change") for m in metrics], *[percent_change(F.col(m), F.col(f"previous_{m}")).alias(f"{m}_change_percent") for m in metrics])
    if most:
        by = [F.col("dimension_id")] if group_by == "month" else [F.abs(f"{metrics[0]}_change" if before else metrics[0]).desc(), F.col("dimension_label"), F.col("dimension_id")]
        out = out.orderBy(*by).limit(120 if group_by == "month" else most)
    return out


def range_coverage(txn: DataFrame, start: str, end: str) -> DataFrame:
    """What a comparison's figures of a range rest on, in one row: postings, valued and pending ones, and the pending ones by currency. Currencies are counted first, so a few rows meet."""
    rows = txn.where(F.col("booked_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("currency_native").agg(F.count("*").alias("n"), F.count("amount_base").alias("valued"))
    waiting = F.collect_list(F.when(F.col("n") > F.col("valued"), F.struct("currency_native", (F.col("n") - F.col("valued")).alias("pending"))))
    sums = {name: F.coalesce(F.sum(c), F.lit(0)) for name, c in (("transaction_count", "n"), ("valued_count", "valued"))}
    out = rows.agg(*[c.alias(n) for n, c in sums.items()], F.map_from_entries(F.sort_array(waiting)).alias("pending_by_currency"))
    pending = F.col("transaction_count") - F.col("valued_count")
    return out.select("transaction_count", "valued_count", pending.alias("pending_count"), "pending_by_currency", F.when(pending > 0, "partial").otherwise("complete").alias("coverage_status"))


def earliest(txn: DataFrame, otherwise: str) -> DataFrame:
    return txn.agg(F.coalesce(F.min("booked_date"), F.lit(otherwise).cast("date")).alias("earliest"))


# --- series -----------------------------------------------------------------------------------------------------------------


def in_range(occurrences: DataFrame, start: str, end: str) -> DataFrame:
    return occurrences.where(F.col("occurrence_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def series_of(series: DataFrame, occurrences: DataFrame, entity: tuple[str, str], txn: DataFrame) -> DataFrame:
    """The series about an entity (kind, id): of that merchant, or with an occurrence, among those given, whose posting is of that account or category."""
    kind, wanted = entity
    if kind == "merchant":
        return series.where(F.col("merchant_id") == wanted)
    ours = txn.where(F.col(f"{kind}_id") == wanted).select("transaction_id")
    return series.join(occurrences.join(ours, "transaction_id", "left_semi"), ["market_scope", "detector_fingerprint"], "left_semi")


def series_context(occurrences: DataFrame, accounts: DataFrame) -> DataFrame:
    """Of a series' occurrences (with account_id): count, ends, the change of the latest price to the one before in percent, the account if it is the only one, and the list."""
    keys = ["market_scope", "detector_fingerprint"]
    recent = Window.partitionBy(*keys).orderBy(F.col("occurrence_date").desc(), F.col("occurrence_number").desc())
    rows = occurrences.join(accounts.select("account_id", "display_name"), "account_id").withColumn("rank", F.row_number().over(recent))
    price = lambda n: F.max(F.when(F.col("rank") == n, F.col("comparison_amount")))
    one = F.min("account_id") == F.max("account_id")
    out = rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("occurrence_count"),
        F.min("occurrence_date").alias("first_occurrence_date"),
        F.max("occurrence_date").alias("latest_occurrence_date"),
        percent_change(price(1), price(2)).alias("latest_change_percent"),
        F.when(one, F.min("account_id")).alias("account_id"),
        F.when(one, F.min("display_name")).otherwise("Multiple accounts").alias("account_name"),
        F.sort_array(F.collect_list(F.struct("occurrence_number", "transaction_id", "occurrence_date", "comparison_amount"))).alias("occurrences"),
    )
    return out


def monthly_equivalent(cadence: Column, amount: Column) -> Column:
    """What a price of a cadence comes to in a month, unrounded."""
    wide = amount.cast("decimal(20,8)")
    return F.when(cadence == "weekly", wide * 52 / 12).when(cadence == "biweekly", wide * 26 / 12).when(cadence == "monthly", wide).when(cadence == "quarterly", wide / 3).when(cadence == "annual", wide / 12)


def effective_series(series: DataFrame, as_of: Column) -> DataFrame:
    """Adds what users' overrides make of a series: cadence, amount, next date, overdue for detected and confirmed ones, and whether a user changed anything."""
    live = F.col("status").isin("detected", "confirmed")
    due = F.coalesce("next_date_override", "next_date")
    changed = F.col("cadence_override").isNotNull() | F.col("expected_amount_override").isNotNull() | F.col("next_date_override").isNotNull()
    return series.select("*", F.coalesce("cadence_override", "cadence").alias("effective_cadence"), F.coalesce("expected_amount_override", "expected_amount").cast("decimal(14,2)").alias("effective_amount"), due.alias("expected_next_date"), (live & (due < as_of)).alias("is_overdue"), changed.alias("user_corrected"))


def read_recurring(series: DataFrame, occurrences: DataFrame, accounts: DataFrame, merchants: DataFrame, as_of: Column, start: str, end: str, scope: str = "ALL", direction: str | None = None, overdue: bool | None = None, price_changed: bool | None = None, entity: tuple[str, str] | None = None, txn: DataFrame | None = None) -> DataFrame:
    """Series of a scope with an occurrence in the range, with what happened in the range. entity: (account, category or merchant, id); one with an
    account or category needs the postings (txn) and keeps series of which an occurrence in the range is about it, with all their occurrences of the range."""
    chosen, within = series.where(F.col("market_scope") == scope), in_range(occurrences, start, end)
    if entity:
        chosen = series_of(chosen, within, entity, txn)
    rows = effective_series(chosen, as_of).drop("account_id").join(series_context(within, accounts), ["market_scope", "detector_fingerprint"])
    if direction:
        rows = rows.where(F.col("flow_type") == direction)
    if overdue is not None:
        rows = rows.where(F.col("is_overdue") == overdue)
    if price_changed is not None:
        rows = rows.where((F.coalesce("latest_change_percent", F.lit(0)) != 0) == price_changed)
    rows = rows.join(merchants.select("merchant_id", "canonical_name"), "merchant_id", "left")
    return rows.select("detector_fingerprint", F.coalesce("canonical_name", "merchant_key").alias("merchant_name"), "account_id", "account_name", "flow_type", F.col("effective_cadence").alias("cadence"), "status", F.col("effective_amount").alias("expected_amount"), "occurrence_count", "first_occurrence_date", "latest_occurrence_date", "expected_next_date", F.col("is_overdue").alias("overdue"), "latest_change_percent", "user_corrected", "occurrences")


def recurring_order() -> list[Column]:
    rank = F.when(F.col("status") == "detected", 0).when(F.col("status") == "confirmed", 1).when(F.col("status") == "cancelled", 2).otherwise(3)
    return [rank, F.col("overdue").desc(), F.col("expected_next_date"), F.col("detector_fingerprint")]


def recurring_summary(series: DataFrame, as_of: Column, base_currency: str) -> DataFrame:
    rows = effective_series(series, as_of).where(F.col("status").isin("detected", "confirmed"))
    amount = monthly_equivalent(F.col("effective_cadence"), F.col("effective_amount"))
    return rows.groupBy("market_scope").agg(F.count("*").alias("active_series"), F.count_if("is_overdue").alias("overdue_series"), F.coalesce(F.round(F.sum(F.when(F.col("currency") == base_currency, amount)), 2), F.lit(0)).cast(TOTAL).alias("expected_monthly_amount"))


# --- findings ---------------------------------------------------------------------------------------------------------------


def finding_context(found: DataFrame, txn: DataFrame, series: DataFrame, occurrences: DataFrame, accounts: DataFrame, merchants: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings with the account, category and merchant they are about, by whichever way is known, and the day of the event."""
    keys = ["market_scope", "series_fingerprint"]
    about = series.select("market_scope", F.col("detector_fingerprint").alias("series_fingerprint"), F.col("merchant_id").alias("series_merchant"), F.col("merchant_key").alias("series_key"))
    last = occurrences.groupBy("market_scope", F.col("detector_fingerprint").alias("series_fingerprint")).agg(F.max("occurrence_date").alias("last_occurrence"))
    rows = found.join(txn.select("transaction_id", F.col("account_id").alias("txn_account"), "category_id", F.col("merchant_id").alias("txn_merchant"), "booked_date"), "transaction_id", "left").join(about, keys, "left").join(last, keys, "left")
    proof = lambda k: F.try_element_at("evidence", F.lit(k))
    day = lambda k: F.when(proof(k).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(proof(k), "yyyy-MM-dd"))
    named = lambda kind: F.when(proof("dimensionType") == kind, proof("dimensionId"))
    rows = rows.select(
        *[F.col(c) for c in found.columns if c != "account_id"],
        F.coalesce("account_id", "txn_account").alias("account_id"),
        F.coalesce("category_id", named("category")).alias("category_id"),
        F.coalesce("txn_merchant", "series_merchant", named("merchant")).alias("merchant_id"),
        "series_key",
        F.coalesce("booked_date", day("periodStart"), day("gapStart"), day("secondBookedDate"), "last_occurrence", F.to_date("last_seen_at")).alias("event_date"),
        F.coalesce(F.nullif(proof("summary"), F.lit("")), F.nullif(proof("explanation"), F.lit("")), F.lit("Open the stored evidence to inspect this deterministic finding.")).alias("summary"),
    )
    rows = rows.join(accounts.select("account_id", F.col("display_name").alias("account_name")), "account_id", "left").join(categories.select("category_id", F.col("name").alias("category_name")), "category_id", "left").join(merchants.select("merchant_id", "canonical_name"), "merchant_id", "left")
    return rows.withColumn("merchant_name", F.coalesce("canonical_name", "series_key")).drop("canonical_name", "series_key")


def findings_of(found: DataFrame, entity: tuple[str, str]) -> DataFrame:
    """Findings with their context that are about an entity (account, category or merchant, id), by whichever way finding_context knew it."""
    return found.where(F.col(f"{entity[0]}_id") == entity[1])


def finding_order() -> list[Column]:
    status = F.when(F.col("status") == "new", 0).when(F.col("status") == "confirmed", 1).when(F.col("status") == "dismissed", 2).otherwise(3)
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [status, severity, F.col("last_seen_at").desc(), F.col("detector_fingerprint")]


# --- entities ---------------------------------------------------------------------------------------------------------------


def entities(accounts: DataFrame, categories: DataFrame, merchants: DataFrame) -> DataFrame:
    """(kind, id, label, market_code, name, choice) of everything a term may name; name is the label without case, width and spaces, choice is decorated with the market."""
    none = F.lit(None).cast("string")
    rows = accounts.select(F.lit("account").alias("kind"), F.col("account_id").alias("id"), F.col("display_name").alias("label"), "market_code").unionByName(categories.select(F.lit("category").alias("kind"), F.col("category_id").alias("id"), F.col("name").alias("label"), none.alias("market_code"))).unionByName(merchants.select(F.lit("merchant").alias("kind"), F.col("merchant_id").alias("id"), F.col("canonical_name").alias("label"), none.alias("market_code")))
    place = F.when(F.col("market_code") == "CA", "Canada").when(F.col("market_code") == "TZ", "Tanzania")
    rows = rows.withColumn("choice", F.concat_ws(" · ", "label", place))
    return rows.withColumn("name", plain_description("label")).withColumn("choice_name", plain_description("choice"))


MOST_TERMS = 1000


def resolve(terms: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """terms: (kind, term, market). The matches of each term: an exact choice before an exact label before a label that contains the term or is contained in it, at most five
    of the best tier, by label and id; matched_outside tells of accounts of another market than asked for.

    The table of terms is what a user asks: at most MOST_TERMS rows, which is checked, are broadcast, so that entities are read once and where they are."""
    if terms.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms are resolved at once")
    asked = terms.withColumn("wanted", plain_description("term"))
    rows = known.join(F.broadcast(asked.withColumnRenamed("kind", "asked")), F.col("kind") == F.col("asked"))
    inside = (F.col("kind") != "account") | (F.col("market") == "ALL") | F.coalesce(F.col("market_code") == F.col("market"), F.lit(False))
    holds = F.contains("name", F.col("wanted")) | F.contains("wanted", F.col("name")) | F.contains("choice_name", F.col("wanted"))
    exact = F.when(F.col("choice_name") == F.col("wanted"), 1).when(F.col("name") == F.col("wanted"), 2)
    tier = F.when(inside, F.coalesce(exact, F.when(holds, F.lit(4)))).otherwise(F.when(exact.isNotNull(), F.lit(3)))
    rows = rows.withColumn("tier", tier).where("tier is not null")
    w = Window.partitionBy("kind", "term", "market").orderBy("tier", "label", "id")
    best = F.min("tier").over(Window.partitionBy("kind", "term", "market"))
    rows = rows.withColumn("best", best).where("tier = best").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    token = F.sha2(F.concat(F.lit("entity-v1"), F.chr(F.lit(0)), "kind", F.chr(F.lit(0)), "id"), 256)
    return rows.select("kind", "term", "market", "rank", "id", "label", "choice", (F.col("tier") <= 2).alias("exact"), (F.col("tier") == 3).alias("matched_outside"), token.alias("entity_token"))


# --- declarative queries ----------------------------------------------------------------------------------------------------


def run_spec(spec: dict, txn: DataFrame, as_of: str, watermark: object = None, **tables: DataFrame) -> DataFrame:
    """One closed query over the pinned postings (updated_at up to the watermark). spec: dataset (aggregate, seasonality, recurring, findings, fx, transactions), date,
    market, entity (kind, id), and what the dataset takes. Unknown keys and datasets are refused."""
    allowed = {"aggregate": {"metrics", "group_by", "comparison", "limit"}, "seasonality": set(), "recurring": {"direction", "overdue", "price_changed", "limit"}, "findings": {"type", "status", "severity", "limit"}, "fx": {"limit"}, "transactions": {"direction", "search", "valuation", "sort", "limit"}}
    kind = spec.get("dataset")
    if kind not in allowed or set(spec) - allowed[kind] - {"dataset", "date", "market", "entity"}:
        raise ValueError(f"not a query: {spec}")
    rows = txn if watermark is None else txn.where(F.col("updated_at") <= F.lit(watermark))
    market, entity = spec.get("market", "ALL"), spec.get("entity")
    if market != "ALL":
        rows = rows.where(F.col("market_code") == market)
    if entity:
        rows = rows.where(F.col(f"{entity[0]}_id") == entity[1])
    first = rows.agg(F.min("booked_date")).first()[0] if spec.get("date", "all") == "all" else None
    start, end = date_range(spec.get("date", "all"), as_of, first and first.isoformat())
    within = rows.where(F.col("booked_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    most, day = spec.get("limit", 20), F.lit(as_of).cast("date")
    if kind == "aggregate":
        metrics = tuple(spec.get("metrics", METRICS))
        if spec.get("comparison", "none") != "none" and len(metrics) > 3:
            raise ValueError("compared queries take three metrics at most")
        return compare(rows, start, end, spec.get("group_by", "total"), metrics, spec.get("comparison", "none"), most)
    if kind == "seasonality":
        from . import cube

        return cube.seasonality(cube.monthly(within, ("total",)), day).where(F.col("market_scope") == market)
    if kind == "recurring":
        found = read_recurring(tables["series"], tables["occurrences"], tables["accounts"], tables["merchants"], day, start, end, market, spec.get("direction"), spec.get("overdue"), spec.get("price_changed"), entity, txn)
        return found.orderBy(*recurring_order()).limit(most)
    if kind == "findings":
        found = tables["findings"].where((F.col("market_scope") == market) & F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        found = findings_of(found, entity) if entity else found
        for key, column in (("type", "finding_type"), ("status", "status"), ("severity", "severity")):
            if key in spec:
                found = found.where(F.col(column) == spec[key])
        return found.orderBy(*finding_order()).limit(most)
    if kind == "fx":
        from .costs import fx_cost, fx_cost_totals

        return fx_cost_totals(fx_cost(within, tables["rates"]))
    chosen = matching(within, direction=spec.get("direction"), search=spec.get("search"), valuation=spec.get("valuation"))
    return truncated(chosen, order(spec.get("sort", "date_desc")), most)


class StaleRates(RuntimeError):
    """Rates were fetched since what is published was valued."""


def run_plan(specs: list[dict], txn: DataFrame, as_of: str, watermark: object = None, rates_at: object = None, published_rates_at: object = None, **tables: DataFrame) -> list[DataFrame]:
    """One to three queries over one pinned snapshot: postings up to the watermark are written once and each query reads that table. A query of conversion costs
    is refused when rates were fetched (rates_at) after those that the published generation knew (published_rates_at)."""
    if not 1 <= len(specs) <= 3:
        raise ValueError("a plan has one to three queries")
    if rates_at is not None and any(s.get("dataset") == "fx" for s in specs) and (published_rates_at is None or rates_at > published_rates_at):
        raise StaleRates("rates have changed since the published generation")
    pinned = stage(txn if watermark is None else txn.where(F.col("updated_at") <= F.lit(watermark)), "pinned")
    return [run_spec(s, pinned, as_of, None, **tables) for s in specs]
