"""Queries of reads and checks, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import costs, cube, merges, reads, refresh, series, validity
from ..sources.tables import up_to
from . import detectors, registry
from .detectors import _date, _series, all_findings, reviews
from .registry import _C, _CHECKED, _CUBE, _PCT, _TXN, AS_OF, BASE, POSTING, _checked, _mean, _median, postings, transactions

_OF_ACCOUNT, _OF_MERCHANT = ("account", "A00000003"), ("merchant", "M00000003")
_RANGE = ("1999-01-01", "2001-06-15")


def _named(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Postings with the names of their account, merchant and category. Categories are a row each that somebody has made; the names go to the postings."""
    view = lambda name: fixtures.view(spark, sf_dir, name)
    names = view("d_merchant").select("merchant_id", F.col("canonical_name").alias("merchant_name"))
    kinds = view("d_category").select("category_id", F.col("name").alias("category_name"))
    return rows.withColumnRenamed("display_name", "account_name").join(names, "merchant_id", "left").join(F.broadcast(kinds), "category_id", "left")


def _listing(spark: SparkSession, sf_dir: str, market: str | None = None) -> DataFrame:
    """Postings with running balances and names; of one market's accounts, if named: a market is a fact of the account, and balances run by account."""
    view = lambda name: fixtures.view(spark, sf_dir, name)
    started = view("d_statement").select("statement_id", F.col("period_start").alias("statement_start"))
    rows = transactions(spark, sf_dir)
    rows = rows if market is None else rows.where(F.col("market_code") == market)
    return _named(spark, sf_dir, reads.running_balances(rows, reads.openings(_checked(spark, sf_dir), view("d_account"), view("d_fx_rate"), BASE), started))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, transactions(spark, sf_dir))


_FILTER = {"market": "CA", "start": "1996-01-01", "end": "1999-12-31", "search": "SUPPLIER 1"}
_SHOWN = ("transaction_id", "account_name", "booked_date", "merchant_name", "category_name", "amount_native", "amount_base", "running_native", "running_base")


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page(reads.matching(_listing(spark, sf_dir, _FILTER["market"]), **_FILTER), reads.order("amount_desc"), 2, 25).select(*_SHOWN, "total")


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with a conversion, its three money layers, costs and running balances."""
    rows = costs.with_cost(reads.indicators(_listing(spark, sf_dir)), fixtures.view(spark, sf_dir, "d_fx_rate"))
    return rows.select("transaction_id", F.array_join("indicators", ",").alias("indicators"), "original_amount", "amount_native", "amount_base", "fx_rate", "fx_rate_date", "market_rate", "explicit_fee_native", "estimated_markup_native", "running_native", "running_base")


def _saved_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _series(spark, sf_dir).drop("occurrences")
    return merges.patch(merges.merge_series(refresh._nothing(spark, found, merges.DECISIONS), found, 1), reviews(found), list(merges.DECISIONS))


def _recurring_of(spark: SparkSession, sf_dir: str, entity: tuple[str, str]) -> DataFrame:
    view = lambda name: fixtures.view(spark, sf_dir, name)
    return _occurrence_ids(reads.read_recurring(_saved_series(spark, sf_dir), series.occurrences(_series(spark, sf_dir)), view("d_account"), view("d_merchant"), _date(), *_RANGE, entity=entity, txn=view("d_posting")))


def _reviewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two generations, on some of which users decide; those of the earlier generation stay as they are."""
    digit, last, day = F.substring("detector_fingerprint", 1, 1), F.substring("detector_fingerprint", 2, 1), lambda d: F.lit(d).cast("timestamp")
    found = all_findings(spark, sf_dir).select("market_scope", "detector_fingerprint", "finding_type").withColumn("last_detected_generation", F.when(last == "7", 1).otherwise(2))
    held = found.select("*", F.when(last == "3", "resolved").otherwise("new").alias("status"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.when(last == "3", day("2001-05-01")).alias("resolved_at"))
    said = found.select("market_scope", "detector_fingerprint", F.when(digit == "0", "dismissed").when(digit == "1", "confirmed").when(digit == "2", "resolved").when(digit == "3", "new").alias("status"))
    return merges.review_findings(held, said, day("2001-06-15"), 2)


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda name: fixtures.view(spark, sf_dir, name)
    rows = reads.read_recurring(_saved_series(spark, sf_dir), series.occurrences(_series(spark, sf_dir)), view("d_account"), view("d_merchant"), _date(), *_RANGE)
    ids = F.array_join(F.transform("occurrences", lambda x: x["transaction_id"]), ",")
    return rows.withColumn("occurrences", ids).orderBy(*reads.recurring_order())


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda name: fixtures.view(spark, sf_dir, name)
    digit = F.substring("detector_fingerprint", 1, 1)
    found = all_findings(spark, sf_dir).withColumn("status", F.when(digit == "0", "dismissed").when(digit == "1", "confirmed").when(digit == "2", "resolved").otherwise("new")).withColumn("last_seen_at", F.lit("2001-06-15").cast("timestamp"))
    held = _series(spark, sf_dir)
    return reads.finding_context(found, postings(spark, sf_dir), held, series.occurrences(held), view("d_account"), view("d_merchant"), view("d_category"))


def _findings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).where("market_scope = 'TZ' and event_date between date '1999-01-01' and date '2001-06-15'")
    return reads.page(rows, reads.finding_order(), 1, 50).select("finding_type", "status", "severity", "account_name", "category_name", "merchant_name", "event_date", "detector_fingerprint", "total")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that users type: names as they are, in capitals, parts of names, and accounts of another market."""
    view = lambda name: fixtures.view(spark, sf_dir, name)
    terms = spark.createDataFrame([("account", "customer#000000001", "ALL"), ("account", "CUSTOMER#000000003", "CA"), ("account", "Customer#000000001", "CA"), ("merchant", "supplier#00000000", "ALL"), ("category", "category 7", "ALL"), ("category", "the category 1 please", "ALL")], "kind string, term string, market string")
    return reads.resolve(terms, reads.entities(view("d_account"), view("d_category"), view("d_merchant"))).drop("entity_token")


def _spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"dataset": "aggregate", "date": ("1998-01-01", "1998-12-31"), "market": "TZ", "group_by": "category", "metrics": ["spending", "transaction_count"], "comparison": "previous_year", "limit": 10}
    return reads.run_spec(spec, _plain(spark, sf_dir), "1998-12-31", watermark="1998-11-30 00:00:00")


def _occurrence_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("occurrences", F.array_join(F.transform("occurrences", lambda x: x["transaction_id"]), ","))


def _one(spark: SparkSession, sf_dir: str, spec: dict, **tables: DataFrame) -> DataFrame:
    return reads.run_spec(spec, _plain(spark, sf_dir), detectors.AS_OF, **tables)


def _spec_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda name: fixtures.view(spark, sf_dir, name)
    rows = _one(spark, sf_dir, {"dataset": "recurring", "date": _RANGE, "direction": "spend", "limit": 15}, series=_saved_series(spark, sf_dir), occurrences=series.occurrences(_series(spark, sf_dir)), accounts=view("d_account"), merchants=view("d_merchant"))
    return _occurrence_ids(rows)


def _spec_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries over one pinned snapshot: spending by month, the largest postings, conversion costs."""
    year, market = ("1998-01-01", "1998-12-31"), {"market": "TZ"}
    specs = [{"dataset": "aggregate", "date": year, "group_by": "month", "metrics": ["spending"], "limit": 12} | market, {"dataset": "transactions", "date": year, "sort": "amount_desc", "limit": 12} | market, {"dataset": "fx", "date": year} | market]
    months, largest, costs = reads.run_plan(specs, _plain(spark, sf_dir), "1998-12-31", "1998-11-30 00:00:00", rates=fixtures.view(spark, sf_dir, "d_fx_rate"))
    line = lambda n, key, value: [F.lit(n).alias("query"), key.alias("key"), value.cast("decimal(18,2)").alias("value")]
    out = months.select(*line(1, F.col("dimension_id"), F.col("spending"))).unionByName(largest.select(*line(2, F.col("transaction_id"), F.col("amount_base"))))
    return out.unionByName(costs.select(*line(3, F.coalesce("missing_currency", F.lit("all")), F.col("fx_cost_base"))))


def _broken_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube.monthly(postings(spark, sf_dir))
    m = F.month("period_start")
    rows = rows.withColumn("pending_count", F.col("pending_count") + (m == 3).cast("int")).withColumn("net", F.when(m == 4, F.col("net") + 1).otherwise(F.col("net")).cast("decimal(18,2)"))
    rows = rows.withColumn("dimension_key", F.when((m == 5) & (F.col("dimension_type") == "total"), "x").otherwise(F.col("dimension_key")))
    return cube.broken_rows(rows.withColumn("period_start", F.when(m == 7, F.date_add("period_start", 2)).otherwise(F.col("period_start"))))


def _wrong_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = transactions(spark, sf_dir), F.substring("transaction_id", 2, 9).cast("int")
    rows = rows.withColumn("amount_base", F.when(k % 61 == 0, F.col("amount_base") + 1).when(k % 67 == 0, None).otherwise(F.col("amount_base")).cast("decimal(14,2)"))
    return validity.valuations(rows.withColumn("fx_rate_date", F.when(k % 71 == 0, F.date_sub("fx_rate_date", 9)).otherwise(F.col("fx_rate_date"))))


def _wrong_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("transaction_id", 2, 9).cast("int")
    txn = fixtures.view(spark, sf_dir, "d_txn").withColumn("currency_native", F.when(k % 61 == 0, "EUR").otherwise(F.col("currency_native"))).withColumn("account_id", F.when(k % 67 == 0, "A00000001").when(k % 71 == 0, "none").otherwise(F.col("account_id")))
    held = fixtures.view(spark, sf_dir, "d_statement").withColumn("currency", F.when(F.month("period_start") == 2, "EUR").otherwise(F.col("currency")))
    return validity.references(txn, held, fixtures.view(spark, sf_dir, "d_account"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as printed, of each statement's postings; some balances misprinted."""
    lines = fixtures.view(spark, sf_dir, "d_line")
    return validity.printed_balances(lines, fixtures.view(spark, sf_dir, "d_statement"))


def _category_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = fixtures.view(spark, sf_dir, "d_category_old"), fixtures.view(spark, sf_dir, "d_category_new")
    return validity.category_changes(old, new, fixtures.view(spark, sf_dir, "d_txn").select("category_id"))


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fixtures.view(spark, sf_dir, "d_account")
    k = F.substring("account_id", 2, 8).cast("int")
    new = old.withColumn("kind", F.when(k % 7 == 0, "wallet").otherwise(F.col("kind"))).withColumn("native_currency", F.when(k % 11 == 0, "EUR").otherwise(F.col("native_currency")))
    return validity.identity_changes(old, new, fixtures.view(spark, sf_dir, "d_txn"), fixtures.view(spark, sf_dir, "d_statement"))


QUERIES = {
    "win_running_native": lambda s, d: _listing(s, d).select("transaction_id", "account_id", "running_native"),
    "win_running_base": lambda s, d: _listing(s, d).select("transaction_id", "account_id", "running_base"),
    "read_transactions": _transactions,
    "flt_txn": lambda s, d: reads.matching(_plain(s, d), direction="debit", valuation="valued", **_FILTER).select("transaction_id", "merchant_name"),
    "srt_txn": lambda s, d: _plain(s, d).orderBy(*reads.order("date_asc")).limit(200).select("transaction_id", "posted_date", "booked_date"),
    "srt_truncated": lambda s, d: reads.truncated(_plain(s, d).where("market_code = 'CA'"), reads.order("amount_asc"), 20).select("transaction_id", "rank", "truncated"),
    "fn_indicators": lambda s, d: reads.indicators(_plain(s, d)).groupBy(F.array_join("indicators", ",").alias("indicators")).agg(F.count("*").alias("n")),
    "job_txn_detail": _detail,
    "agg_trends_read": lambda s, d: cube.trends_read(cube.monthly(postings(s, d), ("category",)), "category", fixtures.view(s, d, "d_category").select(F.col("category_id").alias("dimension_key"), F.col("name").alias("label"))),
    "agg_summary": lambda s, d: cube.summary(cube.monthly(postings(s, d), ("total",)), "1999-01-01", "1999-12-31"),
    "agg_compare_merchant": lambda s, d: reads.compare(_plain(s, d), "1998-04-01", "1998-06-30", "merchant", comparison="previous_period"),
    "agg_compare_month": lambda s, d: reads.compare(_plain(s, d), "1998-01-01", "1998-12-31", "month", ("spending", "net_cashflow", "pending_fx_count"), "previous_year"),
    "srt_topk": lambda s, d: reads.compare(_plain(s, d), "1998-01-01", "1998-12-31", "account", ("spending", "inflow"), "none", 20),
    "agg_earliest": lambda s, d: reads.earliest(_plain(s, d).where("market_code = 'TZ'"), AS_OF),
    "src_snapshot": lambda s, d: up_to(fixtures.view(s, d, "d_txn"), "updated_at", "1998-06-10 00:00:00").groupBy("account_id").agg(F.count("*").alias("n")),
    "agg_recurring_summary": lambda s, d: reads.recurring_summary(_saved_series(s, d), _date(), BASE),
    "agg_recurring_ctx": lambda s, d: reads.series_context(reads.in_range(series.occurrences(_series(s, d)), *_RANGE), fixtures.view(s, d, "d_account")).drop("occurrences"),
    "read_recurring": _recurring,
    "flt_recurring": lambda s, d: _recurring_of(s, d, _OF_ACCOUNT),
    "flt_recurring_merchant": lambda s, d: _recurring_of(s, d, _OF_MERCHANT),
    "flt_findings": lambda s, d: reads.findings_of(_findings(s, d), ("category", "C13")).select("market_scope", "finding_type", "status", "detector_fingerprint", "event_date"),
    "job_review_findings": _reviewed_findings,
    "join_finding_ctx": lambda s, d: _findings(s, d).select("market_scope", "detector_fingerprint", "account_id", "account_name", "category_id", "category_name", "merchant_id", "merchant_name", "event_date"),
    "read_findings": _findings_page,
    "join_entity": _entities,
    "job_query_spec": _spec,
    "spec_seasonality": lambda s, d: reads.run_spec({"dataset": "seasonality", "market": "TZ"}, transactions(s, d, "d_fx_rate_daily"), AS_OF),
    "spec_recurring": _spec_recurring,
    "spec_findings": lambda s, d: _one(s, d, {"dataset": "findings", "date": ("1999-01-01", "2001-06-15"), "market": "TZ", "status": "new", "limit": 30}, findings=_findings(s, d)).select("finding_type", "severity", "account_name", "merchant_name", "event_date", "detector_fingerprint"),
    "spec_fx": lambda s, d: _one(s, d, {"dataset": "fx", "date": ("1997-01-01", "1998-12-31"), "market": "CA"}, rates=fixtures.view(s, d, "d_fx_rate")),
    "spec_transactions": lambda s, d: _one(s, d, {"dataset": "transactions", "date": ("1998-01-01", "1998-12-31"), "market": "CA", "direction": "debit", "valuation": "valued", "sort": "amount_desc", "limit": 15}).select("transaction_id", "amount_base", "rank", "truncated"),
    "spec_plan": _spec_plan,
    "val_cube": _broken_cube,
    "val_valuation": _wrong_values,
    "val_refs": _wrong_references,
    "val_running": _printed,
    "val_category": _category_states,
    "val_identity_change": _identity,
}

_OPEN = _TXN + f", d_statement as ({fixtures.VIEWS['d_statement'].strip()})" + _CHECKED[len(_C("d_account", "d_txn", "d_statement")) :] + """,
op as (select account_id, opening_balance, period_start, native_currency from checked join d_account using (account_id) where reconcile_status in ('ok', 'gap', 'pending') and opening_balance is not null qualify row_number() over (partition by account_id order by period_start, statement_id) = 1),
opf as (select op.*, r.as_of, r.rate from op asof left join d_fx_rate r on op.native_currency = r.base and op.period_start >= r.as_of),
opening as (select account_id, opening_balance, case when native_currency = 'CAD' then opening_balance when period_start - as_of <= 7 then round(opening_balance * rate, 2) end as opening_base from opf),
led as (select t.*, o.opening_balance, o.opening_base, sum(amount_native) over w as rn, sum(amount_base) over w as rb, sum(case when amount_base is null then 1 else 0 end) over w as rp from txn t left join d_statement s using (statement_id) left join opening o on t.account_id = o.account_id
 window w as (partition by t.account_id order by coalesce(posted_date, booked_date), s.period_start nulls last, posted_date nulls last, booked_date, transaction_id rows unbounded preceding)),
led2 as (select * exclude (rn, rb, rp), cast(coalesce(opening_balance, 0) + rn as decimal(18,2)) as running_native, cast(case when rp > 0 then null when opening_balance is null then rb else opening_base + rb end as decimal(18,2)) as running_base from led)"""
_NAMES = f", {fixtures.ctes('d_merchant', 'd_category')}"
_NAMED = _TXN + _NAMES + ", nm as (select t.*, m.canonical_name as merchant_name, c.name as category_name from txn t left join d_merchant m using (merchant_id) left join d_category c using (category_id))"
_WHERE = "market_code = 'CA' and booked_date between date '1996-01-01' and date '1999-12-31' and (contains(lower(description_raw), 'supplier 1') or contains(lower(canonical_name), 'supplier 1'))"
_BADGES = """case when (original_amount is not null and original_currency is not null and (original_currency <> currency_native or original_amount <> amount_native)) or fx_fee_amount_native is not null or coalesce(is_fx_fee, false) then 'fx' end"""
_IND = f"concat_ws(',', {_BADGES}, case when amount_base is null then 'pending' when ({_BADGES}) is null and currency_native <> 'CAD' then 'converted' end)"
_SPENT = "case when flow_type in ('spend', 'fee') then abs(amount_base) when flow_type = 'refund' then -abs(amount_base) end"
_IN = "case when flow_type = 'income' then abs(amount_base) end"
_MEASURES = {"inflow": f"sum({_IN})", "outflow": f"sum({_SPENT})", "spending": f"sum({_SPENT})", "net_cashflow": f"sum(coalesce({_IN}, 0) - coalesce({_SPENT}, 0))", "transaction_count": "count(*)", "valued_count": "count(amount_base)", "pending_fx_count": "count(*) - count(amount_base)"}


def _compared(source: str, key: str, label: str, moved: str, now: tuple[str, str], before: tuple[str, str], metrics: tuple[str, ...]) -> str:
    """SQL for reads.compare() with a range before. key and label are expressions of day."""
    typed = lambda m, e: f"cast(coalesce({e}, 0) as {'bigint' if m.endswith('count') else 'decimal(18,2)'})"
    sums = ", ".join(f"{typed(m, _MEASURES[m] + f''' filter (where bucket = '{b}')''' if not m == 'pending_fx_count' else f'''count_if(bucket = '{b}' and amount_base is null)''')} as {p}{m}" for b, p in (("c", ""), ("p", "previous_")) for m in metrics)
    changes = ", ".join(f"{m} - previous_{m} as {m}_change, {_PCT.format(a=m, b=f'previous_{m}')} as {m}_change_percent" for m in metrics)
    return f""", b as (select *, booked_date as day, 'c' as bucket from {source} where booked_date between date '{now[0]}' and date '{now[1]}' union all select *, {moved} as day, 'p' from {source} where booked_date between date '{before[0]}' and date '{before[1]}'),
g as (select {key} as dimension_id, {label} as dimension_label, {sums} from b group by 1, 2) select *, {changes} from g"""


_SERIES = detectors._SCOPED + detectors._SERIES + """, sv as (select *, case k when '0' then 'ignored' when '1' then 'confirmed' else 'detected' end as status, coalesce(case when k = '2' then 'monthly' end, cadence) as ec, cast(coalesce(case when k = '3' then 9000000 end, expected_amount) as decimal(14,2)) as ea,
 coalesce(case when k = '4' then date '2001-07-01' end, next_date) as en, k in ('2', '3', '4') as uc from (select *, left(detector_fingerprint, 1) as k from ser)),
oc as (select market_scope, detector_fingerprint, i, ids[i] as transaction_id, days[i] as d, p[i] as price, accounts[i] as account_id from (select *, unnest(range(1, n + 1)) as i from ser)),
orr as (select *, row_number() over (partition by market_scope, detector_fingerprint order by d desc, i desc) as rk from oc join (select account_id, display_name from d_account) a using (account_id) where d between date '1999-01-01' and date '2001-06-15'),
ctx as (select market_scope, detector_fingerprint, cast(count(*) as int) as occurrence_count, min(d) as first_occurrence_date, max(d) as latest_occurrence_date, """ + _PCT.format(a="max(case when rk = 1 then price end)", b="max(case when rk = 2 then price end)") + """ as latest_change_percent,
 case when min(account_id) = max(account_id) then min(account_id) end as account_id, case when min(account_id) = max(account_id) then min(display_name) else 'Multiple accounts' end as account_name, string_agg(transaction_id, ',' order by i) as occurrences from orr group by 1, 2)"""
_CONTEXT = detectors.FINDINGS.replace(", x as (select t.*", f", {fixtures.ctes('d_merchant', 'd_category')}, x as (select t.*", 1) + """,
dates as (select market_scope, raw, finding_type, transaction_id, account_id, series_fingerprint from raws),
ev as (select market_scope, 'unusual_frequency' as t, """ + detectors._sha("'unusual_frequency'", "merchant_key", "flow_type", "period_start", "cents // 100", "case when n % 2 = 1 then cast(b // 100 as varchar) else cast(baseline as varchar) end") + """ as raw, period_start as day, null as kind, null as key from fro
 union all select market_scope, 'monthly_spike', """ + detectors._sha("'monthly_spike'", "dimension_type", "dimension_key", "period_start", "v", "baseline") + """, period_start, dimension_type, dimension_key from spo
 union all select market_scope, 'reconciliation_mismatch', """ + detectors._sha("'reconciliation_mismatch'", "statement_id", "opening_balance", "cast(activity as decimal(18,2))", "closing_balance", "short") + """, period_start, null, null from d_sc where short <> 0
 union all select market_scope, 'coverage_gap', """ + detectors._sha("'coverage_gap'", "account_id", "covered + 1", "period_start - 1") + """, covered + 1, null, null from d_sc where period_start > covered + 1),
fc2 as (select r.*, sha256(concat_ws(chr(31), r.market_scope, case when finding_type in ('unusual_amount', 'monthly_spike', 'recurring_price_increase', 'pending_fx') then 'CAD' || chr(31) || '""" + series.POLICY + """' end, r.raw)) as detector_fingerprint,
 ev.day, ev.kind as dk, ev.key as dkey from raws r left join ev on ev.raw = r.raw and ev.market_scope = r.market_scope),
cx as (select f.market_scope, f.finding_type, f.severity, f.detector_fingerprint, coalesce(f.account_id, t.account_id) as account_id, coalesce(t.category_id, case when dk = 'category' then dkey end) as category_id,
 coalesce(t.merchant_id, s.merchant_id, case when dk = 'merchant' then dkey end) as merchant_id, s.merchant_key as sk, coalesce(t.booked_date, f.day, s.last_date, date '2001-06-15') as event_date
 from fc2 f left join txn t on t.transaction_id = f.transaction_id left join ser s on s.market_scope = f.market_scope and s.detector_fingerprint = f.series_fingerprint),
con as (select cx.*, a.display_name as account_name, c.name as category_name, coalesce(m.canonical_name, sk) as merchant_name from cx left join d_account a on a.account_id = cx.account_id left join d_category c on c.category_id = cx.category_id left join d_merchant m on m.merchant_id = cx.merchant_id)"""
_ASKED = """asked(kind, term, market) as (values ('account', 'customer#000000001', 'ALL'), ('account', 'CUSTOMER#000000003', 'CA'), ('account', 'Customer#000000001', 'CA'), ('merchant', 'supplier#00000000', 'ALL'), ('category', 'category 7', 'ALL'), ('category', 'the category 1 please', 'ALL'))"""



def _fx_where(condition: str, columns: str) -> str:
    """SQL for the totals of conversion costs of some postings."""
    rows = registry.ORACLES["agg_fx_cost"].replace("from txn t where original_amount", f"from txn t where {condition} and (original_amount").replace("or fx_rate is null),", "or fx_rate is null)),")
    sums = "count(*) as rows, count_if(missing_rate) as missing, cast(coalesce(sum(explicit_fee_base), 0) as decimal(18,2)) as explicit_fee_base, cast(coalesce(sum(estimated_markup_base), 0) as decimal(18,2)) as estimated_markup_base, cast(coalesce(sum(coalesce(explicit_fee_base, 0) + coalesce(estimated_markup_base, 0)), 0) as decimal(18,2)) as fx_cost_base"
    return f"select {columns} from (with q as ({rows}) select null as missing_currency, {sums} from q union all select missing_currency, {sums} from q where missing_rate group by 1)"


ORACLES = {
    "win_running_native": _OPEN + " select transaction_id, account_id, running_native from led2",
    "win_running_base": _OPEN + " select transaction_id, account_id, running_base from led2",
    "read_transactions": _OPEN + _NAMES + f""", f as (select l.*, l.display_name as account_name, m.canonical_name as merchant_name, c.name as category_name from led2 l left join d_merchant m using (merchant_id) left join d_category c using (category_id) where {_WHERE})
select {', '.join(_SHOWN)}, (select count(*) from f) as total from f order by abs(amount_base) desc nulls last, coalesce(posted_date, booked_date) desc, booked_date desc, transaction_id desc limit 25 offset 25""",
    "flt_txn": _NAMED + f" select transaction_id, merchant_name from nm where direction = 'debit' and amount_base is not null and {_WHERE.replace('canonical_name', 'merchant_name')}",
    "srt_txn": _TXN + " select transaction_id, posted_date, booked_date from txn order by coalesce(posted_date, booked_date), booked_date, transaction_id limit 200",
    "srt_truncated": _TXN + ", r as (select transaction_id, cast(row_number() over (order by abs(amount_base) nulls last, coalesce(posted_date, booked_date) desc, booked_date desc, transaction_id desc) as int) as rank from txn where market_code = 'CA') select *, (select count(*) from r) > 20 as truncated from r where rank <= 20",
    "fn_indicators": _TXN + f" select {_IND} as indicators, count(*) as n from txn group by 1",
    "job_txn_detail": _OPEN + f", cost as ({registry.ORACLES['agg_fx_cost']}) select transaction_id, {_IND} as indicators, original_amount, amount_native, amount_base, fx_rate, fx_rate_date, market_rate, explicit_fee_native, estimated_markup_native, running_native, running_base from led2 join cost using (transaction_id)",
    "agg_trends_read": POSTING + _CUBE + f""", c as (select * from monthly where dimension_type = 'category'),
j as (select c.market_scope, c.dimension_key, c.period_start, c.spending, c.coverage_status, p.spending as previous_spending, y.spending as year_spending, coalesce(p.spending, 0.00::decimal(18,2)) as s1, coalesce(e.spending, 0.00::decimal(18,2)) as s2,
 c.coverage_status = 'complete' and coalesce(p.coverage_status, 'complete') = 'complete' and coalesce(e.coverage_status, 'complete') = 'complete' as whole
 from c left join c p on p.market_scope = c.market_scope and p.dimension_key = c.dimension_key and p.period_start = c.period_start - interval 1 month left join c e on e.market_scope = c.market_scope and e.dimension_key = c.dimension_key and e.period_start = c.period_start - interval 2 month
 left join c y on y.market_scope = c.market_scope and y.dimension_key = c.dimension_key and y.period_start = c.period_start - interval 1 year)
select market_scope, dimension_key, period_start, spending, coverage_status, previous_spending, cast(spending - previous_spending as decimal(18,2)) as change, {_PCT.format(a='spending', b='previous_spending')} as change_percent, year_spending, {_PCT.format(a='spending', b='year_spending')} as year_change_percent,
 case when whole then {_mean('(spending + s1 + s2)', '3')} end as trailing_mean, case when whole then {_median('list_sort([spending, s1, s2])')} end as trailing_median, l.name as label from j left join ({fixtures.VIEWS['d_category']}) l on l.category_id = j.dimension_key""",
    "agg_summary": POSTING + _CUBE + f""", m as (select * from monthly where dimension_type = 'total'), h as (select * from m where period_start between date '1999-01-01' and date '1999-12-31'),
s as (select market_scope, cast(sum(inflow) as decimal(18,2)) as inflow, cast(sum(outflow) as decimal(18,2)) as outflow, cast(sum(spending) as decimal(18,2)) as spending, cast(sum(net) as decimal(18,2)) as net, cast(sum(transaction_count) as bigint) as transaction_count, cast(sum(pending_count) as bigint) as pending_count, max(period_start) as latest_month, max_by(spending, period_start) as latest_spending from h group by 1)
select s.*, p.spending as previous, y.spending as year, {_PCT.format(a='s.latest_spending', b='p.spending')} as change_percent, {_PCT.format(a='s.latest_spending', b='y.spending')} as year_change_percent from s left join m p on p.market_scope = s.market_scope and p.period_start = s.latest_month - interval 1 month left join m y on y.market_scope = s.market_scope and y.period_start = s.latest_month - interval 1 year""",
    "agg_compare_merchant": _NAMED + _compared("nm", "coalesce(merchant_id, 'unknown')", "coalesce(merchant_name, 'Unknown merchant')", "booked_date", ("1998-04-01", "1998-06-30"), ("1997-12-31", "1998-03-31"), reads.METRICS),
    "agg_compare_month": _NAMED + _compared("nm", "cast(cast(date_trunc('month', day) as date) as varchar)", "strftime(day, '%Y-%m')", "cast(booked_date + interval 1 year as date)", ("1998-01-01", "1998-12-31"), ("1997-01-01", "1997-12-31"), ("spending", "net_cashflow", "pending_fx_count")),
    "srt_topk": _TXN + f" select account_id as dimension_id, display_name as dimension_label, cast(coalesce(sum({_SPENT}), 0) as decimal(18,2)) as spending, cast(coalesce(sum({_IN}), 0) as decimal(18,2)) as inflow from txn where booked_date between date '1998-01-01' and date '1998-12-31' group by 1, 2 order by abs(coalesce(sum({_SPENT}), 0)) desc, dimension_label, dimension_id limit 20",
    "agg_earliest": _TXN + f" select coalesce(min(booked_date), date '{AS_OF}') as earliest from txn where market_code = 'TZ'",
    "src_snapshot": _C("d_txn") + " select account_id, count(*) as n from d_txn where updated_at <= timestamp '1998-06-10' group by 1",
    "agg_recurring_summary": _SERIES + """ select market_scope, count(*) as active_series, count_if(en < date '2001-06-15') as overdue_series,
 cast(coalesce(round(sum(case when currency = 'CAD' then cast(ea as double) * case ec when 'weekly' then 52.0 / 12 when 'biweekly' then 26.0 / 12 when 'monthly' then 1 when 'quarterly' then 1.0 / 3 else 1.0 / 12 end end), 2), 0) as decimal(18,2)) as expected_monthly_amount from sv where status in ('detected', 'confirmed') group by 1""",
    "agg_recurring_ctx": _SERIES + " select * exclude (occurrences) from ctx",
    "read_recurring": _SERIES + f""", mm as ({fixtures.VIEWS['d_merchant']}) select detector_fingerprint, coalesce(mm.canonical_name, merchant_key) as merchant_name, ctx.account_id, ctx.account_name, flow_type, ec as cadence, status, ea as expected_amount, occurrence_count, first_occurrence_date, latest_occurrence_date,
 en as expected_next_date, status in ('detected', 'confirmed') and en < date '2001-06-15' as overdue, latest_change_percent, uc as user_corrected, occurrences from sv join ctx using (market_scope, detector_fingerprint) left join mm on mm.merchant_id = sv.merchant_id where market_scope = 'ALL'""",
    "join_finding_ctx": _CONTEXT + " select market_scope, detector_fingerprint, account_id, account_name, category_id, category_name, merchant_id, merchant_name, event_date from con",
    "read_findings": _CONTEXT + """, st as (select *, case left(detector_fingerprint, 1) when '0' then 'dismissed' when '1' then 'confirmed' when '2' then 'resolved' else 'new' end as status from con where market_scope = 'TZ' and event_date between date '1999-01-01' and date '2001-06-15')
select finding_type, status, severity, account_name, category_name, merchant_name, event_date, detector_fingerprint, (select count(*) from st) as total from st order by case status when 'new' then 0 when 'confirmed' then 1 when 'dismissed' then 2 else 3 end, case severity when 'critical' then 0 when 'warning' then 1 else 2 end, detector_fingerprint limit 50""",
    "join_entity": _C("d_account", "d_category", "d_merchant") + f""", {_ASKED},
e as (select 'account' as kind, account_id as id, display_name as label, market_code, display_name || case market_code when 'CA' then ' · Canada' when 'TZ' then ' · Tanzania' else '' end as choice from d_account union all select 'category', category_id, name, null, name from d_category union all select 'merchant', merchant_id, canonical_name, null, canonical_name from d_merchant),
j as (select e.*, a.term, a.market, lower(a.term) as w, lower(label) as nm, lower(choice) as cn, e.kind <> 'account' or a.market = 'ALL' or coalesce(e.market_code = a.market, false) as inside from e join asked a on a.kind = e.kind),
t as (select *, case when inside then case when cn = w then 1 when nm = w then 2 when contains(nm, w) or contains(w, nm) or contains(cn, w) then 4 end when cn = w or nm = w then 3 end as tier from j),
r as (select *, min(tier) over (partition by kind, term, market) as best from t where tier is not null),
k as (select *, cast(row_number() over (partition by kind, term, market order by label, id) as int) as rank from r where tier = best)
select kind, term, market, rank, id, label, choice, tier <= 2 as exact, tier = 3 as matched_outside from k where rank <= 5""",
    "job_query_spec": _NAMED + ", pin as (select * from nm where updated_at <= timestamp '1998-11-30' and market_code = 'TZ')" + _compared("pin", "coalesce(category_id, 'uncategorized')", "coalesce(category_name, 'Uncategorized')", "cast(booked_date + interval 1 year as date)", ("1998-01-01", "1998-12-31"), ("1997-01-01", "1997-12-31"), ("spending", "transaction_count")) + " order by abs(spending - previous_spending) desc, dimension_label, dimension_id limit 10",
    "spec_seasonality": "select * from (" + registry.ORACLES["agg_seasonality"] + ") where market_scope = 'TZ'",
    "spec_fx": _fx_where("market_code = 'CA' and booked_date between date '1997-01-01' and date '1998-12-31'", "rows, missing, explicit_fee_base, estimated_markup_base, fx_cost_base, missing_currency"),
    "spec_transactions": _TXN + """, r as (select transaction_id, amount_base, cast(row_number() over (order by abs(amount_base) desc nulls last, coalesce(posted_date, booked_date) desc, booked_date desc, transaction_id desc) as int) as rank from txn where market_code = 'CA' and direction = 'debit' and amount_base is not null and booked_date between date '1998-01-01' and date '1998-12-31')
select *, (select count(*) from r) > 15 as truncated from r where rank <= 15""",
    "spec_plan": f"""with a as (select query, key, value from ({_fx_where("market_code = 'TZ' and updated_at <= timestamp '1998-11-30' and booked_date between date '1998-01-01' and date '1998-12-31'", "3 as query, coalesce(missing_currency, 'all') as key, cast(fx_cost_base as decimal(18,2)) as value")})),
b as ({_TXN}, p as (select * from txn where market_code = 'TZ' and updated_at <= timestamp '1998-11-30' and booked_date between date '1998-01-01' and date '1998-12-31')
 select 2 as query, transaction_id as key, cast(amount_base as decimal(18,2)) as value from (select * from p order by abs(amount_base) desc nulls last, coalesce(posted_date, booked_date) desc, booked_date desc, transaction_id desc limit 12)
 union all select 1, cast(cast(date_trunc('month', booked_date) as date) as varchar), cast(coalesce(sum({_SPENT}), 0) as decimal(18,2)) from p group by 2)
select * from a union all select * from b""",
    "val_cube": POSTING + _CUBE + """, b as (select market_scope, dimension_type, case when month(period_start) = 5 and dimension_type = 'total' then 'x' else dimension_key end as dimension_key, case when month(period_start) = 7 then period_start + 2 else period_start end as period_start, transaction_count, valued_count, pending_count as real,
 pending_count + case when month(period_start) = 3 then 1 else 0 end as pending_count, coverage_status, inflow, outflow, net + case when month(period_start) = 4 then 1 else 0 end as net from monthly)
select market_scope, dimension_type, dimension_key, period_start, unnest(list_filter([case when period_start <> date_trunc('month', period_start) then 'first_of_month' end, case when valued_count + pending_count <> transaction_count then 'counts' end, case when (coverage_status = 'partial') <> (pending_count > 0) then 'coverage' end,
 case when (dimension_type = 'total') <> (dimension_key = '') then 'key_shape' end, case when net <> inflow - outflow then 'net' end, case when real <> pending_count then 'pending_sum' end], lambda x: x is not null)) as violation from b""",
    "val_valuation": _TXN + """, k as (select *, cast(substr(transaction_id, 2, 9) as int) as k from txn),
v as (select transaction_id, currency_native, booked_date, amount_native, fx_rate, case when k % 61 = 0 then amount_base + 1 when k % 67 = 0 then null else amount_base end as amount_base, case when k % 71 = 0 then fx_rate_date - 9 else fx_rate_date end as fx_rate_date from k)
select transaction_id, unnest(list_filter([case when currency_native = 'CAD' and (fx_rate is distinct from 1 or amount_base is distinct from amount_native or fx_rate_date is distinct from booked_date) then 'identity' end,
 case when currency_native <> 'CAD' and ((fx_rate is null) <> (amount_base is null) or (fx_rate is null) <> (fx_rate_date is null)) then 'partial' end, case when currency_native <> 'CAD' and amount_base <> round(amount_native * fx_rate, 2) then 'product' end,
 case when currency_native <> 'CAD' and fx_rate_date not between booked_date - 7 and booked_date then 'rate_date' end, case when fx_rate <= 0 then 'rate_sign' end], lambda x: x is not null)) as violation from v""",
    "val_refs": _C("d_txn", "d_statement") + """, k as (select *, cast(substr(transaction_id, 2, 9) as int) as k from d_txn), t as (select transaction_id, statement_id, case when k % 61 = 0 then 'EUR' else currency_native end as c, case when k % 67 = 0 then 'A00000001' when k % 71 = 0 then 'none' else account_id end as account_id from k),
s as (select statement_id, account_id, case when month(period_start) = 2 then 'EUR' else currency end as currency from d_statement)
select 'txn' as "table", t.transaction_id as id, unnest(list_filter([case when a.account_id is null then 'unknown_account' end, case when t.c <> a.native_currency then 'account_currency' end, case when t.account_id <> s.account_id then 'statement_account' end, case when t.c <> s.currency then 'statement_currency' end], lambda x: x is not null)) as violation
 from t left join d_account a using (account_id) left join s on s.statement_id = t.statement_id
union all select 'statement', statement_id, 'account_currency' from s join d_account a using (account_id) where s.currency <> a.native_currency""",
    "val_running": _C("d_line", "d_statement") + """, w as (select l.*, lag(running) over (partition by statement_id order by line_no) as b, lead(line_no) over (partition by statement_id order by line_no) is null as last, opening_balance, closing_balance from d_line l join d_statement s using (statement_id))
select statement_id, line_no, unnest(list_filter([case when b is null and opening_balance + amount <> running then 'first_line' end, case when b + amount <> running then 'step' end, case when last and running <> closing_balance then 'closing' end], lambda x: x is not null)) as violation from w""",
    "val_category": _C("d_category_old", "d_category_new", "d_txn") + """, j as (select n.*, o.name as oname, o.kind as okind, o.parent_id as oparent, o.archived as oarch, o.is_protected as oprot, p.kind as pkind, p.archived as parch, exists (select 1 from d_txn t where t.category_id = n.category_id) as used,
 count(*) over (partition by n.parent_id, n.kind, lower(n.name)) as twins from d_category_new n left join d_category_old o using (category_id) left join d_category_new p on p.category_id = n.parent_id)
select category_id, unnest(list_filter([case when parent_id = category_id then 'self_parent' end, case when parent_id is not null and pkind is null then 'parent_missing' end, case when parch then 'parent_archived' end, case when kind <> pkind then 'parent_kind' end,
 case when oprot and (name is distinct from oname or kind is distinct from okind or parent_id is distinct from oparent or archived is distinct from oarch) then 'protected' end, case when used and kind <> okind then 'kind_in_use' end, case when twins > 1 then 'sibling_name' end], lambda x: x is not null)) as violation from j""",
    "val_identity_change": _C("d_txn") + """, n as (select account_id, kind as old_kind, native_currency as old_currency, case when cast(substr(account_id, 2) as int) % 7 = 0 then 'wallet' else kind end as kind, case when cast(substr(account_id, 2) as int) % 11 = 0 then 'EUR' else native_currency end as native_currency from d_account)
select * from n where (kind <> old_kind or native_currency <> old_currency) and exists (select 1 from d_txn t where t.account_id = n.account_id)""",
}

_HELD = "exists (select 1 from orr join d_posting t using (transaction_id) where orr.market_scope = sv.market_scope and orr.detector_fingerprint = sv.detector_fingerprint and t.account_id = '" + _OF_ACCOUNT[1] + "')"
ORACLES["flt_recurring"] = ORACLES["read_recurring"].replace("where market_scope = 'ALL'", f"where sv.market_scope = 'ALL' and {_HELD}")
ORACLES["flt_recurring_merchant"] = ORACLES["read_recurring"].replace("where market_scope = 'ALL'", f"where sv.market_scope = 'ALL' and sv.merchant_id = '{_OF_MERCHANT[1]}'")
ORACLES["flt_findings"] = _CONTEXT + " select market_scope, finding_type, case left(detector_fingerprint, 1) when '0' then 'dismissed' when '1' then 'confirmed' when '2' then 'resolved' else 'new' end as status, detector_fingerprint, event_date from con where category_id = 'C13'"
ORACLES["job_review_findings"] = _CONTEXT + """, h as (select market_scope, detector_fingerprint, finding_type, case when substr(detector_fingerprint, 2, 1) = '7' then 1 else 2 end as last_detected_generation, case when substr(detector_fingerprint, 2, 1) = '3' then 'resolved' else 'new' end as old,
 case when substr(detector_fingerprint, 2, 1) <> '7' then case left(detector_fingerprint, 1) when '0' then 'dismissed' when '1' then 'confirmed' when '2' then 'resolved' when '3' then 'new' end end as said from con)
select market_scope, detector_fingerprint, finding_type, last_detected_generation, coalesce(said, old) as status, case when said in ('confirmed', 'dismissed') then timestamp '2001-06-15' end as reviewed_at, case when said = 'resolved' then timestamp '2001-06-15' when said is null and old = 'resolved' then timestamp '2001-05-01' end as resolved_at from h"""
ORACLES["spec_recurring"] = f"select * from ({ORACLES['read_recurring']}) where flow_type = 'spend' order by case status when 'detected' then 0 when 'confirmed' then 1 when 'cancelled' then 2 else 3 end, overdue desc, expected_next_date, detector_fingerprint limit 15"
ORACLES["spec_findings"] = ORACLES["read_findings"].replace("select finding_type, status, severity, account_name, category_name, merchant_name, event_date, detector_fingerprint, (select count(*) from st) as total from st order", "select finding_type, severity, account_name, merchant_name, event_date, detector_fingerprint from st where status = 'new' order").replace("limit 50", "limit 30")
