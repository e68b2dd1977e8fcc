"""Queries of the detectors over postings, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import cube, detect, findings, outliers, series, statements
from .registry import BASE, POSTING, _median, postings

AS_OF = "2001-06-15"


def _date() -> Column:
    """As a call: a column needs a session."""
    return F.lit(AS_OF).cast("date")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.recurring(postings(spark, sf_dir), _date(), BASE)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.monthly(postings(spark, sf_dir), ("total", "category", "merchant"))


def reviews(found: DataFrame) -> DataFrame:
    """What users decided, drawn from the fingerprints: some ignored, confirmed, or with a cadence or a date of their own."""
    digit = F.substring("detector_fingerprint", 1, 1)
    rows = found.select("market_scope", "detector_fingerprint", F.when(digit == "0", "ignored").when(digit == "1", "confirmed").otherwise("detected").alias("status"))
    return rows.select("*", F.when(digit == "2", "monthly").alias("cadence_override"), F.when(digit == "3", F.lit(9_000_000)).cast("decimal(14,2)").alias("expected_amount_override"), F.when(digit == "4", F.lit("2001-07-01").cast("date")).alias("next_date_override"))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _series(spark, sf_dir)
    checked = statements.coverage_status(statements.reconcile(fixtures.view(spark, sf_dir, "d_statement"), fixtures.view(spark, sf_dir, "d_txn")))
    sources = findings.statement_findings(checked, fixtures.view(spark, sf_dir, "d_account"))
    return findings.build(postings(spark, sf_dir), _cube(spark, sf_dir), found, sources, _date(), reviews(found))


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.amounts(postings(spark, sf_dir)).select("market_scope", "transaction_id", "prior_count", "baseline", "difference", "method", "score")


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where("merchant_key is not null and amount_base is not null").select("merchant_key", "booked_date", "transaction_id", F.abs("amount_base").alias("value"))
    return outliers.prior_statistics(rows, ["merchant_key"], "booked_date", "transaction_id", "value", chunk_rows=100).drop("value", "booked_date")


QUERIES = {
    "win_prior_set": _prior,
    "det_amount_outlier": _amounts,
    "det_frequency": lambda s, d: outliers.frequency(postings(s, d), _date()).select("market_scope", "merchant_key", "flow_type", "period_start", F.col("value").cast("long").alias("transaction_count"), "prior_count", "baseline", "difference", "method", "score"),
    "det_spike": lambda s, d: outliers.spikes(_cube(s, d), _date()).select("market_scope", "dimension_type", "dimension_key", "period_start", F.col("value").alias("spending"), "prior_count", "baseline", "difference", "method", "score"),
    "det_recurring": lambda s, d: _series(s, d).drop("occurrences"),
    "win_occurrence_no": lambda s, d: series.occurrences(_series(s, d)).drop("account_id"),
    "det_price_increase": lambda s, d: (lambda x: series.price_increases(x, reviews(x), BASE))(_series(s, d)),
    "det_overdue": lambda s, d: (lambda x: series.overdue(x, _date(), reviews(x)))(_series(s, d)),
    "det_findings": lambda s, d: all_findings(s, d).select("market_scope", "finding_type", "severity", "headline", "account_id", "transaction_id", "series_fingerprint", "detector_fingerprint"),
}


def _mid(s: str) -> str:
    """SQL for the half-up median, in cents, of a sorted list of cents."""
    two = f"({s}[len({s}) // 2] + {s}[len({s}) // 2 + 1])"
    return f"case when len({s}) % 2 = 1 then {s}[len({s}) // 2 + 1] when len({s}) > 0 then sign({two}) * ((abs({two}) + 1) // 2) end"


def _ratio(a: str, b: str) -> str:
    """SQL for a / b in ten-thousandths, half-even, of whole numbers, b above zero."""
    q, r = f"(abs({a}) // ({b}))", f"(abs({a}) % ({b}))"
    return f"(sign({a}) * ({q} + case when 2 * {r} > ({b}) or (2 * {r} = ({b}) and {q} % 2 = 1) then 1 else 0 end))"


def _stats(name: str, source: str, keys: str, day: str, tie: str, value: str) -> str:
    """SQL for a table name of what prior_statistics() gives, in cents: n, b, mad, lo, hi; and cents, the value."""
    return f""",
{name}_h as (select *, cast({value} * 100 as bigint) as cents, list(cast({value} * 100 as bigint)) over (partition by {keys} order by {day}, {tie} rows between unbounded preceding and 1 preceding) as h from {source}),
{name}_s as (select * exclude (h), list_sort(h) as s, len(h) as n from {name}_h where len(h) >= {outliers.LEAST_PRIOR}),
{name}_b as (select *, {_mid('s')} as b from {name}_s),
{name}_a as (select *, list_sort(list_transform(s, lambda x: abs(x - b))) as a, s[1 : n // 2] as l, s[n - n // 2 + 1 : n] as u from {name}_b),
{name} as (select * exclude (s, a, l, u), {_mid('a')} as mad, {_mid('l')} as lo, {_mid('u')} as hi from {name}_a)"""


def _money(c: str) -> str:
    return f"cast({c} * cast(0.01 as decimal(3,2)) as decimal(18,2))"


def _outliers(name: str, source: str, two_sided: bool, least_cents: int, z: int = 35000, twice_times: int = 3) -> str:
    """SQL for a table name of the outliers of a table of _stats()."""
    diff, size = "(cents - b)", "abs(cents - b)" if two_sided else "(cents - b)"
    edge = "case when cents > hi then hi else lo end" if two_sided else "hi"
    out = f"2 * (cents - hi) > {twice_times} * (hi - lo)" + (f" or 2 * (lo - cents) > {twice_times} * (hi - lo)" if two_sided else "")
    mad = _ratio(f"(6745 * {diff})", "mad")
    iqr = _ratio(f"(10000 * (cents - {edge}))", "(hi - lo)")
    score = f"case when mad > 0 then {mad} when hi > lo then {iqr} end"
    return f""",
{name}_j as (select *, cast({score} as bigint) as sc from {source} where {size} >= {least_cents}),
{name} as (select *, n as prior_count, {_money('b')} as baseline, {_money(diff)} as difference, case when mad > 0 then 'mad' else 'iqr' end as method, cast(sc * cast(0.0001 as decimal(5,4)) as decimal(18,4)) as score
 from {name}_j where case when mad > 0 then {'abs(sc)' if two_sided else 'sc'} >= {z} else hi = lo or {out} end)"""


_SCOPED = POSTING + ", sc as (select t.*, s.market_scope from txn t, lateral (select 'ALL' as market_scope union all select t.market_code where t.market_code is not null) s)"
_MONTH = f"date '{AS_OF[:7]}-01'"
_AMOUNT = ", am as (select *, abs(amount_base) as v from sc where merchant_key is not null and amount_base is not null and flow_type not in ('transfer', 'refund'))" + _stats("ams", "am", "market_scope, merchant_key, flow_type", "booked_date", "transaction_id", "v") + _outliers("amo", "ams", True, 1000)
_FREQUENCY = f""", fc as (select market_scope, merchant_key, flow_type, cast(date_trunc('month', booked_date) as date) as period_start, count(*) as n from sc where merchant_key is not null and flow_type not in ('transfer', 'refund') and booked_date < {_MONTH} group by all),
fs as (select market_scope, merchant_key, flow_type, cast(unnest(generate_series(min(period_start), max(period_start), interval 1 month)) as date) as period_start from fc group by 1, 2, 3),
ff as (select fs.*, coalesce(fc.n, 0) as v from fs left join fc using (market_scope, merchant_key, flow_type, period_start))""" + _stats("frs", "ff", "market_scope, merchant_key, flow_type", "period_start", "period_start", "v") + _outliers("fro", "frs", False, 200)
_SPIKE = f""", sk as (select market_scope, d.dimension_type, d.dimension_key, cast(date_trunc('month', booked_date) as date) as period_start, amount_base, flow_type from sc t,
 lateral (select 'total' as dimension_type, '' as dimension_key union all select 'category', t.category_id union all select 'merchant', t.merchant_id) d where d.dimension_key is not null and booked_date < {_MONTH}),
sp as (select distinct market_scope, period_start from sk where dimension_type = 'total' and amount_base is null),
sm as (select market_scope, dimension_type, dimension_key, period_start, sum(case when flow_type in ('spend', 'fee') then abs(amount_base) when flow_type = 'refund' then -abs(amount_base) end) as v from sk where dimension_type <> 'total' group by all),
ss as (select market_scope, dimension_type, dimension_key, cast(unnest(generate_series(min(period_start), max(period_start), interval 1 month)) as date) as period_start from sm group by 1, 2, 3),
sf as (select ss.*, cast(coalesce(v, 0) as decimal(18,2)) as v from ss left join sm using (market_scope, dimension_type, dimension_key, period_start) where not exists (select 1 from sp where sp.market_scope = ss.market_scope and sp.period_start = ss.period_start))""" + _stats("sps", "sf", "market_scope, dimension_type, dimension_key", "period_start", "period_start", "v") + _outliers("spo", "sps", False, 1000)
_PLAIN_CADENCE = "case m when weekly then 'weekly' when biweekly then 'biweekly' when monthly then 'monthly' when quarterly then 'quarterly' else 'annual' end"
_SERIES = f""", rr as (select *, greatest(abs(amount_native) - abs(coalesce(fx_fee_amount_native, 0)), 0) as np, cast(abs(amount_base) * 100 as hugeint) as bc, cast(abs(amount_native) * 100 as hugeint) as nc, cast(abs(fx_fee_amount_native) * 100 as hugeint) as fc
 from sc where merchant_key is not null and flow_type in ('spend', 'income') and amount_native <> 0),
rp as (select *, cast(case when amount_base is null then null when fx_fee_amount_native is null then abs(amount_base) else {_money('greatest((2 * bc * (nc - fc) + nc) // (2 * nc), 0)')} end as decimal(14,2)) as bp,
 booked_date - lag(booked_date) over (partition by market_scope, merchant_key, flow_type order by booked_date, transaction_id) as gap from rr),
rg as (select market_scope, merchant_key, flow_type, count(*) as n, case when min(merchant_id) = max(merchant_id) then min(merchant_id) end as merchant_id, min(booked_date) as first_date, max(booked_date) as last_date,
 case when min(original_currency) = max(original_currency) and count(original_amount) = count(*) then 'original' when min(currency_native) = max(currency_native) then 'native' when count(amount_base) = count(*) then 'base' end as basis,
 min(original_currency) as oc, min(currency_native) as nc, list(abs(original_amount) order by booked_date, transaction_id) as op, list(np order by booked_date, transaction_id) as nps, list(bp order by booked_date, transaction_id) as bps,
 list(transaction_id order by booked_date, transaction_id) as ids, list(account_id order by booked_date, transaction_id) as accounts, list(booked_date order by booked_date, transaction_id) as days,
 list_sort(list(gap) filter (where gap is not null)) as gaps, count_if(gap between 5 and 9) as weekly, count_if(gap between 12 and 16) as biweekly, count_if(gap between 25 and 35) as monthly, count_if(gap between 80 and 100) as quarterly,
 count_if(gap between 330 and 400) as annual from rp group by 1, 2, 3 having count(*) >= 2 and count(*) = count(distinct booked_date)),
rm as (select *, greatest(weekly, biweekly, monthly, quarterly, annual) as m from rg),
rc as (select *, {_PLAIN_CADENCE} as cadence, cast(case basis when 'original' then op when 'native' then nps else bps end as decimal(18,2)[]) as p, case basis when 'original' then oc when 'native' then nc else 'CAD' end as currency
 from rm where m * 4 >= (n - 1) * 3 and basis is not null),
re as (select *, {_median('list_sort(p)')} as expected_amount, cast(round((gaps[(n - 1) // 2 + (n - 1) % 2] + gaps[(n - 1) // 2 + 1]) / 2.0) as int) as step from rc where (cadence = 'annual' or n >= 3) and list_min(p) > 0 and len(list_filter(p, lambda x: x is null)) = 0),
rs as (select *, {_ratio('(10000 * m)', '(n - 1)')} as ist, {_ratio("(10000 * len(list_filter(p, lambda x: abs(x - expected_amount) * 10 <= expected_amount)))", 'n')} as ast from re),
ser as (select *, last_date + step as next_date, sha256(concat_ws(chr(31), market_scope, 'recurring', merchant_key, flow_type, basis, case when basis = 'base' then 'CAD' || chr(31) || '{series.POLICY}' else currency end)) as detector_fingerprint from rs),
rev as (select *, left(detector_fingerprint, 1) as k from ser where left(detector_fingerprint, 1) <> '0')"""
_FOUR = "cast({} * cast(0.0001 as decimal(5,4)) as decimal(5,4))"
_PRICE = f""", pb as (select *, list_sort(p[1 : n - 1]) as before, p[n] as latest_amount, bps[1 : n - 1] as bb, bps[n] as lb from rev where case when cadence = 'annual' then n > 2 or (n = 2 and k = '1') else n >= 4 end),
pm as (select *, {_median('before')} as previous_median, case when lb is not null and len(list_filter(bb, lambda x: x is null)) = 0 then lb - {_median('list_sort(cast(bb as decimal(18,2)[]))')} end as ib from pb),
pi as (select *, cast(latest_amount - previous_median as decimal(18,2)) as increase_amount, cast(ib as decimal(18,2)) as increase_base from pm where previous_median > 0 and (cadence = 'annual' or len(list_filter(before, lambda x: abs(x - previous_median) * 20 > previous_median)) = 0)),
pr as (select *, cast({_ratio('cast(increase_amount * 100 as hugeint) * 1000000', 'cast(previous_median * 100 as hugeint)')} * cast(0.0001 as decimal(5,4)) as decimal(18,4)) as increase_percent from pi where increase_amount > 0),
pro as (select market_scope, detector_fingerprint, ids[n] as latest_transaction_id, accounts[n] as account_id, currency, previous_median, cast(latest_amount as decimal(14,2)) as latest_amount, increase_amount, increase_percent, increase_base from pr
 where increase_percent >= 5 and case when increase_base is not null then increase_base >= 1 else currency = 'CAD' and increase_amount >= 1 end and (k <> '3' or latest_amount > 9000000))"""
_OVERDUE = f""", od as (select *, case when k = '4' then date '2001-07-01' when k = '2' then last_date + 30 else next_date end as expected_next_date, case when k = '2' then 'monthly' else cadence end as shown from rev),
ovo as (select market_scope, detector_fingerprint, merchant_key, shown as cadence, expected_next_date, ids[n] as transaction_id, accounts[n] as account_id from od where date '{AS_OF}' > expected_next_date)"""
_TWICE = """, nd as (select *, abs(amount_native) as amount from txn where flow_type = 'spend' and merchant_key is not null and not is_reversal and coalesce(direction not in ('payment', 'refund'), true)),
ndp as (select a.account_id, a.market_code, b.transaction_id, sha256(concat_ws(chr(31), 'near_duplicate', a.transaction_id, b.transaction_id, a.account_id, a.merchant_key, a.currency_native, a.amount, b.booked_date - a.booked_date)) as raw
 from nd a join nd b on a.account_id = b.account_id and a.merchant_key = b.merchant_key and a.currency_native = b.currency_native and a.amount = b.amount and b.booked_date - a.booked_date between 0 and 3 and (b.booked_date > a.booked_date or a.transaction_id < b.transaction_id))"""
_CHECKED = """, d_sums as (select statement_id, sum(amount_native) as activity from d_txn group by all),
d_rec as (select s.*, a.market_code, coalesce(activity, 0) as activity, cast(closing_balance - opening_balance - coalesce(activity, 0) as decimal(18,2)) as short, max(period_end) over (partition by account_id order by period_start, period_end, statement_id rows between unbounded preceding and 1 preceding) as covered
 from d_statement s left join d_sums using (statement_id) join d_account a using (account_id)),
d_sc as (select t.*, s.market_scope from d_rec t, lateral (select 'ALL' as market_scope union all select t.market_code where t.market_code is not null) s)"""


def _sha(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


_ALL = f""", raws as (
select market_scope, 'unusual_amount' as finding_type, 'warning' as severity, 'Unusual transaction amount' as headline, account_id, transaction_id, null as series_fingerprint, {_sha("'unusual_amount'", 'transaction_id', 'amount_base', 'baseline', 'difference', 'method')} as raw from amo
union all select market_scope, 'unusual_frequency', 'warning', 'Unusual transaction frequency', null, null, null, {_sha("'unusual_frequency'", 'merchant_key', 'flow_type', 'period_start', 'cents // 100', "case when n % 2 = 1 then cast(b // 100 as varchar) else cast(baseline as varchar) end")} from fro
union all select market_scope, 'monthly_spike', 'warning', 'Monthly ' || dimension_type || ' spending spike', null, null, null, {_sha("'monthly_spike'", 'dimension_type', 'dimension_key', 'period_start', 'v', 'baseline')} from spo
union all select s.market_scope, 'near_duplicate', 'warning', 'Possible duplicate charge', account_id, transaction_id, null, raw from ndp t, lateral (select 'ALL' as market_scope union all select t.market_code where t.market_code is not null) s
union all select market_scope, 'recurring_price_increase', 'warning', 'Recurring price increased', account_id, latest_transaction_id, detector_fingerprint, {_sha("'recurring_price_increase'", 'detector_fingerprint', 'latest_transaction_id', 'previous_median', 'latest_amount')} from pro
union all select market_scope, 'recurring_overdue', 'info', 'Recurring transaction is overdue', account_id, transaction_id, detector_fingerprint, {_sha("'recurring_overdue'", 'detector_fingerprint', 'expected_next_date')} from ovo
union all select market_scope, 'pending_fx', 'info', 'CAD valuation is pending', account_id, transaction_id, null, {_sha("'pending_fx'", 'transaction_id', 'booked_date', 'amount_native', 'currency_native')} from sc where amount_base is null
union all select market_scope, 'reconciliation_mismatch', 'critical', 'Statement does not reconcile', account_id, null, null, {_sha("'reconciliation_mismatch'", 'statement_id', 'opening_balance', 'cast(activity as decimal(18,2))', 'closing_balance', 'short')} from d_sc where short <> 0
union all select market_scope, 'coverage_gap', 'warning', 'Statement coverage gap', account_id, null, null, {_sha("'coverage_gap'", 'account_id', 'covered + 1', 'period_start - 1')} from d_sc where period_start > covered + 1),
fin as (select * exclude (raw), sha256(concat_ws(chr(31), market_scope, case when finding_type in {findings.BASE_SENSITIVE} then 'CAD' || chr(31) || '{series.POLICY}' end, raw)) as detector_fingerprint from raws)"""

#: Findings as table fin.
FINDINGS = _SCOPED.replace(", x as (select t.*", f", d_statement as ({fixtures.VIEWS['d_statement'].strip()}), x as (select t.*", 1) + _AMOUNT + _FREQUENCY + _SPIKE + _SERIES + _PRICE + _OVERDUE + _TWICE + _CHECKED + _ALL

ORACLES = {
    "win_prior_set": POSTING + ", am as (select *, abs(amount_base) as v from txn where merchant_key is not null and amount_base is not null)" + _stats("ams", "am", "merchant_key", "booked_date", "transaction_id", "v") + f" select merchant_key, transaction_id, n as prior_count, {_money('b')} as baseline, {_money('mad')} as mad, {_money('lo')} as lower_quartile, {_money('hi')} as upper_quartile from ams",
    "det_amount_outlier": _SCOPED + _AMOUNT + " select market_scope, transaction_id, prior_count, baseline, difference, method, score from amo",
    "det_frequency": _SCOPED + _FREQUENCY + " select market_scope, merchant_key, flow_type, period_start, cents // 100 as transaction_count, prior_count, baseline, difference, method, score from fro",
    "det_spike": _SCOPED + _SPIKE + " select market_scope, dimension_type, dimension_key, period_start, v as spending, prior_count, baseline, difference, method, score from spo",
    "det_recurring": _SCOPED + _SERIES + f""" select market_scope, merchant_key, flow_type, merchant_id, cadence, basis, currency, cast(n as int) as occurrence_count, expected_amount, first_date, last_date, next_date, {_FOUR.format('ist')} as interval_stability, {_FOUR.format('ast')} as amount_stability,
 {_FOUR.format(_ratio('(ist * 55 + ast * 25 + 200000)', '100'))} as confidence, detector_fingerprint, date '{AS_OF}' > next_date as overdue from ser""",
    "win_occurrence_no": _SCOPED + _SERIES + """, un as (select market_scope, detector_fingerprint, basis, currency, unnest(range(1, n + 1)) as i, ids, days, p from ser)
select market_scope, detector_fingerprint, cast(i as int) as occurrence_number, ids[i] as transaction_id, days[i] as occurrence_date, cast(p[i] as decimal(14,2)) as comparison_amount, basis as comparison_basis, currency as comparison_currency from un""",
    "det_price_increase": _SCOPED + _SERIES + _PRICE + " select * from pro",
    "det_overdue": _SCOPED + _SERIES + _OVERDUE + " select * from ovo",
    "det_findings": FINDINGS + " select * from fin",
}
