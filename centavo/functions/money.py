"""Column expressions: flows, money, months and identities."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MONEY, TOTAL, RATE = "decimal(14,2)", "decimal(18,2)", "decimal(18,8)"


def flow(direction: Column, kind: Column, amount: Column) -> Column:
    """Read-time flow from direction, account kind and sign (a value set at ingestion goes first, by coalesce)."""
    card = kind == "credit_card"
    return F.when(direction.isin("fee", "interest"), "fee").when(direction == "payment", "transfer").when(direction == "refund", "refund").when(card & (amount < 0), "refund").when(card, "spend").when(amount > 0, "income").otherwise("spend")


def total(amount: Column) -> Column:
    """An exact sum, zero for no rows."""
    return F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL)


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def rounded(amount: Column) -> Column:
    """Half-up to two places."""
    return F.round(amount, 2).cast(MONEY)


def native_price(amount: Column, fee: Column) -> Column:
    return F.greatest(F.abs(amount) - F.abs(F.coalesce(fee, F.lit(0))), F.lit(0)).cast(MONEY)


def exact_median(values: Column) -> Column:
    """The middle of an array of decimals, or the half-up mean of the two middles; null when empty."""
    s, n = F.sort_array(values), F.size(values)
    mid = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n == 0, None).when(n % 2 == 1, mid).otherwise(F.round((F.get(s, (n / 2 - 1).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2, 2)).cast(TOTAL)


@F.arrow_udf(StringType())
def plain_description(texts: pa.Array) -> pa.Array:
    """NFKC and case folding, runs of (any) white space as one space, none at the ends."""
    return pa.array([x if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in texts.to_pylist()], pa.string())


def dedup_hash(account: Column, booked: Column, amount: Column, currency: Column, description: Column, reference: Column) -> Column:
    """Identity of a transaction: sha-256 of its parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", account, booked.cast("string"), amount.cast(MONEY).cast("string"), F.upper(currency), plain_description(description), F.regexp_replace(F.coalesce(reference, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), 256)


def percent_change4(now: Column, before: Column) -> Column:
    """Half-even to four places; null when the earlier value is null or zero."""
    return F.when(before != 0, F.bround((now - before) * 100 / F.abs(before), 4)).cast("decimal(18,4)")


def base_price(amount_base: Column, amount_native: Column, fee: Column) -> Column:
    """The base value without the inline fee's share, half-up; null when pending."""
    amount, whole = F.abs(amount_base), F.abs(amount_native)
    net = F.greatest(amount - F.round(F.abs(fee) * amount / whole, 10), F.lit(0))
    return F.when(amount_base.isNull() | fee.isNull() | (whole == 0), amount).otherwise(F.round(net, 2)).cast(MONEY)


def fingerprint(*parts: Column | str) -> Column:
    """sha-256 of the parts as text, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def percent_change(now: Column, before: Column) -> Column:
    """Half-up to two places; null when the earlier value is null or zero."""
    return F.when(before != 0, F.round((now - before) * 100 / F.abs(before), 2)).cast(TOTAL)
