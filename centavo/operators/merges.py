"""Keyed merges of a new generation with what is kept: cube months, series, occurrences, findings, and users' decisions.

Every merge rewrites a table by one full outer join on its key; a side is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES_KEY = ["market_scope", "detector_fingerprint"]
#: What users decide about a series; a merge never changes it.
DECISIONS = {"status": "string", "cadence_override": "string", "expected_amount_override": "decimal(14,2)", "next_date_override": "date"}
_DETECTED = ("merchant_key", "flow_type", "cadence", "basis", "currency", "expected_amount", "next_date", "confidence", "last_date")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """Rows of either side; of both, the new row's columns, except those that changed builds from the columns old_<name> and new_<name>."""
    changed = changed or {}
    rest = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"{name}_here"))
    rows = side(old, "old").join(side(new, "new"), keys, "full")
    return rows.select(*keys, *[changed[c].alias(c) if c in changed else F.when(F.col("new_here"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in rest])


def copy_unaffected(previous: DataFrame, cube: DataFrame, affected: DataFrame) -> DataFrame:
    """A new generation: the previous one's months that are not affected (period_start), and the recomputed months."""
    months = F.broadcast(affected.select("period_start").distinct())  # a row a month
    return previous.join(months, "period_start", "left_anti").unionByName(cube.join(months, "period_start", "left_semi"))


def merge_series(old: DataFrame, found: DataFrame, generation: int) -> DataFrame:
    """Detected facts come from the new generation, decisions and the first date ever seen from the old one; detected series that are no longer seen go."""
    new = found.select(*SERIES_KEY, "merchant_id", *_DETECTED, "first_date", *[F.lit(None).cast(t).alias(c) for c, t in DECISIONS.items() if c != "status"], F.lit("detected").alias("status"), F.lit(generation).alias("last_detected_generation"))
    keep = {c: F.col(f"old_{c}") for c in DECISIONS if c != "status"} | {"status": F.coalesce("old_status", F.lit("detected"))}
    keep |= {"merchant_id": F.coalesce("new_merchant_id", "old_merchant_id"), "first_date": F.least("old_first_date", "new_first_date")}
    merged = upsert(old.select(*new.columns), new, SERIES_KEY, keep)
    return merged.where((F.col("status") != "detected") | (F.col("last_detected_generation") == generation))


def replace_occurrences(old: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """Detected occurrences of the series seen now are replaced; those that users matched, and those of series not seen, stay. seen: the found series.
    old and found: (key, transaction_id, ..., match_source)."""
    gone = old.where("match_source = 'detected'").join(seen.select(*SERIES_KEY), SERIES_KEY, "left_semi").select(*SERIES_KEY, "transaction_id")
    kept = old.join(gone, [*SERIES_KEY, "transaction_id"], "left_anti")
    return kept.unionByName(found.join(kept.select(*SERIES_KEY, "transaction_id"), [*SERIES_KEY, "transaction_id"], "left_anti"))


def first_findings(found: DataFrame, generation: int) -> DataFrame:
    """Findings of a generation that has none before it: all are new."""
    return found.withColumn("status", F.lit("new")).withColumn("last_detected_generation", F.lit(generation))


def merge_findings(old: DataFrame, found: DataFrame, generation: int) -> DataFrame:
    """A finding that reappears after being resolved is new; dismissed and confirmed ones keep their status; new and confirmed ones that are not seen any more are resolved."""
    new = first_findings(found, generation)
    here = F.coalesce("new_here", F.lit(False))
    status = F.when(here & (F.coalesce("old_status", F.lit("resolved")) == "resolved"), "new").when(here, F.col("old_status")).when(F.col("old_status").isin("new", "confirmed"), "resolved").otherwise(F.col("old_status"))
    return upsert(old.select(*new.columns), new, SERIES_KEY, {"status": status})


def patch(rows: DataFrame, decisions: DataFrame, columns: list[str], keys: list[str] = SERIES_KEY) -> DataFrame:
    """Users' decisions applied: a decision's columns that are not null replace the row's; decisions about unknown rows do nothing."""
    given = decisions.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(given, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def review_findings(held: DataFrame, decisions: DataFrame, at: Column, generation: int) -> DataFrame:
    """Users' decisions about findings of the published generation (market_scope, detector_fingerprint, status): confirming and dismissing note the time of
    review, resolving the time of resolution, and any other status clears that one. Of several decisions about one finding the greatest status by name holds;
    null and unknown statuses, and decisions about findings of other generations or unknown ones, change nothing."""
    known = decisions.where(F.col("status").isin("new", "confirmed", "dismissed", "resolved")).groupBy(*SERIES_KEY).agg(F.max("status").alias("__to"))
    rows = held.join(known, SERIES_KEY, "left").withColumn("__to", F.when(F.col("last_detected_generation") == generation, F.col("__to")))
    changed = {
        "status": F.coalesce("__to", "status"),
        "reviewed_at": F.when(F.col("__to").isin("confirmed", "dismissed"), at).otherwise(F.col("reviewed_at")),
        "resolved_at": F.when(F.col("__to") == "resolved", at).when(F.col("__to").isNull(), F.col("resolved_at")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in held.columns])


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("market_scope").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "confirmed", "dismissed", "resolved")])


def freeze_thresholds(known: DataFrame, rates: DataFrame, target: str, day: str, source: str = "CAD") -> DataFrame:
    """Adds a currency's materiality floors, the source's floors times one dated rate (half-up, the latest of the 8 days up to day), if it has none yet; with no such rate nothing is added."""
    at = F.lit(day).cast("date")
    near = rates.where((F.col("base") == source) & (F.col("quote") == target) & F.col("as_of").between(F.date_sub(at, 7), at))
    rate = near.agg(F.max(F.struct("as_of", "rate")).alias("r")).select("r.*").where("rate is not null")
    floors = [c for c in known.columns if c.startswith("minimum_")]
    fresh = known.where(F.col("base_currency") == source).crossJoin(F.broadcast(rate)).select(F.lit(target).alias("base_currency"), "policy_version", *[F.round(F.col(c) * F.col("rate"), 2).cast("decimal(18,2)").alias(c) for c in floors], F.col("rate").alias("source_rate"), F.col("as_of").alias("source_rate_date"))
    return known.unionByName(fresh.join(known.select("base_currency"), "base_currency", "left_anti").select(*known.columns))


def convert_series(series: DataFrame, rate: str, source: str, target: str, policy: str) -> DataFrame:
    """On a switch of the base currency: amounts and overrides of series compared in the old base are converted by the audited rate, with new fingerprints."""
    from ..functions.money import fingerprint

    moved = (F.col("basis") == "base") & (F.col("currency") == source)
    money = lambda c: F.when(moved, F.round(F.col(c) * F.lit(rate).cast("decimal(18,8)"), 2)).otherwise(F.col(c)).cast("decimal(14,2)")
    name = fingerprint(F.col("market_scope"), "recurring", F.col("merchant_key"), F.col("flow_type"), F.col("basis"), target, policy)
    changed = {"expected_amount": money("expected_amount"), "expected_amount_override": money("expected_amount_override"), "detector_fingerprint": F.when(moved, name).otherwise(F.col("detector_fingerprint")), "currency": F.when(moved, target).otherwise(F.col("currency"))}
    return series.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in series.columns], F.when(moved, F.col("detector_fingerprint")).alias("former_fingerprint"))


def convert_occurrences(held: DataFrame, converted: DataFrame, rate: str, source: str, target: str) -> DataFrame:
    """Occurrences follow their series' new fingerprints; amounts compared in the old base currency are converted. converted: what convert_series returned."""
    moved = converted.where("former_fingerprint is not null").select("market_scope", F.col("former_fingerprint").alias("detector_fingerprint"), F.col("detector_fingerprint").alias("__now"))
    rows = held.join(moved, SERIES_KEY, "left")
    priced = F.col("__now").isNotNull() & (F.col("comparison_basis") == "base") & (F.col("comparison_currency") == source)
    changed = {
        "detector_fingerprint": F.coalesce("__now", "detector_fingerprint"),
        "comparison_amount": F.when(priced, F.round(F.col("comparison_amount") * F.lit(rate).cast("decimal(18,8)"), 2)).otherwise(F.col("comparison_amount")).cast("decimal(14,2)"),
        "comparison_currency": F.when(priced, target).otherwise(F.col("comparison_currency")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in held.columns])


def convert_findings(held: DataFrame, converted: DataFrame, target: str, policy: str) -> DataFrame:
    """Overdue findings of converted series keep their status under the new identity and name the new currency and policy; findings whose
    meaning depends on the base currency are resolved, to be found anew. Other findings stay."""
    from ..functions.money import fingerprint
    from .findings import BASE_SENSITIVE

    moved = converted.where("former_fingerprint is not null").select("market_scope", F.col("former_fingerprint").alias("series_fingerprint"), F.col("detector_fingerprint").alias("__now"))
    rows = held.join(moved, ["market_scope", "series_fingerprint"], "left")
    day = F.nullif(F.col("evidence")["expectedNextDate"], F.lit(""))
    late = F.col("__now").isNotNull() & (F.col("finding_type") == "recurring_overdue") & day.isNotNull()
    told = F.map_concat(F.map_filter("evidence", lambda k, _: ~k.isin("baseCurrency", "thresholdPolicyVersion")), F.create_map(F.lit("baseCurrency"), F.lit(target), F.lit("thresholdPolicyVersion"), F.lit(policy)))
    changed = {
        "series_fingerprint": F.coalesce("__now", "series_fingerprint"),
        "detector_fingerprint": F.when(late, fingerprint(F.col("market_scope"), fingerprint("recurring_overdue", F.col("__now"), day))).otherwise(F.col("detector_fingerprint")),
        "evidence": F.when(late, told).otherwise(F.col("evidence")),
        "status": F.when(F.col("finding_type").isin(*BASE_SENSITIVE), "resolved").otherwise(F.col("status")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in held.columns])
