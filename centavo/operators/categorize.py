"""Merchants and categories of postings: keys, flows, rules, what was learned, assignments and users' decisions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rules in order (words, category, kind).
RULES = (
    ("refund|reversal|credit", "Refunds", "transfer"),
    ("fee|interest", "Fees & Interest", "fee"),
    ("grocery|supermarket|market|loblaws|walmart|costco", "Groceries", "spend"),
    ("cafe|coffee|restaurant|pizza|grill|bakery|doordash|uber eats", "Dining", "spend"),
    ("uber|taxi|transit|metro|fuel|gas station", "Transport", "spend"),
    ("hotel|airline|airways|flight|booking", "Travel", "spend"),
    ("phone|internet|hydro|electric|utility", "Utilities", "spend"),
    ("pharmacy|clinic|hospital|dental", "Health", "spend"),
    ("cinema|spotify|netflix|music", "Entertainment", "spend"),
)
PAYMENT, TRANSFER, BACK = "payment|autopay|thank you", "transfer|e-?transfer|wire", "refund|reversal"
#: Confidence from which an assignment is applied without review.
AUTO_APPLY = "0.85"


@F.arrow_udf(StringType())
def folded(texts: pa.Array) -> pa.Array:
    """NFKC and case folding."""
    return pa.array([x if x is None else unicodedata.normalize("NFKC", x).casefold() for x in texts.to_pylist()], pa.string())


def merchant_key(description: Column) -> Column:
    """The description without references and numbers, words apart by one space; unknown if nothing is left."""
    text = F.regexp_replace(folded(description), r"(?U)\b(?:ref|reference|txn)(?:\s*[#:]|\s+)[a-z0-9-]+\b", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\d{2,}", " "), "[^a-z0-9]+", " "))
    return F.when(text == "", "unknown").otherwise(text)


def _word(description: Column, words: str) -> Column:
    return description.rlike(rf"(?iU)\b({words})\b")


def flow(description: Column, direction: Column, kind: Column, amount: Column) -> Column:
    """The flow at ingestion; unlike the one at reading it looks at the description."""
    asset = kind != "credit_card"
    return F.when(direction.isin("fee", "interest"), "fee").when((direction == "refund") | _word(description, BACK), "refund").when((direction == "payment") | _word(description, PAYMENT) | _word(description, TRANSFER), "transfer").when(asset & ((direction == "credit") | (amount > 0)), "income").when(~asset & (amount < 0), "refund").otherwise("spend")


def flow_unresolved(given: Column, direction: Column, kind: Column, amount: Column) -> Column:
    """The flow by which unresolved merchants are listed: a given one, else by direction; income of asset accounts needs direction credit."""
    asset = kind != "credit_card"
    return F.coalesce(F.nullif(given, F.lit("")), F.when(direction.isin("fee", "interest"), "fee").when(direction == "refund", "refund").when(direction == "payment", "transfer").when(asset & (direction == "credit"), "income").when(~asset & (amount < 0), "refund").otherwise("spend"))


def kind_for_flow(flow_type: Column) -> Column:
    return F.when(flow_type == "refund", "transfer").otherwise(flow_type)


def category(description: Column, direction: Column, kind: Column, flow_type: Column) -> Column:
    """struct(name, kind, confidence, source): payments, transfers, the rules in order, the direction, income of asset accounts, and Other as fallback."""
    made = lambda name, of, sure, source: F.struct(name.alias("name"), F.lit(of).alias("kind"), F.lit(sure).cast("decimal(5,4)").alias("confidence"), F.lit(source).alias("source"))
    rule = lambda name, of: made(F.lit(name), of, "1", "rule")
    paid = made(F.when(kind == "credit_card", "Payments").otherwise("Transfers"), "transfer", "1", "rule")
    out = F.when(_word(description, PAYMENT), paid).when(_word(description, TRANSFER), rule("Transfers", "transfer"))
    for words, name, of in RULES:
        out = out.when(_word(description, words), rule(name, of))
    out = out.when(direction == "payment", paid).when(direction == "refund", rule("Refunds", "transfer")).when(direction.isin("fee", "interest"), rule("Fees & Interest", "fee"))
    return out.when((kind != "credit_card") & (flow_type == "income"), rule("Income", "income")).otherwise(made(F.lit("Other"), "spend", "0", "fallback"))


def categorize(rows: DataFrame) -> DataFrame:
    """rows: postings with their account's kind. Adds merchant_key, merchant_name, flow_type and the category by rule."""
    text, way, kind = F.col("description_raw"), F.col("direction"), F.col("kind")
    rows = rows.withColumn("merchant_key", merchant_key(text)).withColumn("flow_type", flow(text, way, kind, F.col("amount_native")))
    return rows.withColumn("merchant_name", F.initcap("merchant_key")).withColumn("rule", category(text, way, kind, F.col("flow_type"))).select("*", F.col("rule.name").alias("category_name"), F.col("rule.kind").alias("category_kind"), F.col("rule.confidence").alias("category_confidence"), F.col("rule.source").alias("category_source")).drop("rule")


def resolve_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds category_id: the active root category of that name (whatever its case) and kind; else the protected Other, as a fallback of confidence 0.
    categories: (category_id, parent_id, name, kind, archived, is_protected), a small table."""
    roots = categories.where("parent_id is null and not archived")
    known = roots.groupBy(F.lower("name").alias("__name"), F.col("kind").alias("__kind")).agg(F.min("category_id").alias("__id"))
    other = roots.where("lower(name) = 'other' and is_protected").agg(F.min("category_id").alias("__other"))
    out = rows.join(known, (F.lower("category_name") == F.col("__name")) & (F.col("category_kind") == F.col("__kind")), "left").crossJoin(F.broadcast(other))
    lost = F.col("__id").isNull()
    return out.select(*[c for c in rows.columns if c not in ("category_confidence", "category_source")], F.coalesce("__id", "__other").alias("category_id"), F.when(lost, F.lit(0)).otherwise(F.col("category_confidence")).cast("decimal(5,4)").alias("category_confidence"), F.when(lost, "fallback").otherwise(F.col("category_source")).alias("category_source"))


def learned_category(rows: DataFrame, mappings: DataFrame, categories: DataFrame) -> DataFrame:
    """What was learned about a merchant and flow: a user's mapping always counts, a proposed one only over a fallback; its category must be active and of the flow's kind.
    mappings: (merchant_id, flow_type, category_id, source, confidence)."""
    live = mappings.join(categories.where("not archived").select("category_id", F.col("kind").alias("__kind")), "category_id").where(F.col("__kind") == kind_for_flow(F.col("flow_type")))
    held = live.select("merchant_id", "flow_type", F.col("category_id").alias("__id"), F.col("source").alias("__source"), F.col("confidence").alias("__sure"))
    out = rows.join(held, ["merchant_id", "flow_type"], "left")
    use = (F.col("__source") == "user_merchant") | ((F.col("__source") == "ai") & (F.col("category_source") == "fallback"))
    pick = lambda new, old: F.when(use, F.col(new)).otherwise(F.col(old)).alias(old)
    new = {"category_id": "__id", "category_source": "__source", "category_confidence": "__sure"}
    return out.select(*[pick(new[c], c) if c in new else F.col(c) for c in rows.columns])


def upsert_merchants(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Known merchants and, for new keys, a merchant with an id drawn from the key; known names stay. known: (merchant_id, canonical_name, normalized_key)."""
    new = rows.groupBy(F.col("merchant_key").alias("normalized_key")).agg(F.min("merchant_name").alias("canonical_name")).join(known.select("normalized_key"), "normalized_key", "left_anti")
    return known.unionByName(new.select(F.concat(F.lit("M-"), F.left(F.sha2("normalized_key", 256), F.lit(12))).alias("merchant_id"), "canonical_name", "normalized_key"))


def unresolved(txn: DataFrame, mappings: DataFrame, proposals: DataFrame, categories: DataFrame) -> DataFrame:
    """(merchant_id, merchant_key, flow_type, n, first_seen, last_seen) of postings by fallback without an active mapping and without a proposal."""
    given = F.col("given_flow") if "given_flow" in txn.columns else F.lit(None).cast("string")
    rows = txn.where("category_source = 'fallback' and merchant_id is not null").withColumn("flow_type", flow_unresolved(given, F.col("direction"), F.col("kind"), F.col("amount_native")))
    per = rows.groupBy("merchant_id", "merchant_key", "flow_type").agg(F.count("*").alias("n"), F.min("booked_date").alias("first_seen"), F.max("booked_date").alias("last_seen"))
    active = mappings.join(categories.where("not archived").select("category_id"), "category_id", "left_semi")
    return per.join(active.select("merchant_id", "flow_type"), ["merchant_id", "flow_type"], "left_anti").join(proposals.select("merchant_id", "flow_type"), ["merchant_id", "flow_type"], "left_anti")


class InvalidAssignments(ValueError):
    """The whole batch is refused."""


def apply_assignments(txn: DataFrame, mappings: DataFrame, proposals: DataFrame, categories: DataFrame, assignments: DataFrame, threshold: str = AUTO_APPLY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """assignments: (merchant_id, flow_type, category_id, proposed_name, proposed_kind, confidence). Returns postings, mappings and proposals.

    An existing category of at least the threshold becomes a mapping and replaces fallbacks; all else becomes a proposal, unless there is one or a mapping.
    One unknown category, or one of a kind that does not fit the flow, refuses the batch before anything is changed."""
    known = categories.where("not archived").select("category_id", F.col("kind").alias("__kind"))
    rows = assignments.join(known, "category_id", "left")
    bad = (F.col("category_id").isNotNull() & F.col("__kind").isNull()) | (F.coalesce("__kind", "proposed_kind") != kind_for_flow(F.col("flow_type")))
    if not rows.where(bad).isEmpty():
        raise InvalidAssignments("an assignment names an unknown category or one of another kind than its flow")
    keys = ["merchant_id", "flow_type"]
    rows = rows.join(mappings.select(*keys), keys, "left_anti")
    sure = F.col("__kind").isNotNull() & (F.col("confidence") >= F.lit(threshold).cast("decimal(5,4)"))
    fresh = rows.where(sure).select(*keys, "category_id", F.lit("ai").alias("source"), F.col("confidence").cast("decimal(5,4)").alias("confidence"))
    offered = rows.where(~sure).join(proposals.select(*keys), keys, "left_anti").select(*keys, "category_id", "proposed_name", "proposed_kind", F.col("confidence").cast("decimal(5,4)").alias("confidence"), F.lit("pending").alias("status"))
    return learned_category(txn, fresh, categories), mappings.unionByName(fresh.select(*mappings.columns)), proposals.unionByName(offered.select(*proposals.columns))


def review_proposals(txn: DataFrame, mappings: DataFrame, proposals: DataFrame, categories: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """decisions: (merchant_id, flow_type, accept). Returns postings, mappings, proposals and categories. An accepted proposal becomes a user's mapping (one that a user
    made before stays) and replaces what no user chose; a proposed new category is created under an id drawn from its name and kind."""
    keys = ["merchant_id", "flow_type"]
    judged = proposals.join(decisions, keys, "left")
    taken = judged.where("accept and status = 'pending'")
    new_id = F.concat(F.lit("C-"), F.left(F.sha2(F.concat_ws("\x1f", F.lower("proposed_name"), "proposed_kind"), 256), F.lit(12)))
    taken = taken.withColumn("category_id", F.coalesce("category_id", new_id))
    made = taken.where("proposed_name is not null").groupBy("category_id").agg(F.min("proposed_name").alias("name"), F.min("proposed_kind").alias("kind")).join(categories.select("category_id"), "category_id", "left_anti")
    all_categories = categories.unionByName(made.select("category_id", F.lit(None).cast("string").alias("parent_id"), "name", "kind", F.lit(False).alias("archived"), F.lit(False).alias("is_protected")).select(*categories.columns))
    own = mappings.where("source = 'user_merchant'").select(*keys)
    fresh = taken.join(own, keys, "left_anti").select(*keys, "category_id", F.lit("user_merchant").alias("source"), F.lit(1).cast("decimal(5,4)").alias("confidence"))
    kept = mappings.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*mappings.columns))
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise(F.col("status"))
    after = judged.withColumn("status", status).select(*proposals.columns)
    chosen = F.col("category_source").eqNullSafe("user_transaction")
    return learned_category(txn.where(~chosen), fresh, all_categories).unionByName(txn.where(chosen)), kept, after, all_categories


def override(txn: DataFrame, mappings: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """overrides: (transaction_id, category_id, whole_merchant), one a posting. The named postings take the category as a user's choice; with whole_merchant so do all postings
    of that merchant and flow that no user chose for themselves, and the mapping is kept. Returns postings and mappings."""
    keys = ["merchant_id", "flow_type"]
    named = overrides.select("transaction_id", F.col("category_id").alias("__own"))
    wide = overrides.where("whole_merchant").join(txn.select("transaction_id", *keys), "transaction_id").groupBy(*keys).agg(F.max_by("category_id", "transaction_id").alias("category_id"))
    rows = txn.join(named, "transaction_id", "left").join(wide.withColumnRenamed("category_id", "__wide"), keys, "left")
    broad = F.col("__wide").isNotNull() & (F.col("category_source") != "user_transaction")
    one = F.lit(1).cast("decimal(5,4)")
    new = {"category_id": F.coalesce("__own", F.when(broad, F.col("__wide")), "category_id"), "category_source": F.when(F.col("__own").isNotNull(), "user_transaction").when(broad, "user_merchant").otherwise(F.col("category_source")), "category_confidence": F.when(F.col("__own").isNotNull() | broad, one).otherwise(F.col("category_confidence"))}
    fresh = wide.select(*keys, "category_id", F.lit("user_merchant").alias("source"), one.alias("confidence"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in txn.columns]), mappings.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*mappings.columns))
