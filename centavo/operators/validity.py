"""Checks over several tables: valuations, references, printed balances, categories, and changes of what may not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .costs import broken

VALUATION = {
    "identity": "currency_native = currency_base and (fx_rate is distinct from 1 or amount_base is distinct from amount_native or fx_rate_date is distinct from booked_date)",
    "partial": "currency_native != currency_base and (isnull(fx_rate) != isnull(amount_base) or isnull(fx_rate) != isnull(fx_rate_date))",
    "product": "currency_native != currency_base and amount_base != round(amount_native * fx_rate, 2)",
    "rate_date": "currency_native != currency_base and fx_rate_date not between date_sub(booked_date, 7) and booked_date",
    "rate_sign": "fx_rate <= 0",
}


def valuations(rows: DataFrame) -> DataFrame:
    """A row for each rule of valuation that a posting breaks."""
    return rows.select("transaction_id", F.explode(broken(VALUATION)).alias("violation"))


def references(txn: DataFrame, statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """(table, id, violation): postings against their account and statement, statements against their account."""
    held = accounts.select("account_id", F.col("native_currency").alias("__own"))
    printed = statements.select("statement_id", F.col("account_id").alias("__account"), F.col("currency").alias("__currency"))
    rows = txn.join(held, "account_id", "left").join(printed, "statement_id", "left")
    rules = {"unknown_account": "__own is null", "account_currency": "currency_native != __own", "statement_account": "account_id != __account", "statement_currency": "currency_native != __currency"}
    first = rows.select(F.lit("txn").alias("table"), F.col("transaction_id").alias("id"), F.explode(broken(rules)).alias("violation"))
    own = statements.join(held, "account_id", "left").select(F.lit("statement").alias("table"), F.col("statement_id").alias("id"), F.explode(broken({"unknown_account": "__own is null", "account_currency": "currency != __own"})).alias("violation"))
    return first.unionByName(own)


def printed_balances(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """lines: (statement_id, line_no, amount, running). A row for each line whose printed balance is not the one before plus its amount, the first from the
    opening balance, and for each statement whose last line is not its closing balance. A statement's lines are ordered in one task, as a statement is."""
    w = Window.partitionBy("statement_id").orderBy("line_no")
    opened = statements.select("statement_id", "opening_balance", "closing_balance")
    rows = lines.withColumn("before", F.lag("running").over(w)).withColumn("last", F.lead("line_no").over(w).isNull()).join(opened, "statement_id")
    rules = {"first_line": "isnull(before) and opening_balance + amount != running", "step": "before + amount != running", "closing": "last and running != closing_balance"}
    return rows.select("statement_id", "line_no", F.explode(broken(rules)).alias("violation"))


def category_changes(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    """old, new: (category_id, parent_id, name, kind, archived, is_protected); used: category ids that postings refer to. A row for each rule a new state breaks."""
    before = old.select("category_id", *[F.col(c).alias(f"__{c}") for c in old.columns if c != "category_id"])
    parent = new.select(F.col("category_id").alias("parent_id"), F.col("kind").alias("__parent_kind"), F.col("archived").alias("__parent_archived"))
    twins = new.groupBy(F.col("parent_id"), "kind", F.lower("name").alias("__lower")).agg(F.count("*").alias("__twins"))
    rows = new.join(before, "category_id", "full").join(parent, "parent_id", "left").join(used.select("category_id", F.lit(True).alias("__used")).distinct(), "category_id", "left")
    rows = rows.withColumn("__lower", F.lower("name"))
    same = [rows["parent_id"].eqNullSafe(twins["parent_id"]), rows["kind"] == twins["kind"], rows["__lower"] == twins["__lower"]]
    rows = rows.join(twins, same[0] & same[1] & same[2], "left").select(*[rows[c] for c in rows.columns], twins["__twins"])
    rules = {
        "self_parent": "parent_id = category_id",
        "parent_missing": "isnotnull(parent_id) and isnull(__parent_kind)",
        "parent_archived": "__parent_archived",
        "parent_kind": "kind != __parent_kind",
        "protected": "__is_protected and (name is distinct from __name or kind is distinct from __kind or parent_id is distinct from __parent_id or archived is distinct from __archived)",
        "kind_in_use": "__used and kind != __kind",
        "sibling_name": "__twins > 1",
    }
    return rows.select("category_id", F.explode(broken(rules)).alias("violation"))


def identity_changes(old: DataFrame, new: DataFrame, txn: DataFrame, statements: DataFrame) -> DataFrame:
    """Accounts with postings or statements whose kind or currency differs between two states."""
    changed = old.select("account_id", F.col("kind").alias("old_kind"), F.col("native_currency").alias("old_currency")).join(new.select("account_id", "kind", "native_currency"), "account_id").where("kind != old_kind or native_currency != old_currency")
    with_data = txn.select("account_id").unionByName(statements.select("account_id"))
    return changed.join(with_data, "account_id", "left_semi")
