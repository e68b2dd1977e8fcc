"""Card exports of several sheets: which sheet holds the postings, columns that say the same, facts that have to agree.

An export is a folder of separated-value sheets. What it says of itself stands in several places: every mention is a fact, facts are
compared by aggregates that merge, and an export whose facts or columns contradict each other is refused whole, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..storage import stage
from . import statement_files as S

#: Names of columns by field, in order of preference; labels; the title that tells the period.
NAMES = {
    "booked": ("date", "transaction date", "booked date"),
    "description": ("description", "merchant", "details"),
    "amount": ("amount", "transaction amount", "amount cad"),
    "foreign": ("foreign spend amount", "foreign amount"),
    "fee": ("commission", "fx fee", "foreign exchange fee"),
    "reference": ("reference", "reference id", "ref"),
    "posted": ("posted date", "posting date", "date processed"),
}
DETAILS, SUMMARY, ACCOUNT, OPENING, CLOSING = "transaction details", "transaction summary", "account number", "last billed statement", "summary for this billed period"
_LONG_DAY = r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})"
PERIOD = rf"(?i)\bAmerican\s+Express\b.*?/\s*{_LONG_DAY}\s+to\s+{_LONG_DAY}"
FX_WORDS = ("foreign exchange", "fx fee", "currency conversion", "commission")


def read_sheets(spark: SparkSession, path: str, dealt: bool = False) -> DataFrame:
    """(file, sheet, row_no, cells, problem): path/<export>/<sheet>.csv."""
    rows = S.read_rows(spark, path if dealt else f"{path}/*/*.csv", parts=2, dealt=dealt)
    name = F.split("file", "/")
    return rows.select(name[0].alias("file"), F.regexp_replace(name[1], r"(?i)\.csv$", "").alias("sheet"), "row_no", "cells", "problem")


def _named(fields: tuple[str, ...]) -> Column:
    names = F.transform("cells", T.header)
    has = [F.arrays_overlap(names, F.array(*map(F.lit, NAMES[f]))) for f in fields]
    return has[0] & has[1] & has[2]


def detail_sheets(rows: DataFrame) -> DataFrame:
    """(file, sheet, header_row, reason): the sheet whose header names a date, a description and an amount; of several, the one titled so."""
    heads = rows.groupBy("file", "sheet").agg(F.min(F.when(_named(("booked", "description", "amount")), F.col("row_no"))).alias("header_row"))
    titled = F.col("header_row").isNotNull() & (T.header(F.col("sheet")) == DETAILS)
    which = F.struct("sheet", "header_row")
    per = heads.groupBy("file").agg(F.count("header_row").alias("n"), F.count_if(titled).alias("named"), F.min(F.when(titled, which)).alias("t"), F.min(F.when(F.col("header_row").isNotNull(), which)).alias("any"))
    chosen = F.when(F.col("named") == 1, F.col("t")).when(F.col("n") == 1, F.col("any"))
    reason = F.when(F.col("n") == 0, "no detail sheet").when(chosen.isNull(), "several detail sheets")
    return per.select("file", chosen["sheet"].alias("sheet"), chosen["header_row"].alias("header_row"), reason.alias("reason"))


def facts(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(file, field, value): every mention of a period, an account and the two balances, in a common form. sheets: detail_sheets()."""
    cell = rows.select("file", "sheet", "row_no", "cells", F.posexplode("cells").alias("at", "cell"))
    title = lambda i: F.date_format(T.day(F.regexp_replace(F.regexp_extract("cell", PERIOD, i), r"\s+", " "), F.lit(None)), "yyyy-MM-dd")
    period = cell.where(F.col("cell").rlike(PERIOD)).select("file", F.explode(F.map_from_arrays(F.array(F.lit("period start"), F.lit("period end")), F.array(title(1), title(2)))).alias("field", "value"))
    filled = rows.where(F.exists("cells", lambda c: F.trim(c) != ""))
    filled = filled.withColumn("below", F.lead("cells").over(Window.partitionBy("file", "sheet").orderBy("row_no")))
    label = filled.select("file", "cells", "below", F.explode(F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: T.header(F.get("cells", i)) == ACCOUNT)).alias("at"))
    beside = F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells") - F.col("at") - 1, F.lit(0)))
    asked = F.when(F.exists(beside, lambda c: F.trim(c) != ""), beside).otherwise(F.coalesce("below", F.array().cast("array<string>")))
    refs = label.select("file", F.explode(asked).alias("cell")).select("file", F.lit("account").alias("field"), reference(F.col("cell")).alias("value")).where("value is not null")
    after = F.get(F.filter(F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells") - F.col("at") - 1, F.lit(0))), lambda c: F.trim(c) != ""), F.lit(0))
    which = F.when(T.header(F.col("cell")) == OPENING, "opening balance").when(T.header(F.col("cell")) == CLOSING, "closing balance")
    sums = cell.where(T.header(F.col("sheet")) == SUMMARY).withColumn("field", which).where("field is not null").select("file", "field", T.decimal(after).cast("decimal(18,2)").cast("string").alias("value"))
    top = rows.join(sheets.where("reason is null").select("file", "sheet", "header_row"), ["file", "sheet"])
    said = S.preambles(top.drop("header_row"), sheets.select("file", "header_row"))
    days = [F.date_format(T.day(F.get("period_days", F.lit(i)), F.lit(None)), "yyyy-MM-dd") for i in (0, 1)]
    said = said.select("file", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("period start", "period end", "opening balance", "closing balance"))), F.array(*days, *[F.col(c).cast("decimal(18,2)").cast("string") for c in ("opening", "closing")]))).alias("field", "value"))
    out = period.unionByName(refs).unionByName(sums).unionByName(said)
    return out.where("value is not null")


def reference(cell: Column) -> Column:
    """The digits that end an account's number: up to six of a masked one, else the last four; null if there are fewer than four."""
    digits = F.regexp_extract(F.trim(cell), r"(\d{4,6})$", 1)
    return F.when(digits != "", F.when(cell.rlike("[xX*•]"), digits).otherwise(F.right(digits, F.lit(4))))


def agreed(found: DataFrame) -> DataFrame:
    """(file, field, value, conflict) of facts (file, field, value). Values of a field have to be equal; of account references the longest counts, and
    the others have to equal it or be the four digits that it ends with. One aggregate that merges: least and greatest value by length."""
    size = F.length("value")
    by = {n: (F.min(F.when(size == n, F.col("value"))).alias(f"min{n}"), F.max(F.when(size == n, F.col("value"))).alias(f"max{n}")) for n in (4, 5, 6)}
    per = found.groupBy("file", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.struct(size.alias("size"), "value"))["value"].alias("longest"), *[c for pair in by.values() for c in pair])
    apart = F.lit(False)
    for n in (4, 5, 6):
        whole = F.when(F.length("longest") == n, F.col("longest")).when(F.lit(n) == 4, F.right("longest", F.lit(4)))
        apart |= F.coalesce(F.col(f"min{n}") != F.coalesce(whole, F.lit("")), F.lit(False)) | F.coalesce(F.col(f"max{n}") != F.coalesce(whole, F.lit("")), F.lit(False))
    account = F.col("field") == "account"
    return per.select("file", "field", F.when(account, F.col("longest")).otherwise(F.col("lo")).alias("value"), F.when(account, apart).otherwise(F.col("lo") != F.col("hi")).alias("conflict"))


def columns(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(file, fields: field to position, same: positions of the description's columns by preference, reason). Of other fields no two columns may have a name."""
    known = F.create_map(*[F.lit(x) for field, names in NAMES.items() for rank, name in enumerate(names) for x in (name, f"{field} {rank}")])
    named = rows.join(sheets.where("reason is null").select("file", "sheet", F.col("header_row").alias("row_no")), ["file", "sheet", "row_no"]).select("file", F.posexplode(F.transform("cells", T.header)).alias("at", "name"))
    named = named.withColumn("means", F.split(F.try_element_at(known, F.col("name")), " ")).where("means is not null").select("file", F.col("means")[0].alias("field"), F.col("means")[1].cast("int").alias("rank"), "at")
    per = named.groupBy("file", "field").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "at"))).alias("places"))
    out = per.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("places")[0]["at"]))).alias("fields"), F.max(F.when(F.col("field") == "description", F.transform("places", lambda p: p["at"]))).alias("same"), F.min(F.when((F.col("n") > 1) & (F.col("field") != "description"), F.concat(F.lit("ambiguous "), "field"))).alias("reason"))
    return out


def equivalent(body: DataFrame) -> DataFrame:
    """(file, apart): whether the columns at the positions same differ in any row (white space and case aside). body: rows (file, cells, same)."""
    said = F.transform("same", lambda at: F.lower(F.trim(F.regexp_replace(F.coalesce(F.get("cells", at), F.lit("")), r"\s+", " "))))
    return body.groupBy("file").agg(F.bool_or(F.size(F.array_distinct(said)) > 1).alias("apart"))


def parse(rows: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kinds: (file, kind). Returns postings, statements (a row an accepted export) and refused exports with the first reason."""
    sheets = stage(detail_sheets(rows), "detail-sheets")
    cols = stage(columns(rows, sheets), "columns")
    told = stage(agreed(facts(rows, sheets)), "facts")
    body = rows.join(sheets.where("reason is null").select("file", "sheet", "header_row"), ["file", "sheet"]).where(F.col("row_no") > F.col("header_row")).join(cols.where("reason is null").drop("reason"), "file")
    cell = lambda f: T.filled(F.get("cells", F.try_element_at("fields", F.lit(f)))).alias(f)
    held = stage(body.select("file", "row_no", "cells", "same", *[cell(f) for f in NAMES]).where("booked is not null"), "details")
    nothing = held.select("file", F.array().cast("array<string>").alias("period_days")).distinct()
    orders = stage(S.slash_orders(held, nothing), "slash-orders")
    lines = held.join(orders, "file", "left")
    spent, amount, fee = T.foreign_spend(F.col("foreign")), T.decimal(F.col("amount")), F.abs(T.decimal(F.col("fee")))
    booked, posted = (T.day(F.col(c), F.col("slash_order")) for c in ("booked", "posted"))
    way = T.direction(F.col("description"), amount)
    alone = (way == "fee") & T.header(F.col("description")).rlike("|".join(FX_WORDS))
    error = F.coalesce(
        F.when(F.col("description").isNull(), "blank description"),
        T.money_error(amount, "amount", F.lit("given")),
        F.when(F.col("foreign").isNotNull() & spent["amount"].isNull(), "invalid foreign spend"),
        T.money_error(spent["amount"], "foreign spend", F.lit(None)),
        T.money_error(fee, "fee", F.col("fee")),
        F.when(booked.isNull() | (F.col("posted").isNotNull() & posted.isNull()), "invalid date"),
    )
    money = lambda c: c.cast("decimal(14,2)")
    lines = stage(lines.select("file", "row_no", "slash_reason", error.alias("error"), booked.alias("booked_date"), posted.alias("posted_date"), F.trim("description").alias("description_raw"), money(amount).alias("amount_native"), money(F.when(amount < 0, -spent["amount"]).otherwise(spent["amount"])).alias("original_amount"), spent["currency"].alias("original_currency"), money(F.when(~alone, fee)).alias("fx_fee_amount_native"), alone.alias("is_fx_fee"), F.trim("reference").alias("external_ref"), way.alias("direction")), "lines")
    per = lines.groupBy("file").agg(F.min("slash_reason").alias("slash_reason"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_no"))).alias("error"), F.min("booked_date").alias("lo"), F.max("booked_date").alias("hi"))
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("value")))
    said = told.groupBy("file").agg(F.min(F.when(F.col("conflict"), F.concat(F.lit("conflicting "), "field"))).alias("clash"), *[value(f).alias(f.replace(" ", "_")) for f in ("period start", "period end", "opening balance", "closing balance", "account")])
    broken = rows.groupBy("file").agg(F.min("problem").alias("problem"))
    files = broken.join(kinds, "file", "left").join(sheets.select("file", F.col("reason").alias("no_sheet")), "file", "left").join(cols.select("file", F.col("reason").alias("twice")), "file", "left").join(equivalent(held), "file", "left").join(said, "file", "left").join(per, "file", "left")
    why = F.coalesce("problem", F.when(F.col("kind").isNull(), "no account"), F.when(F.col("kind") != "credit_card", "not a card account"), "no_sheet", "twice", F.when(F.col("apart"), "conflicting description columns"), "slash_reason", "clash", "error", F.when(F.col("lo").isNull(), "no transaction rows"))
    files = files.withColumn("why", why)
    good = files.where("why is null").select("file", F.coalesce(F.to_date("period_start"), "lo").alias("period_start"), F.coalesce(F.to_date("period_end"), "hi").alias("period_end"), *[money(F.col(c)).alias(c) for c in ("opening_balance", "closing_balance")], F.concat(F.lit("••••"), "account").alias("account_ref_masked"))
    return lines.drop("slash_reason", "error").join(good.select("file"), "file", "left_semi"), good, files.where("why is not null").select("file", F.col("why").alias("reason"))
