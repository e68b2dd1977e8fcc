"""Mixed folders, layouts, and exports whose parts have to agree."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from centavo.functions import text as T
from centavo.sources import exports, intake, statement_files

CARD = "Date,Description,Debit,Credit\n2026-01-03,Alpha Shop,25.00,\n2026-01-15,Beta Shop,,15.00\n"
OFX = "OFXHEADER:100\n\n<OFX><CCSTMTRS><CURDEF>CAD<ACCTID>12345678<DTSTART>20260101<DTEND>20260131<STMTTRN><TRNTYPE>OTHER<DTPOSTED>20260105<TRNAMT>-9.50<FITID>f1<NAME>Gamma</STMTTRN><BALAMT>-9.50</CCSTMTRS></OFX>"
LAYOUT = "When;Posted;What;Out;In;Money;Abroad;Abroad money;Fee;Own fee;Ref\n"


def write(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def layouts(spark):
    names = F.array(*[F.lit(x) for x in ("when", "posted", "what", "out", "in", "money", "abroad", "abroad money", "fee", "own fee", "ref")])
    fields = F.create_map(*[x for i, f in enumerate(("booked", "posted", "description", "debit", "credit", "currency", "original_amount", "original_currency", "fx_fee", "is_fx_fee", "reference")) for x in (F.lit(f), F.lit(i))])
    return spark.range(1).select(statement_files.fingerprint(names, "csv", F.lit("credit_card"), F.lit("CAD")).alias("fingerprint"), F.lit(1).alias("version"), fields.alias("fields"))


def accounts(spark, names, kind="credit_card"):
    return spark.createDataFrame([(n, kind, "CAD") for n in names], "file string, kind string, currency string")


def test_every_file_comes_out_once(spark, tmp_path, layouts):
    files = {
        "card.csv": CARD,
        "both.csv": "Date,Description,Debit,Credit\n2026-01-03,x,1.00,1.00\n",
        "bare.csv": "some,thing\n1,2\n",
        "latin.csv": "Date,Description,Amount\n2026-01-03,caf\xe9,1.00\n".encode("latin-1"),
        "empty.csv": "",
        "stored.txt": LAYOUT + "2026-01-03;2026-01-04;Delta;1.234,50;;CAD;10,00;usd;0,25;no;r1\n2026-01-05;;Epsilon;;2,00;;;;;;\n",
        "stored.csv": LAYOUT + "2026-01-05;;Zeta;5,10;;CAD;;;;;r2\n",
        "wrong.txt": LAYOUT + "2026-01-05;;Zeta;5,10;7,00;CAD;;;;;r2\n",
        "other.txt": "a;b;c\n1;2;3\n",
        "good.ofx": OFX,
        "rootless.qfx": "<STMTTRN>",
        "scan.pdf": b"%PDF-1.4 \xff",
        "orphan.csv": CARD,
        "upper.CSV": CARD,
    }
    write(tmp_path, files)
    postings, told = intake.intake(spark, str(tmp_path), accounts(spark, [n for n in files if n != "orphan.csv"]), layouts)
    got = {r["file"]: (r["reader"], r["score"], r["outcome"], r["reason"]) for r in told.collect()}
    assert got == {
        "card.csv": ("separated", 0.88, "accepted", None),
        "upper.CSV": ("separated", 0.88, "accepted", None),
        "both.csv": ("separated", 0.88, "refused", "debit and credit on a row"),
        "bare.csv": (None, 0.15, "unsupported", "no reader recognises it"),
        "latin.csv": (None, 0.0, "unsupported", "not UTF-8"),
        "empty.csv": (None, 0.0, "unsupported", "empty file"),
        "stored.txt": ("layout", 0.6, "accepted", None),
        "stored.csv": ("layout", 0.6, "accepted", None),
        "wrong.txt": ("layout", 0.6, "refused", "debit and credit on a row"),
        "other.txt": (None, 0.0, "unsupported", "no reader recognises it"),
        "good.ofx": ("ofx", 0.99, "accepted", None),
        "rootless.qfx": (None, 0.2, "unsupported", "no reader recognises it"),
        "scan.pdf": (None, 0.0, "unsupported", "no reader recognises it"),
        "orphan.csv": (None, 0.88, "unsupported", "no account"),
    }
    rows = {(r["file"], r["description_raw"]): r for r in postings.collect()}
    assert len(rows) == 2 * 2 + 2 + 1 + 1
    r = rows[("stored.txt", "Delta")]
    assert (r["booked_date"], r["posted_date"], r["amount_native"], r["original_amount"], r["original_currency"], r["fx_fee_amount_native"], r["is_fx_fee"], r["external_ref"]) == (date(2026, 1, 3), date(2026, 1, 4), D("1234.50"), D("10.00"), "USD", D("0.25"), False, "r1")
    assert rows[("good.ofx", "Gamma")]["amount_native"] == D("9.50")


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("2026-01-03;;x;;;CAD;;;;;", "no amount"),
        ("2026-01-03;;x;-1,00;;CAD;;;;;", "signed debit or credit"),
        ("2026-01-03;;;1,00;;CAD;;;;;", "blank description"),
        ("2026-01-03;;x;1,00;;USD;;;;;", "currency differs from the account's"),
        ("2026-01-03;;x;1,00;;CAD;5,00;;;;", "half of an original amount"),
        ("2026-01-03;;x;1,00;;CAD;5,00;USD;;yes;", "fee with an original amount"),
        ("2026-01-03;;x;1,00;;CAD;;;;maybe;", "unclear flag"),
        ("2026-01-03;soon;x;1,00;;CAD;;;;;", "invalid date"),
        ("01/02/2026;;x;1,00;;CAD;;;;;", "unresolved slash dates"),
        ("2026-01-03;;x;1.00;2,00;CAD;;;;;", "ambiguous decimal separator"),
        (";;x;1,00;;CAD;;;;;", "no transaction rows"),
    ],
)
def test_layout_rows_that_refuse_a_file(spark, tmp_path, layouts, line, reason):
    write(tmp_path, {"a.txt": LAYOUT + line + "\n"})
    rows, refused = statement_files.parse_with_layout(statement_files.read_rows(spark, str(tmp_path)), layouts, accounts(spark, ["a.txt"]))
    assert [(r["file"], r["reason"]) for r in refused.collect()] == [("a.txt", reason)] and rows.count() == 0


def test_unreadable_files_are_refused(spark, tmp_path):
    write(tmp_path, {"a.csv": CARD, "b.csv": b"\xff\xfe\x00", "c.csv": "", "d.csv": CARD})
    rows, good, refused = statement_files.parse(statement_files.read_rows(spark, str(tmp_path)), accounts(spark, ["a.csv", "b.csv", "c.csv"]).drop("currency"))
    assert {r["file"]: r["reason"] for r in refused.collect()} == {"b.csv": "not UTF-8", "c.csv": "empty file", "d.csv": "no account"}
    assert [r["file"] for r in good.collect()] == ["a.csv"] and rows.count() == 2


def test_foreign_spend(spark):
    cells = {"USD 12.34": (D("12.34"), "USD"), "usd $1,234.5": (D("1234.5"), "USD"), "12.34 EUR": (D("12.34"), "EUR"), "$ 7 TZS": (D("7"), "TZS"), "US$ 12.34": (D("12.34"), "USD"), "ca$3": (D("3"), "CAD"), "AU$ 4.00": (D("4"), "AU"), "12.34": (None, None), "USD": (None, None), "-5 USD": (None, None), "": (None, None), None: (None, None)}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", T.foreign_spend(F.col("c")).alias("s")).collect()
    assert {r["c"]: (r["s"]["amount"], r["s"]["currency"]) for r in got} == cells


TOP = "American Express Card / 1 Jan 2026 to 31 Jan 2026\nAccount Number,XXXX-XXXXXX-{}\n"
SUMMARY = "Last billed statement,,100.00\nSummary for this billed period,110.00\n"
BODY = "Date,Description,{}Amount,Foreign Spend Amount,Commission,Reference\n"


def export(name, ref="51007", summary=SUMMARY, top="", body="", extra="", lines=("2026-01-03,Alpha,25.00,USD 20.00,0.50,r1",)):
    return {f"{name}/Cover.csv": TOP.format(ref), f"{name}/Transaction Summary.csv": summary, f"{name}/Transaction Details.csv": top + (body or BODY.format(extra)) + "\n".join(lines) + "\n"}


def read(spark, tmp_path, files, kind="credit_card"):
    write(tmp_path, files)
    names = {n.split("/")[0] for n in files}
    rows, good, refused = exports.parse(exports.read_sheets(spark, str(tmp_path)), accounts(spark, names, kind).drop("currency"))
    return rows.collect(), {r["file"]: r for r in good.collect()}, {r["file"]: r["reason"] for r in refused.collect()}


def test_facts_of_an_export_agree(spark, tmp_path):
    files = export("one") | export("suffix", top="Account Number\n\nxxxx 1007\n") | export("plain", ref="123451007", top="Account Number,,99991007\n")
    files |= export("refs", top="Account Number,XXXX-9999\n") | export("five", ref="651007", top="Account Number,x51007\n")
    files |= export("closing", summary=SUMMARY + "Summary for this billed period,110.01\n") | export("same", summary=SUMMARY + "Summary for this billed period,$110\n")
    files |= export("period", top="American Express Card / 1 Jan 2026 to 30 Jan 2026\n") | export("balance", top="Opening Balance,CAD 99.00\n")
    rows, good, refused = read(spark, tmp_path, files)
    assert refused == {"refs": "conflicting account", "five": "conflicting account", "closing": "conflicting closing balance", "period": "conflicting period end", "balance": "conflicting opening balance"}
    assert {n: r["account_ref_masked"] for n, r in good.items()} == {"one": "••••51007", "suffix": "••••51007", "plain": "••••451007", "same": "••••51007"}
    r = good["one"]
    assert (r["period_start"], r["period_end"], r["opening_balance"], r["closing_balance"]) == (date(2026, 1, 1), date(2026, 1, 31), D("100.00"), D("110.00"))
    (r,) = [r for r in rows if r["file"] == "one"]
    assert (r["amount_native"], r["original_amount"], r["original_currency"], r["fx_fee_amount_native"], r["external_ref"], r["direction"]) == (D("25.00"), D("20.00"), "USD", D("0.50"), "r1", "debit")


def test_columns_that_say_the_same(spark, tmp_path):
    same = ("2026-01-03,Alpha  Shop, alpha shop ,25.00,,,", ",gone,astray,,,,", "2026-01-04,Beta,BETA,-5.00,CA$ 4.00,,")
    files = export("same", extra="Merchant,", lines=same) | export("apart", extra="Merchant,", lines=(*same, "2026-01-05,Gamma,Delta,1.00,,,"))
    files |= export("order", body="Details,Date,Merchant,Amount\n", lines=("alpha,2026-01-03,Alpha,1.00",)) | export("twice", body="Date,Description,Amount,Amount CAD\n", lines=("2026-01-03,x,1.00,1.00",))
    rows, good, refused = read(spark, tmp_path, files)
    assert refused == {"apart": "conflicting description columns", "twice": "ambiguous amount"} and set(good) == {"same", "order"}
    assert sorted((r["file"], r["description_raw"], r["original_amount"]) for r in rows if r["original_amount"]) == [("same", "Beta", D("-4.00"))]
    assert {r["description_raw"] for r in rows} == {"Alpha  Shop", "Beta", "Alpha"}


def test_which_sheet_and_what_is_refused(spark, tmp_path):
    files = {"none/a.csv": "x,y\n"} | {"two/a.csv": BODY.format("") + "2026-01-03,x,1.00,,,\n", "two/b.csv": BODY.format("") + "2026-01-03,x,1.00,,,\n"}
    files |= {"bytes/a.csv": b"\xff\xff"} | export("foreign", lines=("2026-01-03,x,1.00,twelve,,",)) | export("places", lines=("2026-01-03,x,1.005,,,",)) | export("empty", lines=(",x,1.00,,,",))
    files |= {"only/anything.csv": BODY.format("") + "2026-01-03,currency conversion fee,1.00,,1.00,\n"}
    rows, good, refused = read(spark, tmp_path, files)
    assert refused == {"none": "no detail sheet", "two": "several detail sheets", "bytes": "not UTF-8", "foreign": "invalid foreign spend", "places": "amount with more than two decimal places", "empty": "no transaction rows"}
    assert [(r["file"], r["is_fx_fee"], r["fx_fee_amount_native"], r["direction"]) for r in rows] == [("only", True, None, "fee")]
    _, _, refused = read(spark, tmp_path, {"only/anything.csv": BODY.format("")}, "chequing")
    assert refused["only"] == "not a card account"
