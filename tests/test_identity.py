"""Identities of postings whose descriptions are not ASCII."""

import hashlib

from pyspark.sql import functions as F

from centavo.functions.money import dedup_hash

GOLDEN = {
    "ＣＡＦＥ　１２": "cafe 12",
    "ﬁne  oﬃce": "fine office",
    "Straße\u00a0 7": "strasse 7",
    "\u2003ÉTÉ\u2028a\u0301\t": "été á",
    "a\x1cb\x85c": "a b c",
    "Purchase  Ref 1 ": "purchase ref 1",
    "\x00 x": "\x00 x",
    "": "",
}


def test_identity_folds_width_ligatures_case_and_spaces(spark):
    df = spark.createDataFrame([(k, " \u00a0r1\x1c\n") for k in GOLDEN], "d string, r string")
    out = df.select("d", dedup_hash(F.lit("A1"), F.lit("2024-01-02").cast("date"), F.lit("7.50").cast("decimal(14,2)"), F.lit("cad"), F.col("d"), F.col("r")).alias("h")).collect()
    want = {k: hashlib.sha256("\x1f".join(("A1", "2024-01-02", "7.50", "CAD", v, "r1")).encode()).hexdigest() for k, v in GOLDEN.items()}
    assert {r["d"]: r["h"] for r in out} == want
