"""Texts, amounts, dates and statement lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import normalize as N
from ledgerloom.operators import parse as P
from ledgerloom.sources import tables as S

DATE = datetime.date


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "number"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", 1234.0), ("-12,50", -12.5), ("+3,10", 3.1), ("12.50", 12.5), ("", None), ("abc", None), ("1.234.56", None)])
def test_money_number(spark, text, number):
    assert one(spark, text, T.money_number) == number


def test_money_values(spark):
    found = one(spark, "KAFE 12,50 TL ve USD 3.20 x 5", T.find_money)
    assert [(m["amount"], m["currency"]) for m in found] == [(12.5, "TRY"), (3.2, "USD")]
    # a dotted date has the form of an amount
    assert [m["amount"] for m in one(spark, "05.01.2025 MIGROS", T.find_money)][0] == 5.01


@pytest.mark.parametrize(("text", "strict", "compat"), [
    ("2025-01-05 X", DATE(2025, 1, 5), DATE(2005, 1, 25)), ("05.01.2025", DATE(2025, 1, 5), DATE(2025, 1, 5)), ("31.02.2025", None, None), ("5 Ocak 2025", DATE(2025, 1, 5), DATE(2025, 1, 5)), ("1/2/24", DATE(2024, 2, 1), DATE(2024, 2, 1)), ("", None, None),
])
def test_dates_in_both_modes(spark, text, strict, compat):
    for mode, want in (("strict", strict), ("compat", compat)):
        found = one(spark, text, lambda c, mode=mode: T.find_date(c, mode))
        assert (found and found["date"]) == want, mode


@pytest.mark.parametrize(("text", "current", "total", "sum_"), [("3. Taksit", 3, None, None), ("(2/6)", 2, 6, None), ("100,00 x 6 = 600,00", None, 6, 600.0), ("none", None, None, None)])
def test_installments(spark, text, current, total, sum_):
    found = one(spark, text, T.find_installment)
    assert (found["current"], found["total"], found["total_amount"]) == (current, total, sum_)


def test_direction_noise_and_currency(spark):
    assert one(spark, "IADE ALINDI", T.direction) == "credit"
    assert one(spark, "MARKET", T.direction) == "debit"
    assert one(spark, "Kart Limiti 5.000,00", T.is_noise) is True
    assert one(spark, "OUTLET", T.without_currencies) == "OU ET"
    assert one(spark, "tl", T.currency) == "TRY"
    assert one(spark, "nope", T.currency) is None


def test_merchants(spark):
    assert one(spark, "TRENDYOL.COM 123456", T.merchant_name) == "TRENDYOL"
    assert one(spark, "shop 1234567 - x", T.merchant_name) == "SHOP -X" or one(spark, "shop 1234567", T.merchant_name) == "SHOP"
    assert one(spark, "POS 123 KART", T.merchant_text) == "pos 123 kart"


def test_candidates_merge_until_an_amount_appears(spark):
    lines = spark.createDataFrame([("d", 1, 1, "05/01/2025 MIGROS"), ("d", 2, 1, "SUBE"), ("d", 3, 1, "12,50 TL"), ("d", 4, 2, "06/01/2025 A"), ("d", 5, 3, "9,00"), ("d", 6, 3, "9,00")], "input_id string, line_no int, page int, text string")
    found = {(r["line_no"], r["merged"]): r["text"] for r in P.candidates(lines).collect()}
    assert found == {(1, 0): "05/01/2025 MIGROS", (1, 1): "05/01/2025 MIGROS SUBE", (1, 2): "05/01/2025 MIGROS SUBE 12,50 TL", (2, 0): "SUBE", (3, 0): "12,50 TL", (4, 0): "06/01/2025 A", (5, 0): "9,00"}


def test_amounts_of_several_currencies(spark):
    lines = spark.createDataFrame([("d", 1, 1, "05/01/2025 AMAZON USD 3,20 100,00 TL"), ("d", 2, 1, "06/01/2025 BAKKAL 5,00 TL")], "input_id string, line_no int, page int, text string")
    found, _ = P.extract(lines)
    r = found.where("line_no = 1").first()
    assert (r["price"], r["currency"], r["original_price"], r["original_currency"]) == (100.0, "TRY", 3.2, "USD")


def test_rejects_keep_a_reason(spark):
    lines = spark.createDataFrame([("d", 1, 1, "kart limiti 05/01/2025 1,00"), ("d", 2, 1, "no date 1,00"), ("d", 3, 1, "05/01/2025 x")], "input_id string, line_no int, page int, text string")
    _, bad = P.extract(lines)
    assert {(r["line_no"], r["reject_reason"]) for r in bad.where("text not like '%x %'").collect()} >= {(1, "noise"), (2, "no_date"), (3, "no_amount")}


def test_words_to_lines_moves_the_centre(spark):
    words = spark.createDataFrame([("d", 1, "v", 6, "a", 0, 0, 10, 10, 90.0), ("d", 1, "v", 6, "b", 20, 4, 10, 10, 80.0), ("d", 1, "v", 6, "c", 0, 40, 10, 10, 70.0), ("d", 1, "v", 6, " ", 0, 0, 1, 1, 99.0), ("d", 1, "v", 6, "x", 0, 0, 1, 1, -1.0)], "input_id string, page int, variant string, psm int, text string, left int, top int, width int, height int, conf double")
    assert [(r["text"], r["word_count"], r["ocr_confidence"]) for r in P.words_to_lines(P.ocr_words(words)).orderBy("line_no").collect()] == [("a b", 2, 0.85), ("c", 1, 0.7)]


def test_normalised_nulls_and_duplicates(spark):
    rows = spark.createDataFrame([("d", 1, "2025-01-05", "MIGROS", 10.0, "TL", "debit", 0.5), ("d", 2, "2025-01-05", "MIGROS", 10.0, "TRY", "debit", 0.9), ("d", 3, None, None, None, None, None, None)], "input_id string, seq int, date string, description string, amount double, currency string, direction string, confidence double")
    n = N.normalized(rows)
    kept = {r["seq"]: r for r in N.keep_best(n).collect()}
    assert set(kept) == {2, 3}
    assert (kept[3]["currency"], float(kept[3]["amount"]), kept[3]["validation_status"]) == ("UNKNOWN", 0.0, "invalid")
    again = N.keep_best(N.keep_best(n))
    assert again.count() == 2
    assert n.where("seq = 1").first()["transaction_id"] == n.where("seq = 2").first()["transaction_id"]


def test_mime(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.7"),), (bytearray(b"\x00\x00\x00\x18ftypheic"),), (bytearray(b"zz"),)], "c binary")
    assert [r[0] for r in rows.select(S.mime(F.col("c"))).collect()] == ["application/pdf", "image/heic", "application/octet-stream"]


@pytest.mark.parametrize("text,number", [("+-5", -5.0), ("-+5", -5.0), ("--5", None), ("1.234.567", 1234567.0), ("1,2,3", None), ("12.34\n", 1234.0), ("1,234.50", 1234.5), ("1.234,50", 1234.5), (".5", 5.0), ("", None), (None, None)])
def test_money_number_signs_and_marks(spark, text, number):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(T.money_number(F.col("t"))).first()[0] == number


def test_expressions_stay_small(spark):
    """What an expression names several times is worked out once: its text is not repeated over and over."""
    row = spark.createDataFrame([("05/01/2024 MIGROS 12,50 TL",)], "t string")
    for made, most in ((T.money_number, 6), (T.find_date, 3)):
        plan = row.select(made(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert len(plan.split("regexp_")) - 1 + len(plan.split("RLIKE")) - 1 <= most, plan


def test_currencies_in_any_case_as_with_flags(spark):
    folded = f"(?iu){T.joined_pattern(T.currency_tokens())}"
    texts = [x for w in T.currency_tokens() for x in (w, w.lower(), w.upper(), w.title(), f"a{w}b 1,00", w.replace("I", "ı"), w.replace("I", "İ"), w.replace("S", "ſ"), w.replace("K", "\u212a"))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert "(?iu)" not in T.currency_pattern()
    assert rows.select(F.regexp_replace("t", folded, "#").alias("a"), F.regexp_replace("t", T.currency_pattern(), "#").alias("b")).where("a != b").collect() == []
