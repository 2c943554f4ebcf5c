"""Steps in plain columns give what the expressions over any text give, and parsing doesn't repeat its work."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions import text as T
from ledgerloom.operators import parse as P
from ledgerloom.operators import results as L

DATES = ["", None, "x", "31/02/2024 x 2024-03-05", "5 Ocak 2024", "5 OCAK 2024 x 01/02/2024", "5 ocak 24", "1/1/00", "29.02.2023", "29.02.2024", "0099-01-01", "0000-01-01", "01/02/95 3.4.1999", "32 Mart 2024 01.02.2024", "00/00/0000", "2024-1-5", "2025-01-05", "1.1.195", "123/01/2024 4-5-06"]
MONEY = ["", None, "x", "TL 12,50", "$-5.00", "US$ 1.234,56 EUR", "1,234.56TL 3,00", "AB-12,00", "12,5", "+7.77", "TL -1.000,00 USD", "5.01.1995", "- 12,34", "TL12,345", "x TL 3,10", "usd 3,00try", "1.234.567,89 €", "a1,00b2,00", "CHF\t 9.99", "ıdr 4,00", "01/02/2024 MIGROS (1/6) 12345,67 TL", "د.إ 5,00", "12 345,67"]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_dates_of_plain_columns(spark, mode):
    rows = T.with_date(rows_of(spark, DATES), "text", "a", mode).withColumn("b", T.find_date(F.col("text"), mode))
    assert rows.where("not (a <=> b)").collect() == []
    assert rows.where("a is not null").count() >= 10


def test_money_of_plain_columns(spark):
    rows = T.with_money(rows_of(spark, MONEY), "text", "a").withColumn("b", T.find_money(F.col("text")))
    assert rows.where("not (a <=> b)").collect() == []
    plain = "(?iu:" + "|".join(re.escape(t) for t in T.currency_tokens()) + ")"  # as the words stand, without shared beginnings and looks ahead
    whole = F.regexp_extract_all(F.col("text"), F.lit(rf"({plain})?\s*({fixed.AMOUNT})\s*({plain})?"), F.lit(0))
    found = rows_of(spark, MONEY).where("text is not null").select("text", whole.alias("b"), T.money_texts(F.col("text")).alias("a"))
    assert found.where("not (a <=> b)").collect() == []
    words = rows_of(spark, [x for x in MONEY if x] + ["MIGROS ATASEHIR", "Şok ıstanbul ſek Kes", "₺₸ €US$"])
    assert words.where(F.regexp_replace("text", plain, "~") != F.regexp_replace("text", T.currency_pattern(), "~")).collect() == []


def test_white_space_as_unicode_has_it(spark):
    texts = ["", " ", "a  b", "\ta\n b ", "a b", "a 　 b", "a b", "a \u0085", "​x  ​", "a b", "a\x1cb", "a \x0b\x0c b"]
    rows = rows_of(spark, texts).select(T.collapse(F.col("text")).alias("a"), F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("b"))
    assert rows.where("not (a <=> b)").collect() == []


def test_installments_without_steps(spark):
    texts = ["(2/6) x", "x (3 / 12)", "(x)", "x", "2. Taksit (4/5)", "100,00 x 3 = 300,00"]
    found = [tuple(r[0]) for r in rows_of(spark, texts).orderBy("i").select(T.find_installment(F.col("text"))).collect()]
    assert found == [(2, 6, ["(2/6)"], None, None), (3, 12, ["(3 / 12)"], None, None), (None, None, [], None, None), (None, None, [], None, None), (4, 5, ["2. Taksit", "(4/5)"], None, None), (None, 3, ["100,00 x 3 = 300,00"], 100.0, 300.0)]


def test_lines_are_sorted_once_and_parsed_once(spark):
    lines = spark.createDataFrame([("a", i, 1, f"0{i}/01/2024 SHOP {i},00 TL") for i in range(1, 4)], "input_id string, line_no long, page int, text string")
    plan = P.candidates(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1  # that of the next lines: equal texts meet by hashing
    _, heads = L.extraction(lines.select("input_id").distinct(), lines)
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 0  # what was parsed is read, not parsed again for each branch
    assert heads.first().transaction_count == 3


def test_rules_meet_texts_not_rows(spark):
    from ledgerloom.operators import analytics as A

    rows = spark.createDataFrame([("a", i, x, d) for i, (x, d) in enumerate([("SHELL 1", "debit"), ("SHELL 1", "credit"), (None, "debit"), ("xyz", "debit"), ("TRENDYOL YEMEK", "debit")])], "input_id string, seq int, description string, direction string")
    found = A.categorized(rows)
    assert "rlike" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r.category, r.method) for r in found.orderBy("seq").collect()] == [("fuel", "rule"), ("income_or_refund", "direction"), ("other", "fallback"), ("other", "fallback"), ("food", "rule")]


def test_an_analysis_works_out_what_is_asked_for(spark, monkeypatch):
    from ledgerloom.operators import analytics as A
    from ledgerloom.plans.analyze import analyze

    schema = "input_id string, seq long, txn_date date, description string, amount decimal(18,2), currency string, original_currency string, direction string, installment_total int, confidence double, validation_status string"
    rows = spark.createDataFrame([("a", 1, None, "SHELL", None, "TRY", None, "debit", None, 0.9, "valid")], schema)
    for name in ("text_categories", "anomalies"):
        monkeypatch.setattr(A, name, lambda *a: pytest.fail("not asked for"))
    assert analyze(rows, rows)["reference"].count() == 2
    assert analyze(rows)["quality"].count() == 1


def test_usual_lines_are_parted_by_one_match_with_the_same_result(spark, monkeypatch):
    dates = ["05/01/2025", "31/12/1999", "01-02/2024", "2025-01-05", "31/02/2024", "5/1/2025", "05.01.2025", "05/01/25", "05/01/0025"]
    words = ["MIGROS ATASEHIR", "A", "İade İstanbul ŞOK", "ıade", "OUTLET", "MALL", "allı", "top", "X TL", "Tl", "ſek", "OCAK", "Ocak X", "ocak", "OCAKTAN X", "KASIM", "kasım", "AĞUSTOS X", "TAKSIT", "X Taksit", "taksİt", "A bosluk B", "BOŞLUK", "A  B", "A, B", "-A", "A -", "H&M *X/Y.Z_", "KART LIMITI", "Asgari Ödeme X", "A 7 B", "A x 3", "CAFÉ", "A\u0301", "A\x01B", "ŸX"]
    ends = ["12,50 TL", "1.234,56", "1,234,567.89 USD", "1234.56 ₺", "(1/6) 12,50 TL", "(12/36) 1.234,56 EUR", "( 1/6) 12,50", "12,50 TLX", "12,50 AB", "12,50 usd", "12,50TL", "-12,50 TL", "12,505 TL", "1.23.456,78", "12,50 TL X", "12,50 TL\n", "100,00 x 6 = 600,00", "99.12.2024 1,00 TL", "2024,50", "2024,50 $"]
    texts = [f"{d} {w} {e}" for d in dates for w in words for e in ends if d in dates[:4] or w == words[0] or e == ends[0]] + ["", " 05/01/2025 A 12,50 TL", "05/01/2025 12,50 TL", "05/01/2025 A", "A 12,50 TL", "\x0105/01/2025 A 12,50", None]
    lines = spark.createDataFrame([(f"d{i % 97}", i, 1, "v", 6, 0.5, x) for i, x in enumerate(texts)], "input_id string, line_no long, page int, variant string, psm int, ocr_confidence double, text string").repartition(4)
    usual = T.with_usual(lines, "text").where("_usual is not null")
    assert {"MIGROS ATASEHIR", "A", "ıade", "H&M *X/Y.Z_", "İade İstanbul ŞOK"} <= {r._usual for r in usual.select("_usual").distinct().collect()}
    assert 200 < usual.count() < len(texts) / 2
    row = T.with_usual(spark.createDataFrame([("05/01/2025 MIGROS (1/6) 1.234,56 TL",)], "text string"), "text").first()
    assert (row._usual, str(row._usual_date), row._usual_fraction, row._usual_amount, row._usual_token, row._usual_currency) == ("MIGROS", "2025-01-05", "(1/6)", "1.234,56", "TL", "TRY")
    one = spark.createDataFrame([(f"d{i}", "EUR") for i in range(0, 97, 2)], "input_id string, document_currency string")
    base = lines.select("input_id", "line_no", "page", "text")

    def results():
        out = [P.parsed(base, one, mode) for mode in ("strict", "compat")]
        # a document a line: nothing is outvoted
        alone = lines.withColumn("input_id", F.col("line_no").cast("string"))
        out += [P.document_currency(alone, kind, "none") for kind in ("pdf", "ocr")] + [P.document_currency(lines, kind) for kind in ("pdf", "ocr")]
        out += [P.variant_scores(alone, mode) for mode in ("strict", "compat")]
        return [sorted(map(repr, df.collect())) for df in out]

    found = results()
    fields = dict(zip(T.USUAL, ("string", "date", "string", "string", "string", "string")))
    monkeypatch.setattr(T, "with_usual", lambda rows, *_: rows.withColumns({c: F.lit(None).cast(t) for c, t in fields.items()}))
    for a, b in zip(found, results()):
        assert [x for x, y in zip(a, b) if x != y] == []
        assert len(a) == len(b)


def test_ocr_lines_keep_their_confidence_without_a_join(spark):
    lines = spark.createDataFrame([("a", 1, 1, "05/01/2025 SHOP 12,50 TL", 0.5, 3), ("a", 1, 2, "no line", 0.9, 2)], "input_id string, page int, line_no long, text string, ocr_confidence double, word_count int")
    one = spark.createDataFrame([("a", "TRY")], "input_id string, document_currency string")
    rows = P.parsed_ocr(lines, one)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # that with the document's currency
    assert [(r.line_no, r.reject_reason, r.confidence) for r in rows.orderBy("line_no").collect()] == [(1, None, 0.87), (2, "no_date", 0.9)]
