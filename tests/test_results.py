"""Result records: appended, read as the latest, normalised, appended again."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import normalize as N
from ledgerloom.operators import parse as P
from ledgerloom.operators import records as R
from ledgerloom.operators import results as L

LINES = [
    ("a", 0, 1, "05/01/2025 MIGROS ALISVERIS 450,00 TL"), ("a", 1, 1, "05/01/2025 MIGROS  ALISVERIS 450,00 TL"), ("a", 2, 2, "09.01.2025 SHELL (2/6) 1.200,00 TL"), ("a", 3, 2, "kart limiti 10.01.2025 99,00 TL"), ("a", 4, 2, "12.01.2025 IADE TRENDYOL 20,00 TL"), ("b", 0, 1, "only words"),
]


def lines(spark):
    return spark.createDataFrame(LINES, "input_id string, line_no int, page int, text string"), spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "input_id string")


def test_headers_of_all_inputs(spark):
    text, inputs = lines(spark)
    rows, heads = L.extraction(inputs, text)
    got = {r["input_id"]: r for r in heads.collect()}
    assert {k: (r["transaction_count"], r["total_lines"], r["candidate_line_count"], r["warnings"]) for k, r in got.items()} == {"a": (4, 5, 5, []), "b": (0, 1, 1, ["no_transactions_detected"]), "c": (0, 0, 0, ["no_text_lines_extracted_from_pdf", "no_transactions_detected"])}
    assert got["a"]["rejected_lines"] == ["kart limiti 10.01.2025 99,00 TL"] and got["b"]["rejected_lines"] == [] and got["b"]["average_confidence"] is None
    assert (got["a"]["total_debit"], got["a"]["total_credit"], got["c"]["document_currency"]) == (Decimal("2100.00"), Decimal("20.00"), "TRY")
    assert rows.where("input_id = 'a'").count() == 4


def test_round_trip_over_stored_records(spark, tmp_path):
    text, inputs = lines(spark)
    rows, heads = L.extraction(inputs, text)
    store, normal = str(tmp_path / "extractions"), str(tmp_path / "normalizations")
    R.append(L.extraction_records(rows.where("page = 1"), heads.withColumn("transaction_count", F.least("transaction_count", F.lit(2))), F.lit("2025-02-01 10:00:00"), version="v0"), store)
    R.append(L.extraction_records(rows, heads, F.lit("2025-02-01 11:00:00")), store)
    kept = spark.read.parquet(store)
    last = L.latest(kept)
    assert last.count() == 3 and last.where("version = 'pdf-native-v1'").count() == 3
    back = L.transactions_of(last).drop("record_id", "method")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))  # nothing is lost on the way through JSON
    out = L.normalize_latest(kept, F.lit("2025-02-02 00:00:00"))
    R.append(out["records"], normal)
    got = {r["input_id"]: r for r in spark.read.parquet(normal).collect()}
    assert {k: (r["transaction_count"], r["duplicate_removed_count"], r["warnings"]) for k, r in got.items()} == {"a": (3, 1, ["duplicates_removed:1"]), "b": (0, 0, ["no_transactions_detected"]), "c": (0, 0, ["no_text_lines_extracted_from_pdf", "no_transactions_detected"])}
    result = json.loads(got["a"]["result"])
    assert result["summary"]["net_amount"] == 1630.0 and len(result["transactions"]) == 3
    assert {t["confidence"] for t in result["transactions"]} == {r["score"] for r in out["transactions"].collect()} and got["a"]["extraction_id"].startswith("ext_")
    again = L.normalize_latest(kept, F.lit("2025-02-02 00:00:00"))["records"]
    assert {r["record_id"] for r in again.collect()} == {r["record_id"] for r in got.values()}  # a repeated run makes the same identifiers


def test_keys_under_which_transactions_lie(spark):
    t = '[{"line_no":1,"description":"x","price":1.5}]'
    said = {"own": f'{{"transactions":{t}}}', "inner": f'{{"result":{{"transactions":{t}}}}}', "null": f'{{"transactions":null,"result":{{"transactions":{t}}}}}', "none": "{}", "text": '{"result":"x"}', "bad": "oops", "missing": None, "both": f'{{"transactions":{t},"result":{{"transactions":[]}}}}'}
    rows = spark.createDataFrame([("r", k, "m", v) for k, v in said.items()], "record_id string, input_id string, method string, result string")
    assert sorted(r["input_id"] for r in L.transactions_of(rows).collect()) == ["both", "inner", "own"]


def test_records_are_read_and_normalised_once(spark):
    t = '[{"line_no":1,"date":"2025-01-05","description":"x","price":1.5},{"line_no":2,"date":"2025-01-05","description":"x","price":1.5},{"line_no":"odd","price":"y"}]'
    said = [f'{{"transactions":{t}}}', f'{{"result":{{"transactions":{t}}}}}', f'{{"transactions":null,"result":{{"transactions":{t}}}}}', f'{{"result":{json.dumps(json.dumps({"transactions": json.loads(t)}))}}}', '{"transactions":[],"result":{"transactions":[{"line_no":5}]}}', '{"result":{"x":1}}', '{"result":[1]}', "[]", "oops", None, f'{{"transactions":{{}},"result":{{"transactions":{t}}}}}']
    rows = spark.createDataFrame([(f"r{i}", str(i), 0, 1, "2025-01-01", "m", ["w"], x) for i, x in enumerate(said)], "record_id string, input_id string, part int, parts int, created_at string, method string, warnings array<string>, result string")
    plain = rows.select("input_id", F.explode(F.from_json(L.body(F.col("result")), f"transactions array<{L.TRANSACTION}>")["transactions"]).alias("t")).select("input_id", "t.*")
    got = L.transactions_of(rows).drop("record_id", "method")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() >= 6
    out = L.normalize_latest(rows, F.lit("2025-02-02 00:00:00"))
    assert "from_json" not in out["records"]._jdf.queryExecution().optimizedPlan().toString().lower()  # what was normalised is read, not parsed again for each branch
    facts = {r["input_id"]: (r["transaction_count"], r["duplicate_removed_count"], r["warnings"]) for r in out["records"].collect()}
    assert facts["0"] == facts["1"] == facts["3"] == (2, 1, ["w", "duplicates_removed:1"]) and facts["8"] == (0, 0, ["w"])


def test_large_documents_have_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 10)
    text = spark.range(95).select(F.when(F.col("id") < 90, "big").otherwise("small").alias("input_id"), F.col("id").cast("int").alias("line_no"), F.lit(1).alias("page"), F.concat(F.lit("05.01.2025 SHOP "), "id", F.lit("x 1"), (F.col("id") % 9).cast("string"), F.lit(",00 TL")).alias("text"))
    rows, heads = L.extraction(text.select("input_id").distinct(), text)
    made = L.extraction_records(rows, heads, F.lit("2025-02-01 10:00:00"))
    assert {(r["input_id"], r["n"], r["p"]) for r in made.groupBy("input_id").agg(F.count("*").alias("n"), F.max("parts").alias("p")).collect()} == {("big", 9, 9), ("small", 1, 1)}
    assert L.transactions_of(L.latest(made)).groupBy("input_id").count().where("input_id = 'big' and count = 90 or input_id = 'small' and count = 5").count() == 2


def test_documents_score_as_confidence(spark):
    rows = spark.createDataFrame([("a", 0, "2025-01-05", "MIGROS", 5.0, "TRY", "debit", 0.9), ("a", 1, "2025-01-05", "MIGROS", 5.0, "TRY", "debit", 0.95), ("a", 2, None, "", None, None, None, None)], "input_id string, seq int, date string, description string, price double, currency string, direction string, confidence double")
    out = N.documents(rows, spark.createDataFrame([("a",), ("z",)], "input_id string"))
    kept = {r["seq"]: r for r in out["transactions"].collect()}
    assert set(kept) == {1, 2} and kept[1]["source_confidence"] == 0.95 and kept[1]["confidence"] == kept[1]["score"]
    s = {r["input_id"]: r for r in out["summary"].collect()}
    assert (s["a"]["duplicate_removed_count"], s["a"]["warnings"], s["a"]["currencies"]) == (1, ["duplicates_removed:1"], ["TRY"])
    assert (s["z"]["transaction_count"], s["z"]["overall_confidence"], s["z"]["validation_passed"], s["z"]["currencies"], s["z"]["warnings"]) == (0, None, False, [], [])


def ocr(spark):
    rows = [("a", 1, "original", 6, 0, "05/01/2025 MIGROS 10,00 TL", 0.9, 4), ("a", 1, "original", 4, 0, "05/01/2025 MIGROS 10,00 TL", 0.9, 4), ("a", 1, "original", 11, 0, "05/01/2025 MIGROS 10,00 TL", 0.9, 4), ("a", 2, "unknown", 6, 0, "no signs", 0.5, 2), ("a", 2, "unknown", 6, 1, "12/01/2025 and nothing", 0.5, 3)]
    return spark.createDataFrame(rows, "input_id string, page int, variant string, psm int, line_no int, text string, ocr_confidence double, word_count int")


def test_image_extraction_of_all_inputs(spark):
    outputs = spark.createDataFrame([("a", 1, "original", 0, True, "u"), ("a", 1, "gray", 1, False, "u"), ("a", 2, None, 0, False, "u"), ("a", None, "bw", 0, False, None), ("b", 1, "gray", 0, False, "u"), ("c", 1, "gray", 0, False, "")], "input_id string, page int, variant string, ord int, is_preferred boolean, storage_url string")
    rows, heads = L.image_extraction(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "input_id string"), ocr(spark), outputs)
    got = {r["input_id"]: r for r in heads.collect()}
    assert rows.count() == 1 and (got["a"]["transaction_count"], got["a"]["total_lines"], got["a"]["candidate_line_count"], got["a"]["rejected_lines"]) == (1, 3, 2, ["12/01/2025 and nothing"])
    assert got["b"]["warnings"] == ["no_ocr_lines_extracted", "no_transactions_detected"] and got["c"]["warnings"] == got["d"]["warnings"] == ["no_preprocessing_outputs_found", "no_ocr_lines_extracted", "no_transactions_detected"]


def test_equal_scores_take_the_first_mode(spark):
    outputs = spark.createDataFrame([("a", 1, "original", 0, True)], "input_id string, page int, variant string, ord int, is_preferred boolean")
    for parts in (1, 5):
        assert {r["psm"] for r in P.chosen_lines(ocr(spark).where("page = 1").repartition(parts), outputs).collect()} == {6}


def test_binary_files(spark, tmp_path):
    from ledgerloom.sources import tables as S

    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n\x1a\nzz", "c.txt": b"hello"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["mime"], r["reject_reason"]) for r in S.binary_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.png": ("image/png", None), "c.txt": ("application/octet-stream", "unsupported_type")}


def test_bucketed_store_needs_no_shuffle(spark, tmp_path):
    from ledgerloom.operators import store as B

    s = B.BucketStore(spark, "at int, v string", buckets=4, path="file://" + str(tmp_path / "store"))
    make = lambda rows: spark.createDataFrame(rows, "input_id string, at int, v string")
    s.put(make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")]), "extraction")
    s.put(make([("a", 1, "old"), ("b", 1, "old")]), "normalization")
    s.put(make([("a", 3, "no"), ("a", 2, "ok"), ("b", 1, "ok")]), "normalization", replace=True)
    s.put(make([("c", 9, "z")]), "extraction")
    gate = s.gate("extraction", "normalization", "v = 'ok'", "at")
    assert sorted(map(tuple, gate.collect())) == [("a", 2, "y", False), ("b", 1, "x", True), ("c", 9, "z", False)]
    assert "Exchange" not in gate._jdf.queryExecution().executedPlan().toString()
    assert s.of("normalization").count() == 3 and s.of("extraction").count() == 5
    s.drop()
