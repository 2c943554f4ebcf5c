"""The contract fixture, invariants, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import analytics as A
from ledgerloom.operators import classify as C
from ledgerloom.operators import preprocess as X
from ledgerloom.operators import records as R
from ledgerloom.operators import report
from ledgerloom.plans.analyze import analyze
from ledgerloom.streaming import ingest as I

SCHEMA = "input_id string, seq long, txn_date date, description string, amount decimal(18,2), currency string, original_currency string, direction string, installment_total int, confidence double, validation_status string"


@pytest.fixture()
def contract(spark):
    d = datetime.date
    from decimal import Decimal as D

    rows = [(d(2025, 1, 5), "MIGROS ALISVERIS", D("450.00"), "debit", 0.95), (d(2025, 1, 9), "SHELL AKARYAKIT", D("1200.00"), "debit", 0.93), (d(2025, 1, 15), "TURKCELL FATURA", D("320.00"), "debit", 0.90), (d(2025, 1, 20), "MAAS ODEMESI", D("30000.00"), "credit", 0.99)]
    return spark.createDataFrame([("x", i, t, s, a, "TRY", None, k, None, c, "valid") for i, (t, s, a, k, c) in enumerate(rows)], SCHEMA)


def test_contract_fixture(contract):
    got = analyze(contract, scenarios=contract.sparkSession.createDataFrame([("x", 1000.0, "TRY", 6)], "input_id string, amount double, currency string, max_months int"))
    names = {r["seq"]: r["category"] for r in got["transactions"].collect()}
    assert names == {0: "groceries", 1: "fuel", 2: "telecom", 3: "income_or_refund"}
    q = got["quality"].first()
    assert (q["usable"], q["overall"], q["status"]) == (4, 0.9425, "completed")
    a = got["anomalies"].collect()
    assert [(r["seq"], r["score"], r["severity"], r["flags"]) for r in a] == [(1, 0.3891, "low", ["unusually_high_amount"])]
    f = got["forecast"].first()
    assert (f["predicted"], f["confidence"]) == (1970.0, 0.41)
    assert got["profile"].first()["labels"] == ["Akaryakıt_heavy_spender"]
    assert abs(sum(r["share_of_spend"] for r in got["categories"].collect()) - 1) < 1e-3
    r = got["installments"].first()
    assert (r["status"], r["recommended_months"], r["monthly_amount"], r["risk_level"], len(r["options"])) == ("completed", 4, 250.0, "low", 6)
    assert r["explanation"] == "1,000.00 TRY tutarındaki alışveriş için 4 ay taksit, aylık 250.00 TRY ödemeyle tahmini harcama seviyenize göre rahatça karşılayabileceğiniz bir seçenek görünüyor."
    o = got["outcome"].first()
    assert (o["status"], o["warnings"]) == ("completed", ["recommendation_is_spending_burden_estimate_not_credit_advice"])
    labels = {r["seq"]: r["category_label"] for r in got["transactions"].collect()}
    assert labels == {0: "Market", 1: "Akaryakıt", 2: "İletişim", 3: "Gelir ve İade"}
    assert len(got["summary"].first()["sentences"]) == 5
    assert got["summary"].first()["sentences"][3] == "Gelecek dönem için tahmini harcamanız yaklaşık 1,970.00 TRY."
    asked = contract.sparkSession.createDataFrame([("x", "en çok ne?"), ("x", "anomali var mı"), ("x", "merhaba")], "input_id string, question string")
    said = {r["intent"]: r["answer"] for r in report.answers(asked, got["facts"]).collect()}
    assert said["anomaly_question"].endswith("SHELL AKARYAKIT (1,200.00 TRY) işlemi dikkat çekiyor: Alışılmışın üzerinde tutar.")
    assert got["context"].first()["lines"] == [
        "- En yoğun harcama kategorisi: Akaryakıt (toplam harcamanın %60.9'i).", "- Harcama profili: Akaryakıt_heavy_spender.", "- En çok harcanan kategoriler: Akaryakıt (60.9%), Market (22.8%), İletişim (16.2%).",
        "- İşaretlenen anomali sayısı: 1.", "  - SHELL AKARYAKIT: 1200.00 TRY (low önem).", "- Gelecek dönem harcama tahmini: 1970.00 TRY.", "- Önerilen taksit sayısı: 4 ay (risk: low).",
    ]
    assert got["anomaly_results"].first()["observations"] == ["1 işlem inceleme gerektirebilecek anomali sinyali taşıyor.", "PyOD modeli için yeterli geçmiş işlem olmadığı için istatistiksel fallback kullanıldı."]


def test_empty_document(spark):
    got = analyze(spark.createDataFrame([], SCHEMA))
    assert all(df.count() == 0 for df in got.values())


def test_results_do_not_depend_on_partitions(contract):
    a = A.robust_anomalies(A.features(contract.repartition(1))).select("seq", "score").collect()
    assert a == A.robust_anomalies(A.features(contract.repartition(7))).select("seq", "score").collect()


def test_equal_amounts_have_no_robust_anomaly(contract):
    same = contract.where("direction = 'debit'").withColumn("amount", F.lit(5).cast("decimal(18,2)"))
    assert A.robust_anomalies(A.features(same)).count() == 0


def test_gap_months_are_zero(contract):
    rows = contract.unionByName(contract.where("seq = 0").withColumn("txn_date", F.lit("2025-04-01").cast("date")))
    assert [r["spend"] for r in A.monthly_spend(A.features(rows)).orderBy("month").collect()] == [1970.0, 0.0, 0.0, 450.0]


def test_latest_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("b", 1, 1, "z")], "k string, id int, at int, v string")
    assert {(r["k"], r["v"]) for r in R.latest(rows, "k", "at", "id").collect()} == {("a", "y"), ("b", "z")}


def test_streamed_batches_equal_one_batch(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.5).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    q = I.staged(I.landing(spark, str(tmp_path / "in"), rows.schema, 1), lambda b: I.tumbling(b), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("window_start").agg(F.sum("n").alias("n"))
    assert {(r["window_start"], r["n"]) for r in back.collect()} == {(r["window_start"], r["n"]) for r in I.tumbling(rows).collect()}


def test_stream_windows_close_after_the_watermark(spark, tmp_path):
    rows = spark.range(0, 200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = I.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert all(r["n"] == 24 for r in spark.table("closed").collect())


def test_image_metrics(spark):
    import numpy as np

    g = np.full((60, 80), 250, np.uint8)
    g[10:14, 10:20] = 0
    g[14, 20] = 0  # touches by a corner
    g[40:42, 40:42] = 0
    g[50, 70] = 0  # one pixel is no component
    rows = spark.createDataFrame([("a", 80, 60, bytearray(g.tobytes())), ("b", 3, 3, bytearray(b"xx"))], "input_id string, width int, height int, pixels binary")
    got = {r["input_id"]: r for r in X.image_metrics(rows).withColumn("readiness", C.readiness()).collect()}
    assert (got["a"]["component_count"], got["a"]["avg_component_area"]) == (2, 22.5)
    assert got["a"]["foreground_density"] == round(46 / 4800, 4) and got["a"]["border_artifact_score"] == 0
    assert 0 <= got["a"]["readiness"] <= 1 and got["b"]["blur_score"] is None


def test_plans_variants_and_gates(spark):
    kinds = spark.createDataFrame([("p", "real_pdf"), ("s", "screenshot"), ("c", "scanned_pdf"), ("u", "unknown")], "input_id string, kind string")
    assert {(r["input_id"], r["method"], r["is_ready"]) for r in X.plan(kinds).collect()} == {("p", "native_pdf_text", True), ("s", "ocr_multi_variant", None), ("c", "ocr_multi_variant", None), ("u", "manual_review", False)}
    v = X.variants(kinds.crossJoin(spark.createDataFrame([(1,), (2,)], "page int")))
    assert v.groupBy("input_id").count().where("input_id = 'c' and count = 6 or input_id = 's' and count = 4").count() == 2
    inputs = spark.createDataFrame([("p", "url"), ("s", "url"), ("u", "url"), ("n", "url")], "input_id string, storage_url string")
    done = spark.createDataFrame([("p", "native_pdf_text", True, None), ("s", "ocr_multi_variant", False, "x")], "input_id string, method string, is_ready boolean, preferred_url string")
    assert {(r["input_id"], r["refused"], r["path"]) for r in X.extraction_gate(inputs, kinds, done).collect()} == {("p", None, "url"), ("s", "wrong_kind", None), ("u", "wrong_kind", None), ("n", "not_classified", None)}
    assert {(r["input_id"], r["refused"]) for r in X.extraction_gate(inputs, kinds, done, native=False).collect()} >= {("s", "not_ready")}


def test_history_with_overlapping_numbers_stays(contract):
    """History and current are numbered per document alike; only equal identifiers meet."""
    old = contract.withColumn("txn_date", F.add_months("txn_date", -1))
    assert analyze(contract, old)["reference"].count() == 8 and analyze(contract, contract)["reference"].count() == 8
    named = contract.withColumn("transaction_id", F.concat(F.lit("t"), "seq"))
    kept = analyze(named, named.where("seq < 2").withColumn("amount", F.lit(1).cast("decimal(18,2)")))["reference"]
    assert sorted((r["transaction_id"], float(r["amount"])) for r in kept.collect()) == [("t0", 450.0), ("t1", 1200.0), ("t2", 320.0), ("t3", 30000.0)]
    assert analyze(contract, old)["forecast"].first()["months"] == 2


def test_ecdf_flag_has_words(spark):
    rows = spark.createDataFrame([(["pyod_outlier_score"],), (["unknown_flag"],)], "flags array<string>")
    said = [r[0] for r in rows.select(A.anomaly_message(F.lit("X"), F.lit(5.0), F.lit("TRY"), F.col("flags"))).collect()]
    assert said == ["X (5.00 TRY) işlemi dikkat çekiyor: İstatistiksel sapma.", "X (5.00 TRY) işlemi dikkat çekiyor: Olağan dışı işlem."]


def test_dimensions_are_checked(spark, contract, monkeypatch):
    monkeypatch.setattr(A, "DIMENSION_ROWS", 2)
    with pytest.raises(ValueError):
        A.first_rule_by_join(contract, spark.createDataFrame([(i, "c", "x") for i in range(3)], "ord int, category string, pattern string"))
    with pytest.raises(ValueError):
        A.similar_categories(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(i, [1.0]) for i in range(3)], "ref_id long, embedding array<double>"))


def test_taxonomy_texts():
    from ledgerloom.functions import taxonomy

    texts = taxonomy.reference_texts()
    assert len(texts) == 19 and texts[12][2] == "category=accommodation; subcategory=hotel_stay; examples=HOTEL, OTEL, BOOKING, AIRBNB, KONAKLAMA"
    assert taxonomy.allowed_categories()[:3] == ["travel", "food", "groceries"] and len(taxonomy.allowed_categories()) == 18


def test_rules_see_any_case(spark):
    from ledgerloom.functions import taxonomy

    said = ["İSTANBULKART yükleme", "ACIBADEM", "acıbadem", "Vatan Bilgisayar", "PARA ÇEKME", "marketplace", "MARTI", "LC WAIKIKI", "bimserver"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, c string")
    got = [r[0] for r in rows.orderBy("i").select(taxonomy.rule(F.col("c"))["category"]).collect()]
    assert got == ["transport", "health", "health", "shopping", "finance", None, "transport", "clothing", None]


def test_quality_metrics(spark):
    import numpy as np

    g = np.full((40, 50), 20, np.uint8)
    g[10:30, 15:35] = 240
    found = X.edges(g)
    # the outline of the square, a pixel thick, closed
    assert 60 <= found.sum() <= 90 and not found[15:25, 20:30].any() and not found[:8].any()
    faint = np.full((20, 20), 100, np.uint8)
    faint[:, 10:] = 115
    assert not X.edges(faint).any()
    joined = np.full((20, 20), 100, np.uint8)
    joined[:10, 10:] = 200  # strong above, weak below, one edge
    joined[10:, 10:] = 130
    assert X.edges(joined)[3:17].any(1).all()
    weak = joined.copy()
    weak[:10, 10:] = 100
    assert not X.edges(weak)[14:].any()
    rows = spark.createDataFrame([("a", 50, 40, bytearray(g.tobytes())), ("b", 3, 3, bytearray(b"xx"))], "input_id string, width int, height int, pixels binary")
    got = {r["input_id"]: r for r in X.quality_metrics(rows).withColumn("quality", C.quality()).collect()}
    assert got["a"]["dark_pixel_ratio"] == 0.8 and got["a"]["bright_pixel_ratio"] == 0.2 and got["a"]["edge_density"] == round(found.mean(), 4)
    assert 0 < got["a"]["quality"] <= 1 and got["b"]["edge_density"] is None


def test_image_without_votes_is_unknown(spark):
    rows = spark.createDataFrame([("x", "image/gif", True, 1, 100, 100, 200.0, 0.0, False, 0.0, 0.0)], "input_id string, mime string, exif_present boolean, camera_exif_tag_count int, width int, height int, blur_score double, edge_density double, has_document_contour boolean, max_contour_area_ratio double, axis_aligned_line_score double")
    r = C.image_kind(rows).first()
    assert (r["kind"], r["confidence"], r["warnings"]) == ("unknown", 0.0, ["image_classification_failed", "low_confidence_image_classification"])


def test_records_append_and_latest(spark, tmp_path):
    path = str(tmp_path / "records")
    for at in (1, 2):
        R.append(spark.createDataFrame([("a", at, f"v{at}"), ("b", at, "x")][: 3 - at], "input_id string, at int, v string"), path)
    assert {(r["input_id"], r["v"]) for r in R.latest(spark.read.parquet(path), "input_id", "at").collect()} == {("a", "v2"), ("b", "x")}


def test_autoregression_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    series = {"a": rng.uniform(10, 99, 14), "b": rng.uniform(1, 5, 6), "c": np.full(8, 7.0), "short": rng.uniform(1, 2, 5)}
    rows = [(k, "TRY", datetime.date(2024 + (i // 12), i % 12 + 1, 1), float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    got = {r["input_id"]: r for r in A.ar_forecast(spark.createDataFrame(rows, "input_id string, currency string, month date, spend double")).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, r in got.items():
        x = series[k]
        sd = x.std() or 1.0
        z = (x - x.mean()) / sd
        m = np.stack([z[i : len(z) - 3 + i] for i in range(3)] + [np.ones(len(z) - 3)], 1)
        beta = np.linalg.solve(m.T @ m + 0.1 * np.eye(4), m.T @ z[3:])
        blended = 0.6 * (np.append(z[-3:], 1.0) @ beta * sd + x.mean()) + 0.4 * np.average(x[-6:], weights=range(1, len(x[-6:]) + 1))
        assert r["predicted"] == pytest.approx(min(max(blended, x.min() * 0.5), x.max() * 1.5), abs=0.006) and r["months"] == len(x)


def months_of(spark, n, name="x", currency="TRY", direction="debit", start=1):
    rows = [(name, i, datetime.date(2024 + (start + i - 1) // 12, (start + i - 1) % 12 + 1, 3), "MIGROS", 100 + 10 * (i % 3), currency, None, direction, None, 0.9, "valid") for i in range(n)]
    return spark.createDataFrame([(*r[:4], __import__("decimal").Decimal(r[4]), *r[5:]) for r in rows], SCHEMA)


def test_forecast_switches_at_six_months(spark):
    got = {}
    for n in (0, 1, 5, 6, 8):
        rows = months_of(spark, n) if n else months_of(spark, 2, direction="credit")
        f = analyze(rows)["forecast"].collect()
        assert len(f) == 1
        got[n] = (f[0]["status"], f[0]["method"], f[0]["months"], f[0]["confidence"])
    assert got == {0: ("insufficient_data", "no_data", 0, None), 1: ("completed", "weighted_moving_average", 1, 0.41), 5: ("completed", "weighted_moving_average", 5, 0.65), 6: ("completed", "ar_moving_average_ensemble", 6, 0.8), 8: ("completed", "ar_moving_average_ensemble", 8, 0.85)}


def test_one_currency_of_reference_a_document(spark):
    rows = months_of(spark, 3).unionByName(months_of(spark, 7, currency="USD").withColumn("seq", F.col("seq") + 100))
    named = spark.createDataFrame([("x", "try", ["b", "b", "a"])], "input_id string, primary_currency string, warnings array<string>")
    buy = spark.createDataFrame([("x", 100.0, "usd", 3)], "input_id string, amount double, currency string, max_months int")
    for inputs, want in ((None, ("USD", 7)), (named, ("TRY", 3))):
        a = analyze(rows, inputs=inputs, scenarios=buy)
        f = a["forecast"].collect()
        assert [(r["currency"], r["months"]) for r in f] == [want] and a["summary"].count() == a["context"].count() == 1
        i = a["installments"].first()
        assert i["status"] == ("completed" if want[0] == "USD" else "insufficient_data") and i["forecast_method"] == f[0]["method"]
    assert a["outcome"].first()["warnings"] == ["a", "b", "insufficient_forecast_for_installment_recommendation"]
    tie = months_of(spark, 2).unionByName(months_of(spark, 2, currency="EUR").withColumn("seq", F.col("seq") + 100))
    assert analyze(tie)["forecast"].first()["currency"] == "EUR"


def test_documents_with_credits_only(spark):
    a = analyze(months_of(spark, 3, direction="credit").unionByName(months_of(spark, 9, "y")))
    p = {r["input_id"]: r for r in a["profile"].collect()}
    assert p["x"]["labels"] == ["insufficient_spending_data"] and p["x"]["observations"] == ["Analiz için harcama işlemi bulunamadı."] and p["x"]["average_amount"] == 0 and p["y"]["observations"] == ["Harcama tutarının %100.0 bölümü Market kategorisinde yoğunlaşıyor."]
    r = {r["input_id"]: r for r in a["anomaly_results"].collect()}
    assert (r["x"]["detector"], r["x"]["anomaly_count"], r["x"]["observations"], r["y"]["detector"]) == ("no_debit_data", 0, ["Anomali analizi için harcama işlemi bulunamadı."], "ecdf")
    s = {r["input_id"]: r["sentences"] for r in a["summary"].collect()}
    assert s["x"] == ["Harcama profiliniz: insufficient_spending_data.", "Dikkat çeken olağan dışı bir işlem görünmüyor."]
    assert {r["input_id"]: r["status"] for r in a["installments"].collect()} == {"x": "not_requested", "y": "not_requested"}
    c = {r["input_id"]: (r["uncategorized_count"], r["rule_assisted_count"]) for r in a["category_counts"].collect()}
    assert c == {"x": (0, 3), "y": (0, 9)}


def test_ecdf_ranks_equal_sorted_windows(spark):
    """Counts by value against cumulative distributions of sorted rows, with ties, hot documents and few values."""
    from pyspark.sql import Window

    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("input_id"), "id", F.log1p((F.pmod(F.xxhash64("id"), F.lit(900)) / 7).cast("decimal(18,2)").cast("double")).alias("log_amount"))
    w = Window.partitionBy("input_id")
    want = rows.select("id", F.count("*").over(w.orderBy("log_amount").rangeBetween(Window.unboundedPreceding, 0)).alias("a"), F.count("*").over(w.orderBy(F.desc("log_amount")).rangeBetween(Window.unboundedPreceding, 0)).alias("b"))
    ranks = A.amount_ranks(rows)
    got = rows.join(ranks, (rows["input_id"] == ranks["input_id"]) & (rows["log_amount"] == ranks["_v"])).select("id", "below", "above")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_given_confidence_and_merchants(contract):
    spark = contract.sparkSession
    a = analyze(contract, inputs=spark.createDataFrame([("x", 0.5), ("unseen", 0.1)], "input_id string, overall_confidence double"))
    q = a["quality"].collect()
    assert [(r["overall"], r["analysis_confidence"], r["status"]) for r in q] == [(0.5, 0.5, "partial")]
    named = contract.withColumn("merchant", F.struct(F.lit("raw").alias("raw"), F.lit("Shop").alias("normalized"), F.lit("").alias("display_name")))
    assert analyze(named)["anomalies"].first()["message"].startswith("Shop (1,200.00 TRY)")


def test_money_is_rounded_as_in_sql(spark):
    import duckdb

    values = [71237.135, -71237.135, 1.005, 617.285, 260791.64499999996, 118014.67499999999, 0.125, 0.0, 8388607.995, 100000.015]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", T.rounded_money(F.col("x")).alias("r"))
    want = {x: duckdb.sql(f"select round({x!r}::double, 2)").fetchall()[0][0] for x in values}
    assert {r["x"]: r["r"] for r in rows.collect()} == want


def test_forecast_of_a_half_cent(spark):
    months = [(datetime.date(2024, m, 1), x) for m, x in ((1, 71237.13), (2, 71237.13), (3, 71237.14))]
    monthly = spark.createDataFrame([("x", "TRY", m, s) for m, s in months], "input_id string, currency string, month date, spend double")
    assert A.forecast(monthly).first()["predicted"] == 71237.13  # 71237.135, whose hundredfold is below the half


def test_half_an_area_is_half_in_any_order(spark):
    areas = [0.5, 0.7000000000000001, 0.3]  # as doubles more than 1.5 in this order, 1.5 from the other end
    rows = [(name, p, 0, 0, a, 1.0) for name, of in (("x", areas), ("y", areas[::-1])) for p, a in enumerate(of)]
    pages = spark.createDataFrame(rows, "input_id string, page int, char_count int, word_count int, image_area double, page_area double").coalesce(1)
    assert {r["input_id"]: r["global_image_area_ratio"] for r in C.pdf_features(pages).collect()} == {"x": 0.5, "y": 0.5}


def test_months_are_sorted_once_and_never_joined(spark, contract):
    monthly = A.monthly_spend(A.features(contract))
    plan = A.ar_forecast(monthly)._jdf.queryExecution().sparkPlan().toString()
    done = A.ar_forecast(monthly)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(done.split("Sort [")) - 1 <= 2  # before gaps are filled, and after
