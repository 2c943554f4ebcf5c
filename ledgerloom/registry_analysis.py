"""Queries of the whole analysis over documents of all sorts: two currencies, credits only, few and many months, with a purchase in mind or none."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import CONTEXT, query
from .sources import tables as S

#: Documents by their number k: a third of the rows of every fifth are in dollars, every seventh has credits only, every third has five months at most.
MIXED_SQL = """
select input_id, seq, txn_date, description, amount, case when k % 5 = 0 and seq % 3 = 0 then 'USD' else currency end as currency, original_currency, case when k % 7 = 0 then 'credit' else direction end as direction, installment_total, confidence,
 case when k % 2 = 0 and validation_status = 'invalid' then 'valid' else validation_status end as validation_status
from (select *, cast(substr(input_id, 6) as bigint) as k from ({base}) t) u where k % 3 <> 0 or txn_date < cast('1995-06-01' as date)
"""
BASE = S.TRANSACTION_SQL.format(orders="orders")
#: Every tenth document names dollars as its primary currency.
REFERENCE = """refc as (select input_id, case when cast(substr(input_id, 6) as bigint) % 10 = 0 then 'USD' else currency end as rc from (select input_id, currency, count(*) as n from txn group by all) qualify row_number() over (partition by input_id order by n desc, currency) = 1"""


def mixed_sql(sql: str) -> str:
    """A query over the driver's transactions as one over MIXED_SQL's, months in the document's reference currency."""
    sql = sql.replace(BASE, MIXED_SQL.format(base=BASE) + "), " + REFERENCE)
    return sql.replace("from txn where direction = 'debit' and validation_status <> 'invalid' group by all", "from txn join refc using (input_id) where currency = rc and direction = 'debit' and validation_status <> 'invalid' group by all")


def mixed(spark, d):
    return spark.sql(MIXED_SQL.format(base=S.TRANSACTION_SQL).format(orders="{orders}"), orders=S.table(spark, d, "orders"))


def analysis(spark, d):
    from .plans.analyze import analyze

    rows = mixed(spark, d)
    k = F.substring("input_id", 6, 20).cast("long")
    inputs = rows.select("input_id").distinct().select("input_id", F.when(k % 10 == 0, "USD").alias("primary_currency"), F.when(k % 9 == 0, 0.6).alias("overall_confidence"), F.when(k % 8 == 0, F.array(F.lit("z_from_before"), F.lit("analysis_contains_invalid_transactions"))).alias("warnings"))
    scenarios = inputs.where(k % 4 <= 1).select("input_id", F.when(k % 4 == 0, 50000.0).otherwise(900.5).alias("amount"), F.when(k % 4 == 0, "try").otherwise("usd").alias("currency"), F.when(k % 4 == 0, 12).otherwise(6).alias("max_months"))
    return analyze(rows, scenarios=scenarios, inputs=inputs)


FOUND = mixed_sql(f"""{CONTEXT}, ks as (select *, cast(substr(input_id, 6) as bigint) as k from said join refc using (input_id)), sc as (select *, case when k % 4 = 0 then 50000.0e0 when k % 4 = 1 then 900.5e0 end as asked, case when k % 4 = 0 then 'TRY' when k % 4 = 1 then 'USD' end as cur, case when k % 4 = 0 then 12 when k % 4 = 1 then 6 end as most from ks),
 opt as (select input_id, m, round(asked / m, 2) as monthly, predicted, case when round(asked / m, 2) / predicted <= 0.15 then 'low' when round(asked / m, 2) / predicted <= 0.30 then 'medium' else 'high' end as risk, most from sc, (select unnest(generate_series(1, 12)) as m) where m <= most and cur = rc and predicted is not null),
 best as (select * from opt qualify row_number() over (partition by input_id order by case when risk = 'low' then m else 100 + most - m end) = 1),
 q as (select input_id, avg(confidence) as o, count(*) as n, count(*) filter (confidence < 0.7e0) as lo, count(*) filter (validation_status = 'invalid') as iv, count(*) filter (direction = 'debit') as debits from txn group by input_id),
 fin as (select sc.*, q.* exclude (input_id, n), q.n as rows_, m, monthly, risk, case when asked is null then 'not_requested' when m is not null then 'completed' else 'insufficient_data' end as inst from sc join q using (input_id) left join best using (input_id))""")


@query("analysis_outcome", f"""{FOUND}, v as (select *, cast(round(cast(greatest(0.0e0, least(1.0e0, case when k % 9 = 0 then 0.6e0 else cast(round(cast(o as decimal(18,10)), 4) as double) end - lo / rows_ * 0.20e0 - iv / rows_ * 0.35e0)) as decimal(18,10)), 4) as double) as conf from fin)
select input_id, conf as analysis_confidence, case when iv > 0 or conf < 0.55 then 'partial' else 'completed' end as status, concat_ws(',', case when iv > 0 or k % 8 = 0 then 'analysis_contains_invalid_transactions' end, case when lo > 0 then 'analysis_contains_low_confidence_transactions' end,
 case when inst = 'insufficient_data' then 'insufficient_forecast_for_installment_recommendation' when inst = 'completed' then 'recommendation_is_spending_burden_estimate_not_credit_advice' end, case when k % 8 = 0 then 'z_from_before' end) as warnings from v""")
def analysis_outcome(spark, d):
    a = analysis(spark, d)
    return a["outcome"].join(a["quality"].select("input_id", "analysis_confidence"), "input_id").select("input_id", "analysis_confidence", "status", F.array_join("warnings", ",").alias("warnings"))


@query("analysis_documents", f"""{FOUND} select input_id, labels, case when debits = 0 then 'no_debit_data' when debits >= 8 then 'ecdf' else 'robust' end as detector, n as anomaly_count, rc as currency, coalesce(months, 0) as months, predicted,
 case when predicted is null then 'no_data' when months < 6 then 'weighted_moving_average' else 'ar_moving_average_ensemble' end as method, case when predicted is null then null when months < 6 then least(0.35 + months * 0.06, 0.65) else least(0.65 + months * 0.025, 0.90) end::double as confidence, inst as installment_status, m::int as recommended_months, risk as risk_level from fin""")
def analysis_documents(spark, d):
    a = analysis(spark, d)
    rows = a["forecast"].select("input_id", "currency", "months", "predicted", "method", "confidence").join(a["installments"].select("input_id", F.col("status").alias("installment_status"), "recommended_months", "risk_level"), "input_id")
    rows = rows.join(a["anomaly_results"].select("input_id", "detector", "anomaly_count"), "input_id").join(a["profile"].select("input_id", F.array_join("labels", ",").alias("labels")), "input_id")
    return rows.select("input_id", "labels", "detector", "anomaly_count", "currency", "months", "predicted", "method", "confidence", "installment_status", "recommended_months", "risk_level")


@query("analysis_texts", f"""{FOUND}, text_ as (select *, concat_ws(chr(10), 'Harcamalarınızın en büyük bölümü ' || label || ' kategorisinde (%' || pct || ').', 'Harcama profiliniz: ' || replace(labels, ',', ', ') || '.', case when n > 0 then 'İncelemeye değer ' || n || ' işlem dikkat çekiyor.' else 'Dikkat çeken olağan dışı bir işlem görünmüyor.' end,
  'Gelecek dönem için tahmini harcamanız yaklaşık ' || next || '.', 'Planladığınız alışveriş için ' || m || ' ay taksit uygun bir seçenek olarak öne çıkıyor.') as summary,
 concat_ws(chr(10), '- En yoğun harcama kategorisi: ' || label || ' (toplam harcamanın %' || pct || chr(39) || 'i).', '- Harcama profili: ' || replace(labels, ',', ', ') || '.', '- En çok harcanan kategoriler: ' || tops || '.', '- İşaretlenen anomali sayısı: ' || n || '.', items,
  '- Gelecek dönem harcama tahmini: ' || format('{{:.2f}}', predicted) || ' ' || rc || '.', '- Önerilen taksit sayısı: ' || m || ' ay (risk: ' || risk || ').') as context,
 case inst when 'not_requested' then 'Taksit değerlendirmesi için purchase_scenario gönderilmelidir.' when 'insufficient_data' then 'Satın alma senaryosu için karşılaştırılabilir harcama tahmini bulunamadı.'
  else format('{{:,.2f}}', asked) || ' ' || cur || ' tutarındaki alışveriş için ' || m || ' ay taksit, aylık ' || format('{{:,.2f}}', monthly) || ' ' || cur || ' ödemeyle tahmini harcama seviyenize göre ' || case risk when 'low' then 'rahatça karşılayabileceğiniz' when 'medium' then 'orta düzeyde zorlayabilecek' else 'bütçenizi yükleyebilecek' end || ' bir seçenek görünüyor.' end as explanation
 from fin left join tops using (input_id) left join items using (input_id)) select input_id, summary, context, explanation from text_""")
def analysis_texts(spark, d):
    a = analysis(spark, d)
    rows = a["summary"].select("input_id", F.array_join("sentences", "\n").alias("summary")).join(a["context"].select("input_id", F.array_join("lines", "\n").alias("context")), "input_id")
    return rows.join(a["installments"].select("input_id", "explanation"), "input_id")

