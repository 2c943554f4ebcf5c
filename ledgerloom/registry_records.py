"""Queries of records: extraction and normalisation from table to table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import preprocess as X
from .operators import results as L
from .operators import store as B
from .registry import TXN, money, query, txn
from .sources import tables as S
from .sources.shared import kept
from .streaming import worker as W

HEADED = f"""{TXN}, per as (select input_id, count(*) as n, round(round(avg(case when installment_total is not null then 0.98e0 else 0.95e0 end), 10), 4) as c, sum(case when direction = 'debit' then amount else 0 end) as db, sum(case when direction = 'credit' then amount else 0 end) as cr from txn group by input_id)"""


@query("extraction_headers", f"""{HEADED} select 'cust_' || c_custkey as input_id, coalesce(n, 0) as transaction_count, c::double as average_confidence, coalesce(db, 0)::double as total_debit, coalesce(cr, 0)::double as total_credit, 'TRY' as document_currency,
 coalesce(n + 1, 0) as total_lines, coalesce(n + 1, 0) as candidate_line_count, case when n is not null then 'KART LIMITI 01/02/2024 10,00 TL' else '' end as rejected, case when n is null then 'no_text_lines_extracted_from_pdf,no_transactions_detected' else '' end as warnings
from customer left join per on input_id = 'cust_' || c_custkey""")
def extraction_headers(spark, d):
    """Customers as documents, some without a line; each other has one line that is no transaction."""
    t = txn(spark, d)
    lines = S.statement_lines(t)
    noise = t.select("input_id").distinct().select("input_id", F.lit(10**12).alias("line_no"), F.lit(1).alias("page"), F.lit("KART LIMITI 01/02/2024 10,00 TL").alias("text"))
    inputs = S.table(spark, d, "customer").select(F.concat(F.lit("cust_"), "c_custkey").alias("input_id"))
    _, heads = L.extraction(inputs, lines.unionByName(noise))
    return heads.select("input_id", "transaction_count", "average_confidence", money("total_debit").alias("total_debit"), money("total_credit").alias("total_credit"), "document_currency", "total_lines", "candidate_line_count", F.array_join("rejected_lines", "|").alias("rejected"), F.array_join("warnings", ",").alias("warnings"))


def extracted(t):
    """Transactions as an extraction gives them, and their headers."""
    none = F.lit(None)
    rows = t.select("input_id", F.col("seq").alias("line_no"), F.lit(1).alias("page"), F.col("txn_date").cast("string").alias("date"), "description", F.col("amount").alias("price"), "currency", none.cast("decimal(18,2)").alias("original_price"), none.cast("string").alias("original_currency"), none.cast("int").alias("installment_current"), none.cast("int").alias("installment_total"), "direction", "confidence")
    zero = F.lit(0).cast("decimal(18,2)")
    heads = rows.groupBy("input_id").agg(F.count(F.lit(1)).alias("transaction_count"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence_count"), F.avg("confidence").alias("average_confidence"), F.sum("price").alias("total_debit"))
    return rows, heads.select("*", zero.alias("total_credit"), F.lit("TRY").alias("document_currency"), F.col("transaction_count").alias("total_lines"), F.col("transaction_count").alias("candidate_line_count"), F.array().cast("array<string>").alias("rejected_lines"), F.array(F.lit("w")).alias("warnings"))


@query("normalize_latest_extraction", f"""{TXN}, docs as (select input_id, cast(substr(input_id, 6) as bigint) as k, max(case when seq % 2 = 0 then 1 else 0 end) as old from txn group by input_id), used as (select t.*, 1 as extra from txn t join docs using (input_id) where k % 3 <> 0 or seq % 2 = 0 union all select t.*, 2 from txn t join docs using (input_id) where k % 3 <> 0 and seq % 5 = 0),
 kept as (select input_id, txn_date, description, amount, direction, max(confidence) as confidence, count(*) as n from used group by all), sc as (select *, cast(round(round(confidence * 0.40e0 + (0.8e0 + (case when description like 'TRENDYOL%' then 0.98e0 else 0.9e0 end) * 0.20e0) * 0.25e0 + 0.20e0 + 0.15e0, 10), 4) as double) as score from kept)
select input_id, count(*) as transaction_count, cast(sum(n) - count(*) as bigint) as duplicate_removed_count, sum(case when direction = 'debit' then amount else 0 end)::double as total_debit, sum(case when direction = 'debit' then amount else -amount end)::double as net_amount, 'TRY' as currencies,
 round(round(avg(score), 10), 4) as overall_confidence, count(*) filter (score < 0.70) as low_confidence_count, 'w' || case when sum(n) > count(*) then ',duplicates_removed:' || cast(sum(n) - count(*) as bigint) else '' end as warnings from sc group by input_id""")
def normalize_latest_extraction(spark, d):
    """An old extraction of half a document's rows, and for two of three documents a later one of all, some rows of it twice; half of the later ones keep their rows under `result`."""
    t = txn(spark, d)
    k = F.substring("input_id", 6, 20).cast("long")
    old = L.extraction_records(*extracted(t.where("seq % 2 = 0")), F.lit("2024-01-01 00:00:00"))
    now = t.where(k % 3 != 0)
    twice = now.unionByName(now.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 10**12))
    later = L.extraction_records(*extracted(twice), F.lit("2024-02-01 00:00:00")).withColumn("result", F.when(k % 3 == 1, F.concat(F.lit('{"result":'), "result", F.lit("}"))).otherwise(F.col("result")))
    records = kept(old.unionByName(later), "extractions")  # the table that both extractions were appended to
    s = L.normalize_latest(records, F.lit("2024-03-01 00:00:00"))["records"].where("part = 0")
    facts = F.from_json("result", "summary struct<total_debit: decimal(18,2), net_amount: decimal(18,2), currencies: array<string>>")["summary"]
    return s.withColumn("f", facts).select("input_id", "transaction_count", "duplicate_removed_count", money("f.total_debit").alias("total_debit"), money("f.net_amount").alias("net_amount"), F.array_join("f.currencies", ",").alias("currencies"), "overall_confidence", "low_confidence_count", F.array_join("warnings", ",").alias("warnings"))


MESSAGES = """select cast(event_id as string) as message_id, case when event_id % 97 <> 0 then cast(user_id as string) end as input_id, ts as at, case when event_id % 4 = 0 then 'queued' when event_id % 41 = 0 then 'odd' else 'prepared' end as stage,
 case event_id % 7 when 0 then 'real_pdf' when 1 then 'scanned_pdf' when 2 then 'screenshot' when 3 then 'camera_photo' when 4 then 'unknown' when 5 then null else 'hybrid_pdf' end as kind,
 case when event_id % 5 <> 0 then array(named_struct('page', 1, 'ord', 0, 'variant', 'a', 'is_candidate', false, 'operations', array('x'), 'readiness', 0.9D), named_struct('page', 1, 'ord', 1, 'variant', 'b', 'is_candidate', true, 'operations', array('x'), 'readiness', event_id % 10 / 20.0D)) end as outputs,
 case when event_id % 11 = 0 then 'boom' end as error from {events}"""


@query("worker_status", """with m as (select event_id, cast(user_id as varchar) as input_id, epoch_us(ts) // 1000 as at_ms, event_id % 4 = 0 as queued, event_id % 7 as k, case when event_id % 11 = 0 then 'boom' when event_id % 7 = 5 then 'missing_classification_kind' when event_id % 4 <> 0 and event_id % 41 = 0 then 'unknown_stage' end as reason, event_id % 5 <> 0 as made, round((0.9e0 + event_id % 10 / 20.0e0) / 2, 4) as mean from events where event_id % 97 <> 0),
 s as (select *, case when reason is not null then 'preprocessing_failed' when queued then 'preprocessing' when k = 0 or (k <> 4 and made and mean >= 0.35) then 'preprocessed' else 'preprocessing_needs_review' end as status from m), n as (select *, count(*) over (partition by input_id) as attempts from s)
select input_id, cast(event_id as varchar) as message_id, at_ms, status, reason, case when status in ('preprocessed', 'preprocessing_needs_review') then case when k = 0 then 'original_pdf' when made then 'b' end end as preferred, attempts from n qualify row_number() over (partition by input_id order by at_ms desc, cast(event_id as varchar) desc) = 1""")
def worker_status(spark, d):
    """What the stateful worker's table is after all messages."""
    return W.batch_statuses(spark.sql(MESSAGES.format(events="{events}"), events=S.table(spark, d, "events")))


@query("input_status", "select cast(event_id as varchar) as input_id, case when event_id % 11 = 0 then 'preprocessing_failed' when event_id % 3 = 0 then 'preprocessed' else 'preprocessing_needs_review' end as status from events")
def input_status(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_id").cast("string").alias("input_id"), F.when(F.col("event_id") % 11 == 0, "boom").alias("error"), F.when(F.col("event_id") % 5 != 1, F.col("event_id") % 3 == 0).alias("is_ready"), "event_id")
    return X.input_status(rows.withColumn("is_ready", F.when(F.col("event_id") % 3 == 0, True).otherwise(F.col("is_ready"))))


@query("bucketed_gate", """with c as (select cast(o_custkey as varchar) as input_id, o_orderkey as id, o_orderdate, o_totalprice, o_orderstatus from orders), x as (select * from c where o_orderstatus <> 'P' qualify row_number() over (partition by input_id order by o_orderdate desc, id desc) = 1), n as (select * from c where o_orderstatus = 'P' qualify row_number() over (partition by input_id order by o_orderdate desc, id desc) = 1)
select x.input_id, x.id, coalesce(n.o_totalprice > 100000, false) as ready from x left join n using (input_id)""")
def bucketed_gate(spark, d):
    """Orders as records of two stages: the latest of one, and whether the latest of the other lets it through; the second stage is written twice, the second time in the place of the first."""
    rows = S.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("input_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    store = B.BucketStore(spark, "id bigint, at timestamp, value double")
    store.put(rows.where("o_orderstatus != 'P'"), "extraction")
    store.put(rows.where("o_orderstatus = 'P'").withColumn("value", F.lit(0.0)), "normalization")
    store.put(rows.where("o_orderstatus = 'P'"), "normalization", replace=True)
    return store.gate("extraction", "normalization", "value > 100000", "at", "id").select("input_id", "id", "ready")
