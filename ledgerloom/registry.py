"""Queries of the statement-analytics operators over the driver's tables, and the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import analytics as A
from .operators import classify as C
from .operators import normalize as N
from .operators import parse as P
from .operators import preprocess as X
from .operators import records as R
from .operators import report
from .sources import tables as S
from .streaming import ingest as I

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracles.
TXN = f"with txn as ({S.TRANSACTION_SQL.format(orders='orders')})"
RULE = """case when description = 'TRENDYOL YEMEK' then 'food' when description like 'MIGROS%' then 'groceries' when description like 'SHELL%' then 'fuel'
 when description like 'TURKCELL%' then 'telecom' when description like 'AMAZON%' then 'shopping' else 'other' end"""
CAT = f"{TXN}, cat as (select *, case when direction = 'credit' then 'income_or_refund' else {RULE} end as category from txn)"
FEAT = """, feat as (select *, coalesce(installment_total > 1, false) as has_installment, coalesce(original_currency <> currency, false) as is_foreign, confidence < 0.7 as is_low,
 isodow(txn_date) >= 6 as is_weekend from txn)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def txn(spark: SparkSession, d: str) -> DataFrame:
    return S.transactions(spark, d)


def money(c: str):
    return F.col(c).cast("double")


@query("category_summary", f"""{CAT}, s as (select input_id, category, count(*) as transaction_count, sum(amount) as t from cat where direction = 'debit' group by all)
select input_id, category, transaction_count, cast(t as double) as total_amount, round(cast(t as double) / cast(sum(t) over (partition by input_id) as double), 4) as share_of_spend from s""")
def category_summary(spark, d):
    return A.category_summary(A.categorized(txn(spark, d))).withColumn("total_amount", money("total_amount"))


@query("category_method_counts", f"{CAT} select case when direction = 'credit' then 'direction' when category = 'other' then 'fallback' else 'rule' end as method, category, count(*) as n from cat group by all")
def category_method_counts(spark, d):
    return A.categorized(txn(spark, d)).groupBy("method", "category").agg(F.count(F.lit(1)).alias("n"))


@query("regex_theta_join_first_match", f"{TXN} select input_id, seq, {RULE} as category from txn")
def regex_theta_join(spark, d):
    return A.first_rule_by_join(txn(spark, d), S.taxonomy(spark))


@query("txn_features", f"""{TXN}{FEAT} select input_id, seq, strftime(date_trunc('month', txn_date), '%Y-%m-%d') as month, cast(isodow(txn_date) - 1 as int) as weekday, is_weekend,
 cast(case when direction = 'debit' then amount else 0 end as double) as spend, cast(case when direction = 'credit' then -amount else amount end as double) as signed_amount,
 round(ln(1 + cast(amount as double)), 6) as log_amount, has_installment, is_foreign as is_foreign_currency, is_low as is_low_confidence, validation_status = 'invalid' as is_invalid from feat""")
def txn_features(spark, d):
    f = A.features(txn(spark, d))
    return f.select("input_id", "seq", F.date_format("month", "yyyy-MM-dd").alias("month"), F.col("weekday").cast("int").alias("weekday"), "is_weekend", money("spend").alias("spend"), money("signed_amount").alias("signed_amount"), F.round("log_amount", 6).alias("log_amount"), "has_installment", "is_foreign_currency", "is_low_confidence", "is_invalid")


@query("debit_credit_summary", f"""{TXN} select input_id, count(*) as transaction_count, cast(sum(case when direction = 'debit' then amount else 0 end) as double) as total_debit,
 cast(sum(case when direction = 'credit' then amount else 0 end) as double) as total_credit, count(*) filter (validation_status = 'invalid') as invalid_count, count(*) filter (validation_status = 'warning') as warning_count from txn group by input_id""")
def debit_credit_summary(spark, d):
    s = N.summary(txn(spark, d).withColumnRenamed("txn_date", "date"))
    return s.select("input_id", "transaction_count", money("total_debit").alias("total_debit"), money("total_credit").alias("total_credit"), "invalid_count", "warning_count")


@query("distinct_currencies", f"{TXN} select input_id, array_to_string(list_sort(list_distinct(list(coalesce(original_currency, currency)))), ',') as currencies from txn group by input_id")
def distinct_currencies(spark, d):
    rows = txn(spark, d).withColumn("currency", F.coalesce("original_currency", "currency")).withColumnRenamed("txn_date", "date")
    return N.summary(rows).select("input_id", F.array_join("currencies", ",").alias("currencies"))


@query("primary_currency_mode", f"""{TXN}, c as (select input_id, coalesce(original_currency, currency) as cur, count(*) as n, min((txn_date, description, amount)) as f from txn group by all)
select input_id, cur as primary_currency from c qualify row_number() over (partition by input_id order by n desc, f, cur) = 1""")
def primary_currency_mode(spark, d):
    rows = txn(spark, d).withColumn("currency", F.coalesce("original_currency", "currency")).withColumnRenamed("txn_date", "date")
    return N.primary_currency(rows)


DUP = f"{TXN}, dup as (select * from txn union all select input_id, seq + 1000000000, txn_date, description, amount, currency, original_currency, direction, installment_total, case when seq % 2 = 0 then confidence + 0.005 else confidence end, validation_status from txn where seq % 3 = 0)"


def doubled(spark, d) -> DataFrame:
    rows = txn(spark, d)
    again = rows.where("seq % 3 = 0").withColumn("confidence", F.expr("case when seq % 2 = 0 then confidence + 0.005 else confidence end")).withColumn("seq", F.col("seq") + 1000000000)
    return rows.unionByName(again)


@query("dedup_keep_best", f"""{DUP} select input_id, seq, strftime(txn_date, '%Y-%m-%d') as date, cast(amount as double) as amount, round(confidence, 4) as confidence from dup
qualify row_number() over (partition by input_id, txn_date, description, amount, currency, direction order by confidence desc, seq) = 1""")
def dedup_keep_best(spark, d):
    rows = doubled(spark, d).withColumnRenamed("txn_date", "date").withColumn("merchant", F.col("description"))
    return N.keep_best(rows).select("input_id", "seq", F.date_format("date", "yyyy-MM-dd").alias("date"), money("amount").alias("amount"), F.round("confidence", 4).alias("confidence"))


@query("union_dedup_keep_last", f"""{TXN}, u as (select *, 0 as role, seq // 2 as k from txn where seq % 4 <> 0 union all select *, 1, seq // 2 from txn where seq % 3 <> 0)
select input_id, k as transaction_key, seq, role from u qualify row_number() over (partition by input_id, k order by role desc, seq desc) = 1""")
def union_dedup_keep_last(spark, d):
    rows = txn(spark, d).withColumn("transaction_key", F.expr("seq div 2"))
    out = A.union_keep_last(rows.where("seq % 4 <> 0").withColumn("role", F.lit(0)), rows.where("seq % 3 <> 0").withColumn("role", F.lit(1)), "transaction_key")
    return out.select("input_id", "transaction_key", "seq", "role")


@query("transaction_id_hash", f"{TXN} select input_id, seq, 'txn_' || substr(sha256(concat_ws('|', strftime(txn_date, '%Y-%m-%d'), case when description like 'TRENDYOL%' then 'TRENDYOL' else description end, cast(amount as varchar), currency, direction)), 1, 16) as transaction_id from txn")
def transaction_id_hash(spark, d):
    return txn(spark, d).select("input_id", "seq", N.transaction_id(F.col("txn_date"), T.merchant_name(F.col("description")), F.col("amount"), F.col("currency"), F.col("direction")).alias("transaction_id"))


@query("merchant_alias", f"""{TXN} select description, case when description like '%TRENDYOL%' then 'TRENDYOL' else description end as merchant, case when description like '%TRENDYOL%' then 0.98e0 else 0.9e0 end as confidence, count(*) as n from txn group by all""")
def merchant_alias(spark, d):
    name = T.merchant_name(F.col("description"))
    return txn(spark, d).select("description", name.alias("merchant"), T.merchant_confidence(F.col("description"), name).alias("confidence")).groupBy("description", "merchant", "confidence").agg(F.count(F.lit(1)).alias("n"))


RAW = """raw as (select input_id, seq, case when seq % 11 = 0 then '31.02.2024' when seq % 2 = 0 then strftime(txn_date, '%d.%m.%Y') else strftime(txn_date, '%Y-%m-%d') end as date_text,
 case when seq % 13 = 0 then null when seq % 17 = 0 then 0 else amount end as amount, case when seq % 5 = 0 then 'TL' when seq % 19 = 0 then 'XQQ' when seq % 23 = 0 then null else 'TRY' end as currency,
 case when seq % 29 = 0 then 'A' else description end as description, direction, confidence, case when seq % 7 = 0 then 9 end as current, installment_total as total from txn)"""


def raw(spark, d) -> DataFrame:
    return txn(spark, d).select("input_id", "seq", F.expr("case when seq % 11 = 0 then '31.02.2024' when seq % 2 = 0 then date_format(txn_date, 'dd.MM.yyyy') else date_format(txn_date, 'yyyy-MM-dd') end").alias("date"), F.expr("case when seq % 13 = 0 then null when seq % 17 = 0 then 0 else amount end").alias("amount"), F.expr("case when seq % 5 = 0 then 'TL' when seq % 19 = 0 then 'XQQ' when seq % 23 = 0 then null else 'TRY' end").alias("currency"), F.expr("case when seq % 29 = 0 then 'A' else description end").alias("description"), "direction", "confidence", F.expr("case when seq % 7 = 0 then 9 end").alias("installment_current"), F.col("installment_total"))


WARN = f"""{TXN}, {RAW}, w as (select *, concat_ws(',', case when seq % 11 = 0 then 'missing_or_invalid_date' end, case when amount is null then 'missing_amount' when amount <= 0 then 'non_positive_amount' end,
 case when currency is null then 'missing_currency' when currency = 'XQQ' then 'invalid_currency' end, case when length(description) < 2 then 'missing_or_short_description' end, case when current > total then 'invalid_installment_current_gt_total' end) as warnings from raw),
st as (select *, case when seq % 11 = 0 or coalesce(amount, 0) <= 0 then 'invalid' when warnings <> '' then 'warning' else 'valid' end as validation_status from w)"""


@query("validate_warnings", f"{WARN} select input_id, seq, warnings, validation_status from st")
def validate_warnings(spark, d):
    return N.normalized(raw(spark, d)).select("input_id", "seq", F.array_join("warnings", ",").alias("warnings"), "validation_status")


SCORE = f"""{WARN}, sc as (select input_id, seq, validation_status, confidence * 0.40e0 + ((case when seq % 11 = 0 then 0.0e0 else 0.25e0 end) + 0.25e0 + 0.15e0 + 0.15e0 + (case when description like '%TRENDYOL%' then 0.98e0 when length(description) < 3 then 0.7e0 else 0.9e0 end) * 0.20e0) * 0.25e0
 + (case when seq % 11 = 0 then 0.8e0 else 1.0e0 end) * 0.20e0 + (case validation_status when 'valid' then 1.0e0 when 'warning' then 0.65e0 else 0.25e0 end) * 0.15e0 as s from st)"""


@query("row_scores", f"{SCORE} select input_id, seq, cast(round(cast(s as decimal(18,10)), 4) as double) as score, validation_status from sc")
def row_scores(spark, d):
    return N.scores(N.normalized(raw(spark, d))).select("input_id", "seq", "score", "validation_status")


@query("score_summary", f"{SCORE} select input_id, count(*) filter (validation_status = 'invalid') as invalid_count, count(*) filter (validation_status = 'warning') as warning_count, count(*) filter (validation_status = 'invalid') = 0 as validation_passed, cast(round(cast(avg(cast(round(cast(s as decimal(18,10)), 4) as double)) as decimal(18,10)), 4) as double) as overall_confidence from sc group by input_id")
def score_summary(spark, d):
    return N.score_summary(N.scores(N.normalized(raw(spark, d)))).select("input_id", "invalid_count", "warning_count", "validation_passed", "overall_confidence")


@query("profile_labels", f"""{CAT}{FEAT.replace('from txn', 'from cat')}, p as (select input_id, count(*) as n, round(count(*) filter (has_installment) / count(*), 4) as ir, round(count(*) filter (is_foreign) / count(*), 4) as fr, round(cast(sum(amount) as double) / count(*), 2) as av, cast(max(amount) as double) as mx from feat where direction = 'debit' group by input_id),
 c as (select input_id, category, sum(amount) as t, round(cast(sum(amount) as double) / cast(sum(sum(amount)) over (partition by input_id) as double), 4) as sh from cat where direction = 'debit' group by input_id, category qualify row_number() over (partition by input_id order by t desc, category) = 1),
 l as (select input_id, concat_ws(',', case when sh >= 0.40 then (case category when 'food' then 'Yeme İçme' when 'groceries' then 'Market' when 'fuel' then 'Akaryakıt' when 'telecom' then 'İletişim' when 'shopping' then 'Alışveriş' else 'Diğer' end) || '_heavy_spender' end, case when ir >= 0.35 then 'installment_heavy_spender' end, case when fr >= 0.20 then 'international_spender' end, case when mx >= av * 3 and n >= 3 then 'large_purchase_sensitive' end) as labels, n, ir, fr from p join c using (input_id))
select input_id, case when labels = '' then 'balanced_spender' else labels end as labels, n, ir as installment_ratio, fr as foreign_ratio from l""")
def profile_labels(spark, d):
    p = A.profile(A.categorized(A.features(txn(spark, d))))
    return p.select("input_id", F.array_join("labels", ",").alias("labels"), "n", "installment_ratio", "foreign_ratio")


FLAGS = ", fl as (select *, cast(amount as double) as x, (case when is_foreign then 0.12 else 0 end) + (case when has_installment then 0.05 else 0 end) + (case when is_low then 0.18 else 0 end) + (case when validation_status <> 'valid' then 0.18 else 0 end) as bonus from feat where direction = 'debit')"
ROBUST = f"""{TXN}{FEAT}{FLAGS}, m as (select *, median(x) over (partition by input_id) as med, count(*) over (partition by input_id) as n from fl), a as (select *, median(abs(x - med)) over (partition by input_id) as mad from m),
 z as (select *, case when mad > 0 then abs(x - med) / (mad * 1.4826) end as z from a), s as (select *, least(1.0, bonus + case when mad > 0 and z >= 3.5 then least(0.70, z / 10) when mad = 0 and n >= 3 and x > med * 3 then 0.55 else 0 end) as score from z)"""


@query("robust_mad_anomaly", f"{ROBUST} select input_id, seq, round(cast(score as double), 4) as score from s where cast(score as double) >= 0.25")
def robust_mad_anomaly(spark, d):
    return A.robust_anomalies(A.features(txn(spark, d))).select("input_id", "seq", "score")


TAIL = "greatest(-ln(cume_dist() over (partition by input_id order by {c})), -ln(cume_dist() over (partition by input_id order by {c} desc)))"
ECDF = f"""{TXN}{FEAT}{FLAGS}, many as (select input_id from fl group by input_id having count(*) >= 8), both_ as (select *, 0 as now, ln(1 + x) as lg from fl semi join many using (input_id) union all select *, 1, ln(1 + x) from fl semi join many using (input_id)),
 t as (select *, {' + '.join(TAIL.format(c=c) for c in ('lg', 'cast(has_installment as int)', 'cast(is_foreign as int)', 'cast(is_low as int)', 'cast(is_weekend as int)'))} as r from both_), r as (select *, round(r, 9) as raw from t where now = 1),
 mm as (select *, min(raw) over (partition by input_id) as lo, max(raw) over (partition by input_id) as hi from r), s as (select *, least(1.0, (case when hi > lo then (raw - lo) / (hi - lo) else 0 end) + cast(bonus as double)) as score from mm)"""


def ecdf(spark, d) -> DataFrame:
    rows = A.features(txn(spark, d))
    many = rows.where("direction = 'debit'").groupBy("input_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 8").select("input_id")
    rows = rows.join(many, "input_id", "left_semi")
    return A.ecdf_anomalies(rows, rows)


@query("ecdf_anomaly", f"{ECDF} select input_id, seq, round(score, 4) as score from s where score >= 0.40")
def ecdf_anomaly(spark, d):
    return ecdf(spark, d).select("input_id", "seq", "score")


@query("severity_histogram", f"{ROBUST} select case when score >= 0.70 then 'high' when score >= 0.45 then 'medium' else 'low' end as severity, count(*) as n from (select round(cast(score as double), 4) as score from s where cast(score as double) >= 0.25) group by all")
def severity_histogram(spark, d):
    return A.robust_anomalies(A.features(txn(spark, d))).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


MONTHLY = f"""{TXN}, sp as (select input_id, currency, date_trunc('month', txn_date) as m, cast(sum(amount) as double) as spend from txn where direction = 'debit' and validation_status <> 'invalid' group by all),
 span as (select input_id, currency, min(m) as a, max(m) as b from sp group by all), cal as (select input_id, currency, unnest(generate_series(a::timestamp, b::timestamp, interval 1 month)) as m from span),
 mon as (select cal.input_id, cal.currency, cal.m, coalesce(sp.spend, 0) as spend from cal left join sp on cal.input_id = sp.input_id and cal.currency = sp.currency and cal.m = sp.m::timestamp)"""


@query("monthly_spend_gapfill", f"{MONTHLY} select input_id, currency, strftime(m, '%Y-%m-%d') as month, spend from mon")
def monthly_spend_gapfill(spark, d):
    return A.monthly_spend(A.features(txn(spark, d))).select("input_id", "currency", F.date_format("month", "yyyy-MM-dd").alias("month"), "spend")


FORE = f"""{MONTHLY}, r as (select *, row_number() over (partition by input_id order by m desc) as r, count(*) over (partition by input_id) as n from mon),
 f as (select input_id, currency, max(n) as months, sum(greatest(least(n, 6) - r + 1, 0) * spend) / sum(greatest(least(n, 6) - r + 1, 0)) as wa, min(spend) as lo, max(spend) as hi from r group by all),
 fc as (select *, round(case when hi <= 0 then 0 else least(greatest(wa, lo * 0.5), hi * 1.5) end, 2) as predicted from f)"""


@query("weighted_moving_average", f"{FORE} select input_id, months, round(wa, 2) as weighted_average from fc")
def weighted_moving_average(spark, d):
    return A.forecast(A.monthly_spend(A.features(txn(spark, d)))).select("input_id", "months", "weighted_average")


@query("forecast_clamped", f"{FORE} select input_id, predicted, round(least(0.35 + months * 0.06, 0.65), 4)::double as confidence from fc")
def forecast_clamped(spark, d):
    return A.forecast(A.monthly_spend(A.features(txn(spark, d)))).select("input_id", "predicted", "confidence")


OPT = f"{FORE}, o as (select input_id, currency, months_ as months, round(50000.0 / months_, 2)::double as monthly_amount, predicted from fc, (select unnest(generate_series(1, 12)) as months_)), opt as (select *, case when predicted > 0 then monthly_amount / predicted end as b from o)"


def options(spark, d) -> DataFrame:
    f = A.forecast(A.monthly_spend(A.features(txn(spark, d))))
    return A.installment_options(f, f.select("input_id", F.lit(50000.0).alias("amount"), "currency", F.lit(12).alias("max_months")))


@query("installment_options", f"{OPT} select input_id, months::int as months, monthly_amount, round(b, 4) as burden_ratio, case when b <= 0.15 then 'low' when b <= 0.30 then 'medium' else 'high' end as risk_level from opt")
def installment_options(spark, d):
    return options(spark, d).drop("currency")


@query("installment_recommended", f"{OPT}, k as (select *, case when b <= 0.15 then 0 else 1 end as worse from opt) select input_id, months::int as recommended_months, monthly_amount from k qualify row_number() over (partition by input_id order by worse, case when worse = 0 then months else -months end) = 1")
def installment_recommended(spark, d):
    return A.recommended(options(spark, d)).select("input_id", "recommended_months", "monthly_amount")


@query("quality_penalty", f"""{TXN}, q as (select input_id, avg(confidence) as o, count(*) as n, count(*) filter (confidence < 0.7e0) as lo, count(*) filter (validation_status = 'invalid') as iv from txn group by input_id)
select input_id, n - iv as usable, lo as low_count, iv as invalid_count, cast(round(cast(greatest(0.0e0, least(1.0e0, cast(round(cast(o as decimal(18,10)), 4) as double) - lo / n * 0.20e0 - iv / n * 0.35e0)) as decimal(18,10)), 4) as double) as analysis_confidence from q""")
def quality_penalty(spark, d):
    return A.quality(txn(spark, d)).select("input_id", "usable", "low_count", "invalid_count", "analysis_confidence")


@query("latest_record_per_key", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_record_per_key(spark, d):
    return R.latest(S.table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("gate_semi_anti_join", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as ready from customer")
def gate_semi_anti_join(spark, d):
    good, bad = R.ready(S.table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), S.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", "o_orderstatus = 'P'")
    return good.select(F.col("k").alias("c_custkey"), F.lit(True).alias("ready")).unionAll(bad.select("k", F.lit(False)))


@query("statement_line_roundtrip", f"{TXN} select input_id, seq, strftime(txn_date, '%Y-%m-%d') as date, description || case when direction = 'credit' then ' IADE' else '' end as description, cast(amount as double) as amount, 'TRY' as currency, direction, case when installment_total is not null then 1 end::int as current, installment_total::int as total, case when installment_total is not null then 0.98 else 0.95 end::double as confidence from txn")
def statement_line_roundtrip(spark, d):
    found, _ = P.extract(S.statement_lines(txn(spark, d)))
    return found.select("input_id", F.col("line_no").alias("seq"), F.date_format("date", "yyyy-MM-dd").alias("date"), "description", F.col("price").alias("amount"), "currency", "direction", "installment.current", "installment.total", "confidence")


@query("candidate_line_merge", f"""{TXN}, t as (select input_id, seq, strftime(txn_date, '%d/%m/%Y') as dt, description, replace(cast(amount as varchar), '.', ',') || ' TL' as a from txn)
select input_id, min(seq * 2) as line_no, dt || ' ' || description as text, 0 as merged from t group by input_id, text union all select input_id, seq * 2, dt || ' ' || description || ' ' || a, 1 from t union all select input_id, min(seq * 2 + 1), a, 0 from t group by input_id, a""")
def candidate_line_merge(spark, d):
    t = txn(spark, d)
    amount = F.concat(F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")), F.lit(" TL"))
    two = F.array(F.struct((F.col("seq") * 2).alias("line_no"), F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "description").alias("text")), F.struct((F.col("seq") * 2 + 1).alias("line_no"), amount.alias("text")))
    lines = t.select("input_id", F.lit(1).alias("page"), F.explode(two).alias("l")).select("input_id", "l.line_no", "page", "l.text")
    return P.candidates(lines).select("input_id", "line_no", "text", "merged")


@query("money_parse", f"{TXN} select input_id, seq, cast(amount as double) as plain, cast(amount as double) as european, -cast(amount as double) as negative, floor(cast(amount as double)) as thousands from txn")
def money_parse(spark, d):
    t, a = txn(spark, d), F.col("amount")
    us = F.format_number(a, 2)
    eu = F.translate(us, ",.", ".,")
    whole = F.replace(F.format_number(F.floor(a), 0), F.lit(","), F.lit("."))
    return t.select("input_id", "seq", T.money_number(us).alias("plain"), T.money_number(eu).alias("european"), T.money_number(F.concat(F.lit("-"), eu)).alias("negative"), F.when(a < 1000, F.floor(a).cast("double")).otherwise(T.money_number(whole)).alias("thousands"))


@query("date_parse", f"{TXN} select input_id, seq, strftime(txn_date, '%Y-%m-%d') as dotted, strftime(txn_date, '%Y-%m-%d') as iso, strftime(txn_date, '%Y-%m-%d') as named, cast(null as varchar) as impossible from txn")
def date_parse(spark, d):
    months = ["Ocak", "Subat", "Mart", "Nisan", "Mayis", "Haziran", "Temmuz", "Agustos", "Eylul", "Ekim", "Kasim", "Aralik"]
    name = F.element_at(F.array(*(F.lit(m) for m in months)), F.month("txn_date"))
    out = lambda c: F.date_format(T.find_date(c)["date"], "yyyy-MM-dd")
    return txn(spark, d).select("input_id", "seq", out(F.concat(F.lit("x "), F.date_format("txn_date", "dd.MM.yyyy"))).alias("dotted"), out(F.concat(F.date_format("txn_date", "yyyy-MM-dd"), F.lit(" y"))).alias("iso"), out(F.concat_ws(" ", F.dayofmonth("txn_date"), name, F.year("txn_date"))).alias("named"), out(F.concat(F.lit("31.02."), F.year("txn_date"))).alias("impossible"))


@query("direction_keywords", "select conv_id, turn, case when contains(lower(text), 'iade') or contains(lower(text), 'alacak') or contains(lower(text), 'refund') or contains(lower(text), 'cashback') or contains(lower(text), 'odeme') or contains(lower(text), 'ödeme') then 'credit' else 'debit' end as direction from conversations")
def direction_keywords(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.direction(F.col("text")).alias("direction"))


@query("document_currency_mode", f"{TXN}, c as (select input_id, case when seq % 3 = 0 then 'USD' else 'TRY' end as cur, count(*) as n, min(seq) as f from txn group by all) select input_id, cur as document_currency from c qualify row_number() over (partition by input_id order by n desc, f) = 1")
def document_currency_mode(spark, d):
    lines = txn(spark, d).select("input_id", F.col("seq").alias("line_no"), F.expr("concat('12,50 ', case when seq % 3 = 0 then 'USD' else '₺' end)").alias("text"))
    return P.document_currency(lines)


PAGES = """select cast(l_orderkey as varchar) as input_id, l_linenumber as page, cast(l_quantity * 12 as int) as char_count, cast(l_quantity * 2 as int) as word_count, l_discount * 10 as image_area, 1.0 as page_area from lineitem"""


@query("pdf_kind_decision", f"""with p as ({PAGES}), f as (select input_id, avg(char_count) as c, avg(case when char_count >= 80 then 1.0 else 0 end) as t, avg(case when image_area >= 0.65 then 1.0 else 0 end) as i, sum(image_area) / count(*) as g from p group by input_id)
select input_id, case when c >= 300 and t >= 0.6 then 'real_pdf' when c < 80 and i >= 0.6 then 'scanned_pdf' when t > 0.15 and i > 0.15 then 'hybrid_pdf' when g > 0.5 and c < 150 then 'scanned_pdf' else 'unknown' end as kind from f""")
def pdf_kind_decision(spark, d):
    pages = S.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("input_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 12).cast("int").alias("char_count"), (F.col("l_quantity") * 2).cast("int").alias("word_count"), (F.col("l_discount") * 10).alias("image_area"), F.lit(1.0).alias("page_area"))
    return C.pdf_features(pages).select("input_id", C.pdf_kind()["kind"].alias("kind"))


IMAGES = """select p_partkey, case p_partkey % 3 when 0 then 'image/png' when 1 then 'image/jpeg' else 'image/webp' end as mime, p_partkey % 5 = 0 as exif_present, cast(case when p_partkey % 5 = 0 then p_partkey % 4 else 0 end as int) as camera_exif_tag_count,
 cast(700 + p_partkey % 700 as int) as width, cast(1300 + p_partkey % 1900 as int) as height, cast(p_size * 30 as double) as blur_score, p_size / 400.0 as edge_density, p_partkey % 7 = 0 as has_document_contour, p_size / 100.0 as max_contour_area_ratio, p_size / 200.0 as axis_aligned_line_score from {part}"""


@query("image_kind_votes", f"""with im as ({IMAGES.format(part='part')}), v as (select p_partkey, cast((case when mime in ('image/png', 'image/webp') then 1.5 else 0 end) + (case when camera_exif_tag_count < 2 and exif_present and camera_exif_tag_count = 0 then 0.5 else 0 end) + (case when not exif_present then 0.7 else 0 end)
 + (case when edge_density >= 0.10 then 0.7 else 0 end) + (case when least(width, height) >= 720 and least(width, height) < 1300 and greatest(width, height) >= 1400 and greatest(width, height) < 3000 then 0.8 else 0 end) + (case when blur_score >= 1000 then 2.0 when blur_score >= 500 then 1.2 else 0 end)
 + (case when axis_aligned_line_score >= 0.20 then 1.5 when axis_aligned_line_score >= 0.08 then 0.8 else 0 end) + (case when round(width / height, 4) between 0.40 and 0.60 then 1.2 when round(width / height, 4) between 1.7 and 2.4 then 1.0 else 0 end) as double) as s,
 cast((case when mime = 'image/jpeg' then 0.8 else 0 end) + (case when camera_exif_tag_count >= 2 then 3.0 else 0 end) + (case when blur_score < 150 then 1.0 else 0 end) + (case when has_document_contour then 2.5 else 0 end) + (case when max_contour_area_ratio >= 0.35 then 1.0 else 0 end) as double) as k from im)
select p_partkey, round(s, 4) as screenshot_score, round(k, 4) as camera_score, case when round(s, 6) > round(k, 6) then 'screenshot' else 'camera_photo' end as kind from v""")
def image_kind_votes(spark, d):
    rows = C.image_kind(spark.sql(IMAGES.format(part="{part}"), part=S.table(spark, d, "part")))
    return rows.select("p_partkey", F.round("screenshot_score", 4).alias("screenshot_score"), F.round("camera_score", 4).alias("camera_score"), F.when(F.round("screenshot_score", 6) > F.round("camera_score", 6), "screenshot").otherwise("camera_photo").alias("kind"))


READY = """select p_partkey, cast(p_size * 15 as double) as blur_score, cast(60 + p_partkey % 200 as double) as brightness, cast(p_partkey % 110 as double) as contrast, p_size / 200.0 as foreground_density, cast(p_partkey % 120 as int) as component_count,
 cast(p_partkey % 500 as double) as avg_component_area, p_size / 250.0 as border_artifact_score, p_size / 160.0 as edge_density, (p_partkey % 50) / 100.0 as dark_pixel_ratio, (p_partkey % 90) / 100.0 as bright_pixel_ratio from {part}"""


@query("ocr_readiness_score", f"""with r as ({READY.format(part='part')}) select p_partkey, round(cast(greatest(0, least(1, (case when blur_score >= 500 then 0.20 when blur_score >= 180 then 0.12 else 0.04 end) + (case when brightness between 80 and 235 then 0.15 else 0.06 end) + (case when contrast between 30 and 95 then 0.20 else 0.08 end)
 + (case when foreground_density between 0.01 and 0.22 then 0.20 else 0.07 end) + (case when component_count >= 80 then 0.15 when component_count >= 20 then 0.08 else 0 end) + (case when avg_component_area between 3 and 400 then 0.10 else 0.04 end) + (case when border_artifact_score <= 0.08 then 0.10 when border_artifact_score <= 0.18 then 0.04 else -0.08 end))) as double), 4) as readiness from r""")
def ocr_readiness_score(spark, d):
    return spark.sql(READY.format(part="{part}"), part=S.table(spark, d, "part")).select("p_partkey", F.round(C.readiness(), 4).alias("readiness"))


@query("image_quality_score", f"""with r as ({READY.format(part='part')}) select p_partkey, round(cast(least(1, (case when blur_score >= 500 then 0.25 when blur_score >= 200 then 0.15 else 0.05 end) + (case when brightness between 70 and 200 then 0.20 else 0.08 end) + (case when contrast >= 45 then 0.25 when contrast >= 25 then 0.15 else 0.05 end)
 + (case when edge_density between 0.02 and 0.25 then 0.20 else 0.08 end) + (case when dark_pixel_ratio < 0.35 and bright_pixel_ratio < 0.70 then 0.10 else 0.04 end)) as double), 4) as quality from r""")
def image_quality_score(spark, d):
    return spark.sql(READY.format(part="{part}"), part=S.table(spark, d, "part")).select("p_partkey", F.round(C.quality(), 4).alias("quality"))


VARIANTS = "select cast(l_orderkey as varchar(20)) as input_id, 1 as page, case l_linenumber % 4 when 0 then 'ocr_grayscale' when 1 then 'thresholded_bw' when 2 then 'original' else 'other' end as variant, 6 as psm, l_linenumber as ord, round(l_quantity, 0) as ocr_score, l_linenumber % 3 = 0 as is_preferred from {lineitem}"


@query("variant_select_top1", f"""with v as ({VARIANTS.format(lineitem='lineitem')}), s as (select *, round(ocr_score + (case when contains(variant, 'grayscale') then 100 when contains(variant, 'original') then 80 when contains(variant, 'threshold') then 55 else 60 end) / 100 + case when is_preferred then 0.15 else 0 end, 4) as f from v)
select input_id, variant, f as final_score from s qualify row_number() over (partition by input_id order by f desc, ord) = 1""")
def variant_select_top1(spark, d):
    rows = spark.sql(VARIANTS.format(lineitem="{lineitem}"), lineitem=S.table(spark, d, "lineitem"))
    return C.best_variant(rows).select("input_id", "variant", "final_score")


@query("ocr_words_to_lines", """with recursive w as (select l_orderkey as o, 'w' || l_partkey as text, cast(l_partkey % 500 as int) as x, cast(floor(l_quantity * 2) as int) as y, row_number() over (partition by l_orderkey order by cast(floor(l_quantity * 2) as int), l_partkey % 500, 'w' || l_partkey) as i from lineitem),
 s as (select o, i, y + 5.0e0 as total, 1 as n, 0 as g from w where i = 1 union all select w.o, w.i, case when abs(total / n - (y + 5.0e0)) <= 6 then total else 0 end + y + 5.0e0, case when abs(total / n - (y + 5.0e0)) <= 6 then n else 0 end + 1, g + case when abs(total / n - (y + 5.0e0)) <= 6 then 0 else 1 end from s join w on w.o = s.o and w.i = s.i + 1)
select cast(o as varchar) as input_id, 1 as page, 'original' as variant, 6 as psm, g as line_no, string_agg(text, ' ' order by x, i) as text, min(x) as x0, min(y) as y0, max(x) + 30 as x1, max(y) + 10 as y1, 0.9e0 as ocr_confidence, cast(count(*) as int) as word_count from s join w using (o, i) group by o, g""")
def ocr_words_to_lines(spark, d):
    """Words in the order of their tops: a word joins the last line if it is within 6 of its moving centre, which no earlier line can be nearer to."""
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("input_id"), F.lit(1).alias("page"), F.lit("original").alias("variant"), F.lit(6).alias("psm"), F.concat(F.lit("w"), F.col("l_partkey")).alias("text"), (F.col("l_partkey") % 500).cast("int").alias("left"), (F.col("l_quantity") * 2).cast("int").alias("top"), F.lit(30).alias("width"), F.lit(10).alias("height"), F.lit(90.0).alias("conf"))
    return P.words_to_lines(P.ocr_words(rows))


@query("cosine_topk", """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), refs as (select min(vec_id) as ref_id from e group by label), r as (select ref_id, v from refs join e on ref_id = vec_id),
 s as (select e.vec_id, ref_id, round(list_cosine_similarity(e.v, r.v), 6) as similarity from e, r) select vec_id, ref_id, round(similarity, 3) as similarity, cast(row_number() over (partition by vec_id order by similarity desc, ref_id) as int) as rank from s qualify rank <= 2""")
def cosine_topk(spark, d):
    e = S.table(spark, d, "embeddings")
    refs = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("ref_id"), "embedding"), "vec_id").alias("r")).select("r.*")
    return A.similar_categories(e, refs, floor=-1.0).withColumn("similarity", F.round("similarity", 3))


@query("intent_detect", """select conv_id, turn, case when contains(lower(text), 'kategori') or contains(lower(text), 'en çok') then 'category_question' when contains(lower(text), 'anomali') or contains(lower(text), 'şüpheli') then 'anomaly_question'
 when contains(lower(text), 'taksit') or contains(lower(text), 'kaç ay') then 'installment_question' when contains(lower(text), 'tahmin') or contains(lower(text), 'gelecek ay') then 'forecast_question' else 'general_statement_question' end as intent from conversations""")
def intent_detect(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


@query("events_json_props", "select event_type, cast(json_extract_string(props, '$.k') as varchar) as k, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_json_props(spark, d):
    return S.table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("events_tumbling_window", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling_window(spark, d):
    return I.tumbling(S.table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_session_window", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 day then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, s""")
def events_session_window(spark, d):
    return I.sessions(S.table(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("rollup_category_month", f"{CAT} select category, strftime(date_trunc('month', txn_date), '%Y-%m') as month, count(*) as n, cast(sum(amount) as double) as total from cat group by rollup (category, month)")
def rollup_category_month(spark, d):
    rows = A.categorized(txn(spark, d)).withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    return rows.rollup("category", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("routing_lookup", """with k as (select event_id, case event_id % 7 when 0 then 'real_pdf' when 1 then 'scanned_pdf' when 2 then 'hybrid_pdf' when 3 then 'screenshot' when 4 then 'camera_photo' when 5 then 'unknown' else 'unsupported' end as kind from events)
select event_id, kind, case kind when 'real_pdf' then 'pdf.real.extract_text' when 'scanned_pdf' then 'pdf.scanned.ocr' when 'hybrid_pdf' then 'pdf.hybrid.extract_and_ocr' when 'screenshot' then 'image.screenshot.ocr' when 'camera_photo' then 'image.camera_photo.preprocessing' when 'unknown' then 'manual_review' else 'unsupported' end as route,
 kind in ('scanned_pdf', 'hybrid_pdf', 'screenshot', 'camera_photo') as ocr, kind in ('scanned_pdf', 'hybrid_pdf', 'camera_photo') as preprocessing from k""")
def routing_lookup(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("real_pdf", "scanned_pdf", "hybrid_pdf", "screenshot", "camera_photo", "unknown", "unsupported"))), (F.col("event_id") % 7 + 1).cast("int"))
    rows = S.table(spark, d, "events").select("event_id", kind.alias("kind"))
    return rows.select("event_id", "kind", C.route(F.col("kind")).alias("route"), C.needs_ocr(F.col("kind")).alias("ocr"), C.needs_preprocessing(F.col("kind")).alias("preprocessing"))


@query("mime_sniff", """select doc_id, case doc_id % 5 when 0 then 'application/pdf' when 1 then 'image/jpeg' when 2 then 'image/png' when 3 then 'image/webp' else 'application/octet-stream' end as mime, case when doc_id % 5 = 4 then 'unsupported_type' end as reject_reason from documents""")
def mime_sniff(spark, d):
    heads = F.array(*(F.lit(x) for x in ("255044462D312E37", "FFD8FFE000104A46", "89504E470D0A1A0A", "524946460000000057454250", "00")))
    content = F.concat(F.unhex(F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int"))), F.encode("text", "utf-8"))
    rows = S.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), S.mime(content).alias("mime"))
    return rows.select("doc_id", "mime", S.reject_reason(F.col("n"), F.col("mime")).alias("reject_reason"))


@query("preferred_output", f"""with v as ({VARIANTS.format(lineitem='lineitem')}), s as (select input_id, variant, ord, is_preferred as is_candidate, ocr_score / 50 as readiness from v), b as (select input_id, variant as preferred from s qualify row_number() over (partition by input_id order by is_candidate desc, readiness desc, ord) = 1),
 a as (select input_id, round(avg(readiness), 4) as mean_readiness, count(*) as n_variants from s group by input_id) select input_id, preferred, mean_readiness, n_variants, mean_readiness >= 0.35 as is_ready from a join b using (input_id)""")
def preferred_output(spark, d):
    rows = spark.sql(VARIANTS.format(lineitem="{lineitem}"), lineitem=S.table(spark, d, "lineitem"))
    return C.preferred_output(rows.select("input_id", "variant", "ord", F.col("is_preferred").alias("is_candidate"), (F.col("ocr_score") / 50).alias("readiness")))


KIND = "case event_id % 6 when 0 then 'real_pdf' when 1 then 'scanned_pdf' when 2 then 'hybrid_pdf' when 3 then 'screenshot' when 4 then 'camera_photo' else 'unknown' end"


def kinds(spark, d) -> DataFrame:
    return S.table(spark, d, "events").select(F.col("event_id").cast("string").alias("input_id"), F.expr(KIND).alias("kind"), "event_id")


@query("preprocessing_variants", f"""with k as (select cast(event_id as varchar) as input_id, {KIND} as kind from events) select input_id, kind, case kind when 'real_pdf' then 'native_pdf_text' when 'unknown' then 'manual_review' else 'ocr_multi_variant' end as method,
 case when kind in ('real_pdf', 'screenshot') then 'low' when kind = 'unknown' then 'high' else 'medium' end as risk, case when kind in ('scanned_pdf', 'hybrid_pdf', 'camera_photo') then 3 when kind = 'screenshot' then 2 else 0 end as n_variants from k""")
def preprocessing_variants(spark, d):
    rows = X.plan(kinds(spark, d))
    n = X.variants(rows.select("input_id", F.lit(1).alias("page"), "kind")).groupBy("input_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return rows.join(n, "input_id", "left").select("input_id", "kind", "method", "risk", F.coalesce("n", F.lit(0)).alias("n_variants"))


@query("extraction_gate", f"""with k as (select cast(event_id as varchar) as input_id, {KIND} as kind, event_id from events) select input_id, kind, case when kind <> 'real_pdf' then 'wrong_kind' when event_id % 4 = 0 then 'not_preprocessed' when event_id % 9 = 0 then 'not_ready' end as refused,
 case when kind = 'real_pdf' and event_id % 4 <> 0 and event_id % 9 <> 0 then case when event_id % 5 = 0 then 'prepared/' else 'raw/' end || input_id end as path from k""")
def extraction_gate(spark, d):
    k = kinds(spark, d)
    done = k.where("event_id % 4 <> 0").select("input_id", F.lit("native_pdf_text").alias("method"), (F.col("event_id") % 9 != 0).alias("is_ready"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("prepared/"), "input_id")).alias("preferred_url"))
    return X.extraction_gate(k.select("input_id", F.concat(F.lit("raw/"), "input_id").alias("storage_url")), k, done)


ANOM = f"""{TXN}, robust_ as ({ROBUST} select input_id, seq, round(cast(score as double), 4) as score, 'robust' as detector, concat_ws(', ', case when is_foreign then 'Yabancı para işlemi' end, case when has_installment then 'Taksitli işlem' end,
  case when is_low then 'Düşük veri güveni' end, case when validation_status <> 'valid' then 'Doğrulama uyarısı' end, case when mad > 0 and z >= 3.5 or mad = 0 and n >= 3 and x > med * 3 then 'Alışılmışın üzerinde tutar' end) as reasons from s where cast(score as double) >= 0.25 and n < 8),
 ecdf_ as ({ECDF.replace(", both_ as (select *, 0 as now, ln(1 + x) as lg from fl semi join many using (input_id) union all select *, 1, ln(1 + x) from fl semi join many using (input_id))", ", both_ as (select *, 1 as now, ln(1 + x) as lg from fl semi join many using (input_id) union all select *, 0, ln(1 + x) from fl semi join many using (input_id))")}
  select input_id, seq, round(score, 4) as score, 'ecdf' as detector, case when bonus = 0 then 'İstatistiksel sapma' else concat_ws(', ', case when is_foreign then 'Yabancı para işlemi' end, case when has_installment then 'Taksitli işlem' end, case when is_low then 'Düşük veri güveni' end, case when validation_status <> 'valid' then 'Doğrulama uyarısı' end) end from s where score >= 0.40),
 anom as (select a.*, t.description, t.amount, t.currency, t.description || ' (' || format('{{:,.2f}}', cast(t.amount as double)) || ' ' || t.currency || ') işlemi dikkat çekiyor: ' || reasons || '.' as message from (from robust_ union all from ecdf_) a join txn t using (input_id, seq))"""


def analysis(spark, d) -> dict[str, DataFrame]:
    from .plans.analyze import analyze

    return analyze(txn(spark, d))


@query("anomaly_detector_switch", f"{ANOM} select detector, case when score >= 0.70 then 'high' when score >= 0.45 then 'medium' else 'low' end as severity, count(*) as n, round(sum(score), 3) as total from anom group by all")
def anomaly_detector_switch(spark, d):
    rows = A.features(txn(spark, d))
    return A.anomalies(rows, rows).groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))


@query("anomaly_messages", f"{ANOM} select input_id, seq, detector, message from anom")
def anomaly_messages(spark, d):
    found = analysis(spark, d)["anomalies"]
    return found.select("input_id", "seq", "detector", "message")


AR = f"""{MONTHLY}, st as (select *, count(*) over w as n, avg(spend) over w as mean, stddev_pop(spend) over w as sd, min(spend) over w as lo, max(spend) over w as hi, row_number() over (partition by input_id order by m desc) as back from mon window w as (partition by input_id)),
 z as (select *, (spend - mean) / case when sd > 0 then sd else 1 end as z from st where n >= 6), l as (select *, lag(z, 3) over w as a, lag(z, 2) over w as b, lag(z, 1) over w as c from z window w as (partition by input_id order by m)),
 g as (select input_id, any_value(currency) as currency, any_value(n) as n, any_value(mean) as mean, any_value(sd) as sd, any_value(lo) as lo, any_value(hi) as hi, max(case when back = 1 then b end) as x1, max(case when back = 1 then c end) as x2, max(case when back = 1 then z end) as x3, sum(greatest(7 - back, 0) * spend) / sum(greatest(7 - back, 0)) as recent,
  sum(a * a) + 0.1e0 as aa, sum(a * b) as ab, sum(a * c) as ac, sum(a) as a1, sum(b * b) + 0.1e0 as bb, sum(b * c) as bc, sum(b) filter (a is not null) as b1, sum(c * c) filter (a is not null) + 0.1e0 as cc, sum(c) filter (a is not null) as c1, count(a) + 0.1e0 as k, sum(a * z) as az, sum(b * z) filter (a is not null) as bz, sum(c * z) filter (a is not null) as cz, sum(z) filter (a is not null) as z1,
  sum(b * b) filter (a is not null) + 0.1e0 as bb_, sum(b * c) filter (a is not null) as bc_ from l group by input_id),
 -- Cramer's rule: without the intercept's row and column first, as k > 0
 r as (select *, aa - a1 * a1 / k as p, ab - a1 * b1 / k as q, ac - a1 * c1 / k as s, bb_ - b1 * b1 / k as t, bc_ - b1 * c1 / k as u, cc - c1 * c1 / k as v, az - a1 * z1 / k as f, bz - b1 * z1 / k as h, cz - c1 * z1 / k as i from g),
 dt as (select *, p * (t * v - u * u) - q * (q * v - u * s) + s * (q * u - t * s) as d from r),
 be as (select *, (f * (t * v - u * u) - q * (h * v - u * i) + s * (h * u - t * i)) / d as e1, (p * (h * v - u * i) - f * (q * v - u * s) + s * (q * i - h * s)) / d as e2, (p * (t * i - h * u) - q * (q * i - h * s) + f * (q * u - t * s)) / d as e3 from dt),
 y as (select *, (x1 * e1 + x2 * e2 + x3 * e3 + (z1 - a1 * e1 - b1 * e2 - c1 * e3) / k) * case when sd > 0 then sd else 1 end + mean as model from be)
select input_id, currency, n as months, round(case when hi <= 0 then 0 else least(greatest(0.6e0 * model + 0.4e0 * recent, lo * 0.5), hi * 1.5) end, 2)::double as predicted, round(least(0.65e0 + n * 0.025e0, 0.90e0), 4)::double as confidence, 'ar_moving_average_ensemble' as method from y"""


@query("ar_forecast", AR)
def ar_forecast(spark, d):
    return A.ar_forecast(A.monthly_spend(A.features(txn(spark, d))))


FACTS = f"""{ANOM}, profile_ as (select * from ({{profile}})), fore_ as (select input_id, currency, months, predicted from ({FORE} select * from fc) where months < 6 union all select input_id, currency, months, predicted from ({AR})), cats as ({CAT}, s as (select input_id, category, sum(amount) as t from cat where direction = 'debit' group by all)
  select input_id, category, t, round(cast(t as double) / cast(sum(t) over (partition by input_id) as double), 4) as sh from s), main as (select input_id, sh, case category when 'food' then 'Yeme İçme' when 'groceries' then 'Market' when 'fuel' then 'Akaryakıt' when 'telecom' then 'İletişim' when 'shopping' then 'Alışveriş' else 'Diğer' end as label from cats qualify row_number() over (partition by input_id order by t desc, category) = 1),
 cnt as (select input_id, count(*) as n, max_by(message, (score, -seq)) as worst from anom group by input_id), every as (select distinct input_id from txn),
 said as (select e.input_id, label, cast(round(cast(sh as decimal(6,4)) * 100, 1) as varchar) as pct, coalesce(labels, 'insufficient_spending_data') as labels, coalesce(cnt.n, 0) as n, worst, predicted, currency, months, format('{{:,.2f}}', predicted) || ' ' || currency as next
  from every e left join profile_ p using (input_id) left join main using (input_id) left join cnt using (input_id) left join fore_ using (input_id))""".replace("{profile}", SQL["profile_labels"])


@query("executive_summary", f"""{FACTS} select input_id, concat_ws(chr(10), 'Harcamalarınızın en büyük bölümü ' || label || ' kategorisinde (%' || pct || ').', 'Harcama profiliniz: ' || replace(labels, ',', ', ') || '.',
 case when n > 0 then 'İncelemeye değer ' || n || ' işlem dikkat çekiyor.' else 'Dikkat çeken olağan dışı bir işlem görünmüyor.' end, 'Gelecek dönem için tahmini harcamanız yaklaşık ' || next || '.') as summary from said""")
def executive_summary(spark, d):
    return analysis(spark, d)["summary"].select("input_id", F.array_join("sentences", "\n").alias("summary"))


@query("report_answers", f"""{FACTS}, q as (select input_id, unnest(['En çok hangi kategori?', 'Anomali var mı?', 'Gelecek ay tahmin nedir?', 'Taksit?', 'Merhaba']) as question from every)
select input_id, question, case question when 'En çok hangi kategori?' then 'category_question' when 'Anomali var mı?' then 'anomaly_question' when 'Gelecek ay tahmin nedir?' then 'forecast_question' when 'Taksit?' then 'installment_question' else 'general_statement_question' end as intent,
 case when question = 'En çok hangi kategori?' and label is not null then 'En çok harcama yaptığınız kategori ' || label || '; bu kategori toplam harcamanızın yaklaşık %' || pct || chr(39) || 'ini oluşturuyor.' when question = 'Anomali var mı?' and n > 0 then 'İncelemenizde fayda olan ' || n || ' işlem var. En dikkat çekeni: ' || worst
 when question = 'Anomali var mı?' then 'Olağan dışı görünen bir işlem tespit edilmedi.' when question = 'Taksit?' then 'Taksit önerisi sunabilmem için alışveriş tutarını (purchase_scenario) paylaşmanız gerekiyor.' when question = 'Gelecek ay tahmin nedir?' and next is not null then 'Gelecek dönem için tahmini harcamanız yaklaşık ' || next || '.'
 when question = 'Gelecek ay tahmin nedir?' then 'Tahmin üretebilmem için yeterli geçmiş dönem verisi yok.' else 'Size kategori dağılımınız, harcama profiliniz, dikkat çeken işlemler, harcama tahmininiz ve taksit seçenekleri hakkında yardımcı olabilirim.' end as answer from q left join said using (input_id)""")
def report_answers(spark, d):
    asked = txn(spark, d).select("input_id").distinct().select("input_id", F.explode(F.array(*(F.lit(q) for q in ("En çok hangi kategori?", "Anomali var mı?", "Gelecek ay tahmin nedir?", "Taksit?", "Merhaba")))).alias("question"))
    return report.answers(asked, analysis(spark, d)["facts"])


CONTEXT = f"""{FACTS}, named as (select *, case category when 'food' then 'Yeme İçme' when 'groceries' then 'Market' when 'fuel' then 'Akaryakıt' when 'telecom' then 'İletişim' when 'shopping' then 'Alışveriş' else 'Diğer' end as label, row_number() over (partition by input_id order by t desc, category) as r from cats),
 tops as (select input_id, string_agg(label || ' (' || cast(round(cast(sh as decimal(6,4)) * 100, 1) as varchar) || '%)', ', ' order by r) as tops from named where r <= 3 group by input_id),
 ranked as (select *, row_number() over (partition by input_id order by score desc, seq) as r from anom), items as (select input_id, string_agg('  - ' || description || ': ' || format('{{:.2f}}', cast(amount as double)) || ' ' || currency || ' (' || case when score >= 0.70 then 'high' when score >= 0.45 then 'medium' else 'low' end || ' önem).', chr(10) order by r) as items from ranked where r <= 3 group by input_id)"""


@query("chat_context", f"""{CONTEXT} select input_id, concat_ws(chr(10), '- En yoğun harcama kategorisi: ' || label || ' (toplam harcamanın %' || pct || chr(39) || 'i).', '- Harcama profili: ' || replace(labels, ',', ', ') || '.', '- En çok harcanan kategoriler: ' || tops || '.',
 '- İşaretlenen anomali sayısı: ' || n || '.', items, '- Gelecek dönem harcama tahmini: ' || format('{{:.2f}}', predicted) || ' ' || currency || '.') as lines from said left join tops using (input_id) left join items using (input_id)""")
def chat_context(spark, d):
    return analysis(spark, d)["context"].select("input_id", F.array_join("lines", "\n").alias("lines"))


HIST = """hist as (select * exclude (seq), row_number() over (partition by input_id order by seq) - 1 as seq from txn where seq % 3 <> 0), cur as (select * exclude (seq), row_number() over (partition by input_id order by seq) - 1 as seq from txn where seq % 3 = 0)"""


@query("history_union", f"""{TXN}, {HIST}, u as (select 'history' as role, * from hist union all select 'current', * from cur)
select input_id, 'txn_' || substr(sha256(concat_ws('|', role, seq, strftime(txn_date, '%Y-%m-%d'), description, regexp_replace(cast(amount as varchar), '(\\.[0-9])0$', '\\1'), currency, direction)), 1, 16) as transaction_id, seq, cast(amount as double) as amount from u""")
def history_union(spark, d):
    from .plans.analyze import analyze

    of = txn(spark, d)
    place = F.row_number().over(Window.partitionBy("input_id").orderBy("seq")) - 1
    history, current = (of.where(c).withColumn("_p", place.cast("long")).drop("seq").withColumnRenamed("_p", "seq") for c in ("seq % 3 <> 0", "seq % 3 = 0"))
    return analyze(current, history)["reference"].select("input_id", "transaction_id", "seq", money("amount").alias("amount"))


@query("history_forecast", f"""{TXN}, d as (select distinct input_id from txn where seq % 3 = 0), f as (select input_id, months, predicted from ({FORE} select * from fc) where months < 6 union all select input_id, months, predicted from ({AR}))
select input_id, coalesce(months, 0) as months, predicted from d left join f using (input_id)""")
def history_forecast(spark, d):
    """History and current rows split a document whose rows number from 0 in each: the forecast is that of all."""
    from .plans.analyze import analyze

    of = txn(spark, d)
    place = F.row_number().over(Window.partitionBy("input_id").orderBy("seq")) - 1
    history, current = (of.where(c).withColumn("_p", place.cast("long")).drop("seq").withColumnRenamed("_p", "seq") for c in ("seq % 3 <> 0", "seq % 3 = 0"))
    return analyze(current, history)["forecast"].select("input_id", "months", "predicted")


@query("merchant_fallback", f"{TXN} select input_id, seq, case when seq % 4 = 0 then 'N' || seq when seq % 4 = 1 then 'D' || seq when seq % 4 = 2 then 'R' || seq else description end as merchant from txn")
def merchant_fallback(spark, d):
    rows = txn(spark, d).withColumn("merchant", F.expr("case when seq % 8 = 7 then null else named_struct('raw', case when seq % 4 <= 2 then concat('R', seq) else '' end, 'normalized', case when seq % 4 = 0 then concat('N', seq) else '' end, 'display_name', case when seq % 4 <= 1 then concat('D', seq) end) end"))
    return rows.select("input_id", "seq", A.merchant_of(rows).alias("merchant"))


@query("categorized_by_given_similarity", f"""{CAT}, c as (select *, seq % 3 = 0 and category = 'other' as asked, round(seq % 100 / 100.0, 2)::double as similarity from cat)
select input_id, seq, case when asked and similarity >= 0.52 then 'education' else category end as category, case when direction = 'credit' then 0.97 when category <> 'other' then 0.94 when asked and similarity >= 0.52 then least(0.90, similarity) else 0.35 end::double as confidence,
 case when direction = 'credit' then 'direction' when category <> 'other' then 'rule' when asked and similarity >= 0.52 then 'embedding' else 'fallback' end as method from c""")
def categorized_by_given_similarity(spark, d):
    """Another model's similarities, by row."""
    t = txn(spark, d)
    near = t.where("seq % 3 = 0").select("input_id", "seq", F.lit("education").alias("category"), F.round(F.col("seq") % 100 / 100, 2).alias("similarity"))
    return A.categorized(t, near).select("input_id", "seq", "category", F.col("category_confidence").alias("confidence"), "method")


@query("mime_predicates", "select doc_id, doc_id % 5 = 0 as pdf, doc_id % 5 in (1, 2, 3) as image from documents")
def mime_predicates(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("application/pdf", "image/jpeg", "image/png", "image/webp", "application/octet-stream"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return S.table(spark, d, "documents").select("doc_id", S.is_pdf(kind).alias("pdf"), S.is_image(kind).alias("image"))


@query("page_lines", """with l as (select doc_id, string_split(text, chr(10)) as parts from documents), u as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as line_no from l)
select doc_id, cast(line_no as int) as line_no, trim(regexp_replace(replace(replace(replace(line, 'bosluk', ' '), 'BOŞLUK', ' '), '□', ' '), '\\s+', ' ', 'g')) as text from u where trim(regexp_replace(replace(replace(replace(line, 'bosluk', ' '), 'BOŞLUK', ' '), '□', ' '), '\\s+', ' ', 'g')) <> ''""")
def page_lines(spark, d):
    return S.lines_of(S.table(spark, d, "documents"), "doc_id")


@query("engine_fallback", "select input_id, engine_rank, line from (select l_orderkey as input_id, l_linenumber % 3 as engine_rank, l_partkey as line, min(l_linenumber % 3) over (partition by l_orderkey) as best from lineitem) where engine_rank = best")
def engine_fallback(spark, d):
    return S.first_engine(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("input_id"), (F.col("l_linenumber") % 3).alias("engine_rank"), F.col("l_partkey").alias("line")))


@query("image_extraction_gate", f"""with k as (select cast(event_id as varchar) as input_id, {KIND} as kind, event_id from events) select input_id, kind, case when kind in ('real_pdf', 'unknown') then 'wrong_kind' when event_id % 5 = 0 then 'not_preprocessed' when event_id % 9 = 0 then 'not_ready' when event_id % 7 = 0 then 'wrong_method' end as refused,
 case when kind not in ('real_pdf', 'unknown') and event_id % 5 <> 0 and event_id % 9 <> 0 and event_id % 7 <> 0 then 'prepared/' || input_id end as path from k""")
def image_extraction_gate(spark, d):
    k = kinds(spark, d)
    done = k.where("event_id % 5 <> 0").select("input_id", F.when(F.col("event_id") % 7 == 0, "native_pdf_text").otherwise("ocr_multi_variant").alias("method"), (F.col("event_id") % 9 != 0).alias("is_ready"), F.concat(F.lit("prepared/"), "input_id").alias("preferred_url"))
    return X.extraction_gate(k.select("input_id", F.concat(F.lit("raw/"), "input_id").alias("storage_url")), k, done, native=False)


@query("chat_target", "select conv_id as analysis_id, turn, case when turn % 3 = 0 then 'given' when conv_id % 2 = 0 then 'stored ' || conv_id end as analysis from conversations")
def chat_target(spark, d):
    c = S.table(spark, d, "conversations")
    asked = c.select(F.col("conv_id").alias("analysis_id"), "turn", F.when(F.col("turn") % 3 == 0, "given").alias("analysis"))
    kept = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("analysis_id"), F.concat(F.lit("stored "), "conv_id").alias("analysis")).distinct()
    return report.chat_target(asked, kept)


@query("classification_dispatch", """with k as (select p_partkey as id, cast(p_partkey as varchar) as input_id, p_partkey % 5 as t from part), c as (select *, case when t = 0 and id % 3 = 0 then 'unopened' when t = 0 and id % 3 = 1 then 'no pages' when t = 0 then 'pdf' when t in (1, 2) then 'image' when t = 3 then 'unread' else 'else' end as c from k)
select input_id, case c when 'pdf' then 'real_pdf' when 'image' then case when t = 1 then 'camera_photo' else 'screenshot' end when 'else' then 'unsupported' else 'unknown' end as kind, case c when 'pdf' then 0.94 when 'image' then case when t = 1 then 1.0 else 0.8611 end else 0 end::double as confidence,
 c = 'image' as needs_ocr, c = 'image' and t = 1 as needs_preprocessing, case c when 'pdf' then 'pdf.real.extract_text' when 'image' then case when t = 1 then 'image.camera_photo.preprocessing' else 'image.screenshot.ocr' end when 'else' then 'unsupported' else 'manual_review' end as routing_key,
 case c when 'unopened' then 'Could not open PDF: bad' when 'no pages' then 'PDF has zero pages' when 'unread' then 'image_classification_failed,low_confidence_image_classification' when 'else' then 'unsupported_mime_type' when 'image' then case when t = 1 then 'possible_blurry_camera_photo' else '' end else '' end as warnings from c""")
def classification_dispatch(spark, d):
    k = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("input_id"), (F.col("p_partkey") % 5).alias("t"))
    inputs = k.select("input_id", F.expr("case t when 0 then 'application/pdf' when 1 then 'image/jpeg' when 2 then 'image/png' when 3 then 'image/webp' else 'text/plain' end").alias("mime"), F.expr("case when t = 0 and id % 3 = 0 then 'bad' end").alias("open_error"))
    pages = k.where("t = 0 and id % 3 = 2").select("input_id", F.lit(1).alias("page"), F.lit(400).alias("char_count"), F.lit(60).alias("word_count"), F.lit(0.0).alias("image_area"), F.lit(1.0).alias("page_area"))
    images = k.where("t in (1, 2)").select("input_id", F.expr("case t when 1 then 'image/jpeg' else 'image/png' end").alias("mime"), F.col("t").isin(1).alias("exif_present"), F.expr("case t when 1 then 5 else 0 end").alias("camera_exif_tag_count"), F.expr("case t when 1 then 4000 else 720 end").alias("width"), F.expr("case t when 1 then 3000 else 1480 end").alias("height"), F.expr("case t when 1 then 60.0d else 1200.0d end").alias("blur_score"), F.lit(0.05).alias("edge_density"), (F.col("t") == 1).alias("has_document_contour"), F.expr("case t when 1 then 0.1d else 0.5d end").alias("max_contour_area_ratio"), F.lit(0.01).alias("axis_aligned_line_score"))
    out = C.classified(inputs, C.pdf_features(pages), C.image_kind(images))
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("preprocessing_results", f"""with k as (select cast(event_id as varchar) as input_id, event_id, {KIND} as kind from events), c as (select *, kind not in ('real_pdf', 'unknown') as imaged, event_id % 10 / 10.0 as q from k)
select input_id, kind, case when kind = 'unknown' then 'skipped' else 'completed' end as status, case when kind = 'unknown' then 0 else 2 end as page_count, case when kind = 'real_pdf' then 'original_pdf' when kind = 'screenshot' then 'ocr_grayscale' when imaged then 'thresholded' end as preferred,
 case kind when 'real_pdf' then 'preserve_original_pdf,skip_image_rendering,skip_ocr' when 'screenshot' then 'grayscale,normalize_original,soft_contrast_enhancement' when 'camera_photo' then 'adaptive_threshold,contrast_enhancement,deskew,grayscale,normalize_original,small_noise_removal' when 'unknown' then '' else 'adaptive_threshold,contrast_enhancement,deskew,grayscale,rendered_original,small_noise_removal' end as operations,
 case when imaged then round(q + case when kind = 'screenshot' then 0.005e0 else 0.01e0 end, 4) end::double as mean_readiness, case when kind = 'real_pdf' then true when imaged then q + 0.01e0 >= 0.35e0 else false end as is_ready, case when kind = 'unknown' then 'unsupported_source_kind_for_preprocessing' else '' end as warnings from c""")
def preprocessing_results(spark, d):
    k = kinds(spark, d).withColumn("page_count", F.lit(2))
    outputs = X.variants(k.select("input_id", "kind", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))).withColumn("readiness", F.col("event_id") % 10 / 10 + F.col("ord") / 100)
    out = X.results(k.drop("event_id"), outputs.drop("kind", "event_id"))
    return out.select("input_id", "kind", "status", "page_count", "preferred", F.array_join("operations", ",").alias("operations"), "mean_readiness", "is_ready", F.array_join("warnings", ",").alias("warnings"))


@query("preview_variants", f"with k as (select cast(event_id as varchar) as input_id, {KIND} as kind from events) select input_id, 'page_preview' as variant, 'debug_preview' as purpose, false as is_candidate, 'grayscale_preview,light_contrast_enhancement' as operations from k where kind = 'real_pdf'")
def preview_variants(spark, d):
    rows = X.preview_variants(kinds(spark, d).select("input_id", F.lit(1).alias("page"), "kind"))
    return rows.select("input_id", "variant", "purpose", "is_candidate", F.array_join("operations", ",").alias("operations"))


OCRED = """ocred as (select input_id, 1 as page, v as variant, 6 as psm, seq as line_no, strftime(txn_date, '%d/%m/%Y') || ' ' || description || ' ' || replace(cast(amount as varchar), '.', ',') || case when v = 'original' then ' TL' else ' USD' end as text, round(0.5 + seq % 50 / 100.0, 2)::double as ocr_confidence, seq % 5 as word_count
 from txn, (values ('original'), ('thresholded')) x(v) where direction = 'debit' and (v = 'original' or seq % 2 = 0))"""
SCORED = f"{TXN}, {OCRED}, scored as (select input_id, variant, round(count(*) * 11.5e0 + avg(ocr_confidence) * 15 + least((sum(length(text)) + count(*) - 1) / 500, 8), 4) as ocr_score from ocred group by all)"


def ocred(spark, d) -> DataFrame:
    t = txn(spark, d).where("direction = 'debit'").withColumn("variant", F.explode(F.array(F.lit("original"), F.lit("thresholded")))).where("variant = 'original' or seq % 2 = 0")
    text = F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "description", F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")), F.when(F.col("variant") == "original", "TL").otherwise("USD"))
    return t.select("input_id", F.lit(1).alias("page"), "variant", F.lit(6).alias("psm"), F.col("seq").alias("line_no"), text.alias("text"), F.round(F.lit(0.5) + F.col("seq") % 50 / 100, 2).alias("ocr_confidence"), (F.col("seq") % 5).alias("word_count"))


@query("ocr_variant_scores", f"{SCORED} select input_id, variant, round(ocr_score, 3) as ocr_score from scored")
def ocr_variant_scores(spark, d):
    return P.variant_scores(ocred(spark, d)).select("input_id", "variant", F.round("ocr_score", 3).alias("ocr_score"))


@query("ocr_document_currency", f"{TXN}, c as (select input_id, case when seq % 3 = 0 then 'USD' else 'TRY' end as cur, count(*) as n, min(seq) as f from txn group by all) select input_id, cur as document_currency from c qualify row_number() over (partition by input_id order by n desc, f) = 1")
def ocr_document_currency(spark, d):
    """Only the currencies of amounts count: EUR stands in each line, but at none."""
    lines = txn(spark, d).select("input_id", F.col("seq").alias("line_no"), F.expr("concat('EUR hesap EUR 05 ', case when seq % 3 = 0 then 'USD' else 'TL' end, ' 12,50')").alias("text"))
    return P.document_currency(lines, "ocr")


@query("image_extraction", f"""{SCORED}, best as (select input_id, variant from scored qualify row_number() over (partition by input_id order by round(ocr_score + case variant when 'original' then 0.80 else 0.70 end, 4) desc, variant) = 1)
select o.input_id, o.line_no as seq, strftime(t.txn_date, '%Y-%m-%d') as date, t.description, cast(t.amount as double) as price, case when o.variant = 'original' then 'TRY' else 'USD' end as currency, round(least(0.95e0 * 0.78e0 + o.ocr_confidence * 0.18e0 + case when o.word_count >= 3 then 0.04e0 else 0 end, 0.98e0), 2)::double as confidence
from ocred o join best using (input_id, variant) join txn t on t.input_id = o.input_id and t.seq = o.line_no""")
def image_extraction(spark, d):
    rows = ocred(spark, d)
    outputs = rows.select("input_id", "page", "variant").distinct().select("*", F.when(F.col("variant") == "original", 0).otherwise(1).alias("ord"), (F.col("variant") == "thresholded").alias("is_preferred"))
    found, _ = P.extract_ocr(rows, outputs)
    return found.select("input_id", F.col("line_no").alias("seq"), F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "price", "currency", "confidence")


@query("extraction_summary", f"""{TXN} select input_id, count(*) as transaction_count, round(avg(cast(case when installment_total is not null then 98 else 95 end as double)) / 100, 4) as average_confidence, cast(sum(case when direction = 'debit' then amount else 0 end) as double) as total_debit, cast(sum(case when direction = 'credit' then amount else 0 end) as double) as total_credit from txn group by input_id""")
def extraction_summary(spark, d):
    found, _ = P.extract(S.statement_lines(txn(spark, d)))
    return P.extraction_summary(found).select("input_id", "transaction_count", F.round("average_confidence", 4).alias("average_confidence"), money("total_debit").alias("total_debit"), money("total_credit").alias("total_credit"))


@query("normalized_extraction", f"""{TXN} select input_id, seq, strftime(txn_date, '%Y-%m-%d') as date, cast(amount as double) as amount, 'TRY' as currency, case when description like 'TRENDYOL%' then 'TRENDYOL' else description || case when direction = 'credit' then ' IADE' else '' end end as merchant, 'valid' as validation_status from txn""")
def normalized_extraction(spark, d):
    found, _ = P.extract(S.statement_lines(txn(spark, d)))
    rows = N.normalized(found.select("input_id", F.col("line_no").alias("seq"), F.col("date").cast("string").alias("date"), "price", "currency", "description", "direction", "confidence", F.col("installment.current").alias("installment_current"), F.col("installment.total").alias("installment_total")))
    return rows.select("input_id", "seq", F.date_format("date", "yyyy-MM-dd").alias("date"), money("amount").alias("amount"), "currency", "merchant", "validation_status")


@query("singular_alias", "select conv_id, turn, case when turn % 2 = 0 then 'plural' when turn % 3 = 0 then 'singular' end as transactions from conversations")
def singular_alias(spark, d):
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "plural").alias("transactions"), F.when(F.col("turn") % 3 == 0, "singular").alias("transaction"))
    return R.singular_alias(rows)


@query("text_matching", "select conv_id, turn, case turn % 4 when 0 then 'iade' when 1 then 'müşteri limiti' when 2 then 'kalem' else 'asgari ödeme' end as text, turn % 4 in (1, 3) as noise, case when turn % 4 in (0, 3) then 'credit' else 'debit' end as direction from conversations")
def text_matching(spark, d):
    """Full-width and decomposed forms, dotless i, no-break spaces."""
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "IADE").replace("Ｉ", "ｉ")
    said = F.element_at(F.array(*(F.lit(x) for x in (wide, "Mu\u0308s\u0327teri\u00a0LiMiTi", "kalem", "asgarı o\u0308deme"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"))
    return rows.select("conv_id", "turn", T.for_matching(F.col("said")).alias("text"), T.is_noise(F.col("said")).alias("noise"), T.direction(F.col("said")).alias("direction"))


@query("currency_tokens", f"{TXN} select input_id, seq, 'x  y' as rest, case seq % 3 when 0 then 'TRY' when 1 then 'USD' else 'EUR' end as code from txn")
def currency_tokens(spark, d):
    token = F.element_at(F.array(F.lit("TL"), F.lit("us$"), F.lit("€")), (F.col("seq") % 3 + 1).cast("int"))
    return txn(spark, d).select("input_id", "seq", T.without_currencies(F.concat(F.lit("x"), F.lit(" "), token, F.lit("y"))).alias("rest"), T.currency(token).alias("code"))


@query("merchant_words", f"{TXN} select input_id, seq, lower(description) as words from txn")
def merchant_words(spark, d):
    return txn(spark, d).select("input_id", "seq", T.merchant_text(F.concat(F.lit("POS "), "description", F.lit(" REF:"), F.lit(12345), F.lit(" *Onay/"))).alias("words"))


@query("ocr_lines_by_top", """with w as (select l_orderkey as o, l_quantity as q, 'w' || l_partkey || '_' || l_linenumber as text, (l_partkey * 8 + l_linenumber) as x from lineitem)
select cast(o as varchar) as input_id, string_agg(text, ' ' order by x) as text, cast(count(*) as int) as word_count, 0.9::double as ocr_confidence from w group by o, q""")
def ocr_lines_by_top(spark, d):
    """Rows of words far apart, each word a pixel or two up or down: groups are known."""
    place = (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("int")
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("input_id"), F.lit(1).alias("page"), F.lit("original").alias("variant"), F.lit(6).alias("psm"), F.concat(F.lit("w"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber")).alias("text"), place.alias("left"), (F.col("l_quantity") * 20 + F.col("l_partkey") % 3).cast("int").alias("top"), F.lit(30).alias("width"), F.lit(10).alias("height"), F.lit(90.0).alias("conf"))
    return P.words_to_lines(P.ocr_words(rows)).select("input_id", "text", "word_count", "ocr_confidence")


from . import registry_analysis, registry_records, registry_temporal, registry_texts  # noqa: E402, F401  more queries of the same registry
