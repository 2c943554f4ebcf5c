"""Queries by time and over versions: as-of and range joins, sketches by month, versions of a document compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import records as R
from .operators import sketches as K
from .operators import temporal as J
from .registry import TXN, query, txn


@query("refund_as_of", f"""{TXN}, c as (select * from txn where direction = 'credit'), d as (select * from txn where direction = 'debit'), m as (select c.input_id, c.seq, max_by(d.seq, (d.txn_date, d.seq)) as debit_seq, max((d.txn_date, d.seq))[1] as debit_date from c join d on c.description = d.description and d.txn_date between c.txn_date - 60 and c.txn_date group by c.input_id, c.seq)
select c.input_id, c.seq, m.debit_seq, strftime(debit_date, '%Y-%m-%d') as debit_date from c left join m using (input_id, seq)""")
def refund_as_of(spark, d):
    """Each refund with the last debit at its merchant, of any document, within 60 days."""
    t = txn(spark, d)
    debits = t.where("direction = 'debit'").select("description", "txn_date", "seq")
    out = J.as_of(t.where("direction = 'credit'").select("input_id", "seq", "description", "txn_date"), debits, ["description"], "txn_date", "seq", 60)
    return out.select("input_id", "seq", F.col("last_seq").alias("debit_seq"), F.date_format("last_txn_date", "yyyy-MM-dd").alias("debit_date"))


@query("debits_in_installment_periods", f"""{TXN}, i as (select input_id, seq as plan_seq, txn_date as a, cast(txn_date + interval 6 month as date) as b from txn where installment_total is not null) select i.input_id, plan_seq, count(*) as n, sum(amount)::double as total
from i join txn t on t.input_id = i.input_id and t.txn_date >= a and t.txn_date < b and t.direction = 'debit' group by i.input_id, plan_seq""")
def debits_in_installment_periods(spark, d):
    """What a document spends while an installment plan of six months runs."""
    t = txn(spark, d)
    plans = t.where("installment_total is not null").select("input_id", F.col("seq").alias("plan_seq"), F.col("txn_date").alias("a"), F.add_months("txn_date", 6).alias("b"))
    points = t.where("direction = 'debit'").select("input_id", "txn_date", "amount")
    met = J.in_intervals(points, plans, ["input_id"], "txn_date", "a", "b", 180)
    return met.groupBy("input_id", "plan_seq").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("sketches_by_month", f"{TXN} select strftime(date_trunc('quarter', txn_date), '%Y-%m-%d') as quarter, count(*) as n, true as distinct_within_bound, true as median_within_bound from txn group by all")
def sketches_by_month(spark, d):
    """Documents and amounts of each quarter from its months' sketches: distinct documents within 4 %, the median's rank within 3 %, of the exact ones."""
    t = txn(spark, d).select("input_id", "amount", F.trunc("txn_date", "month").alias("month"), F.trunc("txn_date", "quarter").alias("quarter"))
    found = K.merged(K.states(t, ["quarter", "month"], "input_id", "amount"), ["quarter"]).select("quarter", "n", K.distinct_count().alias("about"), K.quantile(0.5).alias("median"))
    exact = t.join(found.select("quarter", "median"), "quarter").groupBy("quarter").agg(F.countDistinct("input_id").alias("documents"), F.avg((F.col("amount").cast("double") <= F.col("median")).cast("double")).alias("rank"), F.avg((F.col("amount").cast("double") < F.col("median")).cast("double")).alias("under"))
    rows = found.join(exact, "quarter")
    return rows.select(F.date_format("quarter", "yyyy-MM-dd").alias("quarter"), "n", (F.abs(F.col("about") - F.col("documents")) <= F.greatest(F.lit(1.0), F.col("documents") * 0.04)).alias("distinct_within_bound"), ((F.col("rank") >= 0.47) & (F.col("under") <= 0.53)).alias("median_within_bound"))


@query("reconciled_versions", f"""{TXN}, a as (select input_id, description, direction from txn union all select input_id, description, direction from txn where seq % 4 = 0), b as (select input_id, description, case when seq % 5 = 0 then 'credit' else direction end as direction from txn union all select input_id, description, direction from txn where seq % 6 = 0),
 na as (select input_id, description, direction, count(*) as n from a group by all), nb as (select input_id, description, direction, count(*) as m from b group by all), j as (select input_id, coalesce(n, 0) as n, coalesce(m, 0) as m from na full join nb using (input_id, description, direction))
select input_id, sum(least(n, m))::bigint as same, sum(greatest(n - m, 0))::bigint as removed, sum(greatest(m - n, 0))::bigint as added from j group by input_id""")
def reconciled_versions(spark, d):
    """Two extractions of each document, some rows of which are there more than once."""
    t = txn(spark, d).select("input_id", "seq", "description", "direction")
    columns = ["input_id", "description", "direction"]
    before = t.select(*columns).unionAll(t.where("seq % 4 = 0").select(*columns))
    after = t.withColumn("direction", F.when(F.col("seq") % 5 == 0, "credit").otherwise(F.col("direction"))).select(*columns).unionAll(t.where("seq % 6 = 0").select(*columns))
    return R.reconciled(before, after)
