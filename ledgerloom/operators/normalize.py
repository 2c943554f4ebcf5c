"""Normalised transactions: fields, validation, identifiers, duplicates, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import shared


def normal_date(c: Column) -> Column:
    """ISO dates, then d.m.Y and d/m/Y; null if none."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(F.regexp_extract(s, r"^\d{4}-\d{1,2}-\d{1,2}", 0), F.lit("yyyy-M-d")).cast("date"))
    return F.coalesce(iso, F.when(s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_timestamp(s, F.lit("d.M.yyyy")).cast("date")), F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(s, F.lit("d/M/yyyy")).cast("date")))


def normal_amount(c: Column) -> Column:
    return c.cast("string").try_cast("decimal(18,2)")


def normal_currency(c: Column) -> Column:
    up = F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.when(up == "TL", "TRY").otherwise(up)


def normal_description(c: Column) -> Column:
    return T.strip_edges(T.collapse(F.coalesce(c, F.lit(""))))


def warnings(date: Column, amount: Column, currency: Column, description: Column, current: Column, total: Column) -> Column:
    """Codes of what is wrong with a transaction, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(date.isNull(), "missing_or_invalid_date"), F.when(amount.isNull(), "missing_amount").when(amount <= 0, "non_positive_amount"),
            F.when(currency.isNull(), "missing_currency").when(~currency.isin("UNKNOWN", *T.iso_codes()), "invalid_currency"), F.when(F.length(F.coalesce(description, F.lit(""))) < 2, "missing_or_short_description"),
            F.when((current != 0) & (total != 0) & (current > total), "invalid_installment_current_gt_total"),
        )
    )


def status(codes: Column) -> Column:
    hard = F.array(*(F.lit(x) for x in ("missing_or_invalid_date", "missing_amount", "non_positive_amount")))
    return F.when(F.arrays_overlap(codes, hard), "invalid").when(F.size(codes) > 0, "warning").otherwise("valid")


def transaction_id(date: Column, merchant: Column, amount: Column, currency: Column, direction: Column) -> Column:
    """txn_ and 16 digits of the SHA-256 of the fields; nulls count as empty."""
    fields = (date.cast("string"), merchant, amount.cast("decimal(18,2)").cast("string"), currency, direction)
    return F.concat(F.lit("txn_"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in fields)), 256), 1, 16))


def normalized(raw: DataFrame) -> DataFrame:
    """raw (input_id, seq, date string, description, price or amount, currency, direction, confidence, installment current and total) as normalised rows."""
    has = raw.columns
    amount = F.coalesce(*(normal_amount(F.col(c)) for c in ("price", "amount") if c in has))
    current, total = (F.col(c).try_cast("int") if c in has else F.lit(None).cast("int") for c in ("installment_current", "installment_total"))
    rows = raw.select("input_id", "seq", normal_date(F.col("date").cast("string")).alias("date"), amount.alias("_amount"), normal_currency(F.col("currency")).alias("_currency"), normal_description(F.col("description")).alias("description"), F.coalesce("direction", F.lit("debit")).alias("direction"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), current.alias("installment_current"), total.alias("installment_total"))
    rows = rows.withColumn("merchant", T.merchant_name(F.col("description")))
    rows = rows.withColumn("merchant_confidence", T.merchant_confidence(F.col("description"), F.col("merchant")))
    rows = rows.withColumn("warnings", warnings(F.col("date"), F.col("_amount"), F.col("_currency"), F.col("description"), F.col("installment_current"), F.col("installment_total"))).withColumn("validation_status", status(F.col("warnings")))
    rows = rows.withColumn("transaction_id", transaction_id(F.col("date"), F.col("merchant"), F.col("_amount"), F.col("_currency"), F.col("direction")))
    return rows.withColumn("amount", F.coalesce("_amount", F.lit(0).cast("decimal(18,2)"))).withColumn("currency", F.coalesce("_currency", F.lit("UNKNOWN"))).drop("_amount", "_currency")


def keep_best(rows: DataFrame, count: str | None = None) -> DataFrame:
    """Per document and (date, merchant, amount, currency, direction) the row of the highest confidence, the first on ties; how many rows it stands for, if count names a column for it."""
    key = ["input_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "merchant", "amount", "currency", "direction"))]
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "seq")
    if count:
        rows = rows.withColumn(count, F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scores(rows: DataFrame) -> DataFrame:
    """rows with field_confidence, completeness, validation_score, score and flags. The flag for a low score uses the unrounded score."""
    points = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    field = F.least(points(F.col("date").isNotNull(), 0.25) + points(F.col("amount").isNotNull(), 0.25) + points(F.col("currency") != "", 0.15) + points(F.col("description") != "", 0.15) + F.least("merchant_confidence", F.lit(1.0)) * 0.20, F.lit(1.0))
    there = sum((F.when(c, 1).otherwise(0) for c in (F.col("date").isNotNull(), F.col("description") != "", F.col("amount").isNotNull(), F.col("currency") != "", F.col("direction") != "")), F.lit(0)) / 5
    valid = F.when(F.col("validation_status") == "valid", 1.0).when(F.col("validation_status") == "warning", 0.65).otherwise(0.25)
    rows = rows.withColumn("_f", field).withColumn("_c", there).withColumn("_v", valid).withColumn("_s", F.col("confidence") * 0.40 + F.col("_f") * 0.25 + F.col("_c") * 0.20 + F.col("_v") * 0.15)
    flags = F.array_compact(F.array(F.when(F.col("_s") < 0.70, "low_confidence"), F.when(F.col("validation_status") == "invalid", "validation_failed"), F.when(F.col("validation_status") == "warning", "validation_warning")))
    named = {"field_confidence": "_f", "completeness": "_c", "validation_score": "_v", "score": "_s"}
    return rows.withColumns({k: T.rounded(F.col(v)) for k, v in named.items()} | {"flags": flags}).drop(*named.values())


def score_summary(scored: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Per document; documents of inputs without rows have nulls, zero counts and no pass."""
    out = scored.groupBy("input_id").agg(T.rounded(F.avg("score")).alias("overall_confidence"), F.round(F.min("score"), 4).alias("min_confidence"), F.round(F.max("score"), 4).alias("max_confidence"), F.count_if(F.col("score") < 0.70).alias("low_confidence_count"), F.count_if(F.array_contains("flags", "validation_failed")).alias("invalid_count"), F.count_if(F.array_contains("flags", "validation_warning")).alias("warning_count"))
    out = out.withColumn("validation_passed", F.col("invalid_count") == 0)
    if inputs is not None:
        out = inputs.select("input_id").distinct().join(out, "input_id", "left").fillna(0, ["low_confidence_count", "invalid_count", "warning_count"]).fillna(False, ["validation_passed"])
    return out


def summary(rows: DataFrame) -> DataFrame:
    """Per document: count, debit, credit, debit less credit, currencies but UNKNOWN, primary currency (most frequent but UNKNOWN; first by date, description, amount on ties), invalid and warning counts."""
    of = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)")))
    out = rows.groupBy("input_id").agg(F.count(F.lit(1)).alias("transaction_count"), of("debit").alias("total_debit"), of("credit").alias("total_credit"), F.array_sort(F.collect_set(F.when(F.col("currency") != "UNKNOWN", F.col("currency")))).alias("currencies"), F.count_if(F.col("validation_status") == "invalid").alias("invalid_count"), F.count_if(F.col("validation_status") == "warning").alias("warning_count"))
    return out.withColumn("net_amount", F.col("total_debit") - F.col("total_credit")).join(primary_currency(rows), "input_id", "left")


def documents(raw: DataFrame, inputs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw transactions normalised as a whole: transactions without duplicates, their score as confidence (rows' own as source_confidence), and a summary for each document.

    summary has the columns of summary() and score_summary(), duplicate_removed_count and warnings; documents of inputs
    without transactions have zero counts.
    """
    # stored: counts, scores, currencies and records start here, and raw rows are read and normalised once
    best = shared.kept(scores(keep_best(normalized(raw), "_n")).withColumn("source_confidence", F.col("confidence")).withColumn("confidence", F.col("score")), "normalized")
    kept = best.drop("_n")
    before = best.groupBy("input_id").agg(F.sum("_n").alias("_before"))
    facts = summary(kept).join(score_summary(kept).drop("invalid_count", "warning_count"), "input_id").join(before, "input_id").withColumn("duplicate_removed_count", F.col("_before") - F.col("transaction_count")).drop("_before")
    if inputs is not None:
        facts = inputs.select("input_id").distinct().join(facts, "input_id", "left").fillna(0, ["transaction_count", "duplicate_removed_count", "low_confidence_count", "invalid_count", "warning_count"]).fillna(False, ["validation_passed"])
        zero = F.lit(0).cast("decimal(28,2)")
        facts = facts.withColumns({c: F.coalesce(c, zero) for c in ("total_debit", "total_credit", "net_amount")}).withColumn("currencies", F.coalesce("currencies", F.array().cast("array<string>")))
    said = F.when(F.col("duplicate_removed_count") > 0, F.concat(F.lit("duplicates_removed:"), F.col("duplicate_removed_count")))
    return {"transactions": kept, "summary": facts.withColumn("warnings", F.array_compact(F.array(said)))}


def primary_currency(rows: DataFrame) -> DataFrame:
    seen = rows.where("currency != 'UNKNOWN'").groupBy("input_id", "currency").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("date", "description", "amount")).alias("first"))
    return seen.groupBy("input_id").agg(F.min_by("currency", F.struct(-F.col("n"), "first", "currency")).alias("primary_currency"))
