"""Result records of the stages: what a document's extraction, normalisation or analysis gave, as nested JSON in append-only tables.

A record has a header (counts, status, warnings) in columns and its rows as JSON. A document of many transactions has its
record in several parts of about PART_ROWS each, so that no row holds an unbounded list; readers take all parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import normalize as N
from . import parse as P
from ..functions import text as T
from ..sources.shared import kept

#: Transactions of one part of a record.
PART_ROWS = 1000
#: Rejected lines that a record keeps for looking at.
REJECTED = {"pdf": 100, "image": 150}
TRANSACTION = "struct<line_no: bigint, page: int, date: string, description: string, price: decimal(18,2), currency: string, original_price: decimal(18,2), original_currency: string, installment_current: int, installment_total: int, direction: string, confidence: double>"


def extraction(inputs: DataFrame, lines: DataFrame, date_mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """((transactions as TRANSACTION's columns and input_id), a header for each input) of statement lines; inputs (input_id) without lines or transactions have a header too."""
    currencies = kept(P.document_currency(lines), "currencies")  # a row a document, for parsing and for the header
    rows = kept(P.parsed(P.candidates(lines, date_mode), currencies, date_mode), "parsed")  # transactions, counts and rejected lines start here
    return of_parsed(rows), headers(inputs, rows, currencies, lines.groupBy("input_id").agg(F.count(F.lit(1)).alias("total_lines")), "pdf")


def image_extraction(inputs: DataFrame, lines: DataFrame, outputs: DataFrame, date_mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """The same of OCR lines: those of each page's best variant. A header's warnings say what was missing, from the outputs on."""
    chosen = kept(P.chosen_lines(lines, outputs, date_mode), "chosen")
    currencies = kept(P.document_currency(chosen, "ocr"), "currencies")
    rows = kept(P.parsed_ocr(chosen, currencies, date_mode), "parsed")
    made = P.readable(outputs).select("input_id").distinct().withColumn("_made", F.lit(True))
    total = chosen.groupBy("input_id").agg(F.count(F.lit(1)).alias("total_lines"))
    return of_parsed(rows), headers(inputs.select("input_id").distinct().join(made, "input_id", "left"), rows, currencies, total, "image")


def of_parsed(rows: DataFrame) -> DataFrame:
    kept = rows.where("reject_reason is null")
    return kept.select("input_id", F.col("line_no").cast("long").alias("line_no"), F.col("page").cast("int").alias("page"), F.col("date").cast("string").alias("date"), "description", F.col("price").cast("decimal(18,2)").alias("price"), "currency", F.col("original_price").cast("decimal(18,2)").alias("original_price"), "original_currency", F.col("installment.current").alias("installment_current"), F.col("installment.total").alias("installment_total"), "direction", "confidence")


def headers(inputs: DataFrame, rows: DataFrame, currencies: DataFrame, totals: DataFrame, kind: str) -> DataFrame:
    """(input_id, counts, average_confidence, total_debit, total_credit, document_currency, rejected_lines, warnings) of parsed lines, with and without a reject_reason."""
    ok = F.col("reject_reason").isNull()
    signs = F.col("date").isNotNull() | F.col("price").isNotNull()
    money = lambda d: F.coalesce(F.sum(F.when(ok & (F.col("direction") == d), F.col("price").cast("decimal(18,2)"))), F.lit(0).cast("decimal(18,2)"))
    facts = rows.groupBy("input_id").agg(
        F.count_if(ok).alias("transaction_count"), F.count_if(ok & (F.col("confidence") < 0.70)).alias("low_confidence_count"), T.rounded(F.avg(F.when(ok, F.col("confidence")))).alias("average_confidence"),
        money("debit").alias("total_debit"), money("credit").alias("total_credit"), (F.count(F.lit(1)) if kind == "pdf" else F.count_if(signs)).alias("candidate_line_count"),
    )
    place = F.struct("page", "line_no", *(["merged"] if "merged" in rows.columns else []))
    first = rows.where(~ok & signs).select("input_id", "text", place.alias("_at")).withColumn("_r", F.row_number().over(Window.partitionBy("input_id").orderBy("_at", "text"))).where(F.col("_r") <= REJECTED[kind])
    rejected = first.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("rejected_lines"))
    out = inputs.select("input_id", *(["_made"] if "_made" in inputs.columns else [])).distinct()
    for side in (facts, totals, currencies, rejected):
        out = out.join(side, "input_id", "left")
    zero = ["transaction_count", "low_confidence_count", "candidate_line_count", "total_lines"]
    out = out.fillna(0, zero).withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(18,2)")) for c in ("total_debit", "total_credit")}).withColumn("document_currency", F.coalesce("document_currency", F.lit("TRY"))).withColumn("rejected_lines", F.coalesce("rejected_lines", F.array().cast("array<string>")))
    unread = F.when(F.col("total_lines") == 0, "no_text_lines_extracted_from_pdf" if kind == "pdf" else "no_ocr_lines_extracted")
    said = [*([F.when(F.col("_made").isNull(), "no_preprocessing_outputs_found")] if kind == "image" else []), unread, F.when(F.col("transaction_count") == 0, "no_transactions_detected")]
    return out.withColumn("warnings", F.array_compact(F.array(*said))).drop("_made")


def record_id(prefix: str, *parts: Column) -> Column:
    """An identifier that a repeated run makes again."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32))


def parted(rows: DataFrame, heads: DataFrame, count: str = "transaction_count") -> DataFrame:
    """rows dealt over the parts of their document: (input_id, part, transactions), by a hash of the whole row."""
    parts = heads.select("input_id", F.greatest(F.lit(1), F.ceil(F.col(count) / PART_ROWS)).cast("int").alias("parts"))
    fields = [c for c in rows.columns if c != "input_id"]
    dealt = rows.join(parts, "input_id").select("input_id", F.pmod(F.xxhash64(*fields), F.col("parts")).cast("int").alias("part"), F.struct(*fields).alias("t"))
    return dealt.groupBy("input_id", "part").agg(F.array_sort(F.collect_list("t")).alias("transactions"))


def with_parts(heads: DataFrame, lists: DataFrame, count: str = "transaction_count") -> DataFrame:
    """heads, a row for each of their parts; parts without a row have null transactions."""
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / PART_ROWS)).cast("int")
    return heads.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).join(lists, ["input_id", "part"], "left")


def extraction_records(txn: DataFrame, heads: DataFrame, at: Column, source_kind: str = "real_pdf", extraction_type: str = "pdf_data_extraction", method: str = "native_pdf_text", version: str = "pdf-native-v1") -> DataFrame:
    """Records to append for transactions and headers of extraction(): result holds transactions and summary, debug what was left out."""
    rows = with_parts(heads, parted(txn, heads))
    summary = F.struct("transaction_count", "low_confidence_count", "average_confidence", "total_debit", "total_credit", "document_currency")
    result = F.to_json(F.struct(F.coalesce("transactions", F.array().cast(f"array<{TRANSACTION}>")).alias("transactions"), summary.alias("summary"), "warnings"))
    debug = F.to_json(F.struct("document_currency", "total_lines", "candidate_line_count", "transaction_count", "low_confidence_count", F.col("rejected_lines").alias("rejected_candidate_lines")))
    return rows.select(
        record_id("ext_", F.col("input_id"), F.lit(extraction_type), F.lit(version), at).alias("record_id"), "input_id", "part", "parts", at.cast("timestamp").alias("created_at"), F.lit("completed").alias("status"), F.lit(source_kind).alias("source_kind"), F.lit(extraction_type).alias("type"),
        F.lit(method).alias("method"), F.lit(version).alias("version"), "transaction_count", "low_confidence_count", "average_confidence", result.alias("result"), debug.alias("debug"), "warnings",
    )


def latest(records: DataFrame) -> DataFrame:
    """All parts of the last record of each document, by created_at and record_id."""
    heads = records.where("part = 0").groupBy("input_id").agg(F.max(F.struct("created_at", "record_id")).alias("_m")).select("input_id", F.col("_m.record_id").alias("record_id"))
    return records.join(heads, ["input_id", "record_id"], "left_semi")


def body(result: Column) -> Column:
    """The JSON that has the transactions: the record's own, or that under its key `result` where it has no key `transactions`."""
    inner = F.get_json_object(result, "$.result")
    return F.when(F.coalesce(F.array_contains(F.json_object_keys(result), "transactions"), F.lit(False)), result).otherwise(F.coalesce(F.when(inner.startswith("{"), inner), result))


def transactions_of(records: DataFrame, kind: str = TRANSACTION) -> DataFrame:
    """(record_id, input_id, method, the fields of kind) of each transaction of the records, under either key; a null or missing list has none."""
    # both places are read in one pass; only where neither has a list, or the inner one has, is it asked which keys there are
    both = F.from_json("result", f"transactions array<{kind}>, result struct<transactions: array<{kind}>>")
    outer, inner = F.col("_p.transactions"), F.col("_p.result.transactions")
    keyed = F.coalesce(F.array_contains(F.json_object_keys("result"), "transactions"), F.lit(False))
    odd = F.from_json(body(F.col("result")), f"transactions array<{kind}>")["transactions"]
    listed = F.when(outer.isNotNull(), outer).when(inner.isNotNull(), F.when(~keyed, inner)).otherwise(odd)
    rows = records.withColumn("_p", both).withColumn("_t", F.explode(listed))
    return rows.select("record_id", "input_id", "method", "_t.*")


def normalize_latest(records: DataFrame, at: Column, version: str = "normalization-v1") -> dict[str, DataFrame]:
    """The last extraction of each document, normalised: rows, scores' summary, and the records to append.

    Warnings of the extraction go on; duplicates that were removed are added to them.
    """
    last = latest(records)
    raw = transactions_of(last).select("input_id", F.col("line_no").alias("seq"), "date", "price", "currency", "description", "direction", "confidence", "installment_current", "installment_total")
    carried = last.where("part = 0").select("input_id", F.col("record_id").alias("extraction_id"), F.col("warnings").alias("_warnings"))
    out = N.documents(raw, carried.select("input_id"))
    heads = out["summary"].join(carried, "input_id").withColumn("warnings", F.concat(F.coalesce("_warnings", F.array().cast("array<string>")), "warnings"))
    rows = out["transactions"].withColumn("date", F.col("date").cast("string"))
    made = with_parts(heads, parted(rows, heads))
    summary = F.struct("transaction_count", "duplicate_removed_count", "total_debit", "total_credit", "net_amount", "currencies", "primary_currency", "invalid_count", "warning_count", "low_confidence_count", F.col("overall_confidence").alias("average_confidence"))
    scores = F.struct("overall_confidence", "min_confidence", "max_confidence", "low_confidence_count", "invalid_count", "warning_count", "validation_passed")
    lists = F.coalesce("transactions", F.array().cast(made.schema["transactions"].dataType))
    out["records"] = made.select(
        record_id("norm_", F.col("input_id"), F.col("extraction_id"), at).alias("record_id"), "input_id", "extraction_id", "part", "parts", at.cast("timestamp").alias("created_at"), F.lit("completed").alias("status"), F.lit("normalization").alias("method"), F.lit(version).alias("version"),
        "transaction_count", "duplicate_removed_count", "low_confidence_count", "overall_confidence", F.to_json(F.struct(lists.alias("transactions"), summary.alias("summary"))).alias("result"), F.to_json(F.struct(scores.alias("summary"))).alias("scores"), "warnings",
    )
    return out
