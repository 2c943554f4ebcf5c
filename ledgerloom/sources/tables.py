"""Inputs: driver tables, their reading as transactions, documents and measurements, and raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a file of one row group would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: orders as transactions, one document for each customer; valid in Spark SQL and DuckDB alike.
TRANSACTION_SQL = """
select concat('cust_', cast(o_custkey as varchar(20))) as input_id, o_orderkey as seq, cast(o_orderdate as date) as txn_date,
 case o_orderkey % 6 when 0 then 'MIGROS ATASEHIR' when 1 then 'SHELL ISTASYON' when 2 then 'TURKCELL FATURA'
   when 3 then 'TRENDYOL YEMEK' when 4 then 'AMAZON SIPARIS' else 'KIRTASIYE DUKKANI' end as description,
 cast(o_totalprice as decimal(18,2)) as amount, 'TRY' as currency,
 case when o_orderkey % 9 = 0 then 'USD' end as original_currency,
 case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'credit' else 'debit' end as direction,
 case when o_orderkey % 7 = 0 then 6 end as installment_total,
 cast(60 + (o_orderkey % 40) as double) / 100 as confidence,
 case when o_orderkey % 20 = 0 then 'invalid' when o_orderkey % 10 = 1 then 'warning' else 'valid' end as validation_status
from {orders}
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRANSACTION_SQL.format(orders="{orders}"), orders=table(spark, sf_dir, "orders"))


#: Merchants of all categories and aliases, some misspelt, some of no category.
MERCHANT_TEXTS = [
    "PEGASUS HAVA YOLLARI", "OBILET OTOBUS", "TURKISH AIRLINES 2351234567", "WIZZ AIRLINE", "YEMEKSEPETI ISTANBUL", "MCDONALDS KADIKOY", "DOMINO'S PIZZA", "SOK MARKET 1204", "CARREFOUR  EXPRESS",
    "SHELL ISTASYON", "PO PETROL MALTEPE", "POPETROL", "UBER TRIP", "İSTANBULKART DOLUM", "ECZANE MERKEZ", "MEDICAL PARK", "LC WAIKIKI", "H&M", "PULL&BEAR 77", "STEAM GAMES", "NETFLIX.COM",
    "TURKCELL FATURA", "TÜRK TELEKOM", "GOOGLE STORAGE", "GOOGLESTORAGE", "ICLOUD", "MEDIA MARKT", "IYZICO AMAZON", "IYZICO *AMAZON SIPARIS", "BKMKITAP SIPARIS", "AIRBNB", "UDEMY KURS", "KASKO YENILEME",
    "VERGI DAIRESI", "DAIRE AIDAT", "ATM NAKIT CEKME", "HAVALE 123456", "KART ODEME", "ODEMENIZ ICIN TESEKKUR EDERIZ", "TRENDYOL", "OBİLET COM", "MIGRSO", "TURKCEL", "TEKNOSAA", "CARREFOURSA AVM",
    "STARBUCK", "HASTANESI", "OTELI", "KIRTASIYE DUKKANI", "BIMSERVER", "XYZ 42", "marketplace",
]


def described(txn: DataFrame) -> DataFrame:
    """txn with descriptions of MERCHANT_TEXTS in turn, by seq."""
    texts = F.array(*(F.lit(x) for x in MERCHANT_TEXTS))
    return txn.withColumn("description", F.element_at(texts, (F.col("seq") % len(MERCHANT_TEXTS) + 1).cast("int")))


def statement_lines(txn: DataFrame) -> DataFrame:
    """(input_id, line_no, page, text): each transaction as one line of a statement, slash date, comma decimals."""
    amount = F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))
    text = F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "description", F.when(F.col("direction") == "credit", F.lit("IADE")), F.when(F.col("installment_total").isNotNull(), F.lit("(1/6)")), amount, F.lit("TL"))
    return txn.select("input_id", F.col("seq").alias("line_no"), (F.lit(1) + F.col("seq") % 3).cast("int").alias("page"), text.alias("text"))


def lines_of(texts: DataFrame, key: str = "input_id", text: str = "text") -> DataFrame:
    """(key, line_no, text): the nonblank lines of a page text, artifacts removed."""
    from ..functions.text import without_artifacts

    rows = texts.select(key, F.posexplode(F.split(text, r"\R")).alias("line_no", "text"))
    return rows.withColumn("text", without_artifacts(F.col("text"))).where("text != ''")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, modificationTime, content), with mime and the reason for which an upload would be refused. Spark's reader leaves out files without bytes: reject_reason names them where a length comes from elsewhere."""
    files = spark.read.format("binaryFile").load(path)
    return files.withColumn("mime", mime(F.col("content"))).withColumn("reject_reason", reject_reason(F.col("length"), F.col("mime")))


def mime(content: Column) -> Column:
    """Type by the leading bytes."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.substring(head, 9, 16).isin(*(("ftyp" + b).encode().hex().upper() for b in ("heic", "heix", "hevc"))), "image/heic")
        .when(F.substring(head, 9, 16).isin(*(("ftyp" + b).encode().hex().upper() for b in ("mif1", "msf1", "heif"))), "image/heif")
        .otherwise("application/octet-stream")
    )


def is_pdf(kind: Column) -> Column:
    return kind == "application/pdf"


def is_image(kind: Column) -> Column:
    return kind.startswith("image/")


def reject_reason(length: Column, kind: Column) -> Column:
    return F.when(length == 0, "empty").when(length > fixed.MAX_UPLOAD_BYTES, "too_large").when(~kind.isin(*fixed.ALLOWED_MIME), "unsupported_type")


def first_engine(lines: DataFrame) -> DataFrame:
    """Lines of the least engine_rank that gave any for a document: a fallback engine counts only where the one before found nothing."""
    best = lines.groupBy("input_id").agg(F.min("engine_rank").alias("engine_rank"))
    return lines.join(best, ["input_id", "engine_rank"])


def taxonomy(spark: SparkSession) -> DataFrame:
    """(ord, category, label, subcategory, pattern): a fixed, small dimension."""
    from ..functions.taxonomy import pattern

    rows = [(i, c, label, sub, pattern(words)) for i, (c, label, sub, words) in enumerate(fixed.TAXONOMY)]
    return spark.createDataFrame(rows, "ord int, category string, label string, subcategory string, pattern string")
