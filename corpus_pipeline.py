"""A training-data pipeline over `documents`: five stages, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join, mixing, packing, span_dedup, toxicity
from ledgerloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Wanted shares of tokens, by the quality that the labels table gives documents that are not toxic.
WEIGHTS = {"good": 0.93, "poor": 0.07}


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold. The model learns from all labelled documents of the input (no fold is held out)."""
    rows = docs.select(*COLUMNS)
    trained = toxicity.train(rows, table(spark, sf_dir, "labels"), held_out=None)
    return toxicity.score(rows, trained, out="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates."""
    return jaccard_join.keep_first(docs.select(*COLUMNS))


def repeated_spans_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of later repeated spans; n_chars follows; a text of which nothing but white space is left goes."""
    found = span_dedup.span_dedup(docs.select(*COLUMNS), carry=["lang", "source", "n_chars"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    kept = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"\s+", " ")) != ""))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their fitted rates: the whole part, and once more if a hash of doc_id and text falls under the rest.

    Rates are fitted under the bound that none is below 1, for a budget at which no domain has to shrink: mixing
    adds copies of what is short, meets its targets and loses no clean document.
    """
    rows = docs.select(*COLUMNS)
    domains = mixing.domain_labels(table(spark, sf_dir, "labels")).where(F.col("domain") < len(WEIGHTS))
    rated = mixing.mix(rows, domains, WEIGHTS, budget="cover", least=1.0, carry=COLUMNS[1:])
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("_i", F.explode(F.sequence(F.lit(1), F.floor(F.col("rate") + part).cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 tokens; copy numbers the rows that mixing has repeated, from 0."""
    found = packing.pack(stored(packing.pieces(docs), "pieces"))
    same = Window.partitionBy("doc_id", "piece", "length", "ids_crc32").orderBy("sequence_id", "offset")
    return found.withColumn("copy", F.row_number().over(same) - 1)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("substring_dedup", repeated_spans_out),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Not expressible in SQL: trained scores, MinHash candidates, fitted rates and a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
