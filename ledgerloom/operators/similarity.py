"""Categories of texts by similarity: sparse vectors of word pieces, met through an inverted index.

The reference system compares dense vectors of a pretrained sentence model. Without one, a text's vector has a weight
for each of its word pieces; the examples of the taxonomy's reference texts are the references, and only pieces that
both sides have are ever joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, taxonomy
from ..functions import text as T
from ..sources.shared import kept
from .analytics import distinct_texts, merchant_of, small

#: Letters of a piece. Words shorter than this have one piece, with the marks at both ends.
PIECE = 3
#: From this similarity on a text takes its reference's category; its confidence is at most the second number.
THRESHOLD, MOST = 0.52, 0.90


def pieces(text: Column) -> Column:
    """Word pieces of a text, with repeats: of each word of letters and digits in folded case, marked at both ends, all runs of PIECE characters."""

    def of(word: Column) -> Column:
        marked = F.concat(F.lit("_"), word, F.lit("_"))
        return F.transform(F.sequence(F.lit(1), F.length(marked) - PIECE + 1), lambda i: F.substring(marked, i, F.lit(PIECE)))

    return F.flatten(F.transform(F.regexp_extract_all(taxonomy.folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), of))


def examples(spark: SparkSession) -> DataFrame:
    """(ord, category, subcategory, reference, example): the taxonomy's reference texts, a row for each of their examples."""
    rows = [(i, c, sub, said, x) for i, (c, sub, said) in enumerate(taxonomy.reference_texts()) if fixed.EXAMPLES[sub] and c != "other" for x in fixed.EXAMPLES[sub]]
    return spark.createDataFrame(rows, "ord int, category string, subcategory string, reference string, example string")


def counted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece, n)."""
    return texts.select(key, F.explode(pieces(F.col(text))).alias("piece")).groupBy(key, "piece").agg(F.count(F.lit(1)).alias("n"))


def inverted(references: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """((piece, key, weight, rarity), number of references): unit vectors of the references by piece. A piece's rarity is 1 + ln((R + 1) / (df + 1))."""
    total = references.count()
    rows = counted(references, key, text)
    rare = rows.groupBy("piece").agg((F.log((F.lit(total) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("rarity"))
    rows = rows.join(rare, "piece").withColumn("w", F.col("n") * F.col("rarity"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.select("piece", key, (F.col("w") / norm).alias("weight"), "rarity"), total


def top_similar(texts: DataFrame, references: DataFrame, k: int = 1, floor: float = 0.0) -> DataFrame:
    """(text, example, similarity, rank): the k references of the highest cosine of each text, of equal ones the first by ord and example.

    texts (text): met once each. references (ord, example): a dimension, checked by its size; it is broadcast as an
    inverted index, so that a text meets only references with which it shares a piece. Texts without letters, or without
    a shared piece, have no row.
    """
    if not small(references):
        raise ValueError("too many references to broadcast")
    index, total = inverted(references.coalesce(1), "example", "example")
    order = references.select("example", "ord")
    rows = counted(texts.select("text").where("text is not null").distinct(), "text", "text")
    rare = index.select("piece", "rarity").distinct()
    weighed = rows.join(F.broadcast(rare), "piece", "left").withColumn("w", F.col("n") * F.coalesce("rarity", F.log(F.lit(total + 1.0)) + 1))
    norms = weighed.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where("rarity is not null").select("text", "piece", "w").join(F.broadcast(index.select("piece", "example", "weight")), "piece").groupBy("text", "example").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    met = dots.join(norms, "text").join(F.broadcast(order), "example").select("text", "example", "ord", T.rounded(F.col("dot") / F.col("norm")).alias("similarity")).where(F.col("similarity") >= floor)
    best = Window.partitionBy("text").orderBy(F.desc("similarity"), "ord", "example")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("text", "example", "similarity", "rank")


def similar_texts(txn: DataFrame, references: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(text, category, subcategory, similarity, matched_reference): what categorized() takes for the debits of txn that no rule decides; text is said_of()."""
    spark = txn.sparkSession
    references = examples(spark) if references is None else references
    open_ = distinct_texts(txn.where("direction != 'credit'")).where(taxonomy.rule(F.col("matched")).isNull()).select(F.col("said").alias("text")).distinct()
    best = top_similar(kept(open_, "open"), references, 1, threshold)
    known = references.groupBy("example").agg(F.min_by(F.struct("category", "subcategory", "reference"), "ord").alias("r"))
    return best.join(F.broadcast(known), "example").select("text", "r.category", "r.subcategory", "similarity", F.col("r.reference").alias("matched_reference"))


def said_of(txn: DataFrame) -> Column:
    """What is compared: merchant and description without noise."""
    return T.merchant_text(raw_text(txn))


def raw_text(txn: DataFrame) -> Column:
    return F.concat_ws(" ", merchant_of(txn), "description")


def matched_text(txn: DataFrame) -> Column:
    """What rules look at: merchant and description, as they are and without noise."""
    return F.trim(F.concat_ws(" ", raw_text(txn), said_of(txn)))
