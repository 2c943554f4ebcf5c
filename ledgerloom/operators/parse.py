"""Statement lines to transactions: candidate lines, document currency, parsed fields; OCR words to lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as T


def candidates(lines: DataFrame, date_mode: str = "strict") -> DataFrame:
    """Lines (input_id, line_no, page, text) and, after a line with a date but no amount, its merges with the next one and two lines of the page, until an amount appears; of equal texts on a page the first stays.

    `merged` counts the lines taken in.
    """
    w = Window.partitionBy("input_id").orderBy("line_no")
    nxt = lambda c, k: F.lead(c, k).over(w)
    rows = lines.select("input_id", "line_no", "page", "text", *(nxt(c, k).alias(f"{c}{k}") for k in (1, 2) for c in ("page", "text")))
    bare = lambda c: ~T.has_amount(c)
    # a column a step: each is worked out once, and only for lines that may go on
    rows = T.with_date(rows.withColumn("_bare", F.when(bare(F.col("text")), F.col("text"))), "_bare", "_date", date_mode)
    rows = rows.withColumn("_one", F.when(F.col("_date").isNotNull() & F.col("page1").eqNullSafe(F.col("page")), T.collapse(F.concat_ws(" ", "text", "text1"))))
    rows = rows.withColumn("_two", F.when(F.col("_one").isNotNull() & F.col("page2").eqNullSafe(F.col("page")) & bare(F.col("_one")), T.collapse(F.concat_ws(" ", "text", "text1", "text2"))))
    made = lambda c, n: F.struct(F.col(c).alias("text"), F.lit(n).alias("merged"))
    own, one, two = made("text", 0), made("_one", 1), made("_two", 2)
    all_ = F.when(F.col("_two").isNotNull(), F.array(own, one, two)).when(F.col("_one").isNotNull(), F.array(own, one)).otherwise(F.array(own))
    out = rows.select("input_id", "line_no", "page", F.explode(all_).alias("_c")).select("input_id", "line_no", "page", "_c.text", "_c.merged")
    # the first by line and merged lines as one number, so that it is found by hashing and nothing is sorted
    first = out.groupBy("input_id", "page", "text").agg(F.min(F.col("line_no").cast("long") * 4 + F.col("merged")).alias("_at"))
    return first.select("input_id", F.shiftright("_at", 2).cast(lines.schema["line_no"].dataType).alias("line_no"), "page", "text", F.col("_at").bitwiseAND(3).cast("int").alias("merged"))


def document_currency(lines: DataFrame, source: str = "pdf", default: str = "TRY") -> DataFrame:
    """(input_id, document_currency): the most frequent currency, first seen on ties. pdf: tokens anywhere, inside words too; ocr: those of amounts."""
    rows = T.with_usual(lines.select("input_id", "line_no", "text"), "text")
    usual = F.col("_usual").isNotNull()
    if source == "pdf":
        tokens = F.regexp_extract_all(F.col("text"), F.lit(f"({T.currency_pattern()})"), F.lit(1))
        found = rows.select("input_id", "line_no", F.when(usual & F.col("_usual_token").isNotNull(), F.array("_usual_token")).when(usual, F.array().cast("array<string>")).otherwise(tokens).alias("_found"))
    else:
        rows = T.with_money(rows.withColumn("text", F.when(~usual, F.col("text"))), "text", "_money")
        found = rows.select("input_id", "line_no", F.when(usual, F.array("_usual_currency")).otherwise(F.col("_money.currency")).alias("_found"))
    rows = found.select("input_id", "line_no", F.posexplode_outer("_found").alias("pos", "currency"))
    rows = rows.withColumn("currency", T.currency(F.col("currency"))) if source == "pdf" else rows
    # line and place as one number, so that counts are made by hashing
    place = F.col("line_no").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    counted = rows.groupBy("input_id", "currency").agg(F.count("currency").alias("n"), F.min(place).alias("first"))
    best = counted.groupBy("input_id").agg(F.min_by("currency", F.struct(F.col("currency").isNull(), -F.col("n"), "first")).alias("c"))
    return best.select("input_id", F.coalesce("c", F.lit(default)).alias("document_currency"))


def _description(text: Column, date_raw: Column, money: Column, installment: Column) -> Column:
    longest = F.array_sort(F.transform(money, lambda m: m["raw"]), lambda a, b: F.length(b) - F.length(a))
    gone = lambda acc, x: F.replace(acc, F.coalesce(x, F.lit("")), F.lit(" "))
    c = F.replace(text, date_raw, F.lit(" "))
    c = F.when(F.size(money) > 1, F.aggregate(longest, c, gone)).otherwise(gone(c, F.get(money, F.lit(0))["raw"]))
    for i in range(3):  # as many as an installment has
        c = gone(c, F.get(installment["raws"], F.lit(i)))
    return T.collapse(T.strip_edges(T.without_artifacts(T.without_currencies(c))))


def parsed(lines: DataFrame, currencies: DataFrame, date_mode: str = "strict", carried: tuple[str, ...] = ()) -> DataFrame:
    """Lines with the fields of a transaction, reject_reason (null: it is one) and the carried columns.

    With an installment, or one currency, the last amount is the price; with several currencies the last one in the
    document's currency, the first in another being the original amount. Most lines are parted by one match
    (T.with_usual); for these the expressions over any text get null and do nothing.
    """
    rows = lines.join(currencies, "input_id", "left").withColumn("document_currency", F.coalesce("document_currency", F.lit("TRY")))
    rows = T.with_usual(rows, "text", date_mode)
    usual = F.col("_usual").isNotNull()
    rows = rows.withColumn("clean", F.when(~usual, T.without_artifacts(F.col("text"))))
    rows = T.with_date(rows, "clean", "found_date", date_mode).withColumn("installment", F.when(usual, T.fraction_installment(F.col("_usual_fraction"))).otherwise(T.find_installment(F.col("clean"))))
    filled = F.transform("_found", lambda m: F.struct(m["raw"].alias("raw"), m["amount"].alias("amount"), F.coalesce(m["currency"], F.col("document_currency")).alias("currency")))
    one = F.col("_found")[0]
    lone = F.array(F.struct(one["raw"].alias("raw"), one["amount"].alias("amount"), F.coalesce(one["currency"], F.col("document_currency")).alias("currency")))
    rows = T.with_money(rows, "clean", "_found").withColumn("money", F.when(F.size("_found") == 1, lone).otherwise(filled)).drop("_found")
    last = F.try_element_at(F.col("money"), F.lit(-1))
    own = F.filter("money", lambda m: m["currency"] == F.col("document_currency"))
    several = (F.size("money") > 1) & (F.size(F.array_distinct(F.col("money.currency"))) >= 2)
    split = F.col("installment.current").isNotNull() | F.col("installment.total").isNotNull()
    only = F.struct(F.col("_usual_amount").alias("raw"), T.money_number(F.col("_usual_amount")).alias("amount"), F.coalesce("_usual_currency", "document_currency").alias("currency"))
    rows = rows.withColumn("_price", F.when(usual, only).when(~split & several, F.coalesce(F.try_element_at(own, F.lit(-1)), last)).otherwise(last))
    other = F.when(F.size("money") > 1, F.try_element_at(F.filter("money", lambda m: m["currency"] != F.col("_price.currency")), F.lit(1)))
    rows = rows.withColumn("_several", several).withColumn("_other", F.when(F.col("_several"), other))
    rows = rows.withColumn("description", F.when(usual, F.col("_usual")).otherwise(_description(F.col("clean"), F.coalesce("found_date.raw", F.lit("")), F.col("money"), F.col("installment"))))
    rows = rows.withColumn("_date", F.coalesce("_usual_date", "found_date.date"))
    rows = rows.withColumn("_low", T.lowered(F.coalesce("_usual", "clean"))).withColumn("_low", T.composed(F.col("_low")))
    rows = rows.withColumn("_noise", T.contains_any(F.col("_low"), fixed.NOISE_WORDS)).withColumn("direction", F.when(T.contains_any(F.col("_low"), fixed.CREDIT_WORDS), "credit").otherwise("debit"))
    reject = (
        F.when(F.col("_noise"), "noise").when(F.col("_date").isNull(), "no_date").when(~usual & (F.size("money") == 0), "no_amount").when(F.col("description") == "", "no_description")
    )
    confidence = F.round(F.least(F.lit(0.75) + F.when(F.length("description") >= 3, 0.20).otherwise(0.0) + F.when(F.col("installment.current").isNotNull(), 0.03).otherwise(0.0), F.lit(0.98)), 2)
    one = F.struct(
        "input_id", "line_no", "page", "text", reject.alias("reject_reason"), F.col("_date").alias("date"), "description", F.abs(F.col("_price.amount")).alias("price"), F.col("_price.currency").alias("currency"),
        F.abs(F.when(split, F.col("installment.total_amount")).when(F.col("_several"), F.col("_other.amount"))).alias("original_price"), F.when(split, F.col("_price.currency")).when(F.col("_several"), F.col("_other.currency")).alias("original_currency"),
        "installment", "direction", confidence.alias("confidence"), *carried,
    )
    # exploded as one struct: filters on its fields stay above, and each line is parsed once; the struct is made below, where it is compiled
    return rows.select(one.alias("_t")).select(F.explode(F.array("_t")).alias("_t")).select("_t.*")


def extract(lines: DataFrame, date_mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Transactions and rejected lines of statement lines."""
    rows = parsed(candidates(lines, date_mode), document_currency(lines), date_mode)
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def extraction_summary(txn: DataFrame) -> DataFrame:
    money = lambda d: F.round(F.sum(F.when(F.col("direction") == d, F.col("price").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))), 2)
    return txn.groupBy("input_id").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_if(F.col("confidence") < 0.70).alias("low_confidence_count"), T.rounded(F.avg("confidence")).alias("average_confidence"), money("debit").alias("total_debit"), money("credit").alias("total_credit")
    )


def ocr_confidence(base: Column, ocr: Column, words: Column) -> Column:
    return F.round(F.least(base * 0.78 + F.greatest(F.lit(0.0), F.least(ocr, F.lit(1.0))) * 0.18 + F.when(words >= 3, 0.04).otherwise(0.0), F.lit(0.98)), 2)


def parsed_ocr(lines: DataFrame, currencies: DataFrame, date_mode: str = "strict") -> DataFrame:
    """OCR lines (input_id, page, line_no, text, ocr_confidence, word_count) with the fields of parsed(); a transaction's confidence weighs that of its line and words in."""
    carried = ("ocr_confidence", "word_count")
    rows = parsed(lines.select("input_id", "page", "line_no", "text", *carried), currencies, date_mode, carried)
    return rows.withColumn("confidence", ocr_confidence(F.col("confidence"), *map(F.col, carried))).drop(*carried)


def extract_ocr(lines: DataFrame, outputs: DataFrame, date_mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Transactions and rejected lines of the best variant of each page.

    lines: as words_to_lines() gives them, for all variants; outputs (input_id, page, variant, ord, is_preferred):
    the images that were read. Each page goes on with the variant and mode of the highest final score.
    """
    chosen = chosen_lines(lines, outputs, date_mode)
    rows = parsed_ocr(chosen, document_currency(chosen, "ocr"), date_mode)
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def readable(outputs: DataFrame) -> DataFrame:
    """Images that OCR can take: those with a storage_url, if the column is there; a missing page is the first, a missing variant `unknown`."""
    rows = outputs.where("coalesce(storage_url, '') != ''") if "storage_url" in outputs.columns else outputs
    return rows.withColumn("page", F.when(F.coalesce("page", F.lit(0)) == 0, 1).otherwise(F.col("page"))).withColumn("variant", F.coalesce(F.nullif("variant", F.lit("")), F.lit("unknown")))


def chosen_lines(lines: DataFrame, outputs: DataFrame, date_mode: str = "strict") -> DataFrame:
    """Lines of the variant and mode that read best for each page: the highest final score, on ties the first variant and mode. Images in which nothing was found score -1."""
    from .classify import best_variant

    made = readable(outputs).select("input_id", "page", "variant", "ord", "is_preferred")
    scored = made.join(variant_scores(lines, date_mode), ["input_id", "page", "variant"], "left").withColumn("ocr_score", F.coalesce("ocr_score", F.lit(-1.0)))
    best = best_variant(scored).select("input_id", "page", "variant", "psm")
    return lines.join(best, ["input_id", "page", "variant", "psm"], "left_semi")


def variant_scores(lines: DataFrame, date_mode: str = "strict") -> DataFrame:
    """(input_id, page, variant, psm, ocr_score) of OCR lines (text, ocr_confidence)."""
    rows = T.with_usual(lines.select("input_id", "page", "variant", "psm", "text", "ocr_confidence"), "text", date_mode)
    usual = F.col("_usual").isNotNull()  # with a date and one amount
    rows = T.with_date(rows.withColumn("_rest", F.when(~usual, F.col("text"))), "_rest", "_date", date_mode)
    rows = rows.select("input_id", "page", "variant", "psm", "text", "ocr_confidence", (usual | F.col("_date").isNotNull()).alias("dated"), F.when(usual, 1).otherwise(F.size(T.money_texts(F.col("_rest")))).alias("money"))
    score = F.count_if(F.col("dated") & (F.col("money") > 0)) * 8 + F.count_if("dated") * 2 + F.sum("money") * 1.5 + F.avg("ocr_confidence") * 15 + F.least((F.sum(F.length("text")) + F.count(F.lit(1)) - 1) / 500, F.lit(8.0))
    return rows.groupBy("input_id", "page", "variant", "psm").agg(F.round(score, 4).alias("ocr_score"))


def ocr_words(raw: DataFrame) -> DataFrame:
    """Words (text, left, top, width, height, conf) as boxes with confidence from 0 to 1; blank words and negative confidences go."""
    rest = [c for c in raw.columns if c not in ("left", "top", "width", "height", "conf")]
    rows = raw.where((F.trim("text") != "") & (F.col("conf") >= 0))
    return rows.select(*rest, F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), (F.col("conf") / 100).alias("confidence"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines of each (input_id, page, variant, psm): words by (y0, x0, text) join the nearest group whose moving centre is within the tolerance.

    The centre moves with each word, so a page's words are taken in turn. Pages are dealt out by key and
    streamed in order; a task holds one page's words.
    """
    keys = ["input_id", "page", "variant", "psm"]

    def lines_of(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        heights = sorted(max(1, w[2] - w[0]) for w in rows)
        tolerance = max(6, heights[len(heights) // 2] * 0.55)
        lines: list[list] = []  # sum of centres, words
        for w in rows:
            c = (w[0] + w[2]) / 2
            near = min(((abs(line[0] / len(line[1]) - c), i) for i, line in enumerate(lines)), default=(tolerance + 1, -1))
            if near[0] > tolerance:
                lines.append([0.0, []])
                near = (0.0, len(lines) - 1)
            lines[near[1]][0] += c
            lines[near[1]][1].append(w)
        n = 0
        for _, group in sorted(lines, key=lambda line: line[0] / len(line[1])):
            group.sort(key=lambda w: w[1])
            text = " ".join(" ".join(w[4] for w in group).split())
            if text:
                yield (*key, n, text, min(w[1] for w in group), min(w[0] for w in group), max(w[3] for w in group), max(w[2] for w in group), round(sum(w[5] for w in group) / len(group), 4), len(group))
                n += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b[c].tolist() for c in b.columns)):
                if row[:4] != at and held:
                    out += lines_of(at, held)
                    held = []
                at = row[:4]
                held.append(row[4:])
            yield frame(out)
        if held:
            yield frame(list(lines_of(at, held)))

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*keys, "line_no", "text", "x0", "y0", "x1", "y1", "ocr_confidence", "word_count"])

    placed = words.repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "text").select(*keys, "y0", "x0", "y1", "x1", "text", "confidence")
    return placed.mapInPandas(run, "input_id string, page int, variant string, psm int, line_no int, text string, x0 int, y0 int, x1 int, y1 int, ocr_confidence double, word_count int")
