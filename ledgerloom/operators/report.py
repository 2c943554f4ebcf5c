"""Sentences about a document: summary, answers by intent, context for a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, taxonomy
from ..functions import text as T

S = fixed.SAYINGS
percent = T.percent


def amount(c: Column) -> Column:
    return F.format_number(c, 2)


def facts(profiles: DataFrame, results: DataFrame, forecasts: DataFrame, recommended: DataFrame) -> DataFrame:
    """One row for each document with what sentences need, from its profile, anomaly_results(), spending_forecast() and installments(), each of which has one row for a document."""
    rows = profiles.join(results.select("input_id", "anomaly_count", "worst"), "input_id", "left").withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
    rows = rows.join(forecasts.select("input_id", "predicted", F.col("currency").alias("forecast_currency")), "input_id", "left")
    return rows.join(recommended.select("input_id", "recommended_months", "risk_level"), "input_id", "left")


def summary(rows: DataFrame) -> DataFrame:
    """(input_id, sentences)."""
    said = F.array_compact(
        F.array(
            F.when(F.col("primary_share").isNotNull(), F.format_string(S["top_category"], F.col("primary_category"), percent(F.col("primary_share")))),
            F.when(F.size("labels") > 0, F.format_string(S["profile"], F.array_join("labels", ", "))),
            F.when(F.col("anomaly_count") > 0, F.format_string(S["some_anomalies"], F.col("anomaly_count"))).otherwise(S["no_anomaly"]),
            F.when(F.col("predicted").isNotNull(), F.format_string(S["forecast"], amount(F.col("predicted")), F.col("forecast_currency"))),
            F.when(F.col("recommended_months").isNotNull(), F.format_string(S["installment"], F.col("recommended_months"))),
        )
    )
    return rows.select("input_id", said.alias("sentences"))


def answers(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(input_id, question, intent, answer) for questions (input_id, question) about documents in rows."""
    q = questions.withColumn("intent", T.intent(F.col("question"))).join(rows, "input_id", "left")
    i = F.col("intent")
    said = (
        F.when((i == "category_question") & F.col("primary_category").isNotNull(), F.format_string(S["answer_category"], F.col("primary_category"), percent(F.col("primary_share"))))
        .when((i == "anomaly_question") & (F.col("anomaly_count") > 0), F.format_string(S["answer_anomalies"], F.col("anomaly_count"), F.col("worst")))
        .when(i == "anomaly_question", S["answer_no_anomaly"])
        .when((i == "installment_question") & F.col("recommended_months").isNotNull(), F.format_string(S["answer_installment"], F.col("recommended_months")))
        .when(i == "installment_question", S["answer_no_installment"])
        .when((i == "forecast_question") & F.col("predicted").isNotNull(), F.format_string(S["forecast"], amount(F.col("predicted")), F.col("forecast_currency")))
        .when(i == "forecast_question", S["answer_no_forecast"])
        .otherwise(S["answer_general"])
    )
    return q.select("input_id", "question", "intent", said.alias("answer"))


def context(rows: DataFrame, categories: DataFrame, anomalies: DataFrame, k: int = 3) -> DataFrame:
    """(input_id, lines): what a model would be told of each document in rows (of facts()): its profile, the k largest categories, the number of anomalies and the k worst, forecast and installment. Lists stay within k while they are gathered by rank."""
    from pyspark.sql.window import Window

    C = fixed.CONTEXT
    top = lambda df, *order: df.withColumn("_r", F.row_number().over(Window.partitionBy("input_id").orderBy(*order))).where(F.col("_r") <= k)
    gather = lambda df, line, name: df.select("input_id", F.struct("_r", line.alias("line")).alias("x")).groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias(name))
    a = gather(top(categories, F.desc("total_amount"), "category"), F.concat(taxonomy.label(F.col("category")), F.lit(" ("), percent(F.col("share_of_spend")), F.lit("%)")), "_categories")
    plain = F.replace(amount(F.col("amount")), F.lit(","), F.lit(""))
    b = gather(top(anomalies, F.desc("score"), "seq"), F.format_string(C["anomaly"], F.col("merchant_text"), plain, F.col("currency"), F.col("severity")), "_anomalies")
    met = rows.join(a, "input_id", "left").join(b, "input_id", "left")
    none = F.array().cast("array<string>")
    one = lambda condition, line: F.when(condition, F.array(line)).otherwise(none)
    lines = F.concat(
        one(F.col("primary_share").isNotNull(), F.format_string(C["primary"], F.col("primary_category"), percent(F.col("primary_share")))), one(F.size("labels") > 0, F.format_string(C["labels"], F.array_join("labels", ", "))),
        one(F.col("_categories").isNotNull(), F.format_string(C["categories"], F.array_join("_categories", ", "))), F.array(F.format_string(C["anomalies"], F.col("anomaly_count"))), F.coalesce("_anomalies", none),
        one(F.col("predicted").isNotNull(), F.format_string(C["forecast"], F.replace(amount(F.col("predicted")), F.lit(","), F.lit("")), F.col("forecast_currency"))),
        one(F.col("recommended_months").isNotNull(), F.format_string(C["installment"], F.col("recommended_months"), F.col("risk_level"))),
    )
    return met.select("input_id", lines.alias("lines"))


def chat_target(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """Questions with the analysis that they carry (analysis), else the stored one by analysis_id; those with neither keep null."""
    kept = stored.select("analysis_id", F.col("analysis").alias("_stored"))
    return questions.join(kept, "analysis_id", "left").withColumn("analysis", F.coalesce("analysis", "_stored")).drop("_stored")
