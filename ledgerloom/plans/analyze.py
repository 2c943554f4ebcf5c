"""The whole analysis of normalised transactions, all documents in one job: results by name, each worked out when it is asked for."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import analytics as A
from ..operators import report
from ..operators.similarity import similar_texts
from ..sources.shared import kept


class Analysis(Mapping):
    """Results by name. What several results start from is stored when the first of them is asked for; what none needs is not worked out."""

    NAMES = ("transactions", "reference", "categories", "category_counts", "profile", "anomalies", "anomaly_results", "monthly", "forecast", "installments", "quality", "outcome", "facts", "summary", "context")

    def __init__(self, current: DataFrame, history: DataFrame | None, scenarios: DataFrame | None, inputs: DataFrame | None) -> None:
        self.current, self.history, self.scenarios, self.inputs = current, history, scenarios, inputs

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    @cached_property
    def now(self) -> DataFrame:
        return kept(A.features(A.with_ids(self.current, "current")), "features")

    @cached_property
    def rows(self) -> DataFrame:
        categories = A.text_categories(self.now, kept(similar_texts(self.now), "similar"))
        rows = A.with_categories(self.now, categories)
        return rows if A.small(categories) else kept(rows, "categorized")

    @cached_property
    def reference(self) -> DataFrame:
        return self.now if self.history is None else kept(A.union_keep_last(A.features(A.with_ids(self.history, "history")), self.now), "reference")

    @cached_property
    def documents(self) -> DataFrame:
        return self.now.select("input_id").distinct()

    @cached_property
    def given(self) -> DataFrame | None:
        return None if self.inputs is None else self.documents.join(self.inputs, "input_id", "left")

    @cached_property
    def monthly(self) -> DataFrame:
        return A.monthly_spend(self.reference)

    @cached_property
    def forecast(self) -> DataFrame:
        return A.spending_forecast(A.reference_currency(self.now, self.given), self.monthly)

    @cached_property
    def chosen(self) -> DataFrame:
        return A.detectors(self.documents, self.now, self.reference)

    @cached_property
    def anomalies(self) -> DataFrame:
        return kept(A.anomalies(self.now, self.reference, self.chosen), "anomalies")

    @cached_property
    def anomaly_results(self) -> DataFrame:
        return A.anomaly_results(self.chosen, self.anomalies)

    @cached_property
    def profile(self) -> DataFrame:
        return A.profile(self.rows, self.documents)

    @cached_property
    def quality(self) -> DataFrame:
        return A.quality(self.now, self.given)

    @cached_property
    def installments(self) -> DataFrame:
        return A.installments(self.forecast, self.scenarios)

    @cached_property
    def outcome(self) -> DataFrame:
        return A.outcome(self.quality, self.installments, self.given)

    @cached_property
    def _categories(self) -> DataFrame:
        return A.category_summary(self.rows)

    @property
    def categories(self) -> DataFrame:
        return self._labelled(self._categories)

    @property
    def transactions(self) -> DataFrame:
        return self._labelled(self.rows)

    @cached_property
    def category_counts(self) -> DataFrame:
        return A.category_counts(self.rows)

    @cached_property
    def facts(self) -> DataFrame:
        return report.facts(self.profile, self.anomaly_results, self.forecast, self.installments)

    @cached_property
    def summary(self) -> DataFrame:
        return report.summary(self.facts)

    @cached_property
    def context(self) -> DataFrame:
        return report.context(self.facts, self._categories, self.anomalies)

    @staticmethod
    def _labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("category_label", taxonomy.label(F.col("category")))


def analyze(current: DataFrame, history: DataFrame | None = None, scenarios: DataFrame | None = None, inputs: DataFrame | None = None) -> Analysis:
    """current, history: transactions as features() takes them, with a transaction_id or without; scenarios: (input_id, amount, currency, max_months), one for a document at most.

    inputs: (input_id) and what is known of a document from before, if anything: primary_currency, overall_confidence, warnings (a
    list). Documents without a current transaction have no analysis. The reference that forecasts and outliers are measured by is
    history and current, of equal identifiers in a document the last. Features are worked out once and stored in the
    shared folder, as are the categories of distinct texts; every result starts there.
    """
    return Analysis(current, history, scenarios, inputs)
