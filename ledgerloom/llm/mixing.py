"""Mixing sources to target weights by soft membership, and the query op3.

A naive Bayes classifier, fitted on a bounded sample of labelled documents, gives each document posteriors over
the domains. Nonnegative rates r of the documents are fitted by projected-gradient least squares so that the
expected tokens of each domain, the sum of r * tokens * posterior, match the targets. The gradient is distributed:
a round sums one number for each domain (and for each pair, for the step's scale) over all documents; a
document's rate follows from its posteriors and the rounds' steps, so no state is kept beside the table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by, only, schema_of, small_batches, stored, table

WORD = re.compile(r"\w+")
CELLS = 1 << 15
MAX_LABELLED = 50_000
#: Words at which the evidence of a text has half the weight that it can reach.
HALF_WORDS = 50.0
MEMO_WORDS = 500_000
#: Room above the least budget that leaves all domains whole.
SLACK = 1.1
#: Domains of the labels table, and the weights of the query.
DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}

_cells: dict[str, int] = {}
kept_by("mixing", _cells.clear)


def cells_of(text: str) -> np.ndarray:
    """The cell of each word."""
    if len(_cells) > MEMO_WORDS:
        _cells.clear()
    get, out = _cells.get, []
    for w in WORD.findall(text.lower()):
        c = get(w)
        if c is None:
            c = _cells[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % CELLS
        out.append(c)
    return np.array(out, np.int64)


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the index in DOMAINS of each labelled document; rows with nulls don't count, of several rows of a document the worst does."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)).cast("int").alias("domain"))


class Classifier:
    """Naive Bayes over word cells; the evidence of n words weighs n / (1 + n / HALF_WORDS) words."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray) -> None:
        shared = (counts.sum(0) + 1.0) / (counts.sum() + CELLS)
        self.word = np.log((counts + 200.0 * shared * CELLS / 1000) / (counts.sum(1, keepdims=True) + 200.0 * CELLS / 1000)).T.astype(np.float32)
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(docs)))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.prior)))
        for i, t in enumerate(texts):
            c = cells_of(t)
            if len(c):
                out[i] = self.word[c].mean(0, dtype=np.float64) * (len(c) / (1 + len(c) / HALF_WORDS))
        out += self.prior
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: int, max_labelled: int = MAX_LABELLED) -> Classifier:
    """From at most max_labelled rows of labelled (doc_id, domain), least hash of doc_id first."""
    small_batches(docs.sparkSession)
    sample = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # at most max_labelled rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = np.zeros((domains, CELLS), np.int64), np.zeros(domains, np.int64)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[k] += np.bincount(cells_of(t), minlength=CELLS)
                d[k] += 1
        k, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, np.arange(domains)), pa.int32()), pa.array(np.append(c, np.full(domains, -1)), pa.int32()), pa.array(np.append(n[k, c], d), pa.int64())], names=["domain", "cell", "n"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").select("domain", "text")
    found = rows.mapInArrow(count, "domain int, cell int, n long").groupBy("domain", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most domains * (CELLS + 1) rows
    counts, sizes = np.zeros((domains, CELLS)), np.zeros(domains)
    on = found["cell"] >= 0
    counts[found["domain"][on], found["cell"][on]] = found["n"][on]
    sizes[found["domain"][~on]] = found["n"][~on]
    return Classifier(counts, sizes)


def memberships(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, posteriors) and the columns named in carry: n_tokens counts words between white space; an empty text has 0 and the prior."""
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(classifier)
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), rest.alias("rest"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("mixing")
        for b in batches:
            texts = b.column(1).to_pylist()
            p = known.value.posteriors(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "rest", "n_tokens", "posteriors"])

    out = rows.mapInArrow(of, schema_of(rows, "n_tokens long, posteriors array<double>", "doc_id", "rest"))
    return out.select("doc_id", "n_tokens", "posteriors", *(F.col("rest")[c].alias(c) for c in carry))


def rate(posteriors: Column, steps: list[list[float]], least: float = 0.0) -> Column:
    """A document's rate after the steps: from max(1, least), minus posterior * step, never below `least`."""
    start = F.lit(max(1.0, float(least)))
    if not steps:
        return start
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    dot = lambda s: F.aggregate(F.zip_with(posteriors, s, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(rows, start, lambda r, s: F.greatest(F.lit(float(least)), r - dot(s)))


class Fit(NamedTuple):
    """Steps for rate(), targets in tokens, tokens reached, and whether they meet the targets."""

    steps: list[list[float]]
    targets: list[float]
    reached: list[float]
    met: bool


def fit_rates(members: DataFrame, weights: list[float], budget: float | str = "supply", least: float = 0.0, tolerance: float = 1e-6) -> Fit:
    """Nonnegative rates, none below `least`, by projected-gradient least squares.

    budget: tokens in all, "supply" for as many as there are, or "cover" for SLACK times the least budget at which no
    wanted domain has to shrink: no document's rate needs to fall below 1, and copies of other domains' documents, which
    bring a little of each domain, have room. The rounds end when the targets are met, or when no step brings the
    squared gap down by a tenth (the targets can't be met; `met` says so).
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    p = [F.col("posteriors")[i] for i in range(k)]
    t = F.col("n_tokens")

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        r = F.col("r")
        rows = members.withColumn("r", rate(F.col("posteriors"), steps, least))
        on = F.when((r > least) | F.lit(not steps), t).otherwise(0)
        row = rows.agg(*(F.sum(r * t * x) for x in p), *(F.sum(on * p[i] * p[j]) for i in range(k) for j in range(k))).first()
        v = np.array([x or 0.0 for x in row])
        return v[:k], v[k:].reshape(k, k)

    have, gram = whole = sums([])
    if budget == "supply":
        budget = float(have.sum())
    elif budget == "cover":
        budget = SLACK * float((have[share > 0] / share[share > 0]).max())
    goal = share * budget
    met = lambda x: bool(np.abs(x - goal).max() <= tolerance * max(budget, 1.0))
    steps: list[list[float]] = []
    while not met(have):
        # The gradient in the metric of the domains' overlap (the step that would close the gap were no rate to reach the bound), shorter if need be; else the plain gradient.
        over = gram if np.trace(gram) > 0 else whole[1]
        newton = np.linalg.solve(over + np.eye(k) * (1e-9 * np.trace(over) + 1e-12), have - goal)
        plain = (have - goal) / max(float(np.linalg.eigvalsh(over)[-1]), 1e-12)
        gap = float(((have - goal) ** 2).sum())
        for step in (newton, newton / 4, newton / 32, 8 * plain, plain, plain / 8):
            found = sums([*steps, step.tolist()])
            if ((found[0] - goal) ** 2).sum() < 0.9 * gap:
                break
        else:
            break
        steps.append(step.tolist())
        have, gram = found
    return Fit(steps, goal.tolist(), have.tolist(), met(have))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | str = "supply", least: float = 0.0, max_labelled: int = MAX_LABELLED, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate) of each row of docs (doc_id, text), and its columns named in carry.

    labelled: (doc_id, domain), domain being an index into weights. If documents of a domain don't exist at all its
    target can't be met and the rest of the fit is as near as the rates allow. An empty table gives an empty one.
    """
    classifier = fit_classifier(docs, labelled, len(weights), max_labelled)
    members = stored(memberships(docs, classifier, carry=carry), "memberships")
    fit = fit_rates(members, list(weights.values()), budget, least)
    return members.withColumn("rate", rate(F.col("posteriors"), fit.steps, least))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "n_tokens", *(F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate")
