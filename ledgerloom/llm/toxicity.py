"""Toxicity by class-conditional Kneser-Ney character models, and the query op2.

A word is read as `^word$`, each character given up to five before it. The highest order is counted for each
class over the labelled sample. Every lower order is shared by the classes and is Kneser-Ney's continuation
count over the **whole** corpus: in how many distinct longer n-grams an n-gram ends. Rare expressions of either
class are smoothed by this same backoff.

A history that the sample never shows gives both classes the same probability, and an n-gram it never shows
after a known history differs by the history's freed mass alone. So the corpus is counted in full, but only
n-grams and histories of the sample need a log-ratio; these are broadcast, and are bounded by the sample:
at most `max_labelled` rows and `max_chars` characters of each class.

A text's evidence is its log-likelihood as toxic less that as ordinary, by its length; twice more with toxic
text read as ordinary but for a share of its words (a mixture by word), by the length and by its root. A
logistic calibration of the three is fitted on what sampled documents get from models without their fold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_by, only, small_batches, stored, table

WORD = re.compile(r"[^\W\d_]+")
ORDER, DISCOUNT = 6, 0.75
#: Bounds of the labelled sample: rows, and characters of each class.
MAX_LABELLED, MAX_CHARS = 65_536, 8_000_000
FOLDS, THRESHOLD = 4, 0.3
#: Words longer than this are read in pieces of it.
WORD_CHARS = 64
#: Distinct words that a task reads as n-grams at once, and whose evidence a worker keeps.
STEP_WORDS, MEMO_WORDS = 100_000, 400_000
#: Words added to a text's length: the part of its evidence that is prior.
PRIOR_WORDS = 8.0
#: Observations of the shared distribution that each history of a class starts with.
STRENGTH = 10.0
#: Share of a toxic document's words that are not ordinary; the rest of it is read as ordinary text.
SHARE = 0.03
#: Probability of a character before anything is counted.
UNIFORM = 1 / 512
#: Chance of toxicity where no label is known, as half an observation.
PRIOR = 0.05

#: Counts by class (0, 1) and fold; models of all folds, and without each.
COUNTS = [f"c{y}{f}" for y in (0, 1) for f in range(FOLDS)]
MODELS = ["", *map(str, range(FOLDS))]
_R = np.random.default_rng(2).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> list[str]:
    """Lower-case words; very long ones in pieces."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) > WORD_CHARS:
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


class Places:
    """The characters of words to be predicted: for each its word, place, length of history, and 64-bit hashes of history and n-gram."""

    def __init__(self, ws: list[str]) -> None:
        self.s = np.frombuffer("".join([f"^{w}$" for w in ws]).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w in ws], np.int64)
        within = np.arange(len(self.s)) - np.repeat(np.cumsum(size) - size, size)
        self.at = np.flatnonzero(within > 0)
        self.word = np.repeat(np.arange(len(ws)), size)[self.at]
        self.depth = np.minimum(within[self.at], ORDER - 1)
        self.history, self.gram = self.hashes(self.at - 1, self.depth - 1), self.hashes(self.at, self.depth)

    def hashes(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        h = self.s[at] * _R[0]
        for k in range(1, ORDER):
            on = depth >= k
            h[on] += self.s[at[on] - k] * _R[k]
        return h

    def spelled(self, rows: np.ndarray) -> pa.Array:
        """The n-grams at the given places."""
        start, size = self.at[rows] - self.depth[rows], self.depth[rows] + 1
        i = np.arange(ORDER)
        codes = np.where(i < size[:, None], self.s[np.minimum(start[:, None] + i, len(self.s) - 1)], 0)
        return pa.array(np.ascontiguousarray(codes.astype("<u4")).view(f"<U{ORDER}").ravel(), pa.string())


def string_hashes(grams: list[str]) -> np.ndarray:
    """The hashes that Places gives to these n-grams of up to ORDER characters."""
    out = np.zeros(len(grams), np.uint64)
    if grams:
        size = np.array([len(g) for g in grams])
        codes = np.array(grams, f"<U{ORDER}").view("<u4").reshape(-1, ORDER).astype(np.uint64)
        for k in range(ORDER):
            on = size > k
            out[on] += codes[on, size[on] - 1 - k] * _R[k]
    return out


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS, held_out: int | None = 2) -> DataFrame:
    """(doc_id, toxic, fold, weight): the sample, one row for each doc_id, least hash first within both bounds. Texts of over a
    sixteenth of max_chars come after all others, and a class always has its first, so that no long text ends a class.

    Of a doc_id's labels the worst counts; rows with nulls and those of the fold `held_out` don't. weight: labelled
    documents of the class (before the bound on characters) for each one sampled.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold)
    if held_out is not None:
        rows = rows.where(F.col("fold") != held_out)
    few = stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labels")
    chars = docs.select("doc_id", F.length("text").alias("n")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    # at most max_labelled rows in the two windows
    by = Window.partitionBy("toxic")
    turn = by.orderBy(F.col("n") > max_chars // 16, F.xxhash64("doc_id"), "doc_id")
    rows = chars.select("*", F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(turn).alias("turn"), F.count(F.lit(1)).over(by).alias("all"))
    kept = rows.where((F.col("upto") <= max_chars) | (F.col("turn") == 1)).withColumn("weight", F.col("all") / F.count(F.lit(1)).over(by))
    return stored(kept.select("doc_id", "toxic", "fold", "weight"), "sample")


def corpus_grams(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """gram, counts by class and fold: the longest n-grams of all words of the corpus; counts are of the sample's words."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id", "left")
    rows = rows.select("text", (F.col("toxic") * FOLDS + F.col("fold")).cast("int").alias("code"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        seen: set[str] = set()
        by: list[Counter] = [Counter() for _ in COUNTS]

        def flush() -> pa.RecordBatch:
            ws = list(seen)
            p = Places(ws)
            _, first, inverse = np.unique(p.gram, return_index=True, return_inverse=True)
            columns = []
            for c in by:
                n = np.array([c.get(w, 0) for w in ws], np.int64) if c else None
                columns.append(np.bincount(inverse, n[p.word], len(first)).astype(np.int64) if c else np.zeros(len(first), np.int64))
                c.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([p.spelled(first), *map(pa.array, columns)], names=["gram", *COUNTS])

        for b in batches:
            for t, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                seen.update(ws)
                if code is not None:
                    by[code].update(ws)
                if len(seen) > STEP_WORDS:
                    yield flush()
        if seen:
            yield flush()

    found = rows.mapInArrow(count, "gram string, " + ", ".join(f"{c} long" for c in COUNTS))
    return stored(found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS)), "grams")


def suffix(gram: Column, k: Column | int) -> Column:
    """The last k characters."""
    return F.substring(gram, -F.lit(k) if isinstance(k, int) else -k, F.lit(ORDER))


def continuations(grams: DataFrame) -> DataFrame:
    """gram, a, b: the shared model of lower orders (up to ORDER - 1 characters): p(gram) = a + b * p(gram without its first character)."""
    ends = F.sequence(F.lit(2), F.length("gram"))
    longer = grams.where("length(gram) >= 2").select(F.explode(F.transform(ends, lambda k: suffix(F.col("gram"), k))).alias("x")).distinct()
    counts = longer.groupBy(F.expr("substring(x, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))  # at most a row for each character of the alphabet
    total = F.sum("n").over(of)
    return counts.select("gram", ((F.col("n") - DISCOUNT) / total).alias("a"), (F.count(F.lit(1)).over(of) * DISCOUNT / total).alias("b"))


def backoff(grams: DataFrame) -> DataFrame:
    """The sample's n-grams with their counts and `lower`, the shared probability of their last character by the history without its first."""
    known = grams.where(" + ".join(COUNTS) + " > 0")
    pieces = known.select("gram", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    found = pieces.withColumn("end", suffix(F.col("gram"), F.col("k"))).join(continuations(grams).select(F.col("gram").alias("end"), "a", "b").hint("merge"), "end")
    steps = F.array_sort(F.collect_list(F.struct("k", "a", "b")))
    lower = found.groupBy("gram").agg(F.aggregate(steps, F.lit(UNIFORM), lambda p, s: s["a"] + s["b"] * p).alias("lower"))
    return known.join(lower.hint("merge"), "gram")


def smoothed(n: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """Discounted counts of a class; the freed mass and STRENGTH more observations are spread as the lower order."""
    return (F.greatest(n - DISCOUNT, F.lit(0.0)) + (kinds * DISCOUNT + STRENGTH) * lower) / (total + STRENGTH)


def ratios(known: DataFrame, models: list[str] = MODELS) -> tuple[DataFrame, DataFrame]:
    """(gram, r of each model) and (gram, r of each model): log p(last character | toxic) - log p(.. | ordinary) of the sample's n-grams, and of all others after each of its histories. known: gram, counts, lower."""
    of = Window.partitionBy("history")
    by = {f"{y}_{m}": sum(F.col(f"c{y}{f}") for f in range(FOLDS) if str(f) != m) for y in (0, 1) for m in models}
    rows = known.select("gram", "lower", F.expr("substring(gram, 1, length(gram) - 1)").alias("history"), *(c.alias(f"n{k}") for k, c in by.items()))
    sums = [x for k in by for x in (F.sum(f"n{k}").over(of).alias(f"t{k}"), F.sum((F.col(f"n{k}") > 0).cast("int")).over(of).alias(f"k{k}"))]
    rows = rows.select("*", *sums)
    own = {k: F.log(smoothed(F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"k{k}"), F.col("lower"))) for k in by}
    rest = {k: F.log((F.col(f"k{k}") * DISCOUNT + STRENGTH) / (F.col(f"t{k}") + STRENGTH)) for k in by}
    ratio = lambda p: [(p[f"1_{m}"] - p[f"0_{m}"]).cast("float").alias(f"r{m}") for m in models]
    rows = stored(rows, "ratios")
    return rows.select("gram", *ratio(own)), rows.select(F.col("history").alias("gram"), *ratio(rest)).dropDuplicates(["gram"])


class Ratios(NamedTuple):
    """Sorted hashes of the sample's n-grams and histories, and their log-ratios, a row for each model."""

    grams: np.ndarray
    of_grams: np.ndarray
    histories: np.ndarray
    of_histories: np.ndarray

    def evidence(self, ws: list[str]) -> np.ndarray:
        """Plain evidence of each word, a row for each model."""
        p = Places(ws)
        out = np.zeros((len(self.of_grams), len(ws)))
        if not len(self.grams):
            return out
        h = np.minimum(np.searchsorted(self.histories, p.history), len(self.histories) - 1)
        on = self.histories[h] == p.history
        h, gram, word = h[on], p.gram[on], p.word[on]
        g = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        met = self.grams[g] == gram
        for row, of_grams, of_histories in zip(out, self.of_grams, self.of_histories):
            row += np.bincount(word, np.where(met, of_grams[g], of_histories[h]), len(ws))
        return out


def collected(tables: tuple[DataFrame, DataFrame], models: list[str]) -> Ratios:
    """The tables of ratios() in arrays; their rows are bounded by the sample's characters."""
    out: list[np.ndarray] = []
    for t in tables:
        found = t.select("gram", *(f"r{m}" for m in models)).toArrow()
        h = string_hashes(found.column("gram").to_pylist())
        order = np.argsort(h)
        out += [h[order], np.stack([found.column(f"r{m}").to_numpy()[order] for m in models])]
    return Ratios(*out)


class Reader:
    """features(): evidence of texts by a model; keeps that of words it has met."""

    def __init__(self, known: Ratios) -> None:
        self.known = known
        self.index: dict[str, int] = {}
        self.e = np.zeros((2, len(known.of_grams), 0))

    def features(self, texts: list[str], model: list[int]) -> np.ndarray:
        """(a row for each feature, a column for each text): mixture by length and by its root, plain by length."""
        bags = [Counter(words(t)) for t in texts]
        if len(self.index) > MEMO_WORDS:
            self.index.clear()
            self.e = self.e[:, :, :0]
        new = list({w for b in bags for w in b if w not in self.index})
        if new:
            plain = np.concatenate([self.known.evidence(new[i : i + STEP_WORDS]) for i in range(0, len(new), STEP_WORDS)], 1)
            part = np.log1p(SHARE * np.expm1(np.clip(plain, -50, 50)))
            self.e = np.concatenate([self.e, np.stack([part, plain]).astype(np.float32)], 2)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        out = np.zeros((3, len(texts)))
        get = self.index.__getitem__
        for j, (b, m) in enumerate(zip(bags, model)):
            n = np.fromiter(b.values(), np.float64, len(b))
            size = n.sum() + PRIOR_WORDS
            part, plain = self.e[:, m, np.fromiter(map(get, b), np.int64, len(b))] @ n
            out[:, j] = part / size, part / np.sqrt(size), plain / size
        return out


_readers: dict[int, Reader] = {}
kept_by("toxicity", _readers.clear)


def reader(known) -> Reader:
    """One for each broadcast model and worker process; an older model's goes."""
    if known.value is not getattr(_readers.get(0), "known", None):
        _readers[0] = Reader(known.value)
    return _readers[0]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of the rows of x, and the intercept, by Newton steps; without both classes the intercept alone."""
    weight = np.ones(len(y)) if weight is None else weight
    if len(y) == 0 or y.min() == y.max():
        ones = float((weight * y).sum())
        return np.array([0.0] * len(x) + [float(np.log((ones + PRIOR / 2) / (weight.sum() - ones + (1 - PRIOR) / 2)))])
    scale = np.maximum(np.std(x, axis=1), 1e-12)
    m, w = np.concatenate([x / scale[:, None], np.ones((1, len(y)))]), np.zeros(len(x) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ m, -30, 30)))
        step = np.linalg.solve((m * (weight * p * (1 - p))) @ m.T + ridge * np.eye(len(w)), m @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.append(scale, 1.0)


class Trained(NamedTuple):
    """The model of all folds, and the weights of the calibration."""

    ratios: Ratios
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS, held_out: int | None = 2) -> Trained:
    """The model and its calibration. docs: doc_id, text; labels: doc_id, toxic (0 or 1). Without labels every text gets PRIOR."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled(docs, labels, max_labelled, max_chars, held_out)
    known = collected(ratios(backoff(corpus_grams(docs, sample))), MODELS)
    of_folds = spark.sparkContext.broadcast(Ratios(known.grams, known.of_grams[1:], known.histories, known.of_histories[1:]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        r = reader(of_folds)
        for b in batches:
            f = r.features(b.column(0).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), *map(pa.array, f)], names=["toxic", "weight", "a", "b", "c"])

    sampled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # rows that repeat a doc_id count as one: at most max_labelled rows
    sampled = sampled.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "fold", "weight")).alias("s")).select("s.*")
    rows = sampled.select("text", "toxic", "fold", "weight").mapInArrow(read, "toxic int, weight double, a double, b double, c double").toPandas()
    of_folds.unpersist()
    return Trained(Ratios(known.grams, known.of_grams[:1], known.histories, known.of_histories[:1]), logistic(rows[["a", "b", "c"]].to_numpy().T, rows["toxic"].to_numpy(float), rows["weight"].to_numpy()))


def score(docs: DataFrame, trained: Trained, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the toxicity of each whole text in column `out`, from 0 to 1. Null and empty texts get the score of no evidence."""
    spark = docs.sparkSession
    small_batches(spark)
    known, weights = spark.sparkContext.broadcast(trained.ratios), trained.weights

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("toxicity")
        r = reader(known)
        for texts in batches:
            z = weights[:-1] @ r.features(texts.tolist(), [0] * len(texts)) + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
