"""Quality rules as a ledger of bits, and the query op13.

Measurements are taken from each whole text once; every rule is evaluated once on them and sets its bit where a
text fails. The ledger keeps measurements and bits, so that a policy (a named, versioned mask of rules) is applied
later without a text: a row is rejected if it fails a rule of the mask. What each rule does for a policy is read
from counts by bits, of which there are no more than combinations of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema_of, small_batches, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules by bit: a name and the condition under which a text fails. Bits keep their meaning; a new rule takes a new bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("many_words", "n_words > 100000"),
]
#: Policies by name and version: the rules whose failure rejects. Texts in whole sentences pass "quality" 2: it adds to
#: the base only what tables, markup and encoded data fail. "strict" takes every rule.
POLICIES: dict[tuple[str, int], list[str]] = {
    ("quality", 1): ["few_words", "repeated_words"],
    ("quality", 2): ["few_words", "repeated_words", "symbols"],
    ("strict", 1): [name for name, _ in RULES],
}
BASE, DEFAULT = ("quality", 1), ("quality", 2)


def repeated(ids: np.ndarray, size: int, n: int = WINDOW) -> int:
    """How many places lie in a run of n numbers (below size) that stands at two places or more. Runs are ranked exactly, by pairs of ranks."""
    last = len(ids) - n + 1
    if last < 2:
        return 0
    if size**n < 1 << 63:
        key = ids[:last].copy()
        for j in range(1, n):
            key = key * size + ids[j : j + last]
    else:
        key = ids[:last]
        for j in range(1, n):  # ranks and numbers are below the text's length
            key = np.unique(key, return_inverse=True)[1] * size + ids[j : j + last]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(last, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    return int(np.minimum(np.diff(np.append(at, at[-1] + n)), n).sum()) if len(at) else 0


def measured(text: str) -> tuple[int, ...]:
    """The MEASURES of a text."""
    words = WORD.findall(text)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated(ids, len(known))


def mask_of(rules: Sequence[str], names: Sequence[tuple[str, str]] = RULES) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(names)}
    return sum(bits[r] for r in set(rules))


def ledger(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The columns in carry of each row of docs, the MEASURES (long) of its text, and failures (long): bit i for the i-th rule failed.

    A null text is empty: no word, no line. Rows that repeat each get a row. Nothing is shuffled. Columns of docs that
    are not carried don't matter, whatever their names; a carried one may not have a measurement's name.
    """
    if clash := set(carry) & {*MEASURES, "failures"}:
        raise ValueError(f"columns with names of the ledger's: {sorted(clash)}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *carry)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measured(t) for t in b.column(0).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=[*carry, *MEASURES])

    out = rows.mapInArrow(measure, schema_of(rows, ", ".join(f"{m} long" for m in MEASURES), *carry))
    bits = sum((F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules)), F.lit(0).cast("long"))
    return out.withColumn("failures", bits)


def fails(policy: tuple[str, int], failures: str | Column = "failures", policies: Mapping[tuple[str, int], Sequence[str]] = POLICIES) -> Column:
    """Whether a row of a ledger fails a rule of the policy."""
    failed = F.col(failures) if isinstance(failures, str) else failures
    return failed.bitwiseAND(F.lit(mask_of(policies[policy]))) != 0


def ablation(rows: DataFrame, policies: Mapping[tuple[str, int], Sequence[str]] = POLICIES, by: Sequence[str] = ()) -> DataFrame:
    """(columns in by, policy, version, rule, n_rows, n_rejected, n_failed, n_only) of a ledger, for each rule of each policy.

    n_failed rows fail the rule, n_only of them no other rule of the policy: so many more rows would stay without it.
    Rows are counted by their bits first; policies and rules then meet these counts, not rows. An empty ledger gives no rows.
    """
    counts = rows.groupBy(*by, "failures").agg(F.count(F.lit(1)).alias("n"))
    uses = [F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask_of(names)).cast("long").alias("mask"), F.lit(mask_of([r])).cast("long").alias("bit")) for (p, v), names in policies.items() for r in names]
    met = counts.withColumn("_u", F.explode(F.array(*uses))).select(*by, "failures", "n", "_u.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return met.groupBy(*by, "policy", "version", "rule").agg(F.sum("n").alias("n_rows"), total(hit != 0).alias("n_rejected"), total(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(hit == F.col("bit")).alias("n_only"))


def overlap(rows: DataFrame, by: Sequence[str] = (), rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(columns in by, n_rows, any_failed, all_failed, mean_failed): names of the rules that some row or every row fails (bitwise or and and of the bits), and rules failed a row."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_or("failures").alias("_any"), F.bit_and("failures").alias("_all"), F.avg(F.bit_count("failures")).alias("mean_failed"))
    named = lambda c: F.array_compact(F.array(*(F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, (name, _) in enumerate(rules))))
    return out.select(*by, "n_rows", named("_any").alias("any_failed"), named("_all").alias("all_failed"), "mean_failed")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the ledger's measurements and bits, whether it fails the base, and whether the default policy keeps it."""
    rows = ledger(table(spark, sf_dir, "documents"))
    failed = fails(BASE)
    return rows.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & ~fails(DEFAULT)).alias("kept"), "failures")


OP13_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from d),
s as (select r, i, x as a, lead(x, 1) over o as b, lead(x, 2) over o as c, lead(x, 3) over o as d, lead(x, 4) over o as e from g window o as (partition by r order by i)),
h as (select r, i, count(*) over (partition by r, a, b, c, d, e) as n from s where e is not null),
p as (select r, count(distinct q) as n_repeat_words from (select r, unnest(range(i, i + 5)) as q from h where n > 1) group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
 coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join p using (r) left join l using (r)),
b as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
 + case when word_chars > 10 * n_words then 8 else 0 end + case when word_chars < 3 * n_words then 16 else 0 end + case when 10 * n_dup_lines > 3 * n_lines then 32 else 0 end + case when n_words > 100000 then 64 else 0 end)::bigint as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures & 3 <> 0 as base_failed, failures & 7 = 0 as kept, failures from b
"""
