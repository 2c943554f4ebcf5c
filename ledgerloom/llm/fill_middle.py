"""Fill-in-middle transformation as relations, and the query op12.

A text is cut into units by a pattern; units are exploded with their ordinal, a running sum of their lengths by
document gives the place where each ends, requests for cuts (two ordinals a document) meet the units by ordinal,
their offsets are aggregated to one row a document, and that row meets the text, which substring takes apart.
Columns only: no Python touches a text. Texts are shuffled once, for the last join; before it only lengths travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: A line with its end, or the last one without.
UNIT = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEY = ["_k1", "_k2"]


def drawn(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th (from 0) of eight 32-bit numbers that seed and doc_id give: groups of the SHA-256's hexadecimal digits."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1 + 8 * i, 8), 16, 10).cast("long")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, key): 128 bits of id and text, by which equal rows are one and other rows of an id are apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(SEED), "text", "doc_id")})


def cuts(rows: DataFrame, unit: str, seed: int, rate: int, spm: int) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars) of each distinct row of keyed(); the two lengths are null for plain ones."""
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    h = [drawn(F.col("doc_id"), seed, i) for i in range(4)]
    lengths = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), lambda u: F.length(u))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    said = rows.select(*KEY, lengths.alias("lengths"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    # equal rows are one before they meet; from here on all is dealt by KEY, once
    said = said.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("lengths", "form", "h1", "h2"))).withColumn("n", F.size("lengths").cast("long"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    moved = said.where("form != 'plain'")
    wanted = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.least(a, b).alias("after")), F.struct(F.lit(1).alias("which"), F.greatest(a, b).alias("after"))))
    requests = moved.select(*KEY, wanted.alias("r")).select(*KEY, "r.which", "r.after")
    units = moved.select(*KEY, F.posexplode("lengths").alias("at", "chars"))
    ends = units.select(*KEY, (F.col("at") + 1).cast("long").alias("ordinal"), F.sum("chars").over(Window.partitionBy(*KEY).orderBy("at")).alias("end"))
    # the ordinal is no key of the join, so that both sides stay where the window has left them
    met = ends.join(requests.hint("merge"), KEY).where(F.col("ordinal") - F.col("after") == 0)
    offsets = met.groupBy(*KEY).agg(*(F.max(F.when(F.col("which") == i, F.col("end"))).alias(c) for i, c in enumerate(("first", "second"))))  # a cut before all units meets none
    first, second = (F.coalesce(c, F.lit(0).cast("long")) for c in ("first", "second"))
    moves = F.col("form") != "plain"
    return said.select(*KEY, "n", "form").join(offsets.hint("merge"), KEY, "left").select(*KEY, "n", "form", F.when(moves, first).alias("prefix_chars"), F.when(moves, second - first).alias("middle_chars"))


def output(form: Column, text: Column, prefix_chars: Column, middle_chars: Column) -> Column:
    """The transformed text."""
    prefix, middle = F.substring(text, F.lit(1), prefix_chars), F.substring(text, prefix_chars + 1, middle_chars)
    suffix = F.substring(text, prefix_chars + middle_chars + 1, F.length(text))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(form: Column, out: Column) -> Column:
    """The text that output() was made of, from what it made and the form: a text with a mark in it is always plain, so that the first mark of a kind is the one put there."""
    n = len(PREFIX)
    between = {"psm": SUFFIX, "spm": PREFIX}
    parts = {}
    for k, mark in between.items():
        one = F.substring_index(F.substring(out, F.lit(n + 1), F.length(out)), mark, 1)
        rest = F.substring(out, F.length(one) + 2 * n + 1, F.length(out))
        two = F.substring_index(rest, MIDDLE, 1)
        parts[k] = (one, two, F.substring(rest, F.length(two) + n + 1, F.length(out)))
    psm, spm = parts["psm"], parts["spm"]
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(out)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of each row of docs.

    rate: percentage of texts that are transformed; spm: percentage of these whose suffix goes first. A null text is
    empty; an empty text and one with a mark in it are plain, their lengths null. A null doc_id draws as an empty
    one. Rows that repeat doc_id and text give the same each; rows that repeat a doc_id with another text are cut by
    the same numbers in their own units. Other columns are left out, whatever their names. n is 0 for an empty text.
    """
    rows = keyed(docs, doc_id, text)
    found = stored(cuts(rows, unit, seed, rate, spm), "cuts")  # both sides of the join are plain shuffles, of which Spark splits hot partitions
    met = rows.join(found.hint("merge"), KEY)
    made = output(F.col("form"), F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int"))
    return met.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", made.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units, form, lengths, and the hashes of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
r as (select doc_id, t, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 100 then 'plain' when ('0x' || substr(h, 25, 8))::bigint % 100 < 50 then 'spm' else 'psm' end as form from d),
c as (select *, coalesce(list_sum(list_transform(u[1:least(a, b)], lambda x: length(x))), 0)::bigint as p, coalesce(list_sum(list_transform(u[least(a, b) + 1:greatest(a, b)], lambda x: length(x))), 0)::bigint as m from r),
s as (select *, substr(t, 1, p) as prefix, substr(t, p + 1, m) as middle, substr(t, p + m + 1) as suffix from c),
o as (select *, case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end as o from s)
select doc_id, n::bigint as n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m end as middle_chars, sha256(o) as output_sha256,
 sha256(case form when 'psm' then substr(split_part(o, '<S>', 1), 4) || split_part(o, '<M>', 2) || split_part(split_part(o, '<M>', 1), '<S>', 2)
  when 'spm' then split_part(split_part(o, '<M>', 1), '<P>', 2) || split_part(o, '<M>', 2) || substr(split_part(o, '<P>', 1), 4) else o end) as restored_sha256 from o
"""
