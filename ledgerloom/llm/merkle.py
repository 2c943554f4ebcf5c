"""Document fingerprints: Merkle trees over sections, paragraphs and leaves, and the query op7.

A text is cut at blank lines and headings into sections, those at line ends into paragraphs, those after
sentence ends into leaves; a sentence over `LEAF_WORDS` words is cut by content. A leaf's hash covers its text, a
node's the hashes below it, the root's those of the sections: equal roots mean equal texts (up to hash
collisions), and comparing top-down in order meets only the branches that differ, which locates edits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, small_batches, table

LEAF_WORDS = 12
#: Blocks of neighbours for each shuffle partition.
BLOCKS = 8

SECTION = re.compile(r"(?<=\n)(?=[ \t]*\n)|(?<=\n)(?=#+ )")
SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
WORD = re.compile(r"\S+\s*|\s+")

#: (hash, characters, what lies below): sections over paragraphs over leaves; a leaf has nothing below.
Node = tuple[str, int, list]


def leaves(paragraph: str) -> list[str]:
    """Sentences of a paragraph; a long one is cut after words whose hash says so, else after 2 * LEAF_WORDS words."""
    out = []
    for s in SENTENCE.findall(paragraph):
        if s.count(" ") < LEAF_WORDS and len(s) <= LEAF_WORDS * 16:
            out.append(s)
            continue
        ws = WORD.findall(s)
        start = 0
        for i, w in enumerate(ws):
            if i + 1 - start >= 2 * LEAF_WORDS or xxhash.xxh32_intdigest(w) % LEAF_WORDS == 0:
                out.append("".join(ws[start : i + 1]))
                start = i + 1
        if start < len(ws):
            out.append("".join(ws[start:]))
    return out


def parent(below: list[Node]) -> Node:
    return xxhash.xxh3_64_hexdigest(",".join([x[0] for x in below])), sum([x[1] for x in below]), below


def tree(text: str) -> list[Node]:
    """The sections of a text."""
    hashed = xxhash.xxh3_64_hexdigest
    return [parent([parent([(hashed(x), len(x), []) for x in leaves(p)]) for p in s.splitlines(keepends=True)]) for s in SECTION.split(text)]


def root_of(sections: list[Node]) -> str:
    """32 hexadecimal digits of a SHA-256 over the sections' hashes."""
    return hashlib.sha256(",".join([s[0] for s in sections]).encode()).hexdigest()[:32]


def fingerprint(text: str) -> str:
    """root/section|paragraph,leaf and characters,...;...: the tree as a string; equal texts have equal ones."""
    sections = tree(text)
    return f"{root_of(sections)}/" + ";".join([s[0] + "".join([f"|{p[0]}" + "".join([f",{h}{n:x}" for h, n, _ in p[2]]) for p in s[2]]) for s in sections])


def parsed(print_: str) -> tuple[str, list[Node]]:
    """The root and the sections of a fingerprint."""
    root, _, body = print_.partition("/")
    sections = []
    for s in body.split(";"):
        h, *paragraphs = s.split("|")
        below = []
        for p in paragraphs:
            k, *found = p.split(",")
            nodes = [(x[:16], int(x[16:], 16), []) for x in found]
            below.append((k, sum([x[1] for x in nodes]), nodes))
        sections.append((h, sum([x[1] for x in below]), below))
    return root, sections


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Index pairs of equal nodes, ascending in both: common ends, and between them the increasing pairs with the most characters (the k-th node of a hash meets the k-th)."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    out = [(i, i) for i in range(head)]
    where = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        where[b[j][0]].append(j)
    pairs = [(i, where[a[i][0]].pop()) for i in range(head, len(a) - tail) if where.get(a[i][0])]
    # heaviest increasing subsequence: ends, ascending, with the characters reached by then, ascending too
    ends: list[int] = []
    reached: list[tuple[int, int]] = []
    back = []
    for k, (i, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        total = (reached[at - 1][0] if at else 0) + a[i][1]
        back.append(reached[at - 1][1] if at else -1)
        drop = at
        while drop < len(ends) and reached[drop][0] <= total:
            drop += 1
        ends[at:drop] = [j]
        reached[at:drop] = [(total, k)]
    k, middle = (reached[-1][1] if reached else -1), []
    while k >= 0:
        middle.append(pairs[k])
        k = back[k]
    return out + middle[::-1] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def differing(a: list[Node], b: list[Node]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start, end): character ranges of both texts under branches that differ, in order; equal branches aren't descended into."""

    def walk(x: list[Node], y: list[Node], at: int, bt: int) -> Iterator[tuple[int, int, int, int]]:
        xs, ys = list(accumulate((n[1] for n in x), initial=at)), list(accumulate((n[1] for n in y), initial=bt))
        i = j = 0
        for p, q in [*aligned(x, y), (len(x), len(y))]:
            if p > i or q > j:
                below = [m for n in x[i:p] for m in n[2]], [m for n in y[j:q] for m in n[2]]
                if below[0] and below[1]:
                    yield from walk(*below, xs[i], ys[j])
                elif xs[p] > xs[i] or ys[q] > ys[j]:
                    yield xs[i], xs[p], ys[j], ys[q]
            i, j = p + 1, q + 1

    return walk(a, b, 0, 0)


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """What differs between two fingerprints: (start, end, start, end) in characters of either text."""
    (ra, x), (rb, y) = parsed(a), parsed(b)
    return [] if ra == rb else list(differing(x, y))


def compared(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> tuple[float, list[tuple[int, int, int, int]]]:
    """Likeness of two parsed fingerprints, and what differs. Likeness: the share of the characters of both texts outside of what differs."""
    if a[0] == b[0]:
        return 1.0, []
    found = list(differing(a[1], b[1]))
    total = sum([s[1] for s in a[1]]) + sum([s[1] for s in b[1]])
    return (1.0 - sum([q - p + s - r for p, q, r, s in found]) / total if total else 0.0), found


def likeness(a: str, b: str) -> float:
    """1 for equal roots, 0 without any common leaf in a common order."""
    return compared(parsed(a), parsed(b))[0]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many of the first of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """(block, tail, doc_id, text): documents dealt into blocks of doc_id ranges; a block also has, as its tail, the document after its last one.

    Within a block, by descending doc_id then text, each row's next document is the next row. After the last
    document of all comes the first. Rows without doc_id come last.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = blocks or BLOCKS * shuffle_parts(spark)
    dealt = rows.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low"))
    lows = sorted(r["low"] for r in dealt.collect())  # one for each block: their number is set, whatever the rows
    known = spark.sparkContext.broadcast(lows)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = known.value
        for b in batches:
            block = pa.array([0 if x is None else int(np.searchsorted(low, x, "right")) for x in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([block, b.column(0), b.column(1)], names=["block", "doc_id", "text"])

    placed = rows.mapInArrow(deal, f"block int, doc_id {kind}, text string")
    # The first document of each block, in order: the greatest by (doc_id, text); it is the tail of the block above that has rows.
    heads = placed.groupBy("block").agg(F.max(F.struct("doc_id", F.xxhash64("text").alias("x"))).alias("h"))
    found = sorted(((r["block"], r["h"]["doc_id"], r["h"]["x"]) for r in heads.collect()), key=lambda r: r[0])  # one for each block
    above = {b: found[(i + 1) % len(found)][0] for i, (b, _, _) in enumerate(found)}
    tails = spark.createDataFrame([(b, d, x, above[b]) for b, d, x in found], f"block int, _d {kind}, _x long, above int")
    t = placed.join(F.broadcast(tails), "block").where(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_x")))
    t = t.select(F.col("above").alias("block"), F.lit(1).alias("tail"), "doc_id", "text")
    return placed.select("block", F.lit(0).alias("tail"), "doc_id", "text").unionAll(t)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits) of each row.

    edits: the ranges, in characters of the text and of the edited one, in which comparing the two trees finds branches that differ.

    Null texts are empty, and empty texts have the fingerprint of an empty tree. A single document is its own next.
    Rows that repeat a doc_id follow each other by descending hash of their text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    placed = with_next(docs, doc_id, text)
    ordered = placed.repartition(max(shuffle_parts(spark), 1), "block").sortWithinPartitions("block", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # block, doc_id, text, fingerprint, the same parsed

        def row(a: tuple, after: str, after_tree: tuple) -> tuple:
            e = edited(a[2], after)
            f = fingerprint(e)
            near, found = compared(a[4], parsed(f))
            return a[1], len(a[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a[3], f, near, compared(a[4], after_tree)[0], [dict(zip(("start", "end", "edited_start", "edited_end"), x)) for x in found]

        done = False
        for b in batches:
            for block, tail, k, t in zip(*(c.to_pylist() for c in b.columns)):
                follows = held is not None and held[0] == block and not done
                if follows and t == held[2]:
                    f, known = held[3:]
                elif follows or not tail:
                    f = fingerprint(t)
                    known = parsed(f)
                if follows:
                    out.append(row(held, t, known))
                done = bool(tail)
                held = (block, k, t, f, known) if follows or not tail else (block, k, t, "", None)
            if out:
                yield rows_of(out)
                out = []

    ranges = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "edited_start", "edited_end")]))

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), ranges]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"])

    id_type = spark.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<start:long,end:long,edited_start:long,edited_end:long>>")


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, with `edits` as the number of ranges that differ and the place of the first."""
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(*(c for c in found.columns if c != "edits"), F.size("edits").alias("n_edits"), F.try_element_at("edits", F.lit(1))["start"].alias("edit_start"))
