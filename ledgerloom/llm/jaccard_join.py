"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets; and the query op1.

Documents with equal n-gram sets are one class representative (the least doc_id) from the start. Band
and row counts follow from the wanted recall at the threshold. The shuffle on band hashes yields stars
(bucket member to the bucket's least representative), not pairs; their components are the candidate
clusters. The n-gram sets travel to their cluster once, or to the block pairs of a cluster over
`BLOCK_GRAMS` n-grams or `BLOCK_SETS` sets, where all pairs are verified by counting common n-grams. A block gives link
counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by, only, shuffle_parts, small_batches, stored, table
from .components import components

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9995, 4
#: n-grams and sets of a block (its matrices have a row and a column for each set), columns of the counting matrix, words whose hash a worker keeps.
BLOCK_GRAMS, BLOCK_SETS, MATRIX_COLUMNS, MEMO_WORDS = 150_000, 2000, 4096, 500_000

WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}
kept_by("jaccard_join", _hashes.clear)


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of `rows` hashes by which a pair at the threshold meets with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def gram_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of lower-case words; one of all words if there are fewer than n; none without words."""
    ws = WORD.findall(text.lower())
    if not ws:
        return np.zeros(0, np.uint64)
    get = _hashes.get
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    ids = []
    for w in ws:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    x = np.array(ids, np.uint64)
    k = min(n, len(x))
    h = np.full(len(x) - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0x100000001B3) + x[j : len(x) - k + 1 + j])
    return np.unique(h)


def key_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def signatures(docs: DataFrame, n: int, bands: int, rows: int = ROWS, carry: bool = False) -> DataFrame:
    """(doc_id, key, n_grams, bands) of docs (doc_id, text), with carry also version, a hash of the text; bands is null for an empty set."""
    factors = np.random.default_rng(1).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard_join")
        for b in batches:
            sets = [gram_set(t, n) for t in b.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            out: list = [None] * len(sets)
            if full:
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
                m = np.stack([np.minimum.reduceat(flat * a, starts) for a in factors]).reshape(bands, rows, -1)
                h = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(full), 1)
                for r in range(rows):
                    h = mixed(h * np.uint64(0x100000001B3) + m[:, r])
                for i, x in zip(full, h.T.astype(np.int64)):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([key_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(out, pa.list_(pa.int64())), b.column(2)], names=["doc_id", "key", "n_grams", "bands", "version"])

    signed = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(sign, f"doc_id {kind}, key binary, n_grams int, bands array<long>, version long")
    return signed if carry else signed.drop("version")


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of at least threshold: within a (each pair once), or between a and b."""
    sets = a if b is None else a + b
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    runs = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)
    keep = np.repeat(runs > 1, runs)
    owner, column = owner[keep], column[keep]
    na = len(a)
    common = np.zeros((na, na if b is None else len(sets) - na), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + MATRIX_COLUMNS])
        m = np.zeros((len(sets), min(MATRIX_COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        common += m[:na] @ (m if b is None else m[na:]).T
    total = size[:na, None] + (size[None, :] if b is None else size[None, na:])
    hit = common >= threshold * (total - common) - 1e-4
    if b is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all the pairs connect."""
    root, out = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        p, q = top(x), top(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def verify(sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, other, links, texts) from sets (block, side, rep, copies, grams): counts for node (other null), or an edge of the links' forest."""
    kind = sets.schema["rep"].dataType.simpleString()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        at, held = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if row[0] != at and held:
                    yield held
                    held = []
                at = row[0]
                held.append((*row[1:4], np.frombuffer(row[4].as_buffer(), np.uint64)))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in groups(batches):
            seen: dict[tuple, tuple] = {(side, rep): (copies, g) for side, rep, copies, g in rows}
            ordered = sorted(seen)
            a = [x for x in ordered if x[0] == 0]
            b = [x for x in ordered if x[0] == 1]
            two = any(x[0] == 1 for x in ordered) or rows[0][0] == 1
            if (two and not (a and b)) or (not two and len(a) < 2):
                continue
            i, j = linked([seen[x][1] for x in a], [seen[x][1] for x in b] if two else None, threshold)
            nodes = a + b
            j = j + len(a) if two else j
            w = np.array([seen[x][0] for x in nodes], np.int64)
            links = np.bincount(i, w[j], len(nodes)) + np.bincount(j, w[i], len(nodes))
            texts = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            out += [(nodes[k][1], None, int(links[k]), int(texts[k])) for k in np.flatnonzero(texts)]
            out += [(nodes[x][1], nodes[y][1], 0, 0) for x, y in forest(i, j, len(nodes))]
            if len(out) > 5000:
                yield pack_rows(out)
                out = []
        yield pack_rows(out)

    arrow = sets.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type

    def pack_rows(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c[0], arrow), pa.array(c[1], arrow), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["node", "other", "links", "texts"])

    placed = sets.repartition(parts, "block").sortWithinPartitions("block", "side", "rep").select("block", "side", "rep", "copies", "grams")
    return placed.mapInArrow(run, f"node {kind}, other {kind}, links long, texts long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of n-word runs is at least the
    threshold; n_links counts a row's linked rows, copies included; class_id is the least doc_id that
    chains of links reach. Texts of fewer than n words have one run, of all their words. Documents without words (null,
    empty) are alike and linked to each other only. A row without doc_id has no class and 0 links.
    Rows that repeat a doc_id count as documents of their own and get their own text's class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_parts(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(signatures(docs.where("doc_id is not null"), n, bands_for(threshold, recall)), "signatures")
    facts = class_facts(docs, signed, n, threshold, parts)
    out = signed.select("doc_id", "key").join(facts, "key").select("doc_id", "class_id", "n_links")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.unionAll(docs.where("doc_id is null").select("doc_id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def class_facts(docs: DataFrame, signed: DataFrame, n: int, threshold: float, parts: int) -> DataFrame:
    """(key, class_id, n_links) of each distinct n-gram set in signed, the signatures of docs (doc_id, text)."""
    classes = stored(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "classes")
    buckets = classes.where("bands is not null").select("rep", F.posexplode("bands").alias("band", "hash"))
    least = buckets.groupBy("band", "hash").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = buckets.join(least, ["band", "hash"]).where("rep != v").select(F.col("rep").alias("u"), "v")
    clusters = components(stars).select(F.col("node").alias("rep"), F.col("class").alias("cluster"))
    met = stored(classes.join(clusters, "rep").select("rep", "key", "copies", "n_grams", "cluster"), "clusters")
    sizes = met.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n_grams") / BLOCK_GRAMS, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    met = met.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard_join")
        for b in batches:
            rows = [(i, g.tobytes()) for i, (t, key) in enumerate(zip(b.column("text").to_pylist(), b.column("key").to_pylist())) if key_of(g := gram_set(t, n)) == key]
            keep = b.take(pa.array([i for i, _ in rows], pa.int64())) if len(rows) < b.num_rows else b
            yield pa.RecordBatch.from_arrays([*(keep.column(c) for c in ("rep", "copies", "cluster", "blocks", "own")), pa.array([g for _, g in rows], pa.binary())], names=["rep", "copies", "cluster", "blocks", "own", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.join(met.hint("merge"), docs["doc_id"] == met["rep"]).select("rep", "key", "copies", "cluster", "blocks", "own", "text")
    sets = held.mapInArrow(grams, f"rep {kind}, copies long, cluster {kind}, blocks int, own int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sets = sets.select("*", other).select(
        F.concat_ws(":", "cluster", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "copies", "grams",
    )
    found = stored(verify(sets, threshold, parts), "links")
    links = found.where("other is null").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"))
    labels = components(edges).select(F.col("node").alias("rep"), "class")
    return classes.join(links, "rep", "left").join(labels, "rep", "left").select("key", F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of docs for each class of near_duplicates: that of the class's least doc_id.

    Of rows that repeat doc_id and text one stays; rows that repeat the class's doc_id with other texts stay. Rows
    without doc_id stay, one for each text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    version = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    signed = stored(signatures(rows.where("doc_id is not null"), n, bands_for(threshold, recall), carry=True), "signatures")
    facts = class_facts(rows, signed, n, threshold, shuffle_parts(spark))
    later = signed.join(facts, "key").where("doc_id != class_id").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    marked = docs.withColumn("_v", version(F.col(text)))
    kept = marked.join(later.hint("merge"), (F.col(doc_id) == F.col("_id")) & (F.col("_v") == F.col("_version")), "left_anti")
    return kept.dropDuplicates([doc_id, "_v"]).select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
