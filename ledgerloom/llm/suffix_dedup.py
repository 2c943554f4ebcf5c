"""Exact substring removal by anchored blocks and suffix sorting within buckets, and the query op9.

Byte strings of `length` that start at two or more places are removed wherever they stand.

1. Every window of `length` bytes picks an anchor, the leftmost least hash among its `GRAM`-byte
   substrings, so equal windows pick equal anchors at equal places. Windows in a row with one anchor form a
   block. An anchor that stands once in all texts can't be in a repeated window: its block is done.
2. Blocks equal in all bytes are repeated as a whole.
3. The suffixes and prefixes at one anchor, in blocks that differ, form a bucket. Buckets are sorted one at a
   time, each truncated to the window: by the first `PERIOD` bytes, and ties by prefix-doubled ranks of
   one residue of a difference cover (all rows start at the anchor, so one shift serves). Neighbours' common lengths then name, for each place of the
   anchor in a window, what stands before and after it; windows with equal names are equal.
4. An anchor with over `HOT_BLOCKS` different blocks is split into buckets of one 400-byte prefix each:
   windows are grouped by place and 128-bit hash, which Spark sums before it shuffles. Nothing is dropped.

Blocks and windows of hot anchors are equal by 128-bit hashes, all others by their bytes.

A task holds a bucket of at most HOT_BLOCKS blocks of under 2 * length bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, small_batches, stored, table

LENGTH, GRAM, PERIOD, HOT_BLOCKS = 400, 96, 32, 4000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a text that are read at once, and the bits of a place in them.
SEGMENT = 1 << 25
_PLACE = np.uint64((1 << 26) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    n = len(x)
    full = -(-n // w) * w
    y = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    ahead = np.minimum.accumulate(y.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(y.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def blocks_of(text: bytes, length: int, gram: int, segment: int = SEGMENT) -> list[np.ndarray]:
    """[anchor hash, hash of the block in two numbers, first and last window start, anchor place] of each block; the text has at least length bytes.

    A text is read in segments of `segment` window starts; a block that reaches into the next one is two.
    """
    out: list[list[np.ndarray]] = []
    for low in range(0, len(text) - length + 1, segment):
        part = text[low : low + segment + length - 1]
        data = np.frombuffer(part, np.uint8)
        prefix = prefix_hashes(data)
        at = np.arange(len(data) - gram + 1)
        g = span_hash(prefix, at, at + gram)
        place = (sliding_min((g & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        # 128 bits of the bytes and of the anchor's places in the first and last window
        body = b"".join([xxhash.xxh3_128_digest(part[i:j], seed=k) for i, j, k in zip(first.tolist(), (last + length).tolist(), ((p - first) * 4096 + p - last).tolist())])
        hashes = np.frombuffer(body, "<i8").reshape(-1, 2)
        out.append([g[p].view(np.int64), hashes[:, 0], hashes[:, 1], first + low, last + low, p + low])
    return [np.concatenate(c) for c in zip(*out)]


def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one of two of them (greedy)."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max((x for x in range(v) if x not in cover), key=lambda x: len({(x - c) % v for c in cover} | {(c - x) % v for c in cover} | have))
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


_COVER = difference_cover(PERIOD)


def named(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows given by columns, the first the most significant; equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sorted_bucket(rows: np.ndarray) -> np.ndarray:
    """Order of the suffixes rows[b] (bytes, padded to a multiple of PERIOD).

    The cover sample has the columns whose residue modulo PERIOD is in the difference cover; its ranks come from
    their first PERIOD bytes, doubled until they span the row. Two suffixes that tie over PERIOD bytes compare by
    the ranks at the shift that puts both into the sample; all rows start at one residue, so one shift serves all.
    """
    n, width = rows.shape
    words = rows.view(">u8").reshape(n, width // 8)
    shift = next(d for d in _COVER if d)
    rest = np.zeros((n, width), np.uint8)
    rest[:, : width - shift] = rows[:, shift:]
    sample = rest.view(">u8").reshape(n * (width // PERIOD), PERIOD // 8)
    rank = named([sample[:, k] for k in range(PERIOD // 8)]).reshape(n, -1)
    step = 1
    while step < rank.shape[1]:
        ahead = np.full_like(rank, -1)
        ahead[:, :-step] = rank[:, step:]
        rank = named([rank.ravel(), ahead.ravel()]).reshape(n, -1)
        step *= 2
    return np.lexsort((rank[:, 0], *(words[:, k] for k in range(PERIOD // 8 - 1, -1, -1))))


def common_lengths(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each row, in order, with the one before (0 for the first)."""
    a = rows[order]
    differ = a[1:] != a[:-1]
    out = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], out])


def repeated_windows(blocks: list[bytes], before: np.ndarray, least: np.ndarray, twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each block, which of its windows (by start in it) another window of the bucket equals.

    before: bytes before the anchor, and so the anchor's last place in a window; least: its first place; twice: the block itself stands repeatedly.
    """
    n = len(blocks)
    pad = lambda x: -(-x // PERIOD) * PERIOD
    left, right = np.zeros((n, pad(int(before.max()) + 1)), np.uint8), np.zeros((n, pad(max(len(x) - o for x, o in zip(blocks, before.tolist())))), np.uint8)
    for k, (x, o) in enumerate(zip(blocks, before.tolist())):
        d = np.frombuffer(x, np.uint8)
        left[k, :o] = d[:o][::-1]
        right[k, : len(d) - o] = d[o:]
    hit = [np.ones(int(o - m) + 1, bool) if t else np.zeros(int(o - m) + 1, bool) for o, m, t in zip(before, least, twice)]
    orders = [sorted_bucket(m) for m in (left, right)]
    lcps = [common_lengths(m, o) for m, o in zip((left, right), orders)]
    lo, hi = int(least.min()), int(before.max())
    chunk = max(1, 2_000_000 // n)
    for a in range(lo, hi + 1, chunk):
        places = np.arange(a, min(hi + 1, a + chunk))
        names = []
        for order, lcp, size in ((orders[0], lcps[0], places), (orders[1], lcps[1], length - places)):
            x = np.empty((len(places), n), np.int64)
            x[:, order] = np.cumsum(lcp[None, :] < size[:, None], axis=1)
            names.append(x)
        key = names[0] * (n + 1) + names[1]
        there = (places[:, None] >= least[None, :]) & (places[:, None] <= before[None, :])
        key = np.where(there, key, -1 - np.arange(n)[None, :])
        by = np.argsort(key, axis=1, kind="stable")
        s = np.take_along_axis(key, by, 1)
        same = np.zeros(s.shape, bool)
        same[:, 1:] = s[:, 1:] == s[:, :-1]
        same[:, :-1] |= same[:, 1:]
        found = np.zeros(s.shape, bool)
        np.put_along_axis(found, by, same, 1)
        found &= there
        for j, b in zip(*np.nonzero(found)):
            hit[b][before[b] - places[j]] = True
    return hit


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    x = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(x[::2].tolist(), (x[1::2] - 1).tolist()))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, size, body): texts as compressed bytes, for the shuffle. doc: a hash of doc_id and text, so rows that repeat a doc_id don't mix."""
    fields = docs.select("doc", "data")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc", "body"])

    return fields.mapInArrow(pack, "doc long, body binary")


def anchored_blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, block, more, doc, start, last, place) of docs (doc, data)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(x) >= length:
                    anchor, block, more, *places = blocks_of(x, length, gram)
                    for c, v in zip(cols, (anchor, block, more, np.full(len(anchor), doc, np.int64), *(y.astype(np.int32) for y in places))):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "block", "more", "doc", "start", "last", "place"])

    return docs.select("doc", "data").mapInArrow(find, "anchor long, block long, more long, doc long, start int, last int, place int")


def bucket_hits(bodies: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc, start, end): repeated bytes in blocks (anchor, doc, start, last, place, twice, bytes), by sorting each anchor's bucket."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        at, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != at and held:
                    yield held
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield held

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in buckets(batches):
            _, doc, start, last, place, twice, data = zip(*rows)
            start, last, place = (np.array(x, np.int64) for x in (start, last, place))
            if len(rows) > 1:
                for d, s, flags in zip(doc, start.tolist(), repeated_windows(list(data), place - start, place - last, np.array(twice), length)):
                    out += [(d, s + i, s + j + length) for i, j in runs(flags)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "end"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "end"])

    placed = bodies.repartition(parts, "anchor").sortWithinPartitions("anchor").select("anchor", "doc", "start", "last", "place", "twice", "bytes")
    return placed.mapInArrow(sort, "doc long, start int, end int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(doc, start, end): byte spans, overlapping perhaps, that the repeated windows of docs (doc, data) cover."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    blocks = anchored_blocks(docs, length, gram)
    anchors = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("a"), F.max("block").alias("b"), F.min("more").alias("c"), F.max("more").alias("d")).where("n > 1").select("anchor", ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("mixed"))
    anchors = stored(anchors, "anchors")  # so that the join has plain shuffles on both sides, of which Spark splits the hot partitions
    met = stored(blocks.join(anchors.hint("merge"), "anchor"), "blocks")
    classes = met.groupBy("anchor", "block", "more", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start", "last", "place")).alias("r"))
    classes = stored(classes, "classes")
    # 2. blocks equal to another
    whole = met.join(classes.where("n > 1").select("anchor", "block", "more").hint("merge"), ["anchor", "block", "more"]).select("doc", "start", (F.col("last") + length).alias("end"))
    # 3. and 4. one block for each distinct content, where an anchor has several
    kinds = classes.where("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    asked = classes.where("mixed").join(kinds, "anchor").select("r.*", "anchor", (F.col("n") > 1).alias("twice"), (F.col("kinds") > hot_blocks).alias("hot"))
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "last", "place", "twice", "hot")).alias("blocks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            for doc, body, wanted in zip(*(c.to_pylist() for c in b.columns)):
                data = z.decompress(body)
                out += [(w["anchor"], doc, w["start"], w["last"], w["place"], w["twice"], w["hot"], data[w["start"] : w["last"] + length]) for w in wanted]
            c = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))], names=["anchor", "doc", "start", "last", "place", "twice", "hot", "bytes"])

    bodies = packed_texts(docs).join(lists.hint("merge"), "doc").select("doc", "body", "blocks").mapInArrow(cut, "anchor long, doc long, start int, last int, place int, twice boolean, hot boolean, bytes binary")
    bodies = stored(bodies, "bodies")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for anchor, doc, start, last, place, twice, data in zip(*(c.to_pylist() for c in b.columns)):
                n = last - start + 1
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + length], seed=(anchor ^ place - start - i) & (1 << 64) - 1) for i in range(n)]), "<i8").reshape(-1, 2)
                for c, x in zip(cols, (h[:, 0], h[:, 1], np.full(n, doc, np.int64), np.arange(start, last + 1, dtype=np.int32), np.full(n, 1 + twice, np.int32))):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["window", "more", "doc", "start", "n"])

    hot = bodies.where("hot").select("anchor", "doc", "start", "last", "place", "twice", "bytes").mapInArrow(windows, "window long, more long, doc long, start int, n int")
    often = hot.groupBy("window", "more").agg(F.sum("n").alias("n")).where("n > 1").select("window", "more")
    split = hot.join(often.hint("merge"), ["window", "more"]).select("doc", "start", (F.col("start") + length).alias("end"))
    return whole.unionAll(bucket_hits(bodies.where("not hot").drop("hot"), length, parts)).unionAll(split)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, data, kept, spans): the text's UTF-8 bytes, those that remain, and the maximal removed runs (start, end).

    Bytes covered by a length-byte string that starts anywhere else, in the same text or another, go, at all its
    places; matches don't cross texts. Null texts are empty; texts under length bytes stay whole. Each row stands for
    a text of its own, rows that repeat a doc_id and text too: such texts repeat each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.encode("text", "utf-8").alias("data"), F.xxhash64("doc_id", "text").alias("doc"))
    spans = repeated_spans(rows, length, **options)
    lists = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            data = [z.decompress(x) for x in b.column(1).to_pylist()]
            kept, cuts = [], []
            for x, found in zip(data, b.column(2).to_pylist()):
                joined: list[list[int]] = []
                for s in found or ():
                    if joined and s["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["end"])
                    else:
                        joined.append([s["start"], s["end"]])
                ends = [0, *(e for _, e in joined)]
                kept.append(b"".join(x[i:j] for i, j in zip(ends, [*(s for s, _ in joined), len(x)])))
                cuts.append([{"start": s, "end": e} for s, e in joined])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "data", "kept", "spans"])

    bodies = rows.select("doc", "data", "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([z.compress(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc", "doc_id", "body"])

    texts = bodies.mapInArrow(pack, f"doc long, doc_id {kind}, body binary")
    return texts.join(lists.hint("merge"), "doc", "left").select("doc_id", "body", "spans").mapInArrow(apply, f"doc_id {kind}, data binary, kept binary, spans array<struct<start:int,end:int>>")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.octet_length("data") - F.octet_length("kept")
    return found.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
