"""Vector code compression by delta-maintained Lloyd rounds, and the query op11.

Vectors of integers are cut into parts; each part position has a codebook, and a part's code is its nearest entry.
Vectors lie packed in chunks (a row holds about `CHUNK_BYTES` of them) in a table bucketed by chunk. The codes of the last
round are such a table too, of a thirtieth of the size, so that a round joins both bucket by bucket without a shuffle.
It assigns all parts anew, writes the codes, and shuffles only what has changed: for each chunk, part and entry, the
sum and count of the parts that came less those that left. The driver adds these to running integer sums (a number for
each component of each entry) and so has the next codebook; nothing is summed twice.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ends_with_application, only, shared_path, small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of a chunk and of a bucket of chunks, where components have 16 bits.
CHUNK_BYTES, BUCKET_BYTES = 128 << 10, 64 << 20
#: Bytes of a packed component, by a chunk's first byte.
KINDS = (2, 4, 8)
#: Components may be so large that a squared distance over all dimensions stays below this.
MOST_SQUARE = 1 << 62
TOO_LARGE = "components too large: a squared distance would not fit 64 bits"
#: Labels whose sums are broadcast; more meet the vectors by sort and merge.
LABEL_ROWS = 10_000


class Rounds:
    """What the driver keeps: a codebook (parts, entries, width), its parts' sums and counts. As large as the codebook, whatever the data."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        self.sums = np.zeros(book.shape, object)  # Python's integers: sums over any number of rows
        self.counts = np.zeros(book.shape[:2], object)

    def take(self, changes: list) -> None:
        """Adds (part, entry, at, plus) rows, at -1 for the count, and moves each entry that is used to its parts' mean, rounded down."""
        for part, entry, at, plus in changes:
            if at < 0:
                self.counts[part, entry] += int(plus)
            else:
                self.sums[part, entry, at] += int(plus)
        used = self.counts > 0
        book = self.book.copy()
        book[used] = (self.sums[used] // self.counts[used][:, None]).astype(np.int64)
        self.book = book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of each part of (n, dims) vectors: the nearest entry, of equally near ones the first."""
    parts, _, width = book.shape
    codes, least = np.empty((len(vectors), parts), np.uint8), np.empty((len(vectors), parts), np.int64)
    cut = vectors.reshape(len(vectors), parts, width)
    for p in range(parts):
        d = cut[:, p, None, :] - book[p][None]
        d = np.einsum("nkw,nkw->nk", d, d)
        codes[:, p] = d.argmin(1)
        least[:, p] = d.min(1)
    return codes, least


def deltas(vectors: np.ndarray, before: np.ndarray | None, codes: np.ndarray, shape: tuple[int, int, int]) -> list[dict]:
    """Contributions of the parts whose code has changed, one for each part and entry: plus to the new one, minus to the old one."""
    parts, entries, width = shape
    cut, out = vectors.reshape(len(vectors), parts, width), []
    for p in range(parts):
        moved = np.flatnonzero(codes[:, p] != before[:, p]) if before is not None else np.arange(len(codes))
        if not len(moved):
            continue
        sums, counts = np.zeros((entries, width), np.int64), np.zeros(entries, np.int64)
        for sign, at in ((1, codes[moved, p]), (-1, before[moved, p] if before is not None else None)):
            if at is not None:
                np.add.at(sums, at, sign * cut[moved, p])
                np.add.at(counts, at, sign)
        out += [{"part": p, "entry": int(e), "plus": [int(counts[e]), *sums[e].tolist()]} for e in np.flatnonzero(counts.astype(bool) | sums.any(1))]
    return out


class Bucketed:
    """Tables in the shared folder bucketed alike by chunk. Their names are the session's own and go with release()."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.named = spark, buckets, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, named = shared_path(self.spark, name), f"ledgerloom_{name}_{uuid.uuid4().hex[:12]}"
        ends_with_application(self.spark, path)
        df.write.format("parquet").bucketBy(self.buckets, "chunk").option("path", path).saveAsTable(named)
        self.named[named] = path
        return self.spark.table(named)

    def release(self, keep: int = 0) -> None:
        """Drops all tables but the first and the last `keep`."""
        names = list(self.named)
        for named in names[1 : len(names) - keep] if keep else names:
            self.spark.sql(f"drop table if exists {named}")
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.named.pop(named))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def largest(dims: int) -> int:
    return math.isqrt(MOST_SQUARE // dims) // 2


def integers(body: bytes, n: int) -> np.ndarray:
    """A chunk's (n, dims) integers, as 64 bits."""
    return np.frombuffer(body, f"<i{KINDS[body[0]]}", offset=1).reshape(n, -1).astype(np.int64)


def packed(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(chunk, ids, labels, n, body) of rows (id, label, vector), body a chunk's integers row by row, after a byte that says of how many bits.

    Chunks are numbered by partition and place: store them before anything is dealt by their number.
    """
    size, most = max(1, CHUNK_BYTES // (2 * dims)), largest(dims)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        held, n, place = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                t = pa.Table.from_batches(held)
                for i in range(0, n - size + 1, size):
                    yield chunk(t.slice(i, size), place)
                    place += 1
                held = t.slice(n - n % size).to_batches()
                n %= size
        if n:
            yield chunk(pa.Table.from_batches(held), place)

    def chunk(t: pa.Table, number: int) -> pa.RecordBatch:
        x = np.floor(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(2).chunks]).astype(np.float64) * scale)
        top = np.abs(x).max(initial=0)
        if top > most:
            raise ValueError(TOO_LARGE)
        kind = 0 if top < 1 << 15 else 1 if top < 1 << 31 else 2
        body = bytes([kind]) + x.astype(f"<i{KINDS[kind]}").tobytes()
        whole = pa.array([0, t.num_rows], pa.int32())
        ids, labels = (pa.ListArray.from_arrays(whole, pa.concat_arrays(t.column(c).chunks)) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, labels, pa.array([t.num_rows], pa.int32()), pa.array([body], pa.binary())], names=["chunk", "ids", "labels", "n", "body"])

    lists = [T.StructField(f"{c}s", T.ArrayType(rows.schema[c].dataType)) for c in ("id", "label")]
    return rows.select("id", "label", "vector").mapInArrow(pack, T.StructType([T.StructField("chunk", T.LongType()), *lists, T.StructField("n", T.IntegerType()), T.StructField("body", T.BinaryType())]))


def assigned(vectors: DataFrame, before: DataFrame | None, book: np.ndarray) -> DataFrame:
    """(chunk, codes, changes) of all chunks under a codebook, changes against the codes before (of a first round: against none)."""
    rows = vectors.select("chunk", "n", "body")
    rows = rows.withColumn("codes", F.lit(None).cast("binary")) if before is None else rows.join(before.select("chunk", "codes").hint("shuffle_hash"), "chunk")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        for b in batches:
            codes, changes = [], []
            for n, body, old in zip(*(b.column(c).to_pylist() for c in ("n", "body", "codes"))):
                x = integers(body, n)
                new = nearest(x, book)[0]
                changes.append(deltas(x, None if old is None else np.frombuffer(old, np.uint8).reshape(new.shape), new, book.shape))
                codes.append(new.tobytes())
            kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("plus", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(changes, kind)], names=["chunk", "codes", "changes"])

    return rows.select("chunk", "n", "body", "codes").mapInArrow(assign, "chunk long, codes binary, changes array<struct<part int, entry int, plus array<long>>>")


def summed(changes: DataFrame) -> DataFrame:
    """(part, entry, at, plus): the changes of all chunks, summed; as many rows as the codebook has components and entries, at most."""
    rows = changes.select(F.explode("changes").alias("c")).select("c.part", "c.entry", F.posexplode("c.plus").alias("at", "plus"))
    return rows.groupBy("part", "entry", (F.col("at") - 1).alias("at")).agg(F.sum(F.col("plus").cast("decimal(38,0)")).alias("plus"))


def coded(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, label, code, error) of each vector: codes as two hexadecimal digits a part, error the squared distance to the entries they name."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        for b in batches:
            for k, (n, body) in enumerate(zip(b.column("n").to_pylist(), b.column("body").to_pylist())):
                codes, least = nearest(integers(body, n), book)
                digits, wide = codes.tobytes().hex(), 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1).flatten() for c in ("ids", "labels")), pa.array([digits[i : i + wide] for i in range(0, len(digits), wide)], pa.string()), pa.array(least.sum(1), pa.int64())], names=["id", "label", "code", "error"])

    fields = [T.StructField(c, vectors.schema[f"{c}s"].dataType.elementType) for c in ("id", "label")]
    return vectors.select("ids", "labels", "n", "body").mapInArrow(code, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """((id, label, code, error) of each vector, the codebook as (parts, entries, width) integers, and for each round by how many parts the entries' counts changed).

    Vectors that are null, hold null or not finite components, or cannot be cut into equal parts go; so do those of
    another length than that of the smallest id. The codebook starts as the vectors of the smallest ids (null ids last,
    of equal ids the smaller vector first), of fewer than `entries` if there are no more. Rows that repeat count each.
    Without a vector left there are no rows and no entries. A component beyond about 2^30 / scale / sqrt(dimensions)
    raises an error: its distances would not fit the 64 bits of `error`. Other columns don't matter.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col("vector")
    kept = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = kept.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    head = lambda df: df.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    first = head(kept)
    dims = len(first[0]["vector"]) if first else parts
    if any(len(r["vector"]) != dims for r in first):
        first = head(kept.where(F.size(v) == dims))
    kept = kept.where(F.size(v) == dims)
    start = [[math.floor(scale * x) for x in r["vector"]] for r in first]
    if any(abs(x) > largest(dims) for r in start for x in r):
        raise ValueError(TOO_LARGE)
    start = np.array(start, np.int64).reshape(len(first), parts, dims // parts)
    state = Rounds(np.ascontiguousarray(start.transpose(1, 0, 2)))
    if not first:
        return spark.createDataFrame([], T.StructType([*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), state.book, []
    chunks = stored(packed(kept, dims, scale), "chunks")
    count = chunks.agg(F.sum("n")).first()[0]
    tables = Bucketed(spark, max(spark.sparkContext.defaultParallelism, math.ceil(count * dims * 2 / BUCKET_BYTES)))
    try:
        vectors = tables.put(chunks.repartition(tables.buckets, "chunk"), "vectors")
        before, moved = None, []
        for _ in range(rounds):
            before = tables.put(assigned(vectors, before, state.book), "codes")
            changes = summed(before).collect()
            moved.append(sum(abs(int(r["plus"])) for r in changes if r["at"] < 0))
            state.take(changes)
            tables.release(keep=1)
        return stored(coded(vectors, state.book), "coded"), state.book, moved
    finally:
        tables.release()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector that is whole: its code, its error, the errors of its label's vectors summed, and the codebook's hash."""
    found, book, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by = stored(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    few = by.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS
    met = found.join(F.broadcast(by) if few else by.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def lloyd_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds as common table expressions, each of which sums all parts anew."""
    said = [
        f"""v as (select vec_id, label, row_number() over () as r, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"p as (select r, k::int as k, x[k * (len(x) // {parts}) + 1:(k + 1) * (len(x) // {parts})] as y from (select r, x, unnest(range({parts})) as k from v))",
        f"b0 as (select k, e, y from p join (select r, row_number() over (order by vec_id, x) - 1 as e from v) using (r) where e < {entries})",
    ]
    near = "select p.r, p.k, p.y, min(struct_pack(d := list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := b.e)) as m from p join b{i} b on p.k = b.k group by p.r, p.k, p.y"
    for i in range(rounds):
        said.append(f"a{i} as materialized ({near.format(i=i)})")
        said.append(f"s{i} as (select k, e, i, sum(c)::bigint as s, count(*) as n from (select k, m.e as e, unnest(y) as c, generate_subscripts(y, 1) as i from a{i}) group by k, e, i)")
        said.append(f"b{i + 1} as materialized (select b.k, b.e, coalesce(n.y, b.y) as y from b{i} b left join (select k, e, list((s - ((s % n) + n) % n) // n order by i) as y from s{i} group by k, e) n on n.k = b.k and n.e = b.e)")
    said.append(f"f as materialized ({near.format(i=rounds)})")
    said.append("o as (select r, string_agg(printf('%02x', m.e), '' order by k) as code, sum(m.d)::bigint as error from f group by r)")
    said.append(f"h as (select sha256(string_agg(array_to_string(y, ','), ',' order by k, e)) as codebooks_sha256 from b{rounds})")
    return "with " + ",\n".join(said) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join o using (r), h"


OP11_SQL = lloyd_sql()
