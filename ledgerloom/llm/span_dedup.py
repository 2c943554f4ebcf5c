"""Substring dedup by sliding sentence spans, and the query op4.

Every run of consecutive sentences that just reaches `SPAN_WORDS` words and `SPAN_SENTENCES` sentences, from each
sentence on and back from each, is hashed (128 bits, so that unequal runs don't meet: at 10^13 runs by a chance of
10^-13). A run may begin or end within a sentence of more than 2 * `UNIT_WORDS` words, after each UNIT_WORDS of it, but
one sentence alone is no run, unless `LONE_WORDS` words of it are. The first place of each hash over all documents (least doc_id, then
text, then place) keeps its sentences; at every other place they are covered, and what is covered goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, small_batches, stored, table

#: A run of sentences is a span once it has so many words and sentences.
SPAN_WORDS, SPAN_SENTENCES = 20, 2
#: And a run within one sentence once it has so many words: a passage in a text without ends of sentences.
LONE_WORDS = 48
#: Words after each of which a run may begin or end within a longer sentence.
UNIT_WORDS = 12

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+\s*|\n\s*)|[^.!?\n]+")
WORD = re.compile(r"\s*\S+\s*|\s+")


def units(sentence: str) -> list[str]:
    """A sentence, or the parts of one that has over twice UNIT_WORDS words."""
    if len(sentence) < 4 * UNIT_WORDS or (sentence.count(" ") < 2 * UNIT_WORDS and sentence.isascii() and sentence.isprintable()) or len(sentence.split()) <= 2 * UNIT_WORDS:
        return [sentence]
    ws = WORD.findall(sentence)
    return ["".join(ws[i : i + UNIT_WORDS]) for i in range(0, len(ws), UNIT_WORDS)]


def pieces_of(text: str) -> tuple[list[str], list[int]]:
    """Pieces that make up the text, and the number of each one's sentence; a piece without words belongs to the one before (at the start: to the next)."""
    pieces: list[str] = []
    of: list[int] = []
    k, blank = -1, True  # of the last piece
    for sentence in SENTENCE.findall(text):
        begun = False
        for p in units(sentence):
            empty = p.isspace()
            if pieces and (empty or blank):
                pieces[-1] += p
                blank = blank and empty
            else:
                pieces.append(p)
                blank = empty
                k, begun = (k, True) if begun else (k + 1, True)
                of.append(k)
    return pieces, of


def sentences(text: str) -> tuple[list[str], np.ndarray, bytes, np.ndarray]:
    """pieces_of(text) with the words of each piece and its 16-byte hash without case and spacing, joined: (pieces, words, hashes, numbers)."""
    pieces, of = pieces_of(text)
    words = [p.split() for p in pieces] if text.islower() else [p.lower().split() for p in pieces]
    digest = xxhash.xxh3_128_digest
    return pieces, np.fromiter(map(len, words), np.int64, len(words)), b"".join([digest(" ".join(w)) for w in words]), np.array(of, np.int64)


def spans_of(words: np.ndarray, hashes: bytes, number: np.ndarray, least: int, sentences_: int = SPAN_SENTENCES) -> tuple[np.ndarray, np.ndarray]:
    """(hash as two numbers, a row each; first and end, a row each) of the shortest runs of pieces with at least `least` words that have to do with `sentences_` sentences, from each piece on and back from each."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    first = np.arange(n)
    starts = np.searchsorted(number, np.arange(number[-1] + 2)) if n else np.zeros(1, np.int64)  # the first piece of each sentence, and n
    beyond, before = number + sentences_ - 1, number - sentences_ + 2
    end = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), np.where(beyond < len(starts) - 1, starts[np.minimum(beyond, len(starts) - 1)], n) + 1)
    end = np.minimum(end, np.searchsorted(total, total[:-1] + max(least, LONE_WORDS), "left"))
    on = end <= n
    last = np.arange(1, n + 1)
    begin = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, np.where(before > 0, starts[np.maximum(before, 0)], 0) - 1)
    begin = np.maximum(begin, np.searchsorted(total, total[1:] - max(least, LONE_WORDS), "right") - 1)
    back = begin >= 0
    both = np.unique(np.concatenate([first[on] * (n + 1) + end[on], begin[back] * (n + 1) + last[back]]))
    pairs = np.stack([both // (n + 1), both % (n + 1)], 1)
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(hashes[i:j]) for i, j in (16 * pairs).tolist()])
    return np.frombuffer(digests, "<i8").reshape(-1, 2), pairs


def span_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span_words: int = SPAN_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, kept, n_sentences, n_removed) of each row of docs, and its columns named in carry.

    kept is the text without what is covered, all other bytes as they were; n_removed counts the sentences that lost
    something. Null texts are empty; a text under span_words words has no span and stays, and so does what is repeated in
    runs of fewer words, or as one sentence of fewer than LONE_WORDS. Rows that repeat doc_id and text are one document to each other (none is
    later than the other); rows that repeat a doc_id with another text are documents of their own, in the order of a hash of
    the text. A row without
    doc_id counts as before all others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text", "rest")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("span_dedup")
        for b in batches:
            at, keys, places = [], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for k, t in enumerate(b.column(2).to_pylist()):
                _, words, hashes, number = sentences(t)
                if words.sum() >= span_words:
                    h, p = spans_of(words, hashes, number, span_words)
                    at.append(np.full(len(h), k))
                    keys.append(h)
                    places.append(p)
            k = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())
            h, p = np.concatenate(keys), np.concatenate(places).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), *(pa.array(np.ascontiguousarray(x)) for x in (h[:, 0], h[:, 1], p[:, 0], p[:, 1]))], names=["doc_id", "version", "hash", "more", "first", "end"])

    spans = rows.drop("rest").mapInArrow(find, f"doc_id {kind}, version long, hash long, more long, first int, end int")
    places = spans.groupBy("hash", "more").agg(F.min(F.struct("doc_id", "version", "first")).alias("keep"), F.max(F.struct("doc_id", "version", "first")).alias("m")).where("keep != m or (keep is null) != (m is null)").select("hash", "more", "keep")
    places = stored(places, "places")  # so that the join has plain shuffles on both sides, of which Spark splits the hot partitions
    later = spans.join(places.hint("merge"), ["hash", "more"]).where(~F.struct("doc_id", "version", "first").eqNullSafe(F.col("keep")))
    covered = later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("covered"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary()), b.column(3)], names=["doc_id", "version", "body", "rest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            for body, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = z.decompress(body).decode("utf-8", "surrogatepass")
                pieces, of = pieces_of(t)
                if not found:
                    out.append((t, t, of[-1] + 1 if of else 0, 0))
                    continue
                number = np.array(of, np.int64)
                gone = np.zeros(len(pieces) + 1, np.int64)
                for s in found or ():
                    gone[s["first"]] += 1
                    gone[s["end"]] -= 1
                off = np.cumsum(gone)[:-1] > 0
                out.append((t, "".join(p for p, o in zip(pieces, off) if not o) if off.any() else t, of[-1] + 1, len(np.unique(number[off]))))
            c = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), b.column(3)], names=["doc_id", "text", "kept", "n_sentences", "n_removed", "rest"])

    passed = T.StructType([T.StructField("rest", rows.schema["rest"].dataType)])
    bodies = rows.mapInArrow(pack, T.StructType(T.StructType.fromDDL(f"doc_id {kind}, version long, body binary").fields + passed.fields)).alias("d")
    met = bodies.join(covered.alias("c").hint("merge"), F.expr("d.doc_id <=> c.doc_id and d.version = c.version"), "left").select("d.doc_id", "d.body", "c.covered", "d.rest")
    out = met.mapInArrow(cut, T.StructType(T.StructType.fromDDL(f"doc_id {kind}, text string, kept string, n_sentences long, n_removed long").fields + passed.fields))
    return out.select("doc_id", "text", "kept", "n_sentences", "n_removed", *(F.col("rest")[c].alias(c) for c in carry))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its sentences, those removed, and the hash and characters of what stays."""
    found = span_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))
