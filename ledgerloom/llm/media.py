"""Media columns: interleaved sequences of text and media references from HTML, payloads joined by digest; and the query op6.

Payloads are kept losslessly as 8-bit greyscale PNG images, 64 samples a row, in a table keyed by the digest of the
payload. HTML gives ordered items; a reference names a digest, the join resolves it, and positions and captions stay
with their item.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

WIDTH = 64
PREFIX = "sha256:"
ITEM_SCHEMA = "position int, kind string, text string, digest string, caption string, attributes map<string,string>"
FEATURE_SCHEMA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Elements that end a text item; elements whose text is none of the document's.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
SILENT = frozenset(("script", "style", "template", "noscript"))


class Interleaver(HTMLParser):
    """items: (kind, text, digest or source, caption, attributes) in document order; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if not text:
            return
        if self.caption and self.figure is not None:
            for i in self.figure:
                self.items[i][3] = text
            if not self.figure:
                self.pending = text
        else:
            self.items.append(["text", text, None, None, None])

    pending: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure, self.pending = [], None
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append(["media", None, a["src"], self.pending or a.get("alt"), [(k, v or "") for k, v in a.items() if k != "src"]])

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure":
            self.figure, self.pending = None, None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)


def interleave(html: str) -> list[list]:
    p = Interleaver()
    p.feed(html)
    p.close()
    p.flush()
    return p.items


def items_of(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, kind, text, digest, caption, attributes): the items of each page in order. digest: of references `sha256:...`, else the reference itself. A null html has no items."""
    kind = pages.schema[key].dataType.simpleString()
    small_batches(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, h in enumerate(b.column(1).to_pylist()):
                for n, (what, text, ref, caption, attributes) in enumerate(interleave(h or "")):
                    at.append(i)
                    rows.append((n, what, text, ref.removeprefix(PREFIX) if ref else None, caption, attributes))
            c = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(c[0], pa.int32()), *(pa.array(x, pa.string()) for x in c[1:5]), pa.array(c[5], pa.map_(pa.string(), pa.string()))], names=[key, "position", "kind", "text", "digest", "caption", "attributes"])

    return pages.select(key, html).mapInArrow(parse, f"`{key}` {kind}, {ITEM_SCHEMA}")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """items with the columns of media (a row for each digest); null where a reference is unknown or the item is text. Text items take no part in the join: their null digest would be one key."""
    met = items.where("digest is not null").join(media, "digest", "left")
    return met.unionByName(items.where("digest is null"), allowMissingColumns=True)


def sequences(resolved: DataFrame, key: str) -> DataFrame:
    """(key, items): a page's items as one array of structs, by position."""
    rest = [c for c in resolved.columns if c not in (key, "position")]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *rest)), lambda a, b: a["position"] - b["position"]).alias("items"))


def png(payload: bytes) -> bytes:
    """An 8-bit greyscale image whose samples are the payload (a multiple of WIDTH bytes)."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image that png() wrote, rows by columns; damage raises ValueError."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, width, rows = 8, b"", 0, 0
    while at < len(image):
        size, name = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if name == b"IHDR":
            width, rows, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
        elif name == b"IDAT":
            data += body
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def feature(pixels: np.ndarray) -> str:
    """Size, mean, deviation, entropy of the samples, and the bits of an 8 x 8 average hash."""
    n = np.bincount(pixels.ravel(), minlength=256)
    total = pixels.size
    values = np.arange(256)
    mean = int((n * values).sum()) / total
    var = int((n * values * values).sum()) / total - mean * mean
    p = n[n > 0] / total
    cuts = [len(pixels) * i // 8 for i in range(9)]
    cells = np.array([[pixels[a : max(b, a + 1)][:, 8 * j : 8 * j + 8].astype(np.int64).sum() / (max(b, a + 1) - a) for j in range(8)] for a, b in zip(cuts, cuts[1:])])
    bits = (cells > cells.mean()).ravel()
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={mean:.4f};sd={max(var, 0) ** 0.5:.4f};entropy={-(p * np.log2(p)).sum():.4f};ahash={int(''.join('1' if x else '0' for x in bits), 2):016x}"


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text, filled with bytes 0 to a positive multiple of WIDTH."""
    data = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(data)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH) * WIDTH) - n).cast("int"))))


def media_table(payloads: DataFrame) -> DataFrame:
    """(digest, image) of payloads (payload); a row for each row."""
    small_batches(payloads.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in x], pa.string()), pa.array([png(p) for p in x], pa.binary())], names=["digest", "image"])

    return payloads.mapInArrow(encode, "digest string, image binary")


def read_media(media: DataFrame) -> DataFrame:
    """FEATURE_SCHEMA: what each stored image holds, a row for each digest."""
    small_batches(media.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = samples(image)
                payload = s.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(s)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    found = media.select("digest", "image").mapInArrow(decode, FEATURE_SCHEMA)
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in found.columns if c != "digest"))


def article(text: Column, figure: Column) -> Column:
    """A page with each line of a text as a paragraph, the figure after the first."""
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escaped, "\n")
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "</p><p>")
    return F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text as a page with its payload as a figure; the columns come from the media item of the page's sequence. Of text items the sequence keeps the length only: the query returns no texts."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source").withColumn("payload", padded(F.col("text")))
    media = stored(media_table(rows.select("payload")), "media")
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    figure = F.concat(F.lit(f'<figure><img src="{PREFIX}'), F.sha2("payload", 256), F.lit('" data-bytes="'), F.octet_length("text"), F.lit('"><figcaption>'), quoted(F.concat_ws(" ", "lang", "source")), F.lit("</figcaption></figure>"))
    pages = rows.select("doc_id", F.monotonically_increasing_id().alias("_row"), article(F.col("text"), figure).alias("html"))
    items = items_of(pages.select(F.struct("doc_id", "_row").alias("page"), "html"), "page", "html")
    items = stored(items.withColumn("n_chars", F.length("text")).drop("text"), "items")  # read twice: media and text items
    found = sequences(resolve(items, stored(read_media(media), "features").hint("merge")), "page")
    m = F.filter("items", lambda x: x["kind"] == "media")[0]
    found = found.select("page.doc_id", m.alias("m"), F.size("items").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["n_chars"], F.lit(0))).alias("text_chars"))
    columns = [f"m.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")]
    return found.select("doc_id", F.col("m.attributes")["data-bytes"].cast("long").alias("n_bytes"), *columns, "n_items", "text_chars")
