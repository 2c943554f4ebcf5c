"""Token counts by a compiled finite-state transducer (see transducer.py), and the query op10."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by, only, small_batches, table
from .transducer import CHUNK_BYTES, CHUNK_CHARS, Transducer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048

_compiled: dict[tuple, Transducer] = {}
kept_by("token_counts", _compiled.clear)


def transducer(path: str, chunk_chars: int, chunk_bytes: int) -> Transducer:
    """One per worker process; it keeps what it has compiled."""
    key = path, chunk_chars, chunk_bytes
    if key not in _compiled:
        _compiled[key] = Transducer(*key)
    return _compiled[key]


def token_counter(path: str, chunk_chars: int, chunk_bytes: int):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("token_counts")
        t = transducer(path, chunk_chars, chunk_bytes)
        for s in texts:
            yield pd.Series([t.count(x) for x in s], dtype="int64")

    return count


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, chunk_bytes: int = CHUNK_BYTES, out: str = "n_tokens") -> DataFrame:
    """docs with the tokens of each whole text in column `out` (replaced if there).

    A null text counts as empty: 0 tokens. Each text is counted chunk by chunk, the chunks' state maps being composed
    by a prefix scan; the result doesn't depend on the sizes of chunks. Rows stay as they are: repeated rows and
    other columns are kept.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, token_counter(vocabulary, chunk_chars, chunk_bytes)(F.coalesce(F.col(text), F.lit(""))))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = count_tokens(docs)
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
