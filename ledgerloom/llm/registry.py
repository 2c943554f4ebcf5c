"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .fill_middle import OP12_SQL, op12_fill_in_middle
from .jaccard_join import op1_ngram_jaccard_join
from .media import op6_media_columns
from .merkle import op7_merkle_fingerprints
from .mixing import op3_mixing
from .packing import op8_best_fit_packing
from .quality_ledger import OP13_SQL, op13_quality_rules
from .span_dedup import op4_substring_dedup
from .suffix_dedup import op9_suffix_array_dedup
from .token_counts import op10_token_counts
from .toxicity import op2_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc import op5_warc

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc": op5_warc,
    "op6_media_columns": op6_media_columns,
    "op7_merkle_fingerprints": op7_merkle_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality_rules": op13_quality_rules,
}
SQL: dict[str, str] = {"op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_quality_rules": OP13_SQL}
