"""The taxonomy as expressions."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def folded(text: Column) -> Column:
    """Lower case with one form of i, s and k each, so that patterns need no look at case."""
    return F.lower(F.translate(text, "İıſ\u212a", "iisk"))


def pattern(words: list[str]) -> str | None:
    """One pattern for all of a subcategory's, each between word bounds, for folded text."""
    return r"(?U)\b(?:" + "|".join(words).replace("ı", "i") + r")\b" if words else None


def rule(text: Column) -> Column:
    """struct(category, subcategory, confidence, method) of the first subcategory, in taxonomy order, with a pattern in text; null without one."""

    def first(low: Column) -> Column:
        out = None
        for c, _, sub, words in fixed.TAXONOMY:
            if words:
                hit = F.struct(F.lit(c).alias("category"), F.lit(sub).alias("subcategory"), F.lit(0.94).alias("confidence"), F.lit("rule").alias("method"))
                out = F.when(low.rlike(pattern(words)), hit) if out is None else out.when(low.rlike(pattern(words)), hit)
        return out

    return F.transform(F.array(folded(text)), first)[0]  # bound by transform: the text is folded once


def spellings(word: str) -> list[str] | None:
    """All texts that a pattern of optional letters and groups matches; null if it has more to it than these."""
    parts = re.findall(r"\(\?:([^()|\\]*)\)\?|(.)\?|([^()?\\.*+\[\]|])", word)
    if "".join(f"(?:{g})?" if g else f"{o}?" if o else c for g, o, c in parts) != word:
        return None
    return ["".join(x) for x in product(*(["", g or o] if g or o else [c] for g, o, c in parts))]


def token_index() -> tuple[list[tuple[str, int, int]], list[tuple[int, str]]]:
    """(literal, first rule's place, tokens) of all that rules spell out, and (place, pattern) of what they don't. Places count TAXONOMY from 0."""
    first: dict[str, int] = {}
    rest: dict[int, list[str]] = {}
    for i, (_, _, _, words) in enumerate(fixed.TAXONOMY):
        for w in words:
            w = w.replace("ı", "i")
            for x in spellings(w) or [None]:
                rest.setdefault(i, []).append(w) if x is None else first.setdefault(x, i)
    return [(x, i, len(re.findall(r"\w+|\W+", x))) for x, i in first.items()], [(i, pattern(ws)) for i, ws in rest.items()]


def token_runs(low: Column, longest: int) -> Column:
    """Distinct runs of 1, 3, 5, ... up to `longest` tokens (words, and what stands between them as it is), a word at both ends."""
    tokens = F.regexp_extract_all(low, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    runs = lambda t, n: F.transform(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i >= 1) & (i + n - 1 <= F.size(t))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), ""))
    words = lambda t: F.flatten(F.array(*(runs(t, n) for n in range(1, longest + 1, 2))))
    return F.array_distinct(F.transform(F.array(tokens), words)[0])


def allowed_categories() -> list[str]:
    """Categories in the taxonomy's order, each once."""
    return list(dict.fromkeys(c for c, *_ in fixed.TAXONOMY))


def reference_texts() -> list[tuple[str, str, str]]:
    """(category, subcategory, text): what a classifier by similarity embeds for each subcategory."""
    return [(c, sub, f"category={c}; subcategory={sub}; examples={', '.join(fixed.EXAMPLES[sub])}") for c, _, sub, _ in fixed.TAXONOMY]


def label(category: Column) -> Column:
    """Localised name; the capitalised identifier if there is none."""
    names = dict([fixed.INCOME, *((c, name) for c, name, _, _ in fixed.TAXONOMY)])
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), category), F.initcap(category))
