"""Similarity of texts and rules by an index of words, against plain code and the rules as patterns."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, taxonomy
from ledgerloom.operators import analytics as A
from ledgerloom.operators import similarity as M
from ledgerloom.sources import tables as S

ODD = ["", " ", "H&M", "h & m", "h&m2", "lc  waikiki", "LC WAIKIKI.", "mcdonald's", "mcdonalds", "mcdonaldss", "po\tpetrol", "po petrol", "popetrol", "xbim", "bim-market", "daire", "dairesi", "daireler", "ödemeniz için teşekkür ederiz", "Kart Ödeme", "İSKİ", "ISPARK", "akaryakıt", "a101", "a 101", "_bim", "bim_", "airlines", "airline", "PARA ÇEKME", "media-markt", "google storage"]


def rows_of(spark, texts):
    return spark.createDataFrame([("x", i, t, "debit") for i, t in enumerate(texts)], "input_id string, seq long, description string, direction string")


def test_index_equals_the_patterns(spark):
    words = [w for _, _, _, ws in fixed.TAXONOMY for w in ws if not re.search(r"[?\\(]", w)]
    texts = [*ODD, *S.MERCHANT_TEXTS, *words, *(w.upper() for w in words), *(f"x {w} y" for w in words), *(f"x{w}" for w in words[:40])]
    rows = rows_of(spark, texts)
    names = [sub for _, _, sub, _ in fixed.TAXONOMY]
    got = {r["seq"]: None if r["ord"] is None else names[r["ord"]] for r in A.first_rule_by_index(rows).collect()}
    want = {r["seq"]: r["s"] for r in rows.select("seq", taxonomy.rule(M.matched_text(rows))["subcategory"].alias("s")).collect()}
    assert got == want and len(set(want.values())) == 19  # all subcategories with rules, and none


def test_spellings():
    assert sorted(taxonomy.spellings("airlines?")) == ["airline", "airlines"] and sorted(taxonomy.spellings("daire(?:si)?")) == ["daire", "dairesi"]
    assert taxonomy.spellings(r"po\s?petrol") is None and taxonomy.spellings("a.b") is None and taxonomy.spellings("h&m") == ["h&m"]
    literals, patterns = taxonomy.token_index()
    assert len(patterns) == 2 and all(ws for _, ws in patterns) and max(n for _, _, n in literals) == 5


def plain_similar(text, k):
    fold = lambda x: x.translate(str.maketrans("İıſK", "iisk")).lower()
    cut = lambda x: collections.Counter(p for w in re.findall(r"[^\W_]+", fold(x)) for p in [f"_{w}_"[i : i + 3] for i in range(len(w))])
    refs = [(i, x) for i, (c, sub, _) in enumerate(taxonomy.reference_texts()) if c != "other" for x in fixed.EXAMPLES[sub]]
    df = collections.Counter(p for _, x in refs for p in cut(x))
    unit = lambda c: {p: n * (1 + math.log((len(refs) + 1) / (df[p] + 1))) for p, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    v, out = unit(cut(text)), []
    for i, x in refs:
        u = unit(cut(x))
        if set(u) & set(v):
            out.append((-round(round(sum(v[p] * u[p] for p in v if p in u) / norm(u) / norm(v), 10), 4), i, x))
    return [(x, -s) for s, _, x in sorted(out)[:k]]


def test_similarity_equals_plain_cosine(spark):
    texts = [*S.MERCHANT_TEXTS, "", "!!", "a", "ab", "zzzz qqqq", "market market shell", "ÖDEME"]
    got = collections.defaultdict(list)
    for r in M.top_similar(spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string"), M.examples(spark), 3).orderBy("text", "rank").collect():
        got[r["text"]].append((r["example"], r["similarity"]))
    for t in texts:
        assert [x for x, _ in got[t]] == [x for x, _ in plain_similar(t, 3)], t
        assert [s for _, s in got[t]] == pytest.approx([s for _, s in plain_similar(t, 3)], abs=1.1e-4)


def test_categories_come_from_texts(spark):
    rows = rows_of(spark, ["MIGRSO", "TURKCEL", "XYZ 42", "MIGROS", "TEKNOSAA"]).unionByName(rows_of(spark, ["STARBUCK"]).withColumn("direction", F.lit("credit")).withColumn("seq", F.lit(9).cast("long")))
    found = A.categorized(rows, M.similar_texts(rows))
    got = {r["seq"]: (r["category"], r["subcategory"], r["method"]) for r in found.collect()}
    assert got == {0: ("other", "uncategorized", "fallback"), 1: ("telecom", "mobile_internet", "embedding"), 2: ("other", "uncategorized", "fallback"), 3: ("groceries", "supermarket", "rule"), 4: ("shopping", "electronics", "embedding"), 9: ("income_or_refund", "credit_transaction", "direction")}
    assert found.where("method = 'embedding' and not category_confidence between 0.52 and 0.90").count() == 0
    c = A.category_counts(found).first()
    assert (c["uncategorized_count"], c["rule_assisted_count"], c["embedding_assisted_count"]) == (2, 2, 2)
    m = {r["text"]: r["matched_reference"] for r in M.similar_texts(rows).collect()}
    assert m["turkcel turkcel"].startswith("category=telecom; subcategory=mobile_internet; examples=TURKCELL")
    assert M.similar_texts(rows.where("false")).count() == 0
