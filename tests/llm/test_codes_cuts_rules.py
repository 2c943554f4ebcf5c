"""Vector codes, fill-in-middle and quality rules against plain code, on rows with nulls, repeats, empty and long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle, quality_ledger, vector_codes
from ledgerloom.llm.registry import QUERIES


def lloyd(rows, parts, entries, rounds, scale):
    """(codes and errors by row, codebook), everything summed anew in each round."""
    ints = [[math.floor(scale * x) for x in v] for _, v in rows]
    w = len(ints[0]) // parts
    cut = [[x[p * w : p * w + w] for p in range(parts)] for x in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    book = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((far(c[p], e), k) for k, e in enumerate(book[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    book[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = near()
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], book


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(7, rows[0][1], 5), (7, rows[0][1], 5), (None, [0.5] * 16, None), (500, [1000.25, -3.0] * 8, 1), (501, [0.1] * 16, 1), (502, [0.1] * 16, 1)]
    odd = [(900, None, 1), (901, [float("nan")] + [0.0] * 15, 1), (902, [None] + [0.0] * 15, 1), (903, [float("inf")] * 16, 1), (904, [], 1), (905, [0.1] * 8, 1), (906, [0.1] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows + odd], "vec_id long, embedding array<double>, label int, id string, n int").repartition(5)
    for parts, entries, rounds in ((8, 16, 6), (2, 3, 4), (4, 1, 1)):
        found, book, moved = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
        want, plain = lloyd([(a, b) for a, b, _ in rows], parts, entries, rounds, 4096)
        assert sorted(((r["id"] is None, r["id"] or 0, r["label"] is None, r["label"] or 0, r["code"], r["error"]) for r in found.collect())) == sorted((a is None, a or 0, c is None, c or 0, *w) for (a, _, c), w in zip(rows, want))
        assert book.tolist() == plain
        assert moved[0] >= moved[-1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ledgerloom")]


def test_codes_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], kind))[0].count() == 0
    found, book, _ = vector_codes.compress(spark.createDataFrame([(4, [0.25] * 8, None), (4, [0.25] * 8, None)], kind))
    assert [(r["code"], r["error"]) for r in found.collect()] == [("00" * 8, 0)] * 2 and book.shape == (8, 2, 1)
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(4, [1e30] * 8, None)], kind))[0].collect()


def test_rounds_shuffle_only_what_moved(spark):
    """A round's changes are those of parts whose code is another one than before."""
    import numpy as np

    rng = np.random.default_rng(1)
    x, old = rng.integers(-50, 50, (40, 8)), rng.integers(0, 3, (40, 4)).astype(np.uint8)
    new = old.copy()
    assert vector_codes.deltas(x, old, new, (4, 3, 2)) == []
    new[5, 2] = (old[5, 2] + 1) % 3
    got = {(d["part"], d["entry"]): d["plus"] for d in vector_codes.deltas(x, old, new, (4, 3, 2))}
    assert got == {(2, int(new[5, 2])): [1, *x[5, 4:6].tolist()], (2, int(old[5, 2])): [-1, *(-x[5, 4:6]).tolist()]}


def test_bucketed_join_has_no_shuffle(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0] * 4, 0) for i in range(50)], "id long, vector array<double>, label int")
    tables = vector_codes.Bucketed(spark, 3)
    chunks = vector_codes.packed(df, 8, 4).repartition(3, "chunk")
    vectors = tables.put(chunks, "vectors")
    import numpy as np

    book = np.zeros((8, 2, 1), np.int64)
    codes = tables.put(vector_codes.assigned(vectors, None, book), "codes")
    plan = vector_codes.assigned(vectors, codes, book)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    tables.release()


TEXTS = ["", None, "\n", "a", "a\n", "\n\na\n", "one\ntwo\nthree", "has <P> in it\nmore", "<S>", "x<M>", "ends with <\nP>", "Ünï\nçödé 日本語\n😀 😀\n" * 50, "no line end " * 3000, "l\n" * 5000, "a\r\nb\r\n", "<", "<P\n>"]


def test_cuts_equal_plain_code(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS * 3)] + [(3, "other\ntext\n", 0), (3, "other\ntext\n", 0), (None, "no\nid", 1), (None, None, 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n long, form string").repartition(4)
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        got = Counter()
        for r in fill_middle.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect():
            assert r["back"] == r["text"]
            got[r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]] += 1
        want = Counter()
        for d, t, _ in rows:
            t = t or ""
            u = re.findall(r"[^\n]*\n|[^\n]+", t)
            h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
            h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
            a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
            p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
            form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
            out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            want[d, t, len(u), form, *((None, None) if form == "plain" else (len(p), len(m))), out] += 1
        assert got == want
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0


def test_cuts_run_in_columns(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = fill_middle.cuts(fill_middle.keyed(df, "doc_id", "text"), fill_middle.UNIT, 7, 100, 50)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def plain_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)


def some_texts():
    rng = random.Random(2)
    out = [None, "", " \t\n", "a", "a a a a a a", "a b c d e a b c d e f", "x y   z", "l\nl\n l\n\n\n", "# | * $ words", "w" * 4000, "😀 ü " * 30]
    return out + [" ".join(rng.choice("ab\n") + rng.choice(["", "c"]) for _ in range(rng.randint(1, 400))) for _ in range(40)] + [" ".join(f"w{rng.randint(0, 9000)}" for _ in range(20000)) + " one two three four five six" * 2]


def test_measures_equal_plain_code():
    for t in some_texts():
        assert quality_ledger.measured(t or "") == plain_measures(t)


def test_runs_of_many_words_are_ranked_exactly():
    import numpy as np

    rng = np.random.default_rng(4)
    ids = rng.integers(0, 9000, 30000)
    ids[20000:20050] = ids[100:150]
    ids[:6] = 8999
    assert quality_ledger.repeated(ids, 9000) == quality_ledger.repeated(ids, 6000_00) >= 100


def test_policies_and_ablation(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i % 50, t, i % 3, "s") for i, t in enumerate(texts)], "doc_id long, text string, part int, n_words string").repartition(3)
    rows = quality_ledger.ledger(df, carry=("doc_id", "part")).cache()
    assert rows.count() == len(texts)
    bits = {name: 1 << i for i, (name, _) in enumerate(quality_ledger.RULES)}
    plain = []
    for i, t in enumerate(texts):
        n, c, s, lines, dup, again = plain_measures(t)
        failed = [x for x, f in zip(bits, (n < 10, 100 * again > 20 * n, 10 * s > n, c > 10 * n, c < 3 * n, 10 * dup > 3 * lines, n > 100000)) if f]
        plain.append((i % 50, i % 3, sum(bits[x] for x in failed), failed))
    assert sorted((r["doc_id"], r["part"], r["failures"]) for r in rows.collect()) == sorted(x[:3] for x in plain)
    kept = rows.where(~quality_ledger.fails(("quality", 2))).count()
    assert kept == sum(not {"few_words", "repeated_words", "symbols"} & set(f) for *_, f in plain)
    for r in quality_ledger.ablation(rows, by=("part",)).collect():
        mine, names = [set(f) for _, p, _, f in plain if p == r["part"]], set(quality_ledger.POLICIES[r["policy"], r["version"]])
        assert (r["n_rows"], r["n_rejected"]) == (len(mine), sum(bool(f & names) for f in mine))
        assert (r["n_failed"], r["n_only"]) == (sum(r["rule"] in f for f in mine), sum(f & names == {r["rule"]} for f in mine))
    for r in quality_ledger.overlap(rows, by=("part",)).collect():
        mine = [set(f) for _, p, _, f in plain if p == r["part"]]
        assert set(r["any_failed"]) == set.union(*mine) and set(r["all_failed"]) == set.intersection(*mine)
    assert quality_ledger.ablation(rows.where("false")).count() == 0 and quality_ledger.ledger(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        quality_ledger.ledger(df, carry=("n_words",))


def test_rules_keep_sentences_and_reject_markup(spark):
    """On the driver's labelled documents: hardly any of good quality goes beyond what the base rejects, and markup does."""
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op13_quality_rules"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0"), "doc_id").where("not base_failed")
    by = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert by[1]["kept"] == by[1]["n"] and by[0]["kept"] <= 0.1 * by[0]["n"]
