"""The pipeline's stages on a small corpus, and its effects on planted cases."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [[i, prose(rng, 150), "en", f"s{i % 3}", 0] for i in range(80)]
    passage = prose(rng, 70) + "."
    for i in (10, 20, 30):
        rows[i][1] = prose(rng, 60) + ".\n" + passage + "\n" + prose(rng, 60)
    rows[70][1] = rows[5][1]
    for i in range(0, 80, 4):
        rows[i][1] += " vilgoth vilgothen vilgoth"
    rows[75][1], rows[76][1], rows[77][1] = None, "", " "
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), int(i % 4 == 0 and i != 76)) for i in range(80) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, corpus):
    d, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.stored(out, "test")
        kept[name] = docs.collect()
    toxic = {i for i in range(80) if i % 4 == 0 and i != 76}
    after = {r["doc_id"] for r in kept["toxicity"]}
    assert len(after & toxic) <= 2 and len({*range(80)} - toxic - after) <= 4
    deduped = [r["doc_id"] for r in kept["ngram_jaccard_join"]]
    assert len(deduped) == len(set(deduped)) and 70 not in deduped
    holders = [r["doc_id"] for r in kept["substring_dedup"] if passage[100:200] in (r["text"] or "")]
    assert holders == [min(x for x in (10, 20, 30) if x in deduped)]
    assert {r["doc_id"] for r in kept["mixing"]} == {r["doc_id"] for r in kept["substring_dedup"]}
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == {r["doc_id"] for r in kept["mixing"]}
    pieces = [(r["doc_id"], r["piece"], r["copy"]) for r in kept["best_fit_packing"]]
    copies = collections.Counter(r["doc_id"] for r in kept["mixing"])
    assert len(pieces) == len(set(pieces)) and {(k, c) for k, _, c in pieces} == {(k, c) for k, n in copies.items() for c in range(n)}


def test_mixing_stage_meets_its_weights(spark, corpus):
    """Expected tokens by the rates of the stage, none of them under 1, against the weights."""
    d, _ = corpus
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    domains = corpus_pipeline.mixing.domain_labels(labels).where("domain < 2")
    rated = corpus_pipeline.mixing.mix(docs, domains, corpus_pipeline.WEIGHTS, budget="cover", least=1.0).collect()
    tokens = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][k] for r in rated) for k in range(2)]
    assert min(r["rate"] for r in rated) >= 1 and [x / sum(tokens) for x in tokens] == pytest.approx([0.93, 0.07], abs=1e-4)


def test_stages_take_odd_rows(spark, corpus):
    """Repeated rows, a doc_id with two texts, no doc_id, very long texts, columns with clashing names."""
    d, _ = corpus
    rng = random.Random(4)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id between 1 and 12")
    more = spark.createDataFrame([(1, prose(rng, 60), "en", "s", 0), (None, prose(rng, 50), None, None, None), (99, prose(rng, 9000), "en", "s", 1)], docs.schema)
    docs = docs.unionByName(docs).unionByName(more).withColumns({"rate": F.lit("x"), "score": F.lit(1), "class_id": F.lit(None).cast("int"), "copy": F.lit(7), "key": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, d), "odd")
        ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        assert {1, 99, None} <= ids, name
        docs = out.withColumns({"rate": F.lit("x"), "score": F.lit(1), "copy": F.lit(7), "key": F.lit(2)})


def test_run_on_empty_tables(spark, corpus, tmp_path):
    d, _ = corpus
    spark.read.parquet(f"{d}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
