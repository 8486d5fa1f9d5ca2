"""The pipeline's stages against what a plain version keeps, stage by stage."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm import pii, quality_classifier

from .test_table_operators import plain_components, plain_print


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {"documents": documents}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = corpus_pipeline.cut(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.schema.names == documents.schema.names
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in kept.items() if name != "best_fit_packing"}
    before = list(rows["documents"].values())

    known = rows["language_id"]
    assert all(r.doc_id in known for r in before if r.lang and r.text and re.search(r"[^\W\d_]", r.text) and labels.get(r.doc_id) == 1)
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in known.values())
    good = rows["quality_classifier"]
    assert all(i in good for i in known if labels.get(i) == 1)
    weights = quality_classifier.fit(kept["language_id"], quality_classifier.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    assert set(good) == {i for i, r in known.items() if quality_classifier.score_text(weights, r.text) >= corpus_pipeline.LEAST_QUALITY}

    labelled = [i for i in known if labels.get(i) is not None]
    assert np.mean([(i in good) == (labels[i] == 1) for i in labelled]) > 0.95

    classes = plain_components({i: plain_print(r.text) for i, r in good.items()})
    assert set(rows["simhash_near_dedup"]) == set(classes.values())
    assert len(rows["simhash_near_dedup"]) < len(good)
    for i, r in rows["pii"].items():
        assert r.text == pii.redact_text(good[i].text) and r.n_chars == len(r.text)
    assert set(rows["pii"]) == set(rows["simhash_near_dedup"])

    pieces = kept["best_fit_packing"].collect()
    assert {p.doc_id for p in pieces} == set(rows["pii"])
    fill = {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_near_duplicate_stage_on_odd_rows(spark, odd):
    got = corpus_pipeline.drop_near_duplicates(spark, odd, "")
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    # texts without a word are near each other; of three equal texts and a repeated row one stays; the null id stays
    assert 1 in ids and not {2, 3, 9, 10} & set(ids) and ids.count(8) == 1 and ids.count(None) == 1
    repeated = odd.where("doc_id = 10").union(odd.where("doc_id IS NULL")).union(odd.where("doc_id IS NULL"))
    assert sorted([r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, repeated, "").collect()], key=str) == [10, None]


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id(spark):
    a, b, c = "the first text of a few words", "quite another one on ships and the sea", "a third that has nothing to do with them"
    # two null ids and a repeated one, each with unlike texts; near copies without an id; a copy under the larger id
    rows = [(None, a), (None, b), (None, b), (7, c), (7, "no word of the others in here"), (9, "only once"), (None, c), (8, a + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, b), (7, c), (7, "no word of the others in here"), (9, "only once"), (8, a + "\n")], key=str)


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name != "quality_classifier"])
def test_stages_on_an_empty_table(spark, empty, stage):
    assert stage(spark, empty, "").count() == 0


def test_quality_stage_on_odd_rows(spark, sf, odd):
    got = corpus_pipeline.keep_quality(spark, odd, sf)
    assert got.columns == odd.columns and got.count() <= odd.count()
    assert corpus_pipeline.keep_quality(spark, odd.limit(0), sf).count() == 0
    masked = corpus_pipeline.redact_personal_data(spark, odd, sf)
    assert masked.where(F.col("text").isNull()).count() == 1 and masked.count() == odd.count()


def test_run_is_its_stages(spark, sf):
    docs = corpus_pipeline.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), name)
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.select(place).collect())) == sorted(map(tuple, docs.select(place).collect()))


def test_quality_stage_without_a_label_keeps_all(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_quality(spark, odd, str(tmp_path)).count() == odd.count()


def test_language_stage_rejects_texts_unlike_all_it_learnt(spark, documents):
    strange = ["Это русский текст, которого никто не знал", "日本語のテキスト", "1234 5678"]
    docs = documents.unionByName(spark.createDataFrame([(10**9 + 4 * i + 2, t, None, "x", len(t)) for i, t in enumerate(strange)], documents.schema))
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert not [i for i in got if i >= 10**9] and got == {r.doc_id for r in documents.collect()}


def test_stages_keep_columns_of_any_name(spark, sf, documents):
    more = {c: F.lit(i) for i, c in enumerate(("row", "found", "__found", "__id", "__null", "__hash", "__hash2", "fp", "root", "a.b"))}
    docs = documents.withColumns(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert got.select(*[f"`{c}`" for c in more]).distinct().collect() == [tuple(range(len(more)))], name
